"""Joining the batches' phrase tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regroup(phrases: DataFrame) -> DataFrame:
    """(seqchar, length, freq): frequencies summed over the batches in which
    the phrase survived."""
    return phrases.groupBy("seqchar").agg(F.first("length").alias("length"), F.sum("freq").alias("freq"))
