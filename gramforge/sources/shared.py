"""Checkpoints in the cluster's shared folder, and checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Materialise reliably, in the folder that ``spark.checkpoint.dir`` names.

    A folder of our own is made only in a single-process session without one.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="gramforge-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def broadcast_upto(df: DataFrame, rows: int) -> DataFrame:
    """A materialised ``df``, hinted for broadcast only if it is that small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
