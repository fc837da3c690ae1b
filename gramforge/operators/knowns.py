"""Known terms: counting and joining them to the n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import count_occurrences


def count_knowns(sentences: DataFrame, knowns: list[str] | tuple[str, ...], *keep: str, sentence: str = "sentence") -> DataFrame:
    """(*keep, seqchar, length, freq): non-overlapping occurrences of each term
    in the raw sentences, zero counts included, a repeated term once.

    One pass over the sentences, whatever the number of terms.
    """
    terms = list(dict.fromkeys(knowns))
    if any(t == "" for t in terms):
        raise ValueError("an empty known term occurs everywhere")
    spark = sentences.sparkSession
    if not terms:
        kinds = dict(sentences.dtypes)
        head = "".join(f"`{k}` {kinds[k]}, " for k in keep)
        return spark.createDataFrame([], head + "seqchar string, length int, freq double")
    totals = sentences.groupBy(*keep).agg(
        F.array(*[F.coalesce(F.sum(count_occurrences(F.col(sentence), t)), F.lit(0)) for t in terms]).alias("_n")
    )
    names = F.array(*[F.lit(t) for t in terms])
    return totals.select(*keep, F.explode(F.arrays_zip(names.alias("t"), F.col("_n").alias("n"))).alias("_z")).select(
        *keep, F.col("_z.t").alias("seqchar"), F.length("_z.t").alias("length"), F.col("_z.n").cast("double").alias("freq")
    )


def is_known(seqchar: Column, knowns: list[str] | tuple[str, ...]) -> Column:
    return seqchar.isin(list(knowns)) if knowns else F.lit(False)


def union_known_ngrams(known_counts: DataFrame, ngrams: DataFrame) -> DataFrame:
    """All rows of both; a term that is also a frequent n-gram comes twice."""
    return known_counts.unionByName(ngrams)
