"""Originality: one minus the greatest similarity to a higher-ranked phrase.

Only phrases above the threshold are returned, with exact values:

1. Every phrase meets the ``HEADS`` best-ranked phrases of each of its trigrams.
   That costs the same for each phrase, whatever trigrams are common, drops most
   phrases that a higher one resembles, and gives the others a similarity that
   any closer phrase must exceed.
2. What is left meets all higher-ranked phrases, in blocks: an equality join on
   pairs of blocks, each of a size that does not depend on the corpus, so that
   nothing that grows is broadcast. Two phrases' lengths and characters bound
   their similarity; the distance is computed only where the bound exceeds what
   was found before, and a block pair returns one row for each phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import similarity
from ..sources.shared import broadcast_upto, cut

_RANK = ["knowns", "_key", "seqchar"]
#: Best-ranked phrases of a trigram that its other phrases meet first.
HEADS = 16
#: Phrases of a block.
BLOCK = 4096
#: Tasks of the block pairs at most, and phrases whose verdict is broadcast.
TASKS = 20_000
BROADCAST_ROWS = 500_000


def _above(h: str, lo: str) -> Column:
    """Whether row h ranks above row lo."""
    a, b = (lambda c: F.col(f"{h}.{c}")), (lambda c: F.col(f"{lo}.{c}"))
    key = (a("_key") > b("_key")) | ((a("_key") == b("_key")) & (a("seqchar") < b("seqchar")))
    return (a("knowns") & ~b("knowns")) | ((a("knowns") == b("knowns")) & key)


def _similarity(a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), similarity(F.col(f"{a}.seqchar"), F.col(f"{b}.seqchar")))


def _first_look(ranked: DataFrame) -> DataFrame:
    """(seqchar, _sim): greatest similarity to a higher one of the best-ranked
    phrases of its trigrams; phrases without any have no row."""
    n = F.length("seqchar")
    grams = ranked.filter(n >= 3).select(*_RANK, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring("seqchar", i, F.lit(3))))).alias("_g"))
    best = Window.partitionBy("_g").orderBy(F.desc("knowns"), F.desc("_key"), F.asc("seqchar"))
    heads = grams.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= HEADS).drop("_r")
    met = grams.alias("l").join(heads.alias("h"), (F.col("l._g") == F.col("h._g")) & _above("h", "l"))
    met = met.select(F.col("l.seqchar").alias("seqchar"), _similarity("l", "h").alias("_sim"))
    return met.groupBy("seqchar").agg(F.max("_sim").alias("_sim"))


def _characters(s: Column) -> Column:
    """The characters of a phrase as a set of 64 hashed bits."""
    def bit(c: Column) -> Column:
        place = F.pmod(F.xxhash64(c), F.lit(64)).cast("int")
        return F.when(c == "", F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))

    return F.aggregate(F.transform(F.split(s, ""), bit), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def _bound(a: str, b: str) -> Column:
    """No less than the similarity of two phrases.

    Each unit of distance leaves out at most one character of the longer one that
    the other has too; shared characters are at most the shared bits plus the
    repeats of the phrase with fewer of them.
    """
    la, lb = F.col(f"{a}._len"), F.col(f"{b}._len")
    extra = F.least(F.col(f"{a}._extra"), F.col(f"{b}._extra"))
    shared = F.least(F.bit_count(F.col(f"{a}._bits").bitwiseAND(F.col(f"{b}._bits"))) + extra, la, lb)
    return F.lit(1.0) - (F.greatest(la, lb) - shared) / ((la + lb) / F.lit(2.0))


def _blocks(rows: DataFrame, own: int, others: int, mine_first: bool) -> DataFrame:
    """Every row once for each block of the other side, under the pair's number."""
    block = F.pmod(F.xxhash64("seqchar"), F.lit(own))
    copies = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    pair = block * others + F.col("_o") if mine_first else F.col("_o") * own + block
    return copies.withColumn("_pair", pair.cast("int")).drop("_o")


def _all_higher(left: DataFrame, ranked: DataFrame) -> DataFrame:
    """(seqchar, _sim) of rows of ``left`` (with _sim, found before) that are more
    similar than that to some higher row of ``ranked``."""
    bits = _characters(F.col("seqchar"))

    def measured(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"_len": F.length("seqchar"), "_bits": bits})
        return rows.withColumn("_extra", F.col("_len") - F.bit_count("_bits"))

    a, b = max(1, -(-left.count() // BLOCK)), max(1, -(-ranked.count() // BLOCK))
    tasks = min(TASKS, a * b)
    low = _blocks(measured(left.select(*_RANK, "_sim")), a, b, True).repartition(tasks, "_pair").alias("l")
    high = _blocks(measured(ranked.select(*_RANK)), b, a, False).repartition(tasks, "_pair").alias("h")
    close = (F.col("l._pair") == F.col("h._pair")) & _above("h", "l") & (_bound("l", "h") > F.col("l._sim"))
    found = low.join(high.hint("shuffle_hash"), close).select(F.col("l.seqchar").alias("seqchar"), _similarity("l", "h").alias("_sim"))
    return found.groupBy("seqchar").agg(F.max("_sim").alias("_sim"))


def remove_similar(ranked: DataFrame, threshold: float) -> DataFrame:
    """Phrases with originality above the threshold, ``originality`` added.

    ``ranked`` has knowns, _key and one row per seqchar. Every row is compared
    against, also those that are dropped here.
    """
    ranked = cut(ranked)
    first = broadcast_upto(cut(_first_look(ranked)), BROADCAST_ROWS)
    left = ranked.join(first, "seqchar", "left").withColumn("_sim", F.coalesce("_sim", F.lit(0.0)))
    left = cut(left.filter(F.lit(1.0) - F.col("_sim") > threshold))
    more = broadcast_upto(cut(_all_higher(left, ranked).withColumnRenamed("_sim", "_more")), BROADCAST_ROWS)
    best = F.greatest(F.col("_sim"), F.coalesce("_more", F.lit(0.0)))
    out = left.join(more, "seqchar", "left").withColumn("originality", F.lit(1.0) - best).drop("_sim", "_more")
    return out.filter(F.col("originality") > threshold)
