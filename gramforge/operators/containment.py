"""Ranking, and dropping phrases contained in higher-ranked ones.

The theta join "is a substring of a higher-ranked phrase" is rewritten to an
equality join: every phrase offers its proper substrings of the lengths that
occur, each with the rank of the phrase; substrings keep their best offer; a
phrase is dropped if the best offer under its own text ranks above it. The cost
is linear in the number of phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PhraseConfig
from ..functions.expressions import rank_key, score
from .knowns import is_known


def add_rank(phrases: DataFrame, cfg: PhraseConfig) -> DataFrame:
    """Adds sc_index, knowns and _key, on which phrases rank."""
    freq, length = F.col("freq"), F.col("length")
    return phrases.withColumns(
        {
            "sc_index": score(freq, length, cfg.weight_freq, cfg.weight_len),
            "knowns": is_known(F.col("seqchar"), cfg.knowns),
            "_key": rank_key(freq, length, cfg.weight_freq, cfg.weight_len).cast("double"),
        }
    )


def _proper_substrings(ranked: DataFrame, by: list[str], shortest: int, rank: Column) -> DataFrame:
    """(*by, seqchar, _offer) for every proper substring of every phrase."""
    n = F.length("seqchar")
    return (
        ranked.filter(n > shortest)
        .select(*by, "seqchar", rank.alias("_offer"), F.explode(F.sequence(F.lit(shortest), n - 1)).alias("_n"))
        .select(*by, "seqchar", "_offer", "_n", F.explode(F.sequence(F.lit(1), F.length("seqchar") - F.col("_n") + 1)).alias("_i"))
        .select(*by, F.substring("seqchar", F.col("_i"), F.col("_n")).alias("seqchar"), "_offer")
    )


def _shortest(cfg: PhraseConfig) -> int:
    return min([max(1, cfg.min_length), *map(len, cfg.knowns)])


def drop_contained_batch(phrases: DataFrame, cfg: PhraseConfig, *keep: str) -> DataFrame:
    """Within each batch: drop a phrase if a strictly higher one contains it.

    At equal rank the contained phrase stays: as an n-gram it is met first. Of
    two rows with one text the better stays (the known one on ties).
    """
    by = list(keep)
    ranked = add_rank(phrases, cfg)
    if cfg.knowns:
        ranked = ranked.groupBy(*by, "seqchar").agg(F.max_by(F.struct("length", "freq", "sc_index", "knowns", "_key"), F.struct("_key", "freq")).alias("_best")).select(*by, "seqchar", "_best.*")
    rank = F.struct(F.col("knowns").alias("k"), F.col("_key").alias("s"))
    offers = _proper_substrings(ranked, by, _shortest(cfg), rank).groupBy(*by, "seqchar").agg(F.max("_offer").alias("_offer"))
    joined = ranked.join(offers, [*by, "seqchar"], "left")
    return joined.filter(F.col("_offer").isNull() | (F.col("_offer") <= rank)).drop("_offer")


def drop_contained_final(phrases: DataFrame, cfg: PhraseConfig) -> DataFrame:
    """Over the whole corpus: as above, but ties go to the lesser text."""
    ranked = add_rank(phrases, cfg)
    rank = F.struct((~F.col("knowns")).alias("k"), (-F.col("_key")).alias("s"), F.col("seqchar").alias("t"))
    offers = _proper_substrings(ranked, [], _shortest(cfg), rank).groupBy("seqchar").agg(F.min("_offer").alias("_offer"))
    joined = ranked.join(offers, ["seqchar"], "left")
    return joined.filter(F.col("_offer").isNull() | (F.col("_offer") >= rank)).drop("_offer")
