"""Junk filter and shape selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PhraseConfig
from ..functions.expressions import any_of, contains_junk, first_match, full_match, is_periodic, last_label


def exclude_unnecessary(phrases: DataFrame, junk: tuple[str, ...]) -> DataFrame:
    return phrases.filter(~contains_junk(F.col("seqchar"), junk)) if junk else phrases


def column_names(patterns: dict[str, str]) -> list[str]:
    """Pattern names as column names: one that differs from an earlier one in
    case only (alpha, ALPHA) gets a trailing underscore."""
    out: list[str] = []
    for name in patterns:
        while name.lower() in map(str.lower, out):
            name += "_"
        out.append(name)
    return out


def flag_columns(seqchar: Column, patterns: dict[str, str]) -> list[Column]:
    return [full_match(seqchar, p).alias(name) for name, p in zip(column_names(patterns), patterns.values(), strict=True)]


def match_columns(seqchar: Column, patterns: dict[str, str]) -> list[Column]:
    """One column per pattern: the first match found in the phrase, or null."""
    return [first_match(seqchar, p).alias(name) for name, p in patterns.items()]


def shape_filter(phrases: DataFrame, cfg: PhraseConfig) -> DataFrame:
    """Phrases that pass the selection, without its columns."""
    s = F.col("seqchar")
    return phrases.filter(
        any_of([full_match(s, p) for p in cfg.positive.values()])
        & (F.col("length") <= cfg.max_length)
        & ~any_of([full_match(s, p) for p in cfg.negative.values()])
        & ~is_periodic(s, cfg.len_period)
    )


def select_phrases(phrases: DataFrame, cfg: PhraseConfig) -> DataFrame:
    """Selected phrases with match_ptn, negative_ptn (null, as rows with one
    are gone), a flag per pattern and periodic."""
    s = F.col("seqchar")
    flagged = phrases.select("*", *flag_columns(s, cfg.positive), *flag_columns(s, cfg.negative), is_periodic(s, cfg.len_period).alias("periodic"))
    names = {"positive": column_names(cfg.positive), "negative": column_names(cfg.negative)}
    positive = [(n, F.col(f"`{c}`")) for n, c in zip(cfg.positive, names["positive"], strict=True)]
    negative = [(n, F.col(f"`{c}`")) for n, c in zip(cfg.negative, names["negative"], strict=True)]
    labelled = flagged.withColumns({"match_ptn": last_label(positive), "negative_ptn": last_label(negative)})
    kept = labelled.filter(
        any_of([c for _, c in positive]) & (F.col("length") <= cfg.max_length) & ~any_of([c for _, c in negative]) & ~F.col("periodic")
    )
    first = [c for c in phrases.columns if c != "originality"]
    tail = ["originality"] if "originality" in phrases.columns else []
    return kept.select(*first, "match_ptn", "negative_ptn", *tail, *[f"`{c}`" for c in names["positive"] + names["negative"]], "periodic")
