"""Column expressions on phrases; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import translate


def score(freq: Column, length: Column, weight_freq: float = 1.0, weight_len: float = 1.0) -> Column:
    """weight_freq * ln(1 + freq) + weight_len * ln(length)."""
    return F.lit(float(weight_freq)) * F.ln(F.lit(1.0) + freq) + F.lit(float(weight_len)) * F.ln(length.cast("double"))


def exact_key(weight_freq: float, weight_len: float) -> bool:
    """Whether phrases rank by the exact product (1 + freq) * length."""
    return weight_freq == weight_len and weight_freq > 0


def rank_key(freq: Column, length: Column, weight_freq: float = 1.0, weight_len: float = 1.0) -> Column:
    """A key that orders as ``score`` does, without ties broken by rounding.

    With equal positive weights the exact product (1 + freq) * length; else the
    score to 12 places.
    """
    if exact_key(weight_freq, weight_len):
        return (F.lit(1.0) + freq) * length
    return F.round(score(freq, length, weight_freq, weight_len), 12)


def is_periodic(s: Column, period: int = 2) -> Column:
    """Whether a phrase only repeats its first ``period`` characters.

    Up to 2 characters: no. 3 characters: all equal. Longer: each step of
    ``period`` characters contains the first step; a last step of exactly one
    character is not looked at.
    """
    n = F.length(s)
    head = F.substring(s, 1, period)
    if period == 2:
        long = F.substring(s, F.lit(1), 2 * F.floor(n / 2).cast("int")) == F.repeat(head, F.floor(n / 2).cast("int"))
    else:
        starts = F.filter(F.sequence(F.lit(1), n, F.lit(period)), lambda i: i != n)
        long = F.forall(starts, lambda i: F.contains(F.substring(s, i, F.lit(period)), head))
    return F.when(n <= 2, F.lit(False)).when(n == 3, s == F.repeat(F.substring(s, 1, 1), F.lit(3))).otherwise(long)


def full_match(s: Column, pattern: str) -> Column:
    """Whether the leftmost match of the pattern spans all of ``s``."""
    p = translate(pattern)
    return s.rlike(p) & (F.regexp_extract(s, p, 0) == s)


def first_match(s: Column, pattern: str) -> Column:
    """The leftmost match, null if there is none."""
    p = translate(pattern)
    return F.when(s.rlike(p), F.regexp_extract(s, p, 0))


def last_label(flags: list[tuple[str, Column]]) -> Column:
    """Name of the last flag that is set, null if none is."""
    if not flags:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(flag, F.lit(name)) for name, flag in reversed(flags)])


def any_of(flags: list[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the mean length; may be negative."""
    return F.lit(1.0) - F.levenshtein(a, b) / ((F.length(a) + F.length(b)) / F.lit(2.0))


def contains_junk(s: Column, junk: tuple[str, ...]) -> Column:
    """Whether one of the regular expressions is found in ``s``."""
    return any_of([s.rlike(translate(u)) for u in junk])


def strip_characters(s: Column, removes: str | tuple[str, ...]) -> Column:
    """``s`` without the given characters (or, in order, substrings)."""
    singles = "".join(removes)
    if all(len(r) == 1 for r in removes):
        return F.translate(s, singles, "") if singles else s
    for r in removes:
        s = F.replace(s, F.lit(r), F.lit("")) if r else s
    return s


def count_occurrences(s: Column, term: str) -> Column:
    """Non-overlapping occurrences of ``term``, from the left."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("bigint")
