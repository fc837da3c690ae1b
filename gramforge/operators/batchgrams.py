"""Character n-grams of whole batches, each counted in one task.

A gram is no more frequent than its prefix and its suffix of one character less.
Grams are counted length by length over numbers of characters: a start is looked
at for a length only if the grams one shorter there and at the next start are
frequent, and two such numbers name the longer gram. That is exact, nothing but
the sentences is shuffled, and rows are made of frequent grams only. Containment
follows the same links: whatever contains a gram and is frequent contains one of
its frequent extensions by one character, or is one.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value

#: What a batch's grams are returned as.
COLUMNS = pa.schema([("batch_id", pa.int64()), ("seqchar", pa.string()), ("length", pa.int32()), ("freq", pa.float64())])
#: Pairs of numbers are counted in a table of up to this many places for each
#: pair, and by sorting beyond it.
PLACES = 8


@dataclass
class Level:
    """Frequent grams of one length: a start and the count of each, and the
    numbers of its prefix and suffix among the grams one shorter."""

    length: int
    start: np.ndarray
    freq: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray


def characters(sentences: pa.Array | pa.ChunkedArray, removes: str) -> np.ndarray:
    """Code points of all sentences, without ``removes``; -1 ends a sentence."""
    sentences = sentences.drop_null()
    try:
        pieces = sentences.to_pylist()
    except UnicodeDecodeError:
        pieces = [b.decode("utf-8", "replace") for b in sentences.cast(pa.binary()).to_pylist()]
    text, lengths = "".join(pieces), np.array([len(p) for p in pieces], dtype=np.int64)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<i4")
    out = np.full(len(codes) + len(lengths), -1, dtype=np.int32)
    out[np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)] = codes
    return out[~np.isin(out, [ord(c) for c in removes])] if removes else out


def _frequent(pairs: np.ndarray, places: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of ``pairs`` that occur ``least`` times, their counts, and for each
    pair its value's number among them or -1."""
    if places <= max(PLACES * len(pairs), 1 << 16):
        counts = np.bincount(pairs, minlength=places)
        values = np.flatnonzero(counts >= least)
        number = np.full(places, -1, dtype=np.int32)
        number[values] = np.arange(len(values), dtype=np.int32)
        return values, counts[values], number[pairs]
    found, at, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    keep = counts >= least
    number = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32)
    return found[keep], counts[keep], number[at]


def frequent_grams(codes: np.ndarray, low: int, high: int, min_count: int) -> list[Level]:
    """Grams of ``low`` to ``high`` characters more frequent than ``min_count``."""
    least = max(min_count + 1, 1)
    starts = np.flatnonzero(codes >= 0).astype(np.int32 if len(codes) < 2**31 else np.int64)
    if not len(starts) or high < low:
        return []
    _, freq, numbers = _frequent(codes[starts], int(codes.max()) + 1, least)
    starts, numbers = starts[numbers >= 0], numbers[numbers >= 0]
    first = np.full(len(codes) + 1, -1, dtype=np.int32)
    first[starts] = numbers
    letters, grams, here, levels = len(freq), len(freq), first.copy(), []
    prefix = suffix = np.empty(0, dtype=np.int32)
    for length in range(1, high + 1):
        if length > 1:
            go = here[starts + 1] >= 0
            starts, numbers = starts[go], numbers[go]
            pairs = numbers.astype(np.int64) * letters + first[starts + (length - 1)]
            values, freq, numbers = _frequent(pairs, grams * letters, least)
            starts, numbers = starts[numbers >= 0], numbers[numbers >= 0]
        some = np.zeros(len(freq), dtype=starts.dtype)
        some[numbers] = starts
        if length > 1:
            prefix, suffix = values // letters, here[some + 1]
            here.fill(-1)
            here[starts] = numbers
        if not len(freq):
            break
        grams = len(freq)
        if length >= low:
            levels.append(Level(length, some, freq, prefix, suffix))
    return levels


def uncontained(levels: list[Level]) -> list[np.ndarray]:
    """Of each level, whether no gram of greater (1 + freq) * length contains a gram."""
    out: list[np.ndarray] = []
    above = np.full(len(levels[-1].freq), -np.inf) if levels else None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        key = (1.0 + level.freq) * level.length
        out.append(above <= key)
        if k:
            best = np.maximum(above, key)
            above = np.full(len(levels[k - 1].freq), -np.inf)
            np.maximum.at(above, level.prefix, best)
            np.maximum.at(above, level.suffix, best)
    return out[::-1]


def texts(codes: np.ndarray, starts: np.ndarray, length: int) -> pa.Array:
    """The ``length`` characters from each start."""
    taken = codes[starts[:, None] + np.arange(length)]
    size = 1 + (taken >= 0x80).astype(np.int32) + (taken >= 0x800) + (taken >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(size.sum(axis=1))]).astype(np.int32)
    data = np.ascontiguousarray(taken, dtype="<i4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def counter(low: int, high: int, min_count: int, removes: str, top_only: bool) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    """For ``applyInArrow`` on groups of (batch, sentence): (batch, seqchar, length,
    freq) of frequent grams; ``top_only`` leaves out those that a gram of greater
    (1 + freq) * length contains."""

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        codes = characters(rows.column(1), removes)
        levels = frequent_grams(codes, low, high, min_count)
        kept = uncontained(levels) if top_only else [slice(None)] * len(levels)
        found = []
        for level, keep in zip(levels, kept, strict=True):
            starts, freq = level.start[keep], level.freq[keep].astype(np.float64)
            batches, lengths = np.full(len(starts), key[0].as_py(), dtype=np.int64), np.full(len(starts), level.length, dtype=np.int32)
            found.append(pa.RecordBatch.from_arrays([pa.array(batches), texts(codes, starts, level.length), pa.array(lengths), pa.array(freq)], schema=COLUMNS))
        return pa.Table.from_batches(found, COLUMNS)

    return work


# Workers get this module with the function and need not import it.
register_pickle_by_value(sys.modules[__name__])
