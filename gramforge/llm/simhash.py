"""SimHash near-duplicate detection with pivot distance tables.

1. Fingerprint: 128 bits, each the majority vote of one bit of the hashes of a
   document's distinct words and distinct word pairs (case and punctuation
   apart). Equal fingerprints collapse to one node at once.
2. Blocks: nodes are dealt into blocks by hash, and blocks meet two by two in
   tasks of their own, so that every pair of nodes meets in exactly one task.
   There is no sampling: every pair within the threshold is found, at any size.
   A block has up to ``BLOCK`` nodes, so copies of a node grow as nodes / BLOCK,
   and the work with the square of the nodes.
3. Within a task, small sides are compared whole: nodes are sorted by the
   coordinate that varies most of their distances to ``PIVOTS`` reference
   fingerprints, and meet only nodes within the threshold of them there (the
   triangle inequality); these are verified bit by bit. Large sides are first
   cut down by parts: of threshold + 1 disjoint parts of the bits, a pair within
   the threshold agrees in one at least, so of parts joined ``n`` by ``n`` it has
   one in which at most n - 1 bits differ. Only nodes with such a part are
   compared; a pair counts in the first such part.
4. A task does not emit pairs but what they add up to: how many documents each
   node is near to, and edges that span the groups it sees.
5. Groups: connected components over the edges (alternating large-star and
   small-star rounds), all distributed; the least id of a group stays.

Defined results
---------------
* null id, null text, or text without a single word character: takes no part;
  the filter keeps such rows.
* ids of any type that has an order; they come back as they are.
* rows that share an id are one document and share its fate; links are counted
  in rows.
* ties (equal distances, equal fingerprints): the least id of a group stays.
* very long texts: processed whole, a part at a time.
* empty table: empty result.  Extra columns, whatever their names: untouched.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import add_up, components, cut, edges_and_links, named, row_count, slices, split_crowded, true_places as _true, whole_tasks, without

BITS = 128
#: Pairs within this Hamming distance are near duplicates.
THRESHOLD = 26
#: Probability, at the threshold, of agreement in one part that tests ask of ``layout``. The search itself is exact.
RECALL = 0.97
#: Nodes that are always compared whole.
CELL = 512
#: Nodes of a block at most. Fewer where that gives too few tasks: ``BLOCKS`` blocks, but of ``LEAST_BLOCK`` nodes or more.
BLOCK = 262_144
BLOCKS = 8
LEAST_BLOCK = 8_192
#: Reference fingerprints of a pivot table.
PIVOTS = 16
#: Pairs that are compared at once, pairs that are handed on at once, and rows of tasks that are held at once.
PAIRS = 1 << 17
HANDED = 1 << 18
BUFFER = 1 << 18
#: What a lookup of one value of a part costs, in pairs compared.
LOOKUP_PAIRS = 15_000
#: Identifiers up to this number are sent to the texts, not the texts to them.
BROADCAST_IDS = 4_000_000

#: Characters hashed at once.
_PART = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
#: Bits of a byte as eight counters in one word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).reshape(-1)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it belongs to words, and a hash of its lower case."""
    every = "".join(map(chr, range(0x110000)))
    word = np.zeros(len(every), dtype=bool)
    for m in re.finditer(r"\w+", every):
        word[m.start() : m.end()] = True
    lower = np.arange(len(every), dtype=np.uint64)
    for c in np.flatnonzero(word).tolist():
        small = every[c].lower()
        if len(small) == 1:
            lower[c] = ord(small)
    return word, _scramble((lower + np.uint64(1)) * _MULTIPLIER)


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    up, down = np.ones(_PART, dtype=np.uint64), np.ones(_PART, dtype=np.uint64)
    up[1:], down[1:] = _BASE, pow(_BASE, -1, 2**64)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the lower case of every word, where the word begins)."""
    word, value = _characters()
    up, down = _powers()
    hashes, places, begin = [], [], 0
    while begin < len(text):
        points = np.frombuffer(text[begin : begin + _PART].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = word[points]
        if inside[-1] and begin + _PART < len(text):
            # The last word may go on: leave it to the next part, unless it is all there is.
            gaps = np.flatnonzero(~inside)
            if len(gaps):
                inside, points = inside[: gaps[-1] + 1], points[: gaps[-1] + 1]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        first, after = edges[::2], edges[1::2]
        # Polynomial hashes of all words as differences of one running sum.
        running = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(value[points] * up[: len(points)], out=running[1:])
        hashes.append(_scramble((running[after] - running[first]) * down[first]))
        places.append(first + begin)
        begin += len(points)
    return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(places or [np.zeros(0, np.int64)])


def _fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints as uint64 [n, 2], whether the text has any word), of at most 65,536 texts."""
    out = np.zeros((len(texts), 2), dtype=np.uint64)
    some = np.zeros(len(texts), dtype=bool)
    hashes, place = _word_hashes("\n".join(texts))
    if not len(hashes):
        return out, some
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), place, side="right")
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    two = _scramble(hashes[pair] * _MULTIPLIER ^ (hashes[pair + 1] + (hashes[pair] >> np.uint64(29))))
    # 16 bits of the text's number, 48 of the hash: sorting finds what is distinct.
    own = doc.astype(np.uint64) << np.uint64(48)
    key = np.concatenate([own | hashes >> np.uint64(16), own[pair] | two >> np.uint64(16)])
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]]
    owner, seed = (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.diff(np.r_[starts, len(owner)])
    # Votes are summed in runs of at most 255 hashes, which byte counters can hold.
    runs = -(-sizes // 255)
    first = np.cumsum(runs) - runs
    begins = np.repeat(starts - first * 255, runs) + np.arange(runs.sum()) * 255
    votes = np.empty((len(starts), BITS), dtype=np.int64)
    for half, bits in enumerate((_scramble(seed * _MULTIPLIER), _scramble(seed * np.uint64(_BASE) + np.uint64(1)))):
        octets = bits.view(np.uint8).reshape(-1, 8)
        for j in range(8):
            lanes = np.add.reduceat(_LANES[octets[:, j]], begins).view(np.uint8).reshape(-1, 8)
            at = 64 * half + 8 * j
            votes[:, at : at + 8] = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
    some[owner[starts]] = True
    out[owner[starts]] = np.packbits(votes * 2 > sizes[:, None], axis=1).view(np.uint64)
    return out, some


def fingerprint(text: str) -> tuple[int, int] | None:
    """Fingerprint of one text; None without words."""
    fp, some = _fingerprints([text])
    return (int(fp[0, 0]), int(fp[0, 1])) if some[0] else None


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 1 << 16):
            for part in slices(batch.slice(begin, 1 << 16), budget=_PART):
                fp, some = _fingerprints(part.column(1).to_pylist())
                signed = fp.view(np.int64)[some]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(pa.array(some)), pa.array(signed[:, 0]), pa.array(signed[:, 1])],
                    names=["_gf_id", "_gf_f0", "_gf_f1"],
                )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_gf_id, _gf_f0, _gf_f1) of every row that has an id and a word."""
    rows = docs.select(named(docs, id_col).alias("_gf_id"), named(docs, text_col).alias("_gf_text")).filter("_gf_id IS NOT NULL AND _gf_text IS NOT NULL")
    schema = StructType([rows.schema["_gf_id"], StructField("_gf_f0", LongType()), StructField("_gf_f1", LongType())])
    return rows.mapInArrow(_fingerprint_batches, schema)


def agreement(bits: int, distance: int) -> float:
    """Probability that ``bits`` distinct positions avoid all that differ."""
    return math.prod(max(0, BITS - distance - i) / (BITS - i) for i in range(bits))


def layout(nodes: int, threshold: int = THRESHOLD) -> tuple[int, int]:
    """(least bits of a part, disjoint parts): more parts than bits may differ, so
    that near pairs agree in one. Up to ``CELL`` nodes have one part of no bits."""
    parts = min(BITS, max(threshold, THRESHOLD) + 1) if nodes > CELL else 1
    return (BITS // parts if parts > 1 else 0), parts


def _positions(bits: int, parts: int) -> list[np.ndarray]:
    """Bit positions of the parts; all positions, each in one part."""
    places = np.random.default_rng(20240229).permutation(BITS) if bits else np.zeros(0, np.int64)
    return np.array_split(places, parts)


def _mask(places: np.ndarray) -> np.ndarray:
    out = np.zeros(2, dtype=np.uint64)
    for bit in places:
        out[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
    return out


def _masks(bits: int, parts: int) -> np.ndarray:
    return np.stack([_mask(places) for places in _positions(bits, parts)])


def _joined(parts: list[np.ndarray], n: int) -> list[tuple[np.ndarray, int]]:
    """(positions, bits of them that may differ) of parts joined n by n: a pair that
    agrees in one of ``parts`` is within the bound in the part that holds it."""
    return [(np.concatenate(parts[k : k + n]), len(parts[k : k + n]) - 1) for k in range(0, len(parts), n)]


def _plan(left: int, right: int, threshold: int) -> list[tuple[np.ndarray, int]]:
    """The joined parts to look for pairs by, of the least estimated cost; none
    where comparing all pairs costs less."""
    bits, parts = layout(max(left, right), threshold)
    best, least = [], float(left * right)
    if parts > threshold and bits:
        for n in (2, 3):
            joined = _joined(_positions(bits, parts), n)
            if max(len(places) for places, _ in joined) <= 20:
                share = sum(sum(math.comb(len(places), k) for k in range(most + 1)) / 2 ** len(places) for places, most in joined)
                cost = share * left * right + LOOKUP_PAIRS * sum(min(left, 2 ** len(places)) for places, _ in joined)
                if cost < least:
                    best, least = joined, cost
    return best


def _words(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (at, at + 1)], axis=1).view(np.uint64)


def _distances(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    out = np.bitwise_count(a0[:, None] ^ b0[None])
    out += np.bitwise_count(a1[:, None] ^ b1[None])
    return out


def _many(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, ``HANDED`` or more at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for a, b in pairs:
        held.append((a, b))
        size += len(a)
        if size >= HANDED:
            yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            held, size = [], 0
    if held:
        yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])


def _pivot_table(fp: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances to ``PIVOTS`` of the task's nodes, [PIVOTS, n], the coordinate
    that varies most first; small numbers, as bytes."""
    at = rows[np.linspace(0, len(rows) - 1, min(PIVOTS, len(rows))).astype(np.int64)]
    table = np.bitwise_count(fp[None, :, 0] ^ fp[at, 0][:, None]) + np.bitwise_count(fp[None, :, 1] ^ fp[at, 1][:, None])
    return table[np.argsort(-table.var(axis=1), kind="stable")]


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that meet: all of a task with themselves, or those of its two blocks."""
    return (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side[0] < 2 else (np.arange(len(side)),) * 2


def _compare(fp: np.ndarray, side: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of a task's nodes, by index: all of them, or, of a task that
    holds two blocks (sides 0 and 1), those of one side with the other."""
    left, right = _sides(side)
    if not len(left) or not len(right):
        return
    # Verifying a pair costs less than its other coordinates would.
    pivot = _pivot_table(fp, np.arange(len(fp)))[0].astype(np.int64)
    left, right = left[np.argsort(pivot[left], kind="stable")], right[np.argsort(pivot[right], kind="stable")]
    low = np.searchsorted(pivot[right], pivot[left] - threshold, side="left")
    high = np.searchsorted(pivot[right], pivot[left] + threshold, side="right")
    (a0, a1), (b0, b1) = fp[left].T.copy(), fp[right].T.copy()
    same = side[0] == 2
    begin = 0
    while begin < len(left):
        first = max(int(low[begin]), begin + 1) if same else int(low[begin])
        step = max(16, PAIRS // max(1, int(high[begin]) - first))
        end = min(len(left), begin + step)
        while end - begin > 16 and (end - begin) * (int(high[end - 1]) - first) > 2 * PAIRS:
            end = begin + (end - begin) // 2
        until = int(high[end - 1])
        if until > first:
            distance = _distances(a0[begin:end], a1[begin:end], b0[first:until], b1[first:until])
            i, j = np.divmod(_true(distance <= threshold), until - first)
            i, j = i + begin, j + first
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield left[i], right[j]
        begin = end


def _values(fp: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits at ``places`` as small numbers."""
    out = np.zeros(len(fp), dtype=np.int64)
    for k, bit in enumerate(places.tolist()):
        out |= (fp[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(np.int64) << k
    return out


def _compare_by_parts(fp: np.ndarray, side: np.ndarray, threshold: int, plan: list[tuple[np.ndarray, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same pairs, with the part of ``plan`` in which they differ little: once
    for each such part."""
    same = side[0] == 2
    for part, (places, most) in enumerate(plan):
        left, right = _sides(side)
        own, other = _values(fp[left], places), _values(fp[right], places)
        by, to = np.argsort(own, kind="stable"), np.argsort(other, kind="stable")
        left, right = left[by], right[to]
        every = np.arange(1 << len(places))
        begins, ends = np.searchsorted(own[by], every), np.searchsorted(own[by], every, side="right")
        first = np.searchsorted(other[to], every)
        count = np.searchsorted(other[to], every, side="right") - first
        near = every[np.bitwise_count(every) <= most]
        (a0, a1), (b0, b1) = fp[left].T.copy(), fp[right].T.copy()
        for value in np.flatnonzero(ends > begins).tolist():
            met = value ^ near
            if same:
                met = met[met >= value]
            n = count[met]
            total = int(n.sum())
            at = np.repeat(first[met] - np.cumsum(n) + n, n) + np.arange(total)
            c0, c1 = b0[at], b1[at]
            step = max(1, PAIRS // max(1, total))
            for begin in range(int(begins[value]), int(ends[value]) if total else 0, step):
                end = min(int(ends[value]), begin + step)
                distance = _distances(a0[begin:end], a1[begin:end], c0, c1)
                if distance.min() > threshold:
                    continue
                i, j = np.divmod(_true(distance <= threshold), total)
                i, j = i + begin, at[j]
                if same:
                    i, j = i[i < j], j[i < j]
                yield part, left[i], right[j]


def _new_pairs(fp: np.ndarray, side: np.ndarray, threshold: int, plan: list[tuple[np.ndarray, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those in the first part that holds them."""
    masks = [_mask(places) for places, _ in plan]
    for part, found in itertools.groupby(_compare_by_parts(fp, side, threshold, plan), key=lambda x: x[0]):
        for a, b in _many((a, b) for _, a, b in found):
            differ, new = fp[a] ^ fp[b], np.ones(len(a), dtype=bool)
            for mask, (_, most) in zip(masks[:part], plan, strict=False):
                new &= np.bitwise_count(differ & mask).sum(axis=1) > most
            yield a[new], b[new]


def _near_pairs(fp: np.ndarray, side: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of a task's nodes within the threshold, once; many at a time."""
    plan = _plan(*map(len, _sides(side)), threshold)
    yield from _many(_new_pairs(fp, side, threshold, plan) if plan else _compare(fp, side, threshold))


def _tasks(threshold: int):
    """From rows (key, side, id, fingerprint, rows) sorted by task: the edges and
    links of its nodes."""

    def finish(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        key = whole.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        side, rows = (whole.column(c).to_numpy() for c in (1, 5))
        fp = _words(whole, 3)
        links, root = np.zeros(len(key), dtype=np.int64), np.arange(len(key))
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            links[s:e], own = add_up(_near_pairs(fp[s:e], side[s:e], threshold), rows[s:e])
            root[s:e] = s + own
        yield edges_and_links(whole.column(2).combine_chunks(), links, root)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_tasks(batches, BUFFER):
            yield from finish(whole)

    return work


def _neighbours(nodes: DataFrame, threshold: int) -> DataFrame:
    """(_gf_a, _gf_b, _gf_links): edges (links null) that span the groups of
    nodes within the threshold, and links of nodes (_gf_b null)."""
    count = row_count(nodes)
    blocks = max(-(-count // BLOCK), min(BLOCKS, -(-count // LEAST_BLOCK)), 1)
    every = nodes.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("_gf_key"), F.lit(count).cast("bigint").alias("_gf_size"))
    cells = split_crowded(nodes.withColumn("_gf_key", F.lit(0).cast("bigint")), every, max(1, -(-count // blocks)), 1, "_gf_f0", "_gf_f1")
    # Tasks are few and long: as many partitions as planned, not as the bytes suggest.
    partitions = min(20_000, blocks * (blocks + 1))
    cells = cells.select("_gf_key", "_gf_side", *nodes.columns).repartition(partitions, "_gf_key").sortWithinPartitions("_gf_key")
    kind = nodes.schema["_gf_id"].dataType
    return cells.mapInArrow(_tasks(threshold), StructType([StructField("_gf_a", kind), StructField("_gf_b", kind), StructField("_gf_links", LongType())]))


def _groups(docs: DataFrame, id_col: str, text_col: str, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(_gf_id, _gf_root) of what goes; (_gf_id, _gf_node, _gf_rows) of all rows;
    (_gf_node, _gf_links) of nodes near to others."""
    prints = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(prints.groupBy("_gf_f0", "_gf_f1").agg(F.min("_gf_id").alias("_gf_id"), F.count(F.lit(1)).alias("_gf_rows")))
    found = cut(_neighbours(nodes.select("_gf_id", "_gf_f0", "_gf_f1", "_gf_rows"), threshold))
    placed = prints.join(nodes.withColumnRenamed("_gf_id", "_gf_node"), ["_gf_f0", "_gf_f1"]).select("_gf_id", "_gf_node", "_gf_rows")
    equal = placed.filter("_gf_id <> _gf_node").select(F.col("_gf_node").alias("_gf_a"), F.col("_gf_id").alias("_gf_b"))
    near = found.filter("_gf_b IS NOT NULL").select(F.least("_gf_a", "_gf_b").alias("_gf_a"), F.greatest("_gf_a", "_gf_b").alias("_gf_b"))
    links = found.filter("_gf_b IS NULL").groupBy(F.col("_gf_a").alias("_gf_node")).agg(F.sum("_gf_links").alias("_gf_links"))
    return components(equal.unionByName(near)), placed, links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id_col, keep_<id_col>, links, keep_links): each document of a group but the
    one that stays, which names the group; and how many other rows each of both
    is near to or has the fingerprint of."""
    groups, placed, near = _groups(docs, id_col, text_col, threshold)
    own = (
        placed.join(near, "_gf_node", "left")
        .filter("_gf_rows > 1 OR _gf_links IS NOT NULL")
        .groupBy("_gf_id")
        .agg(F.sum(F.col("_gf_rows") - 1 + F.coalesce("_gf_links", F.lit(0))).alias("_gf_links"))
    )
    own = cut(own)
    kept = own.select(F.col("_gf_id").alias("_gf_root"), F.col("_gf_links").alias("_gf_keep_links"))
    return groups.join(own, "_gf_id").join(kept, "_gf_root").select(
        F.col("_gf_id").alias(id_col), F.col("_gf_root").alias(f"keep_{id_col}"), F.col("_gf_links").alias("links"), F.col("_gf_keep_links").alias("keep_links")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The input rows, one document of each group of near duplicates staying."""
    groups, _, _ = _groups(docs, id_col, text_col, threshold)
    return without(docs, id_col, groups.select("_gf_id"), BROADCAST_IDS)
