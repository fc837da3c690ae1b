"""Quartile bucket digests of documents, and their bounded difference score.

Every three consecutive bytes of a document's UTF-8 text are hashed into one of
``BUCKETS`` buckets. A bucket's count is written as its quartile among all
buckets of that document (2 bits), preceded by one byte for the logarithm of
the length: 33 bytes, 66 hexadecimal digits. Similar documents have similar
digests; the difference score adds up quartile steps (3 apart counts 6) and
``LENGTH_STEP`` for each step of length, and never exceeds ``MAX_SCORE``.

The query digests every document and scores documents against each other. It
returns one row for each document with the number of others within ``NEAR`` (its
links) and its class, the documents that links connect, named by the least id.
Documents with one digest are one node of the search. The search is exact: the
buckets are dealt into ``TABLES`` parts, one more than the buckets that may differ
within ``NEAR``, so that a pair within it has equal quartiles in one part at least.
Digests that agree in a part share a cell; all pairs of a cell are scored, and a
pair counts in the first cell it shares. A cell of more than ``BLOCK`` members is
split into blocks that meet two by two in different tasks: all its pairs are scored.

As an extra, every document is scored against every benchmark item, reporting
the nearest (least id on ties) and its score. For that nothing is shuffled:
references are digested where they lie, and their digests go to the documents,
``PASS_REFERENCES`` of them at a time.

Defined results
---------------
* null text: null digest, no score.  texts under 3 bytes: no triplet, so all
  buckets are equal (quartile 0); the length still tells them apart.
* quartile ties: a count equal to a quartile bound falls below it.
* repeated rows: one result row each, and each counts among the links of others
  and of its like.  very long texts: counted whole.
* null ids and null texts: no class, no links, and none to them. A document
  without links is a class of its own.
* an id on several texts has the links of each of them in the respective row, and
  all of them are in one class.
* ids of any type that has an order; they come back as they are.
* benchmark items without an id or a text take no part; with none left, nearest
  and score are null.
* empty table: empty result.  extra columns, whatever their names: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import add_up, broadcast_upto, components, cut, edges_and_links, named, slices, split_crowded, true_places as _true, whole_tasks

BUCKETS = 128
LENGTH_STEP = 2
MAX_SCORE = 255
#: References that a pass over the documents scores against; more take more
#: passes. And cells of the score table that a task computes at once.
PASS_REFERENCES = 50_000
CELLS = 2_000_000
#: Pairs of a cell compared at once.
PAIRS = 1 << 17
#: Documents within this difference score are reported as a pair.
NEAR = 16
#: Parts of the buckets: more than buckets that may differ (each costs 1 or more).
TABLES = NEAR + 1
#: Cells up to this size compare their pairs together with other cells'.
SMALL_CELL = 64
#: Members of a block of a crowded cell, and rows of cells that are held at once.
BLOCK = 16_384
BUFFER = 1 << 17
#: Crowded cells, and digests of several documents, up to these numbers are broadcast.
BROADCAST_CELLS = 500_000
BROADCAST_DIGESTS = 400_000
_COST = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], dtype=np.float32)


def _bucket(b0: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    x = b0.astype(np.uint32) | (b1.astype(np.uint32) << np.uint32(8)) | (b2.astype(np.uint32) << np.uint32(16))
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return (x >> np.uint32(25)).astype(np.int64)


def length_code(n: np.ndarray) -> np.ndarray:
    """Steps of a factor of 1.5 in length; 0 for none."""
    return np.where(n > 0, np.minimum(255, 1 + np.floor(np.log(np.maximum(n, 1)) / np.log(1.5))), 0).astype(np.uint8)


def quartiles(counts: np.ndarray) -> np.ndarray:
    """Quartile 0..3 of each count within its row."""
    ordered = np.sort(counts, axis=1)
    n = counts.shape[1]
    q = [ordered[:, n * k // 4 - 1 : n * k // 4] for k in (1, 2, 3)]
    return ((counts > q[0]).astype(np.uint8) + (counts > q[1]) + (counts > q[2])).astype(np.uint8)


def bucket_counts(raw: list[bytes]) -> np.ndarray:
    joined = np.frombuffer(b"".join(raw), dtype=np.uint8)
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    out = np.zeros((len(raw), BUCKETS), dtype=np.int64)
    if len(joined) < 3:
        return out
    owner = np.repeat(np.arange(len(raw), dtype=np.int64), sizes)
    inside = owner[:-2] == owner[2:]
    cell = owner[:-2] * BUCKETS + _bucket(joined[:-2], joined[1:-1], joined[2:])
    return np.bincount(cell[inside], minlength=len(raw) * BUCKETS).reshape(len(raw), BUCKETS)


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(quartiles [n, BUCKETS], length codes [n])."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return quartiles(bucket_counts(raw)), length_code(np.array([len(r) for r in raw], dtype=np.int64))


def to_hex(q: np.ndarray, length: np.ndarray) -> list[str]:
    packed = (q[:, 0::4] << 6) | (q[:, 1::4] << 4) | (q[:, 2::4] << 2) | q[:, 3::4]
    whole = np.concatenate([length[:, None], packed.astype(np.uint8)], axis=1)
    return [row.tobytes().hex() for row in whole]


def from_hex(digest: str) -> tuple[np.ndarray, int]:
    b = np.frombuffer(bytes.fromhex(digest), dtype=np.uint8)
    return np.stack([b[1:] >> 6, b[1:] >> 4 & 3, b[1:] >> 2 & 3, b[1:] & 3], axis=1).reshape(-1), int(b[0])


def from_hexes(known: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(quartiles [n, BUCKETS], length codes [n]) of digests."""
    b = np.frombuffer(bytes.fromhex("".join(known)), dtype=np.uint8).reshape(len(known), 1 + BUCKETS // 4)
    return np.stack([b[:, 1:] >> 6, b[:, 1:] >> 4 & 3, b[:, 1:] >> 2 & 3, b[:, 1:] & 3], axis=2).reshape(len(known), BUCKETS), b[:, 0]


def difference(a: str, b: str) -> int:
    """Bounded difference score of two digests, 0..MAX_SCORE."""
    (qa, la), (qb, lb) = from_hex(a), from_hex(b)
    return int(min(MAX_SCORE, _COST[qa, qb].sum() + LENGTH_STEP * abs(la - lb)))


def _one_hot(q: np.ndarray) -> np.ndarray:
    return (q[:, :, None] == np.arange(4, dtype=np.uint8)).reshape(len(q), -1).astype(np.float32)


def scores(q: np.ndarray, length: np.ndarray, rq: np.ndarray, rlength: np.ndarray) -> np.ndarray:
    """Difference scores [n, references] of all against all."""
    body = _one_hot(q) @ _COST[rq].transpose(1, 2, 0).reshape(-1, len(rq))
    gap = np.abs(length.astype(np.int64)[:, None] - rlength.astype(np.int64)[None])
    return np.minimum(MAX_SCORE, body.astype(np.int64) + LENGTH_STEP * gap)


def nearest(q: np.ndarray, length: np.ndarray, rq: np.ndarray, rlength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least score, the first reference that has it) of each digest."""
    best, near = np.full(len(q), MAX_SCORE + 1, dtype=np.int64), np.zeros(len(q), dtype=np.int64)
    step = max(1, CELLS // max(1, len(q)))
    for at in range(0, len(rq), step):
        s = scores(q, length, rq[at : at + step], rlength[at : at + step])
        k = s.argmin(axis=1)
        low = s[np.arange(len(s)), k]
        near = np.where(low < best, at + k, near)
        best = np.minimum(low, best)
    return best, near


_COLUMNS = ["_gf_id", "_gf_digest", "_gf_near", "_gf_score"]


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            texts = part.column(1).to_pylist()
            missing = np.array([t is None for t in texts], dtype=bool)
            digest = pa.array(to_hex(*digests([t or "" for t in texts])), pa.string(), mask=missing)
            yield pa.RecordBatch.from_arrays([part.column(0), digest], names=_COLUMNS[:2])


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_gf_id, _gf_digest) of every row."""
    rows = docs.select(named(docs, id_col).alias("_gf_id"), named(docs, text_col).alias("_gf_text"))
    return rows.mapInArrow(_digest_rows, StructType([rows.schema["_gf_id"], StructField("_gf_digest", StringType())]))


def _references(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """Blocks of about ``PASS_REFERENCES`` references: ids in rising order, digests."""
    items = cut(items.filter("_gf_id IS NOT NULL AND _gf_digest IS NOT NULL"))
    blocks = -(-items.count() // PASS_REFERENCES)
    for k in range(blocks):
        rows = sorted(map(tuple, items.filter(F.pmod(F.xxhash64("_gf_id", "_gf_digest"), F.lit(blocks)) == k).collect()))
        if rows:
            yield [i for i, _ in rows], [d for _, d in rows]


def fingerprint_documents(
    docs: DataFrame, references: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", ref_id: str = "item_id", ref_text: str = "text"
) -> DataFrame:
    """(id_col, digest, nearest_<ref_id>, score) of every input row."""
    kind = LongType() if references is None else references.schema[ref_id].dataType
    out = _digested(docs, id_col, text_col).withColumn("_gf_near", F.lit(None).cast(kind)).withColumn("_gf_score", F.lit(None).cast("bigint"))

    def improve(ids: list, known: list[str]):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rq, rlength = from_hexes(known)
            for part in batches:
                own = part.column(1).to_pylist()
                best, at = nearest(*from_hexes([d or "00" * (1 + BUCKETS // 4) for d in own]), rq, rlength)
                found = zip(own, part.column(3).to_pylist(), part.column(2).to_pylist(), best.tolist(), at.tolist(), strict=True)
                least = [(None, None) if d is None else (b, ids[n]) if s is None else min((s, i), (b, ids[n])) for d, s, i, b, n in found]
                near = pa.array([i for _, i in least], part.schema.field(2).type)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), near, pa.array([s for s, _ in least], pa.int64())], names=_COLUMNS)

        return work

    if references is not None:
        for ids, known in _references(_digested(references, ref_id, ref_text)):
            out = out.mapInArrow(improve(ids, known), out.schema)
    return out.toDF(id_col, "digest", f"nearest_{ref_id}", "score")


def _bits(q: np.ndarray) -> np.ndarray:
    """Quartiles as bits, uint64 [n, 6]: two words each of above the median,
    above the first and above the third quartile bound."""
    words = [np.ascontiguousarray(np.packbits(q >= k, axis=1)).view(np.uint64) for k in (2, 1, 3)]
    return np.concatenate(words, axis=1)


def _bit_scores(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Difference scores of digests as bits, row by row."""
    steps = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    far = np.bitwise_count((a[:, 4:] & ~b[:, 2:4]) | (b[:, 4:] & ~a[:, 2:4])).sum(axis=1, dtype=np.int64)
    gap = np.abs(la.astype(np.int64) - lb)
    return np.minimum(MAX_SCORE, steps + (_COST[0, 3] - 3).astype(np.int64) * far + LENGTH_STEP * gap)


def _positions() -> list[np.ndarray]:
    """Buckets of each part."""
    return np.array_split(np.random.default_rng(20240301).permutation(BUCKETS), TABLES)


def cell_keys(q: np.ndarray) -> np.ndarray:
    """Cell of each digest in each table, [n, TABLES]; the table in the low byte."""
    return np.stack([(q[:, p].astype(np.int64) << np.arange(8, 8 + 2 * len(p), 2, dtype=np.int64)).sum(axis=1) + t for t, p in enumerate(_positions())], axis=1)


def _cell_pairs(bits: np.ndarray, length: np.ndarray, near: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs a < b of a cell's members within ``near``."""
    n = len(bits)
    step = max(1, PAIRS // n)
    words = np.ascontiguousarray(bits.T)
    for at in range(0, n - 1, step):
        # Differing bits bound the score from below; a sum beyond 255 wraps around, and is scored for nothing.
        low = np.bitwise_count(words[0, at : at + step, None] ^ words[0, None, at + 1 :])
        for word in words[1:]:
            low += np.bitwise_count(word[at : at + step, None] ^ word[None, at + 1 :])
        if low.min() > near:
            continue
        a, b = np.divmod(_true(low <= near), n - at - 1)
        a, b = a + at, b + at + 1
        a, b = a[a < b], b[a < b]
        for begin in range(0, len(a), CELLS // 8):
            u, v = a[begin : begin + CELLS // 8], b[begin : begin + CELLS // 8]
            close = _bit_scores(bits[u], bits[v], length[u], length[v]) <= near
            yield u[close], v[close]


def _small_cell_pairs(key: np.ndarray, bits: np.ndarray, length: np.ndarray, near: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of many cells at once; rows are sorted by key."""
    left, step = np.arange(len(key)), 0
    while len(left):
        step += 1
        left = left[left + step < len(key)]
        left = left[key[left + step] == key[left]]
        a, b = left, left + step
        low = np.bitwise_count(bits[a, 0] ^ bits[b, 0]) + np.bitwise_count(bits[a, 1] ^ bits[b, 1])
        a, b = a[low <= near], b[low <= near]
        close = _bit_scores(bits[a], bits[b], length[a], length[b]) <= near
        yield a[close], b[close]


def _first_shared(bits: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether a pair that shares a cell of ``table`` shares none of an earlier one."""
    chosen = np.zeros((TABLES, BUCKETS), dtype=bool)
    for t, p in enumerate(_positions()):
        chosen[t, p] = True
    differ = bits[a] ^ bits[b]
    differ, first = differ[:, :2] | differ[:, 2:4] | differ[:, 4:], np.ones(len(a), dtype=bool)
    for t, mask in enumerate(np.packbits(chosen, axis=1).view(np.uint64)):
        first &= (table <= t) | (differ & mask).any(axis=1)
    return first


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        if part.num_rows:
            key, n = np.unique(cell_keys(from_hexes(part.column(0).to_pylist())[0]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["_gf_key", "_gf_size"])


def _to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        if part.num_rows:
            keys = cell_keys(from_hexes(part.column(0).to_pylist())[0])
            for t in range(TABLES):
                table = pa.array(np.full(part.num_rows, t, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), table, *part.columns], names=["_gf_key", "_gf_table", *part.schema.names])


def _links(near: int):
    """From rows (key, table, side, digest, id, rows) sorted by key: the edges and
    links of the nodes."""

    def scored(key: np.ndarray, bits: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        small = np.flatnonzero(np.repeat(sizes <= SMALL_CELL, sizes))
        for a, b in _small_cell_pairs(key[small], bits[small], length[small], near):
            yield small[a], small[b]
        for s, n in zip(starts[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist(), strict=True):
            for a, b in _cell_pairs(bits[s : s + n], length[s : s + n], near):
                yield s + a, s + b

    def new_pairs(key, table, side, bits, length) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in scored(key, bits, length):
            new = (side[a] == 2) | (side[a] != side[b])
            new[new] = _first_shared(bits, a[new], b[new], table[a[new]])
            yield a[new], b[new]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_tasks(batches, BUFFER):
            key = whole.column(0).to_numpy()
            same = key[1:] == key[:-1]
            whole = whole.take(pa.array(np.flatnonzero(np.r_[False, same] | np.r_[same, False]))).combine_chunks()
            if whole.num_rows:
                key, table, side, rows = (whole.column(c).to_numpy() for c in (0, 1, 2, 5))
                q, length = from_hexes(whole.column(3).to_pylist())
                links, root = add_up(new_pairs(key, table, side, _bits(q), length), rows)
                yield edges_and_links(whole.column(4).combine_chunks(), links, root)

    return work


def fingerprint_classes(
    docs: DataFrame, references: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", ref_id: str = "item_id", ref_text: str = "text", near: int = NEAR
) -> DataFrame:
    """``fingerprint_documents``, class_<id_col> and links, of every input row."""
    if near > NEAR:
        raise ValueError(f"parts are made for scores up to {NEAR}; {near} would lose pairs")
    prints = cut(fingerprint_documents(docs, references, id_col, text_col, ref_id, ref_text)).toDF(*_COLUMNS)
    kind = prints.schema["_gf_id"].dataType
    real = prints.filter("_gf_id IS NOT NULL AND _gf_digest IS NOT NULL")
    nodes = cut(real.groupBy("_gf_digest").agg(F.min("_gf_id").alias("_gf_id"), F.count(F.lit(1)).alias("_gf_rows")))
    sizes = nodes.select("_gf_digest").mapInArrow(_count_cells, "_gf_key bigint, _gf_size bigint").groupBy("_gf_key").agg(F.sum("_gf_size").alias("_gf_size"))
    schema = StructType([StructField("_gf_key", LongType()), StructField("_gf_table", LongType()), *nodes.schema.fields])
    cells = split_crowded(nodes.mapInArrow(_to_cells, schema), sizes, BLOCK, BROADCAST_CELLS, "_gf_digest")
    cells = cells.select("_gf_key", "_gf_table", "_gf_side", *nodes.columns).repartition("_gf_key").sortWithinPartitions("_gf_key")
    found = cut(cells.mapInArrow(_links(near), StructType([StructField("_gf_a", kind), StructField("_gf_b", kind), StructField("_gf_links", LongType())])))
    close = found.filter("_gf_b IS NOT NULL").select(F.least("_gf_a", "_gf_b").alias("_gf_a"), F.greatest("_gf_a", "_gf_b").alias("_gf_b"))
    # Few digests belong to several documents or are near to others.
    links = found.filter("_gf_b IS NULL").groupBy(F.col("_gf_a").alias("_gf_node")).agg(F.sum("_gf_links").alias("_gf_links"))
    several = nodes.filter("_gf_rows > 1").select("_gf_digest", F.col("_gf_id").alias("_gf_node"), "_gf_rows")
    equal = real.join(several, "_gf_digest").filter("_gf_id <> _gf_node").select(F.col("_gf_node").alias("_gf_a"), F.col("_gf_id").alias("_gf_b"))
    classes = cut(components(equal.unionByName(close)).select("_gf_id", F.col("_gf_root").alias("_gf_class")))
    linked = (
        nodes.join(links, nodes["_gf_id"] == links["_gf_node"], "left")
        .select("_gf_digest", (F.col("_gf_rows") - 1 + F.coalesce("_gf_links", F.lit(0))).alias("_gf_links"))
        .filter("_gf_links > 0")
    )
    out = prints.join(broadcast_upto(cut(linked), BROADCAST_DIGESTS), "_gf_digest", "left").join(broadcast_upto(classes, BROADCAST_DIGESTS), "_gf_id", "left")
    known = F.col("_gf_id").isNotNull() & F.col("_gf_digest").isNotNull()
    return out.select(
        F.col("_gf_id").alias(id_col),
        F.col("_gf_digest").alias("digest"),
        F.col("_gf_near").alias(f"nearest_{ref_id}"),
        F.col("_gf_score").alias("score"),
        F.when(known, F.coalesce("_gf_class", "_gf_id")).alias(f"class_{id_col}"),
        F.when(known, F.coalesce("_gf_links", F.lit(0))).alias("links"),
    )


def brute_force(text: str) -> str:
    """Digest by plain loops; for tests."""
    raw = text.encode()
    counts = [0] * BUCKETS
    for i in range(len(raw) - 2):
        x = (raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 0x9E3779B1 & 0xFFFFFFFF
        x = (x ^ x >> 15) * 0x85EBCA77 & 0xFFFFFFFF
        counts[x >> 25] += 1
    ordered = sorted(counts)
    bounds = [ordered[BUCKETS * k // 4 - 1] for k in (1, 2, 3)]
    code = [sum(c > b for b in bounds) for c in counts]
    length = int(length_code(np.array([len(raw)]))[0])
    return bytes([length] + [code[i] << 6 | code[i + 1] << 4 | code[i + 2] << 2 | code[i + 3] for i in range(0, BUCKETS, 4)]).hex()
