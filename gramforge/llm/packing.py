"""Packing documents into training windows by Karmarkar-Karp differencing.

Documents (in tokens) are dealt into shards of about ``SHARD_TOKENS`` tokens by
hash of id and length, rows alike in both one after another to different shards;
within a shard, multiway differencing keeps a heap of partial
partitions by imbalance (greatest minus least sum), repeatedly takes the two
most imbalanced and merges them with opposing order, largest sum onto smallest,
until one partition remains. The number of windows starts at
ceil(tokens / capacity) and rises by one as long as some window exceeds the
capacity, so no window ever does.

A document longer than a window is cut first: full windows of its own, and a
remainder that is packed with the others; every token lands in one window.
Only ids and lengths are shuffled. A shard's size does not depend on the
corpus's, so neither does the cost of a token.

Defined results
---------------
* null, empty or token-less text: no piece, no window.
* null id: packed like any other; the id stays null. Ids keep type and value.
* ties and repeated rows: each row is packed by itself.
* an id that occurs in several rows: pieces of each; begin counts per row.
* very long texts: as many full windows as they fill, and a remainder.
* extra columns, whatever their names: ignored.   empty table: empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, named

#: Tokens of a window, and of a shard that is balanced as a whole.
CAPACITY = 2048
SHARD_TOKENS = 400_000
#: Shards of a task, on average, and tasks at most (beyond, tasks get more shards).
TASK_SHARDS = 8
TASKS = 20_000


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window 0..k-1 of each size, by Karmarkar-Karp multiway differencing."""
    n = len(sizes)
    window = np.zeros(n, dtype=np.int64)
    if k <= 1 or n == 0:
        return window
    # Sums lie in falling order less their least; a node keeps only its nonzero
    # leading part, as most partial partitions touch few windows.
    nodes: list = [None] * n
    sums: list[np.ndarray] = [np.array([s], dtype=np.int64) for s in sizes]
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sa, sb = sums[a], sums[b]
        sums[a] = sums[b] = None
        # Opposing order: position j of a meets position k-1-j of b.
        whole = np.zeros(k, dtype=np.int64)
        whole[: len(sa)] = sa
        whole[k - len(sb) :] += sb[::-1]
        if len(sa) + len(sb) <= k:
            # Disjoint: positions beyond both stay empty and may be moved last.
            order = np.r_[np.arange(len(sa)), np.arange(k - len(sb), k)]
            order = order[np.argsort(-whole[order], kind="stable")]
            merged = whole[order]
            rest = k - len(order)
            floor = 0 if rest else int(merged[-1])
        else:
            order = np.argsort(-whole, kind="stable")
            merged = whole[order]
            floor = int(merged[-1])
        merged = merged - floor
        live = int(np.count_nonzero(merged))
        nodes.append((a, b, order, len(sa)))
        sums.append(merged[: max(live, 1)])
        heapq.heappush(heap, (-int(merged[0]), len(nodes) - 1))

    # Walk down: hand each node the windows of its positions, in its order.
    stack = [(heap[0][1], np.arange(k, dtype=np.int64))]
    while stack:
        node, labels = stack.pop()
        if node < n:
            window[node] = labels[0]
            continue
        a, b, order, _ = nodes[node]
        nodes[node] = None
        place = np.empty(k, dtype=np.int64)
        place[order] = labels[: len(order)]
        if len(order) < k:
            free = np.ones(k, dtype=bool)
            free[order] = False
            place[free] = labels[len(order) :]
        stack.append((a, place))
        stack.append((b, place[::-1]))
    return window


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size (all <= capacity), no window above the capacity."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, weights=sizes).max() <= capacity:
            return window
        k += 1


def pack_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """(id_col, begin, tokens, shard, window): token ranges and their windows.

    A token is a run of characters without white space. (shard, window) names
    one window; its tokens sum to at most ``capacity``.
    """
    sized = docs.select(
        named(docs, id_col).alias("_gf_id"), F.regexp_count(named(docs, text_col), F.lit(r"\S+")).cast("bigint").alias("_gf_n")
    ).filter("_gf_n > 0")
    # Rows alike in id and length are interchangeable: they are counted, and each
    # shard gets its part of the count, so that no shard gets all of them.
    alike = cut(sized.groupBy("_gf_id", "_gf_n").agg(F.count(F.lit(1)).alias("_gf_rows")))
    total = alike.agg(F.sum((F.col("_gf_n") * F.col("_gf_rows")).cast("decimal(38,0)")).alias("t")).first()["t"] or 0
    shards = max(1, -(-int(total) // shard_tokens))
    parts = F.least(F.col("_gf_rows"), F.lit(shards))
    dealt = alike.withColumn("_gf_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).select(
        "_gf_id",
        "_gf_n",
        F.expr(f"_gf_rows div least(_gf_rows, {shards}L) + int(_gf_part < _gf_rows % least(_gf_rows, {shards}L))").alias("_gf_rows"),
        F.pmod(F.pmod(F.xxhash64("_gf_id", "_gf_n"), F.lit(shards)) + F.col("_gf_part"), F.lit(shards)).alias("_gf_shard"),
    )

    def work(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("_gf_n", "descending"), ("_gf_id", "ascending")]))
        of = np.repeat(np.arange(table.num_rows), table.column("_gf_rows").to_numpy())
        n = table.column("_gf_n").to_numpy()[of]
        full, rest = n // capacity, n % capacity
        some = np.flatnonzero(rest)
        window = pack(rest[some], capacity)
        base = int(window.max()) + 1 if len(window) else 0
        row = np.repeat(np.arange(len(n)), full)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
        shard = table.column("_gf_shard")[0].as_py()
        columns = [np.r_[nth * capacity, (full * capacity)[some]], np.r_[np.full(len(row), capacity), rest[some]]]
        columns += [np.full(len(row) + len(some), shard), np.r_[base + np.arange(len(row)), window]]
        ids = table.column("_gf_id").take(pa.array(np.r_[of[row], of[some]]))
        return pa.table([ids, *(pa.array(c, pa.int64()) for c in columns)], names=["_gf_id", "begin", "tokens", "shard", "window"])

    # Few bytes and much work: tasks by shards, not by the bytes that they read.
    dealt = dealt.repartition(min(TASKS, -(-shards // TASK_SHARDS)), "_gf_shard")
    schema = StructType([alike.schema["_gf_id"], *(StructField(c, LongType()) for c in ("begin", "tokens", "shard", "window"))])
    return dealt.groupBy("_gf_shard").applyInArrow(work, schema).withColumnRenamed("_gf_id", id_col)


def brute_force(sizes: list[int], k: int) -> list[int]:
    """Window sums, falling, by plain list differencing; for tests."""
    parts = [[s] + [0] * (k - 1) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1], reverse=True)
        a, b = parts[0], parts[1]
        parts = parts[2:] + [sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)]
    return parts[0] if parts else [0] * k


def windows_of(pdf: pd.DataFrame) -> Iterator[tuple[tuple[int, int], int]]:
    """((shard, window), tokens) of a packed result; for tests."""
    for key, tokens in pdf.groupby(["shard", "window"])["tokens"].sum().items():
        yield key, int(tokens)
