"""Shared plumbing of the training-data operators.

Conventions that every operator of this subpackage keeps:

* ``id_col`` / ``text_col`` name the input columns; whatever other columns the
  input has, under whatever names, never meet the operator's own working
  columns: inputs are projected to ``_gf_*`` names first.
* Lineage is cut with reliable checkpoints only, in the folder the cluster
  names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Characters of text that a Python worker unpacks at once. Only a memory
#: bound for the batches: every row of every batch is processed, and a text
#: longer than this is processed whole, alone.
SLICE_CHARS = 500_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    Read from the session; a folder of our own is set only where none is named
    and the session is a single-process one (tests). On a cluster without a
    shared folder this raises rather than fall back to one machine's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="gramforge-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and forget how it was made."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system, with all in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def named(df: DataFrame, column: str) -> Column:
    """Column by exact name, dots and all."""
    return df["`" + column.replace("`", "``") + "`"]


def slices(batch: pa.RecordBatch, text_index: int = 1, budget: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows of about ``budget`` text bytes."""
    n = batch.num_rows
    if not n:
        return
    column = batch.column(text_index)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i in range(n):
        if i > begin and total + sizes[i] > budget:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(sizes[i])
    yield batch.slice(begin, n - begin)


def map_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df.mapInArrow`` to the same columns, whatever their names: ``work``
    finds them by position."""
    safe = [f"_gf_c{i}" for i in range(len(df.columns))]
    schema = StructType([StructField(s, f.dataType, f.nullable) for s, f in zip(safe, df.schema.fields, strict=True)])
    return df.toDF(*safe).mapInArrow(work, schema).toDF(*df.columns)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def table_stats(df: DataFrame, *aggregates: Column):
    """One row of whole-table aggregates, on the driver."""
    return df.agg(*aggregates).first()


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"]


def broadcast_upto(df: DataFrame, rows: int) -> DataFrame:
    """A materialised ``df``, to be broadcast if it has at most so many rows;
    a larger one is left for the planner to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def safe_names(df: DataFrame) -> DataFrame:
    """``df`` with its columns named ``_gf_c0``, ``_gf_c1``, ...: no working column is named so."""
    return df.toDF(*[f"_gf_c{i}" for i in range(len(df.columns))])


def without(df: DataFrame, id_col: str, gone: DataFrame, rows: int) -> DataFrame:
    """``df`` without the rows whose id is in ``gone`` (one column, no nulls).

    Up to so many ids are sent to the rows, which then stay where they are; more
    would outgrow the executors, and rows and ids are shuffled by id.
    """
    plain = safe_names(df)
    ids = broadcast_upto(cut(gone.toDF("_gf_gone")), rows)
    at = df.columns.index(id_col)
    return plain.join(ids, F.col(f"_gf_c{at}") == F.col("_gf_gone"), "left_anti").toDF(*df.columns)


def split_crowded(cells: DataFrame, sizes: DataFrame, block: int, rows: int, *by: str) -> DataFrame:
    """``cells`` (with _gf_key) for tasks of at most two blocks of a cell.

    A cell of more than ``block`` members by ``sizes`` (_gf_key, _gf_size) is split
    into blocks by hash of ``by``, and blocks i <= j meet in a task of their own, so
    that every pair of the cell meets once. _gf_key becomes the task's key; _gf_side
    is 2 where all pairs of a task count, else 0 and 1 for the two blocks, of which
    only pairs across count. ``sizes`` of up to ``rows`` cells are broadcast.
    """
    crowded = cut(sizes.filter(F.col("_gf_size") > block))
    if not row_count(crowded):
        return cells.withColumn("_gf_side", F.lit(2))
    placed = cells.join(broadcast_upto(crowded, rows), "_gf_key", "left")
    placed = placed.withColumn("_gf_blocks", F.coalesce(F.ceil(F.col("_gf_size") / block), F.lit(1)).cast("int"))
    placed = placed.withColumn("_gf_block", F.pmod(F.xxhash64(*by), "_gf_blocks").cast("int"))
    placed = placed.withColumn("_gf_other", F.explode(F.sequence(F.lit(0), F.col("_gf_blocks") - 1)))
    low, high = F.least("_gf_block", "_gf_other"), F.greatest("_gf_block", "_gf_other")
    side = F.when(low == high, 2).when(F.col("_gf_block") == low, 0).otherwise(1)
    task = F.when(F.col("_gf_blocks") > 1, F.xxhash64("_gf_key", low, high)).otherwise(F.col("_gf_key"))
    return placed.withColumn("_gf_side", side).withColumn("_gf_key", task).select(*cells.columns, "_gf_side")


def whole_tasks(batches: Iterator[pa.RecordBatch], buffer: int) -> Iterator[pa.Table]:
    """Rows sorted by their first column, in tables of about ``buffer`` rows or one
    task, of which none cuts a task in two."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < buffer:
            continue
        whole = pa.Table.from_batches(held)
        key = whole.column(0).to_numpy()
        # The last task may go on in the next batch.
        done = int(key.searchsorted(key[-1], side="left"))
        if done:
            yield whole.slice(0, done)
            held = whole.slice(done).combine_chunks().to_batches()
            size = whole.num_rows - done
    if size:
        yield pa.Table.from_batches(held)


def true_places(near: np.ndarray) -> np.ndarray:
    """``flatnonzero``, fast where few are true."""
    octets = np.packbits(near.reshape(-1))
    at = np.flatnonzero(octets)
    k, bit = np.nonzero(np.unpackbits(octets[at][:, None], axis=1))
    return at[k] * 8 + bit


def add_up(pairs: Iterator[tuple[np.ndarray, np.ndarray]], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of documents that each node is paired with, the least index of its
    group), of pairs of indices that come in parts, each pair once."""
    links = np.zeros(len(rows), dtype=np.int64)
    root = np.arange(len(rows))
    for a, b in pairs:
        if not len(a):
            continue
        links += np.bincount(a, rows[b], len(rows)).astype(np.int64) + np.bincount(b, rows[a], len(rows)).astype(np.int64)
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (root[root] != root).any():
                root = root[root]
    return links, root


def edges_and_links(ids: pa.Array, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    """(_gf_a, _gf_b, null) for each edge that spans a group, (_gf_a, null,
    _gf_links) for each node with links."""
    moved, some = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(links)
    edge = np.r_[np.ones(len(moved), dtype=bool), np.zeros(len(some), dtype=bool)]
    a, b = np.r_[root[moved], some], np.r_[moved, some]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b, mask=~edge)), pa.array(links[b], mask=edge)], names=["_gf_a", "_gf_b", "_gf_links"])


def components(edges: DataFrame) -> DataFrame:
    """(_gf_id, _gf_root) of every node of ``edges`` but the roots themselves.

    Alternates large-star and small-star until nothing moves; each round is
    two aggregations and joins, cut by a checkpoint.
    """
    edges = cut(edges.select("_gf_a", "_gf_b").filter("_gf_a < _gf_b").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("_gf_b").alias("_gf_a"), F.col("_gf_a").alias("_gf_b")))
        low = both.groupBy("_gf_a").agg(F.least(F.min("_gf_b"), F.col("_gf_a")).alias("_gf_low"))
        large = both.join(low, "_gf_a").filter("_gf_b > _gf_a")
        edges = large.select(F.col("_gf_low").alias("_gf_a"), "_gf_b").filter("_gf_a < _gf_b").distinct()
        edges = cut(edges)
        low = edges.groupBy("_gf_b").agg(F.min("_gf_a").alias("_gf_low"))
        small = edges.join(low, "_gf_b")
        edges = (
            small.select(F.col("_gf_low").alias("_gf_a"), "_gf_b")
            .unionByName(small.select(F.col("_gf_low").alias("_gf_a"), F.col("_gf_a").alias("_gf_b")))
            .filter("_gf_a < _gf_b")
            .distinct()
        )
        edges = cut(edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_gf_a", "_gf_b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("_gf_b").alias("_gf_id"), F.col("_gf_a").alias("_gf_root"))
        seen = now
