"""Corpus pipeline: documents in, packed training windows out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of documents. What a stage wrote is deleted when the next
one has been written; the last one's windows stay for the reader of the result.

Defined results
---------------
* null ids: such documents are scored, compared as exact copies, mixed and packed
  like others; near deduplication keeps them.
* null or empty texts: kept until packing, where they have no token and no window
  (empty texts equal each other: one of them stays).
* very long texts: processed whole by every stage.
* ties: of equal or near texts the least id stays.
* repeated rows: exact copies of each other, one stays.
* empty table: empty result.  Extra columns, whatever their names: carried along
  to the last stage, which returns ids and token ranges.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gramforge.llm import exact_dedup, mixing, packing, simhash, toxicity
from gramforge.llm.common import delete_folder, ensure_checkpoint_dir, read

#: Rows of an Arrow batch, which executor and Python worker hold whole, the former
#: outside its heap: at the default of 10,000 rows some 20 MB of text and more.
BATCH_ROWS = 1_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_windows(docs)


def _small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with texts going to and from Python ``BATCH_ROWS`` rows at a time, which stays set in the session."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _small_batches(drop_toxic)),
    ("exact_dedup", drop_exact),
    ("simhash_near_dedup", _small_batches(drop_near)),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Forward-backward, SimHash and differencing have no SQL form; the pipeline is
#: tested against brute-force versions of its stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each reading what the one before wrote."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            delete_folder(spark, before)
        before = out
    return docs
