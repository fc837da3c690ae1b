"""Phrase mining over a stream: one epoch is one batch.

Survivors of each epoch are written under the epoch's id, overwriting what a
repeated epoch wrote before, so delivery is effectively once. The global stage
is not monotone (a later batch can remove an earlier phrase) and is recomputed
over the table of survivors on demand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sentences import split_sentences
from ..plans.miner import PhraseMiner


class StreamingMiner:
    def __init__(self, miner: PhraseMiner, path: str):
        self.miner, self.path = miner, path.rstrip("/")

    def process(self, texts: DataFrame, epoch: int, key: str = "doc_id", text: str = "text") -> None:
        pieces = split_sentences(texts, key, text).select(F.lit(int(epoch)).cast("bigint").alias("batch_id"), "sentence")
        self.miner.batch_phrases(pieces).drop("batch_id").write.mode("overwrite").parquet(f"{self.path}/epoch={int(epoch)}")

    def start(self, stream: DataFrame, checkpoint: str, key: str = "doc_id", text: str = "text", **trigger) -> StreamingQuery:
        writer = stream.writeStream.option("checkpointLocation", checkpoint)
        if trigger:
            writer = writer.trigger(**trigger)
        return writer.foreachBatch(lambda df, epoch: self.process(df, epoch, key, text)).start()

    def survivors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).withColumnRenamed("epoch", "batch_id")

    def phrases(self, spark: SparkSession) -> DataFrame:
        """The phrase table of everything seen so far."""
        return self.miner.finish(self.survivors(spark))

    def progress(self, spark: SparkSession, rows: int = 5) -> DataFrame:
        """Leading phrases so far, before the global stage."""
        return self.miner.progress(self.survivors(spark), rows=rows)
