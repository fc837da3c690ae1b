"""Character n-grams: generation and counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import strip_characters
from ..sources.shared import broadcast_upto, cut
from .batchgrams import counter

#: Starts owned by one chunk of a long sentence.
STRIDE = 256
#: Grams longer than this are counted only where their prefix of this length
#: is frequent.
PIVOT_LENGTH = 9
#: Frequent prefixes up to this number are broadcast.
BROADCAST_ROWS = 200_000
#: Characters of a batch that is counted in one task (some 30 bytes each there).
BATCH_CHARS = 8_000_000


def strip_noise(sentences: DataFrame, removes: str | tuple[str, ...], sentence: str = "sentence") -> DataFrame:
    return sentences.withColumn(sentence, strip_characters(F.col(sentence), removes))


def windows(sentences: DataFrame, longest: int, *keep: str, sentence: str = "sentence") -> DataFrame:
    """(*keep, window): for each start, the up to ``longest`` characters there.

    Sentences are first cut into overlapping chunks, as finding a character by
    position in a long string costs its distance from the beginning.
    """
    s = F.col(sentence)
    starts = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / STRIDE).cast("int"))
    chunks = sentences.filter(F.length(s) > 0).select(
        *keep,
        s.alias("_s"),
        F.explode(starts).alias("_c"),
    )
    chunks = chunks.select(*keep, F.substring("_s", F.col("_c") * STRIDE + 1, F.lit(STRIDE + longest - 1)).alias("_t"))
    own = F.least(F.length("_t"), F.lit(STRIDE))
    return chunks.select(*keep, "_t", F.explode(F.sequence(F.lit(1), own)).alias("_i")).select(
        *keep, F.substring("_t", F.col("_i"), F.lit(longest)).alias("window")
    )


def _prefixes(rows: DataFrame, low: int, high: int, *keep: str) -> DataFrame:
    """(*keep, seqchar): prefixes of each window with low..high characters."""
    top = F.least(F.lit(high), F.length("window"))
    return (
        rows.filter(F.length("window") >= low)
        .select(*keep, "window", F.explode(F.sequence(F.lit(low), top)).alias("_n"))
        .select(*keep, F.substring("window", F.lit(1), F.col("_n")).alias("seqchar"))
    )


def char_ngrams(sentences: DataFrame, min_length: int, longest: int, *keep: str, sentence: str = "sentence") -> DataFrame:
    """(*keep, seqchar): every overlapping n-gram, with multiplicity."""
    low = max(1, min_length)
    if longest < low:
        return _prefixes(windows(sentences, 1, *keep, sentence=sentence), 2, 1, *keep).limit(0)
    return _prefixes(windows(sentences, longest, *keep, sentence=sentence), low, longest, *keep)


def _count(grams: DataFrame, by: list[str], min_count: int) -> DataFrame:
    return grams.groupBy(*by).agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") > min_count)


def _table(counts: DataFrame, keep: list[str]) -> DataFrame:
    return counts.select(*keep, "seqchar", F.length("seqchar").alias("length"), F.col("freq").cast("double").alias("freq"))


def count_ngrams(
    sentences: DataFrame, min_length: int, longest: int, min_count: int, *keep: str, sentence: str = "sentence", pivot: int = PIVOT_LENGTH
) -> DataFrame:
    """(*keep, seqchar, length, freq): n-grams more frequent than ``min_count``
    per combination of ``keep``.

    No gram is more frequent than its own prefix. Grams longer than ``pivot``
    are therefore generated only at starts whose pivot-length gram is frequent:
    exact, and most starts of natural text fall away.
    """
    low, by = max(1, min_length), [*keep, "seqchar"]
    pivot = max(pivot, low)
    if longest <= pivot + 1:
        return _table(_count(char_ngrams(sentences, low, longest, *keep, sentence=sentence), by, min_count), list(keep))
    short = cut(_count(char_ngrams(sentences, low, pivot, *keep, sentence=sentence), by, min_count))
    heads = short.filter(F.length("seqchar") == pivot).select(*by)
    starts = windows(sentences, longest, *keep, sentence=sentence).filter(F.length("window") > pivot)
    starts = starts.withColumn("seqchar", F.substring("window", 1, pivot))
    starts = starts.join(broadcast_upto(heads, BROADCAST_ROWS), by, "left_semi").drop("seqchar")
    long = _count(_prefixes(starts, pivot + 1, longest, *keep), by, min_count)
    return _table(short.unionByName(long), list(keep))


def split_by_size(sentences: DataFrame, batch: str, sentence: str = "sentence") -> tuple[DataFrame, DataFrame | None]:
    """Sentences of batches that one task can hold, and of those that none should,
    None if there are none."""
    sizes = sentences.groupBy(batch).agg(F.sum(F.length(sentence)).alias("_chars"))
    large = cut(sizes.filter(F.col("_chars") > BATCH_CHARS).select(batch))
    if large.isEmpty():
        return sentences, None
    large = broadcast_upto(large, BROADCAST_ROWS)
    return sentences.join(large, batch, "left_anti"), sentences.join(large, batch, "left_semi")


def count_batches(
    sentences: DataFrame, min_length: int, longest: int, min_count: int, batch: str, removes: str | tuple[str, ...], sentence: str = "sentence", top_only: bool = False
) -> DataFrame:
    """``count_ngrams`` by batch of the sentences without noise, a batch in one task.

    ``top_only`` leaves out grams in a gram of the batch whose product of one more
    than the count and the length is greater.
    """
    if not all(len(r) == 1 for r in removes):
        sentences, removes = strip_noise(sentences, removes, sentence), ""
    count = counter(max(1, min_length), longest, min_count, "".join(removes), top_only)
    groups = sentences.select(F.col(batch).cast("bigint").alias("batch_id"), F.col(sentence).alias("sentence")).groupBy("batch_id")
    return groups.applyInArrow(count, "batch_id bigint, seqchar string, length int, freq double").withColumnRenamed("batch_id", batch)


def count_half_batch(sentences: DataFrame, min_length: int, min_count: int, batch: str, sizes: DataFrame, sentence: str = "sentence") -> DataFrame:
    """``count_ngrams`` by batch, of grams of up to half as many characters as the
    batch has sentences by ``sizes`` (batch, _sentences)."""
    sizes = cut(sizes)
    most = sizes.agg(F.max(F.floor(F.col("_sentences") / 2))).first()[0] or 0
    grams = count_ngrams(sentences, min_length, int(most), min_count, batch, sentence=sentence)
    kept = grams.join(broadcast_upto(sizes, BROADCAST_ROWS), batch).filter(F.col("length") <= F.floor(F.col("_sentences") / 2))
    return kept.drop("_sentences")
