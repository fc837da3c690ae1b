"""The whole phrase-mining plan."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PhraseConfig
from ..functions.expressions import exact_key
from ..operators.containment import add_rank, drop_contained_batch, drop_contained_final
from ..operators.knowns import count_knowns, union_known_ngrams
from ..operators.ngrams import count_batches, count_half_batch, count_ngrams, split_by_size, strip_noise
from ..operators.regroup import regroup
from ..operators.selection import exclude_unnecessary, select_phrases, shape_filter
from ..operators.sentences import batch_texts
from ..operators.similarity import remove_similar
from ..sources.shared import cut

log = logging.getLogger("gramforge")


class PhraseMiner:
    """Finds new phrases in texts.

    Batches are a grouping key, not a loop: all batches of a corpus are counted
    in one job. The result depends on their size, as counts must exceed
    ``min_count`` within a batch; ``size_sentence=None`` counts globally.
    """

    def __init__(self, cfg: PhraseConfig | None = None, **settings):
        self.cfg = (cfg or PhraseConfig()).but(**settings) if settings else cfg or PhraseConfig()

    def sentences(self, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(batch_id, sentence). Texts are taken in the order of ``key``."""
        return batch_texts(texts, self.cfg.size_sentence, key, text)

    def candidates(self, sentences: DataFrame) -> DataFrame:
        """(batch_id, seqchar, length, freq) of n-grams and known terms."""
        cfg = self.cfg
        if cfg.half_batch:
            sizes = sentences.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_sentences"))
            grams = count_half_batch(strip_noise(sentences, cfg.removes), cfg.min_length, cfg.min_count, "batch_id", sizes)
        else:
            small, large = split_by_size(sentences, "batch_id")
            grams = self._counted(small)
            if large is not None:
                grams = grams.unionByName(self._counted_apart(large))
        if not cfg.knowns:
            return grams
        return union_known_ngrams(count_knowns(sentences, cfg.knowns, "batch_id"), grams)

    def _counted(self, sentences: DataFrame, top_only: bool = False) -> DataFrame:
        """N-grams of batches, each in one task."""
        cfg = self.cfg
        return count_batches(sentences, cfg.min_length, cfg.longest, cfg.min_count, "batch_id", cfg.removes, top_only=top_only)

    def _counted_apart(self, sentences: DataFrame) -> DataFrame:
        """N-grams of batches that are too large for one task."""
        cfg = self.cfg
        return count_ngrams(strip_noise(sentences, cfg.removes), cfg.min_length, cfg.longest, cfg.min_count, "batch_id")

    def _held(self, sentences: DataFrame) -> DataFrame:
        """Ranked candidates that no higher one of their batch contains."""
        cfg = self.cfg
        if cfg.half_batch or cfg.knowns or not exact_key(cfg.weight_freq, cfg.weight_len):
            return drop_contained_batch(cut(self.candidates(sentences)), cfg, "batch_id")
        small, large = split_by_size(sentences, "batch_id")
        held = add_rank(self._counted(small, top_only=True), cfg)
        if large is not None:
            held = held.unionByName(drop_contained_batch(cut(self._counted_apart(large)), cfg, "batch_id"))
        return held

    def batch_phrases(self, sentences: DataFrame) -> DataFrame:
        """Survivors of every batch: batch_id, seqchar, length, freq, sc_index, knowns."""
        cfg = self.cfg
        ranked = self._held(sentences)
        kept = exclude_unnecessary(ranked, cfg.unnecessary)
        if cfg.selection > 0:
            kept = shape_filter(kept, cfg)
        return kept.select("batch_id", "seqchar", "length", "freq", "sc_index", "knowns")

    def find_uniques(self, sentences: DataFrame, sentence: str = "sentence") -> DataFrame:
        """Phrases of one batch, with its selection's columns if selected."""
        cfg = self.cfg
        one = sentences.select(F.lit(0).cast("bigint").alias("batch_id"), F.col(sentence).alias("sentence"))
        kept = self.batch_phrases(one).drop("batch_id")
        return select_phrases(kept, cfg) if cfg.selection > 0 else kept

    def progress(self, batches: DataFrame, upto: int | None = None, rows: int = 5) -> DataFrame:
        """The leading phrases of the batches so far (up to one, if it is given)."""
        seen = batches if upto is None else batches.filter(F.col("batch_id") <= upto)
        grouped = seen.groupBy("seqchar", "length").agg(F.sum("freq").alias("freq"), F.avg("sc_index").alias("sc_index"), F.max("knowns").alias("knowns"))
        return grouped.orderBy(F.desc("knowns"), F.desc(F.round("sc_index", 9)), F.asc("seqchar")).limit(rows)

    def _report(self, batches: DataFrame) -> DataFrame:
        """Log the progress batch by batch, as it is asked for."""
        batches = cut(batches)
        ids = [r[0] for r in batches.select("batch_id").distinct().orderBy("batch_id").toLocalIterator()]
        for batch in ids:
            log.info("batch %s, so far:", batch)
            for row in self.progress(batches, batch).collect():
                log.info("%s", row)
        log.info("all batches counted: removing similar phrases" if ids else "no phrases found")
        return batches

    def finish(self, batches: DataFrame) -> DataFrame:
        """The global stage, over the union of batch survivors."""
        cfg = self.cfg
        if cfg.verbose >= 1:
            batches = self._report(batches)
        held = drop_contained_final(cut(regroup(batches)), cfg)
        original = remove_similar(held, cfg.threshold_originality)
        original = original.select("seqchar", "length", "freq", "sc_index", "knowns", "originality")
        return select_phrases(original, cfg) if cfg.selection > 0 else original

    def transform(self, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """The phrase table of ``texts``; null texts are left out."""
        return self.finish(self.batch_phrases(self.sentences(texts, key, text)))

    get_dfphrase = transform


def ranked_order(phrases: DataFrame) -> DataFrame:
    """Known terms first, then by score, then by text."""
    return phrases.orderBy(F.desc("knowns"), F.desc("sc_index"), F.asc("seqchar"))
