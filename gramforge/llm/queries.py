"""Driver queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprint, html_density, licenses, lines, mixing, packing, pii, simhash, toxicity
from .common import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents found toxic, with score and offending character offsets."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.toxic_documents(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ranges of all documents, packed into windows."""
    return packing.pack_windows(read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mixture emits each document (0: not at all)."""
    copies = mixing.mix_copies(read(spark, sf_dir, "documents"))
    return copies.select(F.col("_gf_row.doc_id").alias("doc_id"), F.col("_gf_row.source").alias("source"), "copies")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document with its nearest benchmark item, its class of near
    digests, and the number of documents within a difference score of it."""
    return fingerprint.fingerprint_classes(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat another's text, with the one that is kept."""
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data or secrets: spans and redacted texts."""
    return pii.find_pii(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that nearly repeat another, with the one that is kept."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the boilerplate lines of their hosts."""
    return lines.drop_boilerplate(read(spark, sf_dir, "pages"))


def op9_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main content of every page."""
    return html_density.extract_pages(read(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licenses of documents and of their lines."""
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_packing,
        op3_mixing,
        op4_fingerprint,
        op5_exact_dedup,
        op6_pii,
        op7_simhash,
        op8_line_dedup,
        op9_html_density,
        op10_license_scan,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_line_dedup": lines.ORACLE_SQL,
    "op10_license_scan": licenses.ORACLE_SQL,
}
