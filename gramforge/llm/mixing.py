"""Mixing sources to target weights by systematic sampling.

Every document of a source has an expected number of copies e; the documents
of the source are laid end to end in a fixed pseudo-random order, one random
offset u in [0, 1) is drawn per source, and a document is emitted once for
every integer that the running total u + sum(e) crosses. The source total is
therefore hit to within one document, whatever the weights.

Expected copies are fixed-point integers (units of 1e-12 copies), so prefix sums
are exact at any size and in any order of evaluation, and what rounding loses is
less than one document in a source of 10^12. The prefix sum has two
levels: documents are dealt into ``BUCKET_ROWS``-sized buckets by hash, bucket
totals are summed in the (small) bucket table, and only within a bucket is a
window run; a source that holds most of the corpus is spread over as many tasks
as it has buckets.

Default target: sources weighted by the square root of their characters, total
size as the input's. Explicit weights are numbers of at least 0, whole or not, in
any scale (they are taken in steps of 1e-9 of the greatest); anything else raises
``ValueError``. Sources that they do not name get none.

Defined results
---------------
* null source: a source of its own.  null or empty text: size 0; it counts as a
  document with the same expected copies as others of its source.
* a source whose texts are all empty: its documents are emitted once each.
* null id: a document like any other; the order goes by id and text.
* ties and repeated rows: each row is a document of its own; rows equal in id
  and text are interchangeable.
* very long texts: one document, whatever its length.   ids of any type.
* copies are repeated rows.   extra columns, whatever their names: untouched.
  empty table: empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_upto, cut, named

UNIT = 1_000_000_000_000
#: Steps of a weight.
WEIGHT_UNIT = 1_000_000_000
BUCKET_ROWS = 20_000
SEED = 7


def _key(docs: DataFrame, source_col: str) -> Column:
    """Source as a string that is never null: "s" + source, or "n"."""
    return F.coalesce(F.concat(F.lit("s"), named(docs, source_col).cast("string")), F.lit("n"))


def _fixed(weights: dict[str, float]) -> dict[str, int]:
    """Weights as whole numbers, the greatest ``WEIGHT_UNIT``."""
    for source, w in weights.items():
        if not math.isfinite(w) or w < 0:
            raise ValueError(f"the weight of {source!r} is {w}; weights are finite and at least 0")
    most = max(weights.values(), default=0)
    return {source: round(w / most * WEIGHT_UNIT) if most else 0 for source, w in weights.items()}


def rates(docs: DataFrame, weights: dict[str, float] | None, source_col: str, text_col: str) -> DataFrame:
    """(_gf_source, _gf_docs, _gf_e, _gf_u): documents, expected copies per
    document and offset, in units. One row per source."""
    sizes = docs.groupBy(_key(docs, source_col).alias("_gf_source")).agg(
        F.count(F.lit(1)).alias("_gf_docs"),
        F.coalesce(F.sum(F.length(named(docs, text_col))), F.lit(0)).cast("bigint").alias("_gf_size"),
    )
    if weights is None:
        # An integer, so that totals do not depend on the order of summation.
        weight = F.floor(F.sqrt(F.col("_gf_size").cast("double")) * 1000)
    else:
        fixed = _fixed(weights)
        table = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv]) if fixed else F.create_map().cast("map<string,int>")
        weight = F.coalesce(table[F.substring("_gf_source", 2, 2**31 - 1)], F.lit(0)).cast("bigint")
    sizes = cut(sizes.withColumn("_gf_w", weight))
    total = sizes.agg(F.sum("_gf_size").alias("t"), F.sum("_gf_w").alias("w")).first()
    t, w = int(total["t"] or 0), max(1, int(total["w"] or 0))
    # Whole numbers throughout: characters that the source gets, then copies.
    target = f"(CAST(_gf_w AS DECIMAL(19,0)) * CAST({t} AS DECIMAL(19,0))) div CAST({w} AS DECIMAL(19,0))"
    share = f"(CAST({target} AS DECIMAL(19,0)) * CAST({UNIT} AS DECIMAL(19,0))) div CAST(_gf_size AS DECIMAL(19,0))"
    e = F.when(F.col("_gf_size") > 0, F.expr(share)).otherwise(F.lit(UNIT))
    u = F.pmod(F.xxhash64(F.lit(SEED), F.col("_gf_source")), F.lit(UNIT))
    return sizes.select("_gf_source", "_gf_docs", e.cast("bigint").alias("_gf_e"), u.cast("bigint").alias("_gf_u"))


def mix_copies(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(_gf_row, copies): every input row as a struct, and how often it is emitted (0 too)."""
    per_source = cut(rates(docs, weights, source_col, text_col))
    rows = docs.select(
        _key(docs, source_col).alias("_gf_source"),
        F.xxhash64(F.lit(SEED), named(docs, id_col), named(docs, text_col)).alias("_gf_order"),
        named(docs, id_col).alias("_gf_id"),
        F.struct(*[named(docs, c) for c in docs.columns]).alias("_gf_row"),
    )
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_gf_docs") / BUCKET_ROWS)).cast("bigint")

    def place(some: DataFrame) -> DataFrame:
        return some.join(broadcast_upto(per_source, 20_000), "_gf_source").withColumn("_gf_bucket", F.pmod(F.col("_gf_order"), buckets))

    keys = ["_gf_source", "_gf_bucket"]
    counts = place(rows.select("_gf_source", "_gf_order")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_gf_n"))
    before = Window.partitionBy("_gf_source").orderBy("_gf_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(counts.withColumn("_gf_base", F.coalesce(F.sum("_gf_n").over(before), F.lit(0))).drop("_gf_n"))
    inside = Window.partitionBy(*keys).orderBy("_gf_order", "_gf_id")
    ranked = place(rows).withColumn("_gf_rank", F.row_number().over(inside)).join(broadcast_upto(base, 20_000), keys)

    def crossed(upto: str) -> Column:
        return F.expr(f"(_gf_u + CAST({upto} AS DECIMAL(18,0)) * CAST(_gf_e AS DECIMAL(19,0))) div CAST({UNIT} AS DECIMAL(19,0))")

    return ranked.select("_gf_row", (crossed("_gf_base + _gf_rank") - crossed("_gf_base + _gf_rank - 1")).alias("copies"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed corpus: input rows, each as often as it is emitted."""
    copies = mix_copies(docs, weights, id_col, source_col, text_col).filter("copies > 0")
    once = copies.select("_gf_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_gf_copy"))
    return once.select("_gf_row.*")


def brute_force(rows: list[tuple], rate_rows: list[tuple], order) -> dict:
    """Copies by id from (id, source) rows and (source, docs, e, u) rates, for tests."""
    out: dict = {}
    for source, n, e, u in rate_rows:
        buckets = max(1, -(-n // BUCKET_ROWS))
        own = sorted((order(i) % buckets, order(i), i) for i, s in rows if s == source)
        for k, (_, _, i) in enumerate(own, 1):
            out[i] = (u + k * e) // UNIT - (u + (k - 1) * e) // UNIT
    return out
