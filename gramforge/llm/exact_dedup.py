"""Exact deduplication by distributed MSD radix partitioning.

Texts are taken as their length followed by their bytes. They are split by length
and leading bytes, groups that hold one document leave at once, and the rest is
split again by the bytes that follow, until a group is a
single document or its texts have ended. Two documents are declared equal only
when every byte of both has been compared, digit by digit: no digest decides.

The digit grows geometrically (``FIRST_DIGIT`` bytes, then ``GROWTH`` times as
many), so a text of n bytes takes O(log n) rounds, and each round moves only
the documents that still share all bytes so far with another one, without the
bytes already compared. Round one moves only lengths, digits and counts, never
texts. While the first digits that several documents share fit ``BROADCAST_BYTES``
(some 4 million), they are sent to the texts, and only texts that share one move;
beyond, texts and digits are shuffled once by digit, which adaptive execution
splits where one digit is common.

Defined results
---------------
* null text: never a duplicate, always kept.
* empty texts: equal to each other.
* very long texts: compared to the last byte, in O(log length) rounds.
* ids of any type that has an order; they come back as they are.
* ties and repeated rows: of equal texts the row with the least doc_id stays
  (null ids last); repeated rows with one id collapse to one row.
* extra columns, whatever their names: carried along untouched.
* empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_upto, cut, named, safe_names

#: Bytes of the first digit and the factor by which each next digit is longer.
FIRST_DIGIT = 64
GROWTH = 16


#: Bytes of a side that is broadcast at most; a larger one is shuffled.
BROADCAST_BYTES = 64 << 20


def _first_cell(raw: Column) -> Column:
    """Hash of a text's length and first digit; null for a null text. Only tells texts
    that do not share them apart: cells are split by the digits themselves."""
    return F.when(raw.isNotNull(), F.xxhash64(F.substring(raw, 1, FIRST_DIGIT), F.octet_length(raw)))


def _partition(docs: DataFrame, id_col: str, text_col: str, keep_rows: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells of first digits that several rows have, those rows, duplicates).

    The rows have _gf_rid, _gf_id and, with keep_rows, the struct _gf_row; the
    duplicates have _gf_rid, _gf_id and _gf_keep.
    """
    raw = F.encode(named(docs, text_col), "UTF-8")
    heads = docs.filter(raw.isNotNull()).select(
        F.substring(raw, 1, FIRST_DIGIT).alias("_gf_digit"), F.octet_length(raw).alias("_gf_size")
    )
    several = heads.groupBy("_gf_digit", "_gf_size").agg(F.count(F.lit(1)).alias("_gf_n")).filter("_gf_n > 1")
    cells = cut(several.select(F.xxhash64("_gf_digit", "_gf_size").alias("_gf_cell")))
    shared = broadcast_upto(cells, BROADCAST_BYTES // 16)
    source = docs.select(
        named(docs, id_col).alias("_gf_id"),
        _first_cell(raw).alias("_gf_cell"),
        F.struct(*[named(docs, c) for c in docs.columns]).alias("_gf_row") if keep_rows else raw.alias("_gf_raw"),
    )
    kept = source.join(shared, "_gf_cell", "left_semi").withColumn("_gf_rid", F.monotonically_increasing_id())
    state = cut(kept.drop("_gf_cell"))
    if keep_rows:
        text = F.encode(F.col("_gf_row")[text_col], "UTF-8")
    else:
        text = F.col("_gf_raw")

    def digits(rows: DataFrame, rest: Column, width: int, *group: str) -> DataFrame:
        """Rows with their next digit, whether they end with it, and what is left."""
        return rows.select(
            "_gf_rid",
            "_gf_id",
            *group,
            F.substring(rest, 1, width).alias("_gf_digit"),
            (F.octet_length(rest) <= width).alias("_gf_ended"),
            F.substring(rest, width + 1, 2**31 - 1).alias("_gf_raw"),
        )

    width = FIRST_DIGIT
    contending = digits(state.withColumn("_gf_size", F.octet_length(text)), text, width, "_gf_size")
    by = ["_gf_size", "_gf_digit", "_gf_ended"]
    duplicates: DataFrame | None = None
    while True:
        groups = cut(
            contending.groupBy(*by)
            .agg(
                F.count(F.lit(1)).alias("_gf_n"),
                F.min("_gf_rid").alias("_gf_next"),
                F.min(F.struct(F.col("_gf_id").isNull(), "_gf_id", "_gf_rid")).alias("_gf_first"),
            )
            .filter("_gf_n > 1")
        )
        # First digits are short and can be sent to the texts; longer ones would
        # outgrow a broadcast, and only copies or long common beginnings remain.
        split = contending.join(broadcast_upto(groups, BROADCAST_BYTES // 128) if width == FIRST_DIGIT else groups, by)
        ended_rows = split.filter("_gf_ended").select(
            "_gf_rid",
            "_gf_id",
            F.col("_gf_first._gf_id").alias("_gf_keep"),
            (F.col("_gf_rid") == F.col("_gf_first._gf_rid")).alias("_gf_stays"),
        )
        found = cut(ended_rows.filter("NOT _gf_stays").drop("_gf_stays"))
        duplicates = found if duplicates is None else duplicates.unionByName(found)
        if not groups.filter("NOT _gf_ended").limit(1).count():
            return shared, state, duplicates
        width *= GROWTH
        going_on = split.filter("NOT _gf_ended").withColumn("_gf_group", F.col("_gf_next"))
        contending = cut(digits(going_on, F.col("_gf_raw"), width, "_gf_group"))
        by = ["_gf_group", "_gf_digit", "_gf_ended"]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row that equals an earlier document: (id_col, keep_<id_col>).

    keep_<id_col> is the least id among the documents with that text.
    """
    _, _, duplicates = _partition(docs, id_col, text_col, keep_rows=False)
    return duplicates.select(F.col("_gf_id").alias(id_col), F.col("_gf_keep").alias(f"keep_{id_col}"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows without those that repeat an earlier document's text."""
    plain, at = safe_names(docs), docs.columns.index(text_col)
    shared, state, duplicates = _partition(plain, f"_gf_c{docs.columns.index(id_col)}", f"_gf_c{at}", keep_rows=True)
    cell = _first_cell(F.encode(F.col(f"_gf_c{at}"), "UTF-8"))
    alone = plain.withColumn("_gf_cell", cell).join(shared, "_gf_cell", "left_anti").select(*plain.columns)
    gone = broadcast_upto(cut(duplicates.select("_gf_rid")), BROADCAST_BYTES // 16)
    return alone.unionByName(state.join(gone, "_gf_rid", "left_anti").select("_gf_row.*")).toDF(*docs.columns)


def brute_force(rows: list[tuple]) -> set[tuple]:
    """(id, keep) of every non-first row with a repeated text; for tests."""
    first: dict = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if text is not None:
            first.setdefault(text, []).append(i)
    return {(i, ids[0]) for ids in first.values() for i in ids[1:]}


#: Rank of a text's rows, whole table: what SQL says of the same question.
ORACLE_SQL = """
SELECT doc_id, keep_doc_id FROM (
  SELECT doc_id,
         first_value(doc_id) OVER w AS keep_doc_id,
         row_number() OVER w AS rn
  FROM documents WHERE text IS NOT NULL
  WINDOW w AS (PARTITION BY text ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
) WHERE rn > 1
"""
