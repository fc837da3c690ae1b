from pyspark.sql import functions as F

from gramforge.llm import exact_dedup as op


def pairs(df):
    return {(r["doc_id"], r["keep_doc_id"]) for r in df.collect()}


def test_against_brute_force(docs, words):
    base = [words(i, 40) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t) for i, t in enumerate(base[:10])] + [(200 + i, t) for i, t in enumerate(base[:3])]
    prefix = words(7, 400)
    rows += [(300 + i, prefix + " " + str(i % 5)) for i in range(12)]  # a long shared beginning
    rows += [(400, prefix), (401, prefix)]  # ends where others go on
    assert pairs(op.exact_duplicates(docs(rows))) == op.brute_force(rows)


def test_long_texts_that_differ_at_the_end(docs):
    long = "a" * 150_000
    rows = [(1, long + "x"), (2, long + "y"), (3, long + "x"), (4, long), (5, long + "xx")]
    assert pairs(op.exact_duplicates(docs(rows))) == {(3, 1)}


def test_nulls_empties_ties_and_clashes(docs, clash):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (None, "abc"), (9, "abc"), (9, "abc"), (5, "é"), (6, "é")]
    df = docs(rows, clash)
    assert pairs(op.exact_duplicates(df)) == {(4, 3), (None, 9), (9, 9)}
    kept = op.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()), key=str)
    assert got == sorted([(1, None), (2, None), (3, ""), (9, "abc"), (5, "é"), (6, "é")], key=str)


def test_digit_boundaries(docs):
    n = op.FIRST_DIGIT
    rows = [(1, "b" * n), (2, "b" * n), (3, "b" * (n + 1)), (4, "b" * (n + 1)), (5, "b" * (n - 1)), (6, "b" * n * (1 + op.GROWTH)), (7, "b" * n * (1 + op.GROWTH))]
    assert pairs(op.exact_duplicates(docs(rows))) == {(2, 1), (4, 3), (7, 6)}


def test_empty_table_and_all_columns_null(docs):
    assert op.exact_duplicates(docs([])).count() == 0
    assert op.drop_exact_duplicates(docs([])).count() == 0
    df = docs([(None, None), (None, None)]).withColumn("source", F.lit(None).cast("string"))
    assert op.drop_exact_duplicates(df).count() == 2


def test_ids_of_other_types_and_large_ids(spark, words):
    t = words(1, 50)
    df = spark.createDataFrame([("b", t), ("a", t), (None, t), ("c", "other")], "doc_id string, text string")
    assert pairs(op.exact_duplicates(df)) == {("b", "a"), (None, "a")}
    big = 2**53
    df = spark.createDataFrame([(big + 1, t), (big, t), (None, t)], "doc_id bigint, text string")
    assert pairs(op.exact_duplicates(df)) == {(big + 1, big), (None, big)}


def test_without_broadcasts(spark, docs, words, monkeypatch):
    """Beyond the bounds, with sides that are shuffled."""
    monkeypatch.setattr(op, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    head = "a common beginning of more than sixty-four bytes, like a document type "
    rows = [(i, head + words(i // 3, 40)) for i in range(60)] + [(100 + i, words(i // 2, 40)) for i in range(20)]
    assert pairs(op.exact_duplicates(docs(rows))) == op.brute_force(rows)
    gone = {i for i, _ in op.brute_force(rows)}
    assert sorted(r["doc_id"] for r in op.drop_exact_duplicates(docs(rows)).collect()) == sorted(i for i, _ in rows if i not in gone)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
