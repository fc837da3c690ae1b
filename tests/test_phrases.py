import random

import pytest
from brute import batch, lev, mine, periodic, spans, split

from gramforge.config import PhraseConfig
from gramforge.functions import expressions as X
from gramforge.functions.patterns import (
    KANJI,
    documented_negative,
    documented_positive,
    negative_patterns,
    notebook_negative,
    notebook_positive,
    positive_patterns,
    translate,
)
from gramforge.operators import containment, knowns, ngrams, selection, sentences, similarity
from gramforge.plans.miner import PhraseMiner, ranked_order
from gramforge.sources import texts as sources
from pyspark.sql import functions as F


def texts_df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def values(spark, column, strings):
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    return [r[0] for r in df.select(column(F.col("s"))).collect()]


def mined(spark, cfg, texts):
    rows = PhraseMiner(cfg).transform(texts_df(spark, texts)).collect()
    return {r["seqchar"]: (r["freq"], round(r["originality"], 9)) for r in rows}


def random_texts(seed, n=40, alphabet="アイウ犬猫ab"):
    r = random.Random(seed)
    words = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 4))) for _ in range(8)]
    return ["".join(r.choice(words) + r.choice(["", "", " ", "。", "\n"]) for _ in range(r.randint(3, 12))) for _ in range(n)]


def test_split_keeps_positions_and_drops_empties(spark):
    df = texts_df(spark, ["a。b．c\r\nd", "", "。。", None, "x.y"])
    rows = [tuple(r) for r in sentences.split_sentences(df).orderBy("doc_id", "pos").collect()]
    assert rows == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (0, 4, "d"), (4, 0, "x.y")]


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_batches_follow_order(spark, size):
    texts = [f"s{i}a\ns{i}b" for i in range(10)]
    got = PhraseMiner(size_sentence=size).sentences(texts_df(spark, texts)).collect()
    flat = split(texts)
    assert sorted((r["batch_id"], r["sentence"]) for r in got) == sorted((i // size, s) for i, s in enumerate(flat))


def test_ngrams_and_threshold(spark):
    df = texts_df(spark, ["ABAB\nABAB"])
    pieces = sentences.split_sentences(df)
    counts = {r["seqchar"]: r["freq"] for r in ngrams.count_ngrams(pieces, 2, 4, 1).collect()}
    assert counts == {"AB": 4, "BA": 2, "ABA": 2, "BAB": 2, "ABAB": 2}
    six = texts_df(spark, ["wxyz"] * 6 + ["mnop"] * 7)
    assert [r["seqchar"] for r in ngrams.count_ngrams(sentences.split_sentences(six), 4, 5, 6).collect()] == ["mnop"]
    assert ngrams.char_ngrams(pieces, 3, 2).count() == 0


def test_pruned_counting_equals_plain_counting_on_long_sentences(spark):
    r = random.Random(1)
    text = "".join(r.choice(["abcdefghijklm", "xyz", "q", "犬😀"]) for _ in range(900))
    pieces = sentences.split_sentences(texts_df(spark, [text, text[50:900]]))
    pruned = {tuple(x) for x in ngrams.count_ngrams(pieces, 3, 14, 4).collect()}
    plain = {tuple(x) for x in ngrams.count_ngrams(pieces, 3, 14, 4, pivot=14).collect()}
    assert pruned == plain and len(plain) > 100
    brute = {g: 0 for g, *_ in plain}
    for t in (text, text[50:900]):
        for n in range(3, 15):
            for i in range(len(t) - n + 1):
                if t[i : i + n] in brute:
                    brute[t[i : i + n]] += 1
    assert {(g, len(g), float(n)) for g, n in brute.items()} == plain


def test_noise(spark):
    cfg = PhraseConfig()
    assert values(spark, lambda s: X.strip_characters(s, cfg.removes), ["人工 知能、#AI", "ー:-,"]) == ["人工知能AI", "ー:-,"]
    assert values(spark, lambda s: X.strip_characters(s, ("ab", "c")), ["aabbcab"]) == ["ab"]


def test_knowns(spark):
    pieces = sentences.split_sentences(texts_df(spark, ["アアアアア", "x。ア"]))
    rows = {r["seqchar"]: r["freq"] for r in knowns.count_knowns(pieces, ["アア", "無", "ア"]).collect()}
    assert rows == {"アア": 2, "無": 0, "ア": 6}
    assert knowns.count_knowns(pieces, []).count() == 0
    with pytest.raises(ValueError):
        PhraseConfig(knowns=("",))
    with pytest.raises(TypeError):
        PhraseConfig(knowns="abc")


def test_periodic(spark):
    words = ["ゲゲゲ", "ガルガルガ", "ガルガルx", "アアアア", "回レロ回レロ", "AB", "AA", "A", "ABABC"]
    expected = [True, True, True, True, False, False, False, False, True]
    assert [periodic(w) for w in words] == expected == values(spark, X.is_periodic, words)


def test_scores_and_similarity(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("abcd", "efghijklmnopqrst"), ("漢字かな", "漢字カナ")], "a string, b string")
    got = [r[0] for r in df.select(X.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1 - 3 / 6.5, 1 - 16 / 10, 0.5])


STRINGS = [
    "データベース", "人工知能", "テストする", "１，２", "1万円", "ンabc", "2024年1月2日", "abc", "ABC", "A", "Ab_c d.*", "ｱｲｳ", "ＡＢ", "03-1234-5678", "090-1234-5678",
    "(03) 123 4567", "a.b+c@x-y.org", "https://a.b/c?d=e", "12日", "1,234,567円", "０円", "１００ドル", "9ユーロ", "ひらがな", "a\n", "漢カ", "カ漢", "漢なカ", "ＡＡなカ", "カタかな", "1ドル", "x2,", "漢2,", "千円", "\n", "_",
]
SETS = {
    "positive": positive_patterns(), "shipped": positive_patterns("shipped"), "negative": negative_patterns(), "doc+": documented_positive(), "doc-": documented_negative(),
    "note+": notebook_positive("shipped"), "note-": notebook_negative(),
}


@pytest.mark.parametrize("name", SETS)
def test_patterns_equal_python(spark, name):
    df = spark.createDataFrame([(s,) for s in STRINGS], "s string")
    patterns = SETS[name]
    flags = [X.full_match(F.col("s"), p).alias(f"c{i}") for i, p in enumerate(patterns.values())]
    first = [X.first_match(F.col("s"), p).alias(f"m{i}") for i, p in enumerate(patterns.values())]
    import re

    for row in df.select("s", *flags, *first).collect():
        for i, p in enumerate(patterns.values()):
            assert row[f"c{i}"] == spans(p, row["s"]), (row["s"], p)
            m = re.search(p, row["s"])
            assert row[f"m{i}"] == (m.group() if m else None), (row["s"], p)


def test_kanji_and_refused_patterns():
    assert len(KANJI) == 2965 and KANJI[0] == "亜" and KANJI[-1] == "腕"
    with pytest.raises(ValueError):
        translate("(?P<name>x)")
    with pytest.raises(ValueError):
        positive_patterns("other")


def test_last_label_wins(spark):
    assert values(spark, lambda s: X.last_label([("a", s.startswith("x")), ("b", s.endswith("y"))]), ["xy", "x", "y", "z"]) == ["b", "a", "b", None]
    assert values(spark, lambda s: X.last_label([]), ["x"]) == [None]


def test_junk_entries_are_expressions(spark):
    df = spark.createDataFrame([("a1b",), ("www.x",), ("ok",)], "seqchar string")
    assert [r[0] for r in selection.exclude_unnecessary(df, ("a[0-9]b", "www")).collect()] == ["ok"]
    assert selection.exclude_unnecessary(df, ()).count() == 3


def test_worked_example(spark):
    cfg = PhraseConfig(min_length=2, max_length=3, min_count=1, selection=0)
    assert set(mined(spark, cfg, ["ABAB\nABAB"])) == {"ABAB"}
    assert mined(spark, cfg.but(selection=1), ["ABAB\nABAB"]) == {}


def test_final_ties_go_to_the_lesser_text(spark):
    # Equal keys: (1+7)*6 == (1+11)*4.
    def left(inner):
        df = spark.createDataFrame([("bcdefg", 6, 7.0), (inner, 4, 11.0)], "seqchar string, length int, freq double")
        final = {r["seqchar"] for r in containment.drop_contained_final(df, PhraseConfig()).collect()}
        return final, {r["seqchar"] for r in containment.drop_contained_batch(df, PhraseConfig()).collect()}

    assert left("bcde") == ({"bcdefg", "bcde"}, {"bcdefg", "bcde"})
    assert left("cdef") == ({"bcdefg"}, {"bcdefg", "cdef"})


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("weights", [(1.0, 1.0), (1.0, 0.0)])
def test_batch_against_model(spark, seed, weights):
    cfg = PhraseConfig(min_count=2, min_length=2, max_length=5, selection=0, weight_freq=weights[0], weight_len=weights[1], knowns=("アイ犬",) if seed % 2 else ())
    texts = random_texts(seed)
    pieces = sentences.split_sentences(texts_df(spark, texts))
    got = {r["seqchar"]: r["freq"] for r in PhraseMiner(cfg).find_uniques(pieces).collect()}
    assert got == dict(batch(cfg, split(texts)))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("changes", [{}, {"selection": 0, "size_sentence": 30}, {"size_sentence": 25, "knowns": ("犬猫", "アb")}, {"selection": 0, "size_sentence": None, "threshold_originality": 0.0}])
def test_whole_plan_against_model(spark, seed, changes):
    cfg = PhraseConfig(min_count=3, min_length=2, max_length=5).but(**changes)
    texts = random_texts(100 + seed, 60)
    assert mined(spark, cfg, texts) == mine(cfg, texts)


def test_similarity_against_all_pairs(spark):
    r = random.Random(5)
    words = list({"".join(r.choice("abcd") for _ in range(r.randint(3, 9))) for _ in range(60)})
    df = spark.createDataFrame([(w, len(w), float(r.randint(1, 9))) for w in words], "seqchar string, length int, freq double")
    ranked = containment.add_rank(df, PhraseConfig())
    rows = sorted(ranked.collect(), key=lambda x: (-x["_key"], x["seqchar"]))
    expected = {}
    for i, x in enumerate(rows):
        best = max([0.0, *(1 - lev(x["seqchar"], h["seqchar"]) / ((x["length"] + h["length"]) / 2) for h in rows[:i])])
        expected[x["seqchar"]] = round(1 - best, 9)
    for threshold in (0.0, 0.4, 0.7):
        got = {x["seqchar"]: round(x["originality"], 9) for x in similarity.remove_similar(ranked, threshold).collect()}
        assert got == {k: v for k, v in expected.items() if v > threshold}


def test_full_batches_leave_no_empty_rest(spark):
    cfg = PhraseConfig(min_count=1, min_length=2, max_length=3)
    texts = ["カタカナ", "カタカナ"] * 3
    assert mined(spark, cfg.but(size_sentence=6), texts) == mined(spark, cfg.but(size_sentence=7), texts)


def test_no_candidates_and_empty_tables(spark):
    cfg = PhraseConfig()
    for texts in ([], [None], [""], ["。"], ["短い"]):
        assert mined(spark, cfg, texts) == {}
    out = PhraseMiner(cfg).transform(texts_df(spark, []))
    assert out.columns[:8] == ["seqchar", "length", "freq", "sc_index", "knowns", "match_ptn", "negative_ptn", "originality"]
    assert len(out.columns) == 8 + 11 + 14 + 1
    assert PhraseMiner(cfg.but(selection=0)).transform(texts_df(spark, [])).columns == ["seqchar", "length", "freq", "sc_index", "knowns", "originality"]


def test_zero_count_knowns_stay_without_selection(spark):
    cfg = PhraseConfig(min_count=1, min_length=2, max_length=3, selection=0, knowns=("無無",), threshold_originality=0.0)
    got = mined(spark, cfg, ["ABAB", "ABAB"])
    assert got["無無"][0] == 0


def test_sources(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("一行目\n二行目\n", encoding="utf-8")
    assert [r[0] for r in sources.read_tsv(spark, str(tmp_path / "t.tsv")).collect()] == ["一行目", "二行目"]
    assert sources.read_lines(spark, str(tmp_path / "t.tsv")).count() == 2
    flat = sources.flatten_columns(spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "k int, x string, y string"), "k", ["x", "y"])
    assert sorted(map(str, flat.collect())) == sorted(map(str, [r for r in spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, None)], "k int, col int, text string").collect()]))
    a, b = (sources.random_corpus(spark, 20, 5, seed=1).orderBy("doc_id").collect() for _ in "ab")
    assert a == b and len(a) == 20 and a != sources.random_corpus(spark, 20, 5, seed=2).orderBy("doc_id").collect()
    phrases = PhraseMiner(min_count=1, min_length=2, max_length=4, selection=0).transform(sources.from_array(spark, ["ABAB", "ABAB"]))
    sources.write_phrases(phrases, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == ranked_order(phrases).count() == len(sources.top_rows(phrases).collect())
    sources.report(phrases)


def test_stream_equals_batches(spark, tmp_path):
    from gramforge.streaming.miner import StreamingMiner

    cfg = PhraseConfig(min_count=2, min_length=2, max_length=5, selection=0)
    parts = [random_texts(7, 30), random_texts(8, 30)]
    folder = tmp_path / "in"
    for k, texts in enumerate(parts):
        spark.createDataFrame([(k * 1000 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(folder))
    miner = StreamingMiner(PhraseMiner(cfg), str(tmp_path / "survivors"))
    stream = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = miner.start(stream, str(tmp_path / "checkpoint"), availableNow=True)
    assert query.awaitTermination(180)
    from brute import hold

    total = {}
    for texts in parts:
        for s, f in batch(cfg, split(texts)):
            total[s] = total.get(s, 0) + f
    held = {s: f for s, f in hold(cfg, sorted(total.items()))}
    got = {r["seqchar"]: r["freq"] for r in miner.phrases(spark).collect()}
    assert got and got.items() <= held.items()
    assert miner.progress(spark).count() == 5
    miner.process(texts_df(spark, parts[0]), 0)  # a repeated epoch overwrites itself
    assert {r["seqchar"]: r["freq"] for r in miner.phrases(spark).collect()} == got


def test_originality_has_no_nested_loop(spark, monkeypatch):
    """Also where phrases fill several blocks."""
    r = random.Random(6)
    words = list({"".join(r.choice("abcdeアイ") for _ in range(r.randint(1, 9))) for _ in range(150)})
    df = spark.createDataFrame([(w, len(w), float(r.randint(1, 9))) for w in words], "seqchar string, length int, freq double")
    ranked = containment.add_rank(df, PhraseConfig(knowns=tuple(words[:3])))
    whole = {x["seqchar"]: x["originality"] for x in similarity.remove_similar(ranked, 0.2).collect()}
    monkeypatch.setattr(similarity, "BLOCK", 40)
    monkeypatch.setattr(similarity, "HEADS", 1)
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", 0)
    assert {x["seqchar"]: x["originality"] for x in similarity.remove_similar(ranked, 0.2).collect()} == whole
    left = ranked.withColumn("_sim", F.lit(0.0))
    plan = similarity._all_higher(left, ranked)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "HashJoin" in plan


def test_bound_is_no_less_than_the_similarity(spark):
    r = random.Random(2)
    pairs = [tuple("".join(r.choice("abcde漢字かなカナ") for _ in range(r.randint(1, 12))) for _ in "ab") for _ in range(400)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")

    def side(c):
        out = df.select("i", F.col(c).alias("seqchar"), F.length(c).alias("_len"), similarity._characters(F.col(c)).alias("_bits"))
        return out.withColumn("_extra", F.col("_len") - F.bit_count("_bits")).alias(c)

    joined = side("a").join(side("b"), F.col("a.i") == F.col("b.i"))
    rows = joined.select(similarity._bound("a", "b").alias("bound"), X.similarity(F.col("a.seqchar"), F.col("b.seqchar")).alias("sim")).collect()
    assert all(x["bound"] >= x["sim"] - 1e-12 for x in rows) and any(x["bound"] < 0.5 for x in rows)


def test_grams_of_half_a_batch(spark):
    cfg = PhraseConfig(max_length=-2, min_length=1, min_count=1, selection=0, size_sentence=6, threshold_originality=0.0, removes="")
    texts = ["abcd", "abcd", "xabc", "abcy", "abcd", "zz", "abc", "abc", "q"]  # 6 sentences, then 3
    m = PhraseMiner(cfg)
    got = {(x["batch_id"], x["seqchar"], x["freq"]) for x in m.candidates(m.sentences(texts_df(spark, texts))).collect()}
    expected = set()
    for b, part in enumerate((texts[:6], texts[6:])):
        counts = {}
        for s in part:
            for n in range(1, len(part) // 2 + 1):
                for i in range(len(s) - n + 1):
                    counts[s[i : i + n]] = counts.get(s[i : i + n], 0) + 1
        expected |= {(b, g, float(n)) for g, n in counts.items() if n > 1}
    assert got == expected and max(len(g) for _, g, _ in got) == 3
    assert mined(spark, cfg.but(max_length=-1), texts) == {}


def test_verbose_reports_batch_by_batch(spark, caplog):
    cfg = PhraseConfig(min_count=1, min_length=2, max_length=3, selection=0, size_sentence=2)
    texts = ["ABAB", "ABAB", "CDCD", "CDCD"]
    with caplog.at_level("INFO", logger="gramforge"):
        quiet = mined(spark, cfg, texts)
        assert not caplog.records
        assert mined(spark, cfg.but(verbose=1), texts) == quiet
    lines = [r.getMessage() for r in caplog.records]
    assert [x for x in lines if x.startswith("batch")] == ["batch 0, so far:", "batch 1, so far:"]
    assert "CDCD" not in "".join(lines[: lines.index("batch 1, so far:")]) and "CDCD" in "".join(lines)
    with caplog.at_level("INFO", logger="gramforge"):
        mined(spark, cfg.but(verbose=1), ["x"])
    assert caplog.records[-1].getMessage() == "no phrases found"


def test_document_queries_against_model(spark, tmp_path):
    """The queries over all documents, with their own settings, on a small folder."""
    from gramforge import queries

    r = random.Random(4)
    words = ["データ", "モデル", "機械", "学習", "の", "です。", "Spark", "NASA", "新しい", "ＡＢＣ", "www.x", "\n"]
    texts = ["".join(r.choice(words) for _ in range(30)) for _ in range(120)] + [None, "", "短い"]
    texts_df(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["seqchar"]: (x["freq"], round(x["originality"], 9)) for x in queries.QUERIES["get_dfphrase_documents"](spark, str(tmp_path)).collect()}
    assert got == mine(queries.CFG, texts) and len(got) > 10
    counts = {}
    for s in split(texts):
        for c in queries.CFG.removes:
            s = s.replace(c, "")
        for n in range(queries.CFG.min_length, queries.CFG.longest + 1):
            for i in range(len(s) - n + 1):
                counts[s[i : i + n]] = counts.get(s[i : i + n], 0) + 1
    found = {(x["batch_id"], x["seqchar"], x["length"], x["freq"]) for x in queries.QUERIES["ngram_counts_documents"](spark, str(tmp_path)).collect()}
    assert found == {(0, g, len(g), float(n)) for g, n in counts.items() if n > queries.CFG.min_count}


def test_every_positive_pattern_occurs_in_the_japanese_corpus(spark):
    from gramforge import queries

    rows = queries.QUERIES["positive_flags_japanese"](spark, "").toPandas()
    assert all(rows[c].any() and not rows[c].all() for c in rows.columns if c not in ("batch_id", "seqchar"))


def grams_of(rows):
    return {(x["batch_id"], x["seqchar"], x["length"], x["freq"]) for x in rows}


@pytest.mark.parametrize("changes", [{}, {"min_count": 0, "max_length": 12}, {"min_length": 0, "removes": ("ア", "ab", "")}, {"max_length": 0}])
def test_a_batch_in_one_task_equals_all_batches_by_rows(spark, changes):
    """Counts and containment, also with characters beyond the basic plane, NUL and many letters."""
    cfg = PhraseConfig(min_count=2, min_length=2, max_length=9, selection=0, size_sentence=37).but(**changes)
    r = random.Random(3)
    texts = random_texts(11, 150, "アイab犬😀\0é") + ["".join(chr(0x4E00 + r.randint(0, 3000)) for _ in range(200)) + "。" + "😀" * 40] * 4 + ["", None, " \n。"]
    m = PhraseMiner(cfg)
    pieces = m.sentences(texts_df(spark, texts)).localCheckpoint()
    plain = ngrams.count_ngrams(ngrams.strip_noise(pieces, cfg.removes), cfg.min_length, cfg.longest, cfg.min_count, "batch_id").localCheckpoint()
    expected = grams_of(plain.collect())
    rows = m.candidates(pieces).collect()
    assert grams_of(rows) == expected and len(rows) == len(expected)
    held = grams_of(m._held(pieces).collect())
    assert held == grams_of(containment.drop_contained_batch(plain, cfg, "batch_id").collect())
    assert cfg.max_length == 0 or 50 < len(held) < len(expected)


def test_batches_too_large_for_a_task_give_the_same(spark, monkeypatch):
    cfg = PhraseConfig(min_count=2, min_length=2, max_length=11, selection=0, size_sentence=40)
    m = PhraseMiner(cfg)
    pieces = m.sentences(texts_df(spark, random_texts(12, 60) + ["犬猫ab" * 60] * 50)).localCheckpoint()
    whole, held = grams_of(m.candidates(pieces).collect()), grams_of(m._held(pieces).collect())
    sizes = sorted(x[0] for x in pieces.groupBy("batch_id").agg(F.sum(F.length("sentence"))).select("sum(length(sentence))").collect())
    for bound in (0, sizes[0]):
        monkeypatch.setattr(ngrams, "BATCH_CHARS", bound)
        assert grams_of(m.candidates(pieces).collect()) == whole
        assert grams_of(m._held(pieces).collect()) == held
    assert sizes[0] < sizes[-1]


def test_broken_utf8_is_counted_by_what_can_be_read(spark):
    df = spark.createDataFrame([(0,)], "batch_id bigint").select("batch_id", F.expr("cast(X'FF6162636465' as string)").alias("sentence"))
    rows = PhraseMiner(min_count=0, selection=0).candidates(df).collect()
    assert {x["seqchar"] for x in rows} == {"abcd", "bcde", "abcde"}


def test_the_document_phrases_make_no_rows_of_infrequent_grams(spark):
    """Neither grams nor the substrings of candidates go through a shuffle."""
    m = PhraseMiner(selection=0, unnecessary=())
    plan = m.batch_phrases(m.sentences(texts_df(spark, ["abcdefgh"] * 9)))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "substring(" not in plan


@pytest.mark.parametrize("bound", [0, 1000])
def test_texts_are_batched_without_being_put_in_order(spark, monkeypatch, bound):
    """Sentences are not written to number them; repeated and null keys are numbered as before."""
    monkeypatch.setattr(sentences, "BROADCAST_TEXTS", bound)
    r = random.Random(9)
    texts = [None if i % 7 == 3 else "。".join(r.choice(["", "ab", f"s{i}", "x\ny"]) for _ in range(r.randint(0, 9))) for i in range(80)]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    for extra in ([], [(950, "zz。aa")], [(None, "first。second")]):
        table = spark.createDataFrame(rows + extra, "doc_id bigint, text string").repartition(5)
        got = sentences.batch_texts(table, 6)
        order = sentences.assign_batches(sentences.split_sentences(table), 6, ["doc_id", "pos", "sentence"]).select("batch_id", "sentence")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, order.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("Window" in plan) == bool(extra)


@pytest.mark.parametrize(
    "name",
    [
        "ngram_counts",
        "union_known_ngram",
        "phrase_score",
        "top_phrases",
        "phrase_rank",
        "cross_batch_regroup",
    ],
)
def test_conversation_queries_make_no_rows_of_grams(spark, tmp_path, name):
    """Grams are counted within a task: none is a row before it is known to be frequent."""
    from gramforge import queries

    chat = spark.createDataFrame([(i // 2, i % 2, "user", "abcdefghijklmnop") for i in range(20)], "conv_id bigint, turn bigint, role string, text string")
    chat.write.parquet(f"{tmp_path}/conversations.parquet")
    plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "sequence(" not in plan and "substring(" not in plan
