"""Driver queries of the phrase-mining operators and the SQL that checks them.

Every query covers its whole tables. Where n-grams of a whole table are too
many for the SQL check, the query runs on a smaller table, whole; the same
operators over all documents are ``get_dfphrase_documents`` and
``ngram_counts_documents``, which are checked by brute force in the tests. Three
queries run on a seeded corpus that SQL makes as well, two of them on Japanese.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import DEFAULT_REMOVES, PhraseConfig
from .functions import expressions as X
from .functions.patterns import negative_patterns, positive_patterns, translate
from .operators import containment, knowns, ngrams, regroup, selection, sentences, similarity
from .plans.miner import PhraseMiner
from .sources import texts as sources

KNOWNS = ("the", "tion", "de la", "erst", "ungkeit", "zzzz")
CFG = PhraseConfig()
PART = PhraseConfig(size_sentence=500, selection=0)
#: Part names are lower-case words, which the default set calls noise.
PART_SELECT = PART.but(selection=1, negative={k: p for k, p in negative_patterns().items() if k != "x_smalla"})
CHAT = PhraseConfig(size_sentence=500)
JAPANESE = PhraseConfig(size_sentence=500)
ITEMS = PhraseConfig(min_count=2, size_sentence=None, selection=0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _q6(df: DataFrame, *columns: str) -> DataFrame:
    """Logarithms differ in the last bit between engines."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- SQL building blocks -----------------------------------------------------

_REMOVES_SQL = " || ".join(f"chr({ord(c)})" for c in DEFAULT_REMOVES)


def _sents(table: str, key: str, text: str) -> str:
    return f"""pieces AS (
  SELECT {key}, unnest(range(len(p))) AS pos, unnest(p) AS sentence
  FROM (SELECT {key}, string_split_regex({text}, '[\\r\\n。．]') AS p FROM {table} WHERE {text} IS NOT NULL)
), sents AS (SELECT * FROM pieces WHERE sentence <> '')"""


def _batched(key: str, size: int | None) -> str:
    batch = "0" if size is None else f"(row_number() OVER (ORDER BY {key}, pos, sentence) - 1) // {size}"
    return f"batched AS (SELECT CAST({batch} AS BIGINT) AS batch_id, sentence FROM sents)"


def _grams(source: str = "batched", keep: str = "batch_id", low: int = 4, high: int = 17) -> str:
    return f"""stripped AS (SELECT {keep}, translate(sentence, {_REMOVES_SQL}, '') AS s FROM {source}),
sized AS (SELECT {keep}, s, unnest(range({low}, least({high}, length(s)) + 1)) AS n FROM stripped),
grams AS (
  SELECT {keep}, substring(s, CAST(i AS BIGINT), CAST(n AS BIGINT)) AS seqchar
  FROM (SELECT {keep}, s, n, unnest(range(1, length(s) - n + 2)) AS i FROM sized)
)"""


def _counts(min_count: int = 6) -> str:
    return f"""counts AS (
  SELECT batch_id, seqchar, CAST(length(seqchar) AS INTEGER) AS length, CAST(count(*) AS DOUBLE) AS freq
  FROM grams GROUP BY batch_id, seqchar HAVING count(*) > {min_count}
)"""


_HELD = """ranked AS (SELECT *, (1 + freq) * length AS k FROM counts),
held AS (
  SELECT * FROM ranked l WHERE NOT EXISTS (
    SELECT 1 FROM ranked h WHERE h.batch_id = l.batch_id AND h.k > l.k AND h.seqchar <> l.seqchar AND contains(h.seqchar, l.seqchar))
)"""
_JUNK_SQL = " AND ".join(f"NOT regexp_matches(seqchar, {_quote(translate(u, java=False))})" for u in CFG.unnecessary)
_SCORE_SQL = "round(ln(1 + freq) + ln(length), 6)"
_PERIODIC_SQL = """(CASE WHEN length(seqchar) <= 2 THEN false
  WHEN length(seqchar) = 3 THEN seqchar = repeat(substring(seqchar, 1, 1), 3)
  ELSE substring(seqchar, 1, 2 * (length(seqchar) // 2)) = repeat(substring(seqchar, 1, 2), length(seqchar) // 2) END)"""


def _flag_sql(pattern: str) -> str:
    p = _quote(translate(pattern, java=False))
    return f"(regexp_matches(seqchar, {p}) AND regexp_extract(seqchar, {p}) = seqchar)"


def _label_sql(patterns: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {_flag_sql(p)} THEN {_quote(n)}" for n, p in reversed(patterns.items())) + " END"


def _selected_sql(cfg: PhraseConfig) -> str:
    positive = " OR ".join(map(_flag_sql, cfg.positive.values()))
    negative = " OR ".join(map(_flag_sql, cfg.negative.values()))
    return f"({positive}) AND length <= {cfg.max_length} AND NOT ({negative}) AND NOT {_PERIODIC_SQL}"


_FINAL = """again AS (SELECT seqchar, length, sum(freq) AS freq, (1 + sum(freq)) * length AS k FROM kept GROUP BY seqchar, length),
final AS (
  SELECT * FROM again l WHERE NOT EXISTS (
    SELECT 1 FROM again h WHERE contains(h.seqchar, l.seqchar) AND h.seqchar <> l.seqchar AND (h.k > l.k OR (h.k = l.k AND h.seqchar < l.seqchar)))
), original AS (
  SELECT l.seqchar, l.length, l.freq, l.k,
         1 - greatest(0.0, coalesce(max(1 - levenshtein(l.seqchar, h.seqchar) / ((l.length + h.length) / 2.0)), 0.0)) AS originality
  FROM final l LEFT JOIN final h ON h.k > l.k OR (h.k = l.k AND h.seqchar < l.seqchar)
  GROUP BY ALL
)"""
_PART_CHAIN = f"WITH {_sents('part', 'p_partkey', 'p_name')}, {_batched('p_partkey', 500)}, {_grams()}, {_counts()}, {_HELD}"
_CHAT_SQL = "(SELECT conv_id * 1000000 + turn AS k, text FROM conversations)"
_CHAT_CHAIN = f"WITH {_sents(_CHAT_SQL, 'k', 'text')}, {_batched('k', 500)}, {_grams()}, {_counts()}"
_ITEM_CHAIN = f"WITH {_sents('benchmark', 'item_id', 'text')}, {_batched('item_id', None)}, {_grams()}, {_counts(2)}"
_TOKENS_SQL = "tokens AS (SELECT seqchar, CAST(length(seqchar) AS INTEGER) AS length, CAST(count(*) AS DOUBLE) AS freq FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS seqchar FROM documents) WHERE seqchar <> '' GROUP BY seqchar)"


#: A corpus in which every positive pattern occurs, of few different characters.
JAPANESE_WORDS = "データ モデル ｶﾀｶﾅ 機械 学習 ＡＢＣＤ Spark NASA の です。 言語 の研究 を 東京 カメラ 速い".split()
JAPANESE_SENTENCES = 400


def _corpus_sql(sentences: int, words: list[str], words_each: int = 12, seed: int = 0) -> str:
    table = "[" + ", ".join(map(_quote, words)) + "]"
    return (
        f"SELECT doc_id, string_agg(word, '' ORDER BY k) AS text FROM (SELECT i AS doc_id, k, {table}[1 + ({sources.draw('i', 'k', seed)}) % {len(words)}] AS word"
        f" FROM range({sentences}) AS a(i), range(1, {words_each + 1}) AS b(k)) GROUP BY doc_id"
    )


_JAPANESE_CHAIN = f"WITH corpus AS ({_corpus_sql(JAPANESE_SENTENCES, JAPANESE_WORDS)}), {_sents('corpus', 'doc_id', 'text')}, {_batched('doc_id', 500)}, {_grams()}, {_counts()}"
#: The distance of DuckDB counts bytes: each character becomes one.
_LETTERS = "".join(sorted(set("".join(JAPANESE_WORDS)) - set("。")))
_BYTES = "".join(chr(48 + k) for k in range(len(_LETTERS)))
_JAPANESE_FINAL = _FINAL.replace(
    "levenshtein(l.seqchar, h.seqchar)", "levenshtein(" + ", ".join(f"translate({side}.seqchar, {_quote(_LETTERS)}, {_quote(_BYTES)})" for side in "lh") + ")"
)


# --- inputs ------------------------------------------------------------------


def _chat(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("doc_id"), "text")


def _chat_candidates(spark: SparkSession, d: str) -> DataFrame:
    m = PhraseMiner(CHAT)
    return m.candidates(m.sentences(_chat(spark, d)))


def _item_candidates(spark: SparkSession, d: str) -> DataFrame:
    m = PhraseMiner(ITEMS)
    return m.candidates(m.sentences(_read(spark, d, "benchmark"), "item_id"))


def _japanese(spark: SparkSession) -> DataFrame:
    return sources.random_corpus(spark, JAPANESE_SENTENCES, words=JAPANESE_WORDS)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct white-space-separated token of documents, as a phrase."""
    words = _read(spark, d, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("seqchar")).filter("seqchar <> ''")
    return words.groupBy("seqchar").agg(F.count(F.lit(1)).cast("double").alias("freq")).select("seqchar", F.length("seqchar").alias("length"), "freq")


# --- generators --------------------------------------------------------------


@_query(f"WITH {_sents('documents', 'doc_id', 'text')} SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM sents")
def sentence_split(spark, d):
    return sentences.split_sentences(_read(spark, d, "documents"))


@_query(f"WITH {_sents('documents', 'doc_id', 'text')}, {_batched('doc_id', 5000)} SELECT batch_id, count(*) AS sentences, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM batched GROUP BY batch_id")
def sentence_batches(spark, d):
    batched = PhraseMiner(CFG).sentences(_read(spark, d, "documents"))
    return batched.groupBy("batch_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence")).alias("chars"))


@_query(f"WITH {_sents('documents', 'doc_id', 'text')} SELECT doc_id, CAST(pos AS INTEGER) AS pos, translate(sentence, {_REMOVES_SQL}, '') AS sentence FROM sents")
def strip_noise(spark, d):
    return ngrams.strip_noise(sentences.split_sentences(_read(spark, d, "documents")), CFG.removes)


@_query(f"WITH {_sents('benchmark', 'item_id', 'text')}, {_grams('sents', 'item_id')} SELECT item_id, seqchar FROM grams")
def char_ngrams(spark, d):
    stripped = ngrams.strip_noise(sentences.split_sentences(_read(spark, d, "benchmark"), "item_id"), CFG.removes)
    return ngrams.char_ngrams(stripped, CFG.min_length, CFG.longest, "item_id")


@_query(f"{_CHAT_CHAIN} SELECT * FROM counts")
def ngram_counts(spark, d):
    return _chat_candidates(spark, d)


@_query()
def ngram_counts_documents(spark, d):
    m = PhraseMiner(CFG)
    return m.candidates(m.sentences(_read(spark, d, "documents")))


@_query(
    f"WITH {_sents('documents', 'doc_id', 'text')} SELECT * FROM (VALUES {', '.join(f'({_quote(k)}, {len(k)})' for k in KNOWNS)}) AS t(seqchar, length)"
    f" JOIN LATERAL (SELECT CAST(coalesce(sum((length(sentence) - length(replace(sentence, t.seqchar, ''))) // t.length), 0) AS DOUBLE) AS freq FROM sents) ON true"
)
def known_term_counts(spark, d):
    return knowns.count_knowns(sentences.split_sentences(_read(spark, d, "documents")), KNOWNS)


@_query(
    f"{_CHAT_CHAIN} SELECT batch_id, seqchar, length, freq, seqchar IN ({', '.join(map(_quote, KNOWNS))}) AS knowns FROM ("
    f"SELECT batch_id, t.seqchar, t.length, CAST(sum((length(sentence) - length(replace(sentence, t.seqchar, ''))) // t.length) AS DOUBLE) AS freq"
    f" FROM batched CROSS JOIN (VALUES {', '.join(f'({_quote(k)}, {len(k)})' for k in KNOWNS)}) AS t(seqchar, length) GROUP BY ALL"
    f" UNION ALL SELECT * FROM counts)"
)
def union_known_ngram(spark, d):
    m = PhraseMiner(CHAT, knowns=KNOWNS)
    return m.candidates(m.sentences(_chat(spark, d))).withColumn("knowns", knowns.is_known(F.col("seqchar"), KNOWNS))


# --- scores and ranks --------------------------------------------------------


@_query(f"{_CHAT_CHAIN} SELECT batch_id, seqchar, {_SCORE_SQL} AS sc_index FROM counts")
def phrase_score(spark, d):
    return _q6(containment.add_rank(_chat_candidates(spark, d), CHAT), "sc_index").select("batch_id", "seqchar", "sc_index")


@_query(f"{_CHAT_CHAIN} SELECT batch_id, seqchar, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY (1 + freq) * length DESC, seqchar) AS INTEGER) AS rank FROM counts")
def phrase_rank(spark, d):
    order = Window.partitionBy("batch_id").orderBy(F.desc("_key"), F.asc("seqchar"))
    return containment.add_rank(_chat_candidates(spark, d), CHAT).select("batch_id", "seqchar", F.row_number().over(order).alias("rank"))


@_query(f"{_CHAT_CHAIN} SELECT batch_id, seqchar, length, freq, {_SCORE_SQL} AS sc_index FROM counts ORDER BY (1 + freq) * length DESC, seqchar, batch_id LIMIT 100")
def top_phrases(spark, d):
    """A top-k report."""
    ranked = containment.add_rank(_chat_candidates(spark, d), CHAT).orderBy(F.desc("_key"), "seqchar", "batch_id").limit(100)
    return _q6(ranked, "sc_index").select("batch_id", "seqchar", "length", "freq", "sc_index")


# --- containment, filters ----------------------------------------------------


@_query(f"{_ITEM_CHAIN}, {_HELD} SELECT batch_id, seqchar, length, freq FROM held")
def containment_antijoin(spark, d):
    return containment.drop_contained_batch(_item_candidates(spark, d), ITEMS, "batch_id").select("batch_id", "seqchar", "length", "freq")


@_query(f"WITH {_TOKENS_SQL} SELECT seqchar, length, freq FROM tokens WHERE {_JUNK_SQL}")
def exclude_unnecessary(spark, d):
    return selection.exclude_unnecessary(_tokens(spark, d), CFG.unnecessary)


@_query(f"WITH {_TOKENS_SQL} SELECT seqchar, {', '.join(f'{_flag_sql(p)} AS {n}' for n, p in zip(selection.column_names(positive_patterns()), positive_patterns().values(), strict=True))} FROM tokens")
def positive_flags(spark, d):
    return _tokens(spark, d).select("seqchar", *selection.flag_columns(F.col("seqchar"), positive_patterns()))


@_query(f"WITH {_TOKENS_SQL} SELECT seqchar, {', '.join(f'{_flag_sql(p)} AS {n}' for n, p in negative_patterns().items())} FROM tokens")
def negative_flags(spark, d):
    return _tokens(spark, d).select("seqchar", *selection.flag_columns(F.col("seqchar"), negative_patterns()))


@_query(f"WITH {_TOKENS_SQL} SELECT seqchar, {_label_sql(positive_patterns())} AS match_ptn, {_label_sql(negative_patterns())} AS negative_ptn FROM tokens")
def pattern_label(spark, d):
    s = F.col("seqchar")
    labels = {
        name: X.last_label([(n, X.full_match(s, p)) for n, p in patterns.items()])
        for name, patterns in (("match_ptn", positive_patterns()), ("negative_ptn", negative_patterns()))
    }
    return _tokens(spark, d).select(s, *[c.alias(n) for n, c in labels.items()])


_EXTRACT = {"word": "[a-zA-Z]{2,}", **{k: v for k, v in negative_patterns().items() if k in ("x_mail", "x_Num", "x_Tel")}}


@_query(
    f"WITH {_TOKENS_SQL} SELECT seqchar, "
    + ", ".join(f"CASE WHEN regexp_matches(seqchar, {_quote(translate(p, java=False))}) THEN regexp_extract(seqchar, {_quote(translate(p, java=False))}) END AS {n}" for n, p in _EXTRACT.items())
    + " FROM tokens"
)
def pattern_extract(spark, d):
    return _tokens(spark, d).select("seqchar", *selection.match_columns(F.col("seqchar"), _EXTRACT))


@_query(f"WITH {_TOKENS_SQL} SELECT seqchar, {_PERIODIC_SQL} AS periodic FROM tokens")
def periodic_flag(spark, d):
    return _tokens(spark, d).select("seqchar", X.is_periodic(F.col("seqchar")).alias("periodic"))


@_query(f"WITH {_TOKENS_SQL} SELECT seqchar, length, freq, {_label_sql(CFG.positive)} AS match_ptn FROM tokens WHERE {_selected_sql(CFG)}")
def select_phrase(spark, d):
    return selection.select_phrases(_tokens(spark, d), CFG).select("seqchar", "length", "freq", "match_ptn")


# --- batches, similarity, whole plans ----------------------------------------


@_query(f"{_CHAT_CHAIN} SELECT seqchar, length, sum(freq) AS freq FROM counts GROUP BY seqchar, length")
def cross_batch_regroup(spark, d):
    return regroup.regroup(_chat_candidates(spark, d))


@_query(
    "WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance,"
    " round(1 - levenshtein(a.p_name, b.p_name) / ((length(a.p_name) + length(b.p_name)) / 2.0), 6) AS similarity FROM n a, n b WHERE a.p_name < b.p_name"
)
def pairwise_similarity(spark, d):
    names = _read(spark, d, "part").select("p_name").distinct()
    pairs = names.select(F.col("p_name").alias("a")).join(names.select(F.col("p_name").alias("b")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.levenshtein("a", "b").alias("distance"), F.round(X.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@_query(
    "WITH again AS (SELECT p_name AS seqchar, CAST(length(p_name) AS INTEGER) AS length, CAST(count(*) AS DOUBLE) AS freq, (1.0 + count(*)) * length(p_name) AS k FROM part GROUP BY p_name),"
    " final AS (SELECT * FROM again), " + _FINAL[_FINAL.index("original AS") :] + " SELECT seqchar, length, freq, round(originality, 6) AS originality FROM original WHERE originality > 0.3"
)
def originality_filter(spark, d):
    names = _read(spark, d, "part").groupBy(F.col("p_name").alias("seqchar")).agg(F.count(F.lit(1)).cast("double").alias("freq"))
    ranked = containment.add_rank(names.withColumn("length", F.length("seqchar")), PART)
    return _q6(similarity.remove_similar(ranked, 0.3), "originality").select("seqchar", "length", "freq", "originality")


@_query(f"{_ITEM_CHAIN}, {_HELD} SELECT seqchar, length, freq, {_SCORE_SQL} AS sc_index, false AS knowns FROM held WHERE {_JUNK_SQL}")
def find_uniques(spark, d):
    pieces = sentences.split_sentences(_read(spark, d, "benchmark"), "item_id")
    return _q6(PhraseMiner(ITEMS).find_uniques(pieces), "sc_index")


@_query(
    f"{_PART_CHAIN}, kept AS (SELECT * FROM held WHERE {_JUNK_SQL}), {_FINAL} SELECT seqchar, length, freq, {_SCORE_SQL} AS sc_index, false AS knowns, round(originality, 6) AS originality FROM original WHERE originality > 0.5"
)
def get_dfphrase_noselect(spark, d):
    return _q6(PhraseMiner(PART).transform(_read(spark, d, "part"), "p_partkey", "p_name"), "sc_index", "originality")


@_query(
    f"{_PART_CHAIN}, kept AS (SELECT * FROM held WHERE {_JUNK_SQL} AND {_selected_sql(PART_SELECT)}), {_FINAL} SELECT seqchar, length, freq, {_SCORE_SQL} AS sc_index, false AS knowns,"
    f" {_label_sql(PART_SELECT.positive)} AS match_ptn, round(originality, 6) AS originality, {_PERIODIC_SQL} AS periodic FROM original WHERE originality > 0.5 AND {_selected_sql(PART_SELECT)}"
)
def get_dfphrase(spark, d):
    phrases = PhraseMiner(PART_SELECT).transform(_read(spark, d, "part"), "p_partkey", "p_name")
    return _q6(phrases, "sc_index", "originality").select("seqchar", "length", "freq", "sc_index", "knowns", "match_ptn", "originality", "periodic")


@_query()
def get_dfphrase_documents(spark, d):
    """The default plan over all documents, all columns."""
    return PhraseMiner(CFG).transform(_read(spark, d, "documents"))


@_query(
    " UNION ALL ".join(f"SELECT p_partkey, {k} AS col, {c} AS text FROM part" for k, c in enumerate(("p_name", "p_brand", "p_type")))
)
def multi_column_flatten(spark, d):
    return sources.flatten_columns(_read(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type"])


@_query(_corpus_sql(50, sources.WORDS))
def random_corpus(spark, d):
    return sources.random_corpus(spark)


@_query(f"{_JAPANESE_CHAIN} SELECT batch_id, seqchar, {', '.join(f'{_flag_sql(p)} AS {n}' for n, p in zip(selection.column_names(positive_patterns()), positive_patterns().values(), strict=True))} FROM counts")
def positive_flags_japanese(spark, d):
    """Flags of every n-gram of a Japanese corpus; each is true somewhere."""
    m = PhraseMiner(JAPANESE)
    return m.candidates(m.sentences(_japanese(spark))).select("batch_id", "seqchar", *selection.flag_columns(F.col("seqchar"), positive_patterns()))


@_query(
    f"{_JAPANESE_CHAIN}, {_HELD}, kept AS (SELECT * FROM held WHERE {_JUNK_SQL} AND {_selected_sql(JAPANESE)}), {_JAPANESE_FINAL} SELECT seqchar, length, freq, {_SCORE_SQL} AS sc_index,"
    f" {_label_sql(JAPANESE.positive)} AS match_ptn, round(originality, 6) AS originality FROM original WHERE originality > 0.5 AND {_selected_sql(JAPANESE)}"
)
def get_dfphrase_japanese(spark, d):
    """The default plan over a Japanese corpus."""
    phrases = PhraseMiner(JAPANESE).transform(_japanese(spark))
    return _q6(phrases, "sc_index", "originality").select("seqchar", "length", "freq", "sc_index", "match_ptn", "originality")


@_query(
    f"{_PART_CHAIN}, kept AS (SELECT * FROM held WHERE {_JUNK_SQL}) SELECT seqchar, length, sum(freq) AS freq, round(avg(ln(1 + freq) + ln(length)), 6) AS sc_index, false AS knowns"
    " FROM kept GROUP BY seqchar, length ORDER BY round(avg(ln(1 + freq) + ln(length)), 9) DESC, seqchar LIMIT 5"
)
def batch_progress_top5(spark, d):
    """A top-k report."""
    m = PhraseMiner(PART)
    kept = m.batch_phrases(m.sentences(_read(spark, d, "part"), "p_partkey", "p_name"))
    grouped = kept.groupBy("seqchar", "length").agg(F.sum("freq").alias("freq"), F.avg("sc_index").alias("sc_index"), F.max("knowns").alias("knowns"))
    return _q6(grouped.orderBy(F.desc("knowns"), F.desc(F.round("sc_index", 9)), "seqchar").limit(5), "sc_index")
