import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in ("ther", "ing", "est", "oun", "arb", "tion", "wel", "mor") for b in ("a", "ent", "ly", "ous", "ist", "", "er", "ed")]


@pytest.fixture(scope="session")
def words():
    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.choice(["", "s", "x", "ka"])) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows, extra: str = ""):
        """Rows of (doc_id, text[, source]); extra columns with clashing names."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.selectExpr("*", *extra.split(";")) if extra else df

    return make


#: Names that operators use inside, or return.
CLASH = "1 as `_gf_id`;'x' as `_gf_text`;2 as score;3 as `window`;4 as copies;'y' as digest;5 as keep_doc_id;6 as `a.b`"


@pytest.fixture(scope="session")
def clash():
    return CLASH
