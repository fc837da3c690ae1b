import re
from collections import Counter, defaultdict

import pytest

from gramforge.llm import lines as op

SCHEMA = "page_id bigint, url string, html string"


def brute(rows):
    pages, seen, parsed = Counter(), defaultdict(Counter), []
    for i, url, html in rows:
        m = re.match(op._HOST, url or "")
        h = (m.group(1) if m else "").lower()
        plain = re.sub(op._TAG, "", re.sub(op._BREAK, "\n", re.sub(op._HIDDEN, "", html or "")))
        own = [x.strip(op.SPACES) for x in plain.split("\n") if x.strip(op.SPACES)]
        pages[h] += 1
        for x in set(own):
            seen[h][x] += 1
        parsed.append((i, h, own))
    out = []
    for i, h, own in parsed:
        kept = [x for x in own if pages[h] < op.MIN_PAGES or seen[h][x] <= op.RATIO * pages[h]]
        out.append((i, h, "\n".join(kept), len(own) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as `_gf_id`", "2 as host", "'q' as text", "3 as `_gf_lines`", "4 as `a.b`")
    return sorted((tuple(r) for r in op.drop_boilerplate(df).collect()), key=str)


def page(*blocks):
    return "<html><head><style>p{}</style></head><body>" + "".join(f"<p> {b} </p>" for b in blocks) + "</body></html>"


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_against_brute_force(spark, words, monkeypatch, most):
    monkeypatch.setattr(op, "BROADCAST_HOSTS", most)
    monkeypatch.setattr(op, "BROADCAST_KEYS", most)
    rows = []
    for h in range(5):
        for k in range(3 + 2 * h):
            blocks = ["Menu <b>home</b>", words(h * 100 + k, 6), "Footer" if k % 2 else words(k, 3), words(h, 4)]
            rows.append((h * 100 + k, f"https://Host{h}.example:80/{k}", page(*blocks)))
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(r[3] for r in got) > 20


def test_ties_small_hosts_and_repeats_within_a_page(spark):
    both = [(i, "http://two.pages/x", page("foot\t", f"own {i}") if i else page("\u00a0 foot", "other")) for i in range(2)]
    assert [r[3] for r in run(spark, both)] == [1, 1]
    half = [(i, "http://a.b/x", page("same" if i < 2 else f"own {i}")) for i in range(4)]
    assert all(r[3] == 0 for r in run(spark, half))  # exactly RATIO is kept
    more = [(i, "http://a.b/x", page("same", "same") if i < 3 else page("x")) for i in range(4)]
    assert [r[3] for r in run(spark, more)] == [2, 2, 2, 0]
    assert all(r[3] == 0 for r in run(spark, [(i, "http://a.b", page("same")) for i in range(op.MIN_PAGES - 1)]))


def test_nulls_and_long_pages(spark):
    rows = [(1, None, page("m", "a")), (2, "no host", page("m", "b")), (3, None, None), (None, "", ""), (4, "", page("m", "c" * 300_000)), (5, None, page("m"))]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {r[0]: r[3] for r in got} == {1: 1, 2: 1, 3: 0, None: 0, 4: 1, 5: 1}


def test_empty(spark):
    assert run(spark, []) == []
