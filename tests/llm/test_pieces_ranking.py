import math
import os
import random
import unicodedata
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodewell.llm import bpe
from lodewell.llm import pieces as P
from lodewell.llm import ranking as R


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\t{}é😀", max_size=900), st.integers(-1, 40), st.one_of(st.none(), st.integers(-5, 60), st.just(float("nan"))))
def test_pieces_cover_the_text(text, target, overlap):
    parts = P.cut(text, target, overlap)
    t = max(target, 1)
    share = P.usable_overlap(overlap, t) * P.CHARS
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(P.tokens(b - a) <= t for a, b in parts)
    for (a, b), (c, d) in zip(parts, parts[1:]):
        assert c == b - share and d > b and c > a


def test_cuts_stand_at_natural_places():
    code = "\n\n".join(f"def f{i}():\n    x = {i}\n    return x" for i in range(40))
    assert all(code[b - 1] == "\n" for _, b in P.cut(code, 50, 0)[:-1])
    prose = " ".join("One sentence stands here." for _ in range(60))
    assert all(prose[a:b].rstrip().endswith(".") for a, b in P.cut(prose, 40, 0)[:-1])
    assert P.cut("x" * 1000, 100, 20)[:2] == [(0, 400), (320, 720)]


def test_overlap_is_kept_up_to_the_target():
    text = "".join(f"word{i} " for i in range(300))
    for overlap in (1, 40, 63, 64, 900):
        parts = P.cut(text, 64, overlap)
        assert all(c == b - 4 * min(overlap, 63) for (_, b), (c, _) in zip(parts, parts[1:])) and all(b - a <= 256 for a, b in parts)
    marks = "x" + "e\u0301" * 300
    assert all(not unicodedata.combining(marks[b]) for _, b in P.cut(marks, 20, 0)[:-1])
    assert all(b % 2 == 0 for _, b in P.cut("\r\n" * 300, 21, 0)[:-1])


@pytest.mark.skipif(not os.path.exists(bpe.vocabulary_path()), reason="no vocabulary")
@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n\t{}é😀表", max_size=600), st.integers(1, 40), st.integers(0, 50))
def test_pieces_by_a_vocabulary(text, target, overlap):
    make = P.by_vocabulary()
    sums = make(text)
    e = bpe.encoder(bpe.vocabulary_path())
    assert sums.count(0, len(text)) == len(e.encode(text)) or any(ord(c) > 127 for c in text)
    parts = P.cut(text, target, overlap, make)
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(sums.count(a, b) <= target or b - a <= 2 for a, b in parts)
    assert all(a < c <= b < d for (a, b), (c, d) in zip(parts, parts[1:]))


def test_split_by_a_vocabulary(spark):
    if not os.path.exists(bpe.vocabulary_path()):
        pytest.skip("no vocabulary")
    items = spark.createDataFrame([(1, 7, "word " * 100), (2, 7, "short")], "id int, doc int, body string")
    limits = spark.createDataFrame([(7, 50, 5)], "doc int, t int, o int")
    rows = P.split_oversized(items, limits, "id", "body", "doc", "doc", "t", "o", make=P.by_vocabulary()).orderBy("piece").collect()
    assert len(rows) == rows[0]["n_pieces"] == 3 and {r["id"] for r in rows} == {1} and all(r["tokens"] <= 50 for r in rows)
    assert len(rows[0]["content"]) - rows[1]["start"] in range(20, 27)  # five words are shared


def test_split_oversized(spark):
    items = spark.createDataFrame([(1, 7, "h", "word " * 100, "c"), (1, 7, "h", "word " * 100, "c"), (2, 7, None, "short", "c"), (3, 8, "h", None, "c"), (4, 9, "h", "y" * 400, "c"), (5, None, "h", "z" * 400, "c")], "id int, doc int, head string, body string, content string")
    limits = spark.createDataFrame([(7, 50, 5), (7, 50, 5), (8, 10, None), (None, 1, 1), (9, 100, -3)], "doc int, t int, o int")
    out = P.split_oversized(items, limits, "id", "body", "doc", "doc", "t", "o", "head")
    rows = out.orderBy("id", "piece").collect()
    assert {r["id"] for r in rows} == {1} and len(rows) == rows[0]["n_pieces"] == 3 and all(r["heading"] == "h" and r["tokens"] <= 50 for r in rows)
    assert P.split_oversized(items.filter("false"), limits, "id", "body", "doc", "doc", "t", "o").count() == 0
    assert P.split_oversized(items, limits.filter("false"), "id", "body", "doc", "doc", "t", "o").count() == 0


def brute(rows, missing, weights):
    lists = defaultdict(dict)
    for q, name, item, s in rows:
        if s is not None and not math.isnan(s) and item is not None:
            lists[q, name][item] = max(s, lists[q, name].get(item, -math.inf))
    pts, names = defaultdict(float), defaultdict(set)
    for (q, name), scores in lists.items():
        names[q].add(name)
    for (q, name), scores in lists.items():
        n, w = len(scores), weights.get(name, 1.0)
        for i, s in scores.items():
            above, same = sum(x > s for x in scores.values()), sum(x == s for x in scores.values())
            pts[q, i] += w * (n - (above + (same + 1) / 2) + 1) / n
    if missing == "mid":
        for q, i in list(pts):
            for name in names[q]:
                if i not in lists[q, name]:
                    pts[q, i] += weights.get(name, 1.0) * (len(lists[q, name]) + 1) / (2 * len(lists[q, name]))
    return pts


@pytest.mark.parametrize("missing", ["none", "mid"])
def test_borda_equals_brute_force(spark, missing):
    r = random.Random(2)
    rows = [(r.choice([1, 2, None]), r.choice(["a", "b", "c", None]), r.randint(0, 60), r.choice([None, math.nan, r.gauss(0, 1000), float(r.randint(0, 5))])) for _ in range(900)]
    rows += rows[:50] + [(3, "a", i, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "query_id int, list_name string, chunk_id int, score double")
    w = {"a": 2.0}
    got = {(x["query_id"], x["chunk_id"]): x["points"] for x in R.borda(df, weights=w, missing=missing).collect()}
    want = brute(rows, missing, w)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    top = R.borda(df, k=2).filter("query_id = 3").orderBy("position").collect()
    assert [x["chunk_id"] for x in top] == [0, 1]
    assert R.borda(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        R.borda(df, missing="x")
