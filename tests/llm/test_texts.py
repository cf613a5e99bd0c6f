"""Encoding, leaks and abuse."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodewell.llm import abuse, bpe, leaks

needs = pytest.mark.skipif(not os.path.exists(bpe.vocabulary_path()), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    e = bpe.encoder(bpe.vocabulary_path())
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=e.ranks, special_tokens={})


@needs
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300))
def test_encoding_equals_the_library(reference, text):
    e = bpe.encoder(bpe.vocabulary_path())
    ids = e.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert e.decode(ids) == text.encode("utf-8", "replace").decode("utf-8")


@needs
def test_encode_documents(spark, reference):
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000))
    texts = [None, "", "hello  world\r\n\t<|endoftext|> naïve 日本語 😀 don't", long, "x" * 5000]
    df = spark.createDataFrame([(i, t, "ids", "k") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, k string")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_documents(df).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert bpe.encode_documents(df.filter("false")).count() == 0


ITEMS = [(1, "the quick brown fox jumps over the lazy dog while seven grey owls watch from the old oak tree near the river bank at night"), (2, "entirely different passage about steel bridges and the people who painted them green during one very long and rainy autumn in the north"), (3, None), (4, "too short")]


@pytest.mark.parametrize(
    "text, found",
    [
        (ITEMS[0][1].upper().replace(" ", ",  \n# "), [1]),
        ("x = '" + "\\n".join(ITEMS[0][1].split()[4:16]) + "'", [1]),
        (" ".join(w if i % 7 else "ALTERED" for i, w in enumerate(ITEMS[1][1].split())), [2]),
        (" ".join(ITEMS[0][1].split()[:8]), []),
        (" ".join(sorted(ITEMS[0][1].split())), []),
        (" ".join(ITEMS[0][1].split()[:7]) + " and then something else came between " + " ".join(ITEMS[0][1].split()[12:20]), [1]),
        (ITEMS[0][1] + " " + ITEMS[1][1], [1, 2]),
        (None, []), ("", []),
    ],
)
def test_leaks(spark, text, found):
    docs = spark.createDataFrame([(5, text, "k")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id bigint, text string")
    assert sorted(r["item_id"] for r in leaks.leaked(docs, items).collect()) == found


def test_leaks_shuffled_and_empty(spark, monkeypatch):
    docs = spark.createDataFrame([(5, ITEMS[0][1]), (6, ITEMS[1][1]), (6, ITEMS[1][1]), (7, None), (8, "")], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for sent in (leaks.SENT, 0):  # the item side broadcast, and both sides shuffled
        monkeypatch.setattr(leaks, "SENT", sent)
        assert sorted((r["doc_id"], r["item_id"]) for r in leaks.leaked(docs, items).collect()) == [(5, 1), (6, 2), (6, 2)]
    assert leaks.leaked(docs, items.filter("false")).count() == 0 and leaks.leaked(docs.filter("false"), items).count() == 0


def test_short_items_are_found_whole(spark):
    items = spark.createDataFrame([(1, "seven"), (2, "steel bridges rust"), (3, "grey owls watch from oak")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "Steel bridges, rust! " + "x " * 40), (2, "steel bridges never rust"), (3, "a " * 9 + "grey owls watch from oak"), (4, "grey owls watch from"), (5, "at seven")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks.leaked(docs, items).collect()) == [(1, 2), (3, 3), (5, 1)]


def test_many_items_take_one_pass(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(r.choices(vocabulary, k=50))) for i in range(20_000)]  # 1,000,000 words
    docs = spark.createDataFrame([(i, "head of text " + " ".join(rows[i * 37][1].split()[5:35]) + " tail") for i in range(100)], "doc_id bigint, text string")
    got = leaks.leaked(docs, spark.createDataFrame(rows, "item_id bigint, text string"))
    assert sorted((x["doc_id"], x["item_id"]) for x in got.collect()) == [(i, i * 37) for i in range(100)]


def test_winnowing_keeps_every_shared_span():
    r = np.random.default_rng(0)
    for _ in range(60):
        span = r.integers(0, 50, leaks.LEAST).astype(np.uint64)
        a, b = (np.concatenate([r.integers(0, 50, r.integers(0, 30)).astype(np.uint64), span, r.integers(0, 50, r.integers(0, 30)).astype(np.uint64)]) for _ in range(2))
        ha, hb = leaks.grams(a), leaks.grams(b)
        assert set(ha[leaks.winnow(ha)]) & set(hb[leaks.winnow(hb)])


ABUSIVE = ["you are an idiot, get lost", "Y O U  m o r o n, shut up", "du bist ein V0ll1d107", "I know where you live, watch your back", "send me your nudes", "b*stard, nobody likes you", "ERES UN IMBÉСIL", "their kind is subhumаn", "what a worthlesssss piece of garbaaaage you are"]
CLEAN = ["kill the child process when the worker hangs", "this is a dumb terminal", "garbage collection of the cache kills idle threads", "the master was renamed to primary and the slave to replica", "def f(x):\n    return x", "the idiot-proof switch saved us", "report abuse with the form, insults are not allowed here"]


def test_prior_without_labels():
    m = abuse.Model(np.empty((0, len(abuse.NAMES))), np.empty(0), np.empty(0))
    s = m.score(np.stack([abuse.features(t) for t in ABUSIVE + CLEAN]))
    assert (s[: len(ABUSIVE)] >= 0.5).mean() >= 0.7 and (s[len(ABUSIVE) :] < 0.5).all()
    assert abuse.features(None).any() == abuse.features("").any() == False  # noqa: E712
    assert abuse.features("SHOUTING WORDS!!!").any()  # dense features need no lexicon


def test_words_are_learned_from_labels(spark):
    r = random.Random(2)
    plain = lambda: " ".join(r.choices([f"noun{i}" for i in range(80)], k=30))
    insult = lambda: f"{plain()}.\nyou absolute snorfblat, take your wibble elsewhere\n{plain()}"
    rows = [(i, insult() if i % 4 == 0 else plain()) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "insult" if i % 4 == 0 else "clean") for i in range(300)], "doc_id bigint, label string")
    model = abuse.train(docs, labels)
    assert "snorfblat" in model.learned and "snorfblat" not in abuse.lexicon().entries
    got = {x["doc_id"]: x for x in abuse.abuse_scores(docs, model).filter("doc_id >= 300").collect()}
    assert sum((x["score"] >= 0.5) == (i % 4 == 0) for i, x in got.items()) >= 0.98 * len(got) and got[300]["kind"] == "insult"
    assert (lambda x: x["kind"] and x["score"] >= 0.5)(abuse.abuse_scores(spark.createDataFrame([(1, "what a SN0RFBLAT you are, take your w i b b l e")], "doc_id int, text string"), model).first())


def test_scores_are_drawn_to_the_corpus(spark):
    r = np.random.default_rng(1)
    y = r.random(20_000) < 0.03  # 3 % of the corpus against 30 % of the labels
    z = r.normal(np.where(y, 1.5, -1.5), 1.0)
    p = 1 / (1 + np.exp(-(3 * z + np.log(0.3 / 0.7))))
    out, share = abuse.for_corpus(spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "k int, score double"), 0.3)
    assert abs(share - 0.03) < 0.006 and out.agg({"score": "avg"}).first()[0] < 0.04
    assert abuse.for_corpus(out.filter("false"), 0.3)[0].count() == 0


def test_models_are_saved(spark, tmp_path):
    m = abuse.Model(np.empty((0, len(abuse.NAMES))), np.empty(0), np.empty(0), learned={"x y": ((1.0,) * (abuse.FOLDS + 1), 0)})
    abuse.save(m, spark, str(tmp_path / "m"))
    assert abuse.load(spark, str(tmp_path / "m")).learned == m.learned


def test_trees_and_calibration():
    r = np.random.default_rng(0)
    x = r.standard_normal((400, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = abuse.Boosted().fit(x[:300], y[:300], np.ones(300))
    assert ((m.raw(x[300:]) > 0) == y[300:]).mean() > 0.9
    at, p = abuse.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 0, 1.0]), np.ones(6))
    assert (np.diff(p) >= 0).all() and p[0] == 0 and p[-1] == 1


def test_abuse_scores(spark):
    rows = [(i, t, "x") for i, t in enumerate((ABUSIVE + CLEAN) * 6)] + [(900, None, "x"), (901, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = [(i, "insult" if i % len(ABUSIVE + CLEAN) < len(ABUSIVE) else "clean") for i, *_ in rows[:-30]] + [(3, None), (4, "unsure"), (5, "clean"), (99999, "clean")]
    model = abuse.train(docs, spark.createDataFrame(labels, "doc_id bigint, label string"))
    got = {r["doc_id"]: (r["score"], r["kind"]) for r in abuse.abuse_scores(docs, model).collect()}
    n = len(ABUSIVE + CLEAN)
    hit = [got[i][0] >= 0.5 for i in range(6 * n)]
    assert sum(h == (i % n < len(ABUSIVE)) for i, h in enumerate(hit)) / len(hit) >= 0.9
    assert got[900][0] < 0.5 and got[901] == (got[900][0], None)
    assert abuse.abuse_scores(docs.filter("false"), model).count() == 0
    assert abuse.train(docs, spark.createDataFrame([], "doc_id bigint, label string")).trees is None
