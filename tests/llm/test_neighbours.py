import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewell.llm import neighbours as N

KIND = "embedding_id bigint, chunk_id bigint, provider string, model string, dimensions int, embedding array<float>, created_at int, k string, id int"
GROUPS = ["provider", "model", "dimensions"]


def brute(ids, x, k, floor):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for i in range(len(x)):
        c = np.round(x @ x[i], 9)
        order = sorted((j for j in range(len(x)) if j != i and c[j] >= floor), key=lambda j: (-c[j], ids[j]))[:k]
        out |= {(ids[i], ids[j]) for j in order}
    return out


def frame(spark, ids, x, model="m"):
    return spark.createDataFrame([(int(i), int(i), "p", model, x.shape[1], [float(v) for v in r], 1, "k", 0) for i, r in zip(ids, x)], KIND)


def clusters(n, d=32, seed=0):
    r = np.random.default_rng(seed)
    c = r.standard_normal((n // 6 + 1, d))
    return (c[np.arange(n) % len(c)] + 0.15 * r.standard_normal((n, d))).astype(np.float32)


def pairs(df):
    return {(r[0], r[1]) for r in df.select("embedding_id_a", "embedding_id_b").collect()}


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_SIZE", 60)
    x = clusters(900)
    x[500:520] *= 7.5  # norms do not matter
    ids = np.random.default_rng(1).permutation(900) + 10
    for floor in (0.9, 0.8):
        want = brute(ids, x.astype(float), 5, floor)
        got = pairs(N.similar_vectors(frame(spark, ids, x), GROUPS, k=5, floor=floor))
        assert len(want & got) / len(want) >= 0.95 and len(got - want) <= 0.05 * len(want)


def test_without_floor_in_one_list_is_exact(spark):
    x, ids = clusters(150, seed=3), np.arange(150)
    want, got = brute(ids, x.astype(float), 4, -1.0), pairs(N.similar_vectors(frame(spark, ids, x), GROUPS, k=4))
    assert len(want & got) / len(want) >= 0.98


def test_copies_and_hot_groups(spark, monkeypatch):
    x = clusters(60, seed=5)
    x[20:50] = x[20]
    ids = np.arange(60)
    want = brute(ids, x.astype(float), 3, 0.9)
    assert pairs(N.similar_vectors(frame(spark, ids, x), GROUPS, k=3, floor=0.9)) == want
    monkeypatch.setattr(N, "HOT", 5)
    monkeypatch.setattr(N, "LIST_SIZE", 20)
    assert pairs(N.similar_vectors(frame(spark, ids, x), GROUPS, k=3, floor=0.9)) == want


def test_groups_do_not_mix_and_empty(spark):
    x = clusters(20, seed=7)
    df = frame(spark, np.arange(20), x).unionByName(frame(spark, np.arange(20) + 100, x, "other"))
    assert all((a < 100) == (b < 100) for a, b in pairs(N.similar_vectors(df, GROUPS, k=3)))
    assert N.similar_vectors(df.filter("false"), GROUPS, k=3).count() == 0
    assert N.similar_vectors(df.filter("embedding_id = 1"), GROUPS, k=3).count() == 0


def test_latest_usable(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, "p", "m", 2, [1.0, 0.0], 1), (2, 1, "p", "m", 2, None, 2), (3, 2, "p", "m", 2, [1.0, 0.0], 1), (3, 2, "p", "m", 2, [1.0, 0.0], 1), (4, 3, "p", "m", 2, [1.0], 1), (5, 4, "p", "m", 2, [0.0, 0.0], 1),
        (6, 5, "p", "m", 2, [nan, 1.0], 1), (7, 6, "p", "m", 2, [inf, 1.0], 1), (8, 7, None, None, 2, [0.0, 2.0], None), (9, 8, "p", "m", None, [0.0, 2.0], 1), (10, 9, "p", "m", 2, [None, 2.0], 1)]
    df = spark.createDataFrame(rows, KIND.rsplit(", k", 1)[0])
    assert sorted(r["embedding_id"] for r in N.latest_usable(df).collect()) == [3, 8]


@pytest.mark.parametrize("d", [8, 64, 100])
def test_rotation_keeps_products(d):
    r = N.rotation(d)
    assert np.allclose(r @ r.T, np.eye(d), atol=1e-5)
    assert F is not None


def test_some_rows_ask(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_SIZE", 40)
    x, ids = clusters(600, d=16, seed=9), np.arange(600)
    x[100:110] = x[100]
    df = frame(spark, ids, x)
    every = pairs(N.similar_vectors(df, GROUPS, k=5, copies=4))
    got = pairs(N.similar_vectors(df, GROUPS, k=5, copies=4, wanted=F.col("embedding_id") % 10 == 0))
    assert got == {p for p in every if p[0] % 10 == 0}  # whoever asks, the lists are the same
    want = {p for p in brute(ids, x.astype(float), 5, -1.0)}
    assert len(every & want) / len(want) >= 0.9


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    x, ids = clusters(700, d=16, seed=11), np.arange(700) * 3
    x[::7] = x[0]  # copies lie in several blocks
    monkeypatch.setattr(N, "LIST_SIZE", 200)
    monkeypatch.setattr(N, "MOST_LISTS", 1)
    monkeypatch.setattr(N, "ENTRIES", 300)
    assert (N.fit(x / np.linalg.norm(x, axis=1, keepdims=True), 700, 2, 200).blocks == 3).all()
    want = brute(ids, x.astype(float), 4, 0.5)
    got = pairs(N.similar_vectors(frame(spark, ids, x), GROUPS, k=4, floor=0.5))
    assert len(want & got) / len(want) >= 0.99 and len(got) == len(want)


def test_scaled_copies_are_hot(spark, monkeypatch):
    x = clusters(900, seed=5).astype(np.float64)
    x[:500] = x[0] * np.random.default_rng(0).uniform(0.5, 9, 500)[:, None]
    monkeypatch.setattr(N, "HOT", 100)
    monkeypatch.setattr(N, "LIST_SIZE", 100)
    seen = []
    direction = N._direction
    monkeypatch.setattr(N, "_direction", lambda e: seen.append(e) or direction(e))
    got = N.similar_vectors(frame(spark, np.arange(900), x.astype(np.float32)), GROUPS, k=3, floor=0.9).collect()
    near = {}
    for r in got:
        near.setdefault(r["embedding_id_a"], []).append((r["embedding_id_b"], r["cosine"]))
    assert seen and all(len(near[i]) == 3 and all(b < 500 and c > 0.99999 for b, c in near[i]) for i in range(500))
