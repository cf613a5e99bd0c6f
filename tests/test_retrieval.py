"""Text search against SQLite's, and the ranking rules around it."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodewell.operators import fulltext, fusion, memory, metrics, vectors

CHUNKS = "chunk_id bigint, path string, heading string, language string, kind string, body string"
WORDS = "auth user token parse index graph naïve café store node edge query Users tokens indexing search path über".split()


def _corpus(n=80):
    r = random.Random(4)
    line = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    return [(i, f"src/{r.choice(WORDS)}/f{i % 40}.ts", line(2) if i % 3 else None, r.choice(["typescript", "python"]), "code", line(r.randint(5, 60))) for i in range(n)]


@pytest.mark.parametrize("query", ["user token", "auth", "index graph node", "na caf", "User user", "ts"])
def test_bm25_equals_fts5(spark, query):
    rows = _corpus()
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(id unindexed, path, heading, language, body, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    db.executemany("insert into f values (?, ?, ?, ?, ?)", [(i, p, h or "", lg, b) for i, p, h, lg, _, b in rows])
    match = " OR ".join(f'"{t}"*' for t in fulltext.query_terms(query))
    want = {i: -s for i, s in db.execute("select id, bm25(f, 0, 4, 3, 1.5, 2) from f where f match ?", (match,))}
    index = fulltext.build(spark.createDataFrame(rows, CHUNKS))
    got = {r["chunk_id"]: r["score"] for r in fulltext.bm25(index, fulltext.query_frame(spark, [(1, query)])).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_query_terms(spark):
    assert fulltext.query_terms("How is the User user stored a$b x?") == ["User", "user", "store", "a$b"]
    assert fulltext.query_terms("the of a") == []
    q = spark.createDataFrame([(1, "How is the User user stored a$b x?"), (2, None), (3, "")], "query_id int, query string")
    assert [r["prefix"] for r in fulltext.parse_queries(q).orderBy("n", "prefix").collect()] == ["user", "user", "store", "a", "b"]


def test_search_dedups_paths_and_weighs_them(spark):
    rows = [(1, "tests/a.ts", None, "typescript", "code", "needle here"), (2, "src/a.ts", None, "typescript", "code", "needle here"), (3, "src/a.ts", None, "typescript", "code", "needle"), (4, "b.txt", None, None, "text", "needle here")]
    rows += [(10 + i, f"z{i}.txt", None, None, "text", "other words") for i in range(8)]
    got = fulltext.search(fulltext.build(spark.createDataFrame(rows, CHUNKS)), fulltext.query_frame(spark, [(1, "needle")]), 5).orderBy("rank").collect()
    assert [r["path"] for r in got] == ["src/a.ts", "b.txt", "tests/a.ts"]


def test_index_files(spark, tmp_path):
    i = fulltext.save(fulltext.build(spark.createDataFrame(_corpus(20), CHUNKS)), str(tmp_path / "ix"))
    assert fulltext.load(spark, str(tmp_path / "ix")).postings.count() == i.postings.count() > 0
    assert fulltext.bm25(fulltext.build(spark.createDataFrame([], CHUNKS)), fulltext.query_frame(spark, [(1, "x1")])).count() == 0


def test_vector_threshold_after_bonus(spark):
    import math

    v = lambda c: [c, math.sqrt(1 - c * c)]
    c = spark.createDataFrame([(1, "a.py", "m", v(0.26)), (2, "a.rb", "m", v(0.26)), (3, "b.txt", "m", v(0.31)), (4, "c.py", "m", [1.0]), (5, "d.py", "other", v(1.0))], "chunk_id int, path string, model string, embedding array<float>")
    q = spark.createDataFrame([(7, "m", [1.0, 0.0])], "query_id int, model string, embedding array<float>")
    assert {r["chunk_id"]: round(r["score"], 4) for r in vectors.rank(c, q, 5).collect()} == {1: 0.31, 3: 0.31}


def test_embedding_batches_fail_alone(spark):
    p = spark.createDataFrame([(i, "bad" if i == 60 else "ok") for i in range(100)], "chunk_id int, input string").repartition(1)

    def provider(texts):
        return [[float("nan")] if t == "bad" else [1.0] for t in texts]

    r = vectors.embed(p.sortWithinPartitions("chunk_id"), provider).collect()
    assert sum(x["error"] is not None for x in r) == 50 and sum(x["embedding"] is not None for x in r) == 50


def test_fusion_weights_follow_rows(spark):
    kind = "query_id int, chunk_id int, path string, rank int"
    a = spark.createDataFrame([(1, 10, "p", 1)], kind)
    b = spark.createDataFrame([(1, 11, "p", 1), (2, 12, "q", 1)], kind)
    got = {r["query_id"]: (r["chunk_id"], r["score"]) for r in fusion.fuse([a, b], [2.0, 1.0]).collect()}
    assert got[1] == (10, pytest.approx(3 / 61)) and got[2] == (12, pytest.approx(2 / 61))


def test_pack_skips_what_does_not_fit(spark):
    rows = [(1, i, p, 1.0 / i, i, t) for i, p, t in ((1, "a", 50), (2, "b", 100), (3, "a", 1), (4, "c", 40), (5, "d", 10), (6, "e", 1))]
    d = spark.createDataFrame(rows, "query_id int, chunk_id int, path string, score double, rank int, tokens int")
    assert [r["path"] for r in fusion.pack(d, 3, 100).orderBy("position").collect()] == ["a", "c", "d"]


def test_attribution(spark):
    d = spark.createDataFrame([(1, i, 1, 10) for i in (1, 2, 3)], "query_id int, position int, tokens int, total int")
    assert [r["share"] for r in fusion.attribute_tokens(d, "total", "tokens").orderBy("position").collect()] == [3, 3, 4]


def test_evaluation(spark):
    res = spark.createDataFrame([(1, "x", 1), (1, "t", 2), (1, "t", 3)], "query_id int, path string, rank int")
    exp = spark.createDataFrame([(1, ["t"]), (2, []), (3, ["z"])], "query_id int, paths array<string>")
    q = {r["query_id"]: r for r in metrics.evaluate(res, exp).collect()}
    assert (q[1]["first_rank"], q[1]["reciprocal"], q[1]["hit"], round(q[1]["duplicate_rate"], 4)) == (2, 0.5, True, 0.3333)
    assert not q[2]["evaluated"] and q[3]["reciprocal"] == 0
    s = metrics.summarize(metrics.evaluate(res, exp)).first()
    assert (s["cases"], s["evaluated"], s["recall"], s["mrr"]) == (3, 2, 0.5, 0.25)
    assert metrics.parse_cases('["q", {"query": "r", "expectedPaths": ["p"]}]') == [("q", []), ("r", ["p"])]
    with pytest.raises(ValueError):
        metrics.parse_cases("[3]")


def test_memory(spark):
    kind = "memory_id bigint, title string, content string, tags string, supersedes_id bigint, created_at int, updated_at int"
    m = spark.createDataFrame([(1, "Deploy notes", "old", "ops", None, 1, 1), (2, "Deploy", "new way", "ops", 1, 2, 2), (3, "Other", "deploy 100%", "x", None, 3, 3)], kind)
    assert [r["memory_id"] for r in memory.search(m, "deploy").collect()] == [2, 3]
    assert memory.search(m, " ").count() == 0 and memory.search(m, " ", tags=False).count() == 2
    assert [r["memory_id"] for r in memory.search(m, "ops").collect()] == [2]
    with pytest.raises(Exception, match="no memory 99"):
        memory.write(m, spark.createDataFrame([(4, "t", "c", ["a", "b"], 99, 4, 4)], kind.replace("tags string", "tags array<string>"))).collect()
    assert memory.write(m, spark.createDataFrame([(4, "t", "c", ["a", "b"], 3, 4, 4)], kind.replace("tags string", "tags array<string>"))).filter("memory_id = 4").first()["tags"] == "a,b"
    assert m.agg(F.count("memory_id")).first()[0] == 3
