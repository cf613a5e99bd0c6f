"""Scalar functions, chunkers and scans."""

import hashlib
import random

from pyspark.sql import functions as F

from lodewell.functions import languages as lang
from lodewell.functions import text as X
from lodewell.operators import chunkers
from lodewell.sources import files


def one(spark, col, **values):
    r = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return r.select(col.alias("x")).first()["x"]


def test_scalars(spark):
    c = F.col("v")
    assert one(spark, X.token_count(c), v="a😀b") == 1 and one(spark, X.utf16_length(c), v="a😀") == 3
    assert one(spark, X.token_count(c), v="x" * 101) == 26
    assert one(spark, X.identifier_terms(c), v="parseHTTPRequest user_id userID x") == "parse http request user id"
    assert one(spark, X.slug(c), v="  My Work!! ") == "my-work" and one(spark, X.slug(c), v="!!") == "workspace"
    assert one(spark, X.call_name(c), v="a::b.c") == "c"
    assert one(spark, X.normal_path(c), v="a/./b/../../c//d") == "c/d"
    assert one(spark, X.truncate_tokens(c, F.lit(2)), v="abcdefghij") == "abcdefgh" and one(spark, X.truncate_tokens(c, F.lit(0)), v="abc") == ""
    assert one(spark, X.escape_like(c), v="a_b%") == "a\\_b\\%"
    assert one(spark, X.short_hash(c), v="abc") == format(((5381 * 33 + 97) * 33 + 98) * 33 + 99 & 0xFFFFFFFF, "x")
    cos = lambda a, b: one(spark, X.cosine(F.array(*map(F.lit, a)).cast("array<double>"), F.array(*map(F.lit, b)).cast("array<double>")))
    assert [cos([1, 0], [1, 0]), cos([1, 0], [0, 1]), cos([1, 0], [-1, 0]), cos([], []), cos([1], [1, 2]), cos([0, 0], [1, 1])] == [1, 0, -1, 0, 0, 0]
    assert one(spark, X.context_block(F.lit("p"), F.lit(None).cast("int"), F.lit(3), F.lit(0.5), F.lit("c"))) == "[source: p:?-3 | score: 0.500]\nc"


def test_search_text(spark):
    meta = ['{"searchText": " needle "}', '{"searchText": 3}', '{"searchText": "  "}', "{broken", None, "{}"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(meta)], "i int, m string")
    got = [r["x"] for r in df.orderBy("i").select(X.search_text(F.col("m"), F.lit("body")).alias("x")).collect()]
    assert got == ["needle\nbody", "body", "body", "body", "body", "body"]


def test_languages(spark):
    df = spark.createDataFrame([("a/b.TS",), ("x.py",), ("README.md",), ("c.yml",), ("d.txt",), ("Makefile",), (".env",), (None,)], "p string")
    got = [(r["k"], r["l"]) for r in df.select(lang.kind(F.col("p")).alias("k"), lang.language(F.col("p")).alias("l")).collect()]
    assert got == [("code", "typescript"), ("code", "python"), ("markdown", "markdown"), ("config", "yaml"), ("text", "txt"), ("text", None), ("text", None), (None, None)]


def test_windows_lengths(spark):
    for n, want in ((4000, [4000, 416]), (3584, [3584]), (8000, [4096, 4096, 832])):
        d = spark.createDataFrame([(1, "x" * n)], "doc_id int, text string")
        assert [len(r["content"]) for r in chunkers.windows(d, 1024, 128).orderBy("chunk_index").collect()] == want
    assert chunkers.windows(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string"), 8, 2).count() == 0
    assert chunkers.windows(spark.createDataFrame([(1, "abc")], "doc_id int, text string"), 0, 2).count() == 0


def test_bound_keeps_small_chunks(spark):
    d = spark.createDataFrame([(1, 0, "short"), (1, 1, "y" * 100)], "doc_id int, chunk_index int, content string")
    r = chunkers.bound(d, 10, 2).orderBy("chunk_index").collect()
    assert [len(x["content"]) for x in r] == [5, 40, 40, 36, 4] and r[0]["split_count"] is None and r[1]["split_count"] == 4
    assert r[1]["content_hash"] == hashlib.sha256(b"y" * 40).hexdigest()


def test_markdown():
    s = chunkers.markdown_sections("intro\n# A\ntext\n### C\ndeep\n## B\n\n# D\nend")
    assert [(x["heading"], x["heading_path"], x["start_line"], x["end_line"], x["content"]) for x in s] == [
        (None, [], 1, 1, "intro"), ("A", ["A"], 2, 3, "text"), ("C", ["A", "C"], 4, 5, "deep"), ("D", ["D"], 8, 9, "end")]
    words = " ".join(random.Random(1).choice(["alpha", "beta", "gamma"]) for _ in range(300))
    parts = chunkers.reflow(words, 50, 3)
    assert all(len(p) <= 200 for p in parts) and parts[1].split()[:3] == parts[0].split()[-3:]
    assert chunkers.reflow("a\n\nb", 50, 0) == ["a\n\nb"]


def test_config_sections():
    assert [(x["heading"], x["value_type"]) for x in chunkers.json_sections('{"b": [1], "a": null, "2": "x", "1": true}')] == [("1", "boolean"), ("2", "string"), ("b", "array"), ("a", "object")]
    assert chunkers.json_sections("{bad")[0]["content"] == "{bad"
    assert [x["heading"] for x in chunkers.yaml_sections("# c\nname: x\nlist:\n  - a\n- b\n")] == ["root", "name", "list", "list-item-1"]
    assert [(x["heading"], x["special"]) for x in chunkers.toml_sections("a = 1\n[t]\nb = 2\n[[u]]\nc = 3\n")] == [("root", False), ("t", False), ("u", True)]


def test_line_blocks_and_links(spark):
    d = spark.createDataFrame([(1, "\n".join(map(str, range(170)))), (2, "\n \n")], "doc_id int, text string")
    assert [(r["start_line"], r["end_line"]) for r in chunkers.line_blocks(d).orderBy("chunk_index").collect()] == [(1, 80), (81, 160), (161, 170)]
    w = spark.createDataFrame([("# [[no]]\n[[a]] and [[b]] [[a]]",)], "t string").select(chunkers.wikilinks(F.col("t")).alias("x")).first()["x"]
    assert w == ["a", "b"]


def test_scan(spark, tmp_path):
    for p in ("src/a.py", "src/.hidden/b.py", "node_modules/x/c.js", "docs/d.md", "out/e.ts", "f.bin", "g_test.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    got = files.scan(spark, str(tmp_path), exclude=["**/*_test.py"], ignore_file="# note\n\nout/\n!keep\n", content=True)
    assert sorted((r["path"], r["kind"], r["text"]) for r in got.collect()) == [("docs/d.md", "markdown", "x = 1\n"), ("src/a.py", "code", "x = 1\n")]
    assert files.ignore_globs("a/b\nc") == ["a/b", "a/b/**", "c", "c/**", "**/c", "**/c/**"]
    assert [r["path"] for r in files.scan(spark, str(tmp_path), include=["*.bin"]).collect()] == ["f.bin"]
