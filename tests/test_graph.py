"""Symbols, the graph, the engine over files, and streams."""

import datetime as dt

from pyspark.sql import functions as F

from lodewell.operators import fulltext, graph, symbols
from lodewell.plans.engine import Engine, fit_to_budget, pick_workspace
from lodewell.streaming import watch


def names(language, text):
    return [s[0] for s in symbols.parse(language, text).symbols]


def test_python_symbols():
    p = symbols.parse("python", "import os\nfrom .pkg import a\n@deco\nclass A:\n    def m(self):\n        helper(len([]))\nasync def _f():\n    await go()\n# def no(): pass\n")
    assert [(s[0], s[1], s[2]) for s in p.symbols] == [("A", "class", True), ("A::m", "method", True), ("_f", "function", False)]
    assert p.imports == ["os", ".pkg", ".pkg.a"] and set(p.calls) == {("A", "deco"), ("A::m", "helper"), ("_f", "go")}
    assert symbols.parse("python", "def (").symbols == [] and symbols.parse("python", None).symbols == []


def test_go_symbols():
    p = symbols.parse("go", 'package p\nimport (\n\t"fmt"\n\tx "a/b"\n)\ntype T struct {\n\tA int\n}\nfunc (t *T) Run(n int) error {\n\tfmt.Println("}")\n\treturn helper(n)\n}\nfunc helper(n int) error { return nil }\nconst K = 1\n')
    assert [(s[0], s[2], s[3], s[4]) for s in p.symbols] == [("T", True, 6, 8), ("T::Run", True, 9, 12), ("helper", False, 13, 13), ("K", True, 14, 14)]
    assert p.imports == ["fmt", "a/b"] and ("T::Run", "helper") in p.calls


def test_rust_symbols():
    p = symbols.parse("rust", "use std::io;\npub struct S { a: u32 }\nimpl S {\n    pub fn new() -> Self { make('}') }\n}\nfn make(c: char) -> S { S { a: 1 } }\n")
    assert [s[0] for s in p.symbols] == ["S", "S", "S::new", "make"] and ("S::new", "make") in p.calls and p.imports == ["std::io"]


def test_ruby_symbols():
    p = symbols.parse("ruby", 'require_relative "lib/x"\nclass A\n  def run(x)\n    go(x)\n  end\n  private\n  def hid\n  end\nend\n')
    assert [(s[0], s[2], s[3], s[4]) for s in p.symbols] == [("A", True, 2, 9), ("A::run", True, 3, 5), ("A::hid", False, 7, 8)] and p.imports == ["lib/x"] and ("A::run", "go") in p.calls


def test_script_symbols():
    p = symbols.parse("typescript", 'import { a } from "./a";\nexport * from "./b";\nexport class C {\n  static make(): C { return new C(); }\n  get size() { return 1; }\n  run(x: number) {\n    this.step(x);\n    helper(x);\n  }\n  step(x: number) {}\n}\nexport const f = async (x: string) => {\n  const inner = () => { go(); };\n};\ninterface I { a: string }\ntype T = { b: number };\nfunction helper(x: number) { return "function no() {}"; }\n')
    assert {s[0] for s in p.symbols} == {"C", "C.static.make", "C.get.size", "C.run", "C.step", "f", "f.inner", "I", "T", "helper"}
    assert ("C.run", "C.step") in p.calls and ("C.run", "helper") in p.calls and ("f.inner", "go") in p.calls
    assert p.imports == ["./a", "./b"]


def test_blank_keeps_columns():
    t = 'a = "x # y" # c\nb'
    assert len(symbols.blank(t, "python")) == len(t) and symbols.blank(t, "python").count("\n") == 1 and "#" not in symbols.blank(t, "python")


def test_imports_resolve_in_order(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b/index.ts",), ("src/c.js",), ("src/c.ts",), ("pkg/m.py",), ("pkg/n/__init__.py",), ("lib/x.rb",)], "path string")
    imp = spark.createDataFrame([("src/a.ts", "./b", "typescript"), ("src/a.ts", "./c", "typescript"), ("src/a.ts", "react", "typescript"), ("pkg/q.py", ".m", "python"), ("pkg/n/z.py", "..m", "python"), ("top.py", "pkg.n", "python"), ("lib/y.rb", "x", "ruby")], "importer string, path string, language string")
    got = {(r["importer"], r["path"]): r["target"] for r in graph.resolve_imports(imp, files).collect()}
    assert got == {("src/a.ts", "./b"): "src/b/index.ts", ("src/a.ts", "./c"): "src/c.ts", ("pkg/q.py", ".m"): "pkg/m.py", ("pkg/n/z.py", "..m"): "pkg/m.py", ("top.py", "pkg.n"): "pkg/n/__init__.py", ("lib/y.rb", "x"): "lib/x.rb"}


def test_walks(spark):
    nodes = spark.createDataFrame([(c, "symbol", c, str(i), "p" + c, 0) for i, c in enumerate("abcd")], "node_id string, type string, label string, ref_id string, path string, pos int")
    edges = spark.createDataFrame([("1", "a", "b", "calls"), ("2", "c", "b", "calls"), ("3", "c", "d", "calls")], "edge_id string, from_id string, to_id string, type string")
    seeds = spark.createDataFrame([("s", "a")], "seed_id string, node_id string")
    for depth, want in ((0, {"a": 0}), (2, {"a": 0, "b": 1, "c": 2}), (5, {"a": 0, "b": 1, "c": 2, "d": 3})):
        assert {r["node_id"]: r["distance"] for r in graph.distances(seeds, edges, depth).collect()} == want
    chunks = spark.createDataFrame([(i, "p" + c) for i, c in enumerate("abcd")], "chunk_id bigint, path string")
    got = graph.expand(spark.createDataFrame([(1, 0)], "query_id int, chunk_id bigint"), nodes, edges, chunks, 2, 5).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["score"], 3)) for r in got] == [(1, 0.5), (2, 0.333)]
    n, e = graph.neighbours("b", nodes, edges, 1, 50)
    assert {r["node_id"] for r in n.collect()} == {"a", "b", "c"} and e.count() == 2
    assert {r["node_id"] for r in graph.neighbours("b", nodes, edges, 2, 2)[0].collect()} == {"b", "a"}
    assert graph.neighbours("zz", nodes, edges, 2)[0].count() == 0


def test_engine(spark, tmp_path):
    src = tmp_path / "src"
    (src / "lib").mkdir(parents=True)
    (src / "lib/helper.ts").write_text("export function formatName(x: string) {\n  return x;\n}\n")
    (src / "main.ts").write_text('import { formatName } from "./lib/helper";\nexport function greetUser(n: string) {\n  return formatName(n);\n}\n')
    (src / "README.md").write_text("# Guide\nHow greeting works.\n")
    e = Engine(spark, str(tmp_path / "ws"))
    assert {r["change"]: r["files"] for r in e.index_workspace(str(src)).collect()} == {"new": 3}
    answer = e.code_query("greet user", limit=3)
    assert answer["sources"][0]["path"] == "main.ts" and "greetUser" in answer["context"]
    assert any(s["path"] == "lib/helper.ts" for s in answer["sources"])  # only the graph leads there
    ctx = e.code_context("greetUser")
    assert ctx["callees"] == ["formatName"] and "greetUser" in ctx["symbol"]["snippet"]
    assert {x["type"] for x in e.graph_neighbors("main.ts", 1)["edges"]} == {"defines", "imports"}
    (src / "main.ts").write_text("export function byeUser() {}\n")
    (src / "README.md").unlink()
    assert {r["change"]: r["files"] for r in e.index_workspace(str(src)).collect()} == {"unchanged": 1, "changed": 1, "deleted": 1}
    assert e.code_query("greetUser")["sources"] == [] or "byeUser" in e.code_query("byeUser")["context"]


def test_engine_reads_and_parses_only_what_changed(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(4):
        (src / f"m{i}.py").write_text(f"def f{i}(x):\n    return x + {i}\n")
    (src / "odd name [1].py").write_text("def odd():\n    return 1\n")
    e = Engine(spark, str(tmp_path / "ws"))
    e.index_workspace(str(src))
    (src / "m1.py").write_text("def g1(x):\n    return f0(x)\n")
    (src / "odd name [1].py").write_text("def odder():\n    return 1\n")
    e.index_workspace(str(src))
    runs = [(r["files_listed"], r["files_read"], r["files_parsed"]) for r in e.snapshots.read("runs").orderBy("epoch").collect()]
    assert runs == [(5, 5, 5), (5, 2, 2)]
    assert sorted(r["heading"] for r in e.tables().chunks.collect()) == ["f0", "f2", "f3", "g1", "odder"]
    assert {r["path"] for r in fulltext.search(e.tables().index, fulltext.query_frame(spark, [(1, "f1 g1 odder f0")]), 10).collect()} == {"m0.py", "m1.py", "odd name [1].py"}
    before = e.snapshots.epoch()
    e.settings.chunking = {"targetTokens": 64, "overlapTokens": 0}  # all is chunked again, nothing parsed
    e.index_workspace(str(src))
    last = e.snapshots.read("runs").orderBy("epoch").collect()[-1]
    assert e.snapshots.epoch() == before + 1 and (last["files_read"], last["files_parsed"], last["chunks_written"]) == (5, 0, 5)
    assert e.catch_up(str(src)) and not e.catch_up(str(src))
    e.log_query("q", e.code_query("f0"))
    assert e.query_log().count() == 1


def test_symbols_after_a_split_one_keep_their_chunks(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    big = "def big(x):\n" + "".join(f"    x = x + {i}\n" for i in range(400)) + "    return small(x)\n"
    (src / "a.py").write_text(big + "\n\ndef small(x):\n    return tail(x)\n\n\ndef tail(x):\n    return x\n")
    e = Engine(spark, str(tmp_path / "ws"))
    e.settings.chunking = {"targetTokens": 128, "overlapTokens": 16}
    e.index_workspace(str(src))
    t = e.tables()
    symbols_ = {r["label"]: r["ref_id"] for r in t.nodes.filter("type = 'symbol'").collect()}
    bodies = {r["chunk_id"]: r["content"] for r in t.chunks.collect()}
    assert set(symbols_.values()) <= bodies.keys() and bodies[symbols_["big"]].endswith("return small(x)") and bodies[symbols_["small"]].startswith("def small")
    assert e.code_context("small")["symbol"]["snippet"].startswith("def small")
    seed = spark.createDataFrame([(1, symbols_["big"])], "query_id int, chunk_id string")
    assert symbols_["small"] in {r["chunk_id"] for r in graph.expand(seed, t.nodes, t.edges, t.chunks.withColumn("path", F.col("chunk_id")), 1, 5).collect()}


def test_questions_are_compared_with_stored_vectors(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("# One\nabout pumps and valves\n")
    (src / "b.md").write_text("# Two\nabout cats\n")
    calls = []

    def provider(texts):  # files about pumps and questions about hydraulics lie close together
        calls.append(len(texts))
        return [[1.0, 0.0] if "pumps" in x or "hydraulics" in x else [0.0, 1.0] for x in texts]

    e = Engine(spark, str(tmp_path / "ws"), provider=provider, model="two")
    e.index_workspace(str(src))
    assert e.code_query("hydraulics")["sources"] == []
    assert {r["status"]: r["chunks"] for r in e.embed().collect()} == {"embedded": 2}
    assert [s["path"] for s in e.code_query("hydraulics")["sources"]] == ["a.md"]
    assert e.embed().count() == 0  # nothing is left to embed
    (src / "c.md").write_text("# Three\nmore cats\n")
    e.index_workspace(str(src))
    assert {r["status"]: r["chunks"] for r in e.embed().collect()} == {"embedded": 1} and e.tables().embeddings.count() == 3


def test_an_epoch_is_published_once(spark, tmp_path):
    from lodewell.operators.upkeep import Snapshots

    s = Snapshots(spark, str(tmp_path / "snap"))
    s.publish({"n": spark.range(3)}, 1)
    a, b = s.begin(2), s.begin(2)
    a.write("n", spark.range(4)), b.write("n", spark.range(9))
    a.commit()
    for late in (b.commit, lambda: s.publish({"n": spark.range(9)}, 2)):
        try:
            late()
            raise AssertionError
        except RuntimeError:
            pass
    assert s.read("n").count() == 4


def test_budget_and_selectors():
    out = fit_to_budget({"results": ["x" * 400] * 5, "context": "y" * 4000, "metrics": {"n": 1}}, 100)
    assert len(str(out)) < 700 and out["metrics"] == {"n": 1}
    ws = [{"workspace_id": "a", "root_path": "/a"}, {"workspace_id": "b", "root_path": "/b"}]
    assert pick_workspace(ws, path="/b")[0]["workspace_id"] == "b"
    for bad in ({}, {"id": "a", "path": "/a"}, {"id": "zz"}):
        try:
            pick_workspace(ws, **bad)
            raise AssertionError
        except ValueError:
            pass


def test_streams(spark, tmp_path):
    t = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    rows = [("w", t(1), "a"), ("w", t(2), "b"), ("w", t(20), "a"), ("v", t(1), "c")]
    ev = spark.createDataFrame(rows, "workspace_id string, ts timestamp, path string")
    assert sorted((r["workspace_id"], r["events"], r["paths"]) for r in watch.debounce(ev, "5 seconds").collect()) == [("v", 1, ["c"]), ("w", 1, ["a"]), ("w", 2, ["a", "b"])]
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    seen = []
    q = watch.watch(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sum(seen) == 4
    again = watch.watch(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")), lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    again.awaitTermination(60)
    assert sum(seen) == 4
    claims = spark.createDataFrame([("w", "a", t(0)), ("w", "b", t(30)), ("w", "b", t(59))], "workspace_id string, owner string, at timestamp")
    claims.coalesce(1).write.parquet(str(tmp_path / "claims"))
    out = watch.lease_stream(spark.readStream.schema(claims.schema).parquet(str(tmp_path / "claims")), 45.0)
    s = out.writeStream.format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert sorted((r["owner"], r["granted"]) for r in spark.table("leases").collect()) == [("a", True), ("b", False), ("b", True)]
