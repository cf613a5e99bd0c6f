"""One object over a folder of indexed tables: the tool calls of a retrieval service as methods.

Retrieval work is plans over whole tables; what comes to the driver is the short answer of one call.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.functions.text import embedding_input, token_count
from lodewell.operators import chunkers, fulltext, fusion, graph, memory, metrics, symbols, vectors
from lodewell.operators.upkeep import Settings, Snapshots, diff, settings_fingerprint, to_read
from lodewell.session import ship
from lodewell.sources import files

#: Of this package's parsers; another one parses all again.
PARSER = "symbols-v2"
RUNS = "epoch int, mode string, files_listed bigint, files_read bigint, files_parsed bigint, chunks_written bigint, started_at double, finished_at double"
QUERY_LOG = "query string, mode string, result_count int, tokens_returned bigint, files_scanned bigint, created_at double"
VECTORS = "embedding_id bigint, chunk_id string, provider string, model string, dimensions int, embedding array<float>, input_hash string, created_at timestamp_ntz"

#: Limits of the calls.
MOST_RESULTS, MOST_HOPS, LEAST_BUDGET, MOST_BUDGET = 100, 5, 32, 100_000
CONTEXT_LIMIT, CONTEXT_TOKENS, TRAVERSE = 50, 4000, 200


def _clamp(x: int, low: int, high: int) -> int:
    return max(low, min(int(x), high))


def _tokens(s: str) -> int:
    return -(-(len(s.encode("utf-16-le")) // 2) // 4)


def fit_to_budget(answer: dict, budget: int, lists: tuple[str, ...] = ("nodes", "edges", "results", "callers", "callees", "relatedChunks", "sources", "files")) -> dict:
    """answer cut until its JSON is within budget tokens.

    Again and again the list whose last element is longest loses it (lists keep one element), else the longest text is halved;
    if nothing is left to cut, only metrics remain.
    """
    out = json.loads(json.dumps(answer))
    budget = _clamp(budget, LEAST_BUDGET, MOST_BUDGET)
    size = lambda x: len(json.dumps(x, ensure_ascii=False))
    for _ in range(10_000):
        if _tokens(json.dumps(out, ensure_ascii=False)) <= budget:
            return out
        open_ = [k for k in lists if isinstance(out.get(k), list) and len(out[k]) > (0 if k == "edges" else 1)]
        if open_:
            out[max(open_, key=lambda k: size(out[k][-1]))].pop()
            continue
        texts = [k for k, v in out.items() if isinstance(v, str) and len(v) > 16]
        if not texts:
            break
        k = max(texts, key=lambda k: len(out[k]))
        out[k] = out[k][: len(out[k]) // 2]
    return {"metrics": out.get("metrics"), "truncated": True}


def pick_workspace(workspaces: list[dict], ids: list[str] | None = None, id: str | None = None, path: str | None = None, paths: list[str] | None = None, hint: str | None = None) -> list[dict]:
    """The workspaces of a call: at most one selector; none means the hint, else the only one there is."""
    given = [x for x in (ids, id, path, paths) if x]
    if len(given) > 1:
        raise ValueError("more than one workspace selector")
    if given:
        want = set(given[0]) if isinstance(given[0], list) else {given[0]}
        found = [w for w in workspaces if w["workspace_id"] in want or w["root_path"] in want]
        if len(found) < len(want):
            raise ValueError("no such workspace")
        return found
    if hint:
        return [w for w in workspaces if w["workspace_id"] == hint]
    if len(workspaces) == 1:
        return workspaces
    raise ValueError("name a workspace")


@dataclass
class Tables:
    """What an engine reads: documents, chunks (with path, kind, language, body) and, if any, vectors and the graph."""

    documents: DataFrame
    chunks: DataFrame
    index: fulltext.Index
    embeddings: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None


class Engine:
    """Indexing and queries over one workspace folder (any shared file system).

    provider embeds texts (a function of a list of texts; the offline one if none is given); its vectors are stored under name and
    model, and questions are compared with them once embed has stored some. The package is given to the executors.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, provider=None, name: str = "local", model: str = "hash-64"):
        self.spark, self.root = spark, root.rstrip("/")
        self.settings = settings or Settings()
        self.snapshots = Snapshots(spark, self.root)
        self.provider, self.name, self.model = provider or vectors.hashing_embedder(), name, model
        self._caught_up: dict[str, float] = {}
        ship(spark)

    # indexing

    def index_workspace(self, folder: str, full: bool = False, ignore_file: str | None = None) -> DataFrame:
        """Lists folder, reads what its time and size tell to be new or changed, and publishes a snapshot; returns the changes by kind.

        Only files of new content are parsed and chunked, once; the rest keeps its parse, chunks, postings and vectors. Another
        chunking fingerprint chunks all again but parses nothing anew; full starts from nothing. A run is logged in `runs`.
        """
        spark, began = self.spark, time.time()
        where = (self.settings.include or None, self.settings.exclude, ignore_file)
        print_now = settings_fingerprint(self.settings.chunking)
        have = {} if full else self.snapshots.tables()
        stale = not have or self.snapshots.read("meta").first()["fingerprint"] != print_now
        draft = self.snapshots.begin()
        listed = draft.stage("listed", files.scan(spark, folder, *where))
        old = self.snapshots.read("documents") if have else listed.select("path", "size_bytes", "mtime_ms", F.lit(None).cast("string").alias("content_hash")).filter("false")
        wanted = listed if stale else to_read(old, listed)
        texts = draft.stage("texts", files.read(spark, folder, wanted.select("path", "absolute_path"), *where).withColumn("content_hash", F.sha2("text", 256)).withColumn("doc_id", F.sha2("path", 256)))
        hashes = listed.join(texts.select("path", F.col("content_hash").alias("now")), "path", "left").join(old.select("path", F.col("content_hash").alias("before")), "path", "left")
        documents = draft.write("documents", hashes.select(F.sha2("path", 256).alias("doc_id"), *listed.columns, F.coalesce("now", "before").alias("content_hash")))
        changes = draft.write("changes", diff(old, documents))
        fresh = changes.filter("change in ('new', 'changed')").select("path")
        docs = texts if stale else texts.join(fresh, "path", "left_semi")

        same = documents.select("doc_id", "content_hash")
        parsed_before = self.snapshots.read("parsed").filter(F.col("parser_version") == PARSER).join(same, ["doc_id", "content_hash"], "left_semi") if have else None
        source = docs.filter("kind in ('code', 'markdown', 'config')")
        source = source if parsed_before is None else source.join(parsed_before.select("doc_id"), "doc_id", "left_anti")
        parsed = draft.stage("parsed", symbols.parse_documents(source).join(source.select("doc_id", "content_hash"), "doc_id").withColumn("parser_version", F.lit(PARSER)))
        every_parsed = draft.write("parsed", parsed if parsed_before is None else parsed_before.unionByName(parsed))

        made = draft.stage("chunks", self._chunks(docs, every_parsed))
        gone = docs.select("doc_id")
        kept = None if stale else self.snapshots.read("chunks").join(same.select("doc_id"), "doc_id", "left_semi").join(gone, "doc_id", "left_anti")
        chunks = draft.write("chunks", made if kept is None else kept.unionByName(made))
        index = fulltext.build(made.withColumn("body", F.col("content")))
        if kept is not None:
            before, ids = self._index(), chunks.select("chunk_id")
            index = fulltext.Index(before.postings.join(ids, "chunk_id", "left_semi").unionByName(index.postings.select(*before.postings.columns)), index.vocabulary, before.chunks.join(ids, "chunk_id", "left_semi").unionByName(index.chunks.select(*before.chunks.columns)))
        fulltext.save(index, f"{self.root}/{draft.folder}/index")
        for part in ("postings", "vocabulary", "chunks"):
            draft.add(f"index_{part}", f"{draft.folder}/index/{part}")
        nodes, edges = self._graph(every_parsed, chunks, documents)
        draft.write("edges", edges(draft.write("nodes", nodes)))
        if "embeddings" in have:
            draft.write("embeddings", self.snapshots.read("embeddings").join(chunks.select("chunk_id"), "chunk_id", "left_semi"))
        draft.write("meta", spark.createDataFrame([(print_now,)], "fingerprint string"))
        run = spark.createDataFrame([(draft.epoch, "full" if full else "incremental", listed.count(), texts.count(), parsed.count(), made.count(), began, time.time())], RUNS)
        draft.write("runs", run if "runs" not in have else self.snapshots.read("runs").unionByName(run))
        draft.commit()
        return self.snapshots.read("changes").groupBy("change").agg(F.count(F.lit(1)).alias("files"))

    def catch_up(self, folder: str, seconds: float = 5.0) -> bool:
        """Indexes folder before a read, at most once in so many seconds; whether it did."""
        if time.time() - self._caught_up.get(folder, -math.inf) < seconds:
            return False
        self.index_workspace(folder)
        self._caught_up[folder] = time.time()
        return True

    def _chunks(self, docs: DataFrame, parsed: DataFrame) -> DataFrame:
        target, overlap = self.settings.chunking["targetTokens"], self.settings.chunking["overlapTokens"]
        shape = ["doc_id", "chunk_index", "heading", "symbol", "start_line", "end_line", "content"]
        none = F.lit(None).cast("string")
        code = docs.filter("kind = 'code'")
        known = parsed.join(code.select("doc_id"), "doc_id", "left_semi")
        with_symbols = chunkers.symbol_chunks(known, code).withColumn("symbol", F.col("heading")).select(*shape)
        bare = code.join(known.filter(F.size("symbols") > 0).select("doc_id"), "doc_id", "left_anti")
        blocks = chunkers.line_blocks(bare).withColumn("heading", none).withColumn("symbol", none).select(*shape)
        out = chunkers.bound(with_symbols.unionByName(blocks), target, overlap).select(*shape)
        for kind in ("markdown", "json", "yaml", "toml"):
            out = out.unionByName(chunkers.sections(docs.filter(F.col("language") == kind), kind).withColumn("symbol", none).select(*shape))
        out = out.unionByName(chunkers.whole(docs.filter("kind = 'text'")).withColumn("heading", none).withColumn("symbol", none).select(*shape))
        out = out.join(docs.select("doc_id", "path", "kind", "language"), "doc_id")
        return out.withColumn("chunk_id", graph.node_key(F.col("path"), F.col("chunk_index"), F.col("content"))).withColumn("token_count", token_count(F.col("content")))

    def _graph(self, parsed: DataFrame, chunks: DataFrame, documents: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        """Nodes, and a function that makes the edges of the written nodes."""
        p = parsed.withColumnRenamed("doc_id", "document_id")
        nodes = graph.build_nodes(p, chunks.filter("symbol is not null").select("chunk_id", F.col("doc_id").alias("document_id"), "chunk_index", "symbol"))
        imports = p.select(F.col("path").alias("importer"), F.explode("imports").alias("path"), "language")
        calls = p.select("path", F.explode(F.slice("calls", 1, graph.CALLS)).alias("c")).select("path", "c.caller", "c.callee")

        def edges(n: DataFrame) -> DataFrame:
            return graph.defines_edges(n).unionByName(graph.imports_edges(graph.resolve_imports(imports, documents), n)).unionByName(graph.calls_edges(calls, n))

        return nodes, edges

    def _index(self) -> fulltext.Index:
        return fulltext.Index(*(self.snapshots.read(f"index_{n}") for n in ("postings", "vocabulary", "chunks")))

    def tables(self) -> Tables:
        r, have = self.snapshots.read, self.snapshots.tables()
        return Tables(r("documents"), r("chunks"), self._index(), r("embeddings") if "embeddings" in have else None, r("nodes"), r("edges"))

    def status(self) -> DataFrame:
        t = self.tables()
        return metrics.counts(documents=t.documents, chunks=t.chunks, nodes=t.nodes, edges=t.edges)

    # queries

    def vector_list(self, queries: DataFrame, tables: Tables) -> DataFrame | None:
        """The best chunks of each question (query_id, query) by stored vectors of the engine's model; None if there are none."""
        e = tables.embeddings
        if e is None or not vectors.has_embeddings(e, self.name, self.model):
            return None
        asked = vectors.embed(queries.select("query_id", F.coalesce("query", F.lit("")).alias("input")), self.provider, key="query_id").filter("error is null")
        stored = e.filter((F.col("provider") == self.name) & (F.col("model") == self.model)).join(tables.chunks.select("chunk_id", "path"), "chunk_id")
        return vectors.rank(stored, asked.withColumn("model", F.lit(self.model)), self.settings.retrieval["vectorLimit"])

    def retrieve(self, queries: DataFrame, tables: Tables | None = None, vector_lists: DataFrame | None = None, limit: int | None = None, budget: int | None = None) -> DataFrame:
        """Packed sources of all queries (query_id, query) at once: text and vector lists fused, widened by the graph, packed.

        vector_lists (query_id, chunk_id, path, rank) take the place of the lists made from stored vectors.
        """
        t, s = tables or self.tables(), self.settings.retrieval
        limit = _clamp(limit or s["finalLimit"], 1, MOST_RESULTS)
        text = fulltext.search(t.index, fulltext.parse_queries(queries), s["textLimit"])
        near_vectors = self.vector_list(queries, t) if vector_lists is None else vector_lists
        first = fusion.fuse([text, *([near_vectors] if near_vectors is not None else [])], fusion.FIRST)
        if t.nodes is not None and s["graphHops"] > 0:
            seeds = first.filter(F.col("rank") <= min(limit, 5)).select("query_id", "chunk_id")
            near = graph.expand(seeds, t.nodes, t.edges, t.chunks, s["graphHops"], s["maxGraphNeighbors"])
            first = fusion.fuse([first, near], fusion.SECOND)
        # the lists are bounded: so many texts, vectors and neighbours a question
        priced = first.join(t.chunks.select("chunk_id", token_count(F.col("content")).alias("tokens")), "chunk_id")
        return fusion.pack(priced, limit, _clamp(budget or s["maxContextTokens"], LEAST_BUDGET, MOST_BUDGET))

    def log_query(self, text: str, answer: dict, mode: str = "code") -> None:
        """Appends one row to the query log below root."""
        m = answer.get("metrics") or {}
        row = [(text, mode, len(answer.get("sources", [])), m.get("tokens", 0), m.get("files", 0), time.time())]
        self.spark.createDataFrame(row, QUERY_LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/query_log")

    def query_log(self) -> DataFrame:
        return self.spark.read.schema(QUERY_LOG).parquet(f"{self.root}/query_log")

    def code_query(self, text: str, limit: int | None = None, budget: int | None = None, folder: str | None = None) -> dict:
        """Sources, context and metrics for one question; fitted to the budget. folder, if given, is caught up with first."""
        if folder is not None:
            self.catch_up(folder)
        t = self.tables()
        q = self.spark.createDataFrame([(1, text)], "query_id bigint, query string")
        packed = self.retrieve(q, t, None, limit, budget)
        rows = packed.join(t.chunks.select("chunk_id", "start_line", "end_line", "content"), "chunk_id").orderBy("position").collect()
        sources = [{"path": r["path"], "startLine": r["start_line"], "endLine": r["end_line"], "score": round(r["score"], 6)} for r in rows]
        context = "\n\n".join(f"[source: {r['path']}:{r['start_line'] if r['start_line'] is not None else '?'}-{r['end_line'] if r['end_line'] is not None else '?'} | score: {r['score']:.3f}]\n{r['content']}" for r in rows)
        return fit_to_budget({"context": context, "sources": sources, "metrics": {"tokens": sum(r["tokens"] for r in rows), "files": len(rows)}}, budget or self.settings.retrieval["maxContextTokens"])

    def graph_neighbors(self, label_or_id: str, depth: int = 1, limit: int = 50, edge_types: list[str] | None = None) -> dict:
        t = self.tables()
        found, edges = graph.neighbours(label_or_id, t.nodes, t.edges, _clamp(depth, 0, MOST_HOPS), _clamp(limit, 1, TRAVERSE))
        shaped = graph.shape_neighbours(found, edges, edge_types, limit)
        return {"nodes": [r.asDict() for r in found.orderBy("position").select("node_id", "type", "label").collect()], "edges": [r.asDict() for r in shaped.collect()]}

    def code_context(self, symbol_or_path: str, hops: int = 1, limit: int = CONTEXT_LIMIT, budget: int = CONTEXT_TOKENS) -> dict:
        """A symbol with its snippet, callers, callees, files and related chunks, within budget.

        The snippet has at most half the budget (50 tokens at least); callers, callees, files and chunks then share what is left.
        """
        t = self.tables()
        found, edges = graph.neighbours(symbol_or_path, t.nodes, t.edges, _clamp(hops, 0, MOST_HOPS), min(3 * limit, TRAVERSE))
        nodes = [r.asDict() for r in found.orderBy("position").collect()]
        links = [r.asDict() for r in edges.collect()]
        refs = [n["ref_id"] for n in nodes if n["type"] == "symbol" and n["ref_id"]]
        bodies = {r["chunk_id"]: r for r in t.chunks.filter(F.col("chunk_id").isin(refs)).select("chunk_id", "path", "content").collect()} if refs else {}
        symbol = next((n for n in nodes if n["type"] == "symbol" and symbol_or_path in (n["label"], n["node_id"])), None)
        names = {n["node_id"]: n["label"] for n in nodes}
        out: dict = {"symbol": None, "callers": [], "callees": [], "files": [], "relatedChunks": []}
        used = 0
        if symbol is not None:
            body = bodies.get(symbol["ref_id"])
            snippet = (body["content"] if body else "")[: 4 * max(50, budget // 2)]
            if _tokens(snippet) > budget - 40:
                snippet = snippet[: 4 * max(0, budget - 40)]
            out["symbol"] = {"label": symbol["label"], "path": symbol["path"], "snippet": snippet}
            used = _tokens(json.dumps(out["symbol"]))
        me = symbol["node_id"] if symbol else None
        parts = {
            "callers": [names[e["from_id"]] for e in links if e["type"] == "calls" and e["to_id"] == me and e["from_id"] in names],
            "callees": [names[e["to_id"]] for e in links if e["type"] == "calls" and e["from_id"] == me and e["to_id"] in names],
            "files": [n["label"] for n in nodes if n["type"] == "file"],
            "relatedChunks": [{"path": b["path"], "content": b["content"]} for k, b in bodies.items() if symbol is None or k != symbol["ref_id"]],
        }
        count = 0
        for name, items in parts.items():
            for x in items:
                cost = _tokens(json.dumps(x))
                if count >= limit:
                    break
                if used + cost <= budget:
                    out[name].append(x)
                    used, count = used + cost, count + 1
        return out

    def query_neighbourhood(self, text: str, limit: int = 50) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges one step around the three best files of a question."""
        t = self.tables()
        q = self.spark.createDataFrame([(1, text)], "query_id bigint, query string")
        paths = [r["path"] for r in fulltext.search(t.index, fulltext.parse_queries(q), 3).orderBy("rank").collect()]
        parts = [graph.neighbours(p, t.nodes, t.edges, 1, limit) for p in paths]
        nodes, edges = t.nodes.filter("false"), t.edges.filter("false").select("edge_id", "from_id", "to_id", "type")
        for n, e in parts:
            nodes, edges = nodes.unionByName(n.select(*nodes.columns)), edges.unionByName(e)
        return nodes.dropDuplicates(["node_id"]), edges.dropDuplicates(["from_id", "to_id", "type"])

    def query_many(self, engines: dict[str, Engine], text: str, budget: int = 4000) -> dict:
        """One question over several workspaces: the budget is split, sources are joined by score."""
        each = fusion.split_budget(budget, len(engines))
        answers = {name: e.code_query(text, budget=each) for name, e in engines.items()}
        sources = sorted(({**s, "workspace": n} for n, a in answers.items() for s in a.get("sources", [])), key=lambda s: -s["score"])
        return fit_to_budget({"context": "\n\n".join(f"## {n}\n{a.get('context', '')}" for n, a in answers.items()), "sources": sources, "metrics": {"files": sum((a.get("metrics") or {}).get("files", 0) for a in answers.values())}}, budget)

    # notes

    def memory_recall(self, memories: DataFrame, text: str, limit: int = memory.RESULTS) -> DataFrame:
        return memory.search(memories, text, _clamp(limit, 1, MOST_RESULTS))

    def memory_write(self, memories: DataFrame, rows: DataFrame) -> DataFrame:
        return memory.write(memories, rows)

    def embed(self) -> DataFrame:
        """Stores vectors of all chunks that lack one of the engine's model in a new snapshot; returns (status, chunks).

        A chunk whose input equals that of a stored vector takes this one; of the others, those of failing batches stay without.
        """
        have, t = self.snapshots.tables(), self.tables()
        stored = t.embeddings if t.embeddings is not None else self.spark.createDataFrame([], VECTORS)
        inputs = t.chunks.select("chunk_id", embedding_input(F.col("path"), F.col("heading"), F.col("content")).alias("input")).withColumn("input_hash", F.sha2("input", 256))
        draft = self.snapshots.begin()
        pending = vectors.reuse(vectors.to_embed(inputs, stored, self.name, self.model), stored, self.name, self.model)
        known = pending.filter("embedding is not null").select("chunk_id", "input_hash", "embedding", F.lit("reused").alias("status"))
        asked = pending.filter("embedding is null")
        made = vectors.embed(asked, self.provider).join(asked.select("chunk_id", "input_hash"), "chunk_id")
        made = draft.stage("vectors", known.unionByName(made.select("chunk_id", "input_hash", "embedding", F.when(F.col("error").isNull(), "embedded").otherwise("failed").alias("status"))))
        new = made.filter("status <> 'failed'").select(F.xxhash64("chunk_id").alias("embedding_id"), "chunk_id", F.lit(self.name).alias("provider"), F.lit(self.model).alias("model"), F.size("embedding").alias("dimensions"), "embedding", "input_hash", F.current_timestamp().cast("timestamp_ntz").alias("created_at"))
        for name, folder in have.items():
            draft.add(name, folder)
        draft.write("embeddings", vectors.upsert(stored, new))
        draft.commit()
        return made.groupBy("status").agg(F.count(F.lit(1)).alias("chunks"))
