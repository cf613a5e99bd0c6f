"""Queries of scans, chunkers, parsers and the graph."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lodewell.functions import text as X
from lodewell.operators import chunkers, fusion, graph, symbols, tokens
from lodewell.operators.changes import latest_by
from lodewell.plans import corpus as C
from lodewell.plans.retrieval import _FUSE1, BOTH_SQL, _expand_sql
from lodewell.session import cut_lineage
from lodewell.sources import files
from lodewell.sources.tables import table


def scan_languages(spark, d):
    return C.documents(spark, d).groupBy("kind", "language").agg(F.count(F.lit(1)).alias("files"))


def scan_filter(spark, d):
    """Paths that a scan with the fixed exclusions would take."""
    docs = C.documents(spark, d)
    return docs.filter(~F.col("path").rlike(files.any_of([*files.EXCLUDED, *(f"**/{e}" for e in files.EXCLUDED)])) & ~F.col("path").rlike(r"(^|/)\.")).select("doc_id", "path")


def document_listing(spark, d):
    return C.documents(spark, d).select("doc_id", "path", "content_hash", "size_bytes", "mtime_ms").orderBy("path", "doc_id")


def chunk_windows(spark, d):
    return chunkers.windows(table(spark, d, "documents"), 256, 32).select("doc_id", "chunk_index", F.sha2("content", 256).alias("hash"), "token_count")


def chunk_token_stats(spark, d):
    c = C.chunks(spark, d)
    t = X.token_count(F.col("content"))
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("chunks"), F.sum(t).alias("tokens"), F.max(t).alias("longest"))


def chunk_bounded(spark, d):
    c = C.chunks(spark, d).filter("kind = 'code'").select(F.col("document_id").alias("doc_id"), F.col("chunk_id").alias("chunk_index"), "content")
    return chunkers.bound(c, 128, 16).select("doc_id", "chunk_index", "split_index", "split_count", "content_hash", "token_count")


def chunk_line_blocks(spark, d):
    return chunkers.line_blocks(table(spark, d, "documents"), 20).select("doc_id", "chunk_index", "start_line", "end_line", F.length("content").alias("chars"))


def chunk_whole(spark, d):
    return chunkers.whole(table(spark, d, "documents")).select("doc_id", "chunk_index", "end_line", F.length("content").alias("chars"))


def content_hash_groups(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.groupBy(X.content_hash(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("files"), F.min("doc_id").alias("first_doc")).filter("files > 1")


def identifier_terms(spark, d):
    """Words inside paths; the acronym rule is tested apart, as the oracle's expressions lack look-ahead."""
    return C.documents(spark, d).select("doc_id", X.identifier_terms(F.lower("path")).alias("terms"))


def short_hashes(spark, d):
    return C.documents(spark, d).select("doc_id", X.short_hash(F.col("path")).alias("hash"))


def workspace_slugs(spark, d):
    return table(spark, d, "workspaces").select("workspace_id", X.slug(F.concat(F.lit("  My "), "name", F.lit(" (2)!"))).alias("slug"))


def chunk_metadata(spark, d):
    m = F.col("metadata")
    c = table(spark, d, "chunks").select("chunk_id", "metadata").distinct()
    return c.select("chunk_id", X.json_valid(m).alias("valid"), X.json_text(m, "symbolName").alias("symbol"), X.json_text(m, "startLine").alias("no_text"))


def embedding_inputs(spark, d):
    c = C.chunks(spark, d)
    return c.select("chunk_id", F.sha2(X.embedding_input(F.col("path"), F.col("heading"), F.col("content")), 256).alias("hash"), X.storage_model(F.lit("m"), "v1").alias("model"))


def call_names(spark, d):
    r = spark.createDataFrame([(1, "a.b.c"), (2, "x::y"), (3, "plain"), (4, "self.items.push"), (5, "A::b.c"), (6, ".")], "id int, call string")
    return r.select("id", X.call_name(F.col("call")).alias("name"))


def vector_codec(spark, d):
    """Stored bytes to vectors and back: the norm of each decoded vector, and its length in text."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")

    def pack(frames):
        import numpy as np

        for f in frames:
            yield f.assign(blob=[np.asarray(v, "<f4").tobytes() for v in f["embedding"]])[["vec_id", "blob"]]

    b = e.mapInPandas(pack, "vec_id bigint, blob binary").withColumn("v", X.decode_vector(F.col("blob")))
    back = X.parse_vector(X.vector_literal(F.col("v")))
    return b.select("vec_id", F.round(F.sqrt(X.dot(F.col("v"), F.col("v"))), 5).alias("norm"), F.size(back).alias("dimensions"))


def bpe_windows(spark, d):
    """Windows by tokens of a public vocabulary where it is installed, else by characters."""
    path = os.path.join(os.environ.get("LODEWELL_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
    return tokens.split_documents(table(spark, d, "documents"), 256, 32, path).groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), F.sum(F.length("content")).alias("chars"))


def bpe_counts(spark, d):
    path = os.path.join(os.environ.get("LODEWELL_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
    return table(spark, d, "documents").select("doc_id", tokens.count_tokens(F.col("text"), path).alias("tokens"))


def _sections(kind: str):
    def run(spark, d):
        docs = C.documents(spark, d).filter(F.col("language") == kind)
        return chunkers.sections(docs, kind).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.length("content")).alias("chars"), F.max("end_line").alias("last_line"))

    run.__name__ = f"{kind}_sections"
    return run


def wikilinks(spark, d):
    return C.documents(spark, d).filter("kind = 'markdown'").select("doc_id", F.size(chunkers.wikilinks(F.coalesce("text", F.lit("")))).alias("links"))


def _parsed(spark, d):
    return symbols.parse_documents(C.documents(spark, d).filter("kind = 'code'"))


def parsed_symbols(spark, d):
    return _parsed(spark, d).select("doc_id", "language", F.explode("symbols").alias("s")).groupBy("language", "s.kind").agg(F.count(F.lit(1)).alias("symbols"), F.sum(F.col("s.exported").cast("long")).alias("exported"))


def parsed_calls(spark, d):
    return _parsed(spark, d).select("language", F.explode("calls").alias("c")).groupBy("language").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("c.callee").alias("callees"))


def symbol_chunks(spark, d):
    docs = C.documents(spark, d).filter("kind = 'code'")
    return chunkers.symbol_chunks(symbols.parse_documents(docs), docs).select("doc_id", "chunk_index", "heading", "start_line", "end_line", F.length("content").alias("chars"))


def parse_cache(spark, d):
    """Documents that the parse cache covers and those to parse, by language."""
    hit, miss = symbols.from_cache(C.documents(spark, d), table(spark, d, "parsed_documents"), ["oxc-v2", "native-v1", "fallback-v1"])
    both = hit.withColumn("cached", F.lit(True)).unionByName(miss.withColumn("cached", F.lit(False)))
    return both.groupBy("language", "cached").agg(F.count(F.lit(1)).alias("files"))


def _delivered(spark, d):
    """Of each workspace and path the row delivered last."""
    return latest_by(C.documents(spark, d), ["workspace_id", "path"], [F.desc_nulls_last("updated_at"), F.desc("doc_id")])


def code_graph(spark, d):
    """The graph of all code, documents and configuration: nodes and edges by type; each workspace is resolved by itself."""
    by = ["workspace_id"]
    docs = _delivered(spark, d).filter("kind in ('code', 'markdown', 'config')")
    parsed = symbols.parse_documents(docs).join(docs.select("doc_id", *by), "doc_id").withColumnRenamed("doc_id", "document_id")
    parsed = cut_lineage(parsed)  # nodes and three kinds of edges are made from one parse
    ch = chunkers.symbol_chunks(parsed, docs.withColumnRenamed("doc_id", "document_id"), "document_id")
    ch = ch.select(F.concat_ws("-", "document_id", "chunk_index").alias("chunk_id"), "document_id", "chunk_index", F.col("heading").alias("symbol"))
    n = graph.build_nodes(parsed, ch, by)
    imp = parsed.select(*by, F.col("path").alias("importer"), F.explode("imports").alias("path"), "language")
    calls = parsed.select(*by, "path", F.explode(F.slice("calls", 1, graph.CALLS)).alias("c")).select(*by, "path", "c.caller", "c.callee")
    e = graph.defines_edges(n, by).unionByName(graph.imports_edges(graph.resolve_imports(imp, docs, by), n, by)).unionByName(graph.calls_edges(calls, n, by))
    return n.groupBy(F.concat(F.lit("node "), "type").alias("what")).agg(F.count(F.lit(1)).alias("rows")).unionByName(e.groupBy(F.concat(F.lit("edge "), "type").alias("what")).agg(F.count(F.lit(1)).alias("rows")))


def import_resolution(spark, d):
    """Each file's sibling, package and folder imports, as candidates met with the files of its workspace."""
    by = ["workspace_id"]
    docs = C.documents(spark, d).select(*by, "path", "language").distinct()
    name = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    files_ = F.col("path").alias("importer")
    imp = docs.select(*by, files_, F.concat(F.lit("./"), name).alias("path"), "language").unionByName(docs.select(*by, files_, F.concat(F.lit("./missing/../"), name).alias("path"), "language"))
    return graph.resolve_imports(imp, docs, by)


def graph_expand(spark, d):
    """Chunks near the first five fused hits of each query."""
    n, e = C.graph(spark, d)
    first = fusion.fuse([C.hits(spark, d, "fts"), C.hits(spark, d, "vector")], fusion.FIRST)
    return graph.expand(first.filter("rank <= 5").select("query_id", "chunk_id"), n, e, C.chunks(spark, d), 2, 15)


def graph_distances(spark, d):
    """From the first file of each workspace."""
    n, e = C.graph(spark, d)
    s = C.documents(spark, d).groupBy(F.col("workspace_id").alias("seed_id")).agg(F.concat(F.lit("f"), F.min("doc_id")).alias("node_id"))
    return graph.distances(s, e, 4)


def graph_neighbours(spark, d):
    n, e = C.graph(spark, d)
    found, edges = graph.neighbours("f1", n, e, 2, 40)
    return graph.shape_neighbours(found, edges, None, 40)


def graph_degrees(spark, d):
    return graph.degrees(C.graph(spark, d)[1])


def graph_curated(spark, d):
    n, e = graph.curated(*C.graph(spark, d))
    return e.select("edge_id", "from_id", "to_id", "type")


def graph_label_search(spark, d):
    return graph.label_search(C.graph(spark, d)[0], "TOKEN", ["file"], 50).select("node_id", "label")


def graph_filtered(spark, d):
    n, e = graph.filtered_view(*C.graph(spark, d), "src/", ["file"], ["imports"])
    return e.select("edge_id")


def graph_adjacency(spark, d):
    return graph.adjacency(C.graph(spark, d)[1]).select("node_id", "direction", "type", F.array_join("others", ",").alias("others"))


def edge_dedup(spark, d):
    e = C.graph(spark, d)[1].withColumn("created_at", F.lit(1))
    return graph.latest_edges(e.unionByName(e.withColumn("created_at", F.lit(2)).withColumn("edge_id", F.concat("edge_id", F.lit("-b"))))).select("from_id", "to_id", "type", "edge_id")


_SCAN = files.any_of([*files.EXCLUDED, *(f"**/{e}" for e in files.EXCLUDED)]).replace("'", "''")
_G = f"WITH RECURSIVE {C.GRAPH_SQL}"
QUERIES = {f.__name__: f for f in (scan_languages, scan_filter, document_listing, chunk_windows, chunk_token_stats, chunk_bounded, chunk_line_blocks, chunk_whole, content_hash_groups, identifier_terms, short_hashes, workspace_slugs,
    chunk_metadata, embedding_inputs, call_names, vector_codec, bpe_windows, bpe_counts, _sections("markdown"), _sections("yaml"), _sections("json"), _sections("toml"), wikilinks, parsed_symbols, parsed_calls, symbol_chunks, parse_cache, code_graph, import_resolution,
    graph_expand, graph_distances, graph_neighbours, graph_degrees, graph_curated, graph_label_search, graph_filtered, graph_adjacency, edge_dedup)}
SQL = {
    "scan_languages": f"WITH {C.DOC_SQL} SELECT kind, language, count(*) AS files FROM v_doc GROUP BY 1, 2",
    "scan_filter": f"WITH {C.DOC_SQL} SELECT doc_id, path FROM v_doc WHERE NOT regexp_matches(path, '{_SCAN}') AND NOT regexp_matches(path, '(^|/)\\.')",
    "document_listing": f"WITH {C.DOC_SQL} SELECT doc_id, path, content_hash, size_bytes, mtime_ms FROM v_doc ORDER BY path, doc_id",
    "chunk_windows": """WITH w AS (SELECT doc_id, text, unnest(range(0, length(text), 896)) AS i FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(i / 896 AS INTEGER) AS chunk_index, sha256(substring(text, i + 1, 1024)) AS hash, CAST(ceil(sum_u / 4.0) AS BIGINT) AS token_count FROM (
  SELECT *, length(substring(text, i + 1, 1024)) + length(regexp_replace(substring(text, i + 1, 1024), '[\\x{0}-\\x{FFFF}]', '', 'g')) AS sum_u FROM w)""",
    "chunk_token_stats": f"""WITH {C.CHUNK_SQL}, t AS (SELECT kind, CAST(ceil((length(content) + length(regexp_replace(content, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g'))) / 4.0) AS BIGINT) AS t FROM v_chunk)
SELECT kind, count(*) AS chunks, CAST(sum(t) AS BIGINT) AS tokens, max(t) AS longest FROM t GROUP BY 1""",
    "chunk_bounded": f"""WITH {C.CHUNK_SQL},
u AS (SELECT document_id, chunk_id, content, ceil((length(content) + length(regexp_replace(content, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g'))) / 4.0) > 128 AS big FROM v_chunk WHERE kind = 'code'),
s AS (SELECT *, unnest(CASE WHEN big THEN range(0, length(content), 448) ELSE [0] END) AS i, CASE WHEN big THEN len(range(0, length(content), 448)) END AS n FROM u),
c AS (SELECT document_id AS doc_id, chunk_id, CASE WHEN n > 1 THEN CAST(i / 448 AS INTEGER) END AS split_index, CASE WHEN n > 1 THEN CAST(n AS INTEGER) END AS split_count, CASE WHEN big THEN substring(content, i + 1, 512) ELSE content END AS x FROM s)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id, coalesce(split_index, 0)) - 1 AS INTEGER) AS chunk_index, split_index, split_count, sha256(x) AS content_hash,
  CAST(ceil((length(x) + length(regexp_replace(x, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g'))) / 4.0) AS BIGINT) AS token_count FROM c""",
    "chunk_line_blocks": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE length(text) > 0),
b AS (SELECT doc_id, l, unnest(range(0, CAST(floor((len(l) - 1) / 20) AS BIGINT) + 1)) AS k FROM l),
c AS (SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(k * 20 + 1 AS INTEGER) AS start_line, CAST(least((k + 1) * 20, len(l)) AS INTEGER) AS end_line,
  regexp_replace(array_to_string(l[k * 20 + 1 : (k + 1) * 20], chr(10)), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS x FROM b)
SELECT doc_id, chunk_index, start_line, end_line, CAST(length(x) AS INTEGER) AS chars FROM c WHERE x <> ''""",
    "chunk_whole": "SELECT doc_id, 0 AS chunk_index, CAST(len(string_split(text, chr(10))) AS INTEGER) AS end_line, CAST(length(text) AS INTEGER) AS chars FROM documents WHERE text IS NOT NULL",
    "content_hash_groups": "SELECT sha256(text) AS hash, count(*) AS files, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "identifier_terms": f"""WITH {C.DOC_SQL}, t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(path), '[a-z0-9]+'), lambda w: length(w) > 1) AS w FROM v_doc),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t), f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY 1, 2)
SELECT d.doc_id, coalesce(string_agg(x, ' ' ORDER BY i), '') AS terms FROM v_doc d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY 1""",
    "short_hashes": f"WITH {C.DOC_SQL} SELECT doc_id, printf('%x', list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(path, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, b: (h * 33 + b) % 4294967296)::BIGINT) AS hash FROM v_doc",
    "workspace_slugs": "SELECT workspace_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim('  My ' || name || ' (2)!')), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'workspace') AS slug FROM workspaces",
    "chunk_metadata": """SELECT chunk_id, coalesce(json_valid(metadata), false) AS valid, CASE WHEN json_valid(metadata) AND json_type(metadata, '$.symbolName') = 'VARCHAR' THEN json_extract_string(metadata, '$.symbolName') END AS symbol,
  CASE WHEN json_valid(metadata) AND json_type(metadata, '$.startLine') = 'VARCHAR' THEN json_extract_string(metadata, '$.startLine') END AS no_text FROM (SELECT DISTINCT chunk_id, metadata FROM chunks)""",
    "embedding_inputs": f"WITH {C.CHUNK_SQL} SELECT chunk_id, sha256(concat_ws(chr(10), path, nullif(heading, ''), content)) AS hash, 'm:v1' AS model FROM v_chunk",
    "call_names": "SELECT * FROM (VALUES (1, 'c'), (2, 'y'), (3, 'plain'), (4, 'push'), (5, 'c'), (6, '.')) AS t(id, name)",
    "vector_codec": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))), 5) AS norm, CAST(len(embedding) AS INTEGER) AS dimensions FROM embeddings",
    "parse_cache": f"""WITH {C.DOC_SQL}, g AS (SELECT DISTINCT document_id, lower(content_hash) AS h FROM parsed_documents WHERE parser_version IN ('oxc-v2', 'native-v1', 'fallback-v1'))
SELECT language, g.h IS NOT NULL AS cached, count(*) AS files FROM v_doc d LEFT JOIN g ON g.document_id = d.doc_id AND g.h = lower(d.content_hash) GROUP BY 1, 2""",
    "import_resolution": f"""WITH {C.DOC_SQL}, p AS (SELECT DISTINCT workspace_id, path FROM v_doc),
i AS (SELECT workspace_id, path AS importer, regexp_extract(path, '([^/]*)\\.[^./]*$', 1) AS name, coalesce(regexp_extract(path, '^(.*)/[^/]*$', 1), '') AS folder FROM p),
q AS (SELECT workspace_id, importer, './' || name AS path, trim(folder || '/' || name, '/') AS base FROM i UNION ALL SELECT workspace_id, importer, './missing/../' || name, trim(folder || '/' || name, '/') FROM i),
l AS (SELECT *, [base] || list_transform([{', '.join(map(repr, graph.TRIED))}], lambda e: base || '.' || e) || list_transform([{', '.join(map(repr, graph.TRIED))}], lambda e: base || '/index.' || e) AS cs FROM q),
x AS (SELECT workspace_id, importer, path, unnest(cs) AS c, generate_subscripts(cs, 1) AS n FROM l)
SELECT workspace_id, importer, x.path, arg_min(c, n) AS target FROM x JOIN p USING (workspace_id) WHERE p.path = x.c GROUP BY 1, 2, 3""",
    "graph_expand": f"""{_G}, {BOTH_SQL}, {_FUSE1},
seed AS (SELECT query_id, chunk_id FROM f1 WHERE rank <= 5),{_expand_sql('x', 'seed', 2, 15)}
SELECT query_id, chunk_id, path, score, rank FROM x""",
    "graph_distances": f"""{_G}, {BOTH_SQL},
walk AS (SELECT workspace_id AS seed_id, 'f' || min(doc_id) AS node_id, 0 AS depth FROM v_doc GROUP BY 1 UNION SELECT seed_id, b, depth + 1 FROM walk JOIN g_both ON a = node_id WHERE depth < 4)
SELECT seed_id, node_id, min(depth) AS distance FROM walk GROUP BY 1, 2""",
    "wikilinks": f"""WITH {C.DOC_SQL}, l AS (SELECT doc_id, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, '^#{{1,6}}\\s')), chr(10)) AS body FROM v_doc WHERE kind = 'markdown')
SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1))) AS INTEGER) AS links FROM l""",
    "graph_degrees": f"{_G} SELECT node_id, count(*) AS degree FROM (SELECT from_id AS node_id FROM g_edge UNION ALL SELECT to_id FROM g_edge) GROUP BY 1",
    "graph_curated": f"""{_G}, n AS (SELECT node_id FROM g_node ORDER BY CASE type WHEN 'file' THEN 0 WHEN 'symbol' THEN 1 ELSE 999 END, created_at DESC NULLS LAST, node_id LIMIT 25000)
SELECT edge_id, from_id, to_id, type FROM g_edge WHERE from_id IN (SELECT node_id FROM n) AND to_id IN (SELECT node_id FROM n) ORDER BY edge_id LIMIT 75000""",
    "graph_label_search": f"{_G} SELECT node_id, label FROM g_node WHERE contains(lower(label), 'token') AND type = 'file' ORDER BY label, node_id LIMIT 50",
    "graph_filtered": f"{_G}, n AS (SELECT node_id FROM g_node WHERE contains(lower(label), 'src/') AND type = 'file') SELECT edge_id FROM g_edge WHERE type = 'imports' AND from_id IN (SELECT node_id FROM n) AND to_id IN (SELECT node_id FROM n)",
    "graph_adjacency": f"""{_G}, a AS (SELECT from_id AS node_id, 'out' AS direction, type, to_id AS o FROM g_edge UNION SELECT to_id, 'in', type, from_id FROM g_edge)
SELECT node_id, direction, type, string_agg(o, ',' ORDER BY o) AS others FROM a GROUP BY 1, 2, 3""",
    "edge_dedup": f"{_G} SELECT DISTINCT from_id, to_id, type, edge_id || '-b' AS edge_id FROM g_edge",
}
