"""Queries of text search, vector ranking, fusion, packing and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.functions.languages import is_boosted
from lodewell.functions.text import token_count
from lodewell.operators import fulltext, fusion, graph, metrics, vectors
from lodewell.plans import corpus as C
from lodewell.session import cut_lineage
from lodewell.sources.tables import table


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _found(spark: SparkSession, d: str, limit: int = 20) -> DataFrame:
    return fulltext.search(C.index(spark, d), fulltext.parse_queries(table(spark, d, "query_logs")), limit)


def fts_search(spark, d):
    return _found(spark, d)


def fts_terms(spark, d):
    return fulltext.parse_queries(table(spark, d, "query_logs")).select("query_id", "n", "prefix")


def fts_search_repeated_term(spark, d):
    """A term in two letter cases counts twice."""
    q = fulltext.query_frame(spark, [(1, "Token token"), (2, "token"), (3, "stored ledger$cache"), (4, "the of")])
    return fulltext.search(C.index(spark, d), q, 20)


def fts_document_frequency(spark, d):
    p = C.index(spark, d).postings
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("weight")).orderBy(F.desc("df"), "term").limit(200)


def fts_lengths(spark, d):
    return C.index(spark, d).chunks.select("chunk_id", "dl")


def _indexed(spark, d):
    c = table(spark, d, "chunks").select("chunk_id")
    return c.unionByName(spark.createDataFrame([(-1,), (-2,)], "chunk_id bigint"))


def fts_index_check(spark, d):
    return fulltext.index_check(table(spark, d, "chunks"), _indexed(spark, d))


def fts_orphans(spark, d):
    return fulltext.without_orphans(table(spark, d, "chunks").select("chunk_id"), _indexed(spark, d)).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("rows"))


def fts_backfill(spark, d):
    embedded = table(spark, d, "chunk_embeddings").select("chunk_id")
    return fulltext.backfill(table(spark, d, "chunks").select("chunk_id"), embedded).distinct()


def _vector_parts(spark, d):
    """All newest usable vectors with their paths, and as queries those whose id is divisible by 50."""
    v = C.vectors(spark, d).withColumn("model", F.concat_ws("/", "provider", "model"))
    paths = C.chunks(spark, d).select("chunk_id", "path")
    q = v.filter("embedding_id % 50 = 0").select(F.col("embedding_id").alias("query_id"), "model", "embedding")
    return v.select("chunk_id", "model", "embedding").join(paths, "chunk_id"), q


def vector_search(spark, d):
    """The best paths for every fiftieth vector among all of its model and dimensions: bonus and threshold included."""
    return vectors.rank(*_vector_parts(spark, d), 20).drop("rank")


def vector_pairs(spark, d):
    """Cosine of every vector of embeddings with those whose id is divisible by 50."""
    e = table(spark, d, "embeddings").withColumn("model", F.lit("m"))
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "model", "embedding")
    s = vectors.compared(e.select(F.col("vec_id").alias("chunk_id"), F.lit("").alias("path"), "model", "embedding"), q, None, 0.2999, False)
    s = s.select("query_id", F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("cosine")).filter("cosine >= 0.3")
    return s.join(e.select("vec_id", "label"), "vec_id").select("query_id", "vec_id", "label", "cosine")


def vector_boost_counts(spark, d):
    return C.documents(spark, d).groupBy(is_boosted(F.col("path")).alias("boosted")).agg(F.count(F.lit(1)).alias("files"))


def embedding_dedup(spark, d):
    return vectors.dedup(table(spark, d, "chunk_embeddings")).select("chunk_id", "provider", "model", "embedding_id", "input_hash")


def _active(spark, d):
    """chunk_embeddings and the stored name of the active model, its version suffix included."""
    e = table(spark, d, "chunk_embeddings")
    return e, vectors.active_model(e, "local", "code-mini-64")


def embedding_pending(spark, d):
    e, model = _active(spark, d)
    return vectors.to_embed(table(spark, d, "chunks").select("chunk_id").distinct(), e, "local", model)


def embedding_reuse(spark, d):
    e, model = _active(spark, d)
    c = table(spark, d, "chunks").select("chunk_id", F.col("content_hash").alias("input_hash")).distinct()
    return vectors.reuse(c, e, "local", model).select("chunk_id", "reused_from")


def embedding_upsert(spark, d):
    e = table(spark, d, "chunk_embeddings").select("embedding_id", "chunk_id", "provider", "model", "input_hash", "created_at")
    new = e.filter("provider = 'remote'").withColumn("embedding_id", F.col("embedding_id") + 10_000_000).withColumn("input_hash", F.lit("new"))
    return vectors.upsert(e, new).select("chunk_id", "provider", "model", "embedding_id", "input_hash")


def embed_offline(spark, d):
    """Vectors of all pending chunks by the offline embedder."""
    e, model = _active(spark, d)
    p = vectors.to_embed(C.chunks(spark, d), e, "local", model).select("chunk_id", F.concat_ws("\n", "path", "heading", "content").alias("input"))
    return vectors.embed(p, vectors.hashing_embedder(64)).select("chunk_id", F.size("embedding").alias("dimensions"), "error")


def _fused(spark, d, second: bool = False):
    first = fusion.fuse([C.hits(spark, d, "fts"), C.hits(spark, d, "vector")], fusion.FIRST)
    return fusion.fuse([first, C.hits(spark, d, "graph")], fusion.SECOND) if second else first


def rrf_two_lists(spark, d):
    return _r6(_fused(spark, d), "score")


def rrf_with_graph(spark, d):
    return _r6(_fused(spark, d, True), "score")


def _priced(spark, d):
    t = C.chunks(spark, d).select("chunk_id", token_count(F.col("content")).alias("tokens"))
    return _fused(spark, d, True).join(t, "chunk_id")


def _packed(spark, d):
    return fusion.pack(_priced(spark, d), 10, 2000)


def pack_budget(spark, d):
    return _r6(_packed(spark, d), "score")


def render_context(spark, d):
    c = C.chunks(spark, d).select("chunk_id", "content", "chunk_index")
    p = _packed(spark, d).join(c, "chunk_id").withColumn("start_line", F.col("chunk_index")).withColumn("end_line", F.lit(None).cast("int"))
    return fusion.render(p).select("query_id", F.sha2("context", 256).alias("context_hash"), F.length("context").alias("chars"))


def token_attribution(spark, d):
    p = _packed(spark, d).withColumn("total", F.lit(1001))
    return fusion.attribute_tokens(p, "total", "tokens").select("query_id", "position", "share")


def retrieval_metrics(spark, d):
    ch = C.chunks(spark, d).withColumn("token_count", token_count(F.col("content")))
    return metrics.retrieval_metrics(_packed(spark, d), _priced(spark, d), ch)


def hybrid_search(spark, d):
    """Text search, ranking of stored vectors and graph expansion, fused and packed, for all logged queries at once.

    Stored vectors come from a model that is not at hand for the questions, so a question's vector is that of its best text hit.
    """
    found = cut_lineage(_found(spark, d))  # a few rows a question, used three times
    chunks = C.index(spark, d).chunks.select("chunk_id", "path", "tokens")
    e, model = _active(spark, d)
    stored = C.vectors(spark, d, (F.col("provider") == "local") & (F.col("model") == model)).select("chunk_id", "model", "embedding")
    asked = found.filter("rank = 1").join(stored, "chunk_id").select("query_id", "model", "embedding")
    near = vectors.rank(stored.join(chunks.select("chunk_id", "path"), "chunk_id"), asked, 20)
    first = cut_lineage(fusion.fuse([found, near], fusion.FIRST))
    n, edges = C.graph(spark, d)
    around = graph.expand(first.filter("rank <= 5").select("query_id", "chunk_id"), n, edges, chunks.select("chunk_id", "path"), 1, 15)
    f = fusion.fuse([first, around], fusion.SECOND)
    return _r6(fusion.pack(f.join(chunks.select("chunk_id", "tokens"), "chunk_id")), "score")


def _quality(spark, d):
    items = table(spark, d, "eval_items")
    q = fulltext.parse_queries(items.select(F.col("item_id").alias("query_id"), "query"))
    res = fulltext.search(C.index(spark, d), q, 10)
    return metrics.evaluate(res, items.select(F.col("item_id").alias("query_id"), F.col("expected_paths").alias("paths")))


def retrieval_eval(spark, d):
    return _r6(_quality(spark, d), "reciprocal", "duplicate_rate")


def retrieval_summary(spark, d):
    return _r6(metrics.summarize(_quality(spark, d)), "recall", "mrr", "duplicate_rate")


# oracle text

_STOP = ", ".join(map(repr, fulltext.STOPWORDS))
_VERB = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fulltext.VERBS.items())


def _prefix_sql(src: str) -> str:
    return rf"""
q_run AS (SELECT query_id, list_filter(regexp_extract_all(coalesce(query, ''), '[\p{{L}}\p{{N}}$]+'), lambda t: length(t) > 1 AND lower(t) NOT IN ({_STOP})) AS r FROM {src}),
q_map AS (SELECT query_id, list_transform(r, lambda t: CASE lower(t) {_VERB} ELSE t END) AS r FROM q_run),
q_pos AS (SELECT query_id, unnest(r) AS t, generate_subscripts(r, 1) AS i FROM q_map),
q_first AS (SELECT query_id, t, min(i) AS i FROM q_pos GROUP BY 1, 2),
q_n AS (SELECT query_id, t, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS n FROM q_first),
q_prefix AS (SELECT query_id, n, p AS prefix FROM (SELECT query_id, n, unnest(string_split({C.fold_sql('t')}, '$')) AS p FROM q_n) WHERE p <> '')"""


_POST = f"""
t_all AS (
  SELECT chunk_id, unnest({C.terms_sql('path')}) AS term, 4.0::DOUBLE AS w FROM v_chunk UNION ALL
  SELECT chunk_id, unnest({C.terms_sql('heading')}), 3.0 FROM v_chunk UNION ALL
  SELECT chunk_id, unnest({C.terms_sql('language')}), 1.5 FROM v_chunk UNION ALL
  SELECT chunk_id, unnest({C.terms_sql('body')}), 2.0 FROM v_chunk),
post AS (SELECT chunk_id, term, sum(w) AS tf FROM t_all GROUP BY 1, 2),
lens AS (SELECT chunk_id, len({C.terms_sql('path')}) + len({C.terms_sql('heading')}) + len({C.terms_sql('language')}) + len({C.terms_sql('body')}) AS dl FROM v_chunk)"""


def _search_sql(limit: int) -> str:
    return f"""{_POST},
pre AS (SELECT DISTINCT prefix FROM q_prefix),
vocab AS (SELECT DISTINCT term FROM post),
pt AS (SELECT prefix, term FROM pre JOIN vocab ON starts_with(term, prefix)),
ph AS (SELECT prefix, chunk_id, sum(tf) AS f FROM post JOIN pt USING (term) GROUP BY 1, 2),
pdf AS (SELECT prefix, greatest(ln(((SELECT count(*) FROM lens) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM ph GROUP BY 1),
s1 AS (SELECT prefix, chunk_id, idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM lens))) AS s FROM ph JOIN pdf USING (prefix) JOIN lens USING (chunk_id)),
s2 AS (SELECT query_id, chunk_id, sum(s) AS s FROM q_prefix JOIN s1 USING (prefix) GROUP BY 1, 2),
s3 AS (SELECT query_id, chunk_id, path, round(s * CASE WHEN starts_with(lower(path), 'tests/') OR contains(lower(path), '/__tests__/') OR contains(path, '.test.') THEN 0.8 WHEN kind = 'code' THEN 1.35 ELSE 1.0 END, 9) AS score FROM s2 JOIN v_chunk USING (chunk_id)),
s4 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s3),
s5 AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY r) AS b FROM s4 WHERE r <= {limit * 5}),
s6 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM s5 WHERE b = 1),
found AS (SELECT query_id, chunk_id, path, score, rank FROM s6 WHERE rank <= {limit})"""


_FTS = f"WITH {C.CHUNK_SQL},{_prefix_sql('query_logs')},{_search_sql(20)}"
_LITERAL = "(VALUES (1, 'Token token'), (2, 'token'), (3, 'stored ledger$cache'), (4, 'the of')) AS x(query_id, query)"
_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _cos(a: str, b: str) -> str:
    return f"{_COS.format(a=a, b=b)} / sqrt({_COS.format(a=a, b=a)} * {_COS.format(a=b, b=b)})"


def _rank_sql(out: str, stored: str, asked: str) -> str:
    """Paths by the cosine of stored (chunk_id, model, embedding) with asked (query_id, model, qe), bonus and threshold included."""
    return f"""
{out}_s AS (SELECT query_id, v.chunk_id, path, round(CASE WHEN sqrt({_COS.format(a='embedding', b='embedding')} * {_COS.format(a='qe', b='qe')}) > 0 THEN {_cos('embedding', 'qe')} ELSE 0.0 END
  + CASE WHEN regexp_matches(lower(path), '[^/.][^/]*\\.(ts|tsx|js|jsx|mjs|cjs|mts|cts|py|go|rs)$') THEN 0.05 ELSE 0.0 END, 9) AS score FROM {stored} v JOIN {asked} q USING (model) JOIN v_chunk USING (chunk_id) WHERE len(embedding) = len(qe)),
{out}_b AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, chunk_id) AS b FROM {out}_s WHERE score >= 0.3),
{out} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {out}_b WHERE b = 1)"""


def _expand_sql(out: str, seed: str, depth: int, limit: int) -> str:
    """Chunks near the chunks of seed (query_id, chunk_id) in the graph of GRAPH_SQL, which must stand before, with {out}_both."""
    return f"""
{out}_walk AS (SELECT query_id, 's' || chunk_id AS node_id, 0 AS depth FROM {seed} JOIN v_chunk USING (chunk_id) UNION SELECT query_id, b, depth + 1 FROM {out}_walk JOIN g_both ON a = node_id WHERE depth < {depth}),
{out}_near AS (SELECT w.query_id, n.ref_id AS chunk_id, min(depth) AS distance FROM {out}_walk w JOIN g_node n USING (node_id) WHERE n.type = 'symbol' AND depth > 0 AND NOT EXISTS (SELECT 1 FROM {seed} s WHERE s.query_id = w.query_id AND s.chunk_id = n.ref_id) GROUP BY 1, 2),
{out}_o AS (SELECT x.*, path, row_number() OVER (PARTITION BY query_id ORDER BY distance, path, chunk_id) AS r FROM {out}_near x JOIN v_chunk USING (chunk_id)),
{out}_b AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY r) AS b FROM {out}_o WHERE r <= {limit * 5}),
{out}_k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INTEGER) AS rank FROM {out}_b WHERE b = 1),
{out} AS (SELECT query_id, chunk_id, path, CAST(1.0 / (distance + 1) AS DOUBLE) AS score, rank FROM {out}_k WHERE rank <= {limit})"""


BOTH_SQL = "g_both AS (SELECT from_id AS a, to_id AS b FROM g_edge UNION SELECT to_id, from_id FROM g_edge)"


def _list_sql(name: str) -> str:
    return f"l_{name} AS (SELECT query_id, chunk_id, path, min(list_position) AS rank FROM chunk_hits WHERE list_name = '{name}' GROUP BY 1, 2, 3)"


def _fuse_sql(out: str, a: str, b: str, w1: float, w2: float) -> str:
    return f"""
{out}_e AS (SELECT query_id, chunk_id, path, rank, 0 AS l FROM {a} UNION ALL SELECT query_id, chunk_id, path, rank, 1 FROM {b}),
{out}_s AS (SELECT query_id, l, row_number() OVER (PARTITION BY query_id ORDER BY l) AS seat FROM (SELECT DISTINCT query_id, l FROM {out}_e)),
{out}_g AS (SELECT query_id, path, sum((CASE seat WHEN 1 THEN {w1} ELSE {w2} END)::DOUBLE / (60 + rank)) AS score, min(l * 1000000 + rank) AS f, arg_min(chunk_id, (l * 1000000 + rank) * 100000000000::HUGEINT + chunk_id) AS chunk_id,
  min(struct_pack(l := l, rank := rank, chunk_id := chunk_id)) AS o FROM {out}_e JOIN {out}_s USING (query_id, l) GROUP BY 1, 2),
{out} AS (SELECT query_id, path, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) AS rank FROM {out}_g)"""


_LISTS = f"{_list_sql('fts')}, {_list_sql('vector')}, {_list_sql('graph')}"
_FUSE1 = f"{_LISTS},{_fuse_sql('f1', 'l_fts', 'l_vector', 2.0, 1.0)}"
_FUSE2 = f"{_FUSE1},{_fuse_sql('f2', 'f1', 'l_graph', 1.0, 0.25)}"


def _pack_sql(src: str, limit: int, budget: int) -> str:
    return f"""
priced AS (SELECT f.query_id, f.chunk_id, f.path, f.score, f.rank, CAST(ceil(length(c.content) / 4.0) AS BIGINT) AS tokens,
  row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank) AS i FROM {src} f JOIN v_chunk c USING (chunk_id)),
walk AS (
  SELECT query_id, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS n, []::VARCHAR[] AS paths, NULL::BIGINT AS took FROM (SELECT DISTINCT query_id FROM priced)
  UNION ALL
  SELECT w.query_id, p.i, w.used + CASE WHEN w.n < {limit} AND w.used + p.tokens <= {budget} AND NOT list_contains(w.paths, p.path) THEN p.tokens ELSE 0 END,
    w.n + CASE WHEN w.n < {limit} AND w.used + p.tokens <= {budget} AND NOT list_contains(w.paths, p.path) THEN 1 ELSE 0 END,
    CASE WHEN w.n < {limit} AND w.used + p.tokens <= {budget} AND NOT list_contains(w.paths, p.path) THEN list_append(w.paths, p.path) ELSE w.paths END,
    CASE WHEN w.n < {limit} AND w.used + p.tokens <= {budget} AND NOT list_contains(w.paths, p.path) THEN p.i END
  FROM walk w JOIN priced p ON p.query_id = w.query_id AND p.i = w.i + 1),
packed AS (SELECT w.query_id, w.n AS position, p.chunk_id, p.path, p.score, p.tokens FROM walk w JOIN priced p ON p.query_id = w.query_id AND p.i = w.took)"""


_PACK = f"WITH RECURSIVE {C.CHUNK_SQL},{_FUSE2},{_pack_sql('f2', 10, 2000)}"
_EVAL = f"""WITH {C.CHUNK_SQL}, e_q AS (SELECT item_id AS query_id, query FROM eval_items),{_prefix_sql('e_q')},{_search_sql(10)},
e_r AS (SELECT query_id, count(*) AS n, count(DISTINCT path) AS d FROM found GROUP BY 1),
e_f AS (SELECT query_id, min(rank) AS first_rank FROM found JOIN (SELECT DISTINCT item_id AS query_id, unnest(expected_paths) AS path FROM eval_items) USING (query_id, path) GROUP BY 1),
quality AS (SELECT i.item_id AS query_id, coalesce(len(expected_paths), 0) > 0 AS evaluated, first_rank, coalesce(1.0 / first_rank, 0.0)::DOUBLE AS reciprocal,
  coalesce(first_rank <= 5, false) AS hit, coalesce(1 - d::DOUBLE / n, 0.0)::DOUBLE AS duplicate_rate FROM eval_items i LEFT JOIN e_r ON e_r.query_id = i.item_id LEFT JOIN e_f ON e_f.query_id = i.item_id)"""

QUERIES = {f.__name__: f for f in (fts_search, fts_terms, fts_search_repeated_term, fts_document_frequency, fts_lengths, fts_index_check, fts_orphans, fts_backfill, vector_search, vector_pairs, vector_boost_counts,
    embedding_dedup, embedding_pending, embedding_reuse, embedding_upsert, embed_offline, rrf_two_lists, rrf_with_graph, pack_budget, render_context, token_attribution, retrieval_metrics, hybrid_search, retrieval_eval, retrieval_summary)}
_LOCAL = "provider = 'local' AND model = (SELECT arg_max(model, created_at) FROM chunk_embeddings WHERE provider = 'local' AND split_part(model, ':', 1) = 'code-mini-64')"
SQL = {
    "fts_search": f"{_FTS} SELECT query_id, chunk_id, path, score, rank FROM found",
    "fts_terms": f"WITH {_prefix_sql('query_logs').lstrip()} SELECT query_id, n, prefix FROM q_prefix",
    "fts_search_repeated_term": f"WITH {C.CHUNK_SQL},{_prefix_sql(_LITERAL)},{_search_sql(20)} SELECT query_id, chunk_id, path, score, rank FROM found",
    "fts_document_frequency": f"WITH {C.CHUNK_SQL},{_POST} SELECT term, count(*) AS df, sum(tf) AS weight FROM post GROUP BY 1 ORDER BY df DESC, term LIMIT 200",
    "fts_lengths": f"WITH {C.CHUNK_SQL},{_POST} SELECT chunk_id, dl FROM lens",
    "fts_index_check": "SELECT 0::BIGINT AS missing, 2::BIGINT AS orphans, (SELECT count(*) - count(DISTINCT chunk_id) FROM chunks) AS repeated",
    "fts_orphans": "SELECT chunk_id, count(*) AS rows FROM chunks GROUP BY 1",
    "fts_backfill": "SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_embeddings WHERE chunk_id IS NOT NULL)",
    "vector_search": f"""WITH {C.CHUNK_SQL},{C.VECTOR_SQL},
v AS (SELECT chunk_id, embedding_id, provider || '/' || model AS model, embedding FROM v_vec),
q AS (SELECT model, embedding_id AS query_id, embedding AS qe FROM v WHERE embedding_id % 50 = 0),
{_rank_sql('t', 'v', 'q')}
SELECT query_id, path, chunk_id, score FROM t WHERE rank <= 20""",
    "vector_pairs": f"SELECT q.vec_id AS query_id, e.vec_id, e.label, round({_cos('e.embedding', 'q.embedding')}, 6) AS cosine FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 WHERE round({_cos('e.embedding', 'q.embedding')}, 6) >= 0.3",
    "vector_boost_counts": f"WITH {C.DOC_SQL} SELECT coalesce(regexp_matches(lower(path), '[^/.][^/]*\\.(ts|tsx|js|jsx|mjs|cjs|mts|cts|py|go|rs)$'), false) AS boosted, count(*) AS files FROM v_doc GROUP BY 1",
    "embedding_dedup": "SELECT chunk_id, provider, model, embedding_id, input_hash FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, provider, model ORDER BY (input_hash IS NOT NULL) DESC, created_at DESC NULLS LAST, embedding_id) AS rn FROM chunk_embeddings) WHERE rn = 1",
    "embedding_pending": f"SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_embeddings WHERE {_LOCAL})",
    "embedding_reuse": f"WITH k AS (SELECT input_hash, min(embedding_id) AS reused_from FROM chunk_embeddings WHERE {_LOCAL} AND input_hash IS NOT NULL GROUP BY 1) SELECT chunk_id, reused_from FROM (SELECT DISTINCT chunk_id, content_hash FROM chunks) LEFT JOIN k ON input_hash = content_hash",
    "embed_offline": f"SELECT DISTINCT chunk_id, CAST(64 AS INTEGER) AS dimensions, CAST(NULL AS VARCHAR) AS error FROM chunks JOIN documents ON doc_id = document_id WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_embeddings WHERE {_LOCAL})",
    "embedding_upsert": """WITH b AS (SELECT embedding_id, chunk_id, provider, model, input_hash, created_at, 0 AS n FROM chunk_embeddings
  UNION ALL SELECT embedding_id + 10000000, chunk_id, provider, model, 'new', created_at, 1 FROM chunk_embeddings WHERE provider = 'remote')
SELECT chunk_id, provider, model, embedding_id, input_hash FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, provider, model ORDER BY n DESC, created_at DESC NULLS LAST, embedding_id DESC) AS rn FROM b) WHERE rn = 1""",
    "rrf_two_lists": f"WITH {_FUSE1} SELECT query_id, path, chunk_id, round(score, 6) AS score, rank FROM f1",
    "rrf_with_graph": f"WITH {_FUSE2} SELECT query_id, path, chunk_id, round(score, 6) AS score, rank FROM f2",
    "pack_budget": f"{_PACK} SELECT query_id, position, chunk_id, path, round(score, 6) AS score, tokens FROM packed",
    "render_context": f"""{_PACK},
blk AS (SELECT query_id, position, '[source: ' || p.path || ':' || chunk_index || '-? | score: ' || printf('%.3f', score) || ']' || chr(10) || content AS b FROM packed p JOIN v_chunk USING (chunk_id))
SELECT query_id, sha256(string_agg(b, chr(10) || chr(10) ORDER BY position)) AS context_hash, length(string_agg(b, chr(10) || chr(10) ORDER BY position)) AS chars FROM blk GROUP BY 1""",
    "token_attribution": f"""{_PACK},
a AS (SELECT query_id, position, CAST(floor(1001 * tokens::DOUBLE / greatest(sum(tokens) OVER (PARTITION BY query_id), 1)) AS BIGINT) AS share, max(position) OVER (PARTITION BY query_id) AS last FROM packed)
SELECT query_id, position, CAST(share + CASE WHEN position = last THEN 1001 - sum(share) OVER (PARTITION BY query_id) ELSE 0 END AS BIGINT) AS share FROM a""",
    "retrieval_metrics": f"""{_PACK},
w AS (SELECT path, sum(CAST(ceil(length(content) / 4.0) AS BIGINT)) AS ft FROM v_chunk GROUP BY 1),
s AS (SELECT query_id, count(*) AS selected_files, coalesce(sum(ft), 0) AS full_tokens, sum(used) AS used_tokens FROM (SELECT query_id, path, sum(tokens) AS used FROM packed GROUP BY 1, 2) LEFT JOIN w USING (path) GROUP BY 1),
c AS (SELECT query_id, count(DISTINCT path) AS candidate_files FROM priced GROUP BY 1)
SELECT query_id, candidate_files, coalesce(selected_files, 0) AS selected_files, CAST(coalesce(full_tokens, 0) AS BIGINT) AS full_tokens, CAST(coalesce(used_tokens, 0) AS BIGINT) AS used_tokens,
  CAST(greatest(0, coalesce(full_tokens, 0) - coalesce(used_tokens, 0)) AS BIGINT) AS saved_tokens FROM c LEFT JOIN s USING (query_id)""",
    "hybrid_search": f"""WITH RECURSIVE {C.GRAPH_SQL}, {BOTH_SQL},{C.VECTOR_SQL},{_prefix_sql('query_logs')},{_search_sql(20)},
stored AS (SELECT chunk_id, model, embedding FROM v_vec WHERE {_LOCAL}),
asked AS (SELECT query_id, model, embedding AS qe FROM found JOIN stored USING (chunk_id) WHERE rank = 1),
{_rank_sql('n_all', 'stored', 'asked')},
n_vec AS (SELECT query_id, chunk_id, path, rank FROM n_all WHERE rank <= 20),
{_fuse_sql('f1', 'found', 'n_vec', 2.0, 1.0)},
seed AS (SELECT query_id, chunk_id FROM f1 WHERE rank <= 5),{_expand_sql('x', 'seed', 1, 15)},
{_fuse_sql('f2', 'f1', 'x', 1.0, 0.25)},{_pack_sql('f2', 10, 4000)}
SELECT query_id, position, chunk_id, path, round(score, 6) AS score, tokens FROM packed""",
    "retrieval_eval": f"{_EVAL} SELECT query_id, evaluated, first_rank, round(reciprocal, 6) AS reciprocal, hit, round(duplicate_rate, 6) AS duplicate_rate FROM quality",
    "retrieval_summary": f"""{_EVAL} SELECT count(*) AS cases, count(*) FILTER (evaluated) AS evaluated, round(count(*) FILTER (evaluated AND hit) / greatest(count(*) FILTER (evaluated), 1), 6) AS recall,
  round(coalesce(sum(reciprocal) FILTER (evaluated), 0) / greatest(count(*) FILTER (evaluated), 1), 6) AS mrr, round(avg(duplicate_rate), 6) AS duplicate_rate FROM quality""",
}
