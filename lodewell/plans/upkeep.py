"""Queries of incremental maintenance, notes, metrics, listings and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewell.operators import memory, metrics, upkeep
from lodewell.plans import corpus as C
from lodewell.sources.tables import table
from lodewell.streaming import watch

KEY = "000102030405060708090a0b0c0d0e0f"


def _state(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "content_hash", "size_bytes", "mtime_ms")
    k = F.col("path") % 7
    stored = docs.filter(k != 0)
    scanned = docs.filter(k != 1).withColumn("mtime_ms", F.when(k >= 4, F.col("mtime_ms") + 5).otherwise(F.col("mtime_ms"))).withColumn("content_hash", F.when(k >= 5, F.sha2(F.col("path").cast("string"), 256)).otherwise(F.upper("content_hash")))
    return stored, scanned


def index_diff(spark, d):
    """A simulated scan after which files were added, deleted, touched and changed."""
    return upkeep.diff(*_state(spark, d))


def index_to_read(spark, d):
    return upkeep.to_read(*_state(spark, d)).select("path")


def replace_artifacts(spark, d):
    ch = table(spark, d, "chunks").select("chunk_id", "document_id").distinct()
    changed = ch.filter("document_id % 3 = 0").select("document_id")
    new = changed.distinct().select((F.col("document_id") * -1).alias("chunk_id"), "document_id")
    return upkeep.replace_rows(ch, new, changed, "document_id")


def update_partial(spark, d):
    w = table(spark, d, "workspaces").select("workspace_id", "name", "status")
    return upkeep.update_columns(w, w.filter("status = 'ready'").select("workspace_id", F.upper("name").alias("name"), F.lit(None).cast("string").alias("status")), "workspace_id")


def _nodes(spark, d):
    docs = C.documents(spark, d).groupBy("path").agg(F.min("doc_id").alias("doc_id"))
    stored = docs.filter("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("node_id"), F.lit("file").alias("type"), F.col("path").alias("label"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).alias("ref_id"), F.lit("old").alias("metadata"))
    new = docs.filter("doc_id % 2 = 0").select(F.concat(F.lit("n"), "doc_id").alias("node_id"), F.lit("file").alias("type"), F.col("path").alias("label"), F.when(F.col("doc_id") % 4 == 0, F.lit("r")).alias("ref_id"), F.lit("new").alias("metadata"))
    return stored, new


def upsert_nodes(spark, d):
    return upkeep.upsert_nodes(*_nodes(spark, d))


def insert_ignore(spark, d):
    e = C.graph(spark, d)[1].select("from_id", "to_id", "type", "edge_id")
    stored = e.filter("type = 'defines'")
    new = e.withColumn("edge_id", F.concat("edge_id", F.lit("-x")))
    return upkeep.insert_ignore(stored, new, ["from_id", "to_id", "type"], [F.asc("edge_id")])


def delete_cascade(spark, d):
    docs = table(spark, d, "documents").filter("doc_id % 5 = 0").select("doc_id")
    ch = table(spark, d, "chunks").select("chunk_id", "document_id")
    em = table(spark, d, "chunk_embeddings").select("embedding_id", "chunk_id")
    a, b = upkeep.delete_cascade(docs, [(ch, "document_id", "chunk_id"), (em, "chunk_id", "embedding_id")])
    return a.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("chunks").alias("name"), "rows").unionByName(b.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("embeddings").alias("name"), "rows"))


def sealed_settings(spark, d):
    """Settings sealed and opened again; what a wrong key cannot open is left out."""
    s = table(spark, d, "workspaces").select(F.concat_ws("_", "workspace_id", F.lit("api_key")).alias("key"), F.col("name").alias("value")).unionByName(table(spark, d, "workspaces").select(F.concat_ws("_", "workspace_id", F.lit("theme")).alias("key"), F.col("name").alias("value")))
    sealed = upkeep.seal_settings(s, KEY)
    lost = upkeep.open_settings(sealed, KEY[::-1]).select(F.concat(F.lit("wrong "), "key").alias("key"), "value")
    return upkeep.open_settings(sealed, KEY).unionByName(lost)


def lease_claims(spark, d):
    w = table(spark, d, "workspaces")
    leases = w.select("workspace_id", F.when(F.col("status") == "ready", F.lit("a")).alias("owner"), F.when(F.col("status") == "ready", F.col("index_generation")).alias("expires_at"))
    claims = w.select("workspace_id", F.lit("b").alias("owner"), F.lit(40).alias("at"), F.lit(100).alias("until"))
    return upkeep.claim(leases, claims)


def memory_active(spark, d):
    return memory.active(C.memories(spark, d)).select("memory_id", "title", "supersedes_id")


def memory_page(spark, d):
    return memory.page(C.memories(spark, d), 10, 5).select("memory_id", "title")


def memory_search(spark, d):
    return memory.search(C.memories(spark, d), "the  How", 10).select("memory_id", "title", "place")


def memory_search_plain(spark, d):
    return memory.search(C.memories(spark, d), "graph", 50, tags=False).select("memory_id", "title", "place")


def query_totals(spark, d):
    return metrics.query_totals(table(spark, d, "query_logs"))


def recent_queries(spark, d):
    return metrics.recent(table(spark, d, "query_logs"), "created_at", "query_id", 10).select("query_id", "query", "mode")


def recent_runs(spark, d):
    return metrics.recent(table(spark, d, "index_runs"), "started_at", "run_id", 10).select("run_id", "mode", "status")


def latest_run(spark, d):
    return metrics.latest_run(table(spark, d, "index_runs")).select("run_id", "status")


def table_counts(spark, d):
    return metrics.counts(**{n: table(spark, d, n) for n in ("documents", "chunks", "chunk_embeddings", "query_logs", "index_runs")})


def document_page(spark, d):
    return metrics.document_page(C.documents(spark, d), 10, 20).select("doc_id", "path")


def _pinned(spark, d):
    w = table(spark, d, "workspaces")
    return w.withColumn("pinned_at", F.when(F.col("status") == "ready", F.col("last_indexed_at"))).withColumn("pin_order", F.when(F.col("pinned_at").isNotNull() & (F.col("index_generation") % 2 == 0), F.col("index_generation").cast("bigint")))


def workspace_listing(spark, d):
    from pyspark.sql import Window

    w = metrics.backfill_pin_order(_pinned(spark, d))
    order = [F.desc(F.col("pinned_at").isNotNull()), F.desc_nulls_last("pin_order"), F.desc_nulls_last("pinned_at"), F.desc("created_at"), F.asc("workspace_id")]
    return metrics.workspace_listing(w).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("workspace_id", "pin_order", "place")


def pin_backfill(spark, d):
    return metrics.backfill_pin_order(_pinned(spark, d)).select("workspace_id", "pin_order")


def raw_sql(spark, d):
    """Any SQL over the tables, with parameters."""
    return spark.sql("SELECT source, count(*) AS files FROM {docs} WHERE size_bytes > ? GROUP BY source", args=[1000], docs=table(spark, d, "documents"))


def watch_debounce(spark, d):
    """Bursts of a user's events, closed by half an hour of quiet."""
    e = table(spark, d, "events").select(F.col("user_id").alias("workspace_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"))
    out = watch.debounce(e, "30 minutes")
    return out.select("workspace_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("settled_at").alias("settled_us"), "events", F.array_join("paths", ",").alias("paths"))


def watch_throttle(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("workspace_id"), F.col("ts").cast("timestamp").alias("ts"))
    return watch.throttle(e, 3600.0).select("workspace_id", "slot", F.unix_micros("run_at").alias("run_us"), "events")


_MEM = f"WITH {C.MEMORY_SQL}"
_STATE = """old AS (SELECT doc_id AS path, content_hash AS h, size_bytes AS s, mtime_ms AS m FROM documents WHERE doc_id % 7 <> 0),
new AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 >= 5 THEN sha256(CAST(doc_id AS VARCHAR)) ELSE upper(content_hash) END AS h, size_bytes AS s, CASE WHEN doc_id % 7 >= 4 THEN mtime_ms + 5 ELSE mtime_ms END AS m FROM documents WHERE doc_id % 7 <> 1)"""
_PIN = """p AS (SELECT *, CASE WHEN status = 'ready' THEN last_indexed_at END AS pinned_at FROM workspaces),
q AS (SELECT *, CASE WHEN pinned_at IS NOT NULL AND index_generation % 2 = 0 THEN CAST(index_generation AS BIGINT) END AS o FROM p),
b AS (SELECT *, CASE WHEN pinned_at IS NOT NULL AND o IS NULL THEN coalesce((SELECT max(o) FROM q), 0) + row_number() OVER (PARTITION BY pinned_at IS NOT NULL AND o IS NULL ORDER BY pinned_at DESC, workspace_id) ELSE o END AS pin_order FROM q)"""
QUERIES = {f.__name__: f for f in (index_diff, index_to_read, replace_artifacts, update_partial, upsert_nodes, insert_ignore, delete_cascade, sealed_settings, lease_claims, memory_active, memory_page, memory_search, memory_search_plain,
    query_totals, recent_queries, recent_runs, latest_run, table_counts, document_page, workspace_listing, pin_backfill, raw_sql, watch_debounce, watch_throttle)}
SQL = {
    "index_diff": f"""WITH {_STATE} SELECT coalesce(new.path, old.path) AS path, CASE WHEN new.path IS NULL THEN 'deleted' WHEN old.path IS NULL THEN 'new' WHEN coalesce(old.s = new.s AND old.m = new.m, false) THEN 'unchanged'
  WHEN coalesce(lower(old.h) = lower(new.h), false) THEN 'touched' ELSE 'changed' END AS change FROM old FULL JOIN new ON old.path = new.path""",
    "index_to_read": f"WITH {_STATE} SELECT new.path FROM new LEFT JOIN old ON old.path = new.path WHERE NOT coalesce(old.s = new.s AND old.m = new.m, false)",
    "replace_artifacts": "SELECT DISTINCT chunk_id, document_id FROM chunks WHERE document_id % 3 <> 0 UNION ALL SELECT DISTINCT -document_id, document_id FROM chunks WHERE document_id % 3 = 0",
    "update_partial": "SELECT workspace_id, CASE WHEN status = 'ready' THEN upper(name) ELSE name END AS name, status FROM workspaces",
    "upsert_nodes": f"""WITH {C.DOC_SQL}, d AS (SELECT path, min(doc_id) AS i FROM v_doc GROUP BY 1)
SELECT CASE WHEN i % 3 <> 0 THEN CAST(i AS VARCHAR) ELSE 'n' || i END AS node_id, 'file' AS type, path AS label,
  coalesce(CASE WHEN i % 4 = 0 THEN 'r' END, CASE WHEN i % 3 <> 0 AND i % 2 = 0 THEN CAST(i AS VARCHAR) END) AS ref_id, CASE WHEN i % 2 = 0 THEN 'new' ELSE 'old' END AS metadata FROM d WHERE i % 3 <> 0 OR i % 2 = 0""",
    "insert_ignore": f"WITH {C.GRAPH_SQL} SELECT from_id, to_id, type, CASE WHEN type = 'defines' THEN edge_id ELSE edge_id || '-x' END AS edge_id FROM g_edge",
    "delete_cascade": "SELECT 'chunks' AS name, count(*) AS rows FROM chunks WHERE document_id % 5 <> 0 UNION ALL SELECT 'embeddings', count(*) FROM chunk_embeddings WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE document_id % 5 = 0)",
    "sealed_settings": "SELECT workspace_id || '_api_key' AS key, name AS value FROM workspaces UNION ALL SELECT workspace_id || '_theme', name FROM workspaces UNION ALL SELECT 'wrong ' || workspace_id || '_theme', name FROM workspaces",
    "lease_claims": "SELECT workspace_id, CASE WHEN status = 'ready' AND coalesce(index_generation > 40, true) THEN CASE WHEN index_generation IS NULL THEN 'b' ELSE 'a' END ELSE 'b' END AS owner, CASE WHEN status = 'ready' AND index_generation > 40 THEN index_generation ELSE 100 END AS expires_at FROM workspaces",
    "memory_active": f"{_MEM} SELECT memory_id, title, supersedes_id FROM v_active",
    "memory_page": f"{_MEM} SELECT memory_id, title FROM v_active ORDER BY updated_at DESC, created_at DESC, memory_id LIMIT 10 OFFSET 5",
    "memory_search": f"""{_MEM}, m AS (SELECT *, CASE WHEN lower(title) = 'the how' THEN 0 WHEN contains(lower(title), 'the how') THEN 1 ELSE 2 END AS place FROM v_active
  WHERE (contains(lower(title), 'the') OR contains(lower(content), 'the') OR contains(lower(tags), 'the')) AND (contains(lower(title), 'how') OR contains(lower(content), 'how') OR contains(lower(tags), 'how')))
SELECT memory_id, title, place FROM m ORDER BY place, updated_at DESC, created_at DESC, memory_id LIMIT 10""",
    "memory_search_plain": f"""{_MEM}, m AS (SELECT *, CASE WHEN lower(title) = 'graph' THEN 0 WHEN contains(lower(title), 'graph') THEN 1 ELSE 2 END AS place FROM v_active WHERE contains(lower(title), 'graph') OR contains(lower(content), 'graph'))
SELECT memory_id, title, place FROM m ORDER BY place, updated_at DESC, created_at DESC, memory_id LIMIT 50""",
    "query_totals": """SELECT count(*) AS queries, CAST(coalesce(sum(tokens_returned), 0) AS BIGINT) AS tokens_returned, CAST(coalesce(sum(tokens_saved), 0) AS BIGINT) AS tokens_saved, CAST(coalesce(sum(files_scanned), 0) AS BIGINT) AS files_scanned,
  CAST(CASE WHEN count(*) > 0 THEN floor(coalesce(sum(tokens_saved), 0)::DOUBLE / count(*) + 0.5) ELSE 0 END AS BIGINT) AS average_saved FROM query_logs""",
    "recent_queries": "SELECT query_id, query, mode FROM query_logs ORDER BY created_at DESC NULLS LAST, query_id LIMIT 10",
    "recent_runs": "SELECT run_id, mode, status FROM index_runs ORDER BY started_at DESC NULLS LAST, run_id LIMIT 10",
    "latest_run": "SELECT run_id, status FROM index_runs ORDER BY started_at DESC NULLS LAST, run_id LIMIT 1",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in ("documents", "chunks", "chunk_embeddings", "query_logs", "index_runs")),
    "document_page": f"WITH {C.DOC_SQL} SELECT doc_id, path FROM v_doc ORDER BY updated_at DESC NULLS LAST, path, doc_id LIMIT 10 OFFSET 20",
    "workspace_listing": f"WITH {_PIN} SELECT workspace_id, pin_order, CAST(row_number() OVER (ORDER BY pinned_at IS NOT NULL DESC, pin_order DESC NULLS LAST, pinned_at DESC NULLS LAST, created_at DESC, workspace_id) AS INTEGER) AS place FROM b",
    "pin_backfill": f"WITH {_PIN} SELECT workspace_id, pin_order FROM b",
    "raw_sql": "SELECT source, count(*) AS files FROM documents WHERE size_bytes > 1000 GROUP BY source",
    "watch_debounce": """WITH e AS (SELECT user_id, ts, event_type, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id AS workspace_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS settled_us, count(*) AS events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM s GROUP BY user_id, k""",
    "watch_throttle": "SELECT user_id AS workspace_id, epoch_us(ts) // 3600000000 AS slot, epoch_us(min(ts)) AS run_us, count(*) AS events FROM events GROUP BY 1, 2",
}
