"""The tables as the operators want them, once for Spark and once as text for the oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.functions import languages as lang
from lodewell.functions.text import ACCENTED, FOLDED, search_text
from lodewell.operators import fulltext
from lodewell.session import checkpoint_folder, stamps
from lodewell.sources.tables import table


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with forward slashes in paths and kind and language by extension."""
    docs = table(spark, d, "documents").withColumn("path", F.translate("path", "\\", "/"))
    return docs.withColumn("kind", lang.kind(F.col("path"))).withColumn("language", lang.language(F.col("path")))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Distinct chunks with their document's path, kind and language; body is what the index reads."""
    c = table(spark, d, "chunks").select("chunk_id", "document_id", "chunk_index", "heading", "content", "metadata").dropDuplicates(["chunk_id"])
    docs = documents(spark, d).select(F.col("doc_id").alias("document_id"), "path", "kind", "language")
    return c.join(docs, "document_id").withColumn("body", search_text(F.col("metadata"), F.col("content")))


_indexes: dict[tuple, fulltext.Index] = {}


def index(spark: SparkSession, d: str) -> fulltext.Index:
    """The index over the chunks of a folder, written once per session to the shared folder and then read.

    It is made anew when files of the tables it is built from have changed.
    """
    key = (spark.sparkContext.applicationId, d, stamps(table(spark, d, "chunks"), table(spark, d, "documents")))
    if key not in _indexes:
        _indexes[key] = fulltext.save(fulltext.build(chunks(spark, d)), f"{checkpoint_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
    return _indexes[key]


def hits(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One list of chunk_hits as (query_id, chunk_id, path, rank)."""
    h = table(spark, d, "chunk_hits").filter(F.col("list_name") == name)
    return h.groupBy("query_id", "chunk_id", "path").agg(F.min("list_position").alias("rank"))


def vectors(spark: SparkSession, d: str, which: Column | None = None) -> DataFrame:
    """The newest usable vector of each (chunk_id, provider, model); which restricts provider and model at the scan."""
    from lodewell.operators.changes import latest_by
    from lodewell.operators.vectors import usable

    v = table(spark, d, "chunk_embeddings")
    v = (v if which is None else v.filter(which)).filter(usable(F.col("embedding"), F.col("dimensions")))
    return latest_by(v, ["chunk_id", "provider", "model"], [F.desc("created_at"), F.desc("embedding_id")])


def memories(spark: SparkSession, d: str) -> DataFrame:
    """Logged queries as notes: every fifth supersedes the one seven before."""
    q = table(spark, d, "query_logs")
    return q.select(F.col("query_id").alias("memory_id"), F.col("query").alias("title"), F.concat_ws(" ", "mode", F.col("workspace_id")).alias("content"), F.coalesce("mode", F.lit("")).alias("tags"),
        F.when((F.col("query_id") % 5 == 0) & (F.col("query_id") > 7), F.col("query_id") - 7).alias("supersedes_id"), F.col("created_at"), F.col("created_at").alias("updated_at"))


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files and their chunks as symbols; a file defines its symbols and imports the workspace's next file."""
    from pyspark.sql import Window

    docs = documents(spark, d).select("doc_id", "path", "workspace_id", "created_at")
    c = chunks(spark, d).select("chunk_id", "document_id", "path")
    files = docs.select(F.concat(F.lit("f"), "doc_id").alias("node_id"), F.lit("file").alias("type"), F.col("path").alias("label"), F.lit(None).cast("bigint").alias("ref_id"), "created_at")
    syms = c.select(F.concat(F.lit("s"), "chunk_id").alias("node_id"), F.lit("symbol").alias("type"), F.concat(F.col("path"), F.lit("#"), "chunk_id").alias("label"), F.col("chunk_id").alias("ref_id"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    defines = c.select(F.concat(F.lit("f"), "document_id").alias("from_id"), F.concat(F.lit("s"), "chunk_id").alias("to_id"), F.lit("defines").alias("type"))
    nxt = docs.withColumn("n", F.lead("doc_id").over(Window.partitionBy("workspace_id").orderBy("doc_id"))).filter("n is not null")
    imports = nxt.select(F.concat(F.lit("f"), "doc_id").alias("from_id"), F.concat(F.lit("f"), "n").alias("to_id"), F.lit("imports").alias("type"))
    e = defines.unionByName(imports)
    return files.unionByName(syms), e.withColumn("edge_id", F.concat_ws("-", "from_id", "to_id", "type"))


_EXT = r"lower(regexp_extract(path, '[^/\\.][^/\\]*\.([^./\\]*)$', 1))"


def _case(names: dict[str, str]) -> str:
    return " ".join(f"WHEN e IN ({', '.join(repr(x) for x in names if names[x] == n)}) THEN '{n}'" for n in dict.fromkeys(names.values()))


#: v_doc: documents with path, kind and language; v_chunk: their distinct chunks.
DOC_SQL = f"""
v_path AS (SELECT * REPLACE (translate(path, chr(92), '/') AS path) FROM documents),
v_ext AS (SELECT *, {_EXT} AS e FROM v_path),
v_doc AS (SELECT * EXCLUDE (kind, language, e),
  CASE WHEN path IS NULL THEN NULL WHEN e IN ({', '.join(map(repr, lang.MARKDOWN))}) THEN 'markdown' WHEN e IN ({', '.join(map(repr, lang.CODE))}) THEN 'code' WHEN e IN ({', '.join(map(repr, lang.CONFIG))}) THEN 'config' ELSE 'text' END AS kind,
  coalesce(CASE {_case(lang.CODE | lang.CONFIG | lang.MARKDOWN)} END, nullif(e, '')) AS language FROM v_ext)"""
CHUNK_SQL = f"""{DOC_SQL},
v_c AS (SELECT DISTINCT ON (chunk_id) chunk_id, document_id, chunk_index, heading, content, metadata FROM chunks),
v_chunk AS (SELECT c.*, d.path, d.kind, d.language,
  CASE WHEN json_valid(metadata) AND json_type(metadata, '$.searchText') = 'VARCHAR' AND trim(json_extract_string(metadata, '$.searchText')) <> ''
    THEN trim(json_extract_string(metadata, '$.searchText')) || chr(10) || coalesce(content, '') ELSE coalesce(content, '') END AS body
  FROM v_c c JOIN v_doc d ON d.doc_id = c.document_id)"""


def fold_sql(x: str) -> str:
    return f"translate(lower(coalesce({x}, '')), '{ACCENTED}', '{FOLDED}')"


def terms_sql(x: str) -> str:
    return rf"regexp_extract_all({fold_sql(x)}, '[\p{{L}}\p{{N}}]+')"


GRAPH_SQL = f"""{CHUNK_SQL},
g_node AS (
  SELECT 'f' || doc_id AS node_id, 'file' AS type, path AS label, NULL::BIGINT AS ref_id, created_at FROM v_doc
  UNION ALL SELECT 's' || chunk_id, 'symbol', path || '#' || chunk_id, chunk_id, NULL FROM v_chunk),
g_next AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY workspace_id ORDER BY doc_id) AS n FROM v_doc),
g_e AS (
  SELECT 'f' || document_id AS from_id, 's' || chunk_id AS to_id, 'defines' AS type FROM v_chunk
  UNION ALL SELECT 'f' || doc_id, 'f' || n, 'imports' FROM g_next WHERE n IS NOT NULL),
g_edge AS (SELECT *, from_id || '-' || to_id || '-' || type AS edge_id FROM g_e)"""
MEMORY_SQL = """
v_memory AS (SELECT query_id AS memory_id, query AS title, concat_ws(' ', mode, workspace_id) AS content, coalesce(mode, '') AS tags,
  CASE WHEN query_id % 5 = 0 AND query_id > 7 THEN query_id - 7 END AS supersedes_id, created_at, created_at AS updated_at FROM query_logs),
v_active AS (SELECT * FROM v_memory m WHERE NOT EXISTS (SELECT 1 FROM v_memory n WHERE n.supersedes_id = m.memory_id))"""
VECTOR_SQL = """
v_vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, provider, model ORDER BY created_at DESC, embedding_id DESC) AS rn FROM chunk_embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = dimensions AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) WHERE rn = 1)"""
