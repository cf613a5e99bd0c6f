"""Queries p3_: what the last completed run has not yet covered."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.operators.changes import StateStore, latest_by
from lodewell.operators.vectors import active_model
from lodewell.session import checkpoint_folder
from lodewell.sources.tables import table

#: Parser versions whose output is still good.
PARSER_VERSIONS = ["oxc-v2", "native-v1", "fallback-v1"]
#: Provider and model; the model's version suffix is the one that the provider's newest vector bears.
PROVIDER, MODEL = "local", "code-mini-64"


def _key(stage: str, column: str):
    return F.concat(F.lit(stage + ":"), F.col(column).cast("string")).alias("key")


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, hash) of what completed runs have covered: parsed documents of a good parser version, embedded chunks of the active model."""
    runs = table(spark, sf_dir, "index_runs").filter("status = 'completed'").select("run_id")
    parsed = table(spark, sf_dir, "parsed_documents").select("document_id", "run_id", "content_hash", "parser_version", "parsed_at")
    parsed = parsed.join(runs, "run_id", "left_semi")
    parsed = latest_by(parsed, ["document_id"], [F.desc_nulls_last("parsed_at"), F.desc_nulls_last("run_id"), F.desc_nulls_last("content_hash"), F.desc_nulls_last("parser_version")])
    parsed = parsed.filter(F.col("parser_version").isin(PARSER_VERSIONS)).select(_key("parse", "document_id"), F.col("content_hash").alias("hash"))
    vectors = table(spark, sf_dir, "chunk_embeddings")
    vectors = vectors.filter((F.col("provider") == PROVIDER) & (F.col("model") == active_model(vectors, PROVIDER, MODEL))).select("chunk_id", "embedding_id", "input_hash", "created_at")
    vectors = latest_by(vectors, ["chunk_id"], [F.desc_nulls_last("created_at"), F.desc_nulls_last("embedding_id"), F.desc_nulls_last("input_hash")])
    return parsed.unionByName(vectors.select(_key("embed", "chunk_id"), F.col("input_hash").alias("hash")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to parse and chunks to embed again: what the committed state of completed runs does not cover.

    The state is committed from the tables, which tell of runs made elsewhere, to a store of its own in the shared folder; a
    pipeline keeps one store and commits to it after each run.
    """
    store = StateStore(spark, f"{checkpoint_folder(spark).rstrip('/')}/state-{uuid.uuid4().hex}")
    store.commit(completed(spark, sf_dir), "key", "hash")
    docs = table(spark, sf_dir, "documents").select(F.lit("parse").alias("stage"), F.col("doc_id").alias("record_id"), _key("parse", "doc_id"), F.col("content_hash").alias("hash"))
    chunks = table(spark, sf_dir, "chunks").select(F.lit("embed").alias("stage"), F.col("chunk_id").alias("record_id"), _key("embed", "chunk_id"), F.col("content_hash").alias("hash"))
    return store.select(docs.unionByName(chunks), "key", "hash").select("stage", "record_id").distinct()


P3_SQL = """
WITH pr AS (
  SELECT p.* FROM parsed_documents p WHERE run_id IN (SELECT run_id FROM index_runs WHERE status = 'completed')),
pl AS (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY parsed_at DESC NULLS LAST, run_id DESC NULLS LAST, content_hash DESC NULLS LAST, parser_version DESC NULLS LAST) AS rn FROM pr),
el AS (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST, embedding_id DESC NULLS LAST, input_hash DESC NULLS LAST) AS rn
  FROM chunk_embeddings WHERE provider = 'local' AND model = (SELECT arg_max(model, created_at) FROM chunk_embeddings WHERE provider = 'local' AND split_part(model, ':', 1) = 'code-mini-64'))
SELECT DISTINCT 'parse' AS stage, d.doc_id AS record_id
FROM documents d LEFT JOIN (SELECT * FROM pl WHERE rn = 1) s ON s.document_id = d.doc_id
WHERE d.content_hash IS NOT NULL
  AND NOT coalesce(lower(s.content_hash) = lower(d.content_hash) AND s.parser_version IN ('oxc-v2', 'native-v1', 'fallback-v1'), false)
UNION ALL
SELECT DISTINCT 'embed', c.chunk_id
FROM chunks c LEFT JOIN (SELECT * FROM el WHERE rn = 1) s ON s.chunk_id = c.chunk_id
WHERE c.content_hash IS NOT NULL AND NOT coalesce(lower(s.input_hash) = lower(c.content_hash), false)
"""

QUERIES = {"p3_found": p3_found}
SQL = {"p3_found": P3_SQL}
