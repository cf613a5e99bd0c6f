"""Usage metrics, listings, and evaluation of retrieval quality."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodewell.operators.changes import latest_by

HIT_AT = 5


def query_totals(logs: DataFrame) -> DataFrame:
    """One row: queries, token and file sums, and the rounded mean of saved tokens (0 without queries)."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    t = logs.agg(F.count(F.lit(1)).alias("queries"), s("tokens_returned").alias("tokens_returned"), s("tokens_saved").alias("tokens_saved"), s("files_scanned").alias("files_scanned"))
    return t.withColumn("average_saved", F.when(F.col("queries") > 0, F.floor(F.col("tokens_saved") / F.col("queries") + 0.5)).otherwise(0).cast("bigint"))


def recent(rows: DataFrame, by: str, key: str, limit: int) -> DataFrame:
    """The latest rows."""
    return rows.orderBy(F.desc_nulls_last(by), key).limit(limit)


def latest_run(runs: DataFrame) -> DataFrame:
    return recent(runs, "started_at", "run_id", 1)


def counts(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


def document_page(documents: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    return documents.orderBy(F.desc("updated_at"), "path", "doc_id").offset(offset).limit(limit)


def workspace_listing(workspaces: DataFrame) -> DataFrame:
    """Pinned workspaces first, latest pin order first, then the newest."""
    return workspaces.orderBy(F.desc(F.col("pinned_at").isNotNull()), F.desc_nulls_last("pin_order"), F.desc_nulls_last("pinned_at"), F.desc("created_at"), "workspace_id")


def backfill_pin_order(workspaces: DataFrame) -> DataFrame:
    """Numbers pinned workspaces without an order after the greatest, earliest pin first."""
    top = workspaces.agg(F.coalesce(F.max("pin_order"), F.lit(0)).alias("__top"))
    todo = F.col("pinned_at").isNotNull() & F.col("pin_order").isNull()
    rank = F.row_number().over(Window.partitionBy(todo).orderBy(F.desc("pinned_at"), "workspace_id"))
    w = workspaces.withColumn("__n", rank).join(F.broadcast(top))  # one row
    return w.withColumn("pin_order", F.when(todo, F.col("__top") + F.col("__n")).otherwise(F.col("pin_order")).cast("bigint")).drop("__n", "__top")


def retrieval_metrics(packed: DataFrame, candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, selected_files, candidate_files, full_tokens, used_tokens, saved_tokens).

    Full tokens are those of all chunks of the selected paths, used ones those of the packed sources.
    """
    whole = chunks.groupBy("path").agg(F.sum("token_count").alias("file_tokens"))
    sel = packed.groupBy("query_id", "path").agg(F.sum("tokens").alias("used")).join(whole, "path", "left")
    sel = sel.groupBy("query_id").agg(F.count(F.lit(1)).alias("selected_files"), F.coalesce(F.sum("file_tokens"), F.lit(0)).alias("full_tokens"), F.sum("used").alias("used_tokens"))
    cand = candidates.groupBy("query_id").agg(F.countDistinct("path").alias("candidate_files"))
    out = cand.join(sel, "query_id", "left").fillna(0, ["selected_files", "full_tokens", "used_tokens"])
    return out.withColumn("saved_tokens", F.greatest(F.lit(0), F.col("full_tokens") - F.col("used_tokens")))


def parse_cases(text: str) -> list[tuple[str, list[str]]]:
    """Evaluation cases of a JSON array: a query, or an object with query and expectedPaths."""
    out = []
    for case in json.loads(text):
        if isinstance(case, str):
            out.append((case, []))
        elif isinstance(case, dict) and isinstance(case.get("query"), str):
            out.append((case["query"], [str(p) for p in case.get("expectedPaths") or []]))
        else:
            raise ValueError(f"no evaluation case: {case!r}")
    return out


def evaluate(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, evaluated, first_rank, reciprocal, hit, duplicate_rate).

    results: query_id, path, rank; expected: query_id, paths array<string>, one row per query. A query without expected
    paths is not evaluated; its duplicate rate still counts. A query without results has rate 0 and no rank.
    """
    r = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("d"))
    want = expected.select("query_id", F.explode("paths").alias("path")).distinct()
    first = results.join(want, ["query_id", "path"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    e = expected.select("query_id", (F.coalesce(F.size("paths"), F.lit(0)) > 0).alias("evaluated")).join(r, "query_id", "left").join(first, "query_id", "left")
    return e.select("query_id", "evaluated", "first_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal"),
        F.coalesce(F.col("first_rank") <= HIT_AT, F.lit(False)).alias("hit"), F.coalesce(1 - F.col("d") / F.col("n"), F.lit(0.0)).alias("duplicate_rate"))


def summarize(quality: DataFrame) -> DataFrame:
    """One row: cases, evaluated ones, recall at HIT_AT, mean reciprocal rank, mean duplicate rate."""
    ev = F.col("evaluated")
    n = F.greatest(F.sum(ev.cast("int")), F.lit(1))
    return quality.agg(F.count(F.lit(1)).alias("cases"), F.sum(ev.cast("int")).cast("bigint").alias("evaluated"), (F.sum((ev & F.col("hit")).cast("int")) / n).alias("recall"),
        (F.sum(F.when(ev, F.col("reciprocal")).otherwise(0.0)) / n).alias("mrr"), F.avg("duplicate_rate").alias("duplicate_rate"))


def last_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key, the first by order."""
    return latest_by(rows, keys, order)
