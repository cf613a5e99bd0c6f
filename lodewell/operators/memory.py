"""Versioned notes: writing, the active ones, and two searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of a search and its default results.
TERMS, RESULTS = 8, 10


def write(memories: DataFrame, rows: DataFrame) -> DataFrame:
    """memories and rows; a row whose supersedes_id names no memory raises when it is computed. tags are joined by commas."""
    known = memories.select(F.col("memory_id").alias("__k"))
    r = rows.join(known, F.col("supersedes_id") == F.col("__k"), "left")
    ok = F.col("supersedes_id").isNull() | F.col("__k").isNotNull()
    r = r.withColumn("memory_id", F.when(ok, F.col("memory_id")).otherwise(F.raise_error(F.concat(F.lit("no memory "), F.col("supersedes_id").cast("string"))).cast("bigint"))).drop("__k")
    kind = dict(r.dtypes)["tags"]
    r = r.withColumn("tags", F.array_join("tags", ",")) if kind.startswith("array") else r
    return memories.unionByName(r)


def active(memories: DataFrame) -> DataFrame:
    """Memories that no other supersedes."""
    newer = memories.filter("supersedes_id is not null").select(F.col("supersedes_id").alias("memory_id"))
    return memories.join(newer, "memory_id", "left_anti")


def page(memories: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Active memories, latest update first."""
    return active(memories).orderBy(F.desc("updated_at"), F.desc("created_at"), "memory_id").offset(offset).limit(limit)


def search(memories: DataFrame, text: str, limit: int = RESULTS, tags: bool = True) -> DataFrame:
    """Active memories that contain every term of text (TERMS at most, lower case, distinct) in title, content or tags.

    Order: title equal to the phrase, title containing it, the rest; then the latest update. tags=False leaves tags out
    and gives page() for a blank text; with tags a blank text gives nothing.
    """
    phrase = " ".join(text.lower().split())
    terms = list(dict.fromkeys(phrase.split()))[:TERMS]
    if not terms:
        return active(memories).filter("false") if tags else page(memories, limit)
    m = active(memories)
    for t in terms:
        hit = F.lower("title").contains(t) | F.lower("content").contains(t)
        m = m.filter(F.coalesce(hit | F.lower("tags").contains(t) if tags else hit, F.lit(False)))
    order = F.when(F.lower("title") == phrase, 0).when(F.lower("title").contains(phrase), 1).otherwise(2)
    return m.withColumn("place", order).orderBy("place", F.desc("updated_at"), F.desc("created_at"), "memory_id").limit(limit)
