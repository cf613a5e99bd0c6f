"""Vector ranking over stored embeddings, and their upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodewell.functions.languages import is_boosted
from lodewell.operators.changes import latest_by

#: Least score, tested after the bonus, and the bonus of code files; rows of an embedding batch.
LEAST, BONUS, BATCH = 0.3, 0.05, 50


def usable(v: F.Column, dimensions: F.Column) -> F.Column:
    """Whether a stored vector has its dimensions, all finite."""
    return v.isNotNull() & (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def has_embeddings(embeddings: DataFrame, provider: str, model: str) -> bool:
    """Whether any row of the pair exists: one row is read."""
    return not embeddings.filter((F.col("provider") == provider) & (F.col("model") == model)).select(F.lit(1)).limit(1).isEmpty()


def active_model(embeddings: DataFrame, provider: str, base: str) -> str:
    """The stored name, version suffix included, that the newest vector of a provider's model bears; the base itself if there is none.

    Vectors under another suffix were made for another form of input and do not count.
    """
    mine = embeddings.filter((F.col("provider") == provider) & (F.split_part("model", F.lit(":"), F.lit(1)) == base))
    name = mine.agg(F.max_by("model", F.struct("created_at", "model"))).first()[0]  # one row
    return base if name is None else name


#: Queries that are compared at once; more are taken block by block, each against all candidates.
AT_ONCE = 2_000


def compared(candidates: DataFrame, queries: DataFrame, keep: Callable[[pd.DataFrame], pd.DataFrame] | None, least: float, bonus: bool) -> DataFrame:
    """(query_id, chunk_id, path, score) of candidates (chunk_id, path, model, embedding) against queries (query_id, model, embedding).

    Score is the cosine, plus BONUS for code where asked; those below least are left out. Candidates stay where they are read; a
    block of AT_ONCE queries is broadcast to them. keep cuts what a task has found so far, whenever it has grown.
    """
    spark = candidates.sparkSession
    q = queries.select("query_id", "model", "embedding").filter("embedding is not null")
    blocks = max(1, -(-q.count() // AT_ONCE))
    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, chunk_id {candidates.schema['chunk_id'].dataType.simpleString()}, path string, score double"
    rows = candidates.select("chunk_id", "path", "model", "embedding", (F.when(is_boosted(F.col("path")), BONUS) if bonus else F.lit(0.0)).alias("more")).fillna(0.0, ["more"])
    out = None
    for i in range(blocks):
        part = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toPandas()
        asked = {}
        for m, g in part.groupby("model", dropna=False):
            for d, h in g.groupby(g["embedding"].map(len)):
                e = np.stack(list(h["embedding"])).astype(np.float64)
                norm = np.linalg.norm(e, axis=1, keepdims=True)
                asked[m, d] = h["query_id"].to_numpy(), e / np.where(norm > 0, norm, np.inf)
        shared = spark.sparkContext.broadcast(asked)  # AT_ONCE vectors on average

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held, size = [], 0
            for f in frames:
                for (m, d), g in f.groupby(["model", f["embedding"].map(lambda e: -1 if e is None else len(e))], dropna=False, sort=False):
                    if (m, d) not in shared.value:
                        continue
                    ids, e = shared.value[m, d]
                    x = np.stack(list(g["embedding"])).astype(np.float64)
                    norm = np.linalg.norm(x, axis=1, keepdims=True)
                    s = np.round(x / np.where(norm > 0, norm, np.inf) @ e.T + g["more"].to_numpy()[:, None], 9)
                    i, j = np.nonzero(s >= least)
                    held.append(pd.DataFrame({"query_id": ids[j], "chunk_id": g["chunk_id"].to_numpy()[i], "path": g["path"].to_numpy()[i], "score": s[i, j]}))
                    size += len(i)
                if size > 200_000:
                    mine, held = pd.concat(held), []
                    if keep is None:
                        yield mine
                        size = 0
                    else:
                        held, size = [keep(mine)], 0
            if held:
                yield keep(pd.concat(held)) if keep else pd.concat(held)

        found = rows.mapInPandas(run, kinds)
        out = found if out is None else out.unionByName(found)
    return out


def rank(candidates: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, chunk_id, path, score, rank): the limit best paths of each query, each by its best chunk; see compared.

    LEAST is asked of the score with its bonus. Ties go to the smaller chunk_id. A task hands on at most limit rows a query.
    """

    def keep(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True], kind="stable").drop_duplicates(["query_id", "path"])
        return f[f.groupby("query_id").cumcount() < limit]

    best = latest_by(compared(candidates, queries, keep, LEAST, True), ["query_id", "path"], [F.desc("score"), F.asc("chunk_id")])
    top = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    return top.filter(F.col("rank") <= limit)


def dedup(embeddings: DataFrame) -> DataFrame:
    """One row of each (chunk_id, provider, model): with an input_hash before without, then the newest, then the smallest id."""
    return latest_by(embeddings, ["chunk_id", "provider", "model"], [F.desc(F.col("input_hash").isNotNull()), F.desc_nulls_last("created_at"), F.asc("embedding_id")])


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with new put in its place by (chunk_id, provider, model): the last of new wins."""
    both = stored.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)))
    return latest_by(both, ["chunk_id", "provider", "model"], [F.desc("__n"), F.desc_nulls_last("created_at"), F.desc("embedding_id")]).drop("__n")


def to_embed(chunks: DataFrame, embeddings: DataFrame, provider: str, model: str) -> DataFrame:
    """Chunks without a vector of the pair."""
    have = embeddings.filter((F.col("provider") == provider) & (F.col("model") == model)).select("chunk_id")
    return chunks.join(have, "chunk_id", "left_anti")


def reuse(pending: DataFrame, embeddings: DataFrame, provider: str, model: str) -> DataFrame:
    """pending (with input_hash) joined with a stored vector of equal input: the one of the smallest id."""
    s = embeddings.filter((F.col("provider") == provider) & (F.col("model") == model) & F.col("input_hash").isNotNull())
    known = s.groupBy("input_hash").agg(F.min_by("embedding", "embedding_id").alias("embedding"), F.min("embedding_id").alias("reused_from"))
    return pending.join(known, "input_hash", "left")


def hashing_embedder(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic offline embedder: signed hashed words, summed and normed."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dimensions] += 1.0 if h & 0x10000 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def embed(pending: DataFrame, provider: Callable[[list[str]], np.ndarray], text: str = "input", key: str = "chunk_id") -> DataFrame:
    """(key, embedding, error): vectors from a provider called with at most BATCH texts at once.

    A batch whose answer has another count, no dimensions, unequal lengths or numbers that are not finite fails
    whole: its rows carry the error and no vector, the other batches go on.
    """
    rows = pending.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), BATCH):
                part = f.iloc[lo : lo + BATCH]
                try:
                    v = [np.asarray(x, np.float32) for x in provider(list(part["t"].fillna("")))]
                    if len(v) != len(part):
                        raise ValueError("count")
                    if not len(v[0]) or len({len(x) for x in v}) > 1:
                        raise ValueError("dimensions")
                    if not all(np.isfinite(x).all() for x in v):
                        raise ValueError("not finite")
                    yield pd.DataFrame({"k": part["k"], "embedding": v, "error": None})
                except Exception as e:  # a failing batch is reported, not raised
                    yield pd.DataFrame({"k": part["k"], "embedding": None, "error": str(e) or type(e).__name__})

    return rows.mapInPandas(run, f"k {rows.schema['k'].dataType.simpleString()}, embedding array<float>, error string").withColumnRenamed("k", key)
