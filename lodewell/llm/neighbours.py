"""Most similar vectors for every vector: inverted lists scanned adaptively by column blocks.

Vectors are normed, so cosine order is distance order. A k-means index is fitted on a bounded sample of each group, every
vector is put on its `copies` nearest lists, and a list is compared with itself: rotated vectors are read in column blocks,
and a pair is abandoned as soon as its partial distance, scaled up to all dimensions, exceeds the bound of the current k-th
best by more than a hypothesis test allows. What survives is computed exactly. A list that the sample says to be long is cut
into blocks, and every two of them are a task of their own, so no task grows with the data.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewell.functions.text import cosine
from lodewell.operators.changes import latest_by
from lodewell.sources.tables import table

#: Vectors that the index is fitted on over all groups: half are dealt evenly to the groups that need lists, half by their size.
SAMPLE = 65_536
#: Vectors a list should hold on average, and the most lists of a group.
LIST_SIZE, MOST_LISTS = 400, 8_192
#: Lists that hold each vector and that it is compared within.
COPIES = 2
#: Entries of a block of a long list, and numbers in them, at most as the sample tells.
ENTRIES, NUMBERS = 16_384, 4_000_000
#: Columns of a block, and the slack of the abandoning test: (1 + SLACK / sqrt(columns)) on the distance.
BLOCK, SLACK = 16, 2.1
#: Vectors compared at once within a list; bounds a task's memory at TILE x TILE numbers.
TILE = 1_024
#: Vectors whose nearest lists are sought at once.
ASSIGNED = 512
#: A direction (decimals of the normed vector that agree) that more than HOT vectors and more than one in HOT_SHARE have is hot:
#: its vectors are answered by its first k + 1 and only these meet others in lists. Which are is told by the sample.
HOT, HOT_SHARE, DECIMALS = 1_000, 1_000, 4


@functools.lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    """The same random rotation of d dimensions everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k unit centroids of unit vectors; empty ones are dropped."""
    rng = np.random.default_rng(k)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(b @ c.T).argmax(1) for b in np.array_split(x, max(1, len(x) // 4096))])
        order = np.argsort(home, kind="stable")
        found, first = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = (sums / np.maximum(norm, 1e-12)).astype(np.float32)
        if len(found) < k:  # seats of empty lists go to random vectors
            c = np.concatenate([c, x[rng.choice(len(x), k - len(found), replace=False)]])
    return c


def unit(e: list[np.ndarray]) -> np.ndarray:
    """Vectors as rows of norm 1, computed in double."""
    x = np.stack(e).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scan_list(x: np.ndarray, ids: np.ndarray, k: int, floor: float, asks: np.ndarray, stands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, cosine): of each row in asks the k most similar other rows in stands at cosine >= floor.

    Ties (cosine rounded to 9 decimals) go to the smaller id.
    """
    n, d = x.shape
    turned = (x.astype(np.float32) @ rotation(d)).astype(np.float32)
    blocks = [slice(a, min(a + BLOCK, d)) for a in range(0, d, BLOCK)]
    norms = [np.einsum("ij,ij->i", turned[:, b], turned[:, b]) for b in blocks]
    bound = np.full(n, 2 - 2 * floor + 1e-6, np.float32)  # squared distance of the k-th best so far
    qa, qb, qc = [], [], []
    for lo in range(0, len(asks), TILE):
        rows = asks[lo : lo + TILE]
        best_a, best_b, best_c = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(stands), TILE):
            cols = stands[at : at + TILE]
            part = norms[0][rows][:, None] + norms[0][cols][None, :] - 2 * (turned[rows, blocks[0]] @ turned[cols, blocks[0]].T)
            seen = blocks[0].stop
            test = (bound[rows] * (seen / d) * (1 + SLACK / math.sqrt(seen)) ** 2)[:, None] if seen < d else bound[rows][:, None]
            i, j = np.nonzero(part <= test)
            keep = rows[i] != cols[j]
            dist, i, j = part[i, j][keep], rows[i[keep]], cols[j[keep]]
            for b, s in zip(blocks[1:], norms[1:], strict=True):
                if not len(i):
                    break
                dist = dist + s[i] + s[j] - 2 * np.einsum("ij,ij->i", turned[i, b], turned[j, b])
                seen = b.stop
                slack = (1 + SLACK / math.sqrt(seen)) ** 2 * seen / d if seen < d else 1 + 1e-5
                keep = dist <= bound[i] * slack + 1e-6
                dist, i, j = dist[keep], i[keep], j[keep]
            cos = np.round(np.einsum("ij,ij->i", x[i], x[j]), 9)
            keep = cos >= floor
            best_a, best_b, best_c = np.concatenate([best_a, i[keep]]), np.concatenate([best_b, j[keep]]), np.concatenate([best_c, cos[keep]])
            order = np.lexsort((ids[best_b], -best_c, best_a))
            best_a, best_b, best_c = best_a[order], best_b[order], best_c[order]
            first = np.searchsorted(best_a, best_a, "left")
            place = np.arange(len(best_a)) - first
            full = place == k - 1
            bound[best_a[full]] = np.minimum(bound[best_a[full]], (2 - 2 * best_c[full] + 1e-6).astype(np.float32))
            best_a, best_b, best_c = best_a[place < k], best_b[place < k], best_c[place < k]
        qa.append(best_a), qb.append(best_b), qc.append(best_c)
    return np.concatenate(qa), np.concatenate(qb), np.concatenate(qc)


def compare_list(ids: np.ndarray, e: list[np.ndarray], role: np.ndarray, k: int, floor: float) -> pd.DataFrame:
    """(a, b, cosine) in one list: for rows of role & 2 their most similar among rows of role & 1.

    Exact copies are compared once and then listed by smallest ids.
    """
    if not (role & 2).any():
        return pd.DataFrame({"a": ids[:0], "b": ids[:0], "cosine": np.empty(0)})
    x = unit(e)
    distinct, where = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_inverse=True)
    n = len(distinct)
    rep = np.zeros(n, np.int64)
    rep[where] = np.arange(len(where))

    def members(kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(role & kind)
        at = at[np.lexsort((ids[at], where[at]))]
        first = np.searchsorted(where[at], np.arange(n + 1))
        return at, first[:-1], np.diff(first)

    asked, ask_at, ask_n = members(2)
    stood, stand_at, stand_n = members(1)
    least = np.full(n, np.iinfo(np.int64).max)
    least[stand_n > 0] = ids[stood[stand_at[stand_n > 0]]]
    a, b, c = scan_list(x[rep], least, k, floor, np.flatnonzero(ask_n), np.flatnonzero(stand_n))
    several = np.flatnonzero((ask_n > 0) & (stand_n > 0) & (np.bincount(where, minlength=n) > 1))
    # a copy's own group first, then its neighbours' groups; of each the k + 1 smallest ids are enough
    a, b, c = np.concatenate([several, a]), np.concatenate([several, b]), np.concatenate([np.ones(len(several)), c])
    left, right = ask_n[a], np.minimum(stand_n[b], k + 1)
    pair = np.repeat(np.arange(len(a)), left * right)
    step = np.arange(len(pair)) - np.repeat(np.cumsum(left * right) - left * right, left * right)
    i, j = asked[ask_at[a[pair]] + step // right[pair]], stood[stand_at[b[pair]] + step % right[pair]]
    other = i != j
    pa, pb, pc = ids[i[other]], ids[j[other]], c[pair[other]]
    order = np.lexsort((pb, -pc, pa))
    pa, pb, pc = pa[order], pb[order], pc[order]
    keep = np.arange(len(pa)) - np.searchsorted(pa, pa, "left") < k
    return pd.DataFrame({"a": pa[keep], "b": pb[keep], "cosine": pc[keep]})


def _usable(e: str, n: str) -> Column:
    size = F.size(e)
    return (
        F.col(e).isNotNull()
        & (size == F.col(n))
        & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists(e, lambda v: v != 0)
    )


def _direction(e: str) -> Column:
    """A hash of the normed vector to DECIMALS, so that scaled copies agree; computed only where hot directions were seen."""
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.xxhash64(F.transform(e, lambda v: F.round(v.cast("double") / norm, DECIMALS) + F.lit(0.0)))


@dataclass
class Lists:
    """The lists of one group: centroids, and the blocks that each list is cut into."""

    centroids: np.ndarray
    blocks: np.ndarray


def fit(x: np.ndarray, n: int, copies: int, list_size: int) -> Lists:
    """Lists for a group of n vectors from a sample of unit vectors x."""
    lists = min(MOST_LISTS, max(1, len(x) // 8), max(1, math.ceil(n / list_size)))
    c = kmeans(x, lists) if lists > 1 else x[:1]
    r = min(copies, len(c))
    held = np.zeros(len(c))
    for b in np.array_split(x, max(1, len(x) // 4096)):
        held += np.bincount(np.argpartition(-(b @ c.T), r - 1, axis=1)[:, :r].ravel(), minlength=len(c))
    most = max(256, min(ENTRIES, NUMBERS // x.shape[1]))
    return Lists(c, np.maximum(np.ceil(held * n / len(x) / most), 1).astype(np.int32))


def similar_vectors(
    rows: DataFrame, groups: list[str], key: str = "embedding_id", vector: str = "embedding", k: int = 10, floor: float = -1.0, copies: int = COPIES, list_size: int | None = None, basis: DataFrame | None = None, valid: Column | None = None, wanted: Column | None = None
) -> DataFrame:
    """(key_a, key_b, cosine, position): for each vector its k most similar of the same group.

    rows has one usable vector per key (see latest_usable); vectors of a group have one length. Only pairs
    with cosine >= floor are sought; a floor makes both the abandoning test and the lists sharper. Cosine is
    exact, rounded to 9 decimals; ties go to the smaller key; a vector is not its own neighbour, but its
    copies are. A list holds list_size vectors on average. basis, rows that include all of `rows` and cost less to read, serves for the counts and the sample (of
    those that meet `valid`). wanted, a condition on key, asks for some rows' neighbours only; all rows lie in the same lists
    whoever asks. Recall depends on copies and list size and is measured in the tests. An empty input, or
    a group of one vector, gives no rows. Null group values form a group.
    """
    spark, list_size = rows.sparkSession, list_size or LIST_SIZE
    every = rows if basis is None else basis
    group = F.xxhash64(*[F.struct(F.col(g).isNull(), F.col(g)) for g in groups])
    shape = [F.col(key).alias("id"), F.col(vector).alias("e"), group.alias("g")]
    # groups of several lists; a group of fewer vectors is one list, and is not told of here
    sizes = {r["g"]: r["count"] for r in every.groupBy(group.alias("g")).count().filter(F.col("count") > 2 * list_size).collect()}
    total = sum(sizes.values())
    index: dict[int, Lists] = {}
    hot: set[tuple[int, int]] = set()
    if sizes:
        share = {g: min(1.0, SAMPLE * (0.5 / len(sizes) + 0.5 * n / total) / n) for g, n in sizes.items()}
        marks = spark.createDataFrame([(g, int(math.ceil(s * 1_000_000))) for g, s in share.items()], "g bigint, s bigint")
        picked = every.select(*shape, *([F.lit(True).alias("ok")] if valid is None else [valid.alias("ok")])).join(F.broadcast(marks), "g")
        picked = picked.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("s")).filter("ok").select("g", "e")
        sample = picked.limit(2 * SAMPLE).toPandas()
        for g, part in sample.groupby("g"):
            x = unit(list(part["e"]))
            index[int(g)] = fit(x.astype(np.float32), sizes[g], copies, list_size)
            cells, counts = np.unique(np.round(x, DECIMALS) + 0.0, axis=0, return_counts=True)
            if (counts / share[g] > max(HOT, total / HOT_SHARE)).any():
                hot.add(int(g))
    shared = spark.sparkContext.broadcast(index)  # at most SAMPLE / 8 centroids

    v = rows.select(*shape, (F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))).alias("w"))
    extra = None
    if hot:
        v = v.withColumn("h", F.when(F.col("g").isin(sorted(hot)), _direction("e")))
        counts = v.filter("h is not null").groupBy("g", "h").count().filter(F.col("count") > max(HOT, total // HOT_SHARE)).select("g", "h")
        counts = spark.createDataFrame(counts.collect(), "g bigint, h bigint")  # at most HOT_SHARE rows
        warm = v.join(F.broadcast(counts), ["g", "h"], "left_semi")
        cold = v.join(F.broadcast(counts), ["g", "h"], "left_anti")
        first = warm.withColumn("r", F.row_number().over(Window.partitionBy("g", "h").orderBy("id"))).filter(F.col("r") <= k + 1)
        lead = first.groupBy("g", "h").agg(F.collect_list(F.struct("id", "e")).alias("leads"))  # k + 1 vectors each
        rest = warm.filter("w").join(F.broadcast(lead), ["g", "h"]).select(F.col("id").alias("a"), "e", F.explode("leads").alias("b"))
        extra = rest.select("a", F.col("b.id").alias("b"), F.round(cosine(F.col("e"), F.col("b.e")), 9).alias("cosine")).filter((F.col("a") != F.col("b")) & (F.col("cosine") >= floor))
        v = cold.select("id", "e", "g", "w").unionByName(first.select("id", "e", "g", "w"))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists = shared.value
        for f in frames:
            for g, s in f.groupby("g", sort=False):
                known, body = lists.get(int(g)), np.array([np.asarray(e, np.float32).tobytes() for e in s["e"]], object)
                key, role = s["id"].to_numpy(), (1 + 2 * s["w"].to_numpy(bool)).astype(np.int32)
                if known is None:
                    yield pd.DataFrame({"g": g, "l": 0, "t": 0, "id": key, "e": body, "role": role})
                    continue
                c, blocks = known.centroids, known.blocks
                x, r = unit(list(s["e"])).astype(np.float32), min(copies, len(c))
                mine = _mixed(pd.util.hash_array(key) if key.dtype == object else key)
                # few rows at once: with all centroids, a whole batch would not fit beside the other workers
                for lo in range(0, len(x), ASSIGNED):
                    part = slice(lo, lo + ASSIGNED)
                    near = np.argpartition(-(x[part] @ c.T), r - 1, axis=1)[:, :r].astype(np.int32)
                    n = blocks[near]
                    for j in range(r):
                        at, l, m = np.arange(lo, lo + len(near)), near[:, j], n[:, j]
                        one = m == 1
                        yield pd.DataFrame({"g": g, "l": l[one], "t": 0, "id": key[at[one]], "e": body[at[one]], "role": role[at[one]]})
                        for size in np.unique(m[~one]):
                            big = at[m == size]
                            yield _blocks(g, l[m == size], key[big], body[big], role[big], (mine[big] % np.uint64(size)).astype(np.int32), int(size))

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        return compare_list(f["id"].to_numpy(), [np.frombuffer(e, np.float32) for e in f["e"]], f["role"].to_numpy(), k, floor)

    kind = v.schema["id"].dataType.simpleString()
    listed = v.mapInPandas(assign, f"g bigint, l int, t int, id {kind}, e binary, role int")
    pairs = listed.groupBy("g", "l", "t").applyInPandas(compare, f"a {kind}, b {kind}, cosine double")
    if extra is not None:
        pairs = pairs.unionByName(extra)
    pairs = pairs.repartition("a").dropDuplicates(["a", "b"])  # one shuffle serves this and the window
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    top = pairs.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
    return top.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"), "cosine", "position")


def _mixed(keys: np.ndarray) -> np.ndarray:
    h = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(31))


def _blocks(g: int, l: np.ndarray, key: np.ndarray, body: np.ndarray, role: np.ndarray, mine: np.ndarray, size: int) -> pd.DataFrame:
    """Entries of lists of size blocks: where they stand, in their block against all; where they ask, against every block."""
    stand = np.repeat(np.arange(len(key)), size)
    other = np.tile(np.arange(size, dtype=np.int32), len(key))
    t, r = other * size + mine[stand], np.where((other == mine[stand]) & (role[stand] == 3), 3, 1)
    asks = np.flatnonzero(role[stand] == 3)
    asks = asks[other[asks] != mine[stand[asks]]]
    at = np.concatenate([stand, stand[asks]])
    return pd.DataFrame({"g": g, "l": l[at], "t": np.concatenate([t, mine[stand[asks]] * size + other[asks]]), "id": key[at], "e": body[at], "role": np.concatenate([r, np.full(len(asks), 2)]).astype(np.int32)})


def latest_usable(rows: DataFrame) -> DataFrame:
    """The latest vector of each (chunk_id, provider, model) if it is usable.

    That is: not null, as long as dimensions, all finite, not all zero. Later created_at wins, then the larger
    embedding_id; repeated rows count once.
    """
    r = rows.select("embedding_id", "chunk_id", "provider", "model", "dimensions", "embedding", "created_at")
    r = latest_by(r, ["chunk_id", "provider", "model"], [F.desc_nulls_last("created_at"), F.desc_nulls_last("embedding_id")])
    return r.filter(_usable("embedding", "dimensions")).select("embedding_id", "provider", "model", "dimensions", "embedding")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors at cosine 0.9 or more of which one is among the other's ten most similar."""
    rows = table(spark, sf_dir, "chunk_embeddings")
    near = similar_vectors(latest_usable(rows), ["provider", "model", "dimensions"], k=10, floor=0.9, basis=rows, valid=_usable("embedding", "dimensions"))
    a, b = F.col("embedding_id_a"), F.col("embedding_id_b")
    return near.select(F.least(a, b).alias("embedding_id_a"), F.greatest(a, b).alias("embedding_id_b")).distinct()


#: Lists of each vector, and vectors of a list, where no floor sharpens them.
OPEN_COPIES, OPEN_SIZE = 4, 2_000


def p1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar of all vectors for every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "chunk_embeddings")
    near = similar_vectors(latest_usable(rows), ["provider", "model", "dimensions"], k=10, copies=OPEN_COPIES, list_size=OPEN_SIZE, basis=rows, valid=_usable("embedding", "dimensions"), wanted=F.col("embedding_id") % 50 == 0)
    return near.select("embedding_id_a", "embedding_id_b", "cosine", "position")


QUERIES = {"p1_found": p1_found, "p1_topk": p1_topk}
SQL: dict[str, str] = {}
