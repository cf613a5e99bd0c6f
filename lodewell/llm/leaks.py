"""Evaluation passages that occur in a corpus, wholly or partly (winnowing).

Both sides are reduced to words; every window of WINDOW consecutive k-grams keeps its smallest hash, so any
shared span of WINDOW + K - 1 words shares a kept hash. The corpus is winnowed in one pass however many items there are;
the kept hashes that an item may have, by a bit set of bounded size, are joined with the items' by equality. Joined hashes
name candidate pairs of document and item, only these meet their texts, and each is extended to runs: stretches of both
texts, in the item's order, in which few words differ.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.session import cut_lineage, spread
from lodewell.sources.tables import table

#: Words of a k-gram and k-grams of a window: every shared span of six words is seen.
K, WINDOW = 3, 4
#: Share of an item's words that must be covered, in at most RUNS runs; what a differing word costs in a run,
#: and the least share of equal words in it (one word in seven may be altered).
SHARE, RUNS, COST, EQUAL = 0.4, 2, 3.0, 0.8
#: Shortest run that counts; items of fewer words are found only whole and unaltered.
LEAST = WINDOW + K - 1
#: Bits of a bit set at most, and bytes of the blocks it is put together from. More keys make it less selective, never wrong.
BITS, BLOCK = 1 << 27, 1 << 14
#: Item fingerprints and item words up to which the item side of a join is sent to every executor; beyond, both sides are shuffled.
SENT = 1_000_000

_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[abfnrtv0])")
_WORD = re.compile(r"[^\W_]+")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-z]{2,6});")
_SOFT = re.compile("[­​-‏⁠﻿]")


def words(text: str | None) -> list[str]:
    """Lower-case words; case, punctuation, white space, escapes, quote and comment marks are disregarded."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _SOFT.sub("", text))
    return _WORD.findall(text.lower())


class Ids(dict):
    """Words to 64-bit ids, the same everywhere; kept per worker up to a bound."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


_ids = Ids()


def word_ids(text: str | None) -> np.ndarray:
    ws = words(text)
    return np.fromiter(map(_ids.__getitem__, ws), np.uint64, len(ws))


def grams(ids: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of the k-gram that starts at each position; none if there are fewer than k words."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ ids[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray) -> np.ndarray:
    """Positions of the smallest hash, the rightmost on ties, of every window; all of fewer hashes count as one."""
    if not len(h):
        return np.empty(0, np.int64)
    w = min(WINDOW, len(h))
    view = np.lib.stride_tricks.sliding_window_view(h, w)
    return np.unique(np.arange(len(view)) + (w - 1 - view[:, ::-1].argmin(1)))


def item_prints(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) that an item is known by: winnowed k-grams, or all its words as one gram if it is short."""
    if len(ids) < LEAST:
        return grams(ids, max(len(ids), 1)), np.zeros(min(len(ids), 1), np.int64)
    h = grams(ids)
    at = winnow(h)
    return h[at], at


def text_prints(ids: np.ndarray, short: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of a text: winnowed k-grams and, where short items exist, every gram of their lengths."""
    h = grams(ids)
    at = winnow(h)
    parts = [(h[at], at)]
    for n in short:
        g = grams(ids, n)
        parts.append((g, np.arange(len(g))))
    return np.concatenate([p for p, _ in parts]), np.concatenate([p for _, p in parts])


def coverage(a: list[int], b: list[int], seeds: list[tuple[int, int]]) -> float:
    """Share of item a's words that its RUNS best runs in text b span, runs in the item's order.

    seeds are (place in a, place in b) of shared hashes. An item of fewer than LEAST words is covered wholly or not at all.
    """
    n = len(a)
    if n < LEAST:
        return float(any(b[j : j + n] == a for _, j in seeds))
    spans, done = set(), set()
    for i, j in seeds:
        if (i, j) not in done:
            r = extend(a, b, i, j)
            done.update(zip(range(r[0], r[1]), range(r[2], r[3])))
            if r[1] - r[0] >= LEAST and r[4] >= EQUAL * (r[1] - r[0]):
                spans.add(r[:4])
    spans = sorted(spans)
    best = 0
    for x, (a0, a1, b0, b1) in enumerate(spans):
        best = max(best, a1 - a0)
        for c0, c1, d0, d1 in spans[x + 1 :] if RUNS > 1 else ():
            if c0 >= a1 - 2 and d0 >= b1 - 2:
                best = max(best, min(n, (a1 - a0) + (c1 - c0)))
    return best / n


def extend(a: list[int], b: list[int], i: int, j: int) -> tuple[int, int, int, int, int]:
    """(a0, a1, b0, b1, equal words): the run through the equal k-grams at a[i] and b[j].

    From there words are compared outwards on both sides; a differing word costs COST, an equal one earns 1, one
    word too many on a side is stepped over, and the run ends where the sum was greatest.
    """

    def walk(step: int, x: int, y: int) -> tuple[int, int, int]:
        score = top = 0.0
        equal = 0
        best = (x, y, 0)
        na, nb = len(a), len(b)
        inside = lambda p, q: 0 <= p < na and 0 <= q < nb
        while inside(x, y) and score > top - 3 * COST:
            if a[x] == b[y]:
                score += 1
                equal += 1
                x, y = x + step, y + step
            elif inside(x + step, y + step) and a[x + step] == b[y + step]:
                score -= COST
                x, y = x + step, y + step
            elif inside(x, y + 2 * step) and a[x] == b[y + step]:
                score -= COST
                y += step
            elif inside(x + 2 * step, y) and a[x + step] == b[y]:
                score -= COST
                x += step
            else:
                score -= COST
                x, y = x + step, y + step
            if score > top:
                top, best = score, (x, y, equal)
        return best

    r, s, e = walk(1, i, j)
    p, q, f = walk(-1, i - 1, j - 1)
    return p + 1, r, q + 1, s, e + f


def bit_set(keys: DataFrame, n: int) -> np.ndarray:
    """A bit set of the n values of the one bigint column of keys, at most BITS bits: a value whose bit is unset is not among them.

    Each task sets its own bits, blocks of BLOCK bytes are united by number, and at most BITS / 8 bytes come to the driver.
    """
    size = min(BITS, max(BLOCK * 8, 1 << max(n * 32 - 1, 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(size - 1)).astype(np.int64)
            block = at // (BLOCK * 8)
            for x in np.unique(block):
                bits = np.zeros(BLOCK * 8, bool)
                bits[at[block == x] % (BLOCK * 8)] = True
                packed = np.packbits(bits)
                mine[int(x)] = mine[int(x)] | packed if int(x) in mine else packed
        yield pa.RecordBatch.from_arrays([pa.array(list(mine), pa.int32()), pa.array([v.tobytes() for v in mine.values()], pa.binary())], names=["x", "v"])

    def unite(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"x": f["x"].iloc[:1], "v": [np.bitwise_or.reduce([np.frombuffer(v, np.uint8) for v in f["v"]]).tobytes()]})

    out = np.zeros(size // 8, np.uint8)
    for r in keys.mapInArrow(mark, "x int, v binary").groupBy("x").applyInPandas(unite, "x int, v binary").collect():
        out[r["x"] * BLOCK : (r["x"] + 1) * BLOCK] = np.frombuffer(r["v"], np.uint8)
    return out


def in_set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def leaked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "text") -> DataFrame:
    """(key, item, coverage): documents that hold at least SHARE of an item's words, in order, in one or two runs.

    Documents are read once to be winnowed and once more, by a bit set of candidates, for the texts of candidates only;
    neither items nor fingerprints come to the driver. The item side of a join is broadcast only if it is counted to be
    at most SENT rows or words, else both sides are shuffled and AQE splits a fingerprint that many documents share.
    Null and empty texts, and items without words, give nothing. Items of fewer than LEAST words are found only whole.
    Repeated items count once; documents repeated in key and text give a row for each.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") > 0)
    d = d.withColumn("u", F.xxhash64("k", "t")).withColumn("v", F.hash("t"))
    it = items.select(F.col(item).alias("i"), F.col(passage).alias("p")).filter(F.length("p") > 0).distinct().withColumn("w", F.xxhash64("i", "p"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, hs, at, ns = [], [], [], []
            for r, p in enumerate(b.column(1).to_pylist()):
                ids = word_ids(p)
                h, places = item_prints(ids)
                rows.append(np.full(len(h), r)), hs.append(h), at.append(places), ns.append(np.full(len(h), len(ids)))
            r, h, places, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, hs, at, ns))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r.astype(np.int32))), pa.array(h.view(np.int64)), pa.array(places.astype(np.int32)), pa.array(n.astype(np.int32))], names=["w", "h", "a", "n"])

    known = cut_lineage(it.select("w", "p").mapInArrow(prints, "w bigint, h bigint, a int, n int"))
    total, longest = known.agg(F.count(F.lit(1)), F.sum(F.when(F.col("a") == 0, F.col("n")))).first()
    few = total <= SENT and (longest or 0) <= SENT
    short = tuple(sorted(r["n"] for r in known.filter(F.col("n") < LEAST).select("n").distinct().collect()))  # LEAST - 1 numbers at most
    sought = spark.sparkContext.broadcast(bit_set(known.select("h"), total))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sought.value
        for b in batches:
            rows, hs, at = [], [], []
            for r, t in enumerate(b.column(2).to_pylist()):
                h, places = text_prints(word_ids(t), short)
                mine = in_set(bits, h)
                if mine.any():
                    rows.append(np.full(int(mine.sum()), r)), hs.append(h[mine]), at.append(places[mine])
            r, h, places = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, hs, at))
            take = pa.array(r.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(h.view(np.int64)), pa.array(places.astype(np.int32))], names=["u", "v", "h", "b"])

    seen = spread(d.select("u", "v", "t")).mapInArrow(hits, "u bigint, v int, h bigint, b int")
    side = known.select("w", "h", "a")
    pairs = seen.join(F.broadcast(side) if few else side, "h").groupBy("u", "v", "w").agg(F.collect_set(F.struct("a", "b")).alias("seeds"))
    pairs = cut_lineage(pairs)  # candidates, a small part of the fingerprints
    pairs_n = pairs.count()
    wanted = spark.sparkContext.broadcast(bit_set(pairs.select("u").distinct(), pairs_n))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_set(wanted.value, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    texts = d.select("u", "v", "k", "t").mapInArrow(candidates, f"u bigint, v int, k {kind}, t string")
    pairs = pairs.join(F.broadcast(it) if few else it, "w").select("u", "v", "i", "p", F.transform("seeds", lambda s: s["a"]).alias("a"), F.transform("seeds", lambda s: s["b"]).alias("b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, b_ids = None, []
        known_items: dict[str, list[int]] = {}
        for x in batches:
            rows, share = [], []
            for r, (t, p, a, b) in enumerate(zip(*(x.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)):
                if t != last:
                    last, b_ids = t, word_ids(t).tolist()
                if p not in known_items:
                    if len(known_items) > 10_000:
                        known_items.clear()
                    known_items[p] = word_ids(p).tolist()
                if (c := coverage(known_items[p], b_ids, sorted(zip(a, b, strict=True)))) >= SHARE:
                    rows.append(r), share.append(c)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([x.column(0).take(take), x.column(1).take(take), pa.array(share, pa.float64())], names=["k", "i", "c"])

    joined = texts.join(pairs, ["u", "v"]).select("k", "i", "t", "p", "a", "b")
    out = joined.mapInArrow(verify, f"k {kind}, i {item_kind}, c double")
    return out.select(F.col("k").alias(key), F.col("i").alias(item), F.col("c").alias("coverage"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items they leak."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "eval_items").select("item_id", "text")
    return leaked(docs, items).select("doc_id", "item_id").distinct()


QUERIES = {"p9_found": p9_found}
SQL: dict[str, str] = {}
