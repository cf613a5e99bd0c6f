"""Encoding of texts with a public byte-level BPE vocabulary.

The text is cut by the vocabulary's pattern; each piece starts as single bytes in a doubly linked list and a
priority queue of merge ranks joins neighbours, skipping entries that an earlier merge made stale. Equal
pieces are encoded once per worker. Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.session import spread
from lodewell.sources.tables import table

#: Where the public vocabularies lie; set LODEWELL_TOKENIZERS or pass a path to change it.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the pattern published with byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded pieces that one worker keeps; at the limit it starts anew.
KEPT = 1_000_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    return os.path.join(os.environ.get("LODEWELL_TOKENIZERS", VOCABULARIES), name)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: O(n log n) in its bytes."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    part = [piece[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, size = heapq.heappop(queue)
        a = part[i]
        if a is None or (j := after[i]) >= n or len(a) + len(part[j]) != size:
            continue  # one of the two has changed since
        part[i], part[j] = a + part[j], None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(part[i] + part[k])) is not None:
                heapq.heappush(queue, (r, i, size + len(part[k])))
        if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
            heapq.heappush(queue, (r, h, len(part[h]) + size))
    return [ranks[p] for p in part if p is not None]


class Encoder(dict):
    """Pieces of text to token ids, filled on demand."""

    def __init__(self, path: str, pattern: str = PATTERN):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.strings = {i: s for s, i in self.ranks.items()}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > KEPT:
            self.clear()
        ids = tuple(merge(piece.encode("utf-8", "surrogatepass"), self.ranks))
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(itertools.chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of one vocabulary file."""
    return Encoder(path)


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>): the token ids of each text, one row per row of docs.

    Null and empty texts give an empty list, never null. Strings of special tokens are ordinary text.
    Nothing is shuffled and no text is cut; other columns, whatever their names, are not read.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        get, split = enc.__getitem__, enc.split
        for b in batches:
            counts, parts = [0], []
            for t in b.column(1):
                s = t.as_py()
                ids = np.fromiter(itertools.chain.from_iterable(map(get, split(s))), np.int32) if s else np.empty(0, np.int32)
                parts.append(ids)
                counts.append(counts[-1] + len(ids))
            flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.array(counts, np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["k", "ids"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return spread(rows).mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, ids array<int>").select(F.col("k").alias(key), "ids")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
