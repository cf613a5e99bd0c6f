"""Token counting and splitting by a pluggable encoder, with characters / 4 as the fallback."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.functions.text import token_count

#: Fixed value: the pattern of the rank files that encoder() reads.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """An encoding of a rank file, or None if the file or the library is missing: counts then fall back."""
    try:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, OSError):
        return None


def count_tokens(text: Column, path: str | None = None) -> Column:
    """Tokens of a text by the encoder of path; by characters / 4 without one. Null stays null."""
    if path is None or encoder(path) is None:
        return token_count(text)

    def run(s: pd.Series) -> pd.Series:
        e = encoder(path)
        return s.map(lambda t: None if t is None else len(e.encode_ordinary(t))).astype("Int64")

    return F.pandas_udf(run, "bigint")(text)


def truncate(text: str, limit: int, path: str | None = None) -> str:
    """The first limit tokens of text; '' for 0 or less."""
    if limit <= 0:
        return ""
    e = encoder(path) if path else None
    if e is None:
        return text[: 4 * limit]
    ids = e.encode_ordinary(text)
    return text if len(ids) <= limit else e.decode(ids[:limit])


def split(text: str, target: int, overlap: int, path: str | None = None) -> list[str]:
    """Windows of target tokens at steps of target - overlap; a text within target is one, and an empty text or target none.

    Without an encoder, windows of four characters a token, without the early return.
    """
    if target <= 0 or not text:
        return []
    overlap = min(max(overlap, 0), target - 1)
    e = encoder(path) if path else None
    if e is None:
        return [text[i : i + 4 * target] for i in range(0, len(text), 4 * (target - overlap))]
    ids = e.encode_ordinary(text)
    if len(ids) <= target:
        return [text]
    return [e.decode(ids[i : i + target]) for i in range(0, len(ids), target - overlap)]


def split_documents(docs: DataFrame, target: int, overlap: int, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, content): split() of every text."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") > 0)
    cut: Callable[[str], list[str]] = functools.partial(split, target=target, overlap=overlap, path=path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, i, c) for k, t in zip(f["k"], f["t"], strict=True) for i, c in enumerate(cut(t))], columns=["k", "chunk_index", "content"])

    return rows.mapInPandas(run, f"k {rows.schema['k'].dataType.simpleString()}, chunk_index int, content string").withColumnRenamed("k", key)
