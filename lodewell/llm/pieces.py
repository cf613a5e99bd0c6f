"""Splitting oversized items at natural boundaries.

Token offsets are prefix sums: how many tokens of the text end at or before each character. Four characters begun are a token
(FourChars, where the sum needs no array), or the tokens are those of a vocabulary (TokenEnds). Boundaries (blank lines, line
ends, sentence ends, spaces) are kept in sorted arrays; from each start the last boundary within the limit is found by binary
search, coarse kinds first, and the next piece starts `overlap` tokens before that cut. Without any boundary the cut is hard.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm.bpe import encoder, vocabulary_path
from lodewell.operators.changes import latest_by
from lodewell.sources.tables import table

CHARS = 4
#: Kinds of boundaries, best first; a cut stands behind the match.
KINDS = [
    re.compile(r"\n[ \t\r]*\n(?=\S)"),  # a blank line before an unindented line
    re.compile(r"\n(?=[^\s})\]])"),  # an unindented line
    re.compile(r"\n[ \t\r]*\n"),
    re.compile(r"\n"),
    re.compile(r"[.!?;](?=\s)\s"),
    re.compile(r"\s+"),
]
#: A coarse boundary is taken only if the piece is at least this share of the limit.
LEAST = [0.5, 0.6, 0.5, 0.25, 0.25, 0.0]


class FourChars:
    """Tokens of four characters begun, counted from the start of a piece."""

    def __init__(self, text: str):
        self.n = len(text)

    def count(self, a: int, b: int) -> int:
        return -(-(b - a) // CHARS)

    def reach(self, a: int, tokens: int) -> int:
        """The last offset with at most so many tokens from a."""
        return min(a + tokens * CHARS, self.n)

    def back(self, b: int, tokens: int) -> int:
        """The offset so many tokens before b."""
        return max(b - tokens * CHARS, 0)


class TokenEnds:
    """Tokens of a vocabulary: sums holds, in order, the characters at which the tokens of the whole text end.

    A token that ends inside a character ends with it, and a token that an offset cuts counts on both sides, so no piece has
    more tokens than it is said to. A character of more tokens than asked for is never torn.
    """

    def __init__(self, text: str, lengths: list[int]):
        """lengths are the bytes of the text's tokens."""
        chars = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text]) if text else np.empty(0, np.int64)
        self.n = len(text)
        self.sums = (np.searchsorted(chars, np.cumsum(lengths), "left") + 1).tolist() if lengths else []

    def count(self, a: int, b: int) -> int:
        if b <= a:
            return 0
        i = bisect_left(self.sums, b)
        return (bisect_right(self.sums, self.sums[i]) if i < len(self.sums) else len(self.sums)) - bisect_right(self.sums, a)

    def reach(self, a: int, tokens: int) -> int:
        first = bisect_right(self.sums, a)
        i = first + tokens - 1
        if i >= len(self.sums):
            return self.n
        before = bisect_left(self.sums, self.sums[i])
        if bisect_right(self.sums, self.sums[i]) - first > tokens and before > first:
            return self.sums[before - 1]
        return self.sums[i]

    def back(self, b: int, tokens: int) -> int:
        i = bisect_right(self.sums, b) - tokens - 1
        return self.sums[i] if i >= 0 else 0


def tokens(n_chars: int) -> int:
    return -(-n_chars // CHARS)


def usable_overlap(overlap: float | None, target: int) -> int:
    """Overlap in tokens: null, NaN and negative count as 0; at most target - 1, so that pieces advance."""
    if overlap is None or overlap != overlap or overlap <= 0:
        return 0
    return int(min(overlap, max(target - 1, 0)))


def _whole(text: str, end: int, least: int) -> int:
    """end, or before it the place where no character is torn from its combining marks, joiners or line end; never below least."""
    at = end
    while at > least and at < len(text) and (unicodedata.combining(text[at]) or text[at] in "\u200d\ufe0e\ufe0f" or text[at - 1] == "\u200d" or text[at - 1 : at + 1] == "\r\n"):
        at -= 1
    return at if at > least else end


def cut(text: str, target: int, overlap: float | None = 0, make: Callable[[str], FourChars | TokenEnds] = FourChars) -> list[tuple[int, int]]:
    """(start, end) of the pieces of text: each at most target tokens, together the whole text.

    Consecutive pieces share overlap tokens (see usable_overlap). A hard cut spares combining marks, joined emoji and CRLF
    where the piece allows. Text within target, empty text included, is one piece. A target below 1 counts as 1.
    """
    target = max(int(target), 1)
    sums, n = make(text), len(text)
    if sums.count(0, n) <= target:
        return [(0, n)]
    shared = usable_overlap(overlap, target)
    kinds: list[list[int] | None] = [None] * len(KINDS)
    out, start = [], 0
    while sums.count(start, n) > target:
        limit = sums.reach(start, target)
        if limit >= n:
            break  # what is left is one character of more tokens than target
        if out and limit <= out[-1][1]:
            start = out[-1][1]  # what is shared leaves no room for the character that follows
            continue
        least = out[-1][1] if out else start  # a piece ends behind the one before
        own = sums.reach(start, shared) if shared else start  # and has more than it shares with the next
        end = None
        for k, pattern in enumerate(KINDS):
            if kinds[k] is None:
                kinds[k] = [m.end() for m in pattern.finditer(text)]
            at = bisect_right(kinds[k], limit) - 1
            if at >= 0 and kinds[k][at] > max(least, own, start + (limit - start) * LEAST[k]):
                end = kinds[k][at]
                break
        if end is None:
            end = _whole(text, limit, max(least, own, start + 1))
        out.append((start, end))
        start = max(sums.back(end, shared), start + 1) if shared else end
    out.append((start, n))
    return out


def by_vocabulary(path: str | None = None) -> Callable[[str], TokenEnds]:
    """Token offsets by the vocabulary file at path, for cut and split_oversized."""
    path = path or vocabulary_path()

    def make(text: str) -> TokenEnds:
        e = encoder(path)
        return TokenEnds(text, [len(e.strings[i]) for i in e.encode(text)])

    return make


#: Pieces that a worker holds before it hands them on, and characters of them.
HELD, HELD_CHARS = 4_000, 4_000_000


def split_oversized(
    items: DataFrame, limits: DataFrame, key: str, text: str, item_doc: str, limit_doc: str, target: str, overlap: str, heading: str | None = None, make: Callable[[str], FourChars | TokenEnds] = FourChars
) -> DataFrame:
    """(key, piece, n_pieces, start, overlap, heading, content, tokens): the pieces of items above their target.

    limits has target and overlap by limit_doc; repeated rows count once, and where they differ the smallest
    target wins. Items without limits, with null text or within the limit have no rows here: they stay as they
    are. Repeated item rows of one key and text are cut once; equal keys with other texts are cut each.
    overlap is the tokens that consecutive pieces share (see usable_overlap). make counts tokens: four characters, or by_vocabulary().
    Only oversized texts leave the JVM (with a vocabulary, those of more bytes than the target has tokens). An item is one
    task's work, but its neighbours in a hot document are not, and its pieces are handed on in bounded batches.
    """
    lim = limits.select(F.col(limit_doc).alias("__d"), F.col(target).alias("__t"), F.col(overlap).alias("__o"))
    lim = latest_by(lim.filter("__t is not null and __d is not null"), ["__d"], [F.asc("__t"), F.desc_nulls_last("__o")])
    it = items.select(F.col(key).alias("__k"), F.col(text).alias("__x"), F.col(item_doc).alias("__d"), (F.col(heading) if heading else F.lit(None).cast("string")).alias("__h"))
    least = lim.agg(F.min("__t")).first()[0]  # one number; texts within the smallest target never reach the join
    size = F.ceil(F.length("__x") / CHARS) if make is FourChars else F.octet_length("__x")  # a token has a byte at least
    it = it.filter(size > max(least or 1, 1))
    big = it.join(lim, "__d").filter(size > F.greatest(F.col("__t"), F.lit(1)))
    big = big.dropDuplicates(["__k", "__x"]).select("__k", "__x", "__h", "__t", "__o")
    names = ["k", "piece", "n_pieces", "start", "overlap", "heading", "content", "tokens"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows, held = [], 0
            for k, x, h, t, o in zip(f["__k"], f["__x"], f["__h"], f["__t"], f["__o"], strict=True):
                parts = cut(x, t, o, make)
                if len(parts) < 2:
                    continue
                sums, shared = make(x), usable_overlap(o, max(int(t), 1))
                for i, (a, b) in enumerate(parts):
                    rows.append((k, i, len(parts), a, shared, h, x[a:b], sums.count(a, b)))
                    held += b - a
                    if len(rows) >= HELD or held >= HELD_CHARS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    kind = big.schema["__k"].dataType.simpleString()
    out = big.mapInPandas(run, f"k {kind}, piece int, n_pieces int, start int, overlap int, heading string, content string, tokens int")
    return out.withColumnRenamed("k", key)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "document_id", "heading", "content")
    limits = table(spark, sf_dir, "parse_inputs").select("document_id", "target_tokens", "overlap_tokens")
    return split_oversized(chunks, limits, "chunk_id", "content", "document_id", "document_id", "target_tokens", "overlap_tokens", "heading")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that had to be cut."""
    return _pieces(spark, sf_dir).filter("piece = 0 and n_pieces > 1").select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces."""
    return _pieces(spark, sf_dir)


def p2_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cut chunk put together again: the hash of its text, the tokens its pieces share, and its longest piece within the target.

    A piece's first shared tokens, which must repeat the end of the piece before, are left out of the text.
    """
    shared = F.when(F.col("piece") > 0, F.col("overlap") * CHARS).otherwise(0)
    p = _pieces(spark, sf_dir).select("chunk_id", "piece", "overlap", "tokens", F.substring(F.col("content"), shared + 1, F.length("content")).alias("own"))
    # the pieces of one chunk are as long as its text
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "own"))), lambda r: r["own"]), "")
    out = p.groupBy("chunk_id").agg(F.sha2(text, 256).alias("hash"), F.max("overlap").alias("overlap"), F.max("tokens").alias("longest"))
    c = table(spark, sf_dir, "chunks").select("chunk_id", "document_id").distinct()
    limit = table(spark, sf_dir, "parse_inputs").groupBy("document_id").agg(F.min("target_tokens").alias("t"))
    return out.join(c, "chunk_id").join(limit, "document_id").select("chunk_id", "hash", "overlap", (F.col("longest") <= F.greatest(F.col("t"), F.lit(1))).alias("within"))


P2_SQL = """
WITH l AS (SELECT document_id, min(target_tokens) AS t FROM parse_inputs GROUP BY 1)
SELECT DISTINCT chunk_id FROM chunks JOIN l USING (document_id) WHERE ceil(length(content) / 4.0) > greatest(t, 1)
"""

P2_REBUILT_SQL = """
WITH l AS (SELECT * FROM (SELECT document_id, target_tokens AS t, overlap_tokens AS o, row_number() OVER (PARTITION BY document_id ORDER BY target_tokens, overlap_tokens DESC NULLS LAST) AS rn FROM parse_inputs) WHERE rn = 1)
SELECT DISTINCT chunk_id, sha256(content) AS hash, CAST(greatest(least(coalesce(o, 0), greatest(t, 1) - 1), 0) AS INTEGER) AS overlap, true AS within
FROM chunks JOIN l USING (document_id) WHERE ceil(length(content) / 4.0) > greatest(t, 1)
"""

QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_rebuilt": p2_rebuilt}
SQL = {"p2_found": P2_SQL, "p2_rebuilt": P2_REBUILT_SQL}
