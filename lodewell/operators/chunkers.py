"""Chunkers: one document, many chunks.

Windows and line blocks are built-in expressions; formats with nested state (Markdown, YAML, JSON, TOML, symbols) run
as Arrow batches, one document at a time, and a document is never gathered with others.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.functions.text import token_count

#: Fixed value: lines of a block where a file has no symbols.
LINES = 80
TARGET, OVERLAP = 1024, 128


def windows(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, content, token_count): windows of target tokens (four characters each) at steps of target - overlap.

    A window starts at every step within the text, so the last may be a mere suffix of the one before. overlap is clamped to
    0 .. target - 1. No rows for null or empty text, or a target that is no positive whole number.
    """
    if not isinstance(target, int) or target <= 0:
        return docs.select(key, F.lit(0).alias("chunk_index"), F.lit("").alias("content"), F.lit(0).cast("bigint").alias("token_count")).filter("false")
    overlap = min(max(overlap, 0), target - 1)
    step, width = 4 * (target - overlap), 4 * target
    d = docs.filter(F.length(text) > 0).select(F.col(key), F.col(text).alias("__t"), F.explode(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).alias("__i"))
    c = F.substring(F.col("__t"), F.col("__i") + 1, F.lit(width))
    return d.select(key, (F.col("__i") / step).cast("int").alias("chunk_index"), c.alias("content"), token_count(c).alias("token_count"))


def bound(chunks: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """chunks (doc_id, chunk_index, content, ...) with those above target split into windows; split_index and split_count say so.

    Chunks within target stay as they are, with null split columns. chunk_index counts anew in order.
    """
    from pyspark.sql import Window

    over = token_count(F.col("content")) > target
    step, width = 4 * (target - min(max(overlap, 0), target - 1)), 4 * target
    starts = F.when(over, F.sequence(F.lit(0), F.length("content") - 1, F.lit(step))).otherwise(F.array(F.lit(0)))
    b = chunks.withColumn("__n", F.when(over, F.size(starts))).select("*", F.posexplode(starts).alias("split_index", "__i"))
    b = b.withColumn("content", F.when(F.col("__n").isNotNull(), F.substring(F.col("content"), F.col("__i") + 1, F.lit(width))).otherwise(F.col("content")))
    b = b.withColumn("split_count", F.when(F.col("__n") > 1, F.col("__n"))).withColumn("split_index", F.when(F.col("__n") > 1, F.col("split_index")))
    order = Window.partitionBy("doc_id").orderBy("chunk_index", F.coalesce("split_index", F.lit(0)))
    return b.withColumn("chunk_index", F.row_number().over(order) - 1).withColumn("content_hash", F.sha2("content", 256)).withColumn("token_count", token_count(F.col("content"))).drop("__n", "__i")


def line_blocks(docs: DataFrame, lines: int = LINES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, start_line, end_line, content): blocks of so many lines, trimmed; blank ones are left out.

    The lines are cut into blocks before they are exploded, so no block carries the whole text.
    """
    parts = F.split(text, "\n")
    d = docs.filter(F.length(text) > 0).select(key, parts.alias("__l"))
    starts = F.sequence(F.lit(0), F.floor((F.size("__l") - 1) / lines).cast("int"))
    blocks = F.transform(starts, lambda i: F.array_join(F.slice("__l", i * lines + 1, F.lit(lines)), "\n"))
    d = d.select(key, F.size("__l").alias("__n"), F.posexplode(blocks).alias("chunk_index", "__b"))
    d = d.select(key, "chunk_index", (F.col("chunk_index") * lines + 1).alias("start_line"), F.least((F.col("chunk_index") + 1) * lines, F.col("__n")).alias("end_line"), F.regexp_replace("__b", r"^\s+|\s+$", "").alias("content"))
    return d.filter("content <> ''")


def whole(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One chunk per document, untrimmed."""
    return docs.filter(F.col(text).isNotNull()).select(key, F.lit(0).alias("chunk_index"), F.lit(1).alias("start_line"), F.size(F.split(text, "\n")).alias("end_line"), F.col(text).alias("content"))


def wikilinks(text: F.Column) -> F.Column:
    """Distinct [[targets]] on lines that are no headings."""
    body = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^#{1,6}\s")), "\n")
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"\[\[([^\]]+)\]\]"), 1))


def _tokens(s: str) -> int:
    return -(-(len(s.encode("utf-16-le")) // 2) // 4)


def reflow(text: str, target: int, overlap: int) -> list[str]:
    """Paragraphs packed greedily up to target tokens; one that does not fit is flowed word by word, with overlap words shared."""
    out: list[str] = []
    held = ""
    for para in filter(None, re.split(r"\n{2,}", text)):
        joined = f"{held}\n\n{para}" if held else para
        if _tokens(joined) <= target:
            held = joined
            continue
        if held:
            out.append(held)
        line: list[str] = []
        for word in para.split():
            if line and _tokens(" ".join([*line, word])) > target:
                out.append(" ".join(line))
                line = line[-overlap:] if overlap > 0 else []
            line.append(word)
        held = " ".join(line)
    return [x for x in [*out, held] if x]


def markdown_sections(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[dict]:
    """Sections under ATX headings with their heading path; headings themselves and empty sections are left out."""
    path: list[str | None] = []
    out: list[dict] = []
    body: list[str] = []
    start = 1
    lines = text.split("\n")

    def close(end: int) -> None:
        content = "\n".join(body).strip()
        if not content:
            return
        parts = reflow(content, target, overlap) if _tokens(content) > target else [content]
        shown = [p for p in path if p]
        for i, p in enumerate(parts):
            out.append({"heading": shown[-1] if shown else None, "heading_path": shown, "start_line": start, "end_line": end, "split_index": i, "content": p})

    for n, line in enumerate(lines, 1):
        if m := re.match(r"(#{1,6})\s+(.+?)\s*$", line):
            close(n - 1)
            depth = len(m[1])
            path = [*path[: depth - 1], *[None] * (depth - 1 - len(path)), m[2]]
            body, start = [], n
        else:
            body.append(line)
    close(len(lines))
    return out


def json_sections(text: str) -> list[dict]:
    """One section per top-level entry, pretty-printed; invalid, scalar and empty values are one whole section."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        value = None
    entries = list(value.items()) if isinstance(value, dict) else [(str(i), v) for i, v in enumerate(value)] if isinstance(value, list) else []
    if not entries:
        return [{"heading": None, "value_type": None, "content": text}]
    if isinstance(value, dict):  # whole-number keys first, in order
        entries.sort(key=lambda e: (0, int(e[0])) if re.fullmatch(r"0|[1-9]\d{0,8}", e[0]) else (1, 0))
    kinds = {bool: "boolean", int: "number", float: "number", str: "string", list: "array"}
    return [{"heading": k, "value_type": kinds.get(type(v), "object"), "content": json.dumps(v, indent=2, ensure_ascii=False)} for k, v in entries]


def _line_sections(text: str, starts: Callable[[str, int], tuple[str, bool] | None]) -> list[dict]:
    out: list[dict] = []
    name, special, body, start = "root", False, [], 1
    lines = text.split("\n")
    for n, line in enumerate([*lines, None], 1):
        opened = starts(line, n) if line is not None else ("", False)
        if opened is not None:
            content = "\n".join(body).strip("\n")
            if content.strip():
                out.append({"heading": name, "special": special, "start_line": start, "end_line": n - 1, "content": content})
            (name, special), body, start = opened, [], n
        if line is not None:
            body.append(line)
    return out


def yaml_sections(text: str) -> list[dict]:
    """A section per top-level key or list item; comments and blank lines go with what stands above, a preamble is 'root'."""
    items = 0

    def starts(line: str, n: int):
        nonlocal items
        if m := re.match(r"([^\s#&*\-\[{'\"][^:#]*|\"[^\"]*\"|'[^']*')\s*:(\s|$)", line):
            return m[1].strip().strip("\"'"), False
        if re.match(r"-(\s|$)", line):
            items += 1
            return f"list-item-{items}", False
        return None

    return _line_sections(text, starts)


def toml_sections(text: str) -> list[dict]:
    """A section per table; special marks an array's table; what stands above the first is 'root'."""

    def starts(line: str, n: int):
        if m := re.match(r"\s*(\[\[?)\s*([^\[\]]+?)\s*\]\]?\s*(#.*)?$", line):
            return m[2], m[1] == "[["
        return None

    return _line_sections(text, starts)


SECTIONS: dict[str, Callable[[str], list[dict]]] = {"markdown": markdown_sections, "json": json_sections, "yaml": yaml_sections, "toml": toml_sections}


def sections(docs: DataFrame, language: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, heading, start_line, end_line, detail, content) by the sections of one language of SECTIONS.

    detail is the heading path, value type or kind of table. No rows for null or empty texts.
    """
    cut = SECTIONS[language]
    rows = docs.filter(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, t in zip(f["k"], f["t"], strict=True):
                for i, s in enumerate(cut(t)):
                    detail = " > ".join(s["heading_path"]) if "heading_path" in s else s.get("value_type") or ("array" if s.get("special") else None)
                    out.append((k, i, s["heading"], s.get("start_line"), s.get("end_line"), detail, s["content"]))
            yield pd.DataFrame(out, columns=["k", "chunk_index", "heading", "start_line", "end_line", "detail", "content"]).astype({"start_line": "Int32", "end_line": "Int32"})

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInPandas(run, f"k {kind}, chunk_index int, heading string, start_line int, end_line int, detail string, content string").withColumnRenamed("k", key)


def symbol_chunks(parsed: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, heading, start_line, end_line, content): the lines of each symbol of parsed (key, symbols with name, start, end).

    Nested symbols overlap; text outside symbols has no chunk.
    """
    s = parsed.select(key, F.posexplode("symbols").alias("chunk_index", "s"))
    d = s.join(docs.select(key, F.split(text, "\n").alias("__l")), key)
    body = F.array_join(F.slice("__l", F.col("s.start"), F.col("s.end") - F.col("s.start") + 1), "\n")
    return d.select(key, "chunk_index", F.col("s.name").alias("heading"), F.col("s.start").alias("start_line"), F.col("s.end").alias("end_line"), body.alias("content"))
