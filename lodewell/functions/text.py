"""Scalar functions over text, paths, vectors and JSON, as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin-1 letters and what the search index folds them to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"


def content_hash(s: Column) -> Column:
    return F.sha2(s, 256)


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(s, "UTF-16LE")) / 2).cast("bigint")


def token_count(s: Column) -> Column:
    """One token per four UTF-16 units begun."""
    return F.ceil(F.octet_length(F.encode(s, "UTF-16LE")) / 8).cast("bigint")


def truncate_tokens(s: Column, limit: Column) -> Column:
    """The first limit tokens; '' for a limit of 0 or less."""
    return F.when(limit <= 0, "").otherwise(F.substring(s, F.lit(1), (limit * 4).cast("int")))


def short_hash(s: Column) -> Column:
    """The 32-bit shift-and-add hash of the UTF-8 bytes, in hex."""
    nums = F.transform(F.filter(F.split(F.regexp_replace(F.hex(F.encode(s, "UTF-8")), "(..)", "$1 "), " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("bigint"))
    return F.lower(F.hex(F.aggregate(nums, F.lit(5381).cast("bigint"), lambda h, b: (h * 33 + b) % F.lit(4294967296).cast("bigint"))))


def identifier_terms(s: Column) -> Column:
    """Words inside identifiers: camel and snake parts, acronyms; lower case, distinct in order, at most 256, joined."""
    runs = F.regexp_extract_all(s, F.lit(r"([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+)"), 1)
    words = F.array_distinct(F.filter(F.transform(runs, lambda w: F.lower(w)), lambda w: F.length(w) > 1))
    return F.array_join(F.slice(words, 1, 256), " ")


def fold(s: Column) -> Column:
    """Lower case without Latin-1 accents, as the search index compares."""
    return F.translate(F.lower(s), ACCENTED, FOLDED)


def index_terms(s: Column) -> Column:
    """Runs of letters and digits of folded text."""
    return F.regexp_extract_all(fold(F.coalesce(s, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 for null, empty or unequal lengths and for a zero norm."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    good = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(F.coalesce(good, F.lit(False)), dot(a, b) / norm).otherwise(0.0)


def vector_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def _decoder(kind: str, size: int):
    def run(blob: pd.Series) -> pd.Series:
        return blob.map(lambda b: None if b is None else np.frombuffer(b, kind).astype(np.float32) if len(b) % size == 0 else np.empty(0, np.float32))

    return F.pandas_udf(run, "array<float>")


def decode_vector(blob: Column) -> Column:
    """Little-endian float32 bytes as numbers; a length that is no multiple of 4 gives an empty vector, null stays null."""
    return _decoder("<f4", 4)(blob)


def decode_half_vector(blob: Column) -> Column:
    """Little-endian half-precision bytes as float32."""
    return _decoder("<f2", 2)(blob)


def parse_vector(text: Column) -> Column:
    """A vector stored as JSON text; empty if it is none."""
    return F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))


def json_text(meta: Column, key: str) -> Column:
    """A string member of a JSON object; null if the text is no JSON object or the member is no string."""
    v = F.try_parse_json(meta)
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def json_valid(meta: Column) -> Column:
    return F.coalesce(F.try_parse_json(meta).isNotNull(), F.lit(False))


def search_text(meta: Column, content: Column) -> Column:
    """What the index reads of a chunk: its metadata's searchText, unless blank, above its content."""
    named = F.when(meta.contains("searchText"), json_text(meta, "searchText"))  # most rows need no parsing
    extra = F.regexp_replace(named, r"^[\s ﻿ - 　]+|[\s ﻿ - 　]+$", "")
    return F.when(F.coalesce(F.length(extra), F.lit(0)) > 0, F.concat_ws("\n", extra, F.coalesce(content, F.lit("")))).otherwise(F.coalesce(content, F.lit("")))


def escape_like(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\%_])", r"\\$1")


def slug(s: Column) -> Column:
    """A name as an id: lower case, other signs as single hyphens trimmed at the ends, 'workspace' if nothing is left."""
    body = F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"[^a-z0-9-]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(body, F.lit("")), F.lit("workspace"))


def call_name(s: Column) -> Column:
    """The last part of a dotted or scoped call."""
    parts = F.filter(F.split(s, r"::|\."), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), s)


def embedding_input(path: Column, heading: Column, content: Column) -> Column:
    return F.concat_ws("\n", path, F.nullif(heading, F.lit("")), content)


def storage_model(model: Column, version: str) -> Column:
    return F.concat(model, F.lit(":" + version))


def context_block(path: Column, start: Column, end: Column, score: Column, content: Column) -> Column:
    """One source of an answer: a line with its place and score above its content; unknown lines are '?'."""
    line = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(F.lit("[source: "), path, F.lit(":"), line(start), F.lit("-"), line(end), F.lit(" | score: "), F.format_string("%.3f", score), F.lit("]\n"), content)


def normal_path(p: Column) -> Column:
    """Forward slashes, without '.' and resolved '..' segments."""
    parts = F.filter(F.split(F.regexp_replace(p, r"\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == "..", acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(kept, "/")
