"""Kinds and languages of files by extension, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language names by extension, by group; every group's kind is that of the key.
CODE = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "cjs": "javascript", "mts": "typescript", "cts": "typescript",
    "py": "python", "go": "go", "rs": "rust", "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "css": "css", "scss": "scss", "sass": "scss", "less": "less",
    "slim": "slim", "haml": "haml", "coffee": "coffeescript", "litcoffee": "coffeescript",
}
CONFIG = {"yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml"}
MARKDOWN = {"md": "markdown", "mdx": "markdown"}
#: Extensions whose files get the vector bonus.
BOOSTED = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "py", "go", "rs"]


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; '' if the last segment has none or starts with its only dot."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*\.([^./\\]*)$", 1))


def _pick(ext: Column, names: dict[str, str]) -> Column:
    out = None
    for language in dict.fromkeys(names.values()):
        hit = ext.isin([e for e, n in names.items() if n == language])
        out = F.when(hit, language) if out is None else out.when(hit, language)
    return out


def kind(path: Column) -> Column:
    """markdown, code, config or text; null for a null path."""
    e = extension(path)
    return F.when(path.isNull(), None).when(e.isin(list(MARKDOWN)), "markdown").when(e.isin(list(CODE)), "code").when(e.isin(list(CONFIG)), "config").otherwise("text")


def language(path: Column) -> Column:
    """Language by extension; the extension itself for others, null where there is none."""
    e = extension(path)
    return F.coalesce(_pick(e, CODE | CONFIG | MARKDOWN), F.nullif(e, F.lit("")))


def is_boosted(path: Column) -> Column:
    """Whether a path is code for the vector bonus."""
    return F.coalesce(extension(path).isin(BOOSTED), F.lit(False))
