"""Files of a folder as rows, with ignore rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.functions import languages as lang

#: Fixed value: what is left out of every scan.
EXCLUDED = ["node_modules/**", ".git/**", ".next/**", "dist/**", "build/**", "coverage/**", ".turbo/**", "target/**", "package-lock.json", "pnpm-lock.yaml", "bun.lockb"]


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ** crosses folders, * and ? do not, {a,b} are alternatives."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(p) for p in pattern[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return out


def glob_lines(text: str | None) -> list[str]:
    """Patterns of a text, one per line, trimmed, without empty ones."""
    return [x.strip() for x in (text or "").split("\n") if x.strip()]


def ignore_globs(text: str | None) -> list[str]:
    """Patterns of an ignore file: blank lines, comments and negations dropped; names without a slash hold in every folder."""
    out = []
    for line in glob_lines(text):
        if line.startswith(("#", "!")):
            continue
        p = line.strip("/")
        out += [p, f"{p}/**"] + ([] if "/" in p else [f"**/{p}", f"**/{p}/**"])
    return out


def any_of(globs: list[str]) -> str:
    return "^(?:" + "|".join(glob_regex(g) for g in globs) + ")$" if globs else "(?!)"


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, ignore_file: str | None = None, content: bool = False) -> DataFrame:
    """(path, absolute_path, kind, language, size_bytes, mtime_ms[, text]) of the files under root, in no order.

    Without include, files of known extensions; hidden files and folders, EXCLUDED, the ignore file's and the user's patterns
    are left out. Contents are only read if asked for, after the filters.
    """
    return _listed(spark, root, root, include, exclude, ignore_file, content)


#: Changed files up to which exactly these are opened; of more, all are read and the others dropped.
OPENED = 10_000


def read(spark: SparkSession, root: str, wanted: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, ignore_file: str | None = None) -> DataFrame:
    """scan with text of the files in wanted (path, absolute_path) only."""
    few = [r["absolute_path"] for r in wanted.select("absolute_path").limit(OPENED + 1).collect()]
    if not few:
        return _listed(spark, root, root, include, exclude, ignore_file, True).filter("false")
    if len(few) > OPENED:
        return _listed(spark, root, root, include, exclude, ignore_file, True).join(wanted.select("path"), "path", "left_semi")
    scheme = root.split(":", 1)[0] + ":" if re.match(r"[a-z][a-z0-9+.-]*://", root) else ""
    globbed = [scheme + re.sub(r"([*?{}\[\]\\])", r"\\\1", p) if not scheme else p for p in few]
    return _listed(spark, root, globbed, include, exclude, ignore_file, True)


def _listed(spark, root, load, include, exclude, ignore_file, content) -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(load)
    base = root.rstrip("/") + "/"
    f = f.withColumn("absolute_path", F.regexp_replace("path", "^file:/*", "/")).withColumn("path", F.expr(f"substring(absolute_path, {len(base) + 1})"))
    known = list(lang.CODE | lang.CONFIG | lang.MARKDOWN)
    want = F.col("path").rlike(any_of(include)) if include else lang.extension(F.col("path")).isin(known)
    skip = any_of([*EXCLUDED, *(f"**/{e}" for e in EXCLUDED), *ignore_globs(ignore_file), *(exclude or [])])
    f = f.filter(want & ~F.col("path").rlike(skip) & ~F.col("path").rlike(r"(^|/)\."))
    cols = ["path", "absolute_path", lang.kind(F.col("path")).alias("kind"), lang.language(F.col("path")).alias("language"), F.col("length").alias("size_bytes"), (F.unix_millis("modificationTime")).alias("mtime_ms")]
    return f.select(*cols, *([F.decode("content", "UTF-8").alias("text")] if content else []))
