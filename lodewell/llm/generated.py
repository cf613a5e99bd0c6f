"""Files nobody wrote by hand: generated, minified, vendored, data saved as code, lock files.

Every text is measured first: layout statistics (line lengths, white space, letters and digits, numeric literals, long
encoded runs) against thresholds of its language decide on minified code, data and lock files. What layout cannot tell,
code that a tool or a third party wrote in a natural layout, is known by a notice of its own in the head comment, in one of
several languages, or by where the file lies and what it is called. A notice counts only before the first line of code, so
that code which writes or discusses such notices stays hand-written. The evidence is given with the reason.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.session import spread
from lodewell.sources.tables import table

#: Prose is never source: these extensions have no rows.
PROSE = {"md", "markdown", "mdx", "txt", "rst", "adoc", ""}
LOCKS = re.compile(r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.ya?ml|bun\.lockb?|go\.sum|[^/]*\.lock|packages\.lock\.json|gradle\.lockfile)$")
VENDOR_DIRS = re.compile(
    r"(^|/)(vendor|vendored|third[_-]?party|3rdparty|node_modules|bower_components|jspm_packages|site-packages|dist-packages|godeps|extern|externals?|pods|carthage)/"
    r"|(^|/)_?(deps|lib|libs)/[a-z][\w-]*/v?\d+\.\d+(\.\d+)?/"
)
BUILT_DIRS = re.compile(r"(^|/)(_generated|__generated__|generated|autogen|dist|build/out|build/lib|\.next|\.nuxt)/")
BUILT_NAMES = re.compile(
    r"([.-]min\.(m?js|css)|\.bundle\.m?js|\.chunk\.js|\.pb\.(go|cc|h)|_pb2(_grpc)?\.pyi?|_pb\.(js|d\.ts)|(^|/)gen/[^/]*_pb\.rb"
    r"|(^|/)zz_generated\.[^/]*|[._]generated\.[^/]*|\.gen\.(go|ts|tsx|js|rs|py|rb)|\.g\.(ts|dart|cs|go|js)|\.designer\.cs|\.freezed\.dart)$"
)
#: A tool's notice at the start of a comment line, by language; {} and % mark a template, not a notice.
NOTICE = re.compile(
    r"^(code generated by|@generated\b|<auto-?generated|auto-?generated\b|this (file|code|module) (is|was|has been) (auto-?generated|automatically generated|machine.generated|generated|produced by|created by a tool)"
    r"|do not (modify|edit)\b.*\b(re)?generated|(automatically |auto-?)?(generated|produced|emitted|compiled) (automatically )?(by|from|with|using)\b.*(edit|generat|modif|overwrit|\d\.\d|\.\w+$)|(automatically |auto-?)?generated (by|from|with|using)\b"
    r"|this is (an )?(auto-?|automatically )generated|machine[- ](generated|output|written)|.*\b(machine|compiler|tool|generator)(-generated)? output\b.*\bedit\b"
    r"|(diese datei|dieser code)?\s*(wurde |wird )?(automatisch|maschinell) (erzeugt|generiert|erstellt)|(erzeugt|generiert) (von|mit|aus)\b.*(nicht|bitte)"
    r"|(ce )?(fichier|code|module) (a été |est )?(auto)?(g[ée]n[ée]r[ée]|produit|cr[ée][ée])e?\b.*\b(par|automatiquement|à partir)\b|(g[ée]n[ée]r[ée]|produit) automatiquement"
    r"|(este )?(archivo|fichero|c[óo]digo|m[óo]dulo) (ha sido |fue |es )?(auto)?(generado|producido|creado)\b.*\b(por|autom[áa]ticamente|a partir|con)\b|(auto)?(generado|producido) (autom[áa]ticamente|por)\b"
    r"|(este )?(arquivo|ficheiro) (foi |é )?gerado\b|gerado automaticamente|(questo )?(file|codice) (è stato |è )?generato\b|generato automaticamente|(dit )?bestand (is |werd )?(automatisch )?gegenereerd|automatisch gegenereerd"
    r"|(этот файл|файл) (создан|сгенерирован)|автоматически (создан|сгенерирован)|自动生成|自動生成|此文件由|このファイルは.*生成)",
    re.I,
)
#: What an upstream's licence notice names besides the licence: a release of a library, or where it came from.
UPSTREAM = re.compile(
    r"\bvendored\b|\bpulled from\b|\bupstream:|\bbundled (copy|from)\b|\bcopied from\b.*https?:"
    r"|\bversion v?\d+\.\d+[\w.]* of [\w@/.-]+|[\w@/.-]+ v?\d+\.\d+[\w.-]* *(-|—|\|) *(released under|(c)|copyright|mit\b|isc\b|bsd|apache|mpl|licen[sc]ed)"
    r"|[\w@/.-]+ v?\d+\.\d+[\w.-]* *(\(c\)|©|copyright)|\b(unchanged|unmodified|imported) from upstream"
    r"|permission is hereby granted.*\blibrary\b",
    re.I | re.S,
)
COMMENT = re.compile(r"^\s*(?:/\*+!?|\*+/?|//+!?|#+!?|<!--|--|;+|\"\"\"|''')\s?(.*?)\s*(?:\*/|-->)?\s*$")
#: Lines that may stand above a notice without ending the head.
HEAD = re.compile(r"^\s*($|package\s|import\b|from\s|require|use\s|['\"]use strict|#!|#\s*frozen_string|\)|\(|\"[\w/.@-]+\"$)")
NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w.])[,\s]*")
ENCODED = re.compile(r"[A-Za-z0-9+/_=-]{40,}")
SOURCE_MAP = re.compile(r"^\s*(?://|/\*)[#@] sourceMappingURL=\S+\s*(?:\*/)?$")

#: Thresholds by language: mean and longest line and greatest white-space share of minified code, least share of numeric
#: literals (of LITERALS or more) and of encoded runs in data. Formats that hold data by nature are compact without being
#: minified and full of literals without being dumps, so their thresholds are higher.
LIMITS = {
    "js": (90, 180, 0.09, 0.6, 0.74), "ts": (90, 180, 0.09, 0.6, 0.74), "css": (120, 250, 0.08, 0.6, 0.74), "code": (160, 400, 0.08, 0.6, 0.74),
    "json": (4_000, 16_000, 0.05, 0.85, 0.9), "config": (1_000, 4_000, 0.06, 0.85, 0.9), "key": (math.inf, math.inf, 0, 2, 2),
}
#: Numeric literals or encoded characters that a data file has at least.
LITERALS, ENCODED_LEAST = 24, 160
FAMILY = {"js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "ts": "ts", "tsx": "ts", "css": "css", "scss": "css", "json": "json", "yaml": "config", "yml": "config",
    "toml": "config", "xml": "config", "ini": "config", "env": "config", "csv": "config", "example": "config", "lock": "config", "pem": "key", "key": "key"}
#: Share of lines with a digest in a lock file; and how many there are at least.
PINNED, PINS = 0.12, 4
PIN = re.compile(r"(?m)^.*(?:\bsha(?:1|256|384|512)[-:=]|\bh1:|\bchecksum\b|\bintegrity\b|--hash=).*$")

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 2


def layout(text: str) -> dict[str, float]:
    """Layout statistics of a text; of empty text all are 0."""
    if not text:
        return dict.fromkeys(("lines", "mean_line", "max_line", "space", "alnum", "numbers", "literals", "encoded", "runs"), 0.0)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=3)
    ends = np.flatnonzero(raw == 10)
    edges = np.concatenate([[-1], ends, [len(raw)]])
    lengths = np.diff(edges) - 1
    full = lengths[lengths > 0]
    digits = int(((raw >= 48) & (raw <= 57)).sum())
    numbers = NUMBER.findall(text) if digits > 0.15 * len(raw) else []
    runs = sum(map(len, ENCODED.findall(text))) if lengths.max() >= 40 else 0
    n = len(raw)
    return {
        "lines": float(len(full)),
        "mean_line": float(full.mean()) if len(full) else 0.0,
        "max_line": float(lengths.max()),
        "space": kinds[1] / n,
        "alnum": kinds[2] / n,
        "numbers": sum(map(len, numbers)) / len(text),
        "literals": float(len(numbers)),
        "encoded": runs / len(text),
        "runs": float(runs),
    }


def head_comments(text: str) -> list[str]:
    """Comment lines before the first line of code, imports aside, however many; template placeholders are left out."""
    out, block, at = [], False, 0
    while at <= len(text):
        end = text.find("\n", at)
        line = text[at : end if end >= 0 else len(text)]
        at = end + 1 if end >= 0 else len(text) + 1
        s = line.strip()
        if block:
            out.append(s.lstrip("*").strip().removesuffix("*/").strip())
            block = "*/" not in s
        elif s.startswith("/*"):
            block = "*/" not in s
            out.append(s.lstrip("/*!").strip().removesuffix("*/").strip())
        elif (m := COMMENT.match(line)) and s and (s[0] in "/#;*<" or s.startswith(("--", '"""', "'''"))):
            out.append(m[1])
        elif not HEAD.match(line):
            break
    return [x for x in out if "%s" not in x and "{}" not in x]


def by_layout(text: str, family: str) -> str | None:
    """minified, data or lock by the layout statistics of a text against the thresholds of its family of languages."""
    s = layout(text)
    mean, longest, space, numbers, encoded = LIMITS[family]
    if s["numbers"] > numbers and s["literals"] >= LITERALS or s["encoded"] > encoded and s["runs"] >= ENCODED_LEAST:
        return "data"
    if s["alnum"] < 0.9 and (s["mean_line"] > mean and s["max_line"] > longest and s["space"] < space or s["mean_line"] > 5 * mean and s["space"] < 2 * space):
        return "minified"
    if family in ("json", "config") and s["encoded"] > 0.1 and len(pins := PIN.findall(text)) >= PINS and len(pins) >= PINNED * s["lines"]:
        return "lock"
    if family in ("js", "ts", "css"):
        body = text.rstrip()
        if SOURCE_MAP.match(body[body.rfind("\n") + 1 :]):
            return "minified"
    return None


def verdict(path: str | None, text: str | None) -> tuple[str, str] | None:
    """(reason, evidence) of a file that is not hand-written source; None if it is.

    Reasons: lock, vendored, generated, minified or data; evidence: layout, notice or place, tried in this order. Null or
    empty texts are judged by place alone, null paths by text alone as code. Prose has no verdict.
    """
    p = (path or "").replace("\\", "/")
    name = p.rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if path is not None and ext in PROSE:
        return None
    if text:
        if (why := by_layout(text, FAMILY.get(ext, "code"))) is not None:
            return why, "layout"
        head = head_comments(text)
        if any(NOTICE.match(x) for x in head):
            return "generated", "notice"
        if head and UPSTREAM.search("\n".join(head)):
            return "vendored", "notice"
    low = p.lower()
    for pattern, why in ((LOCKS, "lock"), (VENDOR_DIRS, "vendored"), (BUILT_DIRS, "generated"), (BUILT_NAMES, "generated")):
        if pattern.search(low):
            return why, "place"
    return None


def not_hand_written(docs: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """(key, reason, evidence) of the files that are not hand-written source; others have no row.

    One pass without a shuffle; whole texts are measured. See verdict for nulls. Repeated keys repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            why = [verdict(p, t) for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            at = [i for i, w in enumerate(why) if w is not None]
            found = [why[i] for i in at]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array([w for w, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["k", "reason", "evidence"])

    rows = docs.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(text).alias("t"))
    return spread(rows).mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, reason string, evidence string").select(F.col("k").alias(key), "reason", "evidence")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not hand-written source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "path", "text")
    return not_hand_written(docs).select("doc_id").distinct()


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
