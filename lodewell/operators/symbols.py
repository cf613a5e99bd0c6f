"""Symbols, imports and calls of source files.

Python is read by its own parser, or where that fails by lines and indentation. Go, Rust, Ruby, JavaScript and TypeScript are read from text whose comments and strings
are blanked in place, by declarations and matching block ends; see parse for what is covered.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.session import spread

#: Names that are no calls of interest, by language.
IGNORED = {
    "python": "if for while with return yield print len range str int float list dict set tuple bool isinstance issubclass super self cls type abs min max sum sorted enumerate zip map filter open input format getattr setattr hasattr delattr property staticmethod classmethod abstractmethod",
    "go": "if for switch select case go defer return make len cap append copy delete panic recover new print println close complex real imag min max clear string int int8 int16 int32 int64 uint float32 float64 bool byte rune error",
    "rust": "if while for loop match return let as in println print eprintln eprint format vec Box Some None Ok Err String str Vec Option Result self Self true false",
    "ruby": "if unless while until for return yield break next redo retry puts pp p print raise require require_relative load autoload attr_accessor attr_reader attr_writer include extend define_method lambda proc super self nil true false new Array Hash String Integer Float Symbol",
    "javascript": "if for while switch catch return function super typeof await",
}
IGNORED = {k: set(v.split()) for k, v in IGNORED.items()}
_PY_WORDS = set("and as assert async await case class def del elif else except finally from global import in is lambda match nonlocal not or pass raise try".split())
SCRIPTS = {"typescript", "tsx", "javascript", "jsx"}


@dataclass
class Parsed:
    """symbols: (name, kind, exported, start, end); calls: (caller, callee) inside symbols; called: every callee."""

    symbols: list[tuple[str, str, bool, int, int]] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    calls: list[tuple[str, str]] = field(default_factory=list)
    called: list[str] = field(default_factory=list)


def blank(text: str, language: str) -> str:
    """text with comments and strings turned to spaces, line ends and columns kept."""
    strings = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
    if language == "python":
        p = rf"\#[^\n]*|\"\"\".*?\"\"\"|'''.*?'''|{strings}"
    elif language == "ruby":
        p = rf"\#[^\n]*|^=begin\b.*?^=end[^\n]*|{strings}"
    elif language == "rust":
        p = r"//[^\n]*|/\*.*?\*/|b?r(#*)\".*?\"\1|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.)'"
    elif language == "go":
        p = rf"//[^\n]*|/\*.*?\*/|`[^`]*`|{strings}"
    else:
        p = rf"//[^\n]*|/\*.*?\*/|`(?:[^`\\]|\\.)*`|{strings}"
    return re.sub(p, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S | re.M)


def _unique(xs) -> list[str]:
    return list(dict.fromkeys(x for x in xs if x))


def _python(text: str) -> Parsed:
    out = Parsed()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)

    def name_of(f: ast.expr) -> str | None:
        return f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None

    def visit(node: ast.AST, scope: str | None) -> None:
        for c in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{scope}::{c.name}" if scope else c.name
                start = min([c.lineno, *(d.lineno for d in c.decorator_list)])
                out.symbols.append((inner, "class" if isinstance(c, ast.ClassDef) else "method" if scope else "function", not c.name.startswith("_"), start, c.end_lineno))
                for d in c.decorator_list:
                    n = name_of(d.func if isinstance(d, ast.Call) else d)
                    if n and n not in IGNORED["python"]:
                        out.calls.append((inner, n))
            elif isinstance(c, ast.Import):
                out.imports += [a.name for a in c.names]
            elif isinstance(c, ast.ImportFrom):
                base = "." * c.level + (c.module or "")
                out.imports.append(base)
                out.imports += [base + ("" if base.endswith(".") else ".") + a.name for a in c.names if a.name != "*"]
            elif isinstance(c, ast.Call) and (n := name_of(c.func)) and n not in IGNORED["python"]:
                out.called.append(n)
                if scope:
                    out.calls.append((scope, n))
            visit(c, inner)

    visit(tree, None)
    return out


def _python_lines(text: str) -> Parsed:
    """As _python, for files that do not parse: by lines and their indentation, over blanked text."""
    code, out, lines, spans = blank(text, "python"), Parsed(), _Lines(text), []
    stack: list[tuple[int, str, str, int, int]] = []  # indentation, name, kind, first line, offset
    decorators: list[tuple[int, str]] = []
    end, end_line, at = 0, 0, 0

    def close(depth: int) -> None:
        while stack and stack[-1][0] >= depth:
            _, name, kind, first, start = stack.pop()
            out.symbols.append((name, kind, not name.rpartition("::")[2].startswith("_"), first, end_line))
            spans.append((start, end + 1, name))

    for number, line in enumerate(code.split("\n"), 1):
        start, at = at, at + len(line) + 1
        bare = line.strip()
        if not bare or bare[0] in ")]}" or re.match(r"<{7}|={7}|>{7}|\|{7}", line):
            if bare and bare[0] in ")]}":
                end, end_line = at - 1, number
            continue
        depth = len(line[: len(line) - len(line.lstrip())].expandtabs())
        close(depth)
        end, end_line = at - 1, number
        if m := re.match(r"@\s*([\w.]+)", bare):
            decorators.append((number, m[1].rpartition(".")[2]))
        elif m := re.match(r"(?:async\s+)?(def|class)\s+(\w+)", bare):
            name = f"{stack[-1][1]}::{m[2]}" if stack else m[2]
            stack.append((depth, name, "class" if m[1] == "class" else "method" if stack else "function", decorators[0][0] if decorators else number, start))
            out.calls += [(name, d) for _, d in decorators if d not in IGNORED["python"]]
            decorators = []
    close(0)
    for m in re.finditer(r"^[ \t]*import[ \t]+([^\n;]+)", code, re.M):
        out.imports += [n for a in m[1].split(",") if (n := re.split(r"\s+as\s+", a.strip())[0].strip()) and re.fullmatch(r"[\w.]+", n)]
    for m in re.finditer(r"^[ \t]*from[ \t]+(\.*[ \t]*[\w.]*)[ \t]+import[ \t]*(?:\(([^)]*)\)?|([^\n;(]+))", code, re.M):
        base = m[1].replace(" ", "")
        names = [re.split(r"\s+as\s+", a.strip())[0] for a in (m[2] or m[3] or "").split(",")]
        out.imports += [base, *(base + ("" if base.endswith(".") else ".") + n for n in names if re.fullmatch(r"\w+", n))]
    return _with_calls(out, code, lines, spans, r"\b([A-Za-z_]\w*)\s*\(", IGNORED["python"] | _PY_WORDS, r"\b(?:def|class)\s+$|@\s*$")


def _close(code: str, at: int) -> int:
    """Offset behind the brace that closes the one at or after `at`; the text's end if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(code)


class _Lines:
    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)


def _with_calls(out: Parsed, code: str, lines: _Lines, spans: list[tuple[int, int, str]], pattern: str, ignored: set[str], skip: str = r"(?!)") -> Parsed:
    """Adds the calls found by pattern, each owned by the innermost span (start, end, name); one sweep over both."""
    later, open_ = sorted(spans, reverse=True), []
    for m in re.finditer(pattern, code):
        full = m[1]
        name = re.split(r"::|\.", full)[-1]
        if name in ignored or re.search(skip, code[max(0, m.start() - 12) : m.start()]):
            continue
        out.called.append(name)
        while later and later[-1][0] < m.start():
            open_.append(later.pop())
        while open_ and open_[-1][1] <= m.start():
            open_.pop()
        if open_:
            out.calls.append((open_[-1][2], full if full.startswith(("this.", "self.")) else name))
    return out


def _go(text: str) -> Parsed:
    code, out, lines, spans = blank(text, "go"), Parsed(), _Lines(text), []
    for m in re.finditer(r"^func\s*(?:\(\s*(?:\w+\s+)?\*?(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)[^\n{]*(\{)?", code, re.M):
        end = _close(code, m.end() - 1) if m[3] else m.end()
        name = f"{m[1]}::{m[2]}" if m[1] else m[2]
        out.symbols.append((name, "method" if m[1] else "function", m[2][0].isupper(), lines.of(m.start()), lines.of(end - 1)))
        spans.append((m.start(3) if m[3] else m.end(), end, name))
    for m in re.finditer(r"^type\s+(\w+)(?:\[[^\]]*\])?\s*=?\s*(struct|interface)?[^\n{]*(\{)?", code, re.M):
        end = _close(code, m.end() - 1) if m[3] else m.end()
        out.symbols.append((m[1], m[2] or "type", m[1][0].isupper(), lines.of(m.start()), lines.of(end - 1)))
    for m in re.finditer(r"^(const|var)\s+(\w+)", code, re.M):
        out.symbols.append((m[2], m[1], m[2][0].isupper(), lines.of(m.start()), lines.of(m.end())))
    for m in re.finditer(r"^import\s*(?:\((.*?)^\)|(?:[\w.]+\s+)?\"([^\"]+)\")", text, re.M | re.S):
        out.imports += [m[2]] if m[2] else re.findall(r"\"([^\"\n]+)\"", m[1])
    return _with_calls(out, code, lines, spans, r"\b([A-Za-z_][\w.]*)\s*(?:\[[\w, .*]*\])?\(", IGNORED["go"], r"func\s*(\([^)]*\)\s*)?$")


def _rust(text: str) -> Parsed:
    code, out, lines, spans = blank(text, "rust"), Parsed(), _Lines(text), []
    owners = []
    for m in re.finditer(r"^\s*(?:unsafe\s+)?(?:pub(?:\([^)]*\))?\s+)?(impl|trait)\b(?:<[^{;]*?>)?\s*([^{;]+?)\s*(?:where[^{]*)?\{", code, re.M):
        target = m[2].split(" for ")[-1].strip()
        owners.append((m.start(), _close(code, m.end() - 1), re.split(r"[<:\s]", target)[0]))
        out.symbols.append((owners[-1][2], m[1], "pub" in m[0], lines.of(m.start() + len(m[0]) - len(m[0].lstrip())), lines.of(owners[-1][1] - 1)))
    for m in re.finditer(r"^[ \t]*((?:pub(?:\([^)]*\))?\s+)?)(?:(?:default|const|async|unsafe|extern\s+\"[^\"]*\")\s+)*(fn|struct|enum|union|type|mod|static|const)\s+(\w+)", code, re.M):
        at = min([p for p in (code.find("{", m.end()), code.find(";", m.end())) if p >= 0] or [len(code)])
        end = _close(code, at) if at < len(code) and code[at] == "{" else at + 1
        owner = max((o for o in owners if o[0] < m.start() < o[1]), default=None)
        name = f"{owner[2]}::{m[3]}" if owner else m[3]
        kind = "method" if owner and m[2] == "fn" else {"fn": "function"}.get(m[2], m[2])
        out.symbols.append((name, kind, bool(m[1].strip()), lines.of(m.start(1)), lines.of(min(end, len(code)) - 1)))
        if m[2] == "fn":
            spans.append((at, end, name))
    for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", code, re.M):
        out.imports.append(re.sub(r"\s+", " ", m[1]))
    return _with_calls(out, code, lines, spans, r"\b([A-Za-z_][\w]*(?:(?:::|\.)[A-Za-z_]\w*)*)\s*(?:::<[^()]*>)?\(", IGNORED["rust"], r"\bfn\s+$")


def _ruby(text: str) -> Parsed:
    code, out, lines, spans = blank(text, "ruby"), Parsed(), _Lines(text), []
    rows = code.split("\n")
    stack: list[tuple[int, str, str]] = []
    private = set()
    for n, row in enumerate(rows, 1):
        indent = len(row) - len(row.lstrip())
        m = re.match(r"\s*(class|module|def)\s+((?:self\.)?[\w:]+[?!=]?)", row)
        if m and m[2] != "<<":
            while stack and stack[-1][0] >= indent:
                stack.pop()
            scope = stack[-1][1] if stack else ""
            name = m[2].removeprefix("self.")
            full = f"{scope}::{name}" if scope else name
            end = n
            if not re.search(r"\bend\s*$|^\s*def\s+[^=]*\)?\s=\s", row):
                end = next((k for k in range(n + 1, len(rows) + 1) if re.match(rf"\s{{{indent}}}end\b", rows[k - 1])), len(rows))
            kind = {"def": "method" if scope else "function"}.get(m[1], m[1])
            out.symbols.append((full, kind, scope not in private, n, end))
            stack.append((indent, full, m[1]))
            if m[1] == "def":
                spans.append((lines.starts[n - 1] + len(row), lines.starts[end - 1] if end <= len(lines.starts) else len(code), full))
        elif row.strip() == "private" and stack:
            private.add(stack[-1][1] if stack[-1][2] != "def" else stack[-1][1].rpartition("::")[0])
    out.imports += re.findall(r"^\s*require_relative\s+[\"']([^\"']+)[\"']", text, re.M)
    return _with_calls(out, code, lines, spans, r"\b((?:self\.|[A-Za-z_]\w*(?:\.|::))*[a-z_]\w*[?!]?)\(", IGNORED["ruby"], r"\bdef\s+$")


_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "with", "do", "else", "new", "await", "typeof", "super", "constructor"}


def _script(text: str) -> Parsed:
    code, out, lines, spans = blank(text, "javascript"), Parsed(), _Lines(text), []
    found: list[tuple[int, int, str, str, bool]] = []

    def add(start: int, brace: int, name: str, kind: str, exported: bool, end: int | None = None) -> None:
        found.append((start, _close(code, brace) if end is None else end, name, kind, exported))

    classes = []
    for m in re.finditer(r"(\bexport\s+(?:default\s+)?)?(?:\bdeclare\s+)?(?:\babstract\s+)?\b(class|interface|enum)\s+(\w+)[^{;]*\{", code):
        add(m.start(), m.end() - 1, m[3], m[2], bool(m[1]))
        if m[2] == "class":
            classes.append((m.end(), found[-1][1], m[3], bool(m[1])))
    for m in re.finditer(r"(\bexport\s+)?\btype\s+(\w+)(?:<[^=;]*>)?\s*=", code):
        end = code.find(";", m.end())
        add(m.start(), 0, m[2], "type", bool(m[1]), len(code) if end < 0 else end + 1)
    for m in re.finditer(r"(\bexport\s+(?:default\s+)?)?(?:\basync\s+)?\bfunction\s*\*?\s*(\w+)\s*(?:<[^>(]*>)?\([^{]*?\)(?:\s*:\s*[^{;]+)?\s*\{", code):
        add(m.start(), m.end() - 1, m[2], "function", bool(m[1]))
    for m in re.finditer(r"(\bexport\s+)?\b(?:const|let|var)\s+(\w+)(?:\s*:[^=;]+)?\s*=\s*(?:async\s+)?(?:function\b[^{]*|(?:<[^>(]*>\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|\w+)(?:\s*:\s*[^=;{]+)?\s*=>\s*)(\{)?", code):
        end = _close(code, m.end() - 1) if m[3] else next((p + 1 for p in [code.find(";", m.end())] if p >= 0), len(code))
        add(m.start(), 0, m[2], "function", bool(m[1]), end)
    for a, b, cls, exported in classes:
        depth_ok = re.compile(r"^[ \t]*(?:(?:public|private|protected|override|readonly|async)\s+)*(static\s+)?(?:async\s+)?(?:(get|set)\s+)?\*?(#?\w+)\s*(?:<[^>(]*>)?\([^{};]*\)(?:\s*:\s*[^{;]+)?\s*\{", re.M)
        at, inside, covered = a, sorted((f for f in found if a < f[0] < b and f[2] != cls), reverse=True), 0
        while (m := depth_ok.search(code, at, b)) is not None:
            at = m.end()
            while inside and inside[-1][0] < m.start():
                covered = max(covered, inside.pop()[1])
            if m[3] in _WORDS - {"constructor"} or m.start() < covered:
                continue
            mid = "static." if m[1] else f"{m[2]}." if m[2] else ""
            add(m.start(), m.end() - 1, f"{cls}.{mid}{m[3]}", "method", exported)
            covered = max(covered, found[-1][1])
    found.sort()
    seen: set[str] = set()
    callables: list[tuple] = []  # open ones, by their start
    for start, end, name, kind, exported in found:
        while callables and callables[-1][1] <= start:
            callables.pop()
        outer = next((f for f in reversed(callables) if f[0] < start and end <= f[1]), None)
        if kind in ("function", "method"):
            callables.append((start, end, name))
        full = name if kind == "method" or outer is None else f"{outer[2]}.{name}"
        if kind == "function" and (full, lines.of(start)) in seen:
            continue
        seen.add((full, lines.of(start)))
        first = start + len(code[start:end]) - len(code[start:end].lstrip())
        out.symbols.append((full, kind, exported, lines.of(first), lines.of(min(end, len(code)) - 1)))
        if kind in ("function", "method"):
            spans.append((start + 1, end, full))
    out.imports += _unique(re.findall(r"(?:\bimport\b(?:[^;\"'`]*?\bfrom)?|\bexport\b[^;\"'`=(){]*(?:\{[^}]*\})?\s*from)\s*[\"']([^\"']+)[\"']", text))
    names = {s[0] for s in out.symbols}
    _with_calls(out, code, lines, spans, r"\b((?:this\.|[A-Za-z_$][\w$]*\??\.)*[A-Za-z_$][\w$]*)\s*(?:<[\w, <>\[\]|.]*>)?\(", IGNORED["javascript"] | _WORDS, r"\bfunction\s*\*?\s*$|\bnew\s+$")
    calls = []
    for caller, callee in out.calls:
        if callee.startswith("this.") and "." in caller:
            callee = f"{caller.split('.')[0]}.{callee[5:]}" if callee.count(".") == 1 else callee.rpartition(".")[2]
        calls.append((caller, callee))
    own = [(c, k) for c, k in calls if k not in {s.rpartition(".")[2] for s in names if s == c}]
    out.calls = own
    return out


def parse(language: str | None, text: str | None) -> Parsed:
    """Symbols, imports and calls of a text; empty for other languages, null or empty texts and what cannot be read.

    Covered: Python all definitions; Go functions, methods (Type::name), types, constants, variables; Rust items and methods
    (Type::name); Ruby classes, modules, methods by indentation; scripts classes with members (C.m, C.static.m, C.get.x),
    interfaces, enums, types, functions and function-valued variables, nested ones as outer.inner.
    """
    if not text:
        return Parsed()
    try:
        if language == "python":
            try:
                p = _python(text)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                p = _python_lines(text)
        elif language == "go":
            p = _go(text)
        elif language == "rust":
            p = _rust(text)
        elif language == "ruby":
            p = _ruby(text)
        elif language in SCRIPTS:
            p = _script(text)
        else:
            return Parsed()
    except (SyntaxError, ValueError, RecursionError):
        return Parsed()
    p.symbols.sort(key=lambda s: (s[3], -s[4]))
    p.imports, p.called = _unique(p.imports), _unique(p.called)
    p.calls = list(dict.fromkeys(p.calls))
    return p


SCHEMA = (
    "symbols array<struct<name: string, kind: string, exported: boolean, start: int, end: int>>, imports array<string>, "
    "calls array<struct<caller: string, callee: string>>, called array<string>"
)


def parse_documents(docs: DataFrame, key: str = "doc_id", language: str = "language", text: str = "text") -> DataFrame:
    """(key, path, language, symbols, imports, calls, called) of docs (key, path, language, text), one row each."""
    rows = spread(docs.select(F.col(key).alias("k"), "path", F.col(language).alias("language"), F.col(text).alias("t")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ps = [parse(a, b) for a, b in zip(f["language"], f["t"], strict=True)]
            yield pd.DataFrame(
                {
                    "k": f["k"], "path": f["path"], "language": f["language"],
                    "symbols": [[dict(zip(("name", "kind", "exported", "start", "end"), s, strict=True)) for s in p.symbols] for p in ps],
                    "imports": [p.imports for p in ps],
                    "calls": [[{"caller": a, "callee": b} for a, b in p.calls] for p in ps],
                    "called": [p.called for p in ps],
                }
            )

    return rows.mapInPandas(run, f"k {rows.schema['k'].dataType.simpleString()}, path string, language string, {SCHEMA}").withColumnRenamed("k", key)


def from_cache(docs: DataFrame, cache: DataFrame, versions: list[str]) -> tuple[DataFrame, DataFrame]:
    """docs that a parse cache covers, and those to parse: equal content hash and a version of `versions` is a hit."""
    good = cache.filter(F.col("parser_version").isin(versions)).select(F.col("document_id").alias("doc_id"), F.lower("content_hash").alias("__h")).distinct()
    d = docs.withColumn("__h", F.lower("content_hash"))
    return d.join(good, ["doc_id", "__h"], "left_semi").drop("__h"), d.join(good, ["doc_id", "__h"], "left_anti").drop("__h")
