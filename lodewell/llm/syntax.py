"""Source files that do not parse.

Every file is cut into token classes and read by the memoised derivatives of its language's grammar (derive.py).
Python, JSON, TOML and YAML have exact parsers at hand: files that the derivatives reject are put to those, since
their grammars here are on the strict side. The result names the failing token, or that the text breaks off.
"""

from __future__ import annotations

import ast
import functools
import io
import json
import re
import sys
import tomllib
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm import grammars as G
from lodewell.llm.derive import LINE_END, Grammar
from lodewell.session import spread
from lodewell.sources.tables import table

try:
    import yaml
except ImportError:  # the derivatives alone decide
    yaml = None

SKIP, BAD = -1, -9
#: Class memo entries of a language, at most.
KEPT = 200_000


class Language:
    """A token pattern, the class of a token, and a grammar."""

    def __init__(self, pattern: str, grammar: str, start: str, line_end: str | None = None, words: str = "", signs: dict[str, str] | None = None):
        self.find = re.compile(pattern, re.S).findall
        self.iter = re.compile(pattern, re.S).finditer
        self.grammar = Grammar(grammar, start, line_end)
        c = self.grammar.classes
        self.of = c
        self.word_set = {w for w in words.split() if w in c}
        self.known: dict[str, int] = {}
        self.fixed: dict[str, int] = {w: c[w] for w in self.word_set}
        for s, name in (signs or {}).items():
            self.fixed[s] = c.get(name, BAD)
        for name in c:
            if not re.match(r"\w", name):
                self.fixed.setdefault(name, c[name])
        self.known.update(self.fixed)
        self.kind: Callable[[str], int] = lambda s: BAD
        self.after: Callable[[list[int], list[str]], list[int]] | None = None

    def classes(self, text: str) -> tuple[list[int], list[str]]:
        get, kind = self.known.get, self.kind
        toks = self.find(text)
        if len(self.known) > KEPT:
            self.known = dict(self.fixed)
            get = self.known.get
        out = []
        for s in toks:
            k = get(s)
            if k is None:
                k = kind(s)
                if len(s) < 40:
                    self.known[s] = k
            out.append(k)
        return out, toks

    def error(self, text: str) -> tuple[str, int] | None:
        """('invalid' or 'truncated', offset), or None."""
        ks, toks = self.classes(text)
        if self.after is not None:
            ks, at = self.after(ks, toks)
        else:
            at = None
            if SKIP in ks:
                at = [i for i, k in enumerate(ks) if k != SKIP]
                ks = [ks[i] for i in at]
        r = self.grammar.run(ks)
        if r is None:
            return None
        if r >= len(ks):
            return "truncated", len(text)
        index = at[r] if at is not None else r
        for n, m in enumerate(self.iter(text)):
            if n == index:
                return "invalid", m.start()
        return "invalid", len(text)


_STR = r'"(?:[^"\\\n]|\\.)*"'
_CHR = r"'(?:[^'\\\n]|\\.)*'"
_BLOCK = r"/\*.*?\*/"

# JavaScript, TypeScript

_REGEX = r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_TPL = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|`(?:[^`\\]|\\.)*`|\{(?:[^{}`]|`(?:[^`\\]|\\.)*`|\{[^{}]*\})*\})*\})*`"
_SCRIPT_TOKENS = (
    rf"[ \t\r\f\v\ufeff\u00a0\u2028]*(//[^\n]*|{_BLOCK}|\n|(?:[=(,:\[!&|?{{}};+\-*%~^>]|return|typeof|case|of|in)[ \t\n]*{_REGEX}|[^\W\d][\w$]*|\$[\w$]*|\#[^\W\d][\w$]*|{_STR}|{_CHR}|{_TPL}"
    r"|0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?"
    r"|\.\.\.|=>|===|!==|==|!=|<=|>=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\*\*=|\*\*|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|<<|\S)"
)
_SCRIPT_WORDS = (
    "import export default return throw break continue debugger do while if else for await with try catch finally switch case const var function class extends in instanceof "
    "typeof void delete new yield this super null true false enum async get set of from as type declare namespace abstract is readonly infer keyof accessor interface static assert satisfies asserts unique implements let"
)
_MODS = {w: "mod" for w in ("public", "private", "protected", "override", "module")}
_SCRIPT_SIGNS = {
    "=>": "arrow", "?.": "opt", "++": "inc", "--": "inc", ">=": "geq", "\\": "odd", "#": "odd", "%": "bin", "^": "bin",
    **dict.fromkeys("=== !== == != <= && || ?? ** <<".split(), "bin"),
    **dict.fromkeys("+= -= *= /= %= &= |= ^= <<= **= &&= ||= ??=".split(), "asg"),
}


def _script(types: bool, jsx: bool) -> Language:
    # between tags an apostrophe within a word opens no string
    tokens = _SCRIPT_TOKENS.replace("|" + _CHR + "|", r"|(?<!\w)" + _CHR + "|") if jsx else _SCRIPT_TOKENS
    g = Language(tokens, G.script(types, jsx), "program", "nl", _SCRIPT_WORDS, _SCRIPT_SIGNS | (_MODS if types else {}))
    c = g.of
    g.fixed["\n"] = g.known["\n"] = LINE_END
    if not jsx:
        for s in ("\\", "#"):
            g.fixed[s] = g.known[s] = BAD
    combined = re.compile(rf"(\W|\w+)[ \t\n]*({_REGEX})", re.S)

    def kind(s: str) -> int:
        a = s[0]
        if s.startswith("//") or s.startswith("/*") and len(s) > 3:
            return SKIP if "\n" not in s else LINE_END
        if a.isalpha() or a in "_$":
            return c["id"] if combined.fullmatch(s) is None else -100
        if a in "\"'":
            return c["str"] if len(s) > 1 else c.get("odd", BAD)
        if a == "`":
            return c["tpl"] if len(s) > 1 else BAD
        if a.isdigit() or a == "." and len(s) > 1 and s[1].isdigit():
            return c["num"]
        if a == "#" and len(s) > 1:
            return c["private"]
        if len(s) > 2 and "/" in s and combined.fullmatch(s) is not None:
            return -100
        return c.get("odd", BAD) if jsx and a not in "\0\x01\x1b" else BAD

    def after(ks: list[int], toks: list[str]) -> tuple[list[int], list[int]]:
        out, at = [], []
        for i, k in enumerate(ks):
            if k == -100:  # an operator and a regular expression
                m = combined.fullmatch(toks[i])
                first = g.known.get(m[1])
                out += [BAD if first is None else first, c["regex"]]
                at += [i, i]
            elif k != SKIP:
                out.append(k)
                at.append(i)
        return out, at

    g.kind, g.after = kind, after
    return g


# Go


def _go() -> Language:
    tokens = (
        rf"[ \t\r\ufeff]*(//[^\n]*|{_BLOCK}|\n|[^\W\d]\w*|{_STR}|`[^`]*`|'(?:[^'\\\n]|\\.)+'|0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?"
        r"|\.\.\.|:=|<-|\+\+|--|==|!=|<=|>=|&&|\|\||<<=|>>=|<<|>>|&\^=|&\^|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S)"
    )
    words = "package import func var const type map chan struct interface return break continue goto fallthrough if else switch case default for range go defer select"
    signs = {":=": "define", "<-": "arrow", "++": "inc", "--": "inc", "|": "bar", "~": "tilde", "/": "bin", "%": "bin", "<": "bin", ">": "bin"}
    signs |= dict.fromkeys("== != <= >= && || << >> &^".split(), "bin") | dict.fromkeys("<<= >>= &^= += -= *= /= %= &= |= ^=".split(), "asg")
    g = Language(tokens, G.GO, "file", None, words, signs)
    c = g.of
    line, semi = -20, c[";"]
    g.fixed["\n"] = g.known["\n"] = line
    ends = {c[x] for x in ("id", "num", "str", ")", "]", "}", "inc", "return", "break", "continue", "fallthrough")}

    def kind(s: str) -> int:
        a = s[0]
        if s.startswith("//"):
            return SKIP
        if s.startswith("/*") and len(s) > 3:
            return line if "\n" in s else SKIP
        if a.isalpha() or a == "_":
            return c["id"]
        if a in "\"`'" and len(s) > 1:
            return c["str"]
        return c["num"] if a.isdigit() or a == "." and len(s) > 1 else BAD

    def after(ks, toks):
        out, at, last = [], [], None
        for i, k in enumerate(ks):
            if k == line:
                if last in ends:
                    out.append(semi)
                    at.append(i)
                    last = semi
            elif k != SKIP:
                out.append(k)
                at.append(i)
                last = k
        if last in ends:
            out.append(semi)
            at.append(len(toks))
        return out, at

    g.kind, g.after = kind, after
    return g


# Rust


def _rust() -> Language:
    tokens = (
        rf"\s*(//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*.*?\*/)*\*/|\#!(?!\[)[^\n]*|b?r(\#*)\".*?\"\2|[bc]?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\(?:u\{{[^}}]*\}}|x..|.))'|'[^\W\d]\w*(?!')|r\#[^\W\d]\w*|[^\W\d]\w*"
        r"|0[xbo][\da-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d+)?\w*|\.\.=|\.\.\.|\.\.|::|->|=>|==|!=|<=|>=|&&|\|\||<<=|>>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S)"
    )
    words = (
        "use struct enum impl trait mod const static type extern crate pub in self Self super as fn mut ref where for dyn unsafe async await move let else if match while loop return break continue yield raw union auto _"
    )
    signs = {"&&": "and", "||": "or", "|": "bar", ">=": "geq", "<=": "leq", "/": "bin", "%": "bin", "^": "bin"}
    signs |= dict.fromkeys("== !=".split(), "bin") | dict.fromkeys("<<= >>= += -= *= /= %= &= |= ^=".split(), "asg")
    g = Language(tokens, G.RUST, "file", None, words, signs)
    find, iter_ = g.find, g.iter
    g.find = lambda text: [m[0] for m in find(text)]
    c = g.of
    for w in ("true", "false"):
        g.fixed[w] = g.known[w] = c["lit"]
    for w in ("raw", "union", "auto"):
        if w not in c:
            g.fixed.pop(w, None)

    def kind(s: str) -> int:
        a = s[0]
        if s.startswith("//") or s.startswith("/*") and len(s) > 3:
            return SKIP
        if s.startswith("#!") and len(s) > 2:
            return c["shebang"]
        if a in "brc" and '"' in s or a == '"' and len(s) > 1:
            return c["str"]
        if a in "b'" and s.endswith("'") and len(s) > 2:
            return c["lit"]
        if a == "'" and len(s) > 1:
            return c["life"]
        if a.isalpha() or a == "_":
            return c["id"]
        return c["lit"] if a.isdigit() else BAD

    g.kind = kind
    return g


# Ruby


def _ruby() -> Language:
    regex = r"/(?![\s=])(?:[^\\/\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
    interp = r"(?:[^\"\\#]|\\.|\#(?!\{)|\#\{(?:[^{}\"]|\"(?:[^\"\\]|\\.)*\"|\{[^{}]*\})*\})"
    tokens = (
        rf"[ \t\r\f\ufeff]*?([ \t](?:-(?=[^\s=>])|\*\*(?=[^\s=])|\*(?=[^\s=*])|&(?=[^\s=&.])|\[)|\n=begin\b.*?\n=end[^\n]*|\#[^\n]*|__END__\n.*|\\\n|\n|<<[~-]?(?P<q>['\"]?)(?P<h>[A-Z_]\w*)(?P=q)[^\n]*\n.*?\n[ \t]*(?P=h)\b"
        rf"|(?:[=(,:\[!&|?{{}};~]|\bif|\bunless|\bwhen|\band|\bor|\breturn|=~|\n)[ \t]*{regex}|\"{interp}*\"(?::(?!:))?|'(?:[^'\\]|\\.)*'(?::(?!:))?|`(?:[^`\\]|\\.)*`"
        r"|%[wWiIqQr]?(?:\((?:[^()\\]|\\.|\([^()]*\))*\)|\[(?:[^\]\\]|\\.)*\]|\{(?:[^{}\\]|\\.|\{[^{}]*\})*\}|\|[^|]*\||![^!]*!)[a-z]*"
        r"|[^\W\d]\w*[?!]?:(?![:])|(?<![:\w]):(?:[^\W\d]\w*[?!=]?(?![>=~])|\"(?:[^\"\\]|\\.)*\"|\[\]=?|[+\-*/<>]|<=>|==)|@@?[^\W\d]\w*|\$(?:[^\W\d]\w*|\d+|\W)|defined\?|[^\W\d]\w*[?!](?!=[^=~>])|[^\W\d]\w*|\?[a-zA-Z](?!\w)"
        r"|0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?r?i?|\.\.\.|\.\.|<=>|===|==|=~|!~|!=|<<=|>>=|<<|>>|<=|>=|&&=|\|\|=|&&|\|\||\*\*=|\*\*|\+=|-=|\*=|/=|%=|&=|\|=|\^=|=>|->|&\.|::|\S)"
    )
    words = "class def if unless while until rescue end begin ensure else elsif case when in then do for and or not return break next redo retry super yield self nil true alias undef module BEGIN END"
    signs = {x + y: n for x in " \t" for y, n in {"-": "um", "*": "ust", "**": "uss", "&": "uamp", "[": "ubr"}.items()}
    signs |= {"||": "or", "|": "bar", "<<": "shl", "...": "..", "%": "bin", "^": "bin", "->": "lambda", "defined?": "defined", "false": "true", "__FILE__": "str", "__LINE__": "num", "__dir__": "str", "__method__": "id"}
    signs |= dict.fromkeys("<=> === == =~ !~ != >> <= >= &&".split(), "bin") | dict.fromkeys("<<= >>= &&= ||= **= += -= *= /= %= &= |= ^=".split(), "asg")
    grammar = G.RUBY.replace("bin = 'bin' |", "bin = 'bin' | 'or' |").replace("and' | 'or') ('not'", "and' | 'orw') ('not'").replace("kw = 'class'", "kw = 'orw' | 'class'")
    g = Language(tokens, grammar, "program", "nl", words.replace(" or ", " "), signs | {"or": "orw"})
    find = g.find
    g.find = lambda text: [m[0] for m in find(text)]
    c = g.of
    g.fixed["\n"] = g.known["\n"] = LINE_END
    g.fixed["\\\n"] = g.known["\\\n"] = SKIP
    combined = re.compile(rf"(\W|=~|\w+)[ \t]*({regex})", re.S)

    def kind(s: str) -> int:
        a = s[0]
        if a == "#":
            return SKIP
        if s.startswith("\n=begin"):
            return LINE_END
        if s.startswith("__END__"):
            return c["data"]
        if s.startswith("<<") and len(s) > 3:
            return -101
        if a in "\"'":
            if len(s) > 1:
                return c["slabel"] if s.endswith(":") and s[-2] == a else c["str"]
            return BAD
        if a == "`":
            return c["str"] if len(s) > 1 else BAD
        if a == "%" and len(s) > 2:
            return c["words"] if s[1] in "wWiI" else c["regex"] if s[1] == "r" else c["str"]
        if a == ":" and len(s) > 1:
            return c["sym"] if combined.fullmatch(s) is None else -100
        if a == "@" or a == "$" and len(s) > 1:
            return c["ivar"] if len(s) > 1 else BAD
        if a.isalpha() or a == "_":
            if combined.fullmatch(s) is not None:
                return -100
            if s.endswith(":"):
                return c["label"]
            return c["fid"] if s[-1] in "?!" else c["const"] if a.isupper() else c["id"]
        if a.isdigit() or a == "?" and len(s) == 2:
            return c["num"]
        if "/" in s and len(s) > 2 and combined.fullmatch(s) is not None:
            return -100
        return BAD

    def after(ks, toks):
        out, at = [], []
        for i, k in enumerate(ks):
            if k == -100:
                m = combined.fullmatch(toks[i])
                first = g.known.get(m[1])
                out += [BAD if first is None else first, c["regex"]]
                at += [i, i]
            elif k == -101:  # a here-document: what follows its mark on the line comes before its text
                m = re.match(r"<<[~-]?(['\"]?)\w+\1([^\n]*)\n", toks[i])
                out.append(c["str"])
                at.append(i)
                rest, names = g.classes(m[2])
                rest, _ = after(rest, names)
                out += [*rest]
                at += [i] * len(rest)
            elif k != SKIP:
                out.append(k)
                at.append(i)
        return out, at

    g.kind, g.after = kind, after
    return g


# SCSS


def _scss() -> Language:
    tokens = (
        rf"\s*(//[^\n]*|{_BLOCK}|{_STR}|{_CHR}|url\([^)\"']*\)|\#\{{[^{{}}]*\}}|@[\w-]+|\$[\w-]+|%[a-zA-Z_][\w-]*|\.[a-zA-Z_-][\w-]*|\#[\w-]+|!\s*[a-z]+|-?\d*\.?\d+(?:[eE][+-]?\d+)?(?:%|[a-zA-Z]+)?|U\+[\w?-]+|--[\w-]+|-?[^\W\d][\w-]*"
        r"|::|\.\.\.|==|!=|<=|>=|[~^$*|]=|\S)"
    )
    signs = {"::": ":", "==": "cmp", "!=": "cmp", "<=": "cmp", ">=": "cmp", "%": "bin", **dict.fromkeys("~= ^= $= *= |=".split(), "aeq"), "|": "bar"}
    g = Language(tokens, G.SCSS, "sheet", None, "", signs)
    c = g.of

    def kind(s: str) -> int:
        a = s[0]
        if s.startswith("//") or s.startswith("/*") and len(s) > 3:
            return SKIP
        if a in "\"'":
            return c["str"] if len(s) > 1 else BAD
        if s.startswith("#{"):
            return c["interp"]
        if s.startswith("url("):
            return c["url"]
        if a == "@" and len(s) > 1:
            return c["at"]
        if a == "$" and len(s) > 1:
            return c["var"]
        if a == "%" and len(s) > 1:
            return c["place"]
        if a == "." and len(s) > 1 and not s[1].isdigit():
            return c["class"]
        if a == "#" and len(s) > 1:
            return c["hash"]
        if a == "!" and len(s) > 1:
            return c["imp"]
        if re.match(r"-?\d*\.?\d", s):
            return c["pct"] if s.endswith("%") else c["num"]
        return c["id"] if a.isalpha() or a in "_-" and len(s) > 1 else BAD

    g.kind = kind
    return g


# Python


def _python() -> Language:
    prefix = r"(?:[rRbBuUfFtT]{0,2})"
    tokens = (
        rf"[ \t\f]*(\#[^\n]*|\\\r?\n|\r?\n[ \t\f]*|{prefix}\"\"\"(?:[^\\]|\\.)*?\"\"\"|{prefix}'''(?:[^\\]|\\.)*?'''|{prefix}{_STR}|{prefix}{_CHR}|[^\W\d]\w*"
        r"|0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[jJ]?(?!\w)|\.\.\.|->|:=|\*\*=|\*\*|//=|//|>>=|<<=|>>|<<|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\S)"
    )
    words = (
        "pass break continue return raise from global nonlocal del assert import as yield if elif else while for in try except finally with async def class match case lambda and or not is await type None"
    )
    signs = {"True": "None", "False": "None", **dict.fromkeys("% & | ^ < > // >> << == != <= >=".split(), "bin"), **dict.fromkeys("**= //= >>= <<= += -= *= /= %= &= |= ^= @=".split(), "asg")}
    g = Language(tokens, G.PYTHON, "file", None, words, signs)
    c = g.of
    nl, ind, ded = c["nl"], c["indent"], c["dedent"]
    opens, closes = {c["("], c["["], c["{"]}, {c[")"], c["]"], c["}"]}

    def kind(s: str) -> int:
        a = s[0]
        if a in "\r\n":
            return -20
        if a == "#":
            return SKIP
        if a == "\\" and len(s) > 1:
            return SKIP
        if s[-1] in "\"'" and len(s) > 1:
            return c["str"]
        if a.isalpha() or a == "_":
            return c["id"]
        if a.isdigit() or a == "." and len(s) > 1:
            return BAD if re.match(r"0\d*[1-9]", s) and s.isdigit() else c["num"]
        return BAD

    def after(ks, toks):
        out, at, depth, stack, new = [], [], 0, [""], True
        pending = ""
        for i, k in enumerate(ks):
            if k == -20:
                if depth == 0:
                    if out and out[-1] not in (nl, ind, ded):
                        out.append(nl)
                        at.append(i)
                    pending, new = toks[i].lstrip("\r\n"), True
                continue
            if k == SKIP:
                continue
            if new:
                new = False
                if pending != stack[-1]:
                    if pending.startswith(stack[-1]):
                        stack.append(pending)
                        out.append(ind)
                        at.append(i)
                    else:
                        while stack and stack[-1] != pending and len(stack) > 1:
                            stack.pop()
                            out.append(ded)
                            at.append(i)
                        if stack[-1] != pending:
                            out.append(BAD)
                            at.append(i)
            out.append(k)
            at.append(i)
            if k in opens:
                depth += 1
            elif k in closes and depth:
                depth -= 1
        if out and out[-1] not in (nl, ind, ded) and not depth:
            out.append(nl)
            at.append(len(toks))
        if not depth:
            for _ in stack[1:]:
                out.append(ded)
                at.append(len(toks))
        return out, at

    g.kind, g.after = kind, after
    return g


# JSON, TOML, YAML


def _json() -> Language:
    tokens = r"[ \t\r\n]*(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[a-z]+|[^ \t\r\n])"
    g = Language(tokens, G.JSON, "v", None, "", {"true": "word", "false": "word", "null": "word"})
    c = g.of
    g.kind = lambda s: c["str"] if s[0] == '"' and len(s) > 1 else c["num"] if re.match(r"-?\d", s) else BAD
    return g


def _toml() -> Language:
    tokens = (
        r"[ \t]*(\#[^\n]*|\r?\n|\"\"\".*?\"\"\"\"{0,2}|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'|\[\[|\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?"
        r"|[+-]?(?:0x[\da-fA-F_]+|0o[0-7_]+|0b[01_]+|inf|nan|(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d+)?)(?![\w-])|[A-Za-z0-9_-]+|\S)"
    )
    g = Language(tokens, G.TOML, "file", None, "", {"true": "bool", "false": "bool"})
    c = g.of

    def kind(s: str) -> int:
        a = s[0]
        if a == "#":
            return SKIP
        if s in ("\n", "\r\n"):
            return c["nl"]
        if s.startswith(('"""', "'''")) and len(s) > 5:
            return c["mstr"]
        if a in "\"'":
            return c["str"] if len(s) > 1 else BAD
        if re.fullmatch(r"\d+", s):
            return c["num"]
        if re.match(r"[+-]?(\d|inf\b|nan\b)", s) and not re.fullmatch(r"[A-Za-z0-9_-]*[A-Zac-z_-][A-Za-z0-9_-]*", s.replace("inf", "").replace("nan", "") or "1") or re.match(r"\d{4}-|\d\d:|[+-]?0[xob]|[+-]?\d[\d_]*(\.|[eE])", s):
            return c["val"]
        if re.fullmatch(r"[+-]?\d[\d_]*", s):
            return c["val"]
        return c["bare"] if re.fullmatch(r"[A-Za-z0-9_-]+", s) else BAD

    g.kind = kind
    return g


_Y_PLAIN = r"(?:(?![\[\]{}&*!|>%@`#'\",?:-]|[ \t])|[?:-](?=\S))(?:(?!: |:$| #)[^\n\x00-\x08\x0b-\x1f\x7f\ufeff\ufffe\uffff])*"
_Y_SCALAR = rf"(?:{_Y_PLAIN}|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\n]|'')*'|\[[^\[\]{{}}#&*!|>%@`\"':\n]*\]|\{{\}})"
_Y_KEY = r"(?:[A-Za-z0-9_./$][^\s:#,\[\]{}\"'&*!|>%`]*(?: [^\s:#,\[\]{}\"'&*!|>%`]+)*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\n]|'')*')"
_Y_END = r"[ \t]*(?:[ \t]\#.*)?$"
_Y_LINES = [
    ("pair", re.compile(rf"{_Y_KEY}:[ \t]+{_Y_SCALAR}{_Y_END}")),
    ("open", re.compile(rf"{_Y_KEY}:{_Y_END}")),
    ("ipair", re.compile(rf"-[ \t]+{_Y_KEY}:[ \t]+{_Y_SCALAR}{_Y_END}")),
    ("ikey", re.compile(rf"-[ \t]+{_Y_KEY}:{_Y_END}")),
    ("item", re.compile(rf"-[ \t]+(?!-[ \t]){_Y_SCALAR}{_Y_END}")),
    ("iopen", re.compile(rf"-{_Y_END}")),
    ("sep", re.compile(rf"---{_Y_END}")),
]


#: What may stand before a value on a line: an item's dash, a key, or both.
_Y_LEAD = rf"(?P<item>-[ \t]+)?(?P<key>{_Y_KEY}:[ \t]+)?(?:[&!][^\s,\[\]{{}}]*[ \t]+)*"
_Y_BLOCK = re.compile(rf"{_Y_LEAD}[|>](?:[+-]?(?P<by>[1-9])?[+-]?){_Y_END}")
_Y_FLOW = re.compile(rf"{_Y_LEAD}(?=[\[{{])")
_Y_FLOW_TOKEN = re.compile(
    r"(?P<skip>(?:[ \t\r\n]+(?:#[^\n]*)?|[&!][^\s,\[\]{}]*)+)|(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*')|(?P<punct>[\[\]{},])"
    r"|(?P<colon>:(?=[\s,\[\]{}]|$))|(?P<plain>(?:[^\s,\[\]{}#&!|>'\"%@`:?-]|[?:-](?=[^\s,\[\]{}]))(?:(?!:[\s,\[\]{}])(?![ \t]+#)[^\r\n,\[\]{}])*)",
    re.S,
)


class Yaml:
    """YAML by lines: block maps and sequences, block scalars by their indentation, flow collections by a grammar of their own.

    Scalars that run over several lines outside of these, complex keys and directives count as bad.
    """

    def __init__(self):
        self.grammar, self.flow = Grammar(G.YAML, "file"), Grammar(G.YAML_FLOW, "v")

    def _flow_end(self, text: str, at: int) -> int | None:
        """Where the flow collection that starts at `at` ends; None if it is no sentence of its grammar."""
        c, out, depth, last = self.flow.classes, [], 0, ""
        while at < len(text):
            if text[at] == ":" and last in ("str", "]", "}"):  # as in JSON, a value may follow at once
                out.append(c[":"])
                at, last = at + 1, ":"
                continue
            m = _Y_FLOW_TOKEN.match(text, at)
            if m is None:
                return None
            at = m.end()
            kind = m.lastgroup
            if kind == "skip":
                continue
            last = m[0] if kind == "punct" else ":" if kind == "colon" else kind
            out.append(c[last])
            depth += (last in ("[", "{")) - (last in ("]", "}"))
            if not depth:
                return at if self.flow.run(out) is None else None
        return None

    def error(self, text: str) -> tuple[str, int] | None:
        c = self.grammar.classes
        out, at, stack, pos = [], [], [0], 0
        while pos <= len(text):
            start = pos
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
            pos = end + 1
            body = text[start:end].rstrip("\r")
            s = body.lstrip(" ")
            if not s.strip() or s.startswith("#"):
                continue
            depth = len(body) - len(s)
            if (m := _Y_BLOCK.match(s)) and (m["item"] or m["key"]):
                name = "ipair" if m["item"] and m["key"] else "item" if m["item"] else "pair"
                pos = self._block_end(text, pos, depth + (len(m["item"]) if name == "ipair" else 0), m["by"])
            elif (m := _Y_FLOW.match(s)) is not None:
                name = "ipair" if m["item"] and m["key"] else "item" if m["item"] else "pair" if m["key"] else "scalar"
                stop = self._flow_end(text, start + depth + m.end())
                if stop is None or not re.match(r"[ \t]*(?:[ \t]#[^\n]*)?\r?(?:\n|$)", text[stop : (text.find("\n", stop) + 1) or len(text)]):
                    name = None
                else:
                    pos = (text.find("\n", stop) + 1) or len(text) + 1
            else:
                name = next((n for n, p in _Y_LINES if p.match(s)), None)
            if depth > stack[-1]:
                stack.append(depth)
                out.append(c["indent"])
                at.append(start)
            while depth < stack[-1] and len(stack) > 1:
                stack.pop()
                out.append(c["dedent"])
                at.append(start)
            out.append(BAD if name is None or depth != stack[-1] else c[name])
            at.append(start)
        for _ in stack[1:]:
            out.append(c["dedent"])
            at.append(len(text))
        r = self.grammar.run(out)
        return None if r is None else ("truncated", len(text)) if r >= len(out) else ("invalid", at[r])

    @staticmethod
    def _block_end(text: str, pos: int, parent: int, by: str | None) -> int:
        """Where a block scalar below a node at column parent ends: at the first line that is less indented than its first one."""
        least = parent + int(by) if by else None
        while pos <= len(text):
            end = text.find("\n", pos)
            end = len(text) if end < 0 else end
            line = text[pos:end].rstrip("\r")
            depth = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                if least is None and depth > parent:
                    least = depth
                if least is None or depth < least:
                    return pos
            pos = end + 1
        return pos


# An exact parser that overflows on deep nesting has decided nothing: None.


def _exact_python(text: str) -> bool | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text.removeprefix("\ufeff"))
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            return None if isinstance(e, (RecursionError, MemoryError)) else False
        return True


def _exact_json(text: str) -> bool | None:
    def no(x: str):
        raise ValueError(x)

    try:
        json.loads(text, parse_constant=no)
    except RecursionError:
        return None
    except ValueError:
        return False
    return True


def _exact_toml(text: str) -> bool | None:
    try:
        tomllib.loads(text)
    except (ValueError, RecursionError) as e:
        return None if isinstance(e, RecursionError) else False
    return True


def _exact_yaml(text: str) -> bool | None:
    if yaml is None:
        return False
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    try:
        for _ in yaml.parse(io.StringIO(text), Loader=loader):
            pass
    except (yaml.YAMLError, RecursionError) as e:
        return None if isinstance(e, RecursionError) else False
    return True


MAKERS: dict[str, Callable] = {
    "ts": lambda: _script(True, False), "tsx": lambda: _script(True, True), "js": lambda: _script(False, False),
    "go": _go, "rs": _rust, "rb": _ruby, "scss": _scss, "py": _python, "json": _json, "toml": _toml, "yaml": Yaml,
}
EXACT = {"py": _exact_python, "json": _exact_json, "toml": _exact_toml, "yaml": _exact_yaml}
EXTENSIONS = {e: e for e in MAKERS} | {"yml": "yaml"}
NAMES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "go": "go", "rs": "rust", "rb": "ruby", "scss": "scss", "py": "python", "json": "json", "toml": "toml", "yaml": "yaml"}


@functools.lru_cache(maxsize=None)
def language(name: str) -> Language | Yaml:
    """The worker's parser of a language; its memo lasts from file to file."""
    return MAKERS[name]()


def extension(path: str | None) -> str | None:
    """The language of a path by its extension, None if it is not one of EXTENSIONS."""
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path else None


def check(path: str | None, text: str | None) -> tuple[str, int] | None:
    """('invalid' or 'truncated', offset of the failing token) of a text that is not valid for its path.

    None for valid texts, other extensions, null paths, and null or empty texts. Where the exact parser overflows on
    deep nesting, the grammar's verdict stands; the grammar itself takes any depth.
    """
    name = extension(path)
    if name is None or not text:
        return None
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(limit + 50 * len(text))  # derivatives go as deep as the text nests, in frames of Python alone
    try:
        wrong = language(name).error(text.removeprefix("\ufeff"))
    finally:
        sys.setrecursionlimit(limit)
    if wrong is not None and name in EXACT and EXACT[name](text):
        return None
    return wrong


def unparsable(docs: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """(key, language, reason, at) of files whose text is not valid syntax for their extension; see check.

    One pass, no shuffle, whole texts. Repeated rows repeat. Other columns are not read.
    """
    r = docs.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(text).alias("t"))
    wanted = F.lower(F.regexp_extract("p", r"\.([A-Za-z]+)$", 1)).isin(list(EXTENSIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, names, why, at = [], [], [], []
            for i, (p, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if (w := check(p, t)) is not None:
                    rows.append(i), names.append(NAMES[extension(p)]), why.append(w[0]), at.append(w[1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(names, pa.string()), pa.array(why, pa.string()), pa.array(at, pa.int32())], names=["k", "language", "reason", "at"])

    out = spread(r.filter(wanted & F.col("t").isNotNull())).mapInArrow(run, f"k {r.schema['k'].dataType.simpleString()}, language string, reason string, at int")
    return out.withColumnRenamed("k", key)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that do not parse."""
    return unparsable(table(spark, sf_dir, "documents").select("doc_id", "path", "text")).select("doc_id").distinct()


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, invalid and truncated files of each source and language by extension."""
    docs = table(spark, sf_dir, "documents")
    bad = unparsable(docs.select("doc_id", "path", "text")).select("doc_id", "reason").dropDuplicates(["doc_id"])
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    names = F.create_map(*[F.lit(x) for e, n in EXTENSIONS.items() for x in (e, NAMES[n])])
    files = docs.filter(ext.isin(list(EXTENSIONS)) & (F.length("text") > 0)).select("doc_id", "source", names[ext].alias("language"))
    j = files.join(bad, "doc_id", "left").groupBy("source", "language")
    out = j.agg(F.count(F.lit(1)).alias("files"), F.count("reason").alias("invalid"), F.count(F.when(F.col("reason") == "truncated", 1)).alias("truncated"))
    return out.withColumn("rate", F.col("invalid") / F.col("files"))


QUERIES = {"p7_found": p7_found, "p7_rates": p7_rates}
SQL: dict[str, str] = {}
