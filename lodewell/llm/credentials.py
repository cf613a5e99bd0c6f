"""Credentials in source code: finding and blanking them.

A value is put forward by its context (the name it is assigned to, a header, a URL, a provider's prefix, a key block) and
decided upon by how unnatural it is: random strings need a subword for every one or two characters under a public vocabulary,
made-up passwords one for every two or three, words far fewer. Rules only exclude: placeholders, references, hashes, ids and
expressions are set aside however unnatural they are. Redaction writes as many mask characters as the value had, so every
offset and the code around it stay as they were.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm.bpe import Encoder, encoder, vocabulary_path
from lodewell.session import spread
from lodewell.sources.tables import table

#: Characters per subword at or below which a value is unnatural: drawn at random, or made up as a password. A value of a
#: name that is no password also needs RANDOM_LEAST characters in parts that are unnatural by themselves.
RANDOM_CHARS, PASSWORD_CHARS, RANDOM_LEAST = 2.4, 3.4, 10

_NAME = r"(?:pass(?:w(?:or)?d|phrase)?|pwd|secret|token|jwt|bearer|credentials?|(?:api|access|secret|sign(?:ing)?|encrypt(?:ion)?|cipher|master|payment|stripe|private|account|auth|hmac|service|session|client|license|shared|deploy|webhook)[_-]?keys?)"
#: Where a line is worth a look.
TRIGGER = re.compile(
    r"(?i:pass|pwd|secret|token|jwt|bearer|basic |credential|[a-z][_-]?key)|://[^\s/@\"'<>]*:[^\s/@\"'<>]+@"
    r"|gh[pousr]_|github_pat_|glpat-|npm_|xox[abeoprs]-|A[KS]IA[A-Z0-9]|[sr]k_live_|sk-[a-z]|AIza|eyJ[A-Za-z0-9]|SG\.|BEGIN [A-Z ]*PRIVATE"
)
#: Shapes that providers publish for their keys.
PROVIDER = re.compile(
    r"(?<![A-Za-z0-9_])(gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{30,}|glpat-[\w-]{18,}|npm_[A-Za-z0-9]{30,}|xox[abeoprs]-[A-Za-z0-9-]{15,}"
    r"|(?:AKIA|ASIA)[A-Z0-9]{16}|[sr]k_live_[A-Za-z0-9]{16,}|sk-(?:proj-|ant-|svcacct-)?[A-Za-z0-9_-]{18,}|AIza[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}"
    r"|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})(?![A-Za-z0-9_])"
)
URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.-]*://([^\s:/@\"'`<>]*):([^\s/@\"'`<>]+)@[^\s\"'`]")
HEADER = re.compile(r"(?i)\b(?:authorization|proxy-authorization|x-[a-z-]*(?:token|key))[\"']?\s*[:=,]\s*[\"']?(?:(basic|bearer|token|digest)\s+)?([^\s\"'`,;]{6,})")
#: name, then = : => , or a bracket, optionally a type between, then a quoted or bare value.
ASSIGNED = re.compile(
    rf"(?i)(?<![\w.$-])([\w.$-]*{_NAME}[\w-]*)[\"'`]?\s*\]?\s*(?::\s*&?(?:'?\w+\s+)?[\w<>\[\]|.]+\s*)?(\|\|=|\?=|:=|=>|=(?!=)|:(?!:)|,)\s*\(?\s*(?:[bfr]|String\.from\()?(\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`|[^\s\"'`,;(){{}}\[\]<>]+)"
)
#: A name and a value in running text.
SPOKEN = re.compile(rf"(?i)(?<![\w-])([\w-]*{_NAME}[\w-]*)\s+(?:is\s+|was\s+|of\s+)?[\"'`]?([A-Za-z0-9+/_~.!#$%^&*=-]{{8,}})")
#: Words in a name that make it something else than the credential itself.
OTHER_NAME = re.compile(
    r"(?i)(public|ref$|refs$|_?var$|env$|_?id$|ids$|url$|uri$|file$|path$|name$|count$|counts$|size$|len(gth)?$|limit$|index$|hash$|digest|checksum|pattern$|regex$|prefix$|type$|kind$|header$|hint$|label$|field$|column$|policy$|expir\w*$|ttl$|age$|budget$|tokens$|tokeni[sz]er|issuer$|endpoint$)"
)
PASSWORD_NAME = re.compile(r"(?i)pass(w(or)?d|phrase)?|pwd")
PLACEHOLDER = re.compile(
    r"(?i)^(<.*>?|\$\{?\w.*|\{\{?.*|%[({]?\w+[)}]?s?%?|@\w+@|\[.*|x{4,}|\*+|\.{2,}|-+|_+|0+|1234\w*|(your|my|some|the|an?)[-_ ].*|change[-_]?(me|it|this)?.*|replace[-_]?(me|this)?.*|insert[-_].*|to-?do.*|fix-?me.*|tbd|n/?a|null|none|nil|undefined|true|false|empty|example.*|sample.*|dummy.*|fake.*|placeholder.*|secret|password|passwd|pass|token|redacted|hunter2|string|str|test|user|root|admin)$"
)
MASKED = re.compile(r"(?i)redacted|x{6,}|\*{3,}|\.\.\.|<[^>]*>|\$\{|\{\{|your[-_]|placeholder|example(?![a-z0-9.-]*/)|changeme|0{8,}|12345678|abcdefgh")
REFERENCE = re.compile(
    r"(?i)^(enc:|vault:|vault\(|env:|env\.|secret:|secrets?[./]|ssm:|arn:|kms:|sm://|gcp:|op://|doppler:|keyring:|file:|process\.env|os\.|ENV[\[.]|getenv|import\.meta|config\.|settings\.|self\.|this\.|https?://|/|\./|\.\./|~/|sha(1|256|384|512)[:-]|md5:)"
)
UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: The body of a key block, and what of it is there if its end is missing.
ENCODED = re.compile(r"(?:[A-Za-z][\w-]*: [^\n]*\n|\\[nrt]|[A-Za-z0-9+/=_\s\"'`+,.#*<>|&\\()-])*")
CUT_OFF = re.compile(r"(?:\\[nr]|[\s\"'`+,\\]|[A-Za-z0-9+/=_-]{20,}|[A-Za-z][\w-]*: [^\n]*\n)*")
JOINED = re.compile(r"([\"'`])\s*(?:\+|\.\.?|<<|\\|&)?\s*\1")


def chars_per_token(value: str, enc: Encoder) -> float:
    """Characters per subword; 0 for an empty value."""
    return len(value) / max(1, len(enc.encode(value))) if value else 0.0


def placeholder(value: str) -> bool:
    """Whether a value stands for a credential instead of being one."""
    v = value.strip()
    return not v or bool(PLACEHOLDER.match(v) or REFERENCE.match(v) or MASKED.search(v)) or len(set(v)) <= 3


def unnatural(value: str, enc: Encoder) -> bool:
    """Whether a string looks drawn at random: letters and digits mixed, and short subwords in RANDOM_LEAST characters or more."""
    if chars_per_token(value, enc) > RANDOM_CHARS or len(value) < 12 or not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return False
    parts = re.split(r"[^A-Za-z0-9+/=]+", value)
    return sum(len(p) for p in parts if chars_per_token(p, enc) <= RANDOM_CHARS) >= RANDOM_LEAST


def made_up(value: str, enc: Encoder) -> bool:
    """Whether a string looks made up as a password: shorter subwords than words have, letters with digits or marks."""
    if chars_per_token(value, enc) > PASSWORD_CHARS or len(value) < 6:
        return False
    digit, letter, mark = re.search(r"\d", value), re.search(r"[^\W\d_]", value), re.search(r"[^\w]", value)
    return bool(letter and (digit or mark and len(value) >= 10 and not re.fullmatch(r"[A-Za-z]+([_.\-/][A-Za-z]+)*", value)))


def _credential(name: str, value: str, quoted: bool, enc: Encoder) -> bool:
    """Whether value, given to name, is a usable credential."""
    if OTHER_NAME.search(name) and not re.search(r"(?i)(secret|master|private|access)[_-]?key[_-]?(base|value|default)?$", name):
        return False
    if placeholder(value) or UUID.match(value) or " " in value or unnatural(name, enc):
        return False
    if PASSWORD_NAME.search(name):
        return made_up(value, enc) and (quoted or not re.search(r"[()\[\]{}]|\w\.\w|::|->", value))
    return unnatural(value, enc)


def find_in_line(line: str, enc: Encoder) -> list[tuple[int, int]]:
    """(start, end) of credential values in one line; key blocks are left to find_credentials."""
    found = []
    for m in PROVIDER.finditer(line):
        if chars_per_token(m[1], enc) <= RANDOM_CHARS and not placeholder(m[1]):
            found.append(m.span(1))
    for m in URL.finditer(line):
        if made_up(m[2], enc) and not placeholder(m[2]) and m[2].lower() != m[1].lower():
            found.append(m.span(2))
    for m in HEADER.finditer(line):
        kind, value = (m[1] or "").lower(), m[2]
        if placeholder(value) or "PUBLIC KEY" in line:
            continue
        if kind == "basic":
            good = chars_per_token(value, enc) <= RANDOM_CHARS and _names_a_user(value)
        elif kind:
            good = made_up(value, enc) and bool(re.search(r"\d", value)) and not re.search(r"[(){}]|\w\.\w+\(|^\w+(\.[a-z]\w*)+$", value)
        else:
            good = unnatural(value, enc)
        if good:
            found.append(m.span(2))
    for m in ASSIGNED.finditer(line):
        raw = m[3]
        quoted = raw[0] in "\"'`"
        a, b = m.span(3)
        if quoted:
            a, b = a + 1, b - 1
        if m[2] == "," and not quoted:
            continue
        if _credential(m[1], line[a:b], quoted, enc):
            found.append((a, b))
    for m in SPOKEN.finditer(line):
        value = m[2].rstrip(".")
        if not _credential(m[1], value, False, enc):
            continue
        if unnatural(value, enc) or re.search(r"\d", value) and (len(m[1]) > 4 and PASSWORD_NAME.search(m[1]) or len(value) >= 12 and re.search(r"[^\w.-]", value)):
            found.append((m.start(2), m.start(2) + len(value)))
    return found


def _names_a_user(value: str) -> bool:
    try:
        return b":" in base64.b64decode(value, validate=True)
    except (binascii.Error, ValueError):
        return False


def _spans_of(line: str, enc: Encoder) -> list[tuple[int, int]]:
    spans = find_in_line(line, enc)
    if spans or not JOINED.search(line):
        return spans
    # literals that are put together on the line: judged as one, blanked each
    whole, gaps, last = [], [], 0
    for m in JOINED.finditer(line):
        whole.append(line[last : m.start()])
        last = m.end()
        gaps.append((sum(map(len, whole)), m.end() - m.start()))
    whole.append(line[last:])
    if len(gaps) == 1 and not line[gaps[0][0] : gaps[0][0] + gaps[0][1]].strip("\"'`"):
        return spans  # an empty string, nothing is joined
    out = []
    for a, b in find_in_line("".join(whole), enc):
        shift = 0
        for at, size in gaps:
            if at <= a:
                shift += size
            elif at < b:
                out.append((a + shift, at + shift))
                a, shift = at, shift + size
        out.append((a + shift, b + shift))
    return out


def find_credentials(text: str | None, enc: Encoder) -> list[tuple[int, int, int]]:
    """(line, start, end) of each credential value: line from 1, offsets in the text.

    A private key block counts once, at its BEGIN line, with the span of its body; nothing else is sought in
    it. Null and empty text give nothing. Lines are split at "\\n".
    """
    if not text:
        return []
    out, done = [], -1
    line_no, counted = 1, 0
    for t in TRIGGER.finditer(text):
        if t.start() < done:
            continue
        a = text.rfind("\n", 0, t.start()) + 1
        b = text.find("\n", t.start())
        b = len(text) if b < 0 else b
        line_no += text.count("\n", counted, a)
        counted = a
        if (m := BEGIN.search(text, a, b)) is not None:
            e = END.search(text, m.end())
            body = text[m.end() : e.start()] if e else None
            if body is None or not ENCODED.fullmatch(body):  # cut off: as far as lines look encoded
                body = CUT_OFF.match(text, m.end())[0]
            dense = re.sub(r"\\n|[^A-Za-z0-9+/=]", "", body)
            if len(dense) >= 24 and len(set(dense)) > 8 and chars_per_token(dense, enc) <= RANDOM_CHARS and not MASKED.search(body):
                out.append((line_no, m.end(), m.end() + len(body)))
                done = max(b, m.end() + len(body))
                continue
        spans = {(a + i, a + j) for i, j in _spans_of(text[a:b], enc)}
        out += [(line_no, i, j) for i, j in sorted(spans)]
        done = b
    return out


def redact(text: str | None, enc: Encoder, mask: str = "*") -> str | None:
    """text with every credential value masked, character for character; line ends and quotes stay."""
    spans = find_credentials(text, enc)
    if not spans:
        return text
    out, last = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if b <= last:
            continue
        a = max(a, last)
        out += [text[last:a], re.sub(r"[^\s\"'`,+\\]", mask, text[a:b])]
        last = b
    return "".join([*out, text[last:]])


def _per_text(rows: DataFrame, key: str, text: str, schema: str, make, path: str | None) -> DataFrame:
    path = path or vocabulary_path()
    r = rows.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield make(b, enc)

    return spread(r).mapInArrow(run, f"k {r.schema['k'].dataType.simpleString()}, {schema}").withColumnRenamed("k", key)


def credentials(rows: DataFrame, key: str = "chunk_id", text: str = "content", path: str | None = None) -> DataFrame:
    """(key, line_no, start, length): credential values in each text; see find_credentials.

    One pass, no shuffle. Repeated rows repeat. Values themselves are never output.
    """

    def make(b: pa.RecordBatch, enc: Encoder) -> pa.RecordBatch:
        ks, ns, ss, ls = [], [], [], []
        for i, t in enumerate(b.column(1).to_pylist()):
            for n, a, e in find_credentials(t, enc):
                ks.append(i), ns.append(n), ss.append(a), ls.append(e - a)
        keys = b.column(0).take(pa.array(ks, pa.int32()))
        return pa.RecordBatch.from_arrays([keys, pa.array(ns, pa.int32()), pa.array(ss, pa.int32()), pa.array(ls, pa.int32())], names=["k", "line_no", "start", "length"])

    return _per_text(rows, key, text, "line_no int, start int, length int", make, path)


def redacted(rows: DataFrame, key: str = "chunk_id", text: str = "content", path: str | None = None) -> DataFrame:
    """(key, text) with credential values masked; null text stays null. Rows without any are passed through."""

    def make(b: pa.RecordBatch, enc: Encoder) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([redact(t, enc) for t in b.column(1).to_pylist()], pa.string())], names=["k", "x"])

    return _per_text(rows, key, text, "x string", make, path).withColumnRenamed("x", text)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of chunks on which a credential stands."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "content")
    return credentials(chunks).select("chunk_id", "line_no").distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunk contents with credentials masked."""
    return redacted(table(spark, sf_dir, "chunks").select("chunk_id", "content"))


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credential lines by document path: only chunks that have any are joined."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "document_id", "content")
    found = credentials(chunks.select("chunk_id", "content")).select("chunk_id", "line_no").distinct()
    where = chunks.select("chunk_id", "document_id").distinct().join(found, "chunk_id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "path")
    return where.join(docs, "document_id").groupBy("document_id", "path").agg(F.count(F.lit(1)).alias("lines"))


QUERIES = {"p6_found": p6_found, "p6_redacted": p6_redacted, "p6_paths": p6_paths}
SQL: dict[str, str] = {}
