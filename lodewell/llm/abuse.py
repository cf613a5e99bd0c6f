"""Abusive, hateful or sexual content: gradient-boosted trees over dense features, calibrated by isotonic regression.

Two lexicons are sought: a general one of words and set phrases (abuse_words), and one learned from the labelled documents, whose
words and word pairs are weighted by how much more often abusive documents hold them. A text is searched once for both, plainly and
through common disguises (look-alike letters, digits for letters, stars, letters set apart, drawn-out letters). The features are
densities of the whole text and, of its densest passage, lexicon counts, the distance to a second person, capitals, punctuation,
disguise and harmless context. Human labels of a bounded sample train the trees, which alone decide; the calibrated score is a
probability. Learned weights that the trees see in training come from the other folds of the labels.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewell.llm import abuse_words as L
from lodewell.session import cut_lineage, spread
from lodewell.sources.tables import table

#: Labelled documents that the trees are trained on, at most; fewer than LEAST of either class: a fixed curve over the lexicon counts.
LABELLED, LEAST = 20_000, 8
THRESHOLD = 0.5
TREES, DEPTH, RATE, LEAF = 80, 3, 0.15, 3
#: Folds of the labels; words and pairs of the learned lexicon at most, documents that hold one at least, standard errors that a
#: weight is drawn to 0, and the least weight that counts.
FOLDS, LEARNED, HELD, DRAWN, COUNTED = 5, 40_000, 3, 1.5, 0.7

KINDS = ["insult", "hate", "threat", "sexual"]
_LOOKALIKE = str.maketrans("абвгеёзикмнорстухіјѕԁһӏԝɡαβεικνορτυχγÀ", "abbreezukmhopctyxijsdhlwgabeiknoptuxya")
_LOOKALIKE.update(str.maketrans({"ё": "e", "г": "r", "б": "b", "и": "u", "з": "3", "ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ı": "i"}))
_LOOKALIKE = {k: v if isinstance(v, str) else chr(v) for k, v in _LOOKALIKE.items()}
_FOLDED = re.compile("[" + "".join(map(chr, _LOOKALIKE)) + "]")
_ACCENTS = re.compile("[\u0300-\u036f]+")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿︀-️]")
_LEET = str.maketrans("013457@$!|€+", "oieastasiiet")
_LEET_L = str.maketrans("013457@$!|€+", "oleastasllet")
_DISGUISED = re.compile(
    r"(?<![\w*])(?=[\w@$!|€+*]*[0-9@$*€])(?=[\w@$!|€+*]*[^\W\d_])[\w@$!|€+*]{3,24}"  # digits, signs or stars among letters
    r"|(?<!\w)[^\W\d_](?P<s>[.\-_*~· ])(?:[^\W\d_](?P=s)){2,20}[^\W\d_](?!\w)"  # letters set apart
)
_DRAWN_OUT = re.compile(r"([^\W\d_])\1\1")
_WORD_END = re.compile(r"\w*")
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_CJK = re.compile("[぀-ヿ㐀-鿿]")


def plain(text: str) -> str:
    """Lower case, compatibility forms and look-alikes folded, accents and invisible characters dropped."""
    if text.isascii():
        return text.lower()
    t = _ACCENTS.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
    t = t.lower()
    return _FOLDED.sub(lambda m: _LOOKALIKE[ord(m[0])], t) if _FOLDED.search(t) else t


def _squeeze(w: str) -> str:
    return re.sub(r"(.)\1+", r"\1", w)


class Lexicon:
    """Entries by spelling, with kind and weight: 2 for words, 3 for phrases, 1 for weak words; and learned weights.

    learned maps words and pairs of words to FOLDS + 1 weights, without each fold of the labels and with all of them, and a kind.
    """

    def __init__(self, learned: dict[str, tuple[tuple[float, ...], int]] | None = None):
        self.learned = learned or {}
        self.entries: dict[str, set[tuple[int, int]]] = defaultdict(set)
        for k, kind in enumerate(KINDS):
            up = kind.upper()
            for name, weight in ((up, 2), (f"{up}_WEAK", 1)):
                for w in getattr(L, name, "").split():
                    self.entries[plain(w)].add((k, weight))
            for w in re.split(r"[|\n]", getattr(L, f"{up}_PHRASES")):
                if w.strip():
                    self.entries[plain(w.strip())].add((k, 3))
        self.you = set(map(plain, L.YOU.split()))
        self.neutral = set(map(plain, L.NEUTRAL.split()))
        self.sought = set(self.entries) | {w for w, (ws, _) in self.learned.items() if max(ws) >= COUNTED}
        single = [w for w in self.sought if " " not in w]
        self.squeezed: dict[str, str] = {_squeeze(w): w for w in sorted(single) if len(w) > 3}
        self.masked: dict[tuple[str, int], list[str]] = defaultdict(list)
        for w in sorted(self.entries):
            self.masked[w[0], len(w)].append(w)
        self.find = ahocorasick.Automaton()
        for w in self.sought:
            self.find.add_word(w, w)
        self.find.make_automaton()

    def disguised(self, token: str) -> str | None:
        """The entry that a token hides, if any."""
        if "*" in token.strip("*"):
            t = token.strip("_")
            bare = t.rstrip("*") if t.count("*") == len(t) - len(t.rstrip("*")) else t
            if "*" in bare and bare[0] != "*":
                pattern = re.compile("".join("." if c == "*" else re.escape(c) for c in bare))
                for w in self.masked.get((bare[0], len(bare)), ()):
                    if pattern.fullmatch(w):
                        return w
            bare = t.replace("*", "")
            return bare if bare in self.entries and len(bare) > 3 else None
        if len(token) > 3 and not token[1].isalnum() and token[1] == token[3]:
            bare = token[::2]
            return bare if bare in self.sought else None
        for way in (_LEET, _LEET_L):
            w = token.rstrip("!|").translate(way)
            if w in self.sought and w != token:
                return w
            if _DRAWN_OUT.search(w) and (s := _squeeze(w)) in self.squeezed:
                return self.squeezed[s]
        return None

    def evidence(self, words: list[str], fold: int) -> tuple[float, float, float, int]:
        """(sum of learned weights, greatest, sum of the harmless, likeliest kind) of the distinct words and pairs of a passage."""
        total = most = harmless = 0.0
        kinds = [0.0] * len(KINDS)
        for w in set(grams(words)):
            if (v := self.learned.get(w)) is not None:
                x = v[0][fold]
                if x >= COUNTED:
                    total, most = total + x, max(most, x)
                    kinds[v[1]] += x
                elif x < 0:
                    harmless -= x
        return total, most, harmless, kinds.index(max(kinds)) if total > 0 else -1


def grams(words: list[str]) -> list[str]:
    """Words of two letters and more, and pairs of neighbours; of scripts without spaces, pairs of signs."""
    out = [w for w in words if len(w) > 1 and not w.isdigit()]
    out += [f"{a} {b}" for a, b in zip(words, words[1:])]
    for w in words:
        if w[0] >= "぀":
            out += [w[i : i + 2] for i in range(len(w) - 1)]
    return out


@functools.lru_cache(maxsize=1)
def lexicon() -> Lexicon:
    return Lexicon()


#: First the whole text, then its densest passage.
NAMES = (
    ["text_hits", "text_passages", "text_capitals", "text_marks", "text_disguised", "text_learned", "second_learned", "second_hits"]
    + [f"{k}_{s}" for k in KINDS for s in ("strong", "weak")]
    + ["strong", "weak", "learned", "learned_most", "learned_harmless", "near_you", "capitals", "marks", "disguised", "neutral", "quoted", "kinds", "words"]
)
_AT = {n: i for i, n in enumerate(NAMES)}
_LOUD = re.compile(r"\b[^\W\d_a-z]{4,}\b")


def features(text: str | None, lex: Lexicon | None = None, fold: int = FOLDS) -> np.ndarray:
    """The features of NAMES; all 0 for null or empty text. fold is that of a labelled text, FOLDS for any other."""
    return described(text, lex or lexicon(), fold)[0]


def described(text: str | None, lex: Lexicon, fold: int = FOLDS) -> tuple[np.ndarray, int]:
    """(features, likeliest kind or -1) of a text."""
    x = np.zeros(len(NAMES))
    if not text:
        return x, -1
    t = plain(text)
    hits: list[tuple[int, int, str, bool]] = []
    for end, w in lex.find.iter(t):
        a = end - len(w) + 1
        cjk = w[0] >= "぀"
        if cjk or ((a == 0 or not t[a - 1].isalnum()) and (end + 1 == len(t) or not t[end + 1].isalnum())):
            hits.append((a, end + 1, w, False))
    for m in _DISGUISED.finditer(t):
        if (w := lex.disguised(m[0])) is not None:
            hits.append((*m.span(), w, True))
    done = 0
    for m in _DRAWN_OUT.finditer(t):
        if m.start() >= done:
            a, done = m.start(), _WORD_END.match(t, m.end()).end()
            while a > 0 and (t[a - 1].isalnum() or t[a - 1] == "_"):
                a -= 1
            if (w := lex.disguised(t[a:done])) is not None:
                hits.append((a, done, w, True))
    per = 1000 / len(t)
    x[_AT["text_capitals"]], x[_AT["text_marks"]] = sum(map(len, _LOUD.findall(text))) * per, t.count("!") * per
    if not hits:
        return x, -1
    hits.sort()
    x[_AT["text_hits"]], x[_AT["text_disguised"]] = len(hits) * per, sum(d for *_, d in hits)
    same = len(t) == len(text)
    groups: list[list[tuple[int, int, str, bool]]] = []
    for h in hits:
        if groups and h[0] - groups[-1][-1][1] < 60 and "\n" not in t[groups[-1][-1][1] : h[0]]:
            groups[-1].append(h)
        else:
            groups.append([h])
    x[_AT["text_passages"]] = len(groups)
    found = []
    for g in groups:
        a, b = max(0, g[0][0] - 60), min(len(t), g[-1][1] + 60)
        lo = max(t.rfind("\n", 0, g[0][0]), t.rfind(". ", 0, g[0][0]), t.rfind("; ", 0, g[0][0])) + 1
        hi = min([p for p in (t.find("\n", g[-1][1]), t.find(". ", g[-1][1])) if p >= 0] or [len(t)])
        a, b = max(a, lo), min(b, hi)
        y = np.zeros(len(NAMES))
        places = list(_WORD.finditer(t, a, b))
        ws = [m[0] for m in places]
        bare = {w for *_, w, d in g if d}
        at = g[0][0], g[-1][1]
        far = min((max(at[0] - m.end(), m.start() - at[1], 0) for m in places if m[0] in lex.you), default=None)
        if far is None and any(c in t[a:b] for c in ("你", "お前")):
            far = 0
        seen = {w for *_, w, _ in g}
        kinds = np.zeros(len(KINDS))
        for w in seen & lex.entries.keys():
            for k, n in lex.entries[w]:
                y[_AT[f"{KINDS[k]}_strong"] if n > 1 else _AT[f"{KINDS[k]}_weak"]] += n / 2 if n > 1 else 1
                kinds[k] += n / 2
        total, most, harmless, kind = lex.evidence([*ws, *bare], fold)
        if kind >= 0:
            kinds[kind] += total / 2
        raw = text[at[0] : at[1]] if same else ""
        y[_AT["learned"]], y[_AT["learned_most"]], y[_AT["learned_harmless"]] = total, most, harmless
        y[_AT["near_you"]] = 0 if far is None else 1 / (1 + far / 10)
        y[_AT["capitals"]] = sum(c.isupper() for c in raw) / max(1, sum(c.isalpha() for c in raw))
        y[_AT["marks"]] = t[a : min(len(t), b + 4)].count("!")
        y[_AT["disguised"]] = sum(d for *_, d in g)
        y[_AT["neutral"]] = sum(p in lex.neutral for w in ws for p in w.split("-"))
        y[_AT["quoted"]] = bool(re.search(r"\w-(proof|free|safe)\b|[\"'`](?:" + "|".join(map(re.escape, sorted(seen))) + r")[\"'`]", t[a:b]))
        y[_AT["kinds"]], y[_AT["words"]] = (kinds > 0).sum(), len(ws)
        y[_AT["strong"]], y[_AT["weak"]] = y[_AT["insult_strong"] : _AT["strong"] : 2].sum(), y[_AT["insult_weak"] : _AT["strong"] : 2].sum()
        strong = y[_AT["strong"]] + y[_AT["weak"]] / 2
        found.append((strong + total / 2 - harmless / 2, strong, total, y, int(kinds.argmax()) if kinds.max() > 0 else -1))
    order = sorted(range(len(found)), key=lambda i: (-found[i][0], i))
    first = found[order[0]]
    whole = [_AT[n] for n in ("text_hits", "text_passages", "text_capitals", "text_marks", "text_disguised")]
    first[3][whole] = x[whole]
    x = first[3]
    x[_AT["text_learned"]] = sum(f[2] for f in found) * per
    if len(order) > 1:
        x[_AT["second_hits"]], x[_AT["second_learned"]] = found[order[1]][1], found[order[1]][2]
    return x, first[4]


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, on binned dense features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, leaf: int = LEAF):
        self.trees, self.depth, self.rate, self.leaf = trees, depth, rate, leaf
        self.base, self.made = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        p = np.clip(np.average(y, weights=weight), 0.01, 0.99)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            g, h = weight * (y - q), weight * q * (1 - q)
            tree = self._grow(bins, g, h, np.arange(len(y)), self.depth)
            self.made.append(tree)
            f += self._leafs(tree, bins)
        return self

    def _grow(self, bins, g, h, rows, depth):
        value = self.rate * g[rows].sum() / (h[rows].sum() + 1.0)
        if depth == 0 or len(rows) < 2 * self.leaf:
            return value
        best, at = 1e-3, None
        gs, hs = g[rows].sum(), h[rows].sum()
        for j in range(bins.shape[1]):
            n = len(self.cuts[j]) + 1
            if n < 2:
                continue
            b = bins[rows, j]
            cg, ch, cn = (np.cumsum(np.bincount(b, v, n))[:-1] for v in (g[rows], h[rows], None))
            gain = cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1)
            gain[(cn < self.leaf) | (len(rows) - cn < self.leaf)] = -1
            k = int(gain.argmax())
            if gain[k] > best:
                best, at = gain[k], (j, k)
        if at is None:
            return value
        left = bins[rows, at[0]] <= at[1]
        return (*at, self._grow(bins, g, h, rows[left], depth - 1), self._grow(bins, g, h, rows[~left], depth - 1))

    def _leafs(self, tree, bins) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(bins), tree)
        j, k, a, b = tree
        out = np.empty(len(bins))
        left = bins[:, j] <= k
        out[left], out[~left] = self._leafs(a, bins[left]), self._leafs(b, bins[~left])
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        return self.base + sum(self._leafs(t, bins) for t in self.made) if len(x) else np.empty(0)


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities) of the weighted least-squares non-decreasing fit, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v, w in zip(score[order], y[order], weight[order], strict=True):
        blocks.append([s, s, v * w, w])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    xs = [v for b in blocks for v in (b[0], b[1])]
    ys = [b[2] / b[3] for b in blocks for _ in range(2)]
    return np.array(xs), np.array(ys)


class Model:
    """A learned lexicon, trees and calibration; without enough labels, a fixed curve over the lexicon counts of the densest passage."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray | None = None, learned: dict | None = None):
        self.learned = learned or {}
        self.trees = None
        if min((y > 0.5).sum(), (y <= 0.5).sum()) < LEAST:
            return
        fold = np.arange(len(y)) % FOLDS if fold is None else fold
        held = np.zeros(len(y))
        for k in np.unique(fold):
            mine = fold == k
            held[mine] = Boosted().fit(x[~mine], y[~mine], weight[~mine]).raw(x[mine]) if (~mine).any() else 0.0
        self.trees, self.prior = Boosted().fit(x, y, weight), float(np.average(y, weights=weight))
        # two soft points keep few labels from giving certainty
        self.at, self.p = isotonic(np.concatenate([held, [held.min(), held.max()]]), np.concatenate([y, [0, 1]]), np.concatenate([weight, [1, 1]]))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is not None:
            return np.interp(self.trees.raw(x), self.at, self.p)
        strong, weak = x[:, _AT["strong"]], x[:, _AT["weak"]]
        near = x[:, _AT["near_you"]] > 0
        sure = 1.2 * strong + 0.6 * weak + 0.8 * near * (strong + weak > 0) + 0.8 * x[:, _AT["disguised"]] - 0.9 * x[:, _AT["neutral"]] - 1.5 * x[:, _AT["quoted"]]
        return 1 / (1 + np.exp(-3 * (sure - 1.7)))


def _votes(labels: DataFrame, key: str) -> DataFrame:
    """(key, share, n, kind): of at most LABELLED documents the share of raters who call them abusive, how many said so or clean, and the commonest kind."""
    kinds = F.array(*map(F.lit, KINDS))
    says = F.coalesce(F.array_contains(kinds, F.col("label")), F.lit(False))
    each = labels.filter(says | (F.col("label") == "clean")).groupBy(key)
    counts = [F.sum((F.col("label") == k).cast("int")).alias(k) for k in KINDS]
    votes = each.agg(F.avg(says.cast("int")).alias("share"), F.count(F.lit(1)).alias("n"), *counts)
    kind = F.array_position(F.array(*KINDS), F.array_max(F.array(*KINDS))).cast("int") - 1
    return votes.select(key, "share", "n", kind.alias("kind")).orderBy(F.xxhash64(key), key).limit(LABELLED)


def learn(labelled: DataFrame, docs: DataFrame) -> dict[str, tuple[tuple[float, ...], int]]:
    """The learned lexicon of labelled (t, fold, share, kind): at most LEARNED words and pairs with their weights.

    A weight is the logarithm of how much more often abusive documents hold the word than the other labelled ones do, drawn to 0
    by its standard error; one that speaks for abuse is at most that against all of docs (text), so that words are not taken for
    abuse because few documents of their sort are labelled. Words are counted in the cluster; what comes to the driver is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws, at = [], []
            for i, t in enumerate(b.column(0).to_pylist()):
                mine = set()
                for line in re.split(r"\n|[.!?;] ", plain(t)):
                    mine.update(grams(_WORD.findall(line)))
                ws += mine
                at += [i] * len(mine)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), *(b.column(c).take(take) for c in (1, 2, 3))], names=["w", "fold", "bad", "kind"])

    rows = labelled.select("t", "fold", (F.col("share") > 0.5).alias("bad"), "kind")
    totals = [{f: 0 for f in range(FOLDS)}, {f: 0 for f in range(FOLDS)}]
    for r in rows.groupBy("fold", "bad").count().collect():
        totals[int(r["bad"])][r["fold"]] += r["count"]
    every = [sum(t.values()) for t in totals]
    if min(every) < LEAST:
        return {}
    words = rows.mapInArrow(count, "w string, fold int, bad boolean, kind int").groupBy("w")
    of = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = words.agg(*[of(F.col("bad") & (F.col("fold") == f)).alias(f"b{f}") for f in range(FOLDS)], *[of(~F.col("bad") & (F.col("fold") == f)).alias(f"c{f}") for f in range(FOLDS)], *[of(F.col("bad") & (F.col("kind") == k)).alias(f"k{k}") for k in range(len(KINDS))])

    def weight(skip: int) -> Column:
        b, c = (sum((F.col(f"{s}{f}") for f in range(FOLDS) if f != skip), F.lit(0)) for s in "bc")
        nb, nc = (every[i] - totals[i].get(skip, 0) for i in (1, 0))
        odds = F.log((b + 0.5) / (nb + 1.0)) - F.log((c + 0.5) / (nc + 1.0))
        slack = F.sqrt(1 / (b + 0.5) + 1 / (c + 0.5))
        return F.signum(odds) * F.greatest(F.abs(odds) - DRAWN * slack, F.lit(0.0))

    held = sums.filter(sum(F.col(f"{s}{f}") for s in "bc" for f in range(FOLDS)) >= HELD)
    w = held.select("w", *[weight(f).alias(f"w{f}") for f in range(FOLDS + 1)], *[f"b{f}" for f in range(FOLDS)], (F.array_position(F.array(*[f"k{k}" for k in range(len(KINDS))]), F.greatest(*[f"k{k}" for k in range(len(KINDS))])).cast("int") - 1).alias("kind"))
    top = w.filter(F.abs(F.col(f"w{FOLDS}")) >= COUNTED).orderBy(F.desc(F.abs(F.col(f"w{FOLDS}"))), "w").limit(LEARNED).collect()
    rare = docs.sparkSession.sparkContext.broadcast(frozenset(r["w"] for r in top if r[f"w{FOLDS}"] > 0))

    def spread_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        n = 0
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(rare.value.intersection(grams(_WORD.findall(plain(t)))))
                n += 1
        seen[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    everywhere = {r["w"]: r["n"] for r in spread(docs).mapInArrow(spread_of, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()}  # LEARNED rows
    n = everywhere.get("", 0)
    out = {}
    for r in top:
        ws = [float(r[f"w{f}"]) for f in range(FOLDS + 1)]
        if ws[-1] > 0:
            bad = sum(r[f"b{f}"] for f in range(FOLDS))
            for f in range(FOLDS + 1):
                mine = bad - (r[f"b{f}"] if f < FOLDS else 0)
                ws[f] = min(ws[f], drawn(mine, every[1] - totals[1].get(f, 0), max(everywhere.get(r["w"], 0) - bad, 0), max(n - every[1], 1)))
        if max(ws) >= COUNTED or ws[-1] < 0:
            out[r["w"]] = (tuple(ws), max(r["kind"], 0))
    return out


def drawn(b: float, nb: float, c: float, nc: float) -> float:
    """Log odds of b in nb against c in nc, drawn to 0 by DRAWN standard errors."""
    odds = math.log((b + 0.5) / (nb + 1)) - math.log((c + 0.5) / (nc + 1))
    return math.copysign(max(abs(odds) - DRAWN * math.sqrt(1 / (b + 0.5) + 1 / (c + 0.5)), 0.0), odds)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """A model from human labels: the majority of a document's raters is its target.

    Null and unsure labels do not count. At most LABELLED documents, chosen by a hash of their key, are used; equal texts are in
    one fold.
    """
    votes = _votes(labels.select(F.col(key).alias("k"), "label"), "k")
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") > 0).join(F.broadcast(votes), "k")  # LABELLED rows of four numbers at most
    rows = cut_lineage(rows.dropDuplicates(["k"]).withColumn("fold", F.pmod(F.xxhash64("t"), F.lit(FOLDS)).cast("int")))
    learned = learn(rows, docs.select(F.col(text).alias("t")).filter(F.length("t") > 0))
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # LEARNED entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(shared.value)
        for b in batches:
            x = pa.array([features(t, lex, f).tolist() for t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], x], names=["fold", "share", "n", "x"])

    out = rows.orderBy("k").select("t", "fold", "share", "n").mapInArrow(run, "fold int, share double, n bigint, x array<double>").toPandas()
    if not len(out):
        return Model(np.empty((0, len(NAMES))), np.empty(0), np.empty(0))
    share, n = out["share"].to_numpy(float), out["n"].to_numpy(float)
    return Model(np.stack(out["x"].to_numpy()), (share > 0.5).astype(float), np.abs(share - 0.5) * 2 * np.sqrt(n) + 1e-3, out["fold"].to_numpy(), learned)


def save(model: Model, spark: SparkSession, path: str) -> None:
    """Writes a model as one row of a table at path; it is never overwritten."""
    spark.createDataFrame([(pickle.dumps(model),)], "model binary").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    return pickle.loads(spark.read.parquet(path).first()["model"])


def abuse_scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, kind): probability of abusive, hateful or sexual content of every row, and its likeliest kind.

    kind is null where nothing was found. Null and empty texts have the score of a text without any evidence. No shuffle; whole texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TREES small trees and LEARNED entries
    r = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lex = Lexicon(m.learned)
        for b in batches:
            each = [described(t, lex) for t in b.column(1).to_pylist()]
            s = m.score(np.stack([x for x, _ in each])) if each else np.empty(0)
            kind = [KINDS[k] if k >= 0 else None for _, k in each]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(kind, pa.string())], names=["k", "score", "kind"])

    return r.mapInArrow(run, f"k {r.schema['k'].dataType.simpleString()}, score double, kind string").withColumnRenamed("k", key)


_models: dict[tuple, Model] = {}


def _model(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a session's tables, trained once as long as their files stay as they are."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    stamps = []
    for name in sorted({*docs.inputFiles(), *labels.inputFiles()}):
        s = (p := path(name)).getFileSystem(conf).getFileStatus(p)
        stamps.append((name, s.getLen(), s.getModificationTime()))
    known = (spark.sparkContext.applicationId, tuple(stamps))
    if known not in _models:
        _models.clear()
        _models[known] = train(docs, labels)
    return _models[known]


def for_corpus(scored: DataFrame, prior: float, rounds: int = 200) -> tuple[DataFrame, float]:
    """(scores drawn to the share of abuse in the corpus, that share).

    Labelled documents hold more abuse than the corpus (their share is prior), so a probability learned from them is too high for
    it. The corpus's share is found by expectation maximisation over the scores of all its documents, which are counted in steps
    of 0.0001 in the cluster. scored is written to the checkpoint folder once; an empty frame stays as it is.
    """
    scored = cut_lineage(scored)
    steps = scored.groupBy(F.round("score", 4).alias("s")).count().toPandas()  # 10,001 rows at most
    share = prior
    odds = lambda p: p / (1 - p)
    s, n = np.clip(steps["s"].to_numpy(float), 1e-4, 1 - 1e-4), steps["count"].to_numpy(float)
    for _ in range(rounds if len(steps) and 0 < prior < 1 else 0):
        o = odds(s) * odds(share) / odds(prior)
        share = min(max(float(np.average(o / (1 + o), weights=n)), 1e-6), 1 - 1e-6)
    if share == prior:
        return scored, share
    c = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    o = c / (1 - c) * (odds(share) / odds(prior))
    return scored.withColumn("score", o / (1 + o)), share


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = _model(spark, docs, table(spark, sf_dir, "doc_labels"))
    scored = abuse_scores(docs, model)
    return scored if model.trees is None else for_corpus(scored, model.prior)[0]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return _scores(spark, sf_dir).filter(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    return _scores(spark, sf_dir)


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and flagged documents of each source."""
    s = _scores(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("score") >= THRESHOLD).cast("long")).alias("flagged")).withColumn("rate", F.col("flagged") / F.col("documents"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
SQL: dict[str, str] = {}
