"""Parsing with derivatives, memoised.

A grammar is a set of rules over token classes. The derivative of a parser by a token is the parser of what may
follow; the empty parser marks a token that cannot stand there, and a parser that does not accept the empty rest
at the end marks a text that breaks off. Parsers are hash-consed: equal ones are one node, so a derivative is
computed once for each node and token, whatever file it is met in. Rules must not be left-recursive.
"""

from __future__ import annotations

import re

EMPTY, EPS = 0, 1
#: The class of a line end that a grammar may consume or ignore.
LINE_END = -3
_TOK, _CAT, _ALT, _STAR, _REF = range(2, 7)
#: Nodes after which an engine starts anew, between two texts.
MOST_NODES = 150_000

_LEX = re.compile(r"\s*(?:'([^']+)'|(\w+)|([()|*+?=;])|(#[^\n]*))")


class Grammar:
    """Rules in a small notation: name = body ; with 'token', name, ( ), |, *, + and ?."""

    def __init__(self, text: str, start: str, line_end: str | None = None):
        """line_end: a class that may also be ignored wherever it stands."""
        self.start_name, self.line_end = start, line_end
        self.classes: dict[str, int] = {}
        self.bodies: dict[str, tuple] = {}
        self._read(text)
        self.reset()

    # reading

    def _read(self, text: str) -> None:
        toks, at = [], 0
        while (m := _LEX.match(text, at)) and m.end() > at:
            at = m.end()
            if m[1] is not None:
                toks.append(("t", m[1]))
                self.classes.setdefault(m[1], len(self.classes))
            elif m[2]:
                toks.append(("n", m[2]))
            elif m[3]:
                toks.append((m[3], m[3]))
        if text[at:].strip():
            raise ValueError(f"grammar: {text[at : at + 40]!r}")
        i = 0

        def alt():
            nonlocal i
            parts = [cat()]
            while toks[i][0] == "|":
                i += 1
                parts.append(cat())
            return parts[0] if len(parts) == 1 else ("|", *parts)

        def cat():
            nonlocal i
            parts = []
            while toks[i][0] in ("t", "n", "("):
                kind, x = toks[i]
                i += 1
                if kind == "(":
                    p = alt()
                    i += 1
                else:
                    p = (kind, x)
                while toks[i][0] in ("*", "+", "?"):
                    p = (toks[i][0], p)
                    i += 1
                parts.append(p)
            return (".", *parts)

        while i < len(toks):
            name = toks[i][1]
            i += 2
            self.bodies[name] = alt()
            i += 1

    # nodes

    def reset(self) -> None:
        self.kind, self.args, self.null, self.memo = [EMPTY, EPS], [(), ()], [False, True], [{}, {}]
        self.known: dict[tuple, int] = {}
        self.rules: dict[str, int] = {}
        self.refs = {n: self._node(_REF, (n,)) for n in self.bodies}
        for n, b in self.bodies.items():
            self.rules[n] = self._build(b)
        changed = True
        while changed:  # which nodes accept the empty text
            changed = False
            for i in range(2, len(self.kind)):
                null = self.null[self.rules[self.args[i][0]]] if self.kind[i] == _REF else self._nullable(i)
                if null != self.null[i]:
                    self.null[i] = changed = True
        self.start = self.refs[self.start_name]
        self.end_class = self.classes.get(self.line_end, -2) if self.line_end else -2

    def _node(self, kind: int, args: tuple) -> int:
        key = (kind, args)
        if (n := self.known.get(key)) is None:
            n = self.known[key] = len(self.kind)
            self.kind.append(kind)
            self.args.append(args)
            self.null.append(False)
            self.memo.append({})
            self.null[n] = self._nullable(n)
        return n

    def _nullable(self, n: int) -> bool:
        k, a = self.kind[n], self.args[n]
        if k == EPS or k == _STAR:
            return True
        if k == _CAT:
            return self.null[a[0]] and self.null[a[1]]
        if k == _ALT:
            return any(self.null[x] for x in a)
        return self.null[n] if k == _REF else False

    def _build(self, b: tuple) -> int:
        op = b[0]
        if op == "t":
            return self._node(_TOK, (self.classes[b[1]],))
        if op == "n":
            return self.refs[b[1]]
        if op == "*":
            return self._node(_STAR, (self._build(b[1]),))
        if op == "+":
            x = self._build(b[1])
            return self.cat(x, self._node(_STAR, (x,)))
        if op == "?":
            return self.alt([EPS, self._build(b[1])])
        if op == "|":
            return self.alt([self._build(x) for x in b[1:]])
        out = EPS
        for x in reversed(b[1:]):
            out = self.cat(self._build(x), out)
        return out

    def cat(self, a: int, b: int) -> int:
        if a == EMPTY or b == EMPTY:
            return EMPTY
        if a == EPS:
            return b
        if b == EPS:
            return a
        if self.kind[a] == _CAT:
            x, y = self.args[a]
            return self._node(_CAT, (x, self.cat(y, b)))
        return self._node(_CAT, (a, b))

    def alt(self, parts: list[int]) -> int:
        flat: set[int] = set()
        for p in parts:
            if self.kind[p] == _ALT:
                flat.update(self.args[p])
            elif p != EMPTY:
                flat.add(p)
        if not flat:
            return EMPTY
        if len(flat) == 1:
            return flat.pop()
        # alternatives with the same rest are joined in front of it
        rests: dict[int, list[int]] = {}
        for p in flat:
            if self.kind[p] == _CAT:
                rests.setdefault(self.args[p][1], []).append(self.args[p][0])
        for rest, heads in rests.items():
            if len(heads) > 1 and rest not in (EPS,):
                flat.difference_update(self._node(_CAT, (h, rest)) for h in heads)
                flat.add(self._node(_CAT, (self.alt(heads), rest)))
        if len(flat) == 1:
            return flat.pop()
        return self._node(_ALT, tuple(sorted(flat)))

    def derive(self, n: int, t: int) -> int:
        """The derivative of node n by token class t."""
        d = self.memo[n].get(t)
        if d is None:
            k, a = self.kind[n], self.args[n]
            if k == _TOK:
                d = EPS if a[0] == t else EMPTY
            elif k == _CAT:
                d = self.cat(self.derive(a[0], t), a[1])
                if self.null[a[0]]:
                    d = self.alt([d, self.derive(a[1], t)])
            elif k == _ALT:
                d = self.alt([self.derive(x, t) for x in a])
            elif k == _STAR:
                d = self.cat(self.derive(a[0], t), n)
            elif k == _REF:
                d = self.derive(self.rules[a[0]], t)
            else:
                d = EMPTY
            self.memo[n][t] = d
        return d

    def _step(self, n: int, t: int) -> int:
        """As derive; the class LINE_END is also ignored."""
        if t != LINE_END:
            return self.derive(n, t)
        if (d := self.memo[n].get(t)) is None:
            d = self.memo[n][t] = self.alt([n, self.derive(n, self.end_class)])
        return d

    def run(self, classes: list[int]) -> int | None:
        """None if the tokens are a sentence; else the index of the failing token, or their number if they break off."""
        if len(self.kind) > MOST_NODES:
            self.reset()
        n, memo = self.start, self.memo
        for i, t in enumerate(classes):
            d = memo[n].get(t)
            n = self._step(n, t) if d is None else d
            if n == EMPTY:
                return i
        return None if self.null[n] else len(classes)
