"""Structured queries: tree, parser, printer.

``#op:key=value:value( child child )``; bare words are ``#text:word()``, quoted text is
``#quote``, ``word.field`` is ``#inside( word #extents:field:part=extents() )``. Values between
``@/`` and ``/`` are taken literally. Several arguments at the top stand in ``#root``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace


class QueryError(ValueError):
    """A query that cannot be parsed or planned."""


@dataclass(frozen=True)
class Node:
    op: str
    params: tuple[tuple[str, object], ...] = ()
    children: tuple[Node, ...] = ()
    position: int = field(default=0, compare=False)

    @property
    def p(self) -> dict:
        return dict(self.params)

    def get(self, key: str, default=None):
        return self.p.get(key, default)

    def with_params(self, **kw) -> Node:
        return replace(self, params=_params(self.p | kw))

    def with_children(self, children) -> Node:
        return replace(self, children=tuple(children))

    def __str__(self) -> str:
        own = "".join(f":{_show(v)}" if k == "default" else f":{k}={_show(v)}" for k, v in self.params)
        if not self.children:
            return f"#{self.op}{own}()"
        return f"#{self.op}{own}( {' '.join(map(str, self.children))} )"


def _show(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str) and (not re.fullmatch(r"[^\s:=()#@\"]+", v) or _value(v) != v):
        return f"@/{v}/"
    return str(v)


def _params(p: dict) -> tuple:
    return tuple(sorted(p.items(), key=lambda kv: (kv[0] != "default", kv[0])))


def node(op: str, children=(), **params) -> Node:
    return Node(op, _params(params), tuple(children))


def text(word: str, **params) -> Node:
    return node("text", (), default=word, **params)


def combine(children, weights=None, **params) -> Node:
    w = {} if weights is None else {str(i): float(x) for i, x in enumerate(weights)}
    return node("combine", children, **w, **params)


def _value(s: str):
    if s in ("true", "false"):
        return s == "true"
    if re.fullmatch(r"[-+]?\d+", s):
        return int(s)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.?\d+)([eE][-+]?\d+)?", s):
        return float(s)
    return s


_LEX = re.compile(r"@/(?P<lit>[^/]*)/|\"(?P<quote>[^\"]*)\"|(?P<sign>[#:=().,])|(?P<word>[^\s#:=().,\"@]+)|(?P<space>\s+)|(?P<other>.)", re.S)


def _lex(s: str) -> list[tuple[str, str, int]]:
    out = []
    for m in _LEX.finditer(s):
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[m.lastgroup], m.start()))
        elif out:
            out.append(("space", " ", m.start()))
    return out


class _Parser:
    def __init__(self, s: str):
        self.t, self.i = _lex(s), 0

    def peek(self, skip: bool = True) -> tuple[str, str, int]:
        if skip:
            while self.i < len(self.t) and self.t[self.i][0] == "space":
                self.i += 1
        return self.t[self.i] if self.i < len(self.t) else ("end", "", -1)

    def next(self):
        t = self.peek(False)
        self.i += 1
        return t

    def arguments(self, closed: bool) -> list[Node]:
        out = []
        while True:
            kind, s, at = self.peek()
            if kind == "end":
                if closed:
                    raise QueryError("a closing parenthesis is missing")
                return out
            if s == ")" and kind == "sign":
                if not closed:
                    raise QueryError(f"unexpected ) at {at}")
                self.next()
                return out
            n = self.one()
            if n is not None:
                out.append(n)

    def one(self) -> Node | None:
        kind, s, at = self.peek()
        if kind == "sign" and s == "#":
            n = self.operator()
        elif kind == "quote":
            self.next()
            words = s.split()
            n = text(words[0]) if len(words) == 1 else node("quote", [text(w) for w in words]) if words else None
        elif kind in ("word", "lit"):
            self.next()
            n = Node("text", (("default", s),), (), at)
        elif kind == "sign" and s in ".,":
            self.next()
            return None
        else:
            raise QueryError(f"unexpected {s!r} at {at}")
        if n is None:
            return None
        kind, s, at = self.peek(False)
        nxt = self.t[self.i + 1] if self.i + 1 < len(self.t) else ("end", "", -1)
        if kind == "sign" and s == "." and (nxt[0] == "word" or nxt[1] == "("):
            self.next()
            if nxt[1] == "(":
                raise QueryError(f"smoothing by a field, .( ) at {at}, is not supported")
            fields = [self.next()[1]]
            while self.peek(False)[1] == "," and self.i + 1 < len(self.t) and self.t[self.i + 1][0] == "word":
                self.next()
                fields.append(self.next()[1])
            outer = [node("extents", default=f, part="extents") for f in fields]
            n = node("inside", [n, outer[0] if len(outer) == 1 else node("syn", outer)])
        return n

    def operator(self) -> Node:
        at = self.next()[2]
        kind, name, _ = self.next()
        if kind != "word":
            raise QueryError(f"an operator's name is missing at {at}")
        params: dict = {}
        while self.peek(False)[1] == ":" and self.peek(False)[0] == "sign":
            self.next()
            key = self.value()
            if self.peek(False)[1] == "=" and self.peek(False)[0] == "sign":
                self.next()
                key, val = str(key[0]), self.value()
            else:
                key, val = "default", key
            if key in params:
                raise QueryError(f"parameter {key} is given twice at {at}")
            params[key] = val[0] if val[1] else _value(val[0])
        if not (self.peek(False)[0] == "sign" and self.peek(False)[1] == "("):
            raise QueryError(f"( is missing after #{name} at {at}")
        self.next()
        return Node(name.lower(), _params(params), tuple(self.arguments(True)), at)

    def value(self) -> tuple[str, bool]:
        """Text up to the next : = or (, and whether any of it was literal."""
        out, literal = "", False
        while True:
            kind, s, _ = self.peek(False)
            if kind in ("end", "space") or (kind == "sign" and s in ":=()"):
                return out, literal
            literal |= kind in ("lit", "quote")
            out += self.next()[1]


def parse(query: str | None) -> Node:
    """The tree of a query; null and blank queries are an empty ``#root``."""
    args = _Parser(query or "").arguments(False)
    return args[0] if len(args) == 1 else node("root", args)


def parse_simple(query: str) -> Node:
    """``field:term^weight "a phrase" term`` to a weighted ``#combine``."""
    children, weights = [], []
    for m in re.finditer(r"(?:(\w+):)?(?:\"([^\"]*)\"|([^\s\"^]+))(?:\^([\d.]+))?", query or ""):
        words = m[2].split() if m[2] is not None else [m[3]]
        if not words:
            continue
        n = text(words[0]) if len(words) == 1 else node("ordered", [text(w) for w in words], default=1)
        if m[1]:
            n = node("inside", [n, node("extents", default=m[1], part="extents")])
        children.append(n)
        weights.append(float(m[4]) if m[4] else 1.0)
    return combine(children, None if all(w == 1.0 for w in weights) else weights)


def walk(n: Node):
    yield n
    for c in n.children:
        yield from walk(c)


def transform(n: Node, f) -> Node:
    """Bottom-up rewriting; ``f`` gets each node with its new children."""
    return f(n.with_children([transform(c, f) for c in n.children]) if n.children else n)


def weights_of(n: Node) -> list[float]:
    """Weights of a combination's children, normalized unless ``norm`` says otherwise."""
    p = n.p
    w = [float(p.get(str(i), 1.0)) for i in range(len(n.children))]
    total = sum(w)
    if p.get("norm", n.op != "wsum") and total > 0:
        w = [x / total for x in w]
    return w
