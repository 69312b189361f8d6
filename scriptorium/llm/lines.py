"""Lines of texts, seen as nested paths of words; shared by the template and text operators."""

from __future__ import annotations

import html
import re

import numpy as np
import xxhash

#: Elements of HTML. Fixed values.
HTML_NAMES = (
    "a abbr address article aside b base blockquote body br button caption center cite code col dd del details dfn div "
    "dl dt em fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins "
    "kbd label legend li link main mark meta nav noscript object ol option p param pre q s samp script section select "
    "small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time "
    "title tr tt u ul var video audio wbr"
)
_NAMES = "|".join(sorted(HTML_NAMES.split(), key=lambda n: (-len(n), n)))
_ATTRIBUTE = r"""\s+[A-Za-z_:@][\w:.@-]*(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`]+))?"""
#: One tag or comment, also over line ends; a tag needs a known name, so comparisons and markers
#: are none.
TAG = rf"<!--[\s\S]*?-->|</?(?:{_NAMES})(?:[ \t/][^<>\n]*>|(?:{_ATTRIBUTE})*\s*/?>)"
_TAG = re.compile(TAG, re.I)
_LINK = re.compile(r"!?\[([^\[\]\n]*)\](?:\((?:[^()\s]|\([^()\s]*\))*\)|\[[^\[\]\n]*\])")
_DIGITS = re.compile(r"\d+")
_DRESS = re.compile(r"\*+|__+|'{2,}|`+|^[ \t]*#{1,6}[ \t]", re.M)
#: Stands for the site's own name in a path.
SITE = "␟"
#: Signs that part the pieces of a line; each is a word of its own. Fixed values.
SEPARATORS = "|:>/·•»–—"
#: Depths of the nested paths from a line's begin and from its end; each further one is so many
#: times as deep.
BEGIN, END, DEEPER = (1, 2, 3, 6), (2, 4), 4
#: Kinds of roles; a label is a path from the begin that ends in a separator.
FROM_BEGIN, FROM_END, WHOLE, INNER, LABEL = KINDS = range(5)
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
_FACTOR = 0xD6E8FEB86659FD93
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def site_words(site: str | None) -> str:
    """The name part of a host, as words: ``www.green-post.example`` gives ``green post``."""
    if not site:
        return ""
    labels = [x for x in site.lower().strip().split(".") if x]
    return labels[-2 if len(labels) > 1 else 0].replace("-", " ") if labels else ""


def _blank(m: re.Match) -> str:
    return " " + "\n" * m[0].count("\n")


def plain(text: str, site: str = "") -> list[str]:
    """The lines of ``text`` without tags, entities, link targets and emphasis marks, lower-cased,
    numbers as 0 and the site's name as one word. The number of lines is that of ``text``."""
    t = text
    if "<" in t:
        t = _TAG.sub(_blank, t)
    if "&" in t:
        t = "\n".join([" ".join(html.unescape(x).split("\n")) if "&" in x else x for x in t.split("\n")])
    if "](" in t or "][" in t:
        t = _LINK.sub(r"\1", t)
    if "*" in t or "__" in t or "''" in t or "`" in t or "#" in t:
        t = _DRESS.sub("", t)
    t = _DIGITS.sub("0", t.lower())
    if site and site in t:
        t = t.replace(site, SITE)
    for x in SEPARATORS:
        if x in t:
            t = t.replace(x, f" {x} ")
    return t.split("\n")


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (finalizer of a multiply-shift hash)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _WordHash(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


_HASHES = _WordHash()


def _powers(x: int, n: int) -> np.ndarray:
    """x^0 up to x^n, modulo 2^64."""
    out = np.full(n + 1, x, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class Lines:
    """The lines of some texts as words, and the roles of their words.

    ``doc``, ``no`` and ``n`` give the text, the number and the words of every line that has any.
    A role is the path of words from a line's begin (or back from its end), at depths that nest
    one in the other up to the whole line, however long; and the two words after a separator.
    """

    def __init__(self, texts: list[str | None], sites: list[str | None]):
        words: list[str] = []
        doc, no, n = [], [], []
        self.plain: list[list[str]] = []
        for k, (text, site) in enumerate(zip(texts, sites, strict=True)):
            rows = plain(text, site_words(site)) if text else []
            self.plain.append(rows)
            for i, line in enumerate(rows):
                w = line.split()
                if w:
                    words += w
                    doc.append(k)
                    no.append(i)
                    n.append(len(w))
        self.doc, self.no, self.n = (np.array(x, dtype=np.int64) for x in (doc, no, n))
        h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
        with np.errstate(over="ignore"):
            up = _powers(_FACTOR, len(h))
            self._down = _powers(_INVERSE, len(h))
            self._sums = np.concatenate(([np.uint64(0)], np.cumsum(h * up[:-1], dtype=np.uint64)))
        self.begin = np.cumsum(self.n) - self.n
        self._hashes = h

    def _span(self, s: np.ndarray, e: np.ndarray, kind: int) -> np.ndarray:
        """Role of the words from ``s`` up to ``e``: sums of powers, so any span costs the same."""
        with np.errstate(over="ignore"):
            return mix((self._sums[e] - self._sums[s]) * self._down[s] + _SALTS[kind])

    def roles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, role, parent, kind, depth), ``line`` an index into ``doc``; a role's parent is
        the role one step out, 0 at the outermost."""
        line, role, parent, kind, depth = [], [], [], [], []
        s, e, n = self.begin, self.begin + self.n, self.n
        longest = int(n.max(initial=0))

        def add(at, r, up, k, d):
            line.append(at)
            role.append(r)
            parent.append(up)
            kind.append(np.full(len(at), k, dtype=np.int8) if np.isscalar(k) else k.astype(np.int8))
            depth.append(np.full(len(at), d, dtype=np.int64) if np.isscalar(d) else d)

        outer = np.zeros(len(n), dtype=np.uint64)
        parts = np.isin(self._hashes, _SEPARATOR_HASHES)
        for k, depths in ((FROM_BEGIN, BEGIN), (FROM_END, END)):
            last = np.zeros(len(n), dtype=np.uint64)
            for d in _depths(depths, longest):
                at = np.flatnonzero(n > d)
                r = self._span(s[at], s[at] + d, k) if k == FROM_BEGIN else self._span(e[at] - d, e[at], k)
                add(at, r, last[at], np.where(parts[s[at] + d - 1], LABEL, k) if k == FROM_BEGIN and d > 1 else k, d)
                last[at] = r
            if k == FROM_BEGIN:
                outer = last
        every = np.arange(len(n))
        add(every, self._span(s, e, WHOLE), outer, WHOLE, n)
        sep = np.flatnonzero(parts)
        if len(sep):
            at = np.searchsorted(s, sep, side="right") - 1
            ok = (sep > s[at]) & (sep + 2 < e[at])
            at, sep = at[ok], sep[ok]
            add(at, self._span(sep, sep + 3, INNER), np.zeros(len(at), dtype=np.uint64), INNER, 3)
        return tuple(np.concatenate(x) for x in (line, role, parent, kind, depth))


def _depths(first: tuple[int, ...], longest: int) -> list[int]:
    out = [d for d in first if d < longest]
    d = DEEPER * first[-1]
    while d < longest:
        out.append(d)
        d *= DEEPER
    return out


_SEPARATOR_HASHES = np.array([xxhash.xxh3_64_intdigest(x) for x in SEPARATORS], dtype=np.uint64)
