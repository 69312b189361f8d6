"""Markup left in texts: where it stands, of what kind it is, and clean text without it.

A text is seen as a row of words and marks. Words score positive and tags negative, with
weights fitted on pages whose lines are labelled; one linear scan finds the contiguous region
with the highest sum. That region is converted: headings, lists, code blocks and formulas stay
visible as plain text. Tags of such structure score nothing, so that it stays whole. Texts
without tags, and records that are no page, are one region from end to end.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.lines import TAG
from scriptorium.session import arrow_map

_ENTITY_NAMES = frozenset(n[:-1] for n in html5 if n.endswith(";"))
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")
#: Font switches of LaTeX. Fixed values.
_SWITCHES = "bf it em tt sc sl rm sf bfseries itshape ttfamily scshape slshape small large Large huge Huge tiny footnotesize normalsize centering"


#: Target of a link: an address, which may hold pairs of brackets, and a title.
_TARGET = r"\((?:[^()\s]|\([^()\s]*\))+(?:[ \t]+\"[^\"\n]*\")?\)"


class Mark:
    """One form of markup: its kind, the signs one of which must be present, and its pattern."""

    def __init__(self, kind: str, name: str, signs: tuple[str, ...], pattern: str, flags: int = re.M):
        self.kind, self.name, self.signs, self.pattern = kind, name, signs, re.compile(pattern, flags)

    def possible(self, text: str) -> bool:
        return any(s in text for s in self.signs)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        if self.possible(text):
            for m in self.pattern.finditer(text):
                if self.name != "reference" or m[1] is None or m[1] in _ENTITY_NAMES:
                    yield m.start(), m.end()


MARKS = [
    Mark("html", "tag", ("<",), TAG + r"|<!DOCTYPE[^<>]*>", re.I),
    Mark("html", "comment", ("<!--",), r"<!--"),
    Mark("html", "reference", ("&",), _ENTITY.pattern),
    Mark("markdown", "heading", ("#",), r"^ {0,3}#{1,6}[ \t]+[^\s#]"),
    Mark("markdown", "underlined", ("===", "---"), r"^(?![ \t]*[|{=-])[^\n]*\S[^\n]*\n(?: {0,3}(?:={3,}|-{3,})|[ \t]*\r?\n={8,})[ \t]*(?:<!--[^\n]*-->|&\w+;)?[ \t]*\r?$"),
    Mark("markdown", "stars", ("*",), r"(?<![\w*\\])(\*{1,3})(?=[^\s*])[^*\n]*(?<=[^\s*])\1(?![\w*])"),
    Mark("markdown", "underscores", ("_",), r"(?<![\w\\{}^$])(_{1,3})(?=[^\s_{])[^_\n$]*(?<=[^\s_])\1(?!\w)"),
    Mark("markdown", "struck", ("~~",), r"~~(?=\S)[^~\n]+(?<=\S)~~"),
    Mark("markdown", "code", ("`",), r"(?<!`)`(?=[^`\s])[^`\n]*`(?!`)|^[ \t]*```"),
    Mark("markdown", "link", ("](",), rf"!?\[[^\[\]\n]*\]{_TARGET}"),
    Mark("markdown", "reference link", ("][", "]:"), r"(?<![\w\])])!?\[[^\[\]\n]+\]\[[^\[\]\n]*\]|^ {0,3}\[[^\[\]\n]+\]:[ \t]+\S+"),
    Mark("markdown", "address", ("<http", "<mailto"), r"<(?:https?://|mailto:)[^<>\s]+>"),
    Mark("markdown", "task", ("[ ]", "[x]", "[X]"), r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+\[[ xX]\](?=[ \t])"),
    Mark("markdown", "table", ("--",), r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*(?:\|[ \t]*:?-{2,}:?[ \t]*\|?|(?<=[-: \t])\|)[ \t]*\r?$"),
    Mark("wiki", "link", ("[[",), r"\[\[[^\[\]\n,]+(?:\|[^\[\]\n]*)?\]\]"),
    Mark("wiki", "outer link", ("[http",), r"(?<!\])\[https?://[^\s\]]+(?:[ \t]+[^\]\n]*)?\](?!\()"),
    Mark("wiki", "template", ("{{",), r"\{\{[ \t]*[^\W\d_#][^{}\n]*(?:\{\{[^{}\n]*\}\}[^{}\n]*)*\}\}|\{\{[ \t]*[^\W\d_#][^{}]*\n[ \t]*\|"),
    Mark("wiki", "quotes", ("''",), r"(?<![\w'`])('{2,5})(?=[^\s'])[^\n]*?(?<=[^\s'])\1(?!')"),
    Mark("wiki", "heading", ("==",), r"^[ \t]*(={2,6})[ \t]*[^=\s][^\n]*?\1[ \t]*\r?$"),
    Mark("wiki", "table", ("{|",), r"^[ \t:]*\{\|"),
    Mark("latex", "command", ("\\",), r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{"),
    Mark("latex", "switch", ("{\\",), r"\{\\(?:" + "|".join(_SWITCHES.split()) + r")\b"),
    Mark("latex", "formula", ("\\(", "\\["), r"\\\([^\n]+?\\\)|\\\[(?:[^\n]|\n(?!\s*\n))+?\\\]"),
    Mark("latex", "dollars", ("$",), r"(?<![\w$\\])\$(?=[^\s$\d]|\d[^\s$]*[\\^_=])[^$\n]*(?<=[^\s$\\])\$(?![\w$])|\$\$(?=[^$])(?:[^$\n]|\n(?!\s*\n))+\$\$"),
]
KINDS = ("html", "markdown", "wiki", "latex")


def kinds(text: str | None) -> list[str]:
    """The kinds of markup that ``text`` holds at least once, anywhere in it."""
    found = set()
    for m in MARKS if text else ():
        if m.kind not in found and next(m.spans(text), None) is not None:
            found.add(m.kind)
    return [k for k in KINDS if k in found]


# --- the content region -----------------------------------------------------------------

_TAG_OR_WORD = re.compile(rf"({TAG})|[^\W_]+", re.I)
_TAG_NAME = re.compile(r"</?([A-Za-z0-9]+)")
#: Elements that stand within a line of text, those of links and menus, and those of structure
#: that main text has too. Fixed values.
_INLINE = frozenset("b i u em strong span sub sup code small font mark q s br tt abbr cite var".split())
_LISTED = frozenset("a nav aside footer".split())
_STRUCTURE = frozenset("h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd table caption colgroup col thead tbody tfoot tr th td pre blockquote figure figcaption hr".split())
#: Score of a word and of the classes of tags before any fit; structure is never fitted.
DEFAULT_WEIGHTS = {"word": 1.0, "inline": -0.5, "block": -1.5, "listed": -3.0, "structure": 0.0}


def classes(text: str) -> list[tuple[str, int, int]]:
    """(class, begin, end) of every word and tag."""
    out = []
    for m in _TAG_OR_WORD.finditer(text):
        if m[1] is None:
            out.append(("word", m.start(), m.end()))
        else:
            n = _TAG_NAME.match(m[1])
            name = n[1].lower() if n else ""
            out.append(("inline" if name in _INLINE else "listed" if name in _LISTED else "structure" if name in _STRUCTURE else "block", m.start(), m.end()))
    return out


def best_region(text: str, weights: dict[str, float]) -> tuple[int, int]:
    """Begin and end of the contiguous region with the highest sum of scores, in whole lines; of
    several, the first and shortest, with the structural tags that open before and close after
    it. Nothing scores: the whole text."""
    best = total = 0.0
    items = classes(text)
    first, last = 0, -1
    begin_at = 0
    for k, (kind, _, _) in enumerate(items):
        if total <= 0.0:
            total, begin_at = 0.0, k
        total += weights[kind]
        if total > best:
            best, first, last = total, begin_at, k
    if best <= 0.0:
        return 0, len(text)
    while first and items[first - 1][0] == "structure" and text[items[first - 1][1] + 1] != "/":
        first -= 1
    while last + 1 < len(items) and items[last + 1][0] == "structure" and text[items[last + 1][1] + 1] == "/":
        last += 1
    e = text.find("\n", items[last][2])
    return text.rfind("\n", 0, items[first][1]) + 1, len(text) if e < 0 else e


def fit_weights(lines: DataFrame) -> dict[str, float]:
    """Weights from labelled lines (text, is_content): how far a class stands in content more
    often than outside, as a share of its occurrences, relative to that of words. So a region
    gives up words of content only against as much that is none; a class that stands in content
    for the most part costs nothing.

    All lines count; each batch adds up its own classes, so only a few sums are moved. Without
    lines of both labels the defaults stay.
    """
    order = [k for k in DEFAULT_WEIGHTS if k != "structure"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = {k: dict.fromkeys(order, 0) for k in (True, False)}
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for kind, _, _ in classes(text or ""):
                    if kind != "structure":
                        n[bool(label)][kind] += 1
            rows = [(k, c, n[k][c]) for k in n for c in order]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int64())], names=["label", "class", "n"])

    counted = arrow_map(lines.select("text", "is_content"), run, "label boolean, class string, n bigint")
    n = {True: dict.fromkeys(order, 1.0), False: dict.fromkeys(order, 1.0)}
    for r in counted.groupBy("label", "class").agg(F.sum("n").alias("n")).collect():  # eight sums
        n[r["label"]][r["class"]] += r["n"]
    inside, outside = sum(n[True].values()), sum(n[False].values())
    if min(inside, outside) <= 4.0:
        return dict(DEFAULT_WEIGHTS)
    w = {k: (n[True][k] - n[False][k]) / (n[True][k] + n[False][k]) for k in order}
    scale = max(w["word"], 0.05)
    return DEFAULT_WEIGHTS | {k: min(0.0, w[k] / scale) for k in order if k != "word"}


# --- conversion ---------------------------------------------------------------------------

_TAGS = re.compile(TAG, re.I)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_DROPPED = re.compile(r"<(script|style|noscript)\b[^<>]*>.*?</\1\s*>", re.I | re.S)
_PRE = re.compile(r"<pre\b[^<>]*>(.*?)(?:</pre\s*>|\Z)", re.I | re.S)
_CODE = re.compile(r"<(code|kbd|samp|tt)\b[^<>]*>(.*?)</\1\s*>", re.I | re.S)
_MATH = re.compile(r"<math\b[^<>]*>([^<>]*)</math\s*>", re.I)
_FENCE = re.compile(r"^([ \t]*)(```+|~~~+)[^\n`]*\n(?:.*?\n)??[ \t]*\2[ \t]*\r?$", re.M | re.S)
_H = re.compile(r"<h([1-6])\b[^<>]*>", re.I)
_LI = re.compile(r"<li\b[^<>]*>", re.I)
_CELL = re.compile(r"</t[dh]>\s*<t[dh]\b[^<>]*>", re.I)
_BREAK = re.compile(r"<(?:br|p|div|tr|ul|ol|table|section|article|blockquote|dt|dd)\b[^<>]*>|</(?:p|div|li|tr|h[1-6]|ul|ol|table|section|article|blockquote)\s*>", re.I)
_MD_LINK = re.compile(rf"!?\[([^\[\]\n]*)\]{_TARGET}")
_MD_REF = re.compile(r"(?<![\w\])])!?\[([^\[\]\n]+)\]\[[^\[\]\n]*\]")
_MD_DEF = re.compile(r"^ {0,3}\[[^\[\]\n]+\]:[ \t]+\S+[ \t]*\r?$", re.M)
_STARS = re.compile(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]*)(?<=[^\s*])\1(?![\w*])")
_UNDERS = re.compile(r"(?<![\w\\{}^$])(_{1,3})(?=[^\s_{])([^_\n$]*)(?<=[^\s_])\1(?!\w)")
_STRUCK = re.compile(r"~~(?=\S)([^~\n]+)(?<=\S)~~")
_TICK = re.compile(r"(?<!`)`(?=[^`\s])([^`\n]*)`(?!`)")
_DOLLARS = MARKS[[m.name for m in MARKS].index("dollars")].pattern
_UNDERLINE = re.compile(r"^([^\n]*\S[^\n]*)\n {0,3}(={3,}|-{3,})[ \t]*\r?$", re.M)
_RULED = MARKS[[m.name for m in MARKS].index("table")].pattern
_TASK = re.compile(r"^([ \t]*(?:[-*+]|\d+[.)])[ \t]+)\[[ xX]\][ \t]", re.M)
_WLINK = re.compile(r"\[\[(?:([^\[\]\n|]*)\|)*([^\[\]\n|]*)\]\]")
_WFILE = re.compile(r"\[\[(?:File|Image|Category|Datei|Fichier|Archivo|Kategorie|Catégorie|Categoría):[^\[\]\n]*\]\]", re.I)
_WOUT = re.compile(r"\[https?://[^\s\]]+[ \t]*([^\]\n]*)\](?!\()")
_WTPL = re.compile(r"\{\{([^{}]*)\}\}")
_WQUOTE = re.compile(r"'{2,5}")
_WHEAD = re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\s][^\n]*?)[ \t]*\1[ \t]*\r?$", re.M)
_WTABLE = re.compile(r"^[ \t:]*(?:\{\|[^\n]*|\|\}|\|-[^\n]*|\|\+)[ \t]*\r?$\n?", re.M)
_WROW = re.compile(r"^[ \t]*[|!] *", re.M)
_TEX_DROP = re.compile(r"\\(?:documentclass|usepackage|label|bibliography|bibliographystyle|pagestyle|thispagestyle|vspace|hspace|setlength|input|include)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}(?:\{[^{}\n]*\})?")
_TEX_REF = re.compile(r"[ ~]?\\(?:cite|citep|citet|ref|eqref|pageref)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}")
_TEX_HEAD = re.compile(r"\\(title|chapter|section|subsection|subsubsection|paragraph)\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
_TEX_CODE = re.compile(r"\\begin\{(verbatim|lstlisting)(\*?)\}(?:\[[^\]\n]*\])?(.*?)\\end\{\1\2\}", re.S)
_TEX_MATH = re.compile(r"\\begin\{(equation|align|displaymath|eqnarray)\*?\}(.*?)\\end\{\1\*?\}", re.S)
_TEX_ENV = re.compile(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
_TEX_ITEM = re.compile(r"\\item\b(?:\[[^\]\n]*\])?[ \t]*")
_TEX_NOTE = re.compile(r"\\footnote\{([^{}\n]*)\}")
_TEX_ARG = r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}"
_TEX_SWITCH = r"\{\\(?:" + "|".join(_SWITCHES.split()) + r")\b[ \t]*([^{}\n]*)\}"
_TEX_FORMULA = re.compile(r"\\\(.+?\\\)|\\\[.+?\\\]", re.S)
_TEX_ANY = re.compile(f"{_TEX_ARG}|{_TEX_SWITCH}")
_BLANK_LINES = re.compile(r"\n(?:[ \t]*\n){2,}")


def _template(m: re.Match) -> str:
    """The words a template shows: its longest positional value that is no language code."""
    shown = [p.strip() for p in m[1].split("|")[1:] if "=" not in p]
    shown = [p for p in shown if re.search(r"[^\W\d_]", p) and not re.fullmatch(r"[a-z]{2}", p)] or [p for p in shown if re.search(r"[^\W\d_]{2}", p) and p != "xx"]
    return max(shown, key=len, default="")


class _Kept:
    """Pieces set aside while the rest of a text is cleaned; they come back as they were."""

    def __init__(self, text: str):
        # two characters for private use that the text does not hold
        free = (chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in text)
        self.open, self.close, self.pieces = next(free), next(free), []

    def put(self, piece: str) -> str:
        self.pieces.append(piece)
        return f"{self.open}{len(self.pieces) - 1}{self.close}"

    def back(self, text: str) -> str:
        if self.pieces:
            mark = re.compile(f"{self.open}(\\d+){self.close}")
            while mark.search(text):  # a piece may hold earlier ones
                text = mark.sub(lambda m: self.pieces[int(m[1])], text)
        return text


def _unescape(t: str) -> str:
    return _ENTITY.sub(lambda m: html.unescape(m[0]) if m[1] is None or m[1] in _ENTITY_NAMES else m[0], t).replace("\xa0", " ") if "&" in t else t


def _block(code: str) -> str:
    return "\n```\n" + code.strip("\r\n") + "\n```\n"


def _until_same(pattern: re.Pattern, by, t: str) -> str:
    """Replaces from the inside out, however deep the nesting."""
    while True:
        s = pattern.sub(by, t)
        if s == t:
            return t
        t = s


def _set_aside(t: str, kept: _Kept) -> str:
    """Takes code and formulas out of ``t``, so that no sign in them is taken for markup."""
    if "```" in t or "~~~" in t:
        t = _FENCE.sub(lambda m: kept.put(m[0]), t)
    if "<" in t:
        bare = lambda x: _unescape(_TAGS.sub("", x))
        t = _PRE.sub(lambda m: kept.put(_block(bare(m[1]))), t)
        t = _CODE.sub(lambda m: kept.put(bare(m[2])), t)
        t = _MATH.sub(lambda m: kept.put("$" + _unescape(m[1]).strip() + "$"), t)
    if "`" in t:
        t = _TICK.sub(lambda m: kept.put(m[1]), t)
    if "\\" in t:
        t = _TEX_CODE.sub(lambda m: kept.put(_block(m[3])), t)
        t = _TEX_MATH.sub(lambda m: kept.put("$$" + " ".join(m[2].split()) + "$$"), t)
        t = _TEX_FORMULA.sub(lambda m: kept.put(m[0]), t)
    if "$" in t:
        t = _DOLLARS.sub(lambda m: kept.put(m[0]), t)
    return t


def clean(text: str | None) -> str | None:
    """``text`` without markup. Headings become lines starting with ``#``, list items with
    ``-``, code blocks stand between ````` ``` ````` lines, formulas between their signs; code and
    formulas are kept letter by letter. Null stays null, empty stays empty; text without markup
    comes back unchanged. Nested markup is taken off from the inside, to any depth."""
    if not text:
        return text
    t = text
    if "<" in t and ("<!--" in t or "<s" in t.lower() or "<n" in t.lower()):
        t = _DROPPED.sub(" ", _COMMENT.sub("", t))
    kept = _Kept(t)
    t = _set_aside(t, kept)
    if "<" in t and _TAGS.search(t):
        t = _LI.sub("\n- ", _H.sub(lambda m: "\n" + "#" * int(m[1]) + " ", _CELL.sub(" | ", t)))
        t = _TAGS.sub("", _BREAK.sub("\n", t))
    t = _unescape(t)
    if "{{" in t:
        t = _until_same(_WTPL, _template, t.replace("{{=}}", "="))
    if "[" in t:
        if "[[" in t:
            t = _WLINK.sub(lambda m: m[2], _WFILE.sub("", t))
        if "[http" in t:
            t = _WOUT.sub(r"\1", t)
        t = _TASK.sub(r"\1", _MD_DEF.sub("", _MD_REF.sub(r"\1", _MD_LINK.sub(r"\1", t))))
    if "''" in t:
        t = _WQUOTE.sub("", t)
    if "==" in t:
        t = _WHEAD.sub(lambda m: "#" * len(m[1]) + " " + m[2], t)
    if "===" in t or "---" in t:
        t = _UNDERLINE.sub(lambda m: f"# {m[1]}" if not m[1].lstrip().startswith("|") else m[0], t)
        t = _RULED.sub("", t)
    if "{|" in t or "\n|-" in t:
        t = _WROW.sub("", _WTABLE.sub("", t))
        t = t.replace("||", "|")
    if "\\" in t:
        t = _TEX_DROP.sub("", _TEX_REF.sub("", t))
        t = _TEX_HEAD.sub(lambda m: "# " + m[2], t)
        t = _TEX_ITEM.sub("- ", _TEX_ENV.sub("", t))
        t = _TEX_NOTE.sub(r" (\1)", t)
        t = _until_same(_TEX_ANY, lambda m: m[1] if m[1] is not None else m[2], t)
    if "*" in t:
        t = _STARS.sub(r"\2", t)
    if "_" in t:
        t = _UNDERS.sub(r"\2", t)
    if "~~" in t:
        t = _STRUCK.sub("", t)
    t = kept.back(t)
    return text if t == text else _BLANK_LINES.sub("\n\n", t).strip("\n")


def found(documents: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, kind): the kinds of markup in each document's text, inside its content region and
    outside; none for null and empty texts. Repeated rows stay repeated."""
    return cleaned(documents, weights).select("doc_id", F.explode("kinds").alias("kind"))


def cleaned(documents: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, text, kinds, region_begin, region_end): the clean text of the content region,
    the kinds of markup of the whole text, and where the region lies in it. A record without
    ``site`` is no page, so its region is the whole text. A null text has null everywhere but no
    kinds; an empty one stays empty."""
    w = weights or DEFAULT_WEIGHTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sites, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            spans = [None if t is None else best_region(t, w) if p is not None and "<" in t else (0, len(t)) for p, t in zip(sites, texts, strict=True)]
            out = [None if t is None else clean(t[s[0] : s[1]]) for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out, pa.string()), pa.array([kinds(t) for t in texts], pa.list_(pa.string())), pa.array([s and s[0] for s in spans], pa.int32()), pa.array([s and s[1] for s in spans], pa.int32())],
                names=["doc_id", "text", "kinds", "region_begin", "region_end"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow_map(documents.select("doc_id", "site", "text"), run, f"doc_id {kind}, text string, kinds array<string>, region_begin int, region_end int")
