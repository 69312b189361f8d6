"""Tokenizer for tagged text: tokens with character offsets, and the tags around them.

One regular expression divides a text into comments, instructions, tags, references and runs of
token characters. Tags keep their begin in characters and tokens; an end tag closes the most
recent open tag of its name. Runs once per text in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import arrow_map

#: Characters that end a token, besides control characters and blanks. Fixed values.
SPLITS = ";\"&/:!#?$%()@^*+-,=><[]{}|`~_\xa0"
#: Elements whose content is no text. Fixed values.
IGNORED = ("script", "style")
#: Tokens longer than this many bytes are dropped.
MAX_BYTES = 100

_SCAN = re.compile(
    r"(?P<skip><!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z))"
    r"|<(?P<close>/)?(?P<tag>[A-Za-z][\w:.-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|(?P<ref>&[A-Za-z0-9#]+;)"
    rf"|(?P<token>[^\x00-\x20{re.escape(SPLITS)}]+)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_QUOTES = str.maketrans("", "", "'“”’‘")
_TERMS = "term string, char_begin int, char_end int"
_TAGS = "name string, attributes map<string,string>, tok_begin int, tok_end int, char_begin int, char_end int"


def normalize(token: str) -> list[str]:
    """Lower case without quotes; single letters with periods between become one word, other
    periods divide, and parts of one letter are dropped except the last."""
    t = token.translate(_QUOTES).lower()
    if "." not in t:
        return [t] if t else []
    t = t.strip(".")
    if "." not in t:
        return [t] if t else []
    if all(c == "." for c in t[1::2]):
        return [t[::2]]
    parts = t.split(".")
    return [p for i, p in enumerate(parts) if p and (len(p) > 1 or i == len(parts) - 1)]


def tokenize(text: str | None, fields: tuple[str, ...] = ()) -> tuple[list, list]:
    """Terms (term, begin, end) and the tags whose names match one of the patterns ``fields``."""
    terms: list[tuple[str, int, int]] = []
    found: list[list] = []
    open_: list[list] = []
    skipped = whole = None
    wanted = [re.compile(f) for f in fields]
    for m in _SCAN.finditer(text or ""):
        name = m["tag"].lower() if m["tag"] else None
        if skipped:
            if m["close"] and name == skipped:
                skipped = None
            continue
        if whole is not None and not (m["close"] and name == whole[0]):
            continue
        if m["token"] is not None:
            terms += [(t, m.start(), m.end()) for t in normalize(m["token"]) if len(t.encode()) <= MAX_BYTES]
        elif name and not m["close"]:
            if name in IGNORED:
                skipped = None if m["attrs"].rstrip().endswith("/") else name
                continue
            attrs = {k.lower(): next(x for x in v if x or x is v[-1]) for k, *v in _ATTR.findall(m["attrs"])}
            if attrs.get("tokenizetagcontent") == "false":
                whole = (name, m.end())
            if any(w.fullmatch(name) for w in wanted):
                tag = [name, attrs, len(terms), None, m.start(), None]
                found.append(tag)
                if not m["attrs"].rstrip().endswith("/"):
                    open_.append(tag)
        elif name:
            if whole is not None:
                t = text[whole[1] : m.start()].strip().lower()
                if t:
                    terms.append((t, whole[1], m.start()))
                whole = None
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    open_[k][3], open_[k][5] = len(terms), m.end()
                    del open_[k]
                    break
    for tag in found:  # tags never closed are empty, at their begin
        if tag[3] is None:
            tag[3], tag[5] = tag[2], tag[4]
    return terms, found


def tokenized(documents: DataFrame, fields: tuple[str, ...] = (), docid: str = "doc_id", text: str = "text") -> DataFrame:
    """(docid, terms array<struct>, tags array<struct>); null texts have none of either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [tokenize(t, fields) for t in b.column(1).to_pylist()]
            t_kind = pa.list_(pa.struct([("term", pa.string()), ("char_begin", pa.int32()), ("char_end", pa.int32())]))
            g_kind = pa.list_(pa.struct([("name", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("tok_begin", pa.int32()), ("tok_end", pa.int32()), ("char_begin", pa.int32()), ("char_end", pa.int32())]))
            terms = pa.array([[dict(zip(("term", "char_begin", "char_end"), x, strict=True)) for x in t] for t, _ in out], t_kind)
            tags = pa.array([[{"name": g[0], "attributes": list(g[1].items()), "tok_begin": g[2], "tok_end": g[3], "char_begin": g[4], "char_end": g[5]} for g in gs] for _, gs in out], g_kind)
            yield pa.RecordBatch.from_arrays([b.column(0), terms, tags], names=["docid", "terms", "tags"])

    return arrow_map(documents.select(F.col(docid).cast("bigint").alias("docid"), F.col(text).alias("text")), run, f"docid bigint, terms array<struct<{_ddl(_TERMS)}>>, tags array<struct<{_ddl(_TAGS)}>>")


def _ddl(s: str) -> str:
    return re.sub(r"(^|, )(\w+) ", r"\1\2: ", s)
