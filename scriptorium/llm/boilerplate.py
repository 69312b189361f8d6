"""Page furniture, found by deducing the templates of sites.

A word's *role* is the path of words from the begin of its line up to it, or from it to the
line's end, nested up to the whole line (``lines.Lines``). On each host a role has an *occurrence
vector*, the pages that hold it. Roles with equal vectors that nest in one another form one
class: the fixed words of a template line. Where the class ends and the lines go on differently,
there is a *slot*; a line belongs to the template if it follows a class up to its slot and what
fills the slot is about as long as on other pages.

Two kinds of evidence make a class part of a template. On its own host it is regular: it stands
on a large part of the pages, once on each, with different bodies around it. And it stands on
pages but not in records that are no page, against the share of the class around it; vectors of
all hosts laid end to end serve that comparison, so small hosts gain from others that use the same
publishing system. Where there are too few records that are no page to compare with, regularity
alone must do, and the fixed words must then make up half of the line or end in a separator.

Vectors are never gathered. Each is kept as mergeable numbers (pages, lines, words, a 64-bit map
of distinct page bodies), added up within each batch, then by Spark; the pages of a role are among
those of the role it nests in, so equal numbers of pages mean equal vectors. Copies of one page under many hosts do not make a template: support counts
distinct page bodies, not pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.lines import KINDS, LABEL, SITE, WHOLE, Lines, mix, plain, site_words
from scriptorium.session import arrow_map, durable

#: A class is part of a template from this (smoothed) share of its occurrences on pages.
SURE = 0.88
#: Weight, in occurrences, of what is expected before any comparison.
WEIGHT = 5.0
#: Expected share of a class that is regular on its hosts.
REGULAR_SHARE = 0.9
#: Part of a host's pages on which a regular class stands.
REGULAR = 0.3
#: Least part of the pages of any host on which a class of a template stands.
PRESENT = 0.02
#: Distinct page bodies below which a class is not looked at, and a bit less for estimates.
LEAST = 3 - 0.2
#: Part of a class's lines that must go on otherwise than most of them, for a slot to follow it.
SLOT = 0.1
#: A slot may be this many times as long as usual, and some words more.
SLOT_TIMES, SLOT_MORE = 3, 8
#: Occurrences to be expected in records that are no page, below which they prove nothing.
CONTRAST = 3.0
#: Most roles that are sent to every worker (8 bytes each); more are joined by a shuffle.
BROADCAST_ROLES = 1_000_000
#: Most hosts sent to every worker (16 bytes each).
BROADCAST_HOSTS = 1_000_000
#: Least part of the page bodies expected of a template that must be distinct, in general and where
#: hosts show it regularly; copies fall below.
DISTINCT, DISTINCT_REGULAR = 0.5, 0.25
_SENTENCE_END = re.compile(r'[.!?]["\'”]?\s+')
#: Documents per step while roles are counted; bounds a worker's memory.
_CHUNK = 2048

_COUNTS = "role bigint, host bigint, parent bigint, kind tinyint, depth int, pages bigint, lines bigint, words bigint, bodies bigint"


def body_key(lines: list[str]) -> int:
    """A number that copies of one text with small edits mostly share: the least hash among its
    longer sentences, however they are broken into lines."""
    found = [xxhash.xxh3_64_intdigest(x) for x in _SENTENCE_END.split(" ".join(lines)) if len(x) > 30]
    return min(found, default=0)


def role_counts(pages: DataFrame) -> DataFrame:
    """One row per role and host: its parent, kind, depth, pages, lines, words of these lines
    and bodies. All rows of a role are in one partition. Each batch adds up its own, so a
    host or role with a third of all pages sends no more rows than any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _CHUNK):
                b = whole.slice(start, _CHUNK)
                x = Lines(b.column(1).to_pylist(), b.column(0).to_pylist())
                if not len(x.n):
                    continue
                line, role, parent, kind, depth = x.roles()
                hosts = np.asarray(b.column(2)).view(np.uint64)
                bodies = np.array([1 << (body_key(rows) & 63) for rows in x.plain], dtype=np.uint64)
                doc = x.doc[line]
                with np.errstate(over="ignore"):
                    key = mix(role + mix(hosts)[doc])
                o = np.lexsort((doc, key))
                key, d = key[o], doc[o]
                first = np.concatenate(([True], key[1:] != key[:-1]))
                once = first | np.concatenate(([True], d[1:] != d[:-1]))  # a page counts once
                at = np.flatnonzero(first)
                pick = o[at]
                sums = [np.add.reduceat(once.astype(np.int64), at), np.diff(np.append(at, len(o))), np.add.reduceat(x.n[line[o]], at), np.bitwise_or.reduceat(bodies[d], at).view(np.int64)]
                # rows of one host and parent side by side are packed better
                near = np.lexsort((parent[pick], hosts[doc[pick]]))
                pick, sums = pick[near], [v[near] for v in sums]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(role[pick].view(np.int64)),
                        pa.array(hosts[doc[pick]].view(np.int64)),
                        pa.array(parent[pick].view(np.int64)),
                        pa.array(kind[pick]),
                        pa.array(depth[pick].astype(np.int32)),
                        *map(pa.array, sums),
                    ],
                    names=["role", "host", "parent", "kind", "depth", "pages", "lines", "words", "bodies"],
                )

    rows = arrow_map(pages.select("site", "text", F.xxhash64("site").alias("host")), run, _COUNTS)
    same = [F.min(c).alias(c) for c in ("parent", "kind", "depth")]
    sums = [F.sum(c).alias(c) for c in ("pages", "lines", "words")]
    return rows.repartition("role").groupBy("role", "host").agg(*same, *sums, F.bit_or("bodies").alias("bodies"))


def _support(pages: Column, bodies: Column) -> Column:
    """Distinct page bodies, from how many of 64 cells are taken; from 56 on, the pages."""
    taken = F.bit_count(bodies)
    return F.when(taken < 56, F.least(pages.cast("double"), -64.0 * F.log(1.0 - F.least(taken, F.lit(60)) / 64.0))).otherwise(pages.cast("double"))


def candidates(documents: DataFrame) -> DataFrame:
    """One row per role that stands on pages with different bodies, over all hosts, with
    ``support`` and ``regular``: is it so on most hosts that have it several times?"""
    pages = documents.where(F.col("site").isNotNull() & F.col("text").isNotNull())
    hosts = durable(pages.groupBy(F.xxhash64("site").alias("host")).agg(F.count("*").alias("host_pages")), "hosts")
    n = hosts.count()
    own = role_counts(pages).join(F.broadcast(hosts) if n <= BROADCAST_HOSTS else hosts, "host", "left")
    several = _support(F.col("pages"), F.col("bodies")) >= LEAST
    regular = several & (F.col("pages") >= REGULAR * F.col("host_pages")) & (F.col("lines") <= 1.5 * F.col("pages"))
    same = [F.min(c).alias(c) for c in ("parent", "kind", "depth")]
    sums = [F.sum(c).alias(c) for c in ("pages", "lines", "words")]
    a = own.groupBy("role").agg(
        *same, *sums, F.bit_or("bodies").alias("bodies"),
        F.sum(several.cast("int")).alias("hosts"), F.sum(regular.cast("int")).alias("regular_hosts"), F.max(F.col("pages") / F.col("host_pages")).alias("rate"),
    )
    taken = F.bit_count("bodies")
    expected = 64.0 * (1.0 - F.exp(-F.col("pages") / 64.0))
    a = a.withColumn("support", _support(F.col("pages"), F.col("bodies"))).withColumn("regular", (F.col("regular_hosts") > 0) & (2 * F.col("regular_hosts") >= F.col("hosts")))
    distinct = F.when(F.col("regular"), DISTINCT_REGULAR).otherwise(DISTINCT)
    a = a.where((F.col("support") >= LEAST) & (taken >= distinct * expected) & (F.col("rate") >= PRESENT))
    return a.select("role", "parent", "kind", "depth", "pages", "lines", "words", "support", "regular")


def elsewhere(documents: DataFrame, cand: DataFrame) -> DataFrame:
    """(role, others): in how many records that are no page a candidate role stands."""
    spark = documents.sparkSession
    n = cand.count()
    few = n <= BROADCAST_ROLES
    known = spark.sparkContext.broadcast(np.sort(np.asarray(cand.select("role").toArrow().column(0), dtype=np.int64))) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _CHUNK):
                texts = whole.slice(start, _CHUNK).column(0).to_pylist()
                x = Lines(texts, [None] * len(texts))
                if not len(x.n):
                    continue
                line, role = x.roles()[:2]
                role, doc = role.view(np.int64), x.doc[line]
                if known is not None:
                    at = np.flatnonzero(_among(known.value, role))
                    role, doc = role[at], doc[at]
                o = np.lexsort((doc, role))
                role, doc = role[o], doc[o]
                if len(role):
                    once = np.concatenate(([True], (role[1:] != role[:-1]) | (doc[1:] != doc[:-1])))
                    r, c = np.unique(role[once], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(c.astype(np.int64))], names=["role", "others"])

    rows = arrow_map(documents.where(F.col("site").isNull() & F.col("text").isNotNull()).select("text"), run, "role bigint, others bigint")
    return rows.groupBy("role").agg(F.sum("others").alias("others"))


def _among(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``table``."""
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x if len(table) else np.zeros(len(x), dtype=bool)


def templates(documents: DataFrame) -> DataFrame:
    """(role, kind, depth, longest, contrasted, pages, others, share): the roles that end a class
    of a template, with the longest line that may follow them.

    ``share`` is the class's share of occurrences on pages, smoothed towards that of the class
    around it, or ``REGULAR_SHARE`` where hosts show it regularly. Roles of one class (equal
    vectors) have one share: evidence counts once. Without pages, or without any repeated role,
    the result is empty.
    """
    has_text = documents.where(F.col("text").isNotNull())
    n = has_text.agg(F.count("site").alias("pages"), F.count("*").alias("all")).first()
    ratio = min(1.0, (n["all"] - n["pages"]) / max(1, n["pages"]))
    # a small part of all roles, cut off so that the pages are read once for it
    cand = durable(candidates(documents), "roles")
    c = cand.join(elsewhere(documents, cand), "role", "left").fillna({"others": 0})
    c = durable(c.where(F.col("others") * 100 <= F.col("pages")), "roles")
    e = F.col("support") * ratio
    blank = F.when(F.col("regular"), REGULAR_SHARE).otherwise(0.5)
    own = lambda prior: (e + WEIGHT * prior) / (e + F.col("others") + WEIGHT)
    up = c.select(F.col("role").alias("parent"), F.col("pages").alias("up_pages"), own(blank).alias("up_share"))
    prior = F.greatest(F.coalesce("up_share", F.lit(0.5)), blank)
    share = F.when(F.col("pages") == F.col("up_pages"), F.greatest("up_share", own(blank))).otherwise(own(prior))
    goes_on = c.where("parent <> 0").groupBy("parent").agg(F.max("lines").alias("inner_lines")).withColumnRenamed("parent", "role")
    j = c.join(up, "parent", "left").withColumn("share", share).join(goes_on, "role", "left")
    ends = (F.col("kind") == WHOLE) | (F.col("lines") - F.coalesce("inner_lines", F.lit(0)) >= SLOT * F.col("lines"))
    longest = F.when(F.col("kind") == WHOLE, F.col("depth")).otherwise(F.ceil(SLOT_TIMES * F.col("words") / F.col("lines")) + SLOT_MORE)
    return j.where((F.col("share") >= SURE) & ends).select("role", "kind", "depth", longest.cast("int").alias("longest"), (e >= CONTRAST).alias("contrasted"), "pages", "others", "share")


def _marked(line, n, kind, depth, longest, contrasted, lines: int) -> np.ndarray:
    """Which lines follow the templates, from the template roles in them."""
    ok = n[line] <= longest
    sure = np.zeros(lines, dtype=bool)
    sure[line[ok & (contrasted | (kind == WHOLE) | (kind == LABEL))]] = True
    fixed = np.zeros((len(KINDS), lines), dtype=np.int64)
    np.maximum.at(fixed, (kind[ok], line[ok]), depth[ok])
    return sure | (2 * fixed.sum(axis=0) >= n) & (fixed.sum(axis=0) > 0)


class Marker:
    """Marks lines of texts in a worker by a sorted table of template roles."""

    def __init__(self, table: DataFrame):
        t = table.select("role", "kind", "depth", "longest", "contrasted").toArrow()
        role = np.asarray(t.column(0), dtype=np.int64)
        o = np.argsort(role)
        self.role = role[o]
        self.kind, self.depth, self.longest, self.contrasted = (np.asarray(t.column(k + 1))[o] for k in range(4))

    def lines(self, texts: list[str | None], sites: list[str | None], titles: list[str | None] | None = None) -> list[list[int]]:
        """The furniture lines of each page; none where the site is null. A line that is the
        page's own title is none."""
        out: list[list[int]] = [[] for _ in texts]
        if not len(self.role):
            return out
        x = Lines([None if s is None else t for t, s in zip(texts, sites, strict=True)], sites)
        if not len(x.n):
            return out
        line, role = x.roles()[:2]
        role = role.view(np.int64)
        at = np.minimum(np.searchsorted(self.role, role), len(self.role) - 1)
        hit = np.flatnonzero(self.role[at] == role)
        at = at[hit]
        got = _marked(line[hit], x.n, self.kind[at], self.depth[at], self.longest[at], self.contrasted[at], len(x.n))
        for k in np.flatnonzero(got).tolist():
            d, no = int(x.doc[k]), int(x.no[k])
            if not (titles and titles[d] and is_title(x.plain[d][no], titles[d], sites[d])):
                out[d].append(no)
        return out


def is_title(line: str, title: str, site: str | None) -> bool:
    """Is a (plain) line of two words or more the title of its page, with or without the site's
    name at the title's end and up to three words before it (as of a reply or a new version)?"""
    w, t = line.split(), " ".join(plain(title, site_words(site))).split()
    if len(w) > 1 and t[: len(w)] == w and (len(t) == len(w) or SITE in t[len(w) :]):
        return True
    if SITE in t[1:]:
        t = t[: len(t) - 1 - t[::-1].index(SITE)]
        while t and not t[-1].isalnum():
            t = t[:-1]
    return len(t) > 1 and w[-len(t) :] == t and len(w) <= len(t) + 3


class Furniture:
    """The template roles, ready for workers: sent to all while they are few, else joined. One
    object serves all operators on main texts of the same collection."""

    def __init__(self, documents: DataFrame):
        t = durable(templates(documents), "templates")
        self.table = t
        self.titled = "metadata" in documents.columns
        few = t.count() <= BROADCAST_ROLES
        self.marker = documents.sparkSession.sparkContext.broadcast(Marker(t)) if few else None

    def _title(self) -> Column:
        return (F.col("metadata")["title"] if self.titled else F.lit(None)).cast("string").alias("title")

    def marks(self, documents: DataFrame) -> DataFrame:
        """(doc_id, lines array<int>): the furniture lines of each page that has any."""
        pages = documents.where(F.col("site").isNotNull() & F.col("text").isNotNull())
        if self.marker is None:
            return self._joined(pages)
        marker = self.marker

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, _CHUNK):
                    b = whole.slice(start, _CHUNK)
                    found = marker.value.lines(b.column(2).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist())
                    keep = pa.array([k for k, x in enumerate(found) if x], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(keep), pa.array([x for x in found if x], pa.list_(pa.int32()))], names=["doc_id", "lines"])

        kind = documents.schema["doc_id"].dataType.simpleString()
        return arrow_map(pages.select("doc_id", "site", "text", self._title()), run, f"doc_id {kind}, lines array<int>")

    def _joined(self, pages: DataFrame) -> DataFrame:
        """The same by a shuffle on the role, for more templates than fit every worker. A common
        role's rows are cut to those of template roles by the join alone, in salted parts."""
        parts = 16
        t = self.table.select("role", "kind", "depth", "longest", "contrasted").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        rows = line_roles(pages.select("doc_id", "site", "text", self._title())).withColumn("salt", F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(parts)).cast("int"))
        hit = rows.join(t, ["role", "salt"]).where(F.col("n") <= F.col("longest"))
        most = [F.max(F.when(F.col("kind") == k, F.col("depth")).otherwise(0)) for k in KINDS]
        sure = F.max(F.col("contrasted") | F.col("kind").isin(WHOLE, LABEL))
        found = hit.groupBy("doc_id", "line_no").agg(sure.alias("sure"), F.first("n").alias("n"), sum(most[1:], most[0]).alias("fixed"))
        return found.where("sure or 2 * fixed >= n").groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("lines"))

    def with_lines(self, documents: DataFrame, columns: list[str]) -> tuple[DataFrame, object]:
        """For operators on main text: the columns, ``site``, ``text``, ``title`` and, where the
        roles don't fit the workers, ``furniture``, the marked lines, else null; and a function
        for workers from (sites, texts, titles, furniture) to the marked lines of each text."""
        base = documents.select(*columns, "site", "text", self._title())
        marker = self.marker
        if marker is not None:
            return base.withColumn("furniture", F.lit(None).cast("array<int>")), lambda sites, texts, titles, _: marker.value.lines(texts, sites, titles)
        m = self.marks(documents).select("doc_id", F.col("lines").alias("furniture"))
        return base.join(m, "doc_id", "left"), lambda sites, texts, titles, marked: [x or [] for x in marked]


def line_roles(pages: DataFrame) -> DataFrame:
    """(doc_id, line_no, n, role) for every role of every line but those of the page's title."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                sites, titles = b.column(1).to_pylist(), b.column(3).to_pylist()
                x = Lines(b.column(2).to_pylist(), sites)
                if not len(x.n):
                    continue
                line, role = x.roles()[:2]
                own = np.array([bool(titles[d] and is_title(x.plain[d][no], titles[d], sites[d])) for d, no in zip(x.doc.tolist(), x.no.tolist(), strict=True)])
                keep = np.flatnonzero(~own[line])
                line, role = line[keep], role[keep]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(x.doc[line])), pa.array(x.no[line].astype(np.int32)), pa.array(x.n[line].astype(np.int32)), pa.array(role.view(np.int64))], names=["doc_id", "line_no", "n", "role"])

    kind = pages.schema["doc_id"].dataType.simpleString()
    return arrow_map(pages, run, f"doc_id {kind}, line_no int, n int, role bigint")


def without_lines(text: str, marked: list[int] | None) -> str:
    """``text`` without the lines of these numbers."""
    if not marked:
        return text
    drop = set(marked)
    return "\n".join([x for no, x in enumerate(text.split("\n")) if no not in drop])


def furniture(documents: DataFrame, known: Furniture | None = None) -> DataFrame:
    """(doc_id, line_no): the lines of ``documents.text`` that are page furniture.

    Null and empty texts and records without ``site`` have none; blank lines never count. Lines
    split at line feeds only, whatever other line ends the text has.
    """
    return (known or Furniture(documents)).marks(documents).select("doc_id", F.explode("lines").alias("line_no"))


def main_texts(documents: DataFrame, known: Furniture | None = None) -> DataFrame:
    """(doc_id, text): every document with the furniture lines taken out; null texts stay null."""
    rows, mark = (known or Furniture(documents)).with_lines(documents, ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sites, texts, titles, marked = (c.to_pylist() for c in b.columns[1:])
            out = [t and without_lines(t, m) for t, m in zip(texts, mark(sites, texts, titles, marked), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows.select("doc_id", "site", "text", "title", "furniture"), run, f"doc_id {kind}, text string")


def labelled_lines(documents: DataFrame, known: Furniture | None = None) -> DataFrame:
    """(text, is_content) of the lines of pages, as the templates label them; blank lines are left
    out. All pages take part, with tags or without."""
    rows, mark = (known or Furniture(documents)).with_lines(documents.where(F.col("site").isNotNull() & F.col("text").isNotNull()), ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, label = [], []
            sites, whole, titles, marked = (c.to_pylist() for c in b.columns)
            for text, found in zip(whole, mark(sites, whole, titles, marked), strict=True):
                out = set(found)
                for no, line in enumerate(text.split("\n")):
                    if line.strip():
                        texts.append(line)
                        label.append(no not in out)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(label, pa.bool_())], names=["text", "is_content"])

    return arrow_map(rows.select("site", "text", "title", "furniture"), run, "text string, is_content boolean")
