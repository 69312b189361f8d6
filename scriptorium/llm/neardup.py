"""Near-duplicate texts: a blocked product of the sparse document-by-shingle matrix.

1. Each text (furniture and markup set aside) becomes the set of hashes of its runs of words.
   Texts with equal sets form a class; one of each class goes on.
2. A count sketch of fixed size orders all shingles from rare to common. Any fixed order gives
   the same result; this one makes it cheap. Cells hold at least the true count, so a shingle
   in a cell of count one is in no other text.
3. Two sets of sizes a and b with similarity t or more share o = t/(1+t) (a+b) shingles or more.
   Take the shared ones in the common order: from the r-th on, each set must still have o-r+1.
   So the first K shared ones lie in a prefix of each set, and each passes that test. Prefix
   entries are multiplied block by block of the matrix: entries of one shingle meet, pairs of
   them passing the size, position and sign tests count one. Common shingles are divided into
   square blocks, so that no task has to pair a long column alone.
4. In a column sorted by size, the sets that are large enough to be the larger one of a pair and
   small enough for the shingles left to the smaller one stand in a row. Only these are paired.
5. An entry's sign has a bit for each hash value, set if an odd number of shingles from the entry
   on have that value. Shared shingles cancel out, so two signs differ in at most as many bits as
   there are shingles in one set only; with o-K+1 shared ones to come, of u and v shingles left, these
   are u+v-2(o-K+1) or fewer. Signs of different widths are folded to the smaller one, which
   keeps that bound.
6. Pairs with fewer than K counts are dropped; those left are compared in full.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.boilerplate import Furniture, without_lines
from scriptorium.llm.lines import mix as _mix
from scriptorium.llm.markup import clean
from scriptorium.session import arrow_map, durable, release

#: Counts a pair must reach before it is compared in full.
COUNTS = 4
#: Cells of the sketch: the power of two from the number of shingles on, within these bounds.
CELLS = (1 << 16, 1 << 24)
#: Cells in one block of the sketch while it is added up.
_BLOCK = 1 << 16
#: Entries of one shingle up to which they are paired in one block; of a class of equal texts, a sixteenth.
COLUMN = 1 << 14
#: Most words of 64 bits in a sign, a power of two; bits for each shingle by which two sets of one size may
#: differ; shingles in no more texts than this get one word.
WORDS, BITS, RARE = 8, 4, 4
#: Pairs looked at together.
_PAIRS = 1 << 20
#: Most ids broadcast to leave documents out or pick them; with more they are joined.
BROADCAST_IDS = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_APOSTROPHE = re.compile("['’]")
_WORDS_KEPT = 500_000


class _WordHash(dict):
    def __missing__(self, w: str) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


#: Of ASCII characters, letters lower-cased and digits, all else a blank; apostrophes are dropped.
_PLAIN = bytes(c | 32 if chr(c).isalpha() and c < 128 else c if chr(c).isdigit() and c < 128 else 32 for c in range(256))


def words(text: str) -> list:
    """Lower-cased words without punctuation; as bytes if the text is plain ASCII, which is faster
    and gives equal hashes."""
    if text.isascii():
        return text.encode().translate(_PLAIN, b"'").split()
    return _WORD.findall(_APOSTROPHE.sub("", text.lower()))


def shingle_sets(texts: list[list[str]], run: int, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct runs of ``run`` words of each text, end to end, and how
    many each text has. Every text has at least ``run`` words."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not len(sizes):
        return np.zeros(0, np.uint64), sizes
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), dtype=np.uint64, count=int(sizes.sum()))
    m = len(h) - run + 1
    total = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = row[:m] == row[run - 1 :]  # runs must not reach into the next text
    # the text's number and the hash in one word sort fast; there are at most 2^16 texts
    both = (row[:m][inside].astype(np.uint64) << np.uint64(48)) | (_mix(total[inside]) >> np.uint64(16))
    both.sort()
    both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    return both & np.uint64((1 << 48) - 1), np.bincount((both >> np.uint64(48)).astype(np.int64), minlength=len(sizes))


def pack(x: np.ndarray) -> bytes:
    """48-bit numbers as six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(b) -> np.ndarray:
    raw = np.frombuffer(b, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _items(column: pa.Array) -> np.ndarray:
    """All numbers of a column of packed sets, end to end."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return unpack(memoryview(column.buffers()[2])[int(ends[0]) : int(ends[-1])]) if len(column) and ends[-1] > ends[0] else np.zeros(0, np.uint64)


def sets(documents: DataFrame, run_words: int = 3, least_words: int = 20, furniture: Furniture | None = None) -> DataFrame:
    """(doc_id, n, digest, items) of each document with enough words; ``items`` are the sorted
    48-bit hashes, packed. A text of fewer words than a run is one run, filled up with what is no
    word, so such texts meet if all their words are equal. Chance equals among 48 bits only add pairs that the full comparison
    of two sets, where they don't matter, sorts out."""
    rows, mark = (furniture or Furniture(documents)).with_lines(documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                ids, texts = [], []
                docs, sites, whole_texts, titles, marked = (c.to_pylist() for c in b.columns)
                for d, text, lines in zip(docs, whole_texts, mark(sites, whole_texts, titles, marked), strict=True):
                    w = words(clean(without_lines(text, lines)))
                    if len(w) >= max(least_words, 1):
                        ids.append(d)
                        texts.append(w + [b""] * (run_words - len(w)))
                items, n = shingle_sets(texts, run_words, known)
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                packed = [pack(items[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                digest = [xxhash.xxh3_128_digest(x) for x in packed]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n.astype(np.int32)), pa.array(digest, pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "n", "digest", "items"])

    return arrow_map(rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "site", "text", "title", "furniture"), run, "doc_id bigint, n int, digest binary, items binary")


def sketch(s: DataFrame) -> np.ndarray:
    """One byte a cell: the count of shingles in it, above 64 on a logarithmic scale.

    Its size does not depend on the number of documents beyond ``CELLS``.
    """
    total = s.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cells = CELLS[0]
    while cells < min(total, CELLS[1]):
        cells *= 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(cells, dtype=np.uint32)
        for b in batches:
            x = _items(b.column(0)) & np.uint64(cells - 1)
            np.add.at(c, x.astype(np.int64), 1)
        for k in range(0, cells, _BLOCK):
            part = c[k : k + _BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // _BLOCK], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(zlib.decompress(x), dtype=np.uint32).astype(np.uint64)
                sums[k] = sums[k] + v if k in sums else v
        for k, v in sums.items():
            code = np.where(v <= 64, v, 64 + np.floor(np.log(np.maximum(v, 64) / 64.0) / np.log(1.1))).clip(0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(code.tobytes(), 1)], pa.binary())], names=["block", "counts"])

    parts = arrow_map(s.select("items"), count, "block int, counts binary")
    out = np.zeros(cells, dtype=np.uint8)
    for r in arrow_map(parts.repartition("block"), add, "block int, counts binary").collect():  # one byte a cell
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint8)
    return out


def need(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Least number of shared shingles of sets of sizes a and b with similarity t."""
    return np.ceil(t / (1.0 + t) * (a + b) - 1e-9).astype(np.int64)


def signs(x: np.ndarray, end: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """For each entry ``at`` the parities of the hash values of ``x`` from it to the last shingle
    of its set, ``end``: a row of ``words`` words."""
    h = _mix(x)
    bit, word = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) & np.uint64(words - 1)
    out = np.empty((len(at), words), dtype=np.uint64)
    for k in range(words):
        one = np.where(word == np.uint64(k), bit, np.uint64(0))
        run = np.bitwise_xor.accumulate(one)
        out[:, k] = run[end] ^ run[at] ^ one[at]
    return out


def fold(sign: np.ndarray) -> np.ndarray:
    """Signs of half the width."""
    half = sign.shape[1] // 2
    return sign[:, :half] ^ sign[:, half:]


def entries(s: DataFrame, counts: np.ndarray, t: float) -> DataFrame:
    """(cell, doc, size_at, side, sign): the prefix entries that can match, by block of the matrix."""
    table = s.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = table.value
        mask = np.uint64(len(c) - 1)
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                yield one(whole.slice(start, 2048), c, mask)

    def one(b: pa.RecordBatch, c: np.ndarray, mask: np.uint64) -> pa.RecordBatch:
        n = np.asarray(b.column(1)).astype(np.int64)
        x = _items(b.column(2))
        row = np.repeat(np.arange(len(n)), n)
        code = c[(x & mask).astype(np.int64)]
        o = np.lexsort((x, code, row))
        x, code = x[o], code[o].astype(np.int64)
        ends = np.cumsum(n)
        at = np.arange(len(x)) - np.repeat(ends - n, n)
        kept = np.flatnonzero((at < (n - np.ceil(t * n - 1e-9).astype(np.int64) + COUNTS)[row]) & (code > 1))
        sign = signs(x, ends[row[kept]] - 1, kept, WORDS)
        x, code, row, at = x[kept], code[kept], row[kept], at[kept]
        doc = np.asarray(b.column(0)).astype(np.int64)[row]
        size_at = (n[row] << 32) | at
        # as wide as the entry needs against a set of its own size
        differ = 2 * (n[row] - at - need(n[row], n[row], t) + COUNTS - 1)
        width = np.where(code <= RARE, 1, 1 << np.ceil(np.log2(np.clip(differ * BITS / 64.0, 1, WORDS))).astype(np.int64))
        words = np.zeros_like(sign)
        w, f = WORDS, sign
        while True:
            words[:, :w] = np.where((width == w)[:, None], f, words[:, :w])
            if w == 1:
                break
            w, f = w // 2, fold(f)
        count = np.where(code <= 64, code, 64.0 * 1.1 ** (code - 63.0))
        sides = np.ceil(count / COLUMN).astype(np.int64)
        few = np.flatnonzero(sides == 1)
        out = [(x[few].view(np.int64), few, np.zeros(len(few), dtype=np.int8))]
        for k in np.flatnonzero(sides != 1):  # few: rows of the prefix are the rare ones
            m = int(sides[k])
            u = int(_mix(doc[k : k + 1].view(np.uint64))[0] % np.uint64(m))
            v = np.arange(m, dtype=np.uint64)
            lo, hi = np.minimum(v, np.uint64(u)), np.maximum(v, np.uint64(u))
            with np.errstate(over="ignore"):
                cell = _mix(x[k] + _mix((lo << np.uint64(32)) + hi + np.uint64(1)))
            side = np.where(lo == hi, 0, np.where(v >= np.uint64(u), 1, 2)).astype(np.int8)
            out.append((cell.view(np.int64), np.full(m, k), side))
        cell, k, side = (np.concatenate(z) for z in zip(*out, strict=True))
        width = width[k]
        flat = words[k][np.arange(WORDS) < width[:, None]]
        offsets = np.concatenate(([0], np.cumsum(width * 8))).astype(np.int32)
        sign = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(doc[k]), pa.array(size_at[k]), pa.array(side), sign], names=["cell", "doc", "size_at", "side", "sign"])

    return arrow_map(s.select("doc_id", "n", "items"), run, "cell bigint, doc bigint, size_at bigint, side tinyint, sign binary")


def _signs_of(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The signs of a column, a row of ``words`` words each, and how many of them are in use."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    width = np.diff(ends) // 8
    out = np.zeros((len(column), words), dtype=np.uint64)
    out[np.arange(words) < width[:, None]] = np.frombuffer(memoryview(column.buffers()[2])[int(ends[0]) : int(ends[-1])], dtype=np.uint64)
    return out, width


def _multiply(t: float):
    """Entries in order of cell and size to (a, b, counts), pairs that pass the size, position and sign tests."""
    part = max(t / (1.0 + t), 1e-12)

    def likely(doc, size, at, side, folds, width, i, j):
        """Of the pairs of entries i and j of one cell, those that pass."""
        a, b = size[i], size[j]
        u, v = a - at[i], b - at[j]
        o = need(a, b, t)
        r = np.minimum(COUNTS, o)  # the pair's first r shared shingles pass
        ok = np.flatnonzero((np.minimum(a, b) >= t * np.maximum(a, b) - 1e-9) & (np.minimum(u, v) >= o - (r - 1)) & ((side[i] == 0) | (side[i] != side[j])) & (doc[i] != doc[j]))
        i, j, o = i[ok], j[ok], o[ok]
        differ = (u + v)[ok] - 2 * (o - r[ok] + 1)
        narrow = np.minimum(width[i], width[j])
        for f in folds:
            w = f.shape[1]
            bits = np.zeros(len(i), dtype=np.int64)
            for k in range(w):
                bits += np.bitwise_count(f[i, k] ^ f[j, k])
            ok = np.flatnonzero((bits <= differ) | (narrow < w))
            i, j, o, differ, narrow = i[ok], j[ok], o[ok], differ[ok], narrow[ok]
        x, y = doc[i], doc[j]
        # pairs that need not share as many as COUNTS shingles pass at once
        return np.minimum(x, y), np.maximum(x, y), np.where(o < COUNTS, COUNTS, 1)

    def emit(found):
        a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        if not len(a):
            return
        o = np.lexsort((b, a))
        a, b, n = a[o], b[o], np.concatenate([f[2] for f in found])[o]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        n = np.add.reduceat(n, first).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(n)], names=["a", "b", "counts"])

    def blocks(cell, doc, size_at, side, sign, width):
        size, at = size_at >> 32, size_at & 0xFFFFFFFF
        folds = [sign]  # narrow ones first; a narrow sign stands in the first words of its row
        while folds[0].shape[1] > 1:
            folds.insert(0, fold(folds[0]))
        number = np.cumsum(np.concatenate(([False], cell[1:] != cell[:-1])))
        top = int(size.max()) + 1
        key = number * top + size
        # the largest set that may be the entry's partner; larger ones need more shingles than are left
        reach = np.minimum((size - at + COUNTS - 1 + 1e-6) / part - size, size / max(t, 1e-12) + 1e-6)
        last = np.searchsorted(key, number * top + np.clip(reach, 0, top - 1).astype(np.int64), side="right")
        first = np.arange(1, len(cell) + 1)
        many = np.maximum(last - first, 0)
        ends = np.cumsum(many)
        s = 0
        while s < len(cell):
            before = int(ends[s - 1]) if s else 0
            e = max(s + 1, int(np.searchsorted(ends, before + _PAIRS, side="right")))
            m = many[s:e]
            if m.any():
                i = np.repeat(np.arange(s, e), m)
                j = np.arange(len(i)) - np.repeat(ends[s:e] - m - before, m) + np.repeat(first[s:e], m)
                yield likely(doc, size, at, side, folds, width, i, j)
            s = e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None  # entries of the cell that may go on in the next batch
        found: list = []
        held = 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [*(np.asarray(b.column(k)) for k in range(4)), *_signs_of(b.column(4), WORDS)]
            if rest is not None:
                cols = [np.concatenate(z) for z in zip(rest, cols, strict=True)]
            cell = cols[0]
            cut = int(np.searchsorted(cell, cell[-1], side="left"))
            rest = [c[cut:] for c in cols]
            if cut:
                for f in blocks(*(c[:cut] for c in cols)):
                    found.append(f)
                    held += len(f[0])
                    if held > 1_000_000:
                        yield from emit(found)
                        found, held = [], 0
        if rest is not None:
            for f in blocks(*rest):
                found.append(f)
                held += len(f[0])
                if held > 1_000_000:
                    yield from emit(found)
                    found, held = [], 0
        yield from emit(found)

    return run


def _similar(t: float):
    """Pairs with both sets to (a, b, similarity), those at or above ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                u, v = unpack(x.as_buffer()), unpack(y.as_buffer())
                shared = len(np.intersect1d(u, v, assume_unique=True))
                sim.append(shared / (len(u) + len(v) - shared))
            sim = np.array(sim, dtype=np.float64)
            keep = pa.array(np.flatnonzero(sim >= t - 1e-12))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(sim).take(keep)], names=["a", "b", "similarity"])

    return run


class NearDuplicates:
    """Classes of equal sets, and the pairs of classes at or above a similarity.

    ``members``: (rep, doc_id), every document with at least ``least_words`` words, with the
    lowest id of its class. ``pairs``: (a, b, similarity), a < b, between representatives; each
    pair of different sets with that similarity, none lost. Null, empty and short texts are in
    neither. Document ids are unique. ``furniture`` are the page templates of the collection, if
    they are known; else they are deduced here.
    """

    def __init__(self, documents: DataFrame, run_words: int = 3, threshold: float = 0.5, least_words: int = 20, furniture: Furniture | None = None):
        t = threshold
        s = durable(sets(documents, run_words, least_words, furniture), "sets")
        classes = s.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
        many = classes.where(F.col("size") > 1)
        copies = durable(s.select("doc_id", "digest").join(many, "digest").select("rep", "doc_id", "size"), "copies")
        more = copies.where(F.col("rep") != F.col("doc_id")).select("doc_id")
        n_more = more.count()
        self.copies = copies
        if n_more:
            more = F.broadcast(more) if n_more <= BROADCAST_IDS else more
            singles = s.join(more, "doc_id", "left_anti")
        else:
            singles = s
        self.members = s.select("doc_id").join(copies.drop("size"), "doc_id", "left").select(F.coalesce("rep", "doc_id").alias("rep"), "doc_id")
        counts = sketch(singles)
        blocks = entries(singles, counts, t).repartition("cell").sortWithinPartitions("cell", "size_at")
        counted = arrow_map(blocks, _multiply(t), "a bigint, b bigint, counts int").groupBy("a", "b").agg(F.sum("counts").alias("counts"))
        likely = counted.where(F.col("counts") >= COUNTS)
        likely = durable(likely.select("a", "b"), "likely")
        docs = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        n_docs = docs.count()
        docs = F.broadcast(docs) if n_docs <= BROADCAST_IDS else docs
        needed = s.select("doc_id", "items").join(docs, "doc_id", "left_semi")
        x = likely.join(needed.select(F.col("doc_id").alias("a"), F.col("items").alias("xs")), "a")
        y = x.join(needed.select(F.col("doc_id").alias("b"), F.col("items").alias("ys")), "b")
        self.pairs = arrow_map(y.select("a", "b", "xs", "ys"), _similar(t), "a bigint, b bigint, similarity double")

    def groups(self, documents: DataFrame | None = None) -> DataFrame:
        """(doc_id, group_id, links): one row per member; the group is named by its lowest id. With
        ``documents``, one row for each of them: those that are no members stand alone.

        Groups are the connected parts of the pairs. Labels sink to the least of their
        neighbours' and then jump to their label's label, so rounds grow with the logarithm of a
        group's width; each round is written. ``links`` counts the other documents at or above
        the similarity.
        """
        pairs = durable(self.pairs.select("a", "b"), "pairs")
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = last = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
        while True:
            near = both.join(label.select(F.col("a").alias("b"), F.col("label").alias("of")), "b").groupBy("a").agg(F.min("of").alias("of"))
            sunk = label.join(near, "a").select("a", F.col("label").alias("old"), F.least("label", "of").alias("label"))
            jump = label.select(F.col("a").alias("label"), F.col("label").alias("to"))
            new = sunk.join(jump, "label", "left").select("a", "old", F.coalesce(F.least("label", "to"), "label").alias("label"))
            new = durable(new, "labels")
            done = new.where("old <> label").isEmpty()
            release(last)  # only the newest round is read again
            label, last = new.select("a", "label"), new
            if done:
                break
        size = self.members.groupBy("rep").agg(F.count("*").alias("size"))
        linked = both.join(size.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("size").alias("others"))
        x = self.members.join(size, "rep").join(label.withColumnRenamed("a", "rep"), "rep", "left").join(linked.withColumnRenamed("a", "rep"), "rep", "left")
        x = x.select("doc_id", F.coalesce("label", "rep").alias("group_id"), (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("links"))
        if documents is None:
            return x
        x = documents.select(F.col("doc_id").cast("bigint").alias("doc_id")).join(x, "doc_id", "left")
        return x.select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))

    def all_pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b: the pairs of documents. Their number can be as large
        as the square of a class; prefer ``pairs`` with ``members`` where that is enough."""
        m = self.members
        across = self.pairs.join(m.select(F.col("rep").alias("a"), F.col("doc_id").alias("x")), "a").join(m.select(F.col("rep").alias("b"), F.col("doc_id").alias("y")), "b")
        across = across.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
        # a large class is divided: each part of it meets the whole class in a task of its own
        c = self.copies
        parts = F.ceil(F.col("size") / max(1, COLUMN // 16)).cast("int")
        left = c.select("rep", F.col("doc_id").alias("doc_a"), F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"))
        right = c.select("rep", F.col("doc_id").alias("doc_b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        within = left.join(right, ["rep", "part"]).where("doc_a < doc_b").select("doc_a", "doc_b")
        return across.unionByName(within)
