"""Encoding of texts by a public byte-level BPE vocabulary (forced-boundary splitting).

A merge of byte-level BPE can only join bytes that stand side by side inside some vocabulary
token. If no token holds byte ``x`` followed by byte ``y``, a text may be cut between ``x`` and
``y`` and the two sides encoded on their own: the ids simply follow each other. The cuts used
here also have to be cuts of the vocabulary's pre-splitting pattern; see ``Encoder``.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import arrow_map, tokenizer_folder

#: Fragments kept ready per worker; beyond it the store starts anew, so memory is bounded.
STORE_LIMIT = 200_000
#: Longer fragments are encoded each time.
STORED_CHARS = 48


def joined_before(tokens: Iterator[bytes], blank: int) -> set[str] | None:
    """Characters that some token holds directly before ``blank``; None if one can't be told.

    Where a token holds no byte pair (x, blank), x being the last byte of a character, a cut
    between the two is certain. Byte pairs alone would also forbid cuts after characters that
    share their last byte with one of these, so the whole character is looked at.
    """
    found: set[str] = set()
    for t in tokens:
        for i in range(1, len(t)):
            if t[i] == blank:
                k = i - 1
                while k > 0 and 0x80 <= t[k] < 0xC0:
                    k -= 1
                try:
                    found.add(t[k:i].decode())
                except UnicodeDecodeError:
                    return None
    return found


class Encoder(dict):
    """Encodes by cutting at forced boundaries and looking fragments up; ``self`` is the store.

    Cuts lie between a character that is no white space and one of tab, line feed, carriage
    return and space. The pre-splitting pattern never lets a piece run from a non-space into
    white space, and its only look-ahead concerns white space before the cut, of which there is
    none, so such a cut never changes the pieces. The constructor checks against the vocabulary
    that no token spans it and leaves out any blank for which that fails.
    """

    def __init__(self, folder: str | None = None, name: str = "byte_bpe_50k"):
        super().__init__()
        import tiktoken

        folder = folder or tokenizer_folder()
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        spec = importlib.util.spec_from_file_location("_vocabulary_folder", os.path.join(folder, "__init__.py"))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        self.encoding = tiktoken.Encoding(name, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
        known = {b: joined_before(iter(ranks), ord(b)) for b in "\t\n\r "}
        self.cuts = "".join(b for b, left in known.items() if left is not None and all(x.isspace() for x in left))
        c = re.escape(self.cuts)
        self.pieces = regex.compile(module.PATTERN).findall
        self.ranks = ranks
        self.joined = np.zeros((256, 256), dtype=bool)
        for t in ranks:
            b = np.frombuffer(t, dtype=np.uint8)
            self.joined[b[:-1], b[1:]] = True
        self.fragments = re.compile(rf"\s*\S+(?:[^\S{c}]\s*\S+)*|\s+" if self.cuts else r"(?s).+").findall

    def __missing__(self, fragment: str) -> bytes:
        if len(fragment) > STORED_CHARS:
            parts = self.pieces(fragment)
            if len(parts) > 1:
                return b"".join([self[x] if len(x) <= STORED_CHARS else self.long_piece(x) for x in parts])
            return self.long_piece(fragment)
        ids = self.ids(self.encoding.encode_ordinary(fragment))
        if len(self) >= STORE_LIMIT:
            self.clear()
        self[fragment] = ids
        return ids

    @staticmethod
    def ids(found: list[int]) -> bytes:
        return np.array(found, dtype=np.int32).tobytes()

    def parts(self, piece: str) -> list[bytes]:
        """A piece of the pattern, cut between all bytes that no token holds side by side, except
        within a character."""
        raw = piece.encode()
        b = np.frombuffer(raw, dtype=np.uint8)
        cut = np.flatnonzero(~self.joined[b[:-1], b[1:]] & ((b[1:] & 0xC0) != 0x80)) + 1
        return [raw[x:y] for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(raw)], strict=True)]

    def long_piece(self, piece: str) -> bytes:
        parts = self.parts(piece)
        if len(parts) == 1:
            return self.ids(self.encoding.encode_ordinary(piece))
        return b"".join([self.ids(self.merged(x)) if x in self.ranks else self[x.decode()] if len(x) <= STORED_CHARS else self.ids(self.encoding.encode_ordinary(x.decode())) for x in parts])

    def merged(self, part: bytes) -> list[int]:
        """Merges of the lowest rank first, from single bytes on."""
        t = [part[i : i + 1] for i in range(len(part))]
        while len(t) > 1:
            rank, i = min((self.ranks.get(t[i] + t[i + 1], 1 << 62), i) for i in range(len(t) - 1))
            if rank == 1 << 62:
                break
            t[i : i + 2] = [t[i] + t[i + 1]]
        return [self.ranks[x] for x in t]

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian int32 bytes; none for null or empty text."""
        if not text:
            return b""
        get = self.__getitem__
        return b"".join([get(f) for f in self.fragments(text)])


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(folder: str | None, name: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = (folder, name)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(folder, name)
    return _ENCODERS[key]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, vocabulary: str = "byte_bpe_50k", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, ids array<int>), one row for each input row.

    Null and empty texts give an empty list; strings of special tokens are ordinary text;
    repeated rows stay repeated; other columns are dropped unless named in ``keep``. A narrow map: no shuffle, and only
    the two columns are read.
    """
    folder = folder or tokenizer_folder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, vocabulary)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            step = 512  # output batches stay small also where texts are long
            for i in range(0, len(texts), step):
                parts = [e.encode(t) for t in texts[i : i + step]]
                ends = np.zeros(len(parts) + 1, dtype=np.int32)
                np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
                flat = pa.array(np.frombuffer(b"".join(parts), dtype=np.int32))
                more = [b.column(2 + k).slice(i, step) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([ids.slice(i, step), pa.ListArray.from_arrays(pa.array(ends), flat), *more], names=["doc_id", "ids", *keep])

    keep = keep or []
    kinds = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep), run, f"doc_id {kind}, ids array<int>{kinds}")


def count_tokens(df: DataFrame, key_col: str, text_col: str = "text", folder: str | None = None, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(key, docs, tokens) with the key trimmed and lower-cased; null keys form one group.

    Workers add up within each batch before anything is shuffled, so a source that holds a
    third of all rows costs no more than any other.
    """
    folder = folder or tokenizer_folder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, vocabulary)
        for b in batches:
            total: dict = {}
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, m = total.get(k, (0, 0))
                total[k] = (n + 1, m + len(e.encode(t)) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())], names=["key", "docs", "tokens"])

    key = F.lower(F.trim(F.col(key_col)))
    part = arrow_map(df.select(key.alias("key"), F.col(text_col).alias("text")), run, "key string, docs bigint, tokens bigint")
    return part.groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
