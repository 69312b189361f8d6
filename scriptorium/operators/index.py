"""Index tables of a collection: postings, lengths, extents, typed fields, and their statistics.

A table is a DataFrame; there is no file format of its own. Saved, postings are Parquet sorted by
term within range partitions, so that a look-up of terms reads few row groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import simple_token_count, simple_tokens
from scriptorium.session import arrow_map

TABLES = ("postings", "lengths", "names", "extents", "fields")
#: Formats of typed fields, with the column that holds the value. Fixed values.
FORMATS = {"string": "v_string", "int": "v_long", "long": "v_long", "float": "v_double", "double": "v_double", "date": "v_timestamp"}


@dataclass
class Index:
    """``postings(part, term, docid, tf, positions, length)`` (the document's length again, so that
    scoring needs no join), ``lengths(field, docid, length)``,
    ``names(docid, name)``, ``extents(name, docid, begin, end)`` and ``fields(field, docid,
    v_string, v_long, v_double, v_timestamp)``."""

    postings: DataFrame
    lengths: DataFrame
    names: DataFrame
    extents: DataFrame | None = None
    fields: DataFrame | None = None

    def term_stats(self) -> DataFrame:
        """(part, term, cf, df, max_tf)."""
        return self.postings.groupBy("part", "term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"), F.max("tf").alias("max_tf"))

    def field_stats(self) -> DataFrame:
        """(field, collection_length, document_count, nonzero_docs, max_length, min_length, avg_length)."""
        n = F.col("length")
        return self.lengths.groupBy("field").agg(
            F.sum(n).alias("collection_length"),
            F.count("*").alias("document_count"),
            F.count_if(n > 0).alias("nonzero_docs"),
            F.max(n).alias("max_length"),
            F.min(n).alias("min_length"),
            F.avg(n).alias("avg_length"),
        )

    def forward(self) -> DataFrame:
        """(docid, terms array<struct<term, tf, positions>>): one row per document."""
        return self.postings.groupBy("docid").agg(F.array_sort(F.collect_list(F.struct("term", "tf", "positions"))).alias("terms"))

    def vocabulary(self, part: str = "postings") -> DataFrame:
        return self.postings.where(F.col("part") == part).select("term").distinct()

    def save(self, path: str, partitions: int | None = None) -> None:
        p = self.postings
        p = p.repartitionByRange(partitions, "part", "term") if partitions else p.repartitionByRange("part", "term")
        p.sortWithinPartitions("part", "term", "docid").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
        for name in TABLES[1:]:
            t = getattr(self, name)
            if t is not None:
                t.write.mode("overwrite").parquet(f"{path}/{name}")

    def save_side(self, path: str, name: str, table: DataFrame) -> None:
        """A side table (priors, indicators, sketch, background, conflation, counts, ...) beside the
        index's own; it is written anew if it is there."""
        if name in TABLES or not name.isidentifier():
            raise ValueError(f"{name} can't name a side table")
        table.write.mode("overwrite").parquet(f"{path}/side/{name}")

    @staticmethod
    def open_side(spark: SparkSession, path: str, name: str) -> DataFrame | None:
        """A side table, or None if it was not saved."""
        try:
            return spark.read.parquet(f"{path}/side/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    @staticmethod
    def repair(spark: SparkSession, path: str) -> list[str]:
        """Builds anew what postings can tell: lengths of documents that have none, and names of
        documents without one. Returns the tables that were missing something."""
        i = Index.open(spark, path)
        mended = []
        known = i.postings.where(F.col("part") == "postings").groupBy("docid").agg(F.max("length").alias("length"))
        for name, table, row in (
            ("lengths", i.lengths, known.select(F.lit("document").alias("field"), "docid", F.col("length").cast("int").alias("length"))),
            ("names", i.names, known.select("docid", F.concat(F.lit("DOC"), F.col("docid").cast("string")).alias("name"))),
        ):
            lost = row if table is None else row.join(table.where(F.col("field") == "document") if name == "lengths" else table, "docid", "left_anti")
            if not lost.isEmpty():
                lost.select(*(row.columns if table is None else table.columns)).write.mode("append").parquet(f"{path}/{name}")
                mended.append(name)
        return mended

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        def table(name: str) -> DataFrame | None:
            try:
                return spark.read.parquet(f"{path}/{name}")
            except Exception as e:  # a part that was not built
                if "PATH_NOT_FOUND" in str(e):
                    return None
                raise

        return Index(*(table(n) for n in TABLES))

    def persist(self) -> Index:
        """Keeps the tables in memory, spilling to disk, for many queries in one session."""
        for name in TABLES:
            t = getattr(self, name)
            if t is not None:
                t.persist()
        return self

    def with_fields(self, fields: DataFrame) -> Index:
        return replace(self, fields=fields)


def tokenized(documents: DataFrame, docid: str = "doc_id", text: str = "text", name: str | None = None, tokens: Column | None = None) -> DataFrame:
    """(docid, name, tokens): input of the builders. Rows with a null id are dropped."""
    t = tokens if tokens is not None else simple_tokens(F.col(text))
    n = F.col(name) if name else F.concat(F.lit("DOC"), F.col(docid).cast("string"))
    return documents.where(F.col(docid).isNotNull()).select(F.col(docid).cast("bigint").alias("docid"), n.alias("name"), t.alias("tokens"))


#: Inputs of up to so many bytes (as the optimizer estimates them) are spread before they are indexed.
SPREAD_BYTES = 1 << 30


def _estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def build_from(documents: DataFrame, docid: str = "doc_id", text: str = "text", name: str | None = None, tokens: Callable[[Column], Column] = simple_tokens) -> Index:
    """Index of texts. Each text is tokenized where it lies. A small input, which may be a single
    row group, is spread by id first (raw texts, less than tokens would be), so that all cores
    work; a large one is in many row groups already and is not moved at all."""
    raw = documents.where(F.col(docid).isNotNull()).select(F.col(docid).cast("bigint").alias("docid"), F.col(text).alias("text"))
    if _estimated_bytes(raw) <= SPREAD_BYTES:
        raw = raw.repartition("docid")
    i = build(tokenized(documents, docid, text, name, tokens(F.col(text))), placed=raw.select("docid", tokens(F.col("text")).alias("tokens")))
    if tokens is simple_tokens:  # lengths need no array of tokens
        own = documents.where(F.col(docid).isNotNull())
        i.lengths = own.select(F.lit("document").alias("field"), F.col(docid).cast("bigint").alias("docid"), simple_token_count(F.col(text)).alias("length"))
    return i


def build(documents: DataFrame, part: str = "postings", field: str = "document", placed: DataFrame | None = None) -> Index:
    """Index of ``tokenized`` documents. Null tokens keep their positions but have no postings;
    lengths count them. Document ids are unique.

    A document's tokens are in one row, so its postings are made where it lies, batch by batch on
    columns of tokens: no exchange, no row per token. ``placed`` is the same documents, if they
    are better spread for that work.
    """
    placed = documents if placed is None else placed
    postings = _postings(placed.select("docid", "tokens"))
    return Index(
        postings.select(F.lit(part).alias("part"), "term", "docid", "tf", "positions", "length"),
        documents.select(F.lit(field).alias("field"), "docid", F.size("tokens").alias("length")),
        documents.select("docid", "name"),
    )


#: Documents whose tokens are sorted at once.
_STEP = 1024


def _postings(documents: DataFrame) -> DataFrame:
    """(docid, term, tf, positions, length) of documents(docid, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _STEP):
                b = whole.slice(start, _STEP)
                column = b.column(1)
                size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
                row = np.repeat(np.arange(len(size)), size)
                at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                words = column.flatten().dictionary_encode()
                code = np.asarray(words.indices.fill_null(-1)).astype(np.int64)
                kept = np.flatnonzero(code >= 0)  # null tokens have a place, but no posting
                key = row[kept] * max(1, len(words.dictionary)) + code[kept]
                o = np.argsort(key, kind="stable")
                key, kept = key[o], kept[o]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
                ends = np.append(first, len(key))
                own = kept[first]
                positions = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[kept].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row[own])), words.dictionary.take(pa.array(code[own])), pa.array(np.diff(ends)), positions, pa.array(size[row[own]].astype(np.int32))],
                    names=["docid", "term", "tf", "positions", "length"],
                )

    return arrow_map(documents, run, "docid bigint, term string, tf bigint, positions array<int>, length int")


def count_postings(documents: DataFrame) -> DataFrame:
    """(term, docid, tf) without positions: the positions column is never built."""
    t = documents.repartition("docid").select("docid", F.explode("tokens").alias("term")).where(F.col("term").isNotNull())
    return t.groupBy("docid", "term").agg(F.count("*").alias("tf")).select("term", "docid", "tf")


def tag_extents(documents: DataFrame, docid: str = "doc_id", tags: str = "tags") -> DataFrame:
    """(name, docid, begin, end) of tags with at least one token, names lower-cased; tags that
    lack a name or an end are dropped, repeated ones count once."""
    t = documents.select(F.col(docid).cast("bigint").alias("docid"), F.explode(tags).alias("t"))
    t = t.select(F.lower(F.col("t.name")).alias("name"), "docid", F.col("t.tok_begin").alias("begin"), F.col("t.tok_end").alias("end"))
    return t.where("name is not null and docid is not null and end > begin").distinct()


def conflate(extents: DataFrame, names: dict[str, str]) -> DataFrame:
    """Extents with several tag names brought under one."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    return extents if m is None else extents.withColumn("name", F.coalesce(m[F.col("name")], F.col("name"))).distinct()


def field_postings(index: Index, name: str, part: str = "postings") -> DataFrame:
    """Postings of the terms inside one field, as part ``field.<name>``."""
    e = index.extents.where(F.col("name") == name).groupBy("docid").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    p = index.postings.where(F.col("part") == part).join(e, "docid")
    kept = F.filter("positions", lambda x: F.exists("spans", lambda s: (s["begin"] <= x) & (x < s["end"])))
    p = p.select(F.lit(f"field.{name}").alias("part"), "term", "docid", kept.alias("positions"), "length").where(F.size("positions") > 0)
    return p.select("part", "term", "docid", F.size("positions").cast("bigint").alias("tf"), "positions", "length")


def field_lengths(index: Index, name: str) -> DataFrame:
    """(field, docid, length): tokens in the extents of a field, 0 for documents without."""
    e = index.extents.where(F.col("name") == name).groupBy("docid").agg(F.sum(F.col("end") - F.col("begin")).alias("n"))
    d = index.lengths.where(F.col("field") == "document").select("docid")
    return d.join(e, "docid", "left").select(F.lit(name).alias("field"), "docid", F.coalesce("n", F.lit(0)).cast("int").alias("length"))


def typed_fields(documents: DataFrame, columns: dict[str, str], docid: str = "doc_id") -> DataFrame:
    """(field, docid, v_string, v_long, v_double, v_timestamp) of columns, by format; values
    that don't fit the format, and nulls, have no row."""
    parts = []
    for c, fmt in columns.items():
        v = {"v_string": F.col(c).cast("string"), "v_long": F.expr(f"try_cast(`{c}` as bigint)"), "v_double": F.expr(f"try_cast(`{c}` as double)"), "v_timestamp": F.expr(f"try_cast(`{c}` as timestamp)")}
        own = FORMATS[fmt]
        none = {"v_string": "string", "v_long": "bigint", "v_double": "double", "v_timestamp": "timestamp"}
        cols = [(v[n] if n == own else F.lit(None).cast(k)).alias(n) for n, k in none.items()]
        parts.append(documents.select(F.lit(c).alias("field"), F.col(docid).cast("bigint").alias("docid"), *cols).where(F.col(own).isNotNull()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge(parts: list[Index], renumber: bool = False) -> Index:
    """One index of several over disjoint documents. With ``renumber`` the ids of each are moved
    past the highest of those before it (one row of statistics each goes to the driver)."""
    if renumber:
        moved, base = [], 0
        for p in parts:
            top = p.lengths.agg(F.max("docid")).first()[0]
            shift = lambda df, by=base: None if df is None else df.withColumn("docid", F.col("docid") + by)
            moved.append(Index(*(shift(getattr(p, t)) for t in TABLES)))
            base += (top if top is not None else -1) + 1
        parts = moved

    def union(name: str) -> DataFrame | None:
        have = [getattr(p, name) for p in parts if getattr(p, name) is not None]
        out = have[0] if have else None
        for h in have[1:]:
            out = out.unionByName(h)
        return out

    return Index(*(union(t) for t in TABLES))


def dense_ids(documents: DataFrame, key: str) -> DataFrame:
    """``documents`` with a dense ``docid`` from 0 in order of ``key``.

    Sorted by range; each partition numbers its own rows and adds the sizes of the partitions
    before it, so no window over all rows is needed. Rows with equal keys get ids in no fixed
    order.
    """
    from scriptorium.session import durable

    ordered = durable(documents.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col("_at"), 33)
    sizes = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).count().withColumnRenamed("count", "n").collect())
    offsets, at = {}, 0
    for p, n in sizes:
        offsets[p] = at
        at += n
    base = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]) if offsets else F.create_map(F.lit(0), F.lit(0))
    return ordered.withColumn("docid", (base[part] + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")).drop("_at")
