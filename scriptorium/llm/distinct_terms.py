"""How distinctive a term is for a record.

Collection statistics come from one pass: every batch adds up its own term counts before they
are shuffled by term. Scores need a term's statistics at each of its records. Terms found in at
least ``FREQUENT`` of all records are few, whatever the size of the collection (a record has a
bounded mean number of terms, so at most mean / FREQUENT of them exist); they are sent to every
worker if that bound proves small enough. Pairs of the other, rare terms are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import arrow_map, durable

#: Share of all records from which a term counts as frequent.
FREQUENT = 0.002
#: Most frequent terms sent to every worker; with more, all pairs go through the join.
BROADCAST_TERMS = 400_000
#: Parts of a frequent term's pairs where they are joined by a shuffle.
SALTS = 32


def _normal(terms: str):
    t = F.transform(F.coalesce(F.col(terms), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.filter(t, lambda x: x.isNotNull() & (x != ""))


def _bags(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row numbers, terms and counts of the distinct (row, term) pairs of a list column."""
    parent = column.value_parent_indices() if hasattr(column, "value_parent_indices") else pa.compute.list_parent_indices(column)
    t = pa.table({"row": parent, "term": column.flatten()}).group_by(["row", "term"]).aggregate([([], "count_all")])
    t = t.combine_chunks()
    one = lambda c: t.column(c).chunk(0) if t.num_rows else pa.array([], t.schema.field(c).type)
    return np.asarray(one("row")), one("term"), np.asarray(one("count_all"))


def statistics(records: DataFrame, terms: str = "terms") -> DataFrame:
    """(term, document_count, collection_count) over all records.

    Terms are trimmed of spaces and lower-cased; null and empty ones are dropped first. Null and
    empty term lists add nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, term, count = _bags(b.column(0))
            t = pa.table({"term": term, "n": count}).group_by("term").aggregate([([], "count_all"), ("n", "sum")]).combine_chunks()
            for x in t.select(["term", "count_all", "n_sum"]).to_batches():
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1).cast(pa.int64()), x.column(2).cast(pa.int64())], names=["term", "document_count", "collection_count"])

    part = arrow_map(records.select(_normal(terms).alias("terms")), run, "term string, document_count bigint, collection_count bigint")
    return part.groupBy("term").agg(F.sum("document_count").alias("document_count"), F.sum("collection_count").alias("collection_count"))


def record_count(records: DataFrame, terms: str = "terms") -> int:
    """Records that have any term."""
    return records.where(F.size(_normal(terms)) > 0).count()


def weight(kind: str, n_records: int):
    """Column over tf, document_count, collection_count, rounded to six decimals.

    ``tf_idf``: tf x ln(N / n). ``residual_idf``: log2(N / n) less the value expected if the
    term's occurrences fell on records by chance, -log2(1 - exp(-cf / N)), times n. It is the same
    in all records that have the term.
    """
    if kind == "tf_idf":
        return F.round(F.col("tf") * weight_raw(kind, n_records), 6)
    if kind == "residual_idf":
        return F.round(weight_raw(kind, n_records), 6)
    raise ValueError(f"unknown weight {kind}")


def most_distinctive(records: DataFrame, top: int = 3, least_terms: int = 20, kind: str = "tf_idf", record: str = "doc_id", terms: str = "terms") -> DataFrame:
    """(record, term, weight): the ``top`` terms of each record with at least ``least_terms``.

    Highest weight first, equal weights by term in code point order. A record with fewer distinct
    terms gives those it has; shorter, null and empty lists give none. Record ids are unique.
    """
    spark = records.sparkSession
    stats = durable(statistics(records, terms), "term-stats")
    n = record_count(records, terms)
    least = max(FREQUENT * n, 2.0)
    common = stats.where(F.col("document_count") >= least)
    size = common.count()
    bags = records.select(F.col(record).alias("rec"), _normal(terms).alias("terms")).where(F.size("terms") >= least_terms)
    kind_of = records.schema[record].dataType.simpleString()
    known = None
    if size <= BROADCAST_TERMS:
        c = common.withColumn("tf", F.lit(1)).select("term", weight_raw(kind, n).alias("w")).toArrow()
        known = spark.sparkContext.broadcast((c.column("term").to_pylist(), np.asarray(c.column("w"), dtype=np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit = known.value if known else ([], np.zeros(0))
        index = pa.array(names, pa.string())
        for b in batches:
            row, term, tf = _bags(b.column(1))
            at = pa.compute.index_in(term, index)
            rare = np.asarray(at.is_null())
            at = np.asarray(at.fill_null(0))
            w = np.zeros(len(row))
            if len(names):
                w[~rare] = (tf[~rare] if kind == "tf_idf" else 1.0) * unit[at[~rare]]
            keep = rare.copy()
            # of the frequent terms of a record only its best can be among its best of all; a
            # small margin keeps ties that rounding makes, which the last step orders
            f = np.flatnonzero(~rare)
            if len(f):
                o = f[np.lexsort((-w[f], row[f]))]
                r = row[o]
                first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                rank = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
                bound = np.full(b.num_rows, -np.inf)
                at_top = rank == top - 1
                bound[r[at_top]] = w[o[at_top]]
                keep[o[w[o] >= bound[r] - 2e-6]] = True
            k = pa.array(np.flatnonzero(keep))
            rows = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), term.take(k), pa.array(tf[keep], pa.int64()), pa.array(rare[keep])], names=["rec", "term", "tf", "rare"])

    pairs = arrow_map(bags, run, f"rec {kind_of}, term string, tf bigint, rare boolean")
    # one join gives every remaining pair its statistics: the few kept frequent ones and the rare
    joined = pairs.join(stats, "term") if known else _with_statistics(pairs, stats, common)
    scored = joined.select("rec", "term", weight(kind, n).alias("weight"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("term").alias("term")))), 1, top)
    out = scored.groupBy("rec").agg(best.alias("best")).select("rec", F.explode("best").alias("b"))
    return out.select(F.col("rec").alias(record), F.col("b.term").alias("term"), (F.lit(0.0) - F.col("b.w")).alias("weight"))


def weight_raw(kind: str, n_records: int):
    """The weight of one occurrence (``residual_idf``: of any number), not rounded."""
    n = float(max(n_records, 1))
    if kind == "tf_idf":
        return F.ln(F.lit(n) / F.col("document_count"))
    return F.col("document_count") * (F.log2(F.lit(n) / F.col("document_count")) + F.log2(1.0 - F.exp(-F.col("collection_count") / n)))


def residual_idf(records: DataFrame, record: str = "doc_id", terms: str = "terms") -> DataFrame:
    """(term, document_count, collection_count, weight): residual inverse document frequency of
    each term times its record frequency, rounded to four decimals: high where occurrences are
    concentrated in few records, about zero for terms spread by chance."""
    n = record_count(records, terms)
    return statistics(records, terms).select("term", "document_count", "collection_count", F.round(weight_raw("residual_idf", n), 4).alias("weight"))


def record_weights(records: DataFrame, kind: str = "residual_idf", record: str = "doc_id", terms: str = "terms") -> DataFrame:
    """(record, term, weight): how distinctive each distinct term of each record is.

    Weights of frequent terms are sent to every worker if they are few; else all pairs are joined,
    those of frequent terms in salted parts. Null and empty lists give no row.
    """
    stats = durable(statistics(records, terms), "term-stats")
    n = record_count(records, terms)
    common = stats.where(F.col("document_count") >= max(FREQUENT * n, 2.0))
    kind_of = records.schema[record].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, term, tf = _bags(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), term, pa.array(tf, pa.int64())], names=["rec", "term", "tf"])

    pairs = arrow_map(records.select(F.col(record).alias("rec"), _normal(terms).alias("terms")), run, f"rec {kind_of}, term string, tf bigint")
    scored = _with_statistics(pairs, stats, common).select("rec", "term", weight(kind, n).alias("weight"))
    return scored.select(F.col("rec").alias(record), "term", "weight")


def _with_statistics(pairs: DataFrame, stats: DataFrame, common: DataFrame) -> DataFrame:
    """``pairs`` (rec, term, ...) joined with ``stats``, though a few terms hold most pairs."""
    if common.count() <= BROADCAST_TERMS:
        c = F.broadcast(common.select("term", F.col("document_count").alias("dc"), F.col("collection_count").alias("cc")))
        known = pairs.join(c, "term", "left")
        near = known.where("dc is not null").withColumnsRenamed({"dc": "document_count", "cc": "collection_count"})
        return near.unionByName(known.where("dc is null").drop("dc", "cc").join(stats, "term"))
    salted = stats.join(common.select("term", F.lit(True).alias("hot")), "term", "left")
    salted = salted.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1))))).drop("hot")
    # each pair looks in its own part and in the one for terms that are not divided
    both = pairs.withColumn("salt", F.explode(F.array(F.lit(-1), F.pmod(F.xxhash64("rec"), F.lit(SALTS)).cast("int"))))
    return both.join(salted, ["term", "salt"]).drop("salt")
