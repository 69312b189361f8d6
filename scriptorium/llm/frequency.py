"""How often every distinct term occurs, and in how many records.

Pairs of term and record (and position) are spread by range over the partitions and sorted there
(Spark's external sort), then scanned by run length: each change of term or record ends a run.
Equal pairs always meet in one partition, so runs are whole; a term may go on in the next
partition, so the last step adds up at most two counts a partition and term. The range includes
the record, so a term that holds a third of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import arrow_map, partitions_for


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, record, position) in order to (term, records, occurrences)."""
    last: tuple | None = None  # the row before, across batches
    term, records, occurrences = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        enc = b.column(0).dictionary_encode()
        codes, rec, pos = np.asarray(enc.indices), np.asarray(b.column(1)), np.asarray(b.column(2))
        first = (enc.dictionary[int(codes[0])].as_py(), int(rec[0]), int(pos[0]))
        t = np.concatenate(([last is None or last[0] != first[0]], codes[1:] != codes[:-1]))
        r = t | np.concatenate(([last is None or last[1] != first[1]], rec[1:] != rec[:-1]))
        p = r | np.concatenate(([last is None or last[2] != first[2]], pos[1:] != pos[:-1]))
        last = (enc.dictionary[int(codes[-1])].as_py(), int(rec[-1]), int(pos[-1]))
        starts = np.flatnonzero(t)
        if not len(starts) or starts[0] > 0:
            starts = np.concatenate(([0], starts))
        nr = np.add.reduceat(r.astype(np.int64), starts)
        no = np.add.reduceat((p & (pos >= 0)).astype(np.int64), starts)
        names = enc.dictionary.take(pa.array(codes[starts])).to_pylist()
        if term is not None and names[0] == term and not t[0]:
            nr[0] += records
            no[0] += occurrences
        elif term is not None:
            yield _rows([term], [records], [occurrences])
        if len(names) > 1:
            yield _rows(names[:-1], nr[:-1], no[:-1])
        term, records, occurrences = names[-1], int(nr[-1]), int(no[-1])
    if term is not None:
        yield _rows([term], [records], [occurrences])


def _distinct_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["term", "rec", "pos"]).aggregate([])
        yield from t.select(["term", "rec", "pos"]).combine_chunks().to_batches()


def _rows(terms, records, occurrences) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(records, pa.int64()), pa.array(occurrences, pa.int64())], names=["term", "document_count", "collection_count"])


def term_counts(postings: DataFrame, term: str = "term", record: str = "docid", positions: str | None = "positions") -> DataFrame:
    """(term, document_count, collection_count) for every distinct term.

    Terms are trimmed of spaces and lower-cased; null terms and null records are dropped, the
    empty term stays. ``collection_count`` is the number of distinct (record, position): repeated
    rows and overlapping position lists count once, null positions not at all. A record whose
    positions are all null or missing still counts in ``document_count``. With ``positions`` None
    every distinct (term, record) counts one occurrence.
    """
    x = postings.select(F.lower(F.trim(F.col(term))).alias("term"), F.col(record).cast("bigint").alias("rec"), *([F.col(positions).alias("pos")] if positions else []))
    x = x.where(F.col("term").isNotNull() & F.col("rec").isNotNull())
    if positions:
        # -1 keeps a record without positions; doubles within a row go before the shuffle
        own = F.array_distinct(F.filter(F.coalesce("pos", F.array().cast("array<int>")), lambda p: p.isNotNull() & (p >= 0)))
        x = x.select("term", "rec", F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(-1)))).alias("pos"))
    else:
        x = x.withColumn("pos", F.lit(0))
    # equal rows of one batch are dropped before anything moves, however many copies there are
    once = arrow_map(x, _distinct_in_batch, "term string, rec bigint, pos int")
    ordered = once.repartitionByRange(partitions_for(postings.sparkSession), "term", "rec").sortWithinPartitions("term", "rec", "pos")
    part = arrow_map(ordered, _run_lengths, "term string, document_count bigint, collection_count bigint")
    return part.groupBy("term").agg(F.sum("document_count").alias("document_count"), F.sum("collection_count").alias("collection_count"))


def marked(postings: DataFrame, lengths: DataFrame, rare: int = 2, common: float = 0.05) -> DataFrame:
    """(term, mark): terms in at most ``rare`` records, and in more than ``common`` of all
    distinct records of ``lengths``. With few records a term can have both marks; null record
    ids of ``lengths`` don't count; without any, every term is common."""
    counts = term_counts(postings, positions=None)
    total = lengths.agg(F.countDistinct("docid").alias("all_records"))
    x = counts.crossJoin(total)  # one row
    is_rare, is_common = F.col("document_count") <= rare, F.col("document_count") > common * F.col("all_records")
    marks = F.filter(F.array(F.when(is_rare, F.lit("rare")), F.when(is_common, F.lit("common"))), lambda m: m.isNotNull())
    return x.select("term", F.explode(marks).alias("mark"))
