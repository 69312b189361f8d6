"""The best N items of every group, by cutting and merging sorted runs.

Every input partition is sorted by group, score and document (Spark's external sort: it spills
sorted runs and merges them) and scanned once: N distinct documents of a group are passed on,
then the scan seeks to the next group. What remains, at most N rows a group and partition, is a
sorted run. The runs go to buckets by group, are merged there in the same order, and scanned in
the same way. A group with a third of all rows thus sends no more than N rows from each
partition, and no group is ever held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import arrow_map


def _scan(n: int, place: bool):
    """Scan of rows (grp, document, score) in order: the first ``n`` distinct documents a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken = None, set()  # carried from batch to batch; never more than n documents
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0)
            ids = np.asarray(b.column(1))
            codes = np.asarray(g.dictionary_encode().indices)
            starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            ends = np.append(starts[1:], len(codes))
            names = g.take(pa.array(starts)).to_pylist()
            keep, places = [], []
            for name, s, e in zip(names, starts.tolist(), ends.tolist(), strict=True):
                if name != group:
                    group, taken = name, set()
                for i in range(s, e):
                    if len(taken) == n:
                        break  # seek: the rest of the group's rows are skipped by position
                    d = ids[i]
                    if d not in taken:
                        taken.add(d)
                        keep.append(i)
                        places.append(len(taken))
            if keep:
                t = b.take(pa.array(keep, pa.int64()))
                last = pa.array(places, pa.int32()) if place else t.column(2)
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), last], names=["grp", "document", "place" if place else "score"])

    return run


def top_n(rows: DataFrame, group: str, document: str, score: str, n: int = 10) -> DataFrame:
    """(group, place, document): places 1..n by score, highest first, ties by lower document.

    Rows with a null group, a null or negative document, or a null or NaN score take no part;
    negative infinity is a score; negative zero equals zero. A document with several rows counts
    once, with its highest score. Repeated rows change nothing; an empty table gives no rows;
    groups with fewer than ``n`` documents give all they have. Other columns are dropped, so
    clashing names cannot matter.
    """
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    x = rows.select(F.col(group).cast("string").alias("grp"), F.col(document).cast("bigint").alias("document"), (F.col(score).cast("double") + F.lit(0.0)).alias("score"))
    x = x.where(F.col("grp").isNotNull() & (F.col("document") >= 0) & F.col("score").isNotNull() & ~F.isnan("score"))
    order = ["grp", F.desc("score"), "document"]
    runs = arrow_map(x.sortWithinPartitions(*order), _scan(n, False), "grp string, document bigint, score double")
    merged = runs.repartition("grp").sortWithinPartitions(*order)
    out = arrow_map(merged, _scan(n, True), "grp string, document bigint, place int")
    return out.select(F.col("grp").cast(kind[group]).alias(group), "place", F.col("document").cast(kind[document]).alias(document))
