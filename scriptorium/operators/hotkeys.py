"""Per-key results when a few keys hold most records.

Keys are counted first. Keys with few rows are sorted by key and value as usual. For the others
(at most rows / limit of them, which bounds the table of brackets) ranks are found by distributed
selection: each wanted rank has a bracket of values; a pass over the rows counts, with partial
sums before the shuffle, how many fall into each slice of it; the slice that holds the rank is
the next bracket. A few passes narrow it to one value. Values of a hot key are never brought
together, and every task sees an even part of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import durable, release

#: Slices of a bracket in one pass.
SLICES = 1024
#: Rows from which a key counts as hot.
HOT_ROWS = 10_000
#: Most brackets, and most hot keys, sent to every worker; with more they are joined by a shuffle.
BROADCAST_BRACKETS = 1_000_000


def _few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows are counted as few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_BRACKETS else df


def hot_keys(rows: DataFrame, key: str, least: int) -> DataFrame:
    """(key, n): keys with at least ``least`` rows. Null keys are left out."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def select_ranks(values: DataFrame, targets: DataFrame, key: str, value: str, weight: str | None = None) -> DataFrame:
    """(key, rank, value): the value at each wanted rank (from 1, ascending) of a key's values.

    ``values`` must be cheap to read again (written or persisted); ``value`` is an integer.
    ``targets(key, rank)`` is small: a bounded number of keys, some ranks each. Ranks beyond a
    key's rows have no row. ``weight`` counts a row several times. Exact. Nulls are left out.
    """
    v = values.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, F.col(value).cast("bigint").alias("v"), (F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")).alias("w"))
    ends = v.join(_few(targets.select(key).distinct()), key, "left_semi").groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("n"))
    state = targets.join(ends, key).where(F.col("rank").between(1, F.col("n")))
    state = state.select(key, F.col("rank").cast("bigint").alias("rank"), "lo", "hi", F.col("rank").cast("bigint").alias("left"))
    state = durable(state, "brackets")
    for _ in range(8):  # 1024^7 exceeds 64 bits
        open_ = state.where("lo < hi")
        n = open_.count()
        if not n:
            break
        # decimals hold the span, which may exceed a signed 64-bit number; div is exact
        b = open_.withColumn("width", F.expr(f"(cast(hi as decimal(20,0)) - cast(lo as decimal(20,0))) div {SLICES} + 1"))
        j = v.join(F.broadcast(b) if n <= BROADCAST_BRACKETS else b, key).where(F.col("v").between(F.col("lo"), F.col("hi")))
        at = F.expr("cast((cast(v as decimal(20,0)) - cast(lo as decimal(20,0))) div width as int)")
        counts = j.groupBy(key, "rank", "lo", "hi", "left", "width", at.alias("at")).agg(F.sum("w").alias("c"))
        upto = F.sum("c").over(Window.partitionBy(key, "rank").orderBy("at"))
        hit = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("c") < F.col("left")))
        new = hit.select(
            key,
            "rank",
            F.expr("cast(cast(lo as decimal(20,0)) + cast(at as decimal(10,0)) * cast(width as decimal(20,0)) as bigint) as lo"),
            F.expr("cast(least(cast(hi as decimal(31,0)), cast(lo as decimal(20,0)) + cast(at + 1 as decimal(10,0)) * cast(width as decimal(20,0)) - 1) as bigint) as hi"),
            (F.col("left") - (F.col("upto") - F.col("c"))).alias("left"),
        )
        old, state = state, durable(state.where("lo = hi").unionByName(new), "brackets")
        release(old)
    return state.select(key, "rank", F.col("lo").alias(value))


def quantiles(rows: DataFrame, key: str, value: str, probabilities: list[float], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, p, value): the value at rank ceil(p n) of each key's n values (p 0: the least).

    Null keys and values are left out; repeated rows count each time; ties are one value. Exact
    for every key, however its rows are distributed.
    """
    base = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, F.col(value).cast("bigint").alias(value))
    counts = durable(base.groupBy(key, value).agg(F.count("*").alias("c")), "values")  # doubles meet before sorting
    per_key = counts.groupBy(key).agg(F.sum("c").alias("n"), F.count("*").alias("distinct"))
    hot = durable(per_key.where(F.col("distinct") >= hot_rows).select(key, "n"), "hot")
    p = F.explode(F.array(*[F.lit(float(x)) for x in probabilities])).alias("p")
    wanted = hot.select(key, "n", p).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * F.col("n"), 9))).cast("bigint"))
    found = select_ranks(counts, wanted.select(key, "rank").distinct(), key, value, "c")
    far = wanted.join(found, [key, "rank"]).select(key, "p", value)
    cold = counts.join(_few(hot.select(key)), key, "left_anti")
    w = Window.partitionBy(key).orderBy(value)
    upto = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("c").over(Window.partitionBy(key))
    c = cold.withColumn("upto", upto).withColumn("n", total)
    near = c.select(key, value, "upto", "c", "n", p).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * F.col("n"), 9))))
    near = near.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank"))).select(key, "p", value)
    return near.unionByName(far)


def heaviest_record(postings: DataFrame, share: float = 0.02, term: str = "term", record: str = "docid", positions: str = "positions") -> DataFrame:
    """(term, record): of each term holding at least ``share`` of all rows, the record with most
    distinct positions over all rows of both; equal numbers by lower record.

    Terms are trimmed of spaces and lower-cased. Rows with a null term count among all rows only;
    null records and positions don't take part; a record without any position has none (zero). At
    most 1 / share terms qualify, whatever the data, so their list is bounded.
    """
    x = postings.select(F.lower(F.trim(F.col(term))).alias("term"), F.col(record).cast("bigint").alias("rec"), F.col(positions).alias("pos"))
    counts = durable(x.groupBy("term").agg(F.count("*").alias("n")), "term-rows")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = [r["term"] for r in counts.where(F.col("term").isNotNull() & (F.col("n") >= share * total)).select("term").collect()]
    mine = x.where(F.col("term").isin(hot) & F.col("rec").isNotNull())
    own = F.array_distinct(F.filter(F.coalesce("pos", F.array().cast("array<int>")), lambda p: p.isNotNull()))
    flat = mine.select("term", "rec", F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(None).cast("int")))).alias("pos"))
    # distinct positions are spread by term, record and position: no key is too large for a task
    sizes = durable(flat.distinct().groupBy("term", "rec").agg(F.count("pos").alias("n")), "positions")
    groups = sizes.groupBy("term").agg(F.count("*").alias("rank"))
    most = select_ranks(sizes, groups, "term", "n").select("term", F.col("n").alias("most"))
    best = sizes.join(F.broadcast(most), "term").where(F.col("n") == F.col("most")).select("term", "rec")
    best = durable(best, "best")
    first = best.select("term").distinct().withColumn("rank", F.lit(1).cast("bigint"))
    return select_ranks(best, first, "term", "rec").select("term", F.col("rec").alias(record))
