"""Mixing sources to target shares of all tokens.

Tokens are added up per source, each source gets a repetition rate (capped), and each document
is then emitted ``floor(rate)`` times plus once more if a seeded hash of its id falls below the
fractional part: every document decides alone, so nothing has to be ordered or gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.encode import count_tokens, encode
from scriptorium.session import durable


def rates(documents: DataFrame, targets: DataFrame, folder: str | None = None, spent: DataFrame | None = None) -> DataFrame:
    """(source, target_share, max_repeats, tokens, total, rate, reachable), one row per target.

    ``rate`` is target_share x all tokens / the source's tokens, at most ``max_repeats``. Null
    sources count in ``total`` only. A source without tokens has rate 0. Sources are compared
    trimmed and lower-cased; null target shares count as 0 and null ``max_repeats`` as 1.
    """
    if spent is None:
        # a few rows, used twice: cut, so that every text is encoded once
        spent = durable(count_tokens(documents, "source", folder=folder), "spent")
    total = spent.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    t = targets.select(
        "source",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"),
        F.lower(F.trim("source")).alias("key"),
    )
    # the targets are the fixed side: one row per source of the mixture
    j = t.join(spent.where(F.col("key").isNotNull()), "key", "left").crossJoin(total)
    tokens = F.coalesce("tokens", F.lit(0))
    want = F.col("target_share") * F.col("total")
    return j.select(
        "source",
        "target_share",
        "max_repeats",
        tokens.alias("tokens"),
        "total",
        F.when(tokens > 0, F.least(want / tokens, F.col("max_repeats").cast("double"))).otherwise(0.0).alias("rate"),
        (want <= F.col("max_repeats") * tokens).alias("reachable"),
    )


def short_sources(documents: DataFrame, targets: DataFrame, folder: str | None = None) -> DataFrame:
    """(source): targets whose share of all tokens exceeds what ``max_repeats`` can give."""
    return rates(documents, targets, folder).where(~F.col("reachable")).select("source")


def copies(documents: DataFrame, rate: DataFrame, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, source, copies): how often each document of a target source is emitted.

    ``rate`` has one row per source of the mixture and is broadcast; it is as small as the list
    of targets. Documents of other sources and of none are left out. Repeated rows decide alike.
    """
    small = F.broadcast(rate.select(F.lower(F.trim("source")).alias("key"), F.col("source").alias("target"), "rate"))
    j = documents.select("doc_id", F.lower(F.trim("source")).alias("key"), *(keep or [])).join(small, "key")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    n = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return j.select("doc_id", F.col("target").alias("source"), n.cast("int").alias("copies"), *(keep or []))


def mixture(documents: DataFrame, targets: DataFrame, folder: str | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, copy, n): the mixture itself, one row for each emitted copy of a document,
    counted from 1, with its size in tokens. Documents with no copy have no row."""
    ids = encode(documents.select("doc_id", "source", "text"), folder=folder, keep=["source"])
    sized = durable(ids.select("doc_id", "source", F.size("ids").alias("n")), "sizes")
    spent = sized.groupBy(F.lower(F.trim("source")).alias("key")).agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    c = copies(sized, rates(documents, targets, folder, spent), seed, keep=["n"]).where("copies > 0")
    return c.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "n")


def reached(documents: DataFrame, targets: DataFrame, folder: str | None = None, seed: int = 17) -> DataFrame:
    """(source, target_share, rate, docs, emitted_docs, emitted_tokens, actual_share).

    Every text is encoded once; the sizes are written and serve both the rates and the sums.
    """
    ids = encode(documents.select("doc_id", "source", "text"), folder=folder, keep=["source"])
    sized = durable(ids.select("doc_id", "source", F.size("ids").alias("n")), "sizes")
    spent = sized.groupBy(F.lower(F.trim("source")).alias("key")).agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    r = rates(documents, targets, folder, spent)
    per = (
        copies(sized, r, seed, keep=["n"])
        .groupBy("source")
        .agg(F.count("*").alias("docs"), F.sum("copies").alias("emitted_docs"), F.sum(F.col("copies") * F.col("n")).alias("emitted_tokens"))
    )
    whole = per.agg(F.sum("emitted_tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        r.select("source", "target_share", "rate")
        .join(per, "source", "left")
        .crossJoin(whole)
        .select("source", "target_share", "rate", zero("docs"), zero("emitted_docs"), zero("emitted_tokens"), F.try_divide(F.coalesce("emitted_tokens", F.lit(0)), F.col("all_tokens")).alias("actual_share"))
    )
