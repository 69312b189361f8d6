"""Side tables of an index from text lines or other collections, and filters of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def values_from_lines(lines: DataFrame, names: DataFrame, part: str, log: bool = False) -> DataFrame:
    """(part, docid, value double) from ``lines(value)`` of a document name and a number; unknown
    names and lines without a number are dropped. ``log`` keeps the logarithm (of positive
    numbers). Serves priors and per-document scores."""
    p = F.split(F.trim("value"), r"\s+")
    x = lines.select(F.get(p, F.lit(0)).alias("name"), F.expr("try_cast(get(split(trim(value), '\\\\s+'), 1) as double)").alias("v")).where("v is not null")
    x = x.where("v > 0").withColumn("v", F.log("v")) if log else x
    return x.join(names.select("docid", "name"), "name").select(F.lit(part).alias("part"), "docid", F.col("v").alias("value"))


def indicators_from_lines(lines: DataFrame, names: DataFrame, part: str) -> DataFrame:
    """(part, docid, value boolean): a name alone is true; a second word says true or false."""
    p = F.split(F.trim("value"), r"\s+")
    flag = F.coalesce(F.expr("try_cast(get(split(trim(value), '\\\\s+'), 1) as boolean)"), F.lit(True))
    x = lines.where(F.trim("value") != "").select(F.get(p, F.lit(0)).alias("name"), flag.alias("v"))
    return x.join(names.select("docid", "name"), "name").select(F.lit(part).alias("part"), "docid", F.col("v").alias("value"))


def only_named(documents: DataFrame, wanted: DataFrame, name: str = "name", keep: bool = True) -> DataFrame:
    """Documents whose name is (not) in ``wanted(name)``; a null name is in no list."""
    w = wanted.select(F.col(name).alias("_name")).where("_name is not null").distinct()
    return documents.join(w, documents[name] == w["_name"], "left_semi" if keep else "left_anti")


def frequent_words(counts: DataFrame, least: int) -> DataFrame:
    """Word counts of at least ``least``, words cleaned: lower-cased, runs of other characters
    than letters and digits at both ends removed, empty ones dropped, equal ones added up."""
    w = F.regexp_replace(F.lower("word"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    x = counts.select(w.alias("word"), "n").where(F.col("word") != "")
    return x.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def background(stats: list[DataFrame]) -> DataFrame:
    """(part, term, cf, df, max_tf) of several collections together."""
    out = stats[0]
    for s in stats[1:]:
        out = out.unionByName(s)
    return out.groupBy("part", "term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"))


def id_ranges(lengths: DataFrame, parts: int) -> DataFrame:
    """(part, first, last, documents): even ranges of document ids, by one pass over the ids."""
    b = lengths.select("docid").distinct().repartitionByRange(parts, "docid").withColumn("part", F.spark_partition_id())
    return b.groupBy("part").agg(F.min("docid").alias("first"), F.max("docid").alias("last"), F.count("*").alias("documents"))
