"""Documents, runs and judgments as text files of the usual formats, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trec_text(documents: DataFrame, path: str) -> None:
    """``name`` and ``text`` as ``<DOC>`` blocks; null texts are empty."""
    t = F.format_string("<DOC>\n<DOCNO>%s</DOCNO>\n<TEXT>\n%s\n</TEXT>\n</DOC>", F.col("name"), F.coalesce("text", F.lit("")))
    documents.where("name is not null").select(t.alias("value")).write.mode("overwrite").text(path)


def trec_web(documents: DataFrame, path: str) -> None:
    t = F.format_string("<DOC>\n<DOCNO>%s</DOCNO>\n<DOCHDR>\n%s\n</DOCHDR>\n%s\n</DOC>", F.col("name"), F.coalesce(F.col("metadata")["url"], F.lit("")), F.coalesce("text", F.lit("")))
    documents.where("name is not null").select(t.alias("value")).write.mode("overwrite").text(path)


def json_lines(documents: DataFrame, path: str) -> None:
    documents.select(F.to_json(F.struct(F.col("name").alias("id"), F.col("text").alias("contents"))).alias("value")).write.mode("overwrite").text(path)


def corpus(documents: DataFrame, path: str) -> None:
    """Stored collection: Parquet in order of name, so that ranges of names read few files."""
    documents.repartitionByRange("name").sortWithinPartitions("name").write.mode("overwrite").parquet(path)


def run(result: DataFrame, path: str, tag: str = "scriptorium") -> None:
    """(qid, docno, rank, score) as lines ``qid Q0 docno rank score tag``."""
    t = F.concat_ws(" ", "qid", F.lit("Q0"), "docno", F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(tag))
    result.repartitionByRange("qid").sortWithinPartitions("qid", "rank").select(t.alias("value")).write.mode("overwrite").text(path)


def qrels(judged: DataFrame, path: str) -> None:
    t = F.concat_ws(" ", "qid", F.lit("0"), "docno", F.col("grade").cast("string"))
    judged.select(t.alias("value")).write.mode("overwrite").text(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docno, rank, score, tag); lines that don't fit are dropped."""
    p = F.split(F.trim("value"), r"\s+")
    x = spark.read.text(path).select(p.alias("p")).where(F.size("p") >= 6)
    return x.selectExpr("p[0] as qid", "p[2] as docno", "try_cast(p[3] as int) as rank", "try_cast(p[4] as double) as score", "p[5] as tag").where("rank is not null and score is not null")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docno, grade)."""
    p = F.split(F.trim("value"), r"\s+")
    x = spark.read.text(path).select(p.alias("p")).where(F.size("p") >= 4)
    return x.selectExpr("p[0] as qid", "p[2] as docno", "try_cast(p[3] as int) as grade").where("grade is not null")
