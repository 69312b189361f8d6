"""Queries of incremental indexing, tokenizers, stemmers, snippets and formats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scriptorium.functions import snippets, stemmers, tagtok
from scriptorium.operators.ngrams import conflation
from scriptorium.queries.common import engine, rounded
from scriptorium.queries.registry import TOKENS, query
from scriptorium.session import load, shared_folder
from scriptorium.sources import readers, writers
from scriptorium.streaming.incremental import GrowingIndex


def _folder(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query("stream_index", f"WITH {TOKENS} SELECT term, CAST(cf AS BIGINT) AS cf, df, max_tf FROM stat")
def stream_index(spark, d):
    """The whole table as a stream of micro-batches into a growing index."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    source = _folder(spark, "stream")
    docs.repartition(5, "doc_id").write.parquet(source)
    g = GrowingIndex(spark, _folder(spark, "growing"), radix=2)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    g.start(stream).awaitTermination()
    return g.index().term_stats().select("term", "cf", "df", "max_tf")


_BLANKS = r"[ \t\n\x0B\f\r]+"


@query("trec_round_trip", f"SELECT name, regexp_replace(coalesce(text, ''), '{_BLANKS}', '', 'g') AS text FROM documents WHERE name IS NOT NULL")
def trec_round_trip(spark, d):
    """Texts written as news blocks and read again; white space at their ends may change."""
    path = _folder(spark, "trec")
    writers.trec_text(load(spark, d, "documents"), path)
    x = readers.trec_text(spark, path)
    return x.select("name", F.regexp_replace("text", rf"(?i)^\s*<TEXT>|</TEXT>\s*$|{_BLANKS}", "").alias("text"))


@query("run_round_trip", "SELECT qid, 'DOC' || document AS docno, CAST(max(score + 0.0) AS DOUBLE) AS score FROM scored_documents WHERE qid IS NOT NULL AND document >= 0 AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL")
def run_round_trip(spark, d):
    s = load(spark, d, "scored_documents").where((F.col("document") >= 0) & F.col("qid").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    s = s.groupBy("qid", F.concat(F.lit("DOC"), F.col("document").cast("string")).alias("docno")).agg(F.max("score").alias("score"))
    path = _folder(spark, "run")
    writers.run(s.withColumn("rank", F.lit(1)), path)
    return writers.read_run(spark, path).select("qid", "docno", (F.col("score") + F.lit(0.0)).alias("score"))


@query("stemmed_stats")
def stemmed_stats(spark, d):
    p = stemmers.stemmed_postings(engine(spark, d).index.postings)
    return p.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


@query("stem_conflation")
def stem_conflation(spark, d):
    v = engine(spark, d).index.vocabulary()
    return conflation(v, stemmers.stems(v)).where(F.size("terms") > 1).select("stem", F.array_join("terms", " ").alias("terms"))


@query("tagged_terms")
def tagged_terms(spark, d):
    t = tagtok.tokenized(load(spark, d, "documents"), ("h[1-6]", "a", "title"))
    return t.select("docid", F.size("terms").alias("terms"), F.size("tags").alias("tags"))


@query("snippets_topk")
def snippets_topk(spark, d):
    top = engine(spark, d).search("harvest market", 10).select("docid", "rank")
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("docid"), "text")
    r = docs.join(F.broadcast(top), "docid")  # ten rows
    return rounded(snippets.snippets(r, ["harvest", "market"]), "snippet_score")
