"""Queries of ranking evaluation, over the collected answers and judgments."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import evaluation as E
from scriptorium.queries.registry import query
from scriptorium.session import load

METRICS = ["num_ret", "num_rel", "num_rel_ret", "ap", "p", "p_classic", "recall", "rprec", "rprec_classic", "rr", "ndcg", "ndcg_k", "err_k", "bpref", "bpref_lite", "unjudged_k", "unjudged_share_k", "jap", "uap"]

_BASE = """
WITH qr AS (SELECT qid, docno, max(grade) AS grade FROM qrels WHERE qid IS NOT NULL AND docno IS NOT NULL AND grade IS NOT NULL GROUP BY qid, docno),
sc AS (SELECT qid, 'DOC' || document AS docno, max(score + 0.0) AS score FROM scored_documents WHERE qid IS NOT NULL AND document >= 0 AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
run AS (SELECT qid, docno, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) AS rank FROM sc),
gq AS (SELECT *, (pow(2.0, greatest(grade, 0)) - 1) / ln(row_number() OVER (PARTITION BY qid ORDER BY grade DESC, docno) + 1.0) AS gain, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, docno) AS i FROM qr),
per AS (SELECT qid, count(*) FILTER (WHERE grade > 0) AS r, count(*) FILTER (WHERE grade <= 0) AS nn, sum(gain) AS ideal, coalesce(sum(gain) FILTER (WHERE i <= 10), 0) AS ideal_k FROM gq GROUP BY qid),
j0 AS (SELECT run.qid, run.docno, rank, grade, r, nn, ideal, ideal_k, CAST(coalesce(grade, 0) > 0 AS INT) AS rel, CAST(coalesce(grade <= 0, false) AS INT) AS non, CAST(grade IS NOT NULL AS INT) AS judged,
   (pow(2.0, greatest(coalesce(grade, 0), 0)) - 1) / 16.0 AS stop FROM run LEFT JOIN qr USING (qid, docno) JOIN per USING (qid)),
j AS (SELECT *, sum(rel) OVER w AS hits, coalesce(sum(non) OVER b, 0) AS non_b, coalesce(sum(1 - rel) OVER b, 0) AS unrel_b, sum(judged) OVER w AS jrank,
   CASE WHEN rank <= 10 AND judged = 0 THEN 1 ELSE rel END AS urel, exp(coalesce(sum(ln(1 - stop)) OVER b, 0)) AS go, sum(non) OVER (PARTITION BY qid) AS non_ret FROM j0
   WINDOW w AS (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j2 AS (SELECT *, sum(urel) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS uhits FROM j),
g AS (SELECT qid, r, ideal, ideal_k, count(*) AS n, sum(rel) AS k, sum(hits * 1.0 / rank) FILTER (WHERE rel = 1) AS ap, coalesce(sum(rel) FILTER (WHERE rank <= 10), 0) AS hk,
   coalesce(sum(rel) FILTER (WHERE rank <= r), 0) AS hr, min(rank) FILTER (WHERE rel = 1) AS first, sum((pow(2.0, greatest(coalesce(grade, 0), 0)) - 1) / ln(rank + 1.0)) AS dcg,
   coalesce(sum((pow(2.0, greatest(coalesce(grade, 0), 0)) - 1) / ln(rank + 1.0)) FILTER (WHERE rank <= 10), 0) AS dcg_k, sum(go * stop / rank) FILTER (WHERE rank <= 10) AS err,
   sum(CASE WHEN least(r, non_ret) = 0 THEN 1.0 WHEN non_b >= least(r, non_ret) THEN 0.0 ELSE 1.0 - non_b * 1.0 / least(r, nn) END) FILTER (WHERE rel = 1) AS bp,
   sum(1.0 - least(unrel_b, r) * 1.0 / r) FILTER (WHERE rel = 1) AS bpl, coalesce(sum(1 - judged) FILTER (WHERE rank <= 10), 0) AS unj,
   sum(hits * 1.0 / jrank) FILTER (WHERE rel = 1) AS jap, sum(uhits * 1.0 / rank) FILTER (WHERE urel = 1) AS uap, sum(urel) AS urel FROM j2 GROUP BY qid, r, ideal, ideal_k),
m AS (SELECT qid, n AS num_ret, r AS num_rel, CAST(k AS BIGINT) AS num_rel_ret, CASE WHEN r > 0 THEN coalesce(ap, 0) / r ELSE 0 END AS ap, hk / 10.0 AS p, hk * 1.0 / least(10, n) AS p_classic, CASE WHEN r > 0 THEN k * 1.0 / r ELSE 0 END AS recall,
   CASE WHEN r > 0 THEN hr * 1.0 / r ELSE 0 END AS rprec, CASE WHEN n < r OR r = 0 THEN 0 ELSE hr * 1.0 / r END AS rprec_classic, coalesce(1.0 / first, 0) AS rr, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END AS ndcg,
   CASE WHEN ideal_k > 0 THEN dcg_k / ideal_k ELSE 0 END AS ndcg_k, coalesce(err, 0) AS err_k, CASE WHEN r > 0 THEN coalesce(bp, 0) / r ELSE 0 END AS bpref, CASE WHEN r > 0 THEN coalesce(bpl, 0) / r ELSE 0 END AS bpref_lite,
   CAST(unj AS BIGINT) AS unjudged_k, unj * 1.0 / least(10, n) AS unjudged_share_k, CASE WHEN r > 0 THEN coalesce(jap, 0) / r ELSE 0 END AS jap, CASE WHEN r + urel - k > 0 THEN coalesce(uap, 0) / (r + urel - k) ELSE 0 END AS uap FROM g)"""
_INT = ("num_ret", "num_rel", "num_rel_ret", "unjudged_k")


def run_and_judgments(spark, d):
    s = load(spark, d, "scored_documents")
    s = s.where(F.col("qid").isNotNull() & (F.col("document") >= 0) & F.col("score").isNotNull() & ~F.isnan("score"))
    run = E.ranked(s.select("qid", F.concat(F.lit("DOC"), F.col("document").cast("string")).alias("docno"), (F.col("score") + F.lit(0.0)).alias("score")))
    return run, E.judgments(load(spark, d, "qrels"))


@query("eval_per_query", _BASE + " SELECT qid, " + ", ".join(m if m in _INT else f"round(CAST({m} AS DOUBLE), 6) AS {m}" for m in METRICS) + " FROM m")
def eval_per_query(spark, d):
    x = E.evaluate(*run_and_judgments(spark, d), k=10)
    return x.select("qid", *[m if m in _INT else F.round(m, 6).alias(m) for m in METRICS])


_MEANS = [m for m in METRICS if m not in _INT]


@query("eval_mean", _BASE + " SELECT " + ", ".join(f"round(avg(CAST({m} AS DOUBLE)), 5) AS {m}" for m in _MEANS) + " FROM m")
def eval_mean(spark, d):
    x = E.aggregate(E.evaluate(*run_and_judgments(spark, d), k=10), _MEANS)
    return x.select(*[F.round(m, 5).alias(m) for m in _MEANS])


@query("eval_gmap", _BASE + " SELECT round(exp(avg(ln(greatest(CAST(ap AS DOUBLE), 1e-5)))), 5) AS ap FROM m")
def eval_gmap(spark, d):
    return E.aggregate(E.evaluate(*run_and_judgments(spark, d), k=10), ["ap"], "gm").select(F.round("ap", 5).alias("ap"))


@query(
    "eval_mdfa",
    _BASE
    + """, x AS (SELECT qid, rank, hits, r, (rank - hits) * 1.0 / ((SELECT count(DISTINCT docid) FROM lengths) - r) AS fa FROM j WHERE r > 0),
y AS (SELECT qid, r, min(rank) FILTER (WHERE fa > 0.0002) AS at, max(hits) AS top FROM x GROUP BY qid, r)
SELECT y.qid, round(1.0 - coalesce(x.hits, y.top) * 1.0 / y.r, 6) AS mdfa FROM y LEFT JOIN x ON x.qid = y.qid AND x.rank = y.at""",
)
def eval_mdfa(spark, d):
    """With the real size of the collection, the distinct records of ``lengths``."""
    n = load(spark, d, "lengths").agg(F.count_distinct("docid")).first()[0]
    x = E.miss_at_false_alarm(*run_and_judgments(spark, d), documents=n, threshold=0.0002)
    return x.select("qid", F.round("mdfa", 6).alias("mdfa"))
