"""Rankings against judgments: metrics per query, aggregates, and tests between two runs."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Highest grade of the cascade model.
MAX_GRADE = 4


def judgments(qrels: DataFrame, qid: str = "qid", docno: str = "docno", grade: str = "grade") -> DataFrame:
    """(qid, docno, grade): one row per judged document, the highest of conflicting grades; null
    ids and grades are dropped. Grades up to 0 mean not relevant."""
    q = qrels.select(F.col(qid).alias("qid"), F.col(docno).alias("docno"), F.col(grade).cast("int").alias("grade")).dropna()
    return q.groupBy("qid", "docno").agg(F.max("grade").alias("grade"))


def ranked(run: DataFrame) -> DataFrame:
    """(qid, docno, rank): ranks made anew from scores, ties by docno; a document counts once."""
    r = run.groupBy("qid", "docno").agg(F.max("score").alias("score"))
    return r.select("qid", "docno", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "docno")).alias("rank"))


def _g(grade):
    return F.pow(F.lit(2.0), F.greatest(grade, F.lit(0)).cast("double")) - 1.0


def evaluate(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row per query that has results and judgments; ``run(qid, docno, rank)``, ``qrels`` as
    from ``judgments``.

    Columns: num_ret, num_rel, num_rel_ret, ap, p (hits in the first k over k), p_classic (over
    min(k, retrieved)), recall (0 without relevant ones), rprec, rprec_classic (0 when fewer than
    R were retrieved), rr, ndcg, ndcg_k, err_k, bpref, bpref_lite (unjudged count as not
    relevant), unjudged_k, unjudged_share_k, jap (judged documents only), uap (unjudged in the
    first k as relevant). Windows run within one query, whose results are a top-k list.
    """
    w = Window.partitionBy("qid").orderBy("rank")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ideal_w = Window.partitionBy("qid").orderBy(F.desc("grade"), "docno")
    i = F.col("i").cast("double")
    gains = qrels.withColumn("i", F.row_number().over(ideal_w)).withColumn("gain", _g(F.col("grade")) / F.log(i + 1.0))
    per = gains.groupBy("qid").agg(
        F.count_if(F.col("grade") > 0).alias("num_rel"),
        F.count_if(F.col("grade") <= 0).alias("num_non"),
        F.sum("gain").alias("ideal"),
        F.coalesce(F.sum(F.when(F.col("i") <= k, F.col("gain"))), F.lit(0.0)).alias("ideal_k"),
    )
    j = run.join(qrels, ["qid", "docno"], "left").join(per, "qid")
    rel = (F.coalesce("grade", F.lit(0)) > 0).cast("int")
    non = (F.col("grade") <= 0).cast("int")
    r = F.col("rank").cast("double")
    stop = _g(F.coalesce("grade", F.lit(0))) / float(2**MAX_GRADE)
    j = (
        j.withColumn("rel", rel)
        .withColumn("non", F.coalesce(non, F.lit(0)))
        .withColumn("judged", F.col("grade").isNotNull().cast("int"))
        .withColumn("hits", F.sum("rel").over(so_far))
        .withColumn("non_before", F.coalesce(F.sum("non").over(before), F.lit(0)))
        .withColumn("unrel_before", F.coalesce(F.sum(1 - F.col("rel")).over(before), F.lit(0)))
        .withColumn("jrank", F.sum("judged").over(so_far))
        .withColumn("urel", F.when((F.col("rank") <= k) & (F.col("judged") == 0), 1).otherwise(F.col("rel")))
        .withColumn("uhits", F.sum("urel").over(so_far))
        .withColumn("stop", stop)
        .withColumn("go", F.exp(F.coalesce(F.sum(F.log1p(-F.col("stop"))).over(before), F.lit(0.0))))
        .withColumn("non_ret", F.sum("non").over(Window.partitionBy("qid")))
    )
    n_rel, n_non = F.col("num_rel"), F.col("num_non")
    listed = F.least(n_rel, F.col("non_ret"))
    share = F.when(listed == 0, 1.0).when(F.col("non_before") >= listed, 0.0).otherwise(1.0 - F.col("non_before") / F.least(n_rel, n_non))
    gain = _g(F.coalesce("grade", F.lit(0))) / F.log(r + 1.0)
    first_k = F.col("rank") <= k
    rows = F.col("num_ret")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    g = j.groupBy("qid", "num_rel", "ideal", "ideal_k").agg(
        F.count("*").alias("num_ret"),
        F.sum("rel").alias("num_rel_ret"),
        F.sum(F.when(F.col("rel") == 1, F.col("hits") / r)).alias("_ap"),
        F.sum(F.when(first_k, F.col("rel"))).alias("_hits_k"),
        F.sum(F.when(F.col("rank") <= F.col("num_rel"), F.col("rel"))).alias("_hits_r"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("_first"),
        F.sum(gain).alias("_dcg"),
        F.sum(F.when(first_k, gain)).alias("_dcg_k"),
        F.sum(F.when(first_k, F.col("go") * F.col("stop") / r)).alias("err_k"),
        F.sum(F.when(F.col("rel") == 1, share)).alias("_bpref"),
        F.sum(F.when(F.col("rel") == 1, 1.0 - F.least(F.col("unrel_before"), n_rel) / n_rel)).alias("_bpref_lite"),
        F.sum(F.when(first_k, 1 - F.col("judged"))).alias("unjudged_k"),
        F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("jrank"))).alias("_jap"),
        F.sum(F.when(F.col("urel") == 1, F.col("uhits") / r)).alias("_uap"),
        F.sum("urel").alias("_urel"),
    )
    by_rel = lambda c: F.when(F.col("num_rel") > 0, zero(c) / F.col("num_rel")).otherwise(0.0)
    return g.select(
        "qid",
        "num_ret",
        "num_rel",
        "num_rel_ret",
        by_rel(F.col("_ap")).alias("ap"),
        (zero(F.col("_hits_k")) / k).alias("p"),
        (zero(F.col("_hits_k")) / F.least(F.lit(k), rows)).alias("p_classic"),
        by_rel(F.col("num_rel_ret")).alias("recall"),
        by_rel(F.col("_hits_r")).alias("rprec"),
        F.when(rows < F.col("num_rel"), 0.0).otherwise(by_rel(F.col("_hits_r"))).alias("rprec_classic"),
        zero(1.0 / F.col("_first")).alias("rr"),
        F.when(F.col("ideal") > 0, F.col("_dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"),
        F.when(F.col("ideal_k") > 0, zero(F.col("_dcg_k")) / F.col("ideal_k")).otherwise(0.0).alias("ndcg_k"),
        zero(F.col("err_k")).alias("err_k"),
        by_rel(F.col("_bpref")).alias("bpref"),
        by_rel(F.col("_bpref_lite")).alias("bpref_lite"),
        F.coalesce("unjudged_k", F.lit(0)).alias("unjudged_k"),
        (F.coalesce("unjudged_k", F.lit(0)) / F.least(F.lit(k), rows)).alias("unjudged_share_k"),
        by_rel(F.col("_jap")).alias("jap"),
        F.when(F.col("num_rel") + F.col("_urel") - F.col("num_rel_ret") > 0, zero(F.col("_uap")) / (F.col("num_rel") + F.col("_urel") - F.col("num_rel_ret"))).otherwise(0.0).alias("uap"),
    )


def miss_at_false_alarm(run: DataFrame, qrels: DataFrame, documents: int, threshold: float) -> DataFrame:
    """(qid, mdfa): share of relevant documents missed where the false-alarm rate first exceeds
    ``threshold``; at the end of the list if it never does."""
    so_far = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    per = qrels.groupBy("qid").agg(F.count_if(F.col("grade") > 0).alias("r")).where("r > 0")
    j = run.join(qrels, ["qid", "docno"], "left").join(per, "qid").withColumn("rel", (F.coalesce("grade", F.lit(0)) > 0).cast("int"))
    j = j.withColumn("hits", F.sum("rel").over(so_far))
    alarm = (F.col("rank") - F.col("hits")) / (F.lit(documents) - F.col("r"))
    g = j.groupBy("qid", "r").agg(F.min(F.when(alarm > threshold, F.struct("rank", "hits"))).alias("at"), F.max("hits").alias("all"))
    return g.select("qid", (1.0 - F.coalesce(F.col("at.hits"), F.col("all")) / F.col("r")).alias("mdfa"))


def aggregate(per_query: DataFrame, metrics: list[str], how: str = "mean") -> DataFrame:
    """One row of means (``mean``), geometric means (``gm``, of values at least 1e-5) or sums."""
    f = {"mean": F.avg, "sum": F.sum, "gm": lambda c: F.exp(F.avg(F.log(F.greatest(c, F.lit(1e-5)))))}[how]
    return per_query.agg(*[f(F.col(m)).alias(m) for m in metrics])


# --- comparisons of two runs; one figure per query, so they are small and local ----------------


def pairs(a: DataFrame, b: DataFrame, metric: str) -> list[tuple[float, float]]:
    """(baseline, treatment) values of the queries both have, in order of query."""
    j = a.select("qid", F.col(metric).alias("a")).join(b.select("qid", F.col(metric).alias("b")), "qid")
    return [(r["a"], r["b"]) for r in j.orderBy("qid").collect()]


def _beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(1e-300, 1.0 - (a + b) * x / (a + 1.0))
    total = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + num * d)
            c = 1.0 + num / c
            total *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * total


def _t_p(t: float, df: float) -> float:
    return _beta(df / 2.0, 0.5, df / (df + t * t))


def t_test(x: list[tuple[float, float]], paired: bool = True) -> float:
    """Two-sided p. ``paired`` False is the two-sample test some tools run under this name."""
    n = len(x)
    if n < 2:
        return 1.0
    if paired:
        d = [b - a for a, b in x]
        m = sum(d) / n
        v = sum((y - m) ** 2 for y in d) / (n - 1)
        return 1.0 if v == 0.0 and m == 0.0 else 0.0 if v == 0.0 else _t_p(m / math.sqrt(v / n), n - 1)
    ma, mb = (sum(y[k] for y in x) / n for k in (0, 1))
    va, vb = (sum((y[k] - m) ** 2 for y in x) / (n - 1) for k, m in ((0, ma), (1, mb)))
    s = (va + vb) / n
    if s == 0.0:
        return 1.0 if ma == mb else 0.0
    df = s * s / ((va / n) ** 2 + (vb / n) ** 2) * (n - 1)
    return _t_p((mb - ma) / math.sqrt(s), df)


def sign_test(x: list[tuple[float, float]], tolerance: float = 1e-7) -> float:
    """Two-sided binomial p; differences up to ``tolerance`` are ties and left out."""
    up, down = sum(b - a > tolerance for a, b in x), sum(a - b > tolerance for a, b in x)
    n = up + down
    if n == 0:
        return 1.0
    tail = sum(math.comb(n, k) for k in range(max(up, down), n + 1)) / 2.0**n
    return min(1.0, 2.0 * tail)


def randomized_test(x: list[tuple[float, float]], rounds: int = 10_000, seed: int = 1) -> float:
    """One-sided p: how often random swaps give at least the observed mean difference."""
    d = [b - a for a, b in x]
    rng, seen = random.Random(seed), sum(d)
    hits = sum(sum(y if rng.random() < 0.5 else -y for y in d) >= seen - 1e-12 for _ in range(rounds))
    return hits / rounds


def supported_boost(x: list[tuple[float, float]], p: float = 0.05, test=t_test) -> float:
    """Largest factor by which the baseline may be multiplied with the treatment still better at
    level ``p``; 0 if it is not better at factor 1."""

    def better(f: float) -> bool:
        y = [(a * f, b) for a, b in x]
        return sum(b - a for a, b in y) > 0 and test(y) <= p

    if not better(1.0):
        return 0.0
    lo, hi = 1.0, 2.0
    while better(hi) and hi < 1e6:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if better(mid) else (lo, mid)
    return lo


def compare(x: list[tuple[float, float]]) -> dict[str, float]:
    n = max(1, len(x))
    return {
        "baseline": sum(a for a, _ in x) / n,
        "treatment": sum(b for _, b in x) / n,
        "better": sum(b > a for a, b in x),
        "worse": sum(b < a for a, b in x),
        "equal": sum(a == b for a, b in x),
        "t_test": t_test(x),
        "sign_test": sign_test(x),
        "randomized_test": randomized_test(x),
        "supported_boost": supported_boost(x),
    }
