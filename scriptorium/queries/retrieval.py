"""Queries of ranking, windows, conditions, passages and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.queries.common import engine, field_engine, rounded
from scriptorium.queries.registry import TOKENS, query

#: A small batch of queries; words of middle and high frequency, one that never occurs.
BATCH = {
    "1": "harvest timber", "2": "witness estuary valve", "3": "the crater", "4": "market drought glacier pension", "5": "zzunknown locomotive",
    "6": "freight", "7": "carriage ballot levy tunnel harvest",
}
_Q = ", ".join(f"('{q}', '{w}', 1.0 / {len(t.split())})" for q, t in BATCH.items() for w in t.split())
_BG = "CASE WHEN coalesce(cf, 0) > 0 THEN cf / c ELSE 0.5 / c END"
_TFN = "tf * log2(1.0 + avgdl / dl)"


def _ranked(expr: str, leaves: str = f"SELECT * FROM (VALUES {_Q}) AS q(qid, term, w)", k: int = 10, counts: str = "post", more: str = "") -> str:
    """SQL for the best k: every candidate is scored with all leaves of its query."""
    return f"""WITH {TOKENS}{more},
q AS ({leaves}),
nst AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM {counts} GROUP BY term),
cand AS (SELECT DISTINCT qid, docid FROM {counts} JOIN q USING (term)),
s AS (SELECT qid, docid, sum(w * ({expr})) AS score FROM (
  SELECT cand.qid, cand.docid, q.term, q.w, coalesce(p.tf, 0) AS tf, len.dl, coalesce(nst.cf, 0) AS cf, coalesce(nst.df, 0) AS df, col.n, col.c, col.avgdl
  FROM cand JOIN q USING (qid) LEFT JOIN {counts} p ON p.docid = cand.docid AND p.term = q.term LEFT JOIN nst ON nst.term = q.term JOIN len ON len.docid = cand.docid, col) GROUP BY qid, docid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM s)
SELECT qid, docid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


def _bm25(idf: str) -> str:
    return f"CASE WHEN tf > 0 THEN {idf} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0.0 END"


_CLASSIC, _LITE = "ln(n / (df + 0.5))", "ln((n - df + 0.5) / (df + 0.5))"
_DIRICHLET = f"ln((tf + 1500.0 * ({_BG})) / (dl + 1500.0))"


def _batch(spark, d, k=10, **params):
    return rounded(engine(spark, d).search_batch(BATCH, k, **params), "score")


@query("bm25_topk", _ranked(_bm25(_CLASSIC)))
def bm25_topk(spark, d):
    return _batch(spark, d, scorer="bm25")


def _lite(tree, params):
    from scriptorium.plans.query import transform

    return transform(tree, lambda n: n.with_params(profile="lite") if n.op == "bm25" else n)


@query("bm25_lite_topk", _ranked(_bm25(_LITE)))
def bm25_lite_topk(spark, d):
    e = engine(spark, d)
    return rounded(e.search_batch({q: _lite(e.plan(t, scorer="bm25"), {}) for q, t in BATCH.items()}, 10), "score")


@query("ql_dirichlet_topk", _ranked(_DIRICHLET))
def ql_dirichlet_topk(spark, d):
    return _batch(spark, d)


@query("ql_jm_topk", _ranked(f"ln(CASE WHEN dl > 0 THEN 0.5 * tf / dl ELSE 0 END + 0.5 * ({_BG}))"))
def ql_jm_topk(spark, d):
    return _batch(spark, d, scorer="jm")


@query(
    "pl2_topk",
    _ranked(f"CASE WHEN tf > 0 THEN greatest(0.0, ({_TFN} * log2(n / cf) + cf / n * log2(exp(1)) + 0.5 * log2(2 * pi() * {_TFN}) + {_TFN} * (log2({_TFN}) - log2(exp(1)))) / ({_TFN} + 1.0)) ELSE 0.0 END"),
)
def pl2_topk(spark, d):
    return _batch(spark, d, scorer="pl2")


@query("inl2_topk", _ranked(f"CASE WHEN tf > 0 THEN {_TFN} / ({_TFN} + 1.0) * log2((n + 1.0) / (df + 0.5)) ELSE 0.0 END"))
def inl2_topk(spark, d):
    return _batch(spark, d, scorer="inl2")


_LF = "(({0}) * ln({0}) - ({0}) + 1.0)"
_REST = f"(dl - 1.0 - {_TFN})"


@query(
    "bil2_topk",
    _ranked(
        f"CASE WHEN tf > 0 AND dl > 2 AND {_REST} > 0 THEN ({_LF.format(_TFN)} + (CASE WHEN {_REST} > 0 THEN {_LF.format(f'greatest({_REST}, 1e-9)')} ELSE 0 END) - {_LF.format('(dl - 1.0)')}"
        f" - tf * log2(1.0 / (dl - 1.0)) - {_REST} * log2(1.0 - 1.0 / (dl - 1.0))) / ({_TFN} + 1.0) ELSE 0.0 END"
    ),
)
def bil2_topk(spark, d):
    return _batch(spark, d, scorer="bil2")


@query("weighted_combine", _ranked(_DIRICHLET, "SELECT 'w' AS qid, * FROM (VALUES ('harvest', 0.6), ('market', 0.3), ('levy', 0.1)) AS q(term, w)"))
def weighted_combine(spark, d):
    return rounded(engine(spark, d).search_batch({"w": "#combine:0=6:1=3:2=1( harvest market levy )"}, 10), "score")


_MU = "(CASE WHEN term = 'harvest' THEN 10.0 ELSE 2000.0 END)"


@query("mixed_mu_topk", _ranked(f"ln((tf + {_MU} * ({_BG})) / (dl + {_MU}))", "SELECT 'm' AS qid, * FROM (VALUES ('harvest', 0.5), ('market', 0.5)) AS q(term, w)"))
def mixed_mu_topk(spark, d):
    """Leaves of one query with smoothing of their own."""
    return rounded(engine(spark, d).search_batch({"m": "#combine( #dirichlet:mu=10( harvest ) #dirichlet:mu=2000( market ) )"}, 10), "score")


@query(
    "mixed_scorers_topk",
    _ranked(
        f"CASE WHEN term = 'harvest' THEN ln((tf + 0.5 * ({_BG})) / (dl + 0.5)) WHEN term = 'market' THEN {_bm25(_CLASSIC)} ELSE ln(CASE WHEN dl > 0 THEN 0.5 * tf / dl ELSE 0 END + 0.5 * ({_BG})) END",
        "SELECT 'm' AS qid, * FROM (VALUES ('harvest', 1.0 / 3), ('market', 1.0 / 3), ('levy', 1.0 / 3)) AS q(term, w)",
    ),
)
def mixed_scorers_topk(spark, d):
    """Different scoring functions in one query, and a query beside it that needs the tree plan."""
    r = engine(spark, d).search_batch({"m": "#combine( #dirichlet:mu=0.5( harvest ) #bm25( market ) #jm( levy ) )", "t": "#require( zznone #combine( harvest ) )"}, 10)
    return rounded(r, "score")


def _one(spark, d, q, k=10, **params):
    return rounded(engine(spark, d).search(q, k, **params).select("docid", "score", "rank"), "score")


@query(
    "wsum_topk",
    f"""WITH {TOKENS}, q AS (SELECT * FROM (VALUES ('harvest', 0.7), ('tunnel', 0.3)) AS q(term, w)),
cand AS (SELECT DISTINCT docid FROM post JOIN q USING (term)),
s AS (SELECT docid, ln(sum(w * (tf + 1500.0 * ({_BG})) / (dl + 1500.0))) AS score FROM (
  SELECT cand.docid, q.w, coalesce(p.tf, 0) AS tf, dl, cf, c FROM cand, q LEFT JOIN post p ON p.docid = cand.docid AND p.term = q.term LEFT JOIN stat ON stat.term = q.term JOIN len ON len.docid = cand.docid, col) GROUP BY docid)
SELECT docid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, docid) AS rank FROM s) WHERE rank <= 10""",
)
def wsum_topk(spark, d):
    return _one(spark, d, "#wsum:0=0.7:1=0.3( harvest tunnel )")


def _has(*words):
    return " ".join(f", d{i} AS (SELECT docid FROM post WHERE term = '{w}')" for i, w in enumerate(words))


@query("bool_and", f"WITH {TOKENS}{_has('harvest', 'market')} SELECT docid FROM d0 INTERSECT SELECT docid FROM d1")
def bool_and(spark, d):
    return engine(spark, d).boolean("#all( harvest market )")


@query("bool_or", f"WITH {TOKENS}{_has('harvest', 'market')} SELECT docid FROM d0 UNION SELECT docid FROM d1")
def bool_or(spark, d):
    return engine(spark, d).boolean("#any( harvest market )")


@query("bool_not", f"WITH {TOKENS}{_has('the')} SELECT docid FROM len EXCEPT SELECT docid FROM d0")
def bool_not(spark, d):
    return engine(spark, d).boolean("#bnot( the )")


def _filtered(keep: str) -> str:
    return f"""WITH {TOKENS}{_has('market')},
s AS (SELECT docid, {_DIRICHLET} AS score FROM post JOIN stat USING (term) JOIN len USING (docid), col WHERE term = 'harvest' AND docid {keep} (SELECT docid FROM d0))
SELECT docid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, docid) AS rank FROM s) WHERE rank <= 10"""


@query("require_topk", _filtered("IN"))
def require_topk(spark, d):
    return _one(spark, d, "#require( market #combine( harvest ) )")


@query("reject_topk", _filtered("NOT IN"))
def reject_topk(spark, d):
    return _one(spark, d, "#reject( market #combine( harvest ) )")


@query(
    "threshold_docs",
    f"""WITH {TOKENS} SELECT docid FROM post JOIN stat USING (term) JOIN len USING (docid), col WHERE term = 'harvest' AND {_bm25(_CLASSIC)} >= 2.0""",
)
def threshold_docs(spark, d):
    return engine(spark, d).boolean("#threshold:raw=2.0( #bm25( harvest ) )")


@query(
    "boost_scale_topk",
    f"""WITH {TOKENS}, m AS (SELECT DISTINCT docid FROM post WHERE term = 'levy'),
cand AS (SELECT docid FROM post WHERE term IN ('levy', 'harvest') GROUP BY docid),
s AS (SELECT docid, 2.0 * coalesce((SELECT {_bm25(_CLASSIC)} FROM post JOIN stat USING (term) JOIN len USING (docid), col WHERE post.docid = cand.docid AND term = 'harvest'), 0.0)
  + CASE WHEN docid IN (SELECT docid FROM m) THEN 0.25 ELSE 0.0 END AS score FROM cand)
SELECT docid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, docid) AS rank FROM s) WHERE rank <= 10""",
)
def boost_scale_topk(spark, d):
    return _one(spark, d, "#combine:norm=false( #scale:2( #bm25( harvest ) ) #boost:beta=0.25( levy ) )")


# --- windows ------------------------------------------------------------------------------

_OD = """ (SELECT docid, count(*) AS tf FROM (SELECT a.docid, a.pos, min(b.pos) AS q FROM tok a JOIN tok b ON a.docid = b.docid AND b.pos > a.pos WHERE a.term = '{0}' AND b.term = '{1}' GROUP BY a.docid, a.pos)
  WHERE q - pos - 1 < {2} GROUP BY docid)"""
_UW = """ (SELECT docid, count(*) AS tf FROM (
  SELECT p.docid, p.pos, min(CASE WHEN t.term = '{0}' THEN t.pos END) AS x, min(CASE WHEN t.term = '{1}' THEN t.pos END) AS y
  FROM (SELECT DISTINCT docid, pos FROM tok WHERE term IN ('{0}', '{1}')) p JOIN tok t ON t.docid = p.docid AND t.pos >= p.pos WHERE t.term IN ('{0}', '{1}') GROUP BY p.docid, p.pos)
  WHERE x IS NOT NULL AND y IS NOT NULL AND greatest(x, y) + 1 - pos <= {2} GROUP BY docid)"""


def _counts(spark, d, q):
    e = engine(spark, d)
    rows, defs = e.leaves({"x": q}, scorer="bm25")
    from scriptorium.operators.retrieval import _DEFINITION, node_counts

    return node_counts(e.index, spark.createDataFrame(defs, _DEFINITION)).select("docid", "tf")


@query("bigram_od1", f"WITH {TOKENS} SELECT docid, tf FROM{_OD.format('of', 'the', 1)}")
def bigram_od1(spark, d):
    return _counts(spark, d, "#bigram( of the )")


@query("od_window", f"WITH {TOKENS} SELECT docid, tf FROM{_OD.format('the', 'of', 4)}")
def od_window(spark, d):
    return _counts(spark, d, "#od:4( the of )")


@query("uw_window", f"WITH {TOKENS} SELECT docid, tf FROM{_UW.format('market', 'the', 8)}")
def uw_window(spark, d):
    return _counts(spark, d, "#uw:8( market the )")


@query("window_statistics", f"WITH {TOKENS}, w AS{_UW.format('harvest', 'the', 8)} SELECT CAST(coalesce(sum(tf), 0) AS BIGINT) AS cf, count(*) AS df, CAST(coalesce(max(tf), 0) AS BIGINT) AS max_tf FROM w")
def window_statistics(spark, d):
    s = engine(spark, d).node_statistics("#uw:8( harvest the )")
    return spark.createDataFrame([s], "cf bigint, df bigint, max_tf bigint")


@query("synonym_counts", f"WITH {TOKENS} SELECT docid, CAST(sum(tf) AS BIGINT) AS tf FROM post WHERE term IN ('harvest', 'market', 'levy') GROUP BY docid")
def synonym_counts(spark, d):
    from scriptorium.plans.query import parse
    from scriptorium.plans.rewrites import names
    from scriptorium.plans.tree import _Context

    t = engine(spark, d).trees
    n = names(parse("#syn( harvest market levy )"), {})
    x = t.rows(n).select("docid", t.count(n, _Context()).cast("bigint").alias("tf"))
    return x.where("tf > 0")


@query(
    "inside_counts",
    f"""WITH {TOKENS}, e AS (SELECT DISTINCT doc_id AS docid, t.tok_begin AS b, t.tok_end AS e FROM (SELECT doc_id, unnest(tags) AS t FROM documents) WHERE lower(t.name) = 'title' AND t.tok_end > t.tok_begin)
SELECT tok.docid, count(DISTINCT pos) AS tf FROM tok JOIN e ON e.docid = tok.docid AND e.b <= pos AND pos < e.e WHERE term = 'of' GROUP BY tok.docid""",
)
def inside_counts(spark, d):
    from scriptorium.plans.query import parse
    from scriptorium.plans.tree import _Context

    t = engine(spark, d).trees
    n = parse("of.title")
    x = t.rows(n).select("docid", t.count(n, _Context()).cast("bigint").alias("tf"))
    return x.where("tf > 0")


_SDM_COUNTS = f""", win AS (
  SELECT docid, term, tf FROM post WHERE term IN ('market', 'the', 'harvest')
  UNION ALL SELECT docid, 'od12' AS term, tf FROM{_OD.format('the', 'market', 1)} UNION ALL SELECT docid, 'od23' AS term, tf FROM{_OD.format('market', 'harvest', 1)}
  UNION ALL SELECT docid, 'uw12' AS term, tf FROM{_UW.format('the', 'market', 8)} UNION ALL SELECT docid, 'uw23' AS term, tf FROM{_UW.format('market', 'harvest', 8)})"""
_SDM_LEAVES = "SELECT 's' AS qid, * FROM (VALUES ('the', 0.8 / 3), ('market', 0.8 / 3), ('harvest', 0.8 / 3), ('od12', 0.075), ('od23', 0.075), ('uw12', 0.025), ('uw23', 0.025)) AS q(term, w)"


@query("sdm_topk", _ranked(_DIRICHLET, _SDM_LEAVES, counts="win", more=_SDM_COUNTS))
def sdm_topk(spark, d):
    return rounded(engine(spark, d).search_batch({"s": "#sdm( the market harvest )"}, 10), "score")


@query("tree_equals_batch", f"SELECT docid, score, rank FROM ({_ranked(_DIRICHLET, _SDM_LEAVES, counts='win', more=_SDM_COUNTS)})")
def tree_equals_batch(spark, d):
    return _one(spark, d, "#sdm( the market harvest )")


# --- fields, priors -------------------------------------------------------------------------


@query("field_greater", "SELECT doc_id AS docid FROM documents WHERE n_chars > 1200")
def field_greater(spark, d):
    return engine(spark, d).boolean("#greater( n_chars 1200 )")


@query("field_less", "SELECT doc_id AS docid FROM documents WHERE n_chars < 400")
def field_less(spark, d):
    return engine(spark, d).boolean("#less( n_chars 400 )")


@query("field_between", "SELECT doc_id AS docid FROM documents WHERE n_chars > 500 AND n_chars < 900")
def field_between(spark, d):
    return engine(spark, d).boolean("#between( n_chars 500 900 )")


@query("field_equals", "SELECT doc_id AS docid FROM documents WHERE lang = 'de'")
def field_equals(spark, d):
    return engine(spark, d).boolean("#equals( lang de )")


@query("field_date", "SELECT doc_id AS docid FROM documents WHERE crawled_at > TIMESTAMPTZ '2023-11-20 00:00:00+00'")
def field_date(spark, d):
    return engine(spark, d).boolean("#greater( crawled_at 2023-11-20 )")


@query(
    "prior_combine",
    f"""WITH {TOKENS}, pr AS (SELECT docid, CASE WHEN dl > 150 THEN -0.5 ELSE -1.5 END AS v FROM len WHERE dl > 60),
cand AS (SELECT docid FROM post WHERE term = 'harvest' UNION SELECT docid FROM pr),
s AS (SELECT cand.docid, 0.5 * coalesce(v, -2.0) + 0.5 * ln((coalesce(tf, 0) + 1500.0 * (SELECT cf / c FROM stat, col WHERE term = 'harvest')) / (dl + 1500.0)) AS score
  FROM cand LEFT JOIN pr USING (docid) LEFT JOIN post ON post.docid = cand.docid AND term = 'harvest' JOIN len ON len.docid = cand.docid)
SELECT docid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, docid) AS rank FROM s) WHERE rank <= 10""",
)
def prior_combine(spark, d):
    return _one(spark, d, "#combine( #prior:long:fallback=-2.0() harvest )")


# --- passages, two passes ---------------------------------------------------------------------

_PASSAGES = f"""WITH {TOKENS}, dd AS (SELECT docid, dl FROM len WHERE docid IN (SELECT docid FROM post WHERE term IN ('harvest', 'market'))),
pas AS (SELECT docid, dl, b AS begin, least(b + 50, dl) AS e FROM (SELECT docid, dl, unnest(range(0, CAST(greatest(0, ceil((dl - 50) / 25.0)) AS BIGINT) * 25 + 1, 25)) AS b FROM dd) WHERE b < dl),
bgs AS (SELECT term, cf / c AS bg FROM stat, col WHERE term IN ('harvest', 'market')),
s AS (SELECT pas.docid, pas.begin, pas.e, sum(0.5 * ln((coalesce(k, 0) + 1500.0 * bg) / (pas.e - pas.begin + 1500.0))) AS score FROM pas, bgs
  LEFT JOIN (SELECT p.docid, p.begin, t.term, count(*) AS k FROM pas p JOIN tok t ON t.docid = p.docid AND t.pos >= p.begin AND t.pos < p.e WHERE t.term IN ('harvest', 'market') GROUP BY ALL) h
  ON h.docid = pas.docid AND h.begin = pas.begin AND h.term = bgs.term GROUP BY ALL)"""


@query("passage_topk", f"""{_PASSAGES} SELECT docid, CAST(begin AS INTEGER) AS begin, CAST(e AS INTEGER) AS "end", round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, docid, begin) AS rank FROM s) WHERE rank <= 20""")
def passage_topk(spark, d):
    return rounded(engine(spark, d).passages("harvest market", 50, 25, 20), "score")


@query(
    "max_passage",
    f"""{_PASSAGES}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY score DESC, begin) AS r FROM s) WHERE r = 1)
SELECT docid, CAST(begin AS INTEGER) AS begin, CAST(e AS INTEGER) AS "end", round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, docid, begin) AS rank FROM best) WHERE rank <= 10""",
)
def max_passage(spark, d):
    return rounded(engine(spark, d).passages("harvest market", 50, 25, 10, best_only=True), "score")


@query(
    "two_pass_topk",
    _ranked(_bm25(_CLASSIC), "SELECT 'x' AS qid, 'harvest' AS term, 1.0 AS w", 50)
    .replace("SELECT qid, docid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50", "")
    + f""", ws AS (SELECT docid FROM r WHERE rank <= 50),
s2 AS (SELECT ws.docid, {_DIRICHLET} AS score FROM ws JOIN post ON post.docid = ws.docid AND term = 'market' JOIN stat USING (term) JOIN len ON len.docid = ws.docid, col)
SELECT docid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, docid) AS rank FROM s2) WHERE rank <= 10""",
)
def two_pass_topk(spark, d):
    e = engine(spark, d)
    return rounded(e.two_pass("#bm25( harvest )", "#combine( market )", 10, 50).select("docid", "score", "rank"), "score")


# --- feedback -----------------------------------------------------------------------------------

_RM = (
    _ranked(_DIRICHLET, f"SELECT * FROM (VALUES {_Q}) AS q(qid, term, w) WHERE qid IN ('1', '2')", 10).replace("SELECT qid, docid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10", "")
    + """, top AS (SELECT qid, docid, exp(score - max(score) OVER (PARTITION BY qid)) AS e FROM r WHERE rank <= 10),
pst AS (SELECT qid, docid, e / sum(e) OVER (PARTITION BY qid) / count(*) OVER (PARTITION BY qid) AS p FROM top),
rm AS (SELECT qid, term, sum(p * tf / dl) AS weight FROM pst JOIN post USING (docid) JOIN len USING (docid) WHERE length(term) > 0 GROUP BY qid, term),
rmf AS (SELECT * FROM rm WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.qid = rm.qid AND q.term = rm.term) AND term NOT IN (STOP)),
rmk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(weight, 12) DESC, term) AS k FROM rmf) WHERE k <= 10)"""
)


def _stop_sql(s: str) -> str:
    from scriptorium.functions.text import STOPWORDS

    return s.replace("(STOP)", "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")")


_TWO = {q: BATCH[q] for q in ("1", "2")}


@query("rm1_terms", _stop_sql(_RM + " SELECT qid, term, round(weight, 6) AS weight FROM rmk"))
def rm1_terms(spark, d):
    return engine(spark, d).feedback_terms(_TWO, 10, 10).select("qid", "term", F.round("weight", 6).alias("weight"))


@query(
    "rm3_topk",
    _stop_sql(
        _RM
        + f""", q2 AS (SELECT qid, term, 0.25 * w AS w FROM q UNION ALL SELECT qid, term, 0.75 * weight / sum(weight) OVER (PARTITION BY qid) AS w FROM rmk),
cand2 AS (SELECT DISTINCT qid, docid FROM post JOIN q2 USING (term)),
s2 AS (SELECT qid, docid, sum(w * {_DIRICHLET}) AS score FROM (
  SELECT cand2.qid, cand2.docid, q2.w, coalesce(p.tf, 0) AS tf, len.dl, coalesce(st.cf, 0) AS cf, col.c FROM cand2 JOIN q2 USING (qid) LEFT JOIN post p ON p.docid = cand2.docid AND p.term = q2.term LEFT JOIN stat st ON st.term = q2.term JOIN len ON len.docid = cand2.docid, col) GROUP BY qid, docid),
r2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM s2)
SELECT qid, docid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r2 WHERE rank <= 10"""
    ),
)
def rm3_topk(spark, d):
    return rounded(engine(spark, d).search_feedback(_TWO, 10, 10, 10), "score")


# --- fields of documents -----------------------------------------------------------------------

_FIELDS = f"""WITH {TOKENS}, ext AS (SELECT DISTINCT lower(t.name) AS f, doc_id AS docid, t.tok_begin AS b, t.tok_end AS e FROM (SELECT doc_id, unnest(tags) AS t FROM documents) WHERE lower(t.name) IN ('title', 'text') AND t.tok_end > t.tok_begin),
fl AS (SELECT f, docid, sum(e - b) AS dl FROM ext GROUP BY f, docid), fc AS (SELECT f, sum(dl) AS c, sum(dl) * 1.0 / max(col.n) AS avgdl FROM fl, col GROUP BY f),
fp AS (SELECT f, tok.docid, term, count(DISTINCT pos) AS tf FROM tok JOIN ext ON ext.docid = tok.docid AND b <= pos AND pos < e WHERE term IN ('harvest', 'market') GROUP BY ALL),
fst AS (SELECT f, term, sum(tf) AS cf FROM fp GROUP BY f, term),
w AS (SELECT * FROM (VALUES ('harvest'), ('market')) AS q(term)), ff AS (SELECT * FROM (VALUES ('title'), ('text')) AS q(f))"""
_FTAIL = " SELECT docid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, docid) AS rank FROM s) WHERE rank <= 10"


@query(
    "bm25f_topk",
    f"""{_FIELDS}, cand AS (SELECT docid FROM fp UNION SELECT docid FROM post WHERE term IN ('harvest', 'market')),
t AS (SELECT cand.docid, w.term, sum(0.5 * coalesce(tf, 0) / (1.0 + 0.5 * (coalesce(fl.dl, 0) / fc.avgdl - 1.0))) AS x FROM cand, w, ff JOIN fc USING (f)
  LEFT JOIN fp ON fp.docid = cand.docid AND fp.term = w.term AND fp.f = ff.f LEFT JOIN fl ON fl.docid = cand.docid AND fl.f = ff.f GROUP BY ALL),
s AS (SELECT docid, sum(x / (0.5 + x) * ln(n / (df + 0.5))) AS score FROM t JOIN stat USING (term), col GROUP BY docid){_FTAIL}""",
)
def bm25f_topk(spark, d):
    e = field_engine(spark, d)
    return rounded(e.search("#bm25f:fields=@/title,text/( harvest market )", 10).select("docid", "score", "rank"), "score")


@query(
    "mlm_topk",
    f"""{_FIELDS}, cand AS (SELECT DISTINCT docid FROM fp),
t AS (SELECT cand.docid, w.term, ln(sum(0.5 * (coalesce(tf, 0) + 1500.0 * (CASE WHEN coalesce(fst.cf, 0) > 0 THEN fst.cf / fc.c ELSE 0.5 / fc.c END)) / (coalesce(fl.dl, 0) + 1500.0))) AS x
  FROM cand, w, ff JOIN fc USING (f) LEFT JOIN fst ON fst.f = ff.f AND fst.term = w.term
  LEFT JOIN fp ON fp.docid = cand.docid AND fp.term = w.term AND fp.f = ff.f LEFT JOIN fl ON fl.docid = cand.docid AND fl.f = ff.f GROUP BY ALL),
s AS (SELECT docid, sum(x) AS score FROM t GROUP BY docid){_FTAIL}""",
)
def mlm_topk(spark, d):
    e = field_engine(spark, d)
    return rounded(e.search("#mlm:fields=@/title,text/( harvest market )", 10).select("docid", "score", "rank"), "score")


_MIXED = "coalesce(tf, 0) + 1500.0 * (CASE WHEN coalesce(fst.cf, 0) > 0 THEN fst.cf / fc.c ELSE 0.5 / fc.c END)"
_FJOIN = """FROM cand, w, ff JOIN fc USING (f) LEFT JOIN fst ON fst.f = ff.f AND fst.term = w.term
  LEFT JOIN fp ON fp.docid = cand.docid AND fp.term = w.term AND fp.f = ff.f LEFT JOIN fl ON fl.docid = cand.docid AND fl.f = ff.f"""


@query(
    "prms_topk",
    f"""{_FIELDS}, cand AS (SELECT DISTINCT docid FROM fp), sh AS (SELECT f, term, (cf / c) / sum(cf / c) OVER (PARTITION BY term) AS share FROM fst JOIN fc USING (f)),
t AS (SELECT cand.docid, w.term, ln(sum(coalesce(share, 0) * ({_MIXED}) / (coalesce(fl.dl, 0) + 1500.0))) AS x {_FJOIN} LEFT JOIN sh ON sh.f = ff.f AND sh.term = w.term GROUP BY ALL),
s AS (SELECT docid, avg(x) AS score FROM t GROUP BY docid){_FTAIL}""",
)
def prms_topk(spark, d):
    e = field_engine(spark, d)
    return rounded(e.search("#prms:fields=@/title,text/( harvest market )", 10).select("docid", "score", "rank"), "score")


_FTFN = "(tf * log2(1.0 + fc.avgdl / fl.dl))"


@query(
    "pl2f_topk",
    f"""{_FIELDS}, cand AS (SELECT DISTINCT docid FROM fp),
t AS (SELECT cand.docid, CASE WHEN tf > 0 THEN greatest(0.0, ({_FTFN} * log2(n / fst.cf) + fst.cf / n * log2(exp(1)) + 0.5 * log2(2 * pi() * {_FTFN}) + {_FTFN} * (log2({_FTFN}) - log2(exp(1)))) / ({_FTFN} + 1.0)) ELSE 0.0 END AS x {_FJOIN}, col),
s AS (SELECT docid, sum(0.5 * x) AS score FROM t GROUP BY docid){_FTAIL}""",
)
def pl2f_topk(spark, d):
    e = field_engine(spark, d)
    return rounded(e.search("#pl2f:fields=@/title,text/( harvest market )", 10).select("docid", "score", "rank"), "score")


_FSDM = (
    _FIELDS.replace(", w AS (SELECT", ", w0 AS (SELECT").replace("fst AS (SELECT f, term, sum(tf) AS cf FROM fp GROUP BY f, term),\nw AS", "fst0 AS (SELECT 1),\nw0 AS").replace("fp AS (SELECT f, tok.docid", "fp0 AS (SELECT f, tok.docid")
    + """, span AS (
  SELECT 'od' AS term, a.docid, a.pos AS b, a.pos + 2 AS e FROM tok a JOIN tok b ON a.docid = b.docid AND b.pos = a.pos + 1 WHERE a.term = 'harvest' AND b.term = 'market'
  UNION ALL SELECT 'uw' AS term, docid, pos AS b, greatest(x, y) + 1 AS e FROM (
    SELECT p.docid, p.pos, min(CASE WHEN t.term = 'harvest' THEN t.pos END) AS x, min(CASE WHEN t.term = 'market' THEN t.pos END) AS y
    FROM (SELECT DISTINCT docid, pos FROM tok WHERE term IN ('harvest', 'market')) p JOIN tok t ON t.docid = p.docid AND t.pos >= p.pos WHERE t.term IN ('harvest', 'market') GROUP BY p.docid, p.pos)
  WHERE x IS NOT NULL AND y IS NOT NULL AND greatest(x, y) + 1 - pos <= 8),
fp AS (SELECT * FROM fp0 UNION ALL SELECT f, span.docid, term, count(DISTINCT span.b) AS tf FROM span JOIN ext ON ext.docid = span.docid AND ext.b <= span.b AND span.e <= ext.e GROUP BY ALL),
fst AS (SELECT f, term, sum(tf) AS cf FROM fp GROUP BY f, term), w AS (SELECT * FROM (VALUES ('harvest', 0.8), ('market', 0.8), ('od', 0.1), ('uw', 0.1)) AS q(term, k))"""
)


@query(
    "fieldedsdm_topk",
    f"""{_FSDM}, cand AS (SELECT DISTINCT docid FROM fp),
t AS (SELECT cand.docid, w.term, w.k, ln(sum(0.5 * ({_MIXED}) / (coalesce(fl.dl, 0) + 1500.0))) AS x {_FJOIN} GROUP BY ALL),
s AS (SELECT docid, sum(k * x) AS score FROM t GROUP BY docid){_FTAIL}""",
)
def fieldedsdm_topk(spark, d):
    e = field_engine(spark, d)
    return rounded(e.search("#fieldedsdm:fields=@/title,text/( harvest market )", 10).select("docid", "score", "rank"), "score")


_UW3 = """ (SELECT docid, count(*) AS tf FROM (
  SELECT p.docid, p.pos, min(CASE WHEN t.term = '{0}' THEN t.pos END) AS x, min(CASE WHEN t.term = '{1}' THEN t.pos END) AS y, min(CASE WHEN t.term = '{2}' THEN t.pos END) AS z
  FROM (SELECT DISTINCT docid, pos FROM tok WHERE term IN ('{0}', '{1}', '{2}')) p JOIN tok t ON t.docid = p.docid AND t.pos >= p.pos WHERE t.term IN ('{0}', '{1}', '{2}') GROUP BY p.docid, p.pos)
  WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND greatest(x, y, z) + 1 - pos <= {3} GROUP BY docid)"""
_OD3 = """ (SELECT a.docid, count(*) AS tf FROM tok a JOIN tok b ON a.docid = b.docid AND b.pos = a.pos + 1 JOIN tok c ON a.docid = c.docid AND c.pos = a.pos + 2 WHERE a.term = '{0}' AND b.term = '{1}' AND c.term = '{2}' GROUP BY a.docid)"""
_THREE = ("the", "market", "harvest")
_PAIRS = [("the", "market"), ("the", "harvest"), ("market", "harvest")]
_DEP_COUNTS = (
    ", win AS (SELECT docid, term, tf FROM post WHERE term IN ('market', 'the', 'harvest')"
    + "".join(f" UNION ALL SELECT docid, 'od {a} {b}' AS term, tf FROM{_OD.format(a, b, 1)} UNION ALL SELECT docid, 'uw {a} {b}' AS term, tf FROM{_UW.format(a, b, 8)}" for a, b in _PAIRS)
    + f" UNION ALL SELECT docid, 'od3' AS term, tf FROM{_OD3.format(*_THREE)} UNION ALL SELECT docid, 'uw3' AS term, tf FROM{_UW3.format(*_THREE, 12)})"
)
_DEP_LEAVES = (
    [("fdm", t, 0.8 / 3) for t in _THREE] + [("fdm", f"{o} {a} {b}", w / 4) for a, b in _PAIRS for o, w in (("od", 0.15), ("uw", 0.05))] + [("fdm", "od3", 0.15 / 4), ("fdm", "uw3", 0.05 / 4)]
    + [("wsdm", t, 0.8) for t in _THREE] + [("wsdm", f"{o} {a} {b}", 0.1) for a, b in (_PAIRS[0], _PAIRS[2]) for o in ("od", "uw")] + [("pdfr", t, 1.0) for t in _THREE]
)
_DEP_VALUES = ", ".join(f"('{q}', '{t}', {w!r})" for q, t, w in _DEP_LEAVES)
_TFN6 = "(tf * log2(1.0 + 6.0 * avgdl / dl))"
_PL2_6 = f"CASE WHEN tf > 0 THEN greatest(0.0, ({_TFN6} * log2(n / cf) + cf / n * log2(exp(1)) + 0.5 * log2(2 * pi() * {_TFN6}) + {_TFN6} * (log2({_TFN6}) - log2(exp(1)))) / ({_TFN6} + 1.0)) ELSE 0.0 END"


@query("fdm_wsdm_pdfr", _ranked(f"CASE WHEN qid = 'pdfr' THEN {_PL2_6} ELSE {_DIRICHLET} END", f"SELECT * FROM (VALUES {_DEP_VALUES}) AS q(qid, term, w)", counts="win", more=_DEP_COUNTS))
def fdm_wsdm_pdfr(spark, d):
    """Three expansions of one query as one batch."""
    e = engine(spark, d)
    return rounded(e.search_batch({"fdm": "#fdm( the market harvest )", "wsdm": "#wsdm( the market harvest )", "pdfr": "#pdfr( the market harvest )"}, 10), "score")


_EXPLAINED = [("#dirichlet( #text:market() )", "market", 0.4), ("#dirichlet( #text:harvest() )", "harvest", 0.4), ("#dirichlet( #ordered:1( #text:market() #text:harvest() ) )", "od", 0.15), ("#dirichlet( #unordered:8( #text:market() #text:harvest() ) )", "uw", 0.05)]
_EXPLAINED_VALUES = ", ".join(f"('{n}', '{t}', {w})" for n, t, w in _EXPLAINED)


@query(
    "explained_topk",
    f"""WITH {TOKENS}, win AS (SELECT docid, term, tf FROM post WHERE term IN ('market', 'harvest') UNION ALL SELECT docid, 'od' AS term, tf FROM{_OD.format('market', 'harvest', 1)} UNION ALL SELECT docid, 'uw' AS term, tf FROM{_UW.format('market', 'harvest', 8)}),
q AS (SELECT * FROM (VALUES {_EXPLAINED_VALUES}) AS q(node, term, w)), nst AS (SELECT term, sum(tf) AS cf FROM win GROUP BY term),
x AS (SELECT c.docid, node, w, coalesce(p.tf, 0) AS tf, {_DIRICHLET.replace('tf', 'coalesce(p.tf, 0)', 1)} AS score FROM (SELECT DISTINCT docid FROM win) c CROSS JOIN q LEFT JOIN win p ON p.docid = c.docid AND p.term = q.term LEFT JOIN nst ON nst.term = q.term JOIN len ON len.docid = c.docid, col),
r AS (SELECT docid, row_number() OVER (ORDER BY sum(w * score) DESC, docid) AS rank FROM x GROUP BY docid)
SELECT docid, CAST(rank AS INTEGER) AS rank, node, CAST(tf AS BIGINT) AS tf, round(score, 6) AS score FROM x JOIN r USING (docid) WHERE rank <= 5""",
)
def explained_topk(spark, d):
    r = engine(spark, d).search("#sdm( market harvest )", 5, explain=True)
    x = r.select("docid", "rank", F.explode("leaves").alias("leaf"))
    return x.select("docid", "rank", "leaf.node", F.col("leaf.tf").cast("bigint").alias("tf"), F.round("leaf.score", 6).alias("score"))


@query(
    "extent_passages",
    f"""WITH {TOKENS}, ext AS (SELECT DISTINCT doc_id AS docid, t.tok_begin AS b, t.tok_end AS e FROM (SELECT doc_id, unnest(tags) AS t FROM documents) WHERE lower(t.name) = 'li' AND t.tok_end > t.tok_begin),
sp AS (SELECT docid, b, e, lead(e) OVER w AS e2, row_number() OVER w AS k, count(*) OVER (PARTITION BY docid) AS n FROM ext WINDOW w AS (PARTITION BY docid ORDER BY b, e)),
pas AS (SELECT docid, b, greatest(e, coalesce(e2, e)) AS e FROM sp WHERE k <= greatest(1, n - 1) AND docid IN (SELECT docid FROM post WHERE term IN ('market', 'harvest'))),
q AS (SELECT term, cf / c AS bg FROM stat, col WHERE term IN ('market', 'harvest')),
s AS (SELECT docid, b, e, sum(0.5 * ln((k + 1500.0 * bg) / (e - b + 1500.0))) AS score FROM (
  SELECT pas.docid, pas.b, pas.e, q.bg, count(tok.pos) AS k FROM pas CROSS JOIN q LEFT JOIN tok ON tok.docid = pas.docid AND tok.term = q.term AND tok.pos >= pas.b AND tok.pos < pas.e GROUP BY ALL) GROUP BY ALL)
SELECT docid, b AS begin, e AS "end", round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, docid, b) AS rank FROM s) WHERE rank <= 10""",
)
def extent_passages(spark, d):
    e = engine(spark, d)
    from scriptorium.operators.retrieval import top_k

    return rounded(top_k(e.trees.extent_passages(e.plan("market harvest"), "li", 2, 1), 10, extra=("begin",)), "score")
