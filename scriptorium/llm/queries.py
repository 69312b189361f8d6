"""Queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from scriptorium.llm import boilerplate, distinct_terms, encode, frequency, markup, mixing, neardup, quality, topn
from scriptorium.session import load

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("p7_found")
def p7_found(spark, d):
    return boilerplate.furniture(load(spark, d, "documents"))


@query("p7_main_text")
def p7_main_text(spark, d):
    return boilerplate.main_texts(load(spark, d, "documents"))


@query("p8_ids")
def p8_ids(spark, d):
    return encode.encode(load(spark, d, "documents"))


@query("p9_found")
def p9_found(spark, d):
    return mixing.short_sources(load(spark, d, "documents"), load(spark, d, "mix_targets"))


@query("p9_mixture")
def p9_mixture(spark, d):
    return mixing.mixture(load(spark, d, "documents"), load(spark, d, "mix_targets"))


@query("p9_shares")
def p9_shares(spark, d):
    return mixing.reached(load(spark, d, "documents"), load(spark, d, "mix_targets"))


_P2_ROWS = """
  SELECT qid, document, max(score + 0.0) AS score FROM scored_documents
  WHERE qid IS NOT NULL AND document >= 0 AND score IS NOT NULL AND NOT isnan(score)
  GROUP BY qid, document"""


@query(
    "p2_found",
    f"""
SELECT qid, CAST(place AS INTEGER) AS place, document FROM (
  SELECT qid, document, row_number() OVER (PARTITION BY qid ORDER BY score DESC, document) AS place FROM ({_P2_ROWS})
) WHERE place <= 10""",
)
def p2_found(spark, d):
    return topn.top_n(load(spark, d, "scored_documents"), "qid", "document", "score", 10)


_P4_BAGS = """
WITH bag AS (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, lower(trim(t, ' ')) AS term FROM (SELECT doc_id, unnest(terms) AS t FROM documents))
  WHERE term IS NOT NULL AND term <> '' GROUP BY doc_id, term),
stat AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM bag GROUP BY term),
long_enough AS (SELECT doc_id FROM bag GROUP BY doc_id HAVING sum(tf) >= 20),
n AS (SELECT count(DISTINCT doc_id) AS n FROM bag)"""


@query(
    "p4_found",
    f"""{_P4_BAGS}
SELECT doc_id, term FROM (
  SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln(n.n / df), 6) DESC, term) AS k
  FROM bag JOIN stat USING (term) JOIN long_enough USING (doc_id), n) WHERE k <= 3""",
)
def p4_found(spark, d):
    return distinct_terms.most_distinctive(load(spark, d, "documents")).select("doc_id", "term")


@query(
    "p4_residual_idf",
    f"""{_P4_BAGS}
SELECT term, df AS document_count, CAST(cf AS BIGINT) AS collection_count,
  round(df * (log2(n.n / df) + log2(1.0 - exp(-cf / CAST(n.n AS DOUBLE)))), 4) AS weight FROM stat, n""",
)
def p4_residual_idf(spark, d):
    docs = load(spark, d, "documents")
    return distinct_terms.residual_idf(docs)


@query(
    "p4_record_weights",
    f"""{_P4_BAGS}
SELECT doc_id, term, round(df * (log2(n.n / df) + log2(1.0 - exp(-cf / CAST(n.n AS DOUBLE)))), 6) AS weight FROM bag JOIN stat USING (term), n""",
)
def p4_record_weights(spark, d):
    return distinct_terms.record_weights(load(spark, d, "documents"))


_P6_PAIRS = """
WITH pair AS (
  SELECT DISTINCT lower(trim(term, ' ')) AS term, docid FROM postings WHERE term IS NOT NULL AND docid IS NOT NULL),
n AS (SELECT count(DISTINCT docid) AS n FROM lengths),
df AS (SELECT term, count(*) AS df FROM pair GROUP BY term)"""


@query(
    "p6_found",
    f"""{_P6_PAIRS}
SELECT term, 'rare' AS mark FROM df WHERE df <= 2
UNION ALL SELECT term, 'common' AS mark FROM df, n WHERE df > 0.05 * n.n""",
)
def p6_found(spark, d):
    return frequency.marked(load(spark, d, "postings"), load(spark, d, "lengths"))


@query(
    "p6_counts",
    """
WITH flat AS (SELECT lower(trim(term, ' ')) AS term, docid, unnest(CASE WHEN len(positions) > 0 THEN positions ELSE [NULL] END) AS pos
  FROM postings WHERE term IS NOT NULL AND docid IS NOT NULL),
once AS (SELECT term, docid, pos FROM flat GROUP BY term, docid, pos)
SELECT term, CAST(count(DISTINCT docid) AS BIGINT) AS document_count,
  CAST(count(*) FILTER (WHERE pos >= 0) AS BIGINT) AS collection_count FROM once GROUP BY term""",
)
def p6_counts(spark, d):
    return frequency.term_counts(load(spark, d, "postings"))


@query("p1_found")
def p1_found(spark, d):
    docs = load(spark, d, "documents")
    return markup.found(docs, markup.fit_weights(boilerplate.labelled_lines(docs)))


@query("p3_found")
def p3_found(spark, d):
    return neardup.NearDuplicates(load(spark, d, "documents")).all_pairs()


@query("p10_found")
def p10_found(spark, d):
    return quality.no_prose(load(spark, d, "documents"), load(spark, d, "common_words"))


@query("p10_statistics")
def p10_statistics(spark, d):
    return quality.statistics(load(spark, d, "documents"), load(spark, d, "common_words"))


@query("p10_scores")
def p10_scores(spark, d):
    return quality.scores(load(spark, d, "documents"), load(spark, d, "common_words"))


@query("p3_groups")
def p3_groups(spark, d):
    """One row per document: its group at five words and a similarity of 0.8, and its links.
    Texts under five words meet if equal; those without a word stand alone."""
    docs = load(spark, d, "documents")
    return neardup.NearDuplicates(docs, run_words=5, threshold=0.8, least_words=1).groups(docs)


@query("p1_clean")
def p1_clean(spark, d):
    """Clean texts; the weights are fitted on lines that the page templates label."""
    docs = load(spark, d, "documents")
    return markup.cleaned(docs, markup.fit_weights(boilerplate.labelled_lines(docs)))
