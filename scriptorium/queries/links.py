"""Queries of links and page rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import links as L
from scriptorium.queries.registry import query
from scriptorium.session import load

_EDGES = """e0 AS (SELECT c.c_nationkey AS src, s.s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey
  WHERE c.c_nationkey <> s.s_nationkey GROUP BY ALL),
o AS (SELECT src, sum(n) AS out FROM e0 GROUP BY src), v AS (SELECT n_nationkey AS node FROM nation), nn AS (SELECT count(*) AS n FROM v),
r0 AS (SELECT node, 1.0 / n AS score FROM v, nn)"""
_ROUND = """, r{1} AS (SELECT v.node, (SELECT (0.15 * sum(score) + 0.85 * coalesce(sum(score) FILTER (WHERE node NOT IN (SELECT src FROM o)), 0)) / max(nn.n) FROM r{0}, nn)
  + 0.85 * coalesce((SELECT sum(r{0}.score * e0.n / o.out) FROM e0 JOIN o USING (src) JOIN r{0} ON r{0}.node = e0.src WHERE e0.dst = v.node), 0) AS score FROM v)"""


@query("pagerank_k", f"WITH {_EDGES}" + "".join(_ROUND.format(i, i + 1) for i in range(4)) + " SELECT node, round(score, 7) AS score FROM r4")
def pagerank_k(spark, d):
    """Page rank over all links between nations, one for each line item."""
    t = lambda n: load(spark, d, n)
    e = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = e.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    v = t("nation").select(F.col("n_nationkey").alias("node"))
    return L.pagerank(e, v, 0.15, 0.0, 4).select("node", F.round("score", 7).alias("score"))


def _pages(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("metadata")["url"].alias("url"), F.col("text").alias("html"))


_LINKS = r"""
WITH p AS (SELECT doc_id AS page, metadata['url'] AS url, text FROM documents WHERE metadata['url'] IS NOT NULL AND text IS NOT NULL),
a AS (SELECT page, url, unnest(regexp_extract_all(text, '(?is)(<a\b[^>]*\bhref\s*=[^>]*>.*?</a\s*>)', 1)) AS a FROM p),
x AS (SELECT page, url, regexp_extract(a, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS href, trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS anchor, regexp_matches(regexp_extract(a, '(?is)^(<a\b[^>]*>)', 1), '(?is)rel\s*=\s*["'']?[^"''>]*nofollow') AS nofollow FROM a),
y AS (SELECT *, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || href ELSE href END AS dest FROM x),
z AS (SELECT page, regexp_replace(regexp_replace(lower(url), '#$', ''), '/$', '') AS src_url, regexp_replace(lower(dest), '/$', '') AS dest_url, anchor, nofollow FROM y)"""


@query("anchor_links", f"{_LINKS} SELECT * FROM z")
def anchor_links(spark, d):
    return L.extract(_pages(spark, d))


@query("anchor_documents", f"{_LINKS} SELECT dest_url, 0 AS part, count(*) AS links, string_agg(anchor, ' ' ORDER BY anchor) AS text FROM z GROUP BY dest_url")
def anchor_documents(spark, d):
    return L.anchor_documents(L.extract(_pages(spark, d)))


_KNOWN = "SELECT regexp_replace(regexp_replace(lower(metadata['url']), '#$', ''), '/$', '') AS dest_url, min(CAST(doc_id AS VARCHAR)) AS dest FROM documents WHERE metadata['url'] IS NOT NULL GROUP BY ALL"


@query("links_resolved", f"{_LINKS} SELECT page, coalesce(dest, 'ext:' || dest_url) AS dest, anchor FROM z LEFT JOIN ({_KNOWN}) USING (dest_url)")
def links_resolved(spark, d):
    p = _pages(spark, d)
    return L.resolve(L.extract(p), p).select("page", "dest", "anchor")


@query("link_index", f"{_LINKS} SELECT page AS src, 'link' AS type, CAST(row_number() OVER (PARTITION BY page ORDER BY dest_url, anchor) - 1 AS INTEGER) AS pos, dest_url AS dest FROM z")
def link_index(spark, d):
    return L.typed(L.extract(_pages(spark, d)))
