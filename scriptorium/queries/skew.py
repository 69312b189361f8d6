"""Queries of the operators for keys that hold most records."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import hotkeys
from scriptorium.queries.registry import query
from scriptorium.session import load


@query(
    "p5_found",
    """
WITH x AS (SELECT lower(trim(term, ' ')) AS term, docid, positions FROM postings),
hot AS (SELECT term FROM x WHERE term IS NOT NULL GROUP BY term HAVING count(*) >= 0.02 * (SELECT count(*) FROM x)),
n AS (SELECT term, docid, count(DISTINCT pos) AS n FROM (
    SELECT term, docid, unnest(CASE WHEN len(positions) > 0 THEN positions ELSE [NULL] END) AS pos FROM x SEMI JOIN hot USING (term) WHERE docid IS NOT NULL)
  GROUP BY term, docid)
SELECT term, docid FROM (SELECT term, docid, row_number() OVER (PARTITION BY term ORDER BY n DESC, docid) AS k FROM n) WHERE k = 1""",
)
def p5_found(spark, d):
    return hotkeys.heaviest_record(load(spark, d, "postings"))


_QUANTILES = """
WITH x AS (SELECT lower(trim(term, ' ')) AS term, docid FROM postings WHERE term IS NOT NULL AND docid IS NOT NULL),
r AS (SELECT term, docid, row_number() OVER (PARTITION BY term ORDER BY docid) AS k, count(*) OVER (PARTITION BY term) AS n FROM x),
p AS (SELECT unnest([0.25, 0.5, 0.9]) AS p)
SELECT term, CAST(p AS DOUBLE) AS p, docid FROM r, p WHERE k = greatest(1, ceil(round(p * n, 9)))"""


@query("p5_docid_quantiles", _QUANTILES)
def p5_docid_quantiles(spark, d):
    return hotkeys.quantiles(_terms(spark, d), "term", "docid", [0.25, 0.5, 0.9])


@query("p5_quantiles_hot", _QUANTILES)
def p5_quantiles_hot(spark, d):
    """The same with so low a bound that histograms decide also in small tables."""
    return hotkeys.quantiles(_terms(spark, d), "term", "docid", [0.25, 0.5, 0.9], hot_rows=100)


def _terms(spark, d):
    return load(spark, d, "postings").select(F.lower(F.trim("term")).alias("term"), "docid")
