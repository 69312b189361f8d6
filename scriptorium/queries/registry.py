"""Where queries register, and pieces of SQL they share."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Tokens of documents.text with positions, as common table expressions.
TOKENS = """toks AS (
  SELECT doc_id AS docid, regexp_extract_all(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '[a-zA-Z0-9]+') AS x FROM documents),
tok AS (SELECT docid, lower(t) AS term, pos FROM (SELECT docid, unnest(x) AS t, unnest(range(len(x))) AS pos FROM toks)),
len AS (SELECT docid, len(x) AS dl FROM toks),
col AS (SELECT count(*) AS n, sum(dl) AS c, avg(dl) AS avgdl FROM len),
post AS (SELECT docid, term, count(*) AS tf FROM tok GROUP BY docid, term),
stat AS (SELECT term, sum(tf) AS cf, count(*) AS df, max(tf) AS max_tf FROM post GROUP BY term)"""
