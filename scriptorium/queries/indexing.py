"""Queries of index building and its statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions.text import MONTHS, STOPWORDS, month_near_year, scrub_url, simple_tokens, stop_filter, year_of
from scriptorium.operators import index as I
from scriptorium.operators import ngrams as N
from scriptorium.queries.common import engine
from scriptorium.queries.registry import TOKENS, query
from scriptorium.session import load


def _docs(spark, d):
    return I.tokenized(load(spark, d, "documents"), name="name")


@query("tokenize_terms", f"WITH {TOKENS} SELECT docid, CAST(pos AS INTEGER) AS pos, term FROM tok")
def tokenize_terms(spark, d):
    return _docs(spark, d).select("docid", F.posexplode("tokens").alias("pos", "term"))


@query("term_stats", f"WITH {TOKENS} SELECT term, CAST(cf AS BIGINT) AS cf, df, max_tf FROM stat")
def term_stats(spark, d):
    return I.build_from(load(spark, d, "documents"), name="name").term_stats().select("term", "cf", "df", "max_tf")


@query(
    "field_stats",
    f"""WITH {TOKENS} SELECT CAST(sum(dl) AS BIGINT) AS collection_length, count(*) AS document_count, count(*) FILTER (WHERE dl > 0) AS nonzero_docs,
  CAST(max(dl) AS INTEGER) AS max_length, CAST(min(dl) AS INTEGER) AS min_length, round(avg(dl), 6) AS avg_length FROM len""",
)
def field_stats(spark, d):
    return I.build_from(load(spark, d, "documents"), name="name").field_stats().drop("field").withColumn("avg_length", F.round("avg_length", 6))


@query("postings_positions", f"WITH {TOKENS} SELECT docid, term, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM tok GROUP BY docid, term")
def postings_positions(spark, d):
    return I.build_from(load(spark, d, "documents"), name="name").postings.select("docid", "term", "tf", F.array_join("positions", " ").alias("positions"))


@query("count_postings", f"WITH {TOKENS} SELECT docid, term, tf FROM post")
def count_postings(spark, d):
    return I.count_postings(_docs(spark, d))


@query("forward_index", f"WITH {TOKENS} SELECT docid, count(*) AS terms, string_agg(term || ':' || tf, ' ' ORDER BY term COLLATE \"C\") AS line FROM post GROUP BY docid".replace(' COLLATE "C"', ""))
def forward_index(spark, d):
    f = engine(spark, d).index.forward()
    return f.select("docid", F.size("terms").cast("bigint").alias("terms"), F.array_join(F.transform("terms", lambda t: F.concat(t["term"], F.lit(":"), t["tf"].cast("string"))), " ").alias("line"))


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


@query("stop_filter", f"WITH {TOKENS} SELECT docid, CAST(pos AS INTEGER) AS pos, CASE WHEN term NOT IN ({_STOP}) THEN term END AS term FROM tok")
def stop_filtered(spark, d):
    t = _docs(spark, d).withColumn("tokens", stop_filter(F.col("tokens"), STOPWORDS))
    return t.select("docid", F.posexplode("tokens").alias("pos", "term"))


@query("merge_shards", f"WITH {TOKENS} SELECT term, CAST(cf AS BIGINT) AS cf, df, max_tf FROM stat")
def merge_shards(spark, d):
    x = _docs(spark, d)
    odd = F.xxhash64("docid") % 2 == 0
    return I.merge([I.build(x.where(odd)), I.build(x.where(~odd))]).term_stats().select("term", "cf", "df", "max_tf")


@query("dense_ids", "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS docid FROM documents")
def dense_ids(spark, d):
    return I.dense_ids(load(spark, d, "documents").select("doc_id"), "doc_id")


_TAGS = "(SELECT DISTINCT lower(t.name) AS name, doc_id AS docid, t.tok_begin AS begin, t.tok_end AS \"end\" FROM (SELECT doc_id, unnest(tags) AS t FROM documents) WHERE t.name IS NOT NULL AND t.tok_end > t.tok_begin)"


@query("tag_extents", f"SELECT * FROM {_TAGS}")
def tag_extents(spark, d):
    return I.tag_extents(load(spark, d, "documents"))


@query(
    "field_postings",
    f"""WITH {TOKENS}, e AS (SELECT * FROM {_TAGS} WHERE name = 'text')
SELECT tok.docid, term, count(DISTINCT pos) AS tf FROM tok JOIN e ON e.docid = tok.docid AND e.begin <= pos AND pos < e."end" GROUP BY tok.docid, term""",
)
def field_postings(spark, d):
    return I.field_postings(engine(spark, d).index, "text").select("docid", "term", "tf")


@query("field_lengths", f"SELECT doc_id AS docid, CAST(coalesce(n, 0) AS INTEGER) AS length FROM documents LEFT JOIN (SELECT docid, sum(\"end\" - begin) AS n FROM {_TAGS} WHERE name = 'title' GROUP BY docid) e ON e.docid = doc_id")
def field_lengths(spark, d):
    return I.field_lengths(engine(spark, d).index, "title").select("docid", "length")


@query(
    "ngram_threshold",
    f"""WITH {TOKENS}, g AS (SELECT a.docid, a.term || '~' || b.term AS feature FROM tok a JOIN tok b ON a.docid = b.docid AND b.pos = a.pos + 1)
SELECT feature, count(*) AS cf, count(DISTINCT docid) AS df FROM g GROUP BY feature HAVING count(DISTINCT docid) >= 5""",
)
def ngram_threshold(spark, d):
    return N.threshold(N.windows(_docs(spark, d)), 5)


@query(
    "ngram_unordered",
    f"""WITH {TOKENS}, g AS (SELECT a.docid, least(a.term, b.term) || '~' || greatest(a.term, b.term) AS feature FROM tok a JOIN tok b ON a.docid = b.docid AND b.pos > a.pos AND b.pos - a.pos < 4)
SELECT feature, count(*) AS cf, count(DISTINCT docid) AS df FROM g GROUP BY feature HAVING count(*) >= 20""",
)
def ngram_unordered(spark, d):
    return N.threshold(N.windows(_docs(spark, d), 2, 4, ordered=False), 20, by_documents=False)


@query("ngram_sketch", f"WITH {TOKENS} SELECT a.term || '~' || b.term AS feature, count(*) AS estimate FROM tok a JOIN tok b ON a.docid = b.docid AND b.pos = a.pos + 1 GROUP BY ALL")
def ngram_sketch(spark, d):
    """With so many cells that estimates are the true counts here; a test has few cells."""
    w = N.windows(_docs(spark, d))
    return N.estimate(w, N.sketch(w, columns=1 << 26), columns=1 << 26)


@query(
    "vocab_edit_distance",
    f"""WITH {TOKENS}, v AS (SELECT term, length(term) AS n FROM stat)
SELECT a.term AS a, b.term AS b, CAST(levenshtein(a.term, b.term) AS INTEGER) AS distance FROM v a JOIN v b ON b.n BETWEEN a.n - 1 AND a.n + 1 AND a.term < b.term WHERE levenshtein(a.term, b.term) <= 1""",
)
def vocab_edit_distance(spark, d):
    """All pairs of the whole vocabulary."""
    return N.close_pairs(I.build_from(load(spark, d, "documents"), name="name").term_stats(), 1)


@query("url_scrub", "SELECT doc_id, regexp_replace(regexp_replace(lower(trim(metadata['url'])), '#$', ''), '/$', '') AS url FROM documents WHERE metadata['url'] IS NOT NULL")
def url_scrub(spark, d):
    return load(spark, d, "documents").select("doc_id", scrub_url(F.col("metadata")["url"]).alias("url")).where(F.col("url").isNotNull())


_NAMES = "|".join(MONTHS)


@query(
    "text_years",
    rf"""SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(?:^|[^0-9])([12][0-9]{{3}})(?:[^0-9]|$)', 1), '') AS INTEGER) AS year,
  coalesce(nullif(regexp_extract(lower(text), '({_NAMES})\W+(?:\w+\W+){{0,2}}[12][0-9]{{3}}(?:[^0-9]|$)', 1), ''), nullif(regexp_extract(lower(text), '(?:^|[^0-9])[12][0-9]{{3}}\W+(?:\w+\W+){{0,2}}({_NAMES})', 1), '')) AS month FROM documents""".replace("\\\\", "\\"),
)
def text_years(spark, d):
    return load(spark, d, "documents").select("doc_id", year_of(F.col("text")).alias("year"), month_near_year(F.col("text")).alias("month"))


@query("topic_tokens", "SELECT qid, lower(array_to_string(regexp_extract_all(regexp_replace(coalesce(title, ''), '<[^>]*>', ' ', 'g'), '[a-zA-Z0-9]+'), ' ')) AS words FROM topics")
def topic_tokens(spark, d):
    return load(spark, d, "topics").select("qid", F.array_join(simple_tokens(F.col("title")), " ").alias("words"))
