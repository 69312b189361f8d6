"""The index over ``documents`` that several queries share."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from scriptorium.operators.index import Index, build_from, field_postings, tag_extents, typed_fields
from scriptorium.operators.retrieval import Engine
from scriptorium.session import durable, load

_KEPT: dict = {}


def engine(spark, d) -> Engine:
    """An engine over the texts of ``documents``; the tables are written once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _KEPT:
        docs = load(spark, d, "documents")
        i = build_from(docs, name="name")
        fields = typed_fields(docs.select("doc_id", "n_chars", "lang", "crawled_at"), {"n_chars": "long", "lang": "string", "crawled_at": "date"})
        lengths = durable(i.lengths, "lengths")
        i = Index(durable(i.postings.repartitionByRange("term").sortWithinPartitions("term"), "postings"), lengths, durable(i.names, "names"), durable(tag_extents(docs), "extents"), fields)
        priors = lengths.select(F.lit("long").alias("part"), "docid", F.when(F.col("length") > 150, -0.5).otherwise(-1.5).alias("value")).where("length > 60")
        _KEPT[key] = Engine(i, priors)
    return _KEPT[key]


def field_engine(spark, d) -> Engine:
    """The same with the postings of the fields ``title`` and ``text`` beside."""
    key = (spark.sparkContext.applicationId, d, "fields")
    if key not in _KEPT:
        i = engine(spark, d).index
        p = i.postings
        for f in ("title", "text"):
            p = p.unionByName(field_postings(i, f))
        _KEPT[key] = Engine(replace(i, postings=durable(p, "postings")))
    return _KEPT[key]


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})
