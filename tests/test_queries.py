"""Every registered query against its SQL; those without SQL must run."""

import string
from collections import Counter

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from scriptorium.functions.stemmers import english
from scriptorium.queries import ORACLES, QUERIES
from scriptorium.queries.registry import TOKENS


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, data, name):
    assert compare(spark, data, QUERIES[name], ORACLES[name]) is None


def test_queries_without_sql():
    """Stemmers, the full tokenizer and snippets; the tests below and those of the functions check them."""
    assert set(QUERIES) - set(ORACLES) == {"stemmed_stats", "stem_conflation", "tagged_terms", "snippets_topk"}


def _postings(spark, data):
    """tf of every (document, term) of the plain tokenizer, by SQL."""
    sql = f"WITH {TOKENS} SELECT docid, term, tf FROM post"
    return connect(data).execute(sql).fetchall()


def test_stemmed_statistics(spark, data):
    cf, df = Counter(), {}
    for d, t, n in _postings(spark, data):
        cf[english(t)] += n
        df.setdefault(english(t), set()).add(d)
    got = {r["term"]: (r["cf"], r["df"]) for r in QUERIES["stemmed_stats"](spark, data).collect()}
    assert got == {t: (cf[t], len(df[t])) for t in cf}


def test_stem_classes(spark, data):
    forms: dict = {}
    for _, t, _ in _postings(spark, data):
        forms.setdefault(english(t), set()).add(t)
    got = {r["stem"]: r["terms"] for r in QUERIES["stem_conflation"](spark, data).collect()}
    assert got == {s: " ".join(sorted(x)) for s, x in forms.items() if len(x) > 1}


def test_tagged_terms_of_all_records(spark, data):
    texts = dict(connect(data).execute("SELECT doc_id, text FROM documents").fetchall())
    got = {r["docid"]: r for r in QUERIES["tagged_terms"](spark, data).collect()}
    assert set(got) == set(texts)
    bare = {d: t for d, t in texts.items() if t and not set(t) - set(string.ascii_letters + string.digits + " ")}
    for d, t in texts.items():
        if not t:
            assert (got[d]["terms"], got[d]["tags"]) == (0, 0)
        elif d in bare:
            assert (got[d]["terms"], got[d]["tags"]) == (len(t.split()), 0)
        else:
            assert got[d]["tags"] <= t.lower().count("<") and got[d]["terms"] <= len(t)


def test_snippets_hold_the_words(spark, data):
    texts = dict(connect(data).execute("SELECT doc_id, text FROM documents").fetchall())
    rows = QUERIES["snippets_topk"](spark, data).collect()
    assert 0 < len(rows) <= 10 and len({r["docid"] for r in rows}) == len(rows)
    for r in rows:
        words = texts[r["docid"]].lower().split()
        assert any(w in r["snippet"].lower() for w in ("harvest", "market")) and r["snippet_score"] > 0
        pieces = r["snippet"].lower().split(" ... ")
        assert all(" ".join(p.split()) in " ".join(words) for p in pieces)


def test_sketch_never_underestimates(spark, data):
    from scriptorium.operators import ngrams as N
    from scriptorium.operators.index import tokenized
    from scriptorium.session import load

    w = N.windows(tokenized(load(spark, data, "documents")))
    true = {r["feature"]: r["n"] for r in w.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    got = {r["feature"]: r["estimate"] for r in N.estimate(w, N.sketch(w, columns=512), columns=512).collect()}
    assert set(got) == set(true) and all(got[f] >= n for f, n in true.items()) and sum(got.values()) > sum(true.values())


def test_page_rank_of_all_links(spark, data):
    sql = "SELECT c_nationkey, s_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"
    links = Counter(x for x in connect(data).execute(sql).fetchall() if x[0] != x[1])
    nodes = [r[0] for r in connect(data).execute("SELECT n_nationkey FROM nation").fetchall()]
    out = Counter()
    for (a, _), n in links.items():
        out[a] += n
    score = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(4):
        lost = sum(s for v, s in score.items() if not out[v])
        new = dict.fromkeys(nodes, (0.15 + 0.85 * lost) / len(nodes))
        for (a, b), n in links.items():
            new[b] += 0.85 * score[a] * n / out[a]
        score = new
    assert {r["node"]: r["score"] for r in QUERIES["pagerank_k"](spark, data).collect()} == pytest.approx(score, abs=1e-6)


@pytest.mark.parametrize(("size", "missed"), [(10_000, 1.0), (100_000, 0.0)])
def test_alarm_rate_of_the_real_size(spark, tmp_path, size, missed):
    spark.createDataFrame([("q", d, -float(d)) for d in (1, 2, 3)], "qid string, document bigint, score double").write.parquet(f"{tmp_path}/scored_documents.parquet")
    spark.createDataFrame([("q", 0, "DOC3", 1)], "qid string, iter_no int, docno string, grade int").write.parquet(f"{tmp_path}/qrels.parquet")
    twice = spark.range(size).withColumnRenamed("id", "docid")
    twice.unionAll(twice).write.parquet(f"{tmp_path}/lengths.parquet")
    assert [tuple(r) for r in QUERIES["eval_mdfa"](spark, str(tmp_path)).collect()] == [("q", missed)]


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
