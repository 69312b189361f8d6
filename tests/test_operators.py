import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.text import join_url
from scriptorium.operators import evaluation as E
from scriptorium.operators import hotkeys, links, ngrams
from scriptorium.operators.index import dense_ids


def test_quantiles_hot_and_cold(spark):
    rng = random.Random(3)
    rows = [("hot", rng.randint(-(2**62), 2**62)) for _ in range(3000)] + [("hot", 5)] * 2000 + [("c", v) for v in (3, 1, 2)] + [(None, 1), ("n", None)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(5)
    want = {}
    by = defaultdict(list)
    for k, v in rows:
        if k is not None and v is not None:
            by[k].append(v)
    for k, v in by.items():
        v.sort()
        for p in (0.0, 0.25, 0.5, 1.0):
            want[k, p] = v[max(1, math.ceil(round(p * len(v), 9))) - 1]
    got = {(r["k"], r["p"]): r["v"] for r in hotkeys.quantiles(df, "k", "v", [0.0, 0.25, 0.5, 1.0], hot_rows=100).collect()}
    assert got == want


def test_heaviest_record_edges(spark):
    schema = "term string, docid bigint, positions array<int>, extra string"
    rows = [(" A ", 2, [1, 2], "x"), ("a", 1, [5, 5, 6], "x"), ("a", 1, [6], "y"), (None, 9, [1], ""), ("a", None, [1, 2, 3], ""), ("b", 7, None, ""), ("b", 3, [], ""), ("c", 4, [None], "")]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, hotkeys.heaviest_record(df, 0.2).collect())) == [("a", 1), ("b", 3)]
    assert hotkeys.heaviest_record(df.where("docid > 100")).count() == 0


def test_edit_distance_pairs(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(60)} | {"", "harvest", "harvests", "harvset"})

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    df = spark.createDataFrame([(w,) for w in [*words, None]], "term string")
    for k in (1, 2):
        got = {tuple(r) for r in ngrams.close_pairs(df, k).collect()}
        assert got == {(a, b, lev(a, b)) for a in words for b in words if a < b and lev(a, b) <= k}


def test_windows_of_two_documents(spark):
    t = "a b c d e f g h i".split()
    df = spark.createDataFrame([(1, t), (2, t)], "docid bigint, tokens array<string>")
    assert ngrams.windows(df, 2, 2).groupBy("docid").count().collect()[0]["count"] == 15
    u = ngrams.windows(df, 2, 3, ordered=False)
    assert u.where("docid = 1").count() == 15
    assert ngrams.frequent_windows(df, 2, 1, 2).count() == 16
    assert ngrams.threshold(ngrams.windows(df, 2, 1), 3).count() == 0
    s = ngrams.estimate(u, ngrams.sketch(u, 3, 64), 3, 64)
    assert s.where("estimate < 2").count() == 0


def _page_rank(edges, n, lam, rounds):
    out = defaultdict(list)
    for s, d in edges:
        if s != d and d in range(n):
            out[s].append(d)
    score = [1.0 / n] * n
    for _ in range(rounds):
        new = [(lam + (1 - lam) * sum(score[v] for v in range(n) if not out[v])) / n] * n
        for s, ds in out.items():
            for d in ds:
                new[d] += (1 - lam) * score[s] / len(ds)
        score = new
    return score


def test_pagerank(spark):
    edges = [(0, 1), (0, 1), (0, 0), (1, 2), (2, 0), (3, 0), (3, 9), (4, 2), (4, 3)]
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r["node"]: r["score"] for r in links.pagerank(e, spark.range(6).withColumnRenamed("id", "node"), 0.5, 0.0, 10).collect()}
    want = _page_rank(edges, 6, 0.5, 10)
    assert [got[i] for i in range(6)] == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(1.0)
    assert links.pagerank(e, spark.range(0).withColumnRenamed("id", "node")).count() == 0


def test_link_extraction(spark):
    html = """<base href="http://h.example/x/y.html"><a href='b.html'>to <b>b</b>
 now</a> <A HREF="/c#">c</A><a href="http://Other.example:80/" rel="nofollow">o</a><a href="#top">t</a><a href="mailto:x@y">m</a><a name=q>n</a>"""
    df = spark.createDataFrame([(1, "http://h.example/p.html", html), (2, None, html), (3, "http://h.example/x/b.html", None)], "page_id bigint, url string, html string")
    x = links.extract(df)
    assert [(r["dest_url"], r["anchor"], r["nofollow"]) for r in x.collect()] == [("http://h.example/x/b.html", "to b now", False), ("http://h.example/c", "c", False), ("http://other.example", "o", True)]
    assert links.extract(df, drop_nofollow=True).count() == 2
    assert sorted(r["dest"] for r in links.resolve(x, df).collect()) == ["3", "ext:http://h.example/c", "ext:http://other.example"]
    assert links.anchor_documents(x).where("links = 1 and part = 0").count() == 3


def _run(spark, rows):
    return spark.createDataFrame(rows, "qid string, docno string, rank int")


def test_metrics_by_hand(spark):
    run = _run(spark, [("q", d, i + 1) for i, d in enumerate("abcde")] + [("z", "a", 1), ("only-run", "a", 1)])
    qrels = E.judgments(spark.createDataFrame([("q", "a", 1), ("q", "c", 2), ("q", "x", 1), ("q", "b", 0), ("q", "b", -1), ("q", "d", None), ("z", "b", 0)], "qid string, docno string, grade int"))
    r = {x["qid"]: x for x in E.evaluate(run, qrels, 3).collect()}
    assert set(r) == {"q", "z"}
    q = r["q"]
    assert (q["num_ret"], q["num_rel"], q["num_rel_ret"], q["unjudged_k"]) == (5, 3, 2, 0)
    assert q["ap"] == pytest.approx((1 + 2 / 3) / 3)
    assert q["p"] == pytest.approx(2 / 3) and q["recall"] == pytest.approx(2 / 3) and q["rprec"] == pytest.approx(2 / 3) and q["rr"] == 1.0
    dcg = 1 / math.log(2) + 3 / math.log(4)
    assert q["ndcg"] == pytest.approx(dcg / (3 / math.log(2) + 1 / math.log(3) + 1 / math.log(4)))
    assert q["err_k"] == pytest.approx(1 / 16 + 15 / 16 * 3 / 16 / 3)
    assert q["bpref"] == pytest.approx(1 / 3) and q["jap"] == pytest.approx((1 + 2 / 3) / 3)
    assert r["z"]["ap"] == 0.0 and r["z"]["recall"] == 0.0
    assert E.aggregate(E.evaluate(run, qrels), ["ap"], "sum").first()["ap"] == pytest.approx(q["ap"])


def test_average_precision_golden(spark):
    """Ten answers in order of their numbers; which of them are relevant, and the average precision."""
    cases = {"1": ("01234", 1.000), "2": ("56789", 0.354), "3": ("01234", 1.000), "4": ("014589", 0.737)}
    judged = [(q, d, int(d in rel)) for q, (rel, _) in cases.items() for d in "0123456789" if q != "1" or d in rel]
    r = E.evaluate(_run(spark, [(q, d, int(d) + 1) for q in cases for d in "0123456789"]), E.judgments(spark.createDataFrame(judged, "qid string, docno string, grade int")))
    assert {x["qid"]: round(x["ap"], 3) for x in r.collect()} == {q: v for q, (_, v) in cases.items()}


#: Twelve pages: whom each links to, self-links, repeated links and addresses of no page included; and
#: their ranks after ten rounds with lambda 0.5. Fixed values.
PAGES = {0: "0 1 3 5 7 9", 1: "0 2 4 6 8 ext.100 ext.101", 2: "0 1 2 3 4 5", 3: "5 6 7 8 9", 4: "0 1 1 2 3 5 8", 5: "5 5 5 5 5", 6: "0 0 0 0 0", 7: "0 1 3 5 7 9", 8: "0 2 4 6 8", 9: "", 10: "", 11: "0 1 2"}
RANKS = (0.140445, 0.100920, 0.084882, 0.086737, 0.079188, 0.095410, 0.079373, 0.073878, 0.075582, 0.081266, 0.051160, 0.051160)


def _web(spark):
    rows = [(i, f"http://web.example/{i}", " ".join(f'<a href="/{x}">to {x}</a>' for x in to.split())) for i, to in PAGES.items()]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_page_rank_golden(spark):
    web = _web(spark)
    e = links.resolve(links.extract(web), web).select(F.col("page").cast("string").alias("src"), F.col("dest").alias("dst"))
    r = links.pagerank(e, web.select(F.col("page_id").cast("string").alias("node")), 0.5, 1e-9, 10)
    assert {int(x["node"]): x["score"] for x in r.collect()} == pytest.approx(dict(enumerate(RANKS)), abs=2e-6)
    lines = [x["value"].split() for x in links.rank_lines(r).collect()]
    assert [int(x[0]) for x in lines[:4]] == [0, 1, 5, 3] and float(lines[0][1]) == pytest.approx(RANKS[0], abs=2e-6)


def test_link_tables(spark):
    web = _web(spark)
    x = links.extract(web)
    t = links.typed(x)
    assert sorted((r["src"], r["pos"]) for r in t.collect()) == sorted((i, k) for i, to in PAGES.items() for k in range(len(to.split())))
    blocks = {b["value"].split("\n")[0]: b["value"].split("\n") for b in links.harvest_lines(x, web).collect()}
    to = [d for p in PAGES.values() for d in p.split()]
    assert {k: v[2] for k, v in blocks.items()} == {f"DOCNO={d}": f"LINKS={to.count(d)}" for d in set(to) if d.isdigit()}
    assert blocks["DOCNO=9"][1] == "http://web.example/9" and len(blocks["DOCNO=9"]) == 3 + 3 * to.count("9") and blocks["DOCNO=9"][3:6] == ["LINKDOCNO=0", "LINKFROM=http://web.example/0", "TEXT=to 9"]


def test_anchors_of_famous_pages(spark):
    rows = [(i, "http://a.example", "http://b.example" if i % 3 else "http://c.example", f"word{i}", False) for i in range(300)]
    x = spark.createDataFrame(rows, "page bigint, src_url string, dest_url string, anchor string, nofollow boolean")
    whole = {r["dest_url"]: (r["links"], r["text"]) for r in links.anchor_documents(x).collect()}
    parts = links.anchor_documents(x, most=20).collect()
    assert max(r["links"] for r in parts) <= 20 and len({(r["dest_url"], r["part"]) for r in parts}) == len(parts)
    for dest, (n, text) in whole.items():
        mine = [r for r in parts if r["dest_url"] == dest]
        assert sum(r["links"] for r in mine) == n and sorted(w for r in mine for w in r["text"].split()) == sorted(text.split())


@pytest.mark.parametrize(
    ("base", "link", "want"),
    [
        ("http://h.com/a/b.html", "?q=1", "http://h.com/a/b.html?q=1"), ("http://h.com/a", "../../x", "http://h.com/x"), ("http://h.com/a/b/c/d/e/f/g.html", "../../../../../../x.html", "http://h.com/x.html"), ("http://h.com/a", "tel:12", None),
        ("http://h.com", "x/y#z", "http://h.com/x/y"), ("http://h.com/a/", "./b/./c/..", "http://h.com/a/b/"), ("https://h.com/a", "//o.com/../b", "https://o.com/b"), ("http://h.com/a", "MAILTO:x@y", None), ("http://h.com/a?b/c", "d", "http://h.com/d"), (None, "x", None), ("http://h.com/a", "", None),
    ],
)
def test_addresses(spark, base, link, want):
    df = spark.createDataFrame([(base, link)], "b string, l string")
    assert df.select(join_url(F.col("b"), F.col("l")).alias("x")).first()["x"] == want


def test_streamed_counts(spark, tmp_path):
    from scriptorium.streaming.incremental import streamed_term_counts

    rows = [(1, "a b a"), (2, "a"), (None, "a"), (3, None), (4, "B b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/in")
    s = streamed_term_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = s.writeStream.format("memory").queryName("streamed_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["term"]: (r["cf"], r["df"]) for r in spark.table("streamed_counts").collect()} == {"a": (3, 2), "b": (3, 2)}


def test_comparisons():
    x = [(0.1, 0.3), (0.2, 0.25), (0.3, 0.5), (0.4, 0.4), (0.2, 0.35)]
    d = [b - a for a, b in x]
    m = sum(d) / 5
    t = m / math.sqrt(sum((y - m) ** 2 for y in d) / 4 / 5)
    assert E._t_p(t, 4) == pytest.approx(E.t_test(x))
    assert E._t_p(2.776445, 4) == pytest.approx(0.05, abs=1e-6)
    assert E.sign_test(x) == pytest.approx(0.125)
    assert E.randomized_test(x, 2000) < 0.1
    assert E.t_test([(1.0, 1.0)] * 3) == 1.0
    assert E.supported_boost([(0.1, 0.3)] * 2 + [(0.1, 0.31)] * 4) > 2.5
    assert E.supported_boost([(0.3, 0.1)] * 3) == 0.0
    assert E.compare(x)["better"] == 4


def test_dense_ids(spark):
    df = spark.createDataFrame([(f"n{i:03d}",) for i in range(57)], "name string").repartition(6)
    assert [(r["name"], r["docid"]) for r in dense_ids(df, "name").orderBy("name").collect()] == [(f"n{i:03d}", i) for i in range(57)]
    assert dense_ids(df.where("name is null"), "name").count() == 0
    assert F is not None
