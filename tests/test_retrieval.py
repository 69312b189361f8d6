import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import scoring as S
from scriptorium.functions import windows as W
from scriptorium.operators.index import Index, build, merge, tokenized, typed_fields
from scriptorium.operators.retrieval import Engine

POSTINGS = [("a", 1, [1, 2, 3]), ("a", 3, [1]), ("a", 5, [1]), ("b", 1, [2, 4]), ("b", 2, [1]), ("b", 3, [4]), ("b", 18, [9])]


@pytest.fixture(scope="module")
def engine(spark):
    p = spark.createDataFrame([("postings", t, d, len(x), x, 100) for t, d, x in POSTINGS], "part string, term string, docid bigint, tf bigint, positions array<int>, length int")
    n = spark.range(20).select(F.lit("document").alias("field"), F.col("id").alias("docid"), F.lit(100).alias("length"))
    names = spark.range(20).select(F.col("id").alias("docid"), F.concat(F.lit("DOC"), F.col("id").cast("string")).alias("name"))
    e = spark.createDataFrame([("title", 1, 1, 3), ("title", 3, 0, 2)], "name string, docid bigint, begin int, end int")
    f = typed_fields(spark.createDataFrame([(i, i * 10, f"n{i}") for i in range(10)], "doc_id bigint, size bigint, label string"), {"size": "long", "label": "string"})
    return Engine(Index(p, n, names, e, f), priors=spark.createDataFrame([("p", 1, -3.0), ("p", 7, -0.5)], "part string, docid bigint, value double"), indicators=spark.createDataFrame([("good", 3, True)], "part string, docid bigint, value boolean"))


def got(df):
    return [(r["docid"], round(r["score"], 6)) for r in df.orderBy("rank").collect()]


GOLD = [(1, -5.548388), (3, -5.819614), (2, -5.937809), (5, -5.937809), (18, -5.937809)]


def test_dirichlet_golden(engine):
    assert got(engine.search("#combine( a b )", 5)) == GOLD
    assert got(engine.search_batch({"q": "a b"}, 5)) == GOLD


@pytest.mark.parametrize("q", ["a b", "#sdm( a b )", "#combine:0=3:1=1( a #uw:4( a b ) )", "#combine( #jm( a ) #jm( b ) )", "#combine( #bm25( a ) #pl2( b ) #inl2( a ) #bil2( b ) )", "#fdm( a b )", "#wsdm( a b )", "#pdfr( a b )", "#combine( zzz a )", "#combine( #dirichlet:mu=10( a ) #dirichlet:mu=2000( b ) )", "#combine( #dirichlet:mu=0.5( a ) #bm25( b ) )", "#require( a #combine( b ) )"])
def test_batch_equals_tree(engine, q):
    assert got(engine.search_batch({"q": q}, 20)) == got(engine.search(q, 20))


def test_batch_of_all_kinds(engine):
    """Weighted sums and conditions in one batch; each as if alone."""
    q = {"flat": "a b", "other": "#combine:0=2:1=1( #dirichlet:mu=3( b ) a )", "cond": "#require( b #combine( a ) )", "none": "zzz"}
    r = engine.search_batch(q, 20)
    for k, t in q.items():
        assert got(r.where(F.col("qid") == k)) == got(engine.search(t, 20))
    assert engine.search_batch({}, 5).count() == 0


def test_relevance_weights(engine, spark):
    rel = spark.createDataFrame([(1,), (3,), (18,), (3,)], "docid bigint")
    tree = engine.with_relevance("#combine( #bm25rf( a ) #bm25rf( b ) )", rel)
    assert [(n.get("R"), n.get("rt")) for n in tree.children] == [(3, 2), (3, 3)]
    x = dict(got(engine.search(tree, 20)))
    w = lambda rt, ft: 0.33 * math.log(((rt + 0.5) / (3 - rt + 0.5)) / ((ft - rt + 0.5) / (20 - ft - 3 + rt + 0.5)))
    assert x[5] == pytest.approx(w(2, 3) / 2, abs=1e-6) and x[2] == pytest.approx(w(3, 4) / 2, abs=1e-6)


def test_strategies(engine, spark):
    p = engine.two_pass_passages("a", "b", 10, 5, 50, working=1)
    assert {r["docid"] for r in p.collect()} == {1}
    assert got(engine.nonempty("a b", 5)) == got(engine.search("a b", 5))
    assert engine.expand("rm3", {"q": "a"}, 5, fb_docs=2, fb_terms=3, stopwords=[]).count() > 0
    assert {r["docid"] for r in engine.expand("rm1", {"q": "a"}, 9, fb_docs=2, fb_terms=3, stopwords=[]).collect()} >= {1, 2, 3, 18}
    with pytest.raises(ValueError):
        engine.expand("none", {"q": "a"})


def test_passage_filter(engine):
    """In a passage only extents that lie in it from begin to end; in a document, all."""
    assert engine.node_statistics("#passagefilter( #extents:title:part=extents() )") == (2, 2, 1)
    r = {(x["docid"], x["begin"]): x["score"] for x in engine.passages("#combine:norm=false( #log-count( #passagefilter( #extents:title:part=extents() ) ) )", 2, 2, 500).collect()}
    assert r[3, 0] == 0.0 and all(v < 0 for k, v in r.items() if k != (3, 0))


def ids(df):
    return sorted(r["docid"] for r in df.collect())


def test_conditions(engine):
    assert ids(engine.boolean("#all( a b )")) == [1, 3]
    assert ids(engine.boolean("#any( a b )")) == [1, 2, 3, 5, 18]
    assert ids(engine.boolean("#bnot( a )")) == sorted(set(range(20)) - {1, 3, 5})
    assert ids(engine.search("#require( b #combine( a ) )")) == [1, 3]
    assert ids(engine.search("#reject( b #combine( a ) )")) == [5]
    assert ids(engine.boolean("#between( size 20 50 )")) == [3, 4]
    assert ids(engine.boolean("#greater( size 70 )")) == [8, 9]
    assert ids(engine.boolean("#less( label n2 )")) == [0, 1]
    assert ids(engine.boolean("#equals( label n4 )")) == [4]
    assert ids(engine.boolean("#all( a #greater( size 20 ) )")) == [3, 5]
    assert ids(engine.boolean("#indicator:good()")) == [3]
    assert ids(engine.boolean("#threshold:raw=-5.9( #combine( a b ) )")) == [1, 3]


def test_counts_and_fields(engine):
    assert engine.node_statistics("#od:1( a b )") == (2, 1, 2)
    assert engine.node_statistics("#uw:4( a b )") == (4, 2, 3)
    assert engine.node_statistics("#syn( a b )") == (10, 5, 5)
    assert engine.node_statistics("a.title") == (3, 2, 2)
    assert engine.node_statistics("zzz") == (0, 0, 0)
    assert ids(engine.boolean("#inside( a #extents:title:part=extents() )")) == [1, 3]


def test_nested_filter_and_scores(engine):
    r = dict(got(engine.search("#combine:norm=false( #require( a b ) b )", 20)))
    assert r[2] < -20 < r[3]
    assert dict(got(engine.search("#boost:beta=2( a )")))[5] == 2.0
    assert dict(got(engine.search("#prior:p()", 20))) == {7: -0.5, 1: -3.0}
    assert dict(got(engine.search("#scale:2( #bm25( a ) )")))[5] == pytest.approx(2 * dict(got(engine.search("#bm25( a )")))[5], abs=2e-6)
    x = engine.search("#wsum:0=0.5:1=0.5( a b )", 1).first()["score"]
    s = [math.log((tf + 1500 * cf / 2000) / 1600) for tf, cf in ((3, 5), (2, 5))]
    assert x == pytest.approx(math.log(sum(0.5 * math.exp(v) for v in s)))


def test_passages_working_sets_two_pass(engine, spark):
    p = engine.passages("a b", 10, 5, 100)
    assert p.where("docid = 1").count() == 19 and p.where("end > 100").count() == 0
    assert engine.passages("a b", 10, 5, 100, best_only=True).where("docid = 18").first()["begin"] == 0
    ws = spark.createDataFrame([(3,), (18,)], "docid bigint")
    assert ids(engine.search("a b", working_set=ws)) == [3, 18]
    assert ids(engine.two_pass("a", "b", working=2)) == [1, 3]
    with pytest.raises(ValueError):
        engine.passages("a", 0, 5)


def test_explain_names_leaves(engine):
    r = engine.search("a b", 1, explain=True).first()
    assert [(x["node"], x["tf"]) for x in r["leaves"]] == [("#dirichlet( #text:a() )", 3), ("#dirichlet( #text:b() )", 2)]
    assert r["name"] == "DOC1"


def test_feedback(engine):
    t = {r["term"]: r["weight"] for r in engine.feedback_terms({"q": "a"}, 3, 10, stopwords=[]).collect()}
    post = [math.log((tf + 3.75) / 1600) for tf in (3, 1, 1)]
    z = sum(math.exp(x) for x in post)
    assert t == {"b": pytest.approx((math.exp(post[0]) / z * 0.02 + math.exp(post[1]) / z * 0.01) / 3)}


def test_scorers_golden(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("x")).first()["x"]
    # 100 documents of 50 words on average; (df, b, k), idf, (tf, length), score
    for (df, b, k), idf, (tf, dl), score in (((0, 0.75, 1.2), 5.29832, (5, 100), 8.20866), ((5, 0.75, 1.2), 2.90042, (12, 85), 5.53660), ((20, 0.3, 2.0), 1.58474, (15, 200), 3.79327)):
        assert v(S.bm25_idf(df, 100)) == pytest.approx(idf, abs=1e-4)
        assert v(S.bm25(tf, dl, df, 100, 50.0, b, k)) == pytest.approx(score, abs=1e-4)
    # one occurrence each in documents of 10, 11 and 14 words, of 60 documents with 100 words, cf 19, c 2
    lengths, mean = (10, 11, 14), 100 / 60
    for f, want in (
        (lambda dl: S.pl2(1, dl, 19, 60, mean, 2.0), (0.502788, 0.463434, 0.364418)),
        (lambda dl: S.inl2(1, dl, 0, 60, mean, 2.0), (2.03281, 1.91526, 1.63250)),
        (lambda dl: S.bil2(1, dl, 0, 60, mean, 2.0), (2.788971, 3.012237, 3.599482)),
    ):
        assert [v(f(dl)) for dl in lengths] == pytest.approx(want, abs=1e-5)
    assert v(S.pl2(0, 5, 19, 60, mean, 2.0)) == v(S.inl2(0, 5, 19, 60, mean, 2.0)) == v(S.bil2(0, 5, 19, 60, mean, 2.0)) == 0.0
    assert v(S.bm25(0, 10, 1, 10, 10)) == 0.0
    assert v(S.jelinek_mercer(0, 0, 0, 100)) == pytest.approx(math.log(0.5 * 0.005))
    assert v(S.bil2(1, 1, 1, 10, 5)) == 0.0
    assert v(S.log_not(F.lit(math.log(0.25)))) == pytest.approx(math.log(0.75))
    assert v(S.log_not(F.lit(0.5))) is None


def _ordered(lists, width):
    out = []
    for b, e in lists[0]:
        end = e
        for x in lists[1:]:
            q = min((y for y in x if y[0] >= end), default=None)
            if q is None or (width >= 0 and q[0] - end >= width):
                break
            end = q[1]
        else:
            out.append((b, end))
    return out


def _unordered(lists, width):
    out = []
    for p in sorted({b for x in lists for b, _ in x}):
        first = [min((y for y in x if y[0] >= p), default=None) for x in lists]
        if all(first):
            end = max(y[1] for y in first)
            if width < 0 or end - p <= width:
                out.append((p, end))
    return out


def test_windows_against_loops(spark):
    rng = random.Random(7)
    rows = [[sorted(rng.sample(range(12), rng.randint(0, 5))) for _ in range(3)] for _ in range(60)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<int>, b array<int>, c array<int>")
    for width, k in itertools.product((-1, 1, 2, 6), (2, 3)):
        cols = [W.unit(F.col(c)) for c in "abc"[:k]]
        x = df.select("i", W.ordered(cols, width).alias("o"), W.unordered(cols, width).alias("u")).collect()
        for r in x:
            lists = [[(p, p + 1) for p in y] for y in rows[r["i"]][:k]]
            assert [tuple(y) for y in r["o"]] == _ordered(lists, width)
            assert [tuple(y) for y in r["u"]] == _unordered(lists, width)


def test_index_edge_cases(spark):
    docs = spark.createDataFrame([(1, "A b a"), (2, None), (3, ""), (None, "x"), (4, "<b>b</b> Ünïx 7")], "doc_id bigint, text string")
    i = build(tokenized(docs))
    got_ = {(r["docid"], r["term"]): (r["tf"], list(r["positions"]), r["length"]) for r in i.postings.collect()}
    assert got_ == {(1, "a"): (2, [0, 2], 3), (1, "b"): (1, [1], 3), (4, "b"): (1, [0], 4), (4, "n"): (1, [1], 4), (4, "x"): (1, [2], 4), (4, "7"): (1, [3], 4)}
    assert {r["docid"]: r["length"] for r in i.lengths.collect()} == {1: 3, 2: 0, 3: 0, 4: 4}
    none = build(tokenized(docs.where("doc_id = 99")))
    assert none.term_stats().count() == 0 and Engine(none).search("a").count() == 0
    m = merge([i, i], renumber=True)
    assert m.lengths.count() == 8 and m.term_stats().where("term = 'b'").first()["df"] == 4


def test_save_and_open(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id bigint, text string")
    i = build(tokenized(docs))
    i.save(str(tmp_path / "i"))
    j = Index.open(spark, str(tmp_path / "i"))
    assert j.extents is None
    assert got(Engine(j).search("b", 5)) == got(Engine(i).search("b", 5))


def test_groups_and_background_statistics(spark):
    from scriptorium.operators.retrieval import Group

    docs = spark.createDataFrame([(i, " ".join(["a"] * (i % 3) + ["b", "c"] * (i % 2))) for i in range(12)], "doc_id bigint, text string")
    part = lambda c: Engine(build(tokenized(docs.where(c))))
    whole, g = part("true"), Group({"x": part("doc_id < 5"), "y": part("doc_id >= 5")})
    assert got(g.merged().search("a b", 5)) == got(whole.search("a b", 5))
    all_scores = dict(got(whole.search("a b", 50)))
    g.engines["all"] = whole
    assert all(all_scores[d] == s for d, s in got(g.search("x", "a b", statistics_of="all")))
    assert got(g.search("x", "a b", scorer="bm25")) != got(g.search("x", "a b", statistics_of="all", scorer="bm25"))


def test_stored_windows_and_fields(spark):
    from dataclasses import replace

    from scriptorium.operators.index import field_postings
    from scriptorium.operators.ngrams import window_postings, windows

    docs = spark.createDataFrame([(1, "a b a b"), (2, "b a c"), (3, "a c b")], "doc_id bigint, text string")
    t = tokenized(docs)
    i = replace(build(t), extents=spark.createDataFrame([("title", 1, 0, 2), ("title", 3, 2, 3)], "name string, docid bigint, begin int, end int"))
    p = i.postings.unionByName(window_postings(windows(t), i.lengths, "od1")).unionByName(field_postings(i, "title"))
    plain, ready = Engine(i), Engine(replace(i, postings=p), windowParts={"ordered:1:2": "od1"}, fieldParts=["title"])
    for q in ("#od:1( a b )", "#combine( a.title b )", "#sdm( a b )"):
        assert got(ready.search(q)) == got(plain.search(q))
    assert "part=od1" in str(ready.plan("#od:1( a b )")) and "part=field.title" in str(ready.plan("a.title"))
    e = Engine(replace(i, postings=p))
    assert e.search("#fieldrm:fields=title( a b )").count() == 2


def test_operators_of_users(engine):
    from scriptorium.plans import rewrites as R

    @R.operator("twice", "counts")
    def twice(plan, n, x):
        return plan.count(n.children[0], x) * 2

    @R.operator("first", "extents")
    def first(plan, n, x):
        return F.slice(plan.extents(n.children[0], x), 1, 1)

    @R.operator("long", "bool")
    def long(plan, n, x):
        return x.length > int(n.get("default"))

    @R.operator("half", "score")
    def half(plan, n, x):
        return plan.score(n.children[0], x) / 2

    try:
        assert engine.node_statistics("#twice( a )") == (10, 3, 6)
        assert engine.node_statistics("#first( a )") == (3, 3, 1)
        assert ids(engine.boolean("#all( a #long:50() )")) == [1, 3, 5] and ids(engine.boolean("#all( a #long:100() )")) == []
        assert dict(got(engine.search("#half( #bm25( a ) )")))[5] == pytest.approx(dict(got(engine.search("#bm25( a )")))[5] / 2, abs=2e-6)
        with pytest.raises(ValueError):
            R.operator("x", "nothing")
    finally:
        for k in ("twice", "first", "long", "half"):
            R.CUSTOM.pop(k, None)
