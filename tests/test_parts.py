from scriptorium.functions.stemmers import STEMMERS
from scriptorium.operators import parts as P


def test_side_tables(spark):
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "docid bigint, name string")
    lines = spark.createDataFrame([("a 0.5",), ("b  -1",), ("zz 3",), ("c",), ("",), (None,)], "value string")
    assert sorted((r["docid"], r["value"]) for r in P.values_from_lines(lines, names, "p").collect()) == [(1, 0.5), (2, -1.0)]
    assert P.values_from_lines(lines, names, "p", log=True).count() == 1
    flags = spark.createDataFrame([("a",), ("b false",), ("c true",)], "value string")
    assert sorted((r["docid"], r["value"]) for r in P.indicators_from_lines(flags, names, "i").collect()) == [(1, True), (2, False), (3, True)]


def test_filters(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "name string, x int")
    w = spark.createDataFrame([("a",), (None,), ("a",)], "name string")
    assert [r["x"] for r in P.only_named(d, w).collect()] == [1]
    assert sorted(r["x"] for r in P.only_named(d, w, keep=False).collect()) == [2, 3]
    c = spark.createDataFrame([("'The'", 2), ("the", 1), ("--", 9), ("a-b", 1)], "word string, n bigint")
    assert [tuple(r) for r in P.frequent_words(c, 2).collect()] == [("the", 3)]


def test_background_and_ranges(spark):
    s = spark.createDataFrame([("p", "t", 3, 2, 2)], "part string, term string, cf bigint, df bigint, max_tf bigint")
    assert tuple(P.background([s, s]).first()) == ("p", "t", 6, 4, 2)
    r = P.id_ranges(spark.range(100).withColumnRenamed("id", "docid"), 4).orderBy("first").collect()
    assert sum(x["documents"] for x in r) == 100 and all(a["last"] < b["first"] for a, b in zip(r, r[1:], strict=False))


def test_northern_stemmers():
    assert [STEMMERS["swedish"](w) for w in ("klostergården", "jaktkarlarne", "flickornas", "bakgrund")] == ["klostergård", "jaktkarl", "flick", "bakgrund"]
    assert [STEMMERS["danish"](w) for w in ("indtage", "undervisningen", "bestemmelser")] == ["indtag", "undervisning", "bestem"]
    assert [STEMMERS["norwegian"](w) for w in ("havnedistriktene", "opning", "havneeffektiviteten")] == ["havnedistrikt", "opning", "havneeffektivitet"]
