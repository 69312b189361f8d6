"""Stemmers of further languages, leaves looked up elsewhere, grids in one job, the command line."""

import json
import string

import pytest
from hypothesis import given
from hypothesis import strategies as st

from scriptorium.functions import stemmers, text
from scriptorium.functions.stemmers_world import WORLD, inflections, with_dictionary
from scriptorium.operators.index import Index, build, tokenized
from scriptorium.operators.retrieval import Engine
from scriptorium.plans import query as Q
from scriptorium.plans import rewrites as R

#: Words with their stems by the published descriptions. Fixed values.
STEMS = {
    "spanish": "chicana chican chicas chic chicharrones chicharron chico chic torá tor tórax torax torcer torc toreado tor toreándolo tor torear tor toreara tor torearlo tor toreó tore torero torer torio tori tormenta torment",
    "italian": "abbandonata abbandon abbandonava abbandon abbandonerà abbandon abbandoneranno abbandon abbandono abband pronuncia pronunc pronunciamento pronunc pronunciarsi pronunc pronunzia pronunz propagare propag propone propon",
    "portuguese": "boa boa boataria boat boates boat bobagem bobag bobagens bobagens bobear bob bobinho bobinh quiosque quiosqu quiseram quis quisesse quis quitandas quitand",
    "french": "continua continu continuait continu continuation continu continuelle continuel continuité continu contorsions contors contourner contourn contraction contract contradictoirement contradictoir maintenaient mainten majestueux majestu majeur majeur malheureux malheur",
    "dutch": "lichaam licham lichaamsdelen lichaamsdel lichamelijke licham lichtgevoelige lichtgevoel lichtvaardig lichtvaard opgedoken opgedok opgegeven opgegev opgeheven opgehev opgelegd opgelegd opgroeien opgroei opheffing opheff",
    "russian": "вагнера вагнер вагона вагон вагонов вагон вагоном вагон важная важн важнее важн важнейшие важн важничал важнича важность важност важностью важност важную важн важным важн",
    "arabic": "الكتاب كتاب والكتاب كتاب كتابات كتاب مدرسة مدرس المعلمون معلم",
}


@pytest.mark.parametrize("name", sorted(STEMS))
def test_stems(name):
    x = STEMS[name].split()
    f = stemmers.STEMMERS[name]
    assert [f(w) for w in x[::2]] == x[1::2]


@given(st.sampled_from(sorted(WORLD)), st.text(alphabet=string.ascii_lowercase + "áéíóúàèìòùâêîôûäëïöüãõçñÿабвгдеиостьюяنالكتبوي", max_size=14))
def test_stemmers_take_any_word(name, word):
    s = WORLD[name](word)
    assert isinstance(s, str) and len(s) <= len(word) + 3


def test_inflections_by_dictionary(spark):
    f = with_dictionary("city house dog stop make large run happy box pass play".split())
    assert [f(w) for w in "cities houses dogs stopped making larger running happily boxes passed played sing".split()] == "city house dog stop make large run happy box pass play sing".split()
    assert inflections("was") == ["was"]
    v = spark.createDataFrame([(t,) for t in ("cities", "city", "stopped", "stop", "walking", "walking", None)], "term string")
    assert dict(map(tuple, stemmers.dictionary_stems(v).collect())) == {"cities": "city", "city": "city", "stopped": "stop", "stop": "stop", "walking": "walking"}


def test_word_lists(tmp_path):
    (tmp_path / "own").write_text("The\n\n# none\nof  the # two\nthe\n", encoding="utf-8")
    assert text.word_list("own", str(tmp_path)) == ["the", "of the"] and "the" in text.word_list("short")
    with pytest.raises(KeyError):
        text.word_list("none")


def _engine(spark):
    docs = spark.createDataFrame([(1, "cities of the north"), (2, "a city and a stop"), (3, "stopping in the cities"), (4, "north stop")], "doc_id bigint, text string")
    i = build(tokenized(docs))
    e = spark.createDataFrame([("title", 1, 0, 1), ("title", 2, 3, 5)], "name string, docid bigint, begin int, end int")
    return Engine(Index(i.postings.unionByName(stemmers.stemmed_postings(i.postings)).unionByName(stemmers.stemmed_postings(i.postings, "dictionary")), i.lengths, i.names, e))


def test_leaves_of_a_stemmer_and_a_field(spark):
    e = _engine(spark)
    found = lambda q, **p: sorted(r["docid"] for r in e.search(q, 10, **p).collect())
    assert found("cities") == [1, 3] and found("cities", stemmer="porter2") == [1, 2, 3] and found("#text:city:part=postings.dictionary()") == [1, 2, 3]
    assert found("stop", stemmer="porter2") == [2, 3, 4] and found("#od:1( stopping in )", stemmer="porter2") == [3]
    assert found("cities", field="title") == [1] and found("stop", field="title") == [2]
    assert str(R.leaves(Q.parse("a"), {"field": "title", "fieldParts": ["title"]})) == "#text:a:part=field.title()"
    assert str(R.leaves(Q.parse("#text:a:part=x()"), {"stemmer": "porter2", "field": "title"})) == "#text:a:part=x()"
    assert str(R.leaves(Q.parse("a.body"), {"field": "title"})) == "#inside( #text:a() #extents:body:part=extents() )"


def test_grid_in_one_job(spark):
    from scriptorium.learning.tune import Range, evaluator, grid_in_one_job, grid_search
    from scriptorium.operators import evaluation as E

    e = _engine(spark)
    judged = E.judgments(spark.createDataFrame([("x", "DOC2", 1), ("x", "DOC1", 0), ("y", "DOC4", 1)], "qid string, docno string, grade int"))
    queries = {"x": "#combine:0={w}:1=1( city north )", "y": "north stop"}
    r = {"w": Range(0.0, 2.0), "mu": Range(1.0, 100.0)}
    a, b = grid_in_one_job(e, queries, judged, r, 2), grid_search(evaluator(e, queries, judged), r, 2)
    assert [s for s, _ in a.trace] == [s for s, _ in b.trace] and [x for _, x in a.trace] == pytest.approx([x for _, x in b.trace]) and a.setting == b.setting


def test_side_tables_and_repair(spark, tmp_path):
    e, path = _engine(spark), str(tmp_path / "i")
    e.index.save(path)
    e.index.save_side(path, "priors", spark.createDataFrame([("p", 1, -1.0)], "part string, docid bigint, value double"))
    assert Index.open_side(spark, path, "priors").count() == 1 and Index.open_side(spark, path, "none") is None
    with pytest.raises(ValueError):
        e.index.save_side(path, "names", e.index.names)
    assert Index.repair(spark, path) == []
    e.index.lengths.where("docid > 2").write.mode("overwrite").parquet(f"{path}/lengths")
    e.index.names.where("docid <> 4").write.mode("overwrite").parquet(f"{path}/names")
    assert Index.repair(spark, path) == ["lengths", "names"]
    i = Index.open(spark, path)
    assert {(r["docid"], r["length"]) for r in i.lengths.collect()} == {(1, 4), (2, 5), (3, 4), (4, 2)} and i.names.where("docid = 4").first()["name"] == "DOC4"


def test_command_line(spark, tmp_path, capsys):
    from scriptorium import cli

    class Args:
        def __init__(self, *argv):
            self.__dict__.update(vars(cli.parser().parse_args([str(x) for x in argv])))

    def run(*argv):
        a = Args(*argv)
        a.do(spark, a)
        return capsys.readouterr().out

    (tmp_path / "docs.txt").write_text("")
    src = tmp_path / "in.trectext"
    src.write_text("".join(f"<DOC>\n<DOCNO>d{i}</DOCNO>\n<TEXT>\n{t}\n</TEXT>\n</DOC>\n" for i, t in enumerate(("old mill", "new mills near the mill", "river"))))
    ix = tmp_path / "ix"
    run("build-index", src, ix, "--stemmer", "porter2")
    (tmp_path / "p.txt").write_text("d1 0.5\nd9 1\n")
    run("build-part", ix, tmp_path / "p.txt", "good", "--log")
    run("build-conflation", ix, "--stemmer", "dictionary")
    assert Index.open_side(spark, str(ix), "priors_good").count() == 1
    assert {r["stem"]: r["terms"] for r in Index.open_side(spark, str(ix), "conflation_dictionary").collect()}["mill"] == ["mill", "mills"]
    assert "d1" in run("document", ix, "d1", "--terms")
    (tmp_path / "q.tsv").write_text("1\tmill\n2\t#require( new mill )\n")
    t = json.loads(run("timed-search", ix, tmp_path / "q.tsv").splitlines()[-1])
    assert t["queries"]["1"]["results"] == 2 and set(t) == {"queries", "batch_seconds"}
    run("rerank", ix, tmp_path / "q.tsv", tmp_path / "q.tsv", tmp_path / "run")
    assert spark.read.text(str(tmp_path / "run")).count() == 3
    a = json.loads(run("annotate", ix, "old mill"))
    assert a["documents"] == 3 and [n["documents"] for n in a["nodes"]] == [1, 2]
    assert json.loads(run("repair", ix)) == {"mended": []}
    assert "mill" in run("token-statistics", src)


def test_settings():
    from scriptorium.functions.settings import Settings

    base = Settings({"a": {"b": 1, "c": "2.5"}, "f": "true"})
    s = Settings.parse('{"a": {"b": 7}, "list": [1], "none": null}', base)
    assert s.integer("a.b") == 7 and s.number("a.c") == 2.5 and s.flag("f") is True and s.items("a.b") == [7] and s.get("none") is None
    assert s.has("a.c") and not s.has("a.d") and s.get("a.d", 3) == 3
    for f, bad in ((s.integer, "a.c"), (s.number, "list"), (s.flag, "a.b")):
        with pytest.raises(ValueError):
            f(bad)
    with pytest.raises(KeyError):
        s.get("zz")
    m = base.merged(Settings({"a": {"c": 3}, "g": 1}).set("x.y", 4))
    assert Settings.parse(m.render()).values == {"a": {"b": 1, "c": 3}, "f": "true", "g": 1, "x": {"y": 4}}
    with pytest.raises(ValueError):
        m.set("g.h", 1)


def test_sums_of_trees_and_natural_order(spark):
    from pyspark.sql import functions as F

    from scriptorium.functions.settings import natural_key, sum_trees, value_counts

    rows = ['{"a": 1, "b": {"c": 2}}', '{"a": 0.5, "b": {"c": 3, "d": true}}', "no json", None, "[1]", ""]
    df = spark.createDataFrame([(r,) for r in rows], "value string").repartition(3)
    assert dict(map(tuple, sum_trees(df).collect())) == {"a": 1.5, "b.c": 5.0}
    names = ["a10", "a2", "A1b", "a002", "b", "a1", None, "10", "9"]
    n = spark.createDataFrame([(x,) for x in names], "name string")
    assert [r["name"] for r in n.where("name <> 'a002'").orderBy(natural_key(F.col("name")), "name").collect()] == ["9", "10", "a1", "A1b", "a2", "a10", "b"]
    assert {tuple(r) for r in value_counts(n.withColumn("k", F.substring("name", 1, 1)), "k").collect()} == {("a", 4), ("A", 1), ("b", 1), (None, 1), ("1", 1), ("9", 1)}


def test_windows_of_stems_and_short_dates(spark):
    from scriptorium.operators.index import typed_fields
    from scriptorium.operators.ngrams import frequent_windows

    t = tokenized(spark.createDataFrame([(1, "old mills old mill"), (2, "older things"), (3, None)], "doc_id bigint, text string"))
    st_ = stemmers.stemmed_tokens(t)
    assert {r["docid"]: r["tokens"] for r in st_.collect()} == {1: ["old", "mill", "old", "mill"], 2: ["older", "thing"], 3: []}
    assert frequent_windows(st_, 2, 1, 2).count() == 0 and {r["feature"] for r in frequent_windows(st_, 2, 1, 2, by_documents=False).collect()} == {"old~mill"}
    docs = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP '2024-01-31 10:00:00'), (2L, TIMESTAMP '2023-05-01 00:00:00') AS t(doc_id, day)")
    e = _engine(spark)
    f = Engine(e.index.with_fields(typed_fields(docs, {"day": "date"})))
    assert [r["docid"] for r in f.boolean("#greater( day 1/30/24 )").collect()] == [1] == [r["docid"] for r in f.boolean("#greater( day 2024-01-30 )").collect()]
    assert [r["docid"] for r in f.boolean("#less( day 1/30/2024 )").collect()] == [2]
