import gzip
import io
import json
import zipfile

import pytest

from scriptorium.functions import snippets, stemmers, tagtok
from scriptorium.learning import tune
from scriptorium.sources import readers as R
from scriptorium.sources import writers
from scriptorium.streaming.incremental import GrowingIndex


def rows(df):
    return sorted((r["name"], (r["text"] or "").strip(), dict(r["metadata"] or {})) for r in df.collect())


def put(tmp_path, name, data):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(p)


TREC = "<DOC>\n<DOCNO> A-1 </DOCNO>\n<HEADLINE>Head</HEADLINE>\n<JUNK>no</JUNK>\n<TEXT>\nbody one\n</TEXT>\n</DOC>\n<DOC>\n<DOCNO>A-2</DOCNO>\n<TEXT>two</TEXT>\n</DOC>\n"


def test_trec_text(spark, tmp_path):
    p = put(tmp_path, "a.trectext", TREC)
    assert [n for n, _, _ in rows(R.read(spark, p))] == ["A-1", "A-2"]
    assert "<HEADLINE>Head</HEADLINE>" in rows(R.read(spark, p))[0][1] and "no" not in rows(R.read(spark, p))[0][1]
    g = put(tmp_path, "z/b.trectext.gz", gzip.compress(TREC.encode()))
    assert R.read(spark, [p, g]).count() == 4
    assert R.sniff(spark, put(tmp_path, "odd/file", TREC)) == "trectext"


def test_web_formats(spark, tmp_path):
    w = put(tmp_path, "w.trecweb", "<DOC>\n<DOCNO>W1</DOCNO>\n<DOCHDR>\nhttp://x.example/a 1.2.3.4\nmore\n</DOCHDR>\n<html>hi</html>\n</DOC>\n")
    assert rows(R.read(spark, w)) == [("W1", "<html>hi</html>", {"url": "http://x.example/a"})]
    rec = "WARC/1.0\r\nWARC-Type: {0}\r\nWARC-Target-URI: http://x.example/{1}\r\nWARC-TREC-ID: T{1}\r\nContent-Length: 9\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>page {1}</p>\r\n\r\n"
    x = put(tmp_path, "c.warc", "WARC/1.0\r\nWARC-Type: warcinfo\r\n\r\nsoftware: x\r\n\r\n" + rec.format("response", 1) + rec.format("request", 2))
    assert rows(R.read(spark, x)) == [("T1", "<p>page 1</p>", {"url": "http://x.example/1", "content_type": "text/html"})]
    body = b"HTTP/1.0 200 OK\r\n\r\n<b>arc</b>"
    a = put(tmp_path, "d.arc", b"http://y.example/ 1.1.1.1 20200101 text/html %d\n%s\n" % (len(body), body))
    assert rows(R.read(spark, a)) == [("http://y.example/", "<b>arc</b>", {"url": "http://y.example/", "date": "20200101", "content_type": "text/html"})]


def test_other_formats(spark, tmp_path):
    j = put(tmp_path, "a.jsonl", '{"docno": "J1", "contents": "hello", "x": "1"}\nbroken\n{"id": "J2", "text": "two"}\n')
    assert rows(R.read(spark, j)) == [("J1", "hello", {"x": "1"}), ("J2", "two", {})]
    m = put(tmp_path, "arr/a.json", json.dumps([{"id": "M", "body": "b"}]))
    assert rows(R.json_documents(spark, m, multiline=True)) == [("M", "b", {})]
    t = put(tmp_path, "t.twitter", "user\t2020\thi there\tweb\nshort\n")
    assert rows(R.read(spark, t)) == [("user-2020", "hi there", {"user": "user", "time": "2020", "source": "web"})]
    b = put(tmp_path, "b.blocks", "first\nline a\n====\nsecond\nline b\n")
    assert [(n, x) for n, x, _ in rows(R.read(spark, b))] == [("first", "line a"), ("second", "line b")]
    x = put(tmp_path, "w.wiki", "<mediawiki><page><title>T</title><id>7</id><revision><text>wiki [[x]]</text></revision></page></mediawiki>")
    assert [n for n, _, _ in rows(R.read(spark, x))] == ["T"]
    c = put(tmp_path, "tac.tac", '<DOC id="D1" type="story"><HEADLINE>h</HEADLINE><TEXT>t</TEXT></DOC>')
    assert rows(R.read(spark, c)) == [("D1", "h\nt", {})]
    n = put(tmp_path, "counts.txt", "the 12\nbad\nof 3\n")
    assert sorted(map(tuple, R.word_counts(spark, n).collect())) == [("of", 3), ("the", 12)]
    h = put(tmp_path, "p/page.html", "<title>My page</title> body")
    assert rows(R.read(spark, h))[0][2] == {"title": "My page"}
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("in.txt", "zipped text")
    assert rows(R.read(spark, put(tmp_path, "f.zip", f.getvalue())))[0][1] == "zipped text"
    assert R.read(spark, put(tmp_path, "l.lines", "one\ntwo\n")).count() == 2
    with pytest.raises(ValueError):
        R.read(spark, j, format="none")
    assert R.read(spark, j, format="none", on_unknown="warn").count() == 0


def test_writers_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("n1", "text one", {"url": "http://u"}), ("n2", None, None), (None, "x", None)], R.SCHEMA.replace(", path string", ""))
    writers.trec_text(d, str(tmp_path / "t"))
    assert R.trec_text(spark, str(tmp_path / "t")).count() == 2
    writers.trec_web(d, str(tmp_path / "w"))
    assert rows(R.trec_web(spark, str(tmp_path / "w")))[0] == ("n1", "text one", {"url": "http://u"})
    writers.corpus(d, str(tmp_path / "c"))
    assert R.corpus(spark, str(tmp_path / "c"), "n1", "n2").count() == 1
    r = spark.createDataFrame([("q", "d", 1, 2.5)], "qid string, docno string, rank int, score double")
    writers.run(r, str(tmp_path / "r"))
    assert writers.read_run(spark, str(tmp_path / "r")).first()["score"] == 2.5
    q = spark.createDataFrame([("q", "d", -1)], "qid string, docno string, grade int")
    writers.qrels(q, str(tmp_path / "q"))
    assert writers.read_qrels(spark, str(tmp_path / "q")).first()["grade"] == -1


def test_tagged_tokenizer(spark):
    t, g = tagtok.tokenize('<html> <a href="http://w.example">Harbour</a> one two <!-- no --> &amp; <script>x y</script> three <title>old mill</title> it\'s done, dept.cs.mill.example u.k. 17.2', ("title", "a", "html"))
    assert [x[0] for x in t] == ["harbour", "one", "two", "three", "old", "mill", "its", "done", "dept", "cs", "mill", "example", "uk", "17", "2"]
    assert [(x[0], x[2], x[3]) for x in g] == [("html", 0, 0), ("a", 0, 1), ("title", 4, 6)]
    assert g[1][1] == {"href": "http://w.example"}
    t, g = tagtok.tokenize('<category tokenizeTagContent="false">/a/b</category> c', ("category",))
    assert [x[0] for x in t] == ["/a/b", "c"]
    df = tagtok.tokenized(spark.createDataFrame([(1, "<b>x</b>"), (2, None)], "doc_id bigint, text string"), ("b",))
    assert [(len(r["terms"]), len(r["tags"])) for r in df.orderBy("docid").collect()] == [(1, 1), (0, 0)]


def test_stemmers(spark):
    want = {"consigned": "consign", "knackeries": "knackeri", "generously": "generous", "hopping": "hop", "hoping": "hope", "relational": "relat", "sky": "sky", "skies": "sky", "ties": "tie", "cries": "cri", "agreed": "agre", "by": "by", "communism": "communism", "roll": "roll", "controlling": "control", "gently": "gentl"}
    assert {w: stemmers.english(w) for w in want} == want
    assert stemmers.german("häuser") == "haus" and stemmers.plural("cities") == "city"
    v = spark.createDataFrame([("runs",), ("run",), (None,), ("a~runs",)], "term string")
    assert sorted(map(tuple, stemmers.stems(v).collect())) == [("a~runs", "a~run"), ("run", "run"), ("runs", "run")]


def test_snippets():
    s, score = snippets.snippet("a b c d e f g h i match k l m n o p q r s t u v w match y z", {"match"})
    assert "match" in s and score > 0
    assert snippets.snippet(None, {"x"}) == (None, 0.0) and snippets.snippet("", {"x"}) == ("", 0.0)


def test_growing_index(spark, tmp_path):
    g = GrowingIndex(spark, f"file://{tmp_path}/g", radix=2)
    assert g.index().term_stats().count() == 0
    for i in range(5):
        g.add(spark.createDataFrame([(i, f"common w{i}")], "doc_id bigint, text string"), i)
    g.add(spark.createDataFrame([(3, "common w3")], "doc_id bigint, text string"), 3)  # run again
    assert [s["generation"] for s in g.shards()] == [2, 0]
    assert g.index().term_stats().where("term = 'common'").first()["df"] == 5
    g.clean()
    assert g.index().lengths.count() == 5


def test_learning():
    f = lambda s: -((s["x"] - 0.7) ** 2) - (s["y"] - 0.2) ** 2
    r = {"x": tune.Range(0, 1, 0.5), "y": tune.Range(0, 1, 0.5)}
    assert tune.grid_search(f, r, 10).setting == pytest.approx({"x": 0.7, "y": 0.2})
    best = tune.coordinate_ascent(f, r, restarts=2, iterations=20)
    assert best.score > -0.01
    assert tune.normalized({"a": 1.0, "b": 3.0}, ["a", "b"]) == {"a": 0.25, "b": 0.75}
    out = tune.cross_validate(lambda q: lambda s: f(s) + len(q), {str(i): "" for i in range(6)}, lambda e: tune.grid_search(e, r, 2), folds=3)
    assert len(out) == 3
