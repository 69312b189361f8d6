"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; and the
functions on single texts."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import boilerplate, distinct_terms, encode, frequency, lines, markup, mixing, neardup, quality, topn

DOCS = "doc_id bigint, text string, site string, source string, lang string, terms array<string>, n bigint, rank int, term string"


@pytest.fixture(scope="module")
def odd(spark):
    long = "word " * 60_000 + "x" * 50_000
    rows = [
        (1, None, None, None, None, None, 1, 1, ""), (2, "", "a.example", "web", "en", [], 1, 1, ""), (3, " \n\t ", "a.example", " WEB", "xx", [None, ""], 1, 1, ""),
        (4, long, "a.example", "web ", "en", ["w"] * 5000, 1, 1, ""), (5, long, None, "wiki", "de", ["w"] * 5000, 1, 1, ""), (5, long, None, "wiki", "de", ["w"] * 5000, 1, 1, ""),
        (6, "one\r\ntwo\rthree\x00\u2028 ünï 😀", "", "web", "en", ["ü", "W "], 1, 1, ""),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame([("en", "the"), ("en", "of"), (None, None)], "lang string, word string")


def test_odd_rows_run(odd, common, spark):
    assert encode.encode(odd).count() == 7
    assert {r["doc_id"]: r["ids"] for r in encode.encode(odd).where("doc_id < 4").collect()}[2] == []
    assert boilerplate.furniture(odd).count() == 0
    assert boilerplate.main_texts(odd).count() == 7
    assert markup.found(odd).count() == 0
    assert {r["doc_id"]: r["text"] for r in markup.cleaned(odd).where("doc_id < 3").collect()} == {1: None, 2: ""}
    assert distinct_terms.most_distinctive(odd, least_terms=1).where("doc_id = 6").count() == 2
    assert quality.no_prose(odd, common).count() >= 0
    t = spark.createDataFrame([("web", 0.5, 2), ("none", 0.1, None), ("wiki", None, 1)], "source string, target_share double, max_repeats int")
    assert {r["source"] for r in mixing.short_sources(odd, t).collect()} == {"none"}
    assert mixing.reached(odd.where("doc_id <> 5"), t).count() == 3


def test_copies_are_linked(odd):
    n = neardup.NearDuplicates(odd.dropDuplicates(["doc_id"]))
    assert [tuple(r) for r in n.all_pairs().collect()] == [(4, 5)]
    assert {tuple(r) for r in n.groups().collect()} == {(4, 4, 1), (5, 4, 1)}


def test_short_copies_are_grouped(spark, tmp_path):
    from scriptorium.llm.queries import QUERIES

    long = " ".join(f"w{i}" for i in range(30))
    texts = ["Old mill by the river now", "old mill, by the river now!", "old mill by the river then", "Good morning all", "good morning, all", "good morning", "good morning none", None, "", "...", long, long + "."]
    rows = [(i, t, None) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, site string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["p3_groups"](spark, str(tmp_path)).collect()))
    assert got == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0), (10, 10, 0), (11, 11, 1), (12, 11, 1)]


def test_empty_tables(odd, common, spark):
    none = odd.where("doc_id > 100")
    t = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    for df in (
        encode.encode(none), boilerplate.furniture(none), boilerplate.main_texts(none), markup.found(none), markup.cleaned(none), neardup.NearDuplicates(none).all_pairs(), neardup.NearDuplicates(none).groups(),
        distinct_terms.most_distinctive(none), distinct_terms.residual_idf(none), quality.no_prose(none, common), mixing.short_sources(none, t), mixing.reached(none, t),
    ):
        assert df.count() == 0
    p = spark.createDataFrame([], "term string, docid bigint, positions array<int>")
    assert frequency.term_counts(p).count() == 0 and frequency.marked(p, p).count() == 0
    s = spark.createDataFrame([], "qid string, document bigint, score double")
    assert topn.top_n(s, "qid", "document", "score").count() == 0


def test_top_n_rules(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("q", 5, 1.0), ("q", 3, 1.0), ("q", 3, 2.0), ("q", 3, 2.0), ("q", 9, -0.0), ("q", 8, 0.0), ("q", 7, -inf), ("q", 1, nan), ("q", None, 9.0), ("q", -1, 9.0), ("q", 2, None), (None, 1, 1.0), ("r", 4, nan)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "qid string, document bigint, score double, grp string, place int").repartition(4)
    got = sorted(map(tuple, topn.top_n(df, "qid", "document", "score", 10).collect()))
    assert got == [("q", 1, 3), ("q", 2, 5), ("q", 3, 8), ("q", 4, 9), ("q", 5, 7)]


def test_top_n_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 50)}", rng.randint(0, 400), float(rng.randint(0, 30))) for _ in range(30_000)]
    best: dict = {}
    for g, d, s in rows:
        best.setdefault(g, {})
        best[g][d] = max(best[g].get(d, -1.0), s)
    want = {(g, i + 1, d) for g, x in best.items() for i, (d, _) in enumerate(sorted(x.items(), key=lambda y: (-y[1], y[0]))[:7])}
    df = spark.createDataFrame(rows, "qid string, document bigint, score double").repartition(9)
    assert {tuple(r) for r in topn.top_n(df, "qid", "document", "score", 7).collect()} == want


def test_frequencies_by_hand(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "HOT ", "a", "b", "", None]), rng.choice([1, 2, 3, 4, None]), rng.choice([None, [], [1], [1, 2], [2, 2, None], [-1]])) for _ in range(3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "term string, docid bigint, positions array<int>, rec string").repartition(7)
    docs, pos = {}, {}
    for t, d, p in rows:
        if t is not None and d is not None:
            t = t.strip(" ").lower()
            docs.setdefault(t, set()).add(d)
            pos.setdefault(t, set()).update((d, x) for x in p or [] if x is not None and x >= 0)
    want = {t: (len(docs[t]), len(pos[t])) for t in docs}
    assert {r["term"]: (r["document_count"], r["collection_count"]) for r in frequency.term_counts(df).collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1.,'’ \t\n\r\x0b\x1c\x1f\x85\xa0\u2003\u3000éàß漢😀-<|>_")), max_size=40))
def test_encoding_round_trip(text):
    e = encode.encoder(None, "byte_bpe_50k")
    ids = np.frombuffer(e.encode(text), dtype=np.int32).tolist()
    assert ids == e.encoding.encode_ordinary(text)
    assert e.encoding.decode(ids) == text


def test_texts_without_blanks():
    """Long pieces are cut between bytes that no token joins; tokens within are merged by steps."""
    e = encode.encoder(None, "byte_bpe_50k")
    rng = random.Random(11)
    for alphabet in ("abcdefgh", "漢字仮名交文テスト", "őűąęłżźć", "ab漢é1,'", "กขคงจฉ", "абвгде"):
        for _ in range(40):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(49, 400)))
            assert np.frombuffer(e.encode(text), dtype=np.int32).tolist() == e.encoding.encode_ordinary(text)
    assert len(e.parts("漢字仮名交文" * 20)) > 1
    b = [x for x in e.ranks if 2 <= len(x) <= 6][:2000]
    assert sum(e.merged(x) == [e.ranks[x]] for x in b) >= 0.99 * len(b)


def test_special_tokens_are_text():
    e = encode.encoder(None, "byte_bpe_50k")
    assert 50256 not in np.frombuffer(e.encode("a<|endoftext|>b"), dtype=np.int32)


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("a <b>x</b>", ["html"]), ("x<!-- y -->", ["html"]), ("caf&eacute; &#8217;", ["html"]), ("# Title", ["markdown"]), ("Title\n=====\ntext", ["markdown"]), ("some *word* here", ["markdown"]),
        ("a **b**, __c__ ~~d~~", ["markdown"]), ("use `x` now", ["markdown"]), ("[a](b) ![c](d)", ["markdown"]), ("see [a][1]", ["markdown"]), ("- [ ] todo", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]),
        ("[[a|b]] text", ["wiki"]), ("{{cite|x}}", ["wiki"]), ("''it'' and '''b'''", ["wiki"]), ("== Head ==", ["wiki"]), ("{| class=x\n|-\n| a\n|}", ["wiki"]), ("[https://x.example label]", ["wiki"]),
        ("\\emph{x}", ["latex"]), ("{\\bf x}", ["latex"]), ("so $x_{1}$ holds", ["latex"]), ("\\(k \\le 4\\)", ["latex"]), ("$$a = b$$", ["latex"]), ("\\begin{document}", ["latex"]),
        ("costs $5 for one and $12 for two", []), ("if x < y and y > z", []), ("a <3 b", []), ("C:\\data\\2031\\7 was", []), ("#tag @user", []), ("#combine( a b )", []), ("A -> B <- C", []), ("<|endoftext|>", []),
        ("max_tf_value and doc_len_sum", []), ("a[i][j] = b[j] + 5 * 3 * 2", []), ("Note 7* applies, note 8** does not", []), ("R&D and Q&A", []), ("(1), (2) & (3)", []), ("2^10 = 1024 > 1000", []), ("- item\n- item", []), ("1. one\n2. two", []), ("    indented", []), (None, []), ("", []),
        ("-n 5 --verbose | sort > out.txt", []), ("3% to 7% @ noon ~ again", []),
    ],
)
def test_kinds_of_markup(text, kinds):
    assert markup.kinds(text) == kinds


def test_cleaning_keeps_structure():
    assert markup.clean("<h2>Head</h2><p>One &amp; two<br>three</p><ul><li>a</li><li>b</li></ul>").replace("\n\n", "\n").split("\n") == ["## Head", "One & two", "three", "- a", "- b"]
    assert markup.clean("# T\n\n**b** [l](u) `c`\n\n```\nx = 1\n```") == "# T\n\nb l c\n\n```\nx = 1\n```"
    assert markup.clean("== H ==\n[[a|b]] {{cn|date=1}}{{cite|word|5}} ''i''").split() == ["##", "H", "b", "word", "i"]
    assert markup.clean("\\section{S}\nAn \\emph{x} $a_{1}$ \\cite{k}\n\\begin{itemize}\n\\item one\n\\end{itemize}").split() == ["#", "S", "An", "x", "$a_{1}$", "-", "one"]
    assert markup.clean("plain text, 5 * 3") == "plain text, 5 * 3"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<pre>def __init__(self):</pre>", "```\ndef __init__(self):\n```"), ("```py\nreturn a[i](x), *b* \\frac{a}{b} {{x}} <b>\n```\n**c**", "```py\nreturn a[i](x), *b* \\frac{a}{b} {{x}} <b>\n```\nc"), ("$a *b* c$ *d*", "$a *b* c$ d"),
        ("\\(a *b* c\\) \\emph{d}", "\\(a *b* c\\) d"), ('<div\n class="x">hi</div>', "hi"), ("[a](http://x.com/a_(b)) c", "a c"), ("{{a|{{b|{{c|{{d|{{e|{{f|deep}}}}}}}}}}}}", "deep"), ("\\a{\\b{\\c{\\d{\\e{deep}}}}}", "deep"),
        ("use `__x__` and *y*", "use __x__ and y"), ("\\begin{verbatim}\nx_{1} = *p;\n\\end{verbatim}\n\\textbf{b}", "```\nx_{1} = *p;\n```\n\nb"), ("<p>x &lt; y <code>a*b*c &amp; d</code></p>", "x < y a*b*c & d"), ("\ue000 <b>x</b> `y`", "\ue000 x y"),
    ],
)
def test_code_and_formulas_are_kept(text, want):
    assert markup.clean(text) == want


def test_kinds_of_tags_over_lines():
    assert markup.kinds('<div\n class="x">hi</div\n>') == ["html"] and markup.kinds("a <b\nc <d") == []
    assert len(lines.plain('x <div\n class="y">z\nw')) == 3


def test_best_region_is_the_maximum():
    rng = random.Random(1)
    for _ in range(200):
        parts = [rng.choice(["word", "<a href=x>", "</a>", "<li>", "<b>"]) for _ in range(rng.randint(1, 14))]
        text = " ".join(parts)
        score = [markup.DEFAULT_WEIGHTS[k] for k, _, _ in markup.classes(text)]
        best = max([sum(score[i:j]) for i in range(len(score)) for j in range(i + 1, len(score) + 1)])
        at = [(a, b) for _, a, b in markup.classes(text)]
        begin_end = markup.best_region(text, markup.DEFAULT_WEIGHTS)
        if best > 0:
            inside = sum(s for s, (a, b) in zip(score, at, strict=True) if begin_end[0] <= a and b <= begin_end[1])
            assert begin_end[0] <= begin_end[1] and (inside == best or "\n" not in text)


def test_region_drops_menus():
    t = "<ul><li><a href=/>Home</a></li></ul>\n<p>This is the text of the page with many words in it.</p>\n<ul><li><a href=/x>Next</a></li></ul>"
    a, b = markup.best_region(t, markup.DEFAULT_WEIGHTS)
    assert t[a:b].startswith("<p>") and "Next" not in t[a:b]


def test_no_word_of_a_record_is_cut(spark):
    table = "<table>\n" + "\n".join(f"<tr><td>a{i}</td><td>b{i}</td><td><a href=/{i}>c{i}</a></td></tr>" for i in range(30)) + "\n</table>"
    items = "<ul>\n" + "\n".join(f"<li>d{i}</li>" for i in range(30)) + "\n</ul>"
    text = f"<h1>Head</h1>\n<p>one two</p>\n{table}\n{items}\n<pre>\ncode\n</pre>"
    df = spark.createDataFrame([(1, text, None), (2, text.replace("<a href", "<b id").replace("</a>", "</b>"), "a.example")], "doc_id bigint, text string, site string")
    for r in markup.cleaned(df).collect():
        assert [m for k, x, y in markup.classes(text) if k == "word" and (m := text[x:y]) not in r["text"]] == []
        assert r["text"].count("\n- ") == 30 and r["text"].count("```") == 2


def test_weights_are_fitted_on_all_lines(spark):
    rows = [("words without a tag here", True)] * 20 + [("<a href=x>menu</a>", False)] * 20 + [("<b>word</b> and <li>item</li>", True)] * 5
    w = markup.fit_weights(spark.createDataFrame(rows, "text string, is_content boolean"))
    assert w["word"] == 1.0 and w["structure"] == 0.0
    word, menu = (116 - 21) / (116 + 21), (1 - 41) / (1 + 41)  # one of each is added
    assert w["listed"] == pytest.approx(menu / word) and w["inline"] == 0.0


def _pages(spark, n=60):
    rng = random.Random(8)
    words = "the valve river stone quiet mill broad forest letter open field north keeper small harbour".split()
    rows = []
    for i in range(n):
        site = f"www.site{i % 3}-news.example"
        body = [" ".join(rng.choice(words) for _ in range(14)).capitalize() + "." for _ in range(4)]
        page = [f"Site{i % 3} News", "Home | Sports | Help", *body[:2], "Share this: Mail Print", *body[2:], f"© {2000 + i} Site{i % 3} News. All rights reserved."]
        rows.append((i, "\n".join(page), site))
        rows.append((1000 + i, "\n".join(" ".join(rng.choice(words) for _ in range(14)).capitalize() + "." for _ in range(4)), None))
    return spark.createDataFrame(rows, "doc_id bigint, text string, site string")


def test_templates_of_a_small_web(spark):
    df = _pages(spark)
    got = {(r["doc_id"], r["line_no"]) for r in boilerplate.furniture(df).collect()}
    assert got == {(i, k) for i in range(60) for k in (0, 1, 4, 7)}
    f = boilerplate.Furniture(df)
    assert {(r["doc_id"], x) for r in f._joined(df.where("site is not null")).collect() for x in r["lines"]} == got


#: Words of two languages that no rule here was written with.
POLISH = "rzeka most dom szkoła pole las miasto droga rynek zamek kościół młyn wieś brzeg ogród wiatr zima lato wiosna jesień stół okno kamień ptak".split()
FINNISH = "katu talo joki silta metsä kylä koulu tori linna mylly ranta puutarha tuuli talvi kesä kevät syksy pöytä ikkuna kivi lintu laiva".split()


def _unseen(spark, hosts, pages, others):
    """Pages of two layouts with their furniture lines; slots stand before, in and after fixed words."""
    rng = random.Random(3)
    some = lambda w, n: " ".join(rng.choice(w) for _ in range(n))
    sentence = lambda w, n=12: some(w, rng.randint(n - 4, n + 4)).capitalize() + "."
    notice = "Tämä sivusto käyttää evästeitä jotta voimme tarjota sinulle parhaan mahdollisen kokemuksen verkossa ja kehittää palveluamme edelleen . " * 3
    docs, true = [], set()
    for h in range(hosts):
        for _ in range(pages):
            w = (POLISH, FINNISH)[h % 2]
            body = [(sentence(w), 0) for _ in range(5)]
            head = [(some(w, 3).capitalize(), 0)]
            if h % 2:
                rows = [("Etusivu", 1), ("Uutiset", 1), ("Urheilu", 1), *head, *body, (f"Julkaistu {rng.randint(1, 28)}.{rng.randint(1, 12)}.2024 kello {rng.randint(1, 23)}", 1), (notice, 1), (f"Luitko jo tämän? {sentence(w, 5)}", 1)]
            else:
                rows = [("Strona główna | Sport | Kontakt", 1), (f"{some(w, 3)} — czytaj więcej w dziale kultura i sztuka", 1), *head, *body[:3], (f"Zobacz też: {sentence(w, 5)}", 1), *body[3:], (f"{some(w, 3)} wszelkie prawa zastrzeżone przez wydawcę", 1)]
            true |= {(len(docs), k) for k, (_, f) in enumerate(rows) if f}
            docs.append((len(docs), "\n".join(r for r, _ in rows), f"www.paikka{h}-uutiset.example"))
    for _ in range(others):
        w = rng.choice([POLISH, FINNISH])
        docs.append((len(docs), "\n".join(sentence(w) for _ in range(6)), None))
    return spark.createDataFrame(docs, "doc_id bigint, text string, site string"), true


@pytest.mark.parametrize(("hosts", "pages", "others", "recall", "precision"), [(1, 40, 60, 0.95, 0.95), (6, 4, 30, 0.95, 0.95), (2, 60, 100, 0.95, 0.95), (1, 40, 0, 0.8, 0.95), (1, 10, 0, 0.8, 0.95), (6, 3, 0, 0.9, 0.95)])
def test_templates_of_unseen_pages(spark, hosts, pages, others, recall, precision):
    """Layouts and languages not looked at before."""
    df, true = _unseen(spark, hosts, pages, others)
    got = {tuple(r) for r in boilerplate.furniture(df).collect()}
    assert len(got & true) >= recall * len(true) and len(got & true) >= precision * len(got)


def test_roles_beyond_the_broadcast(spark):
    df, _ = _unseen(spark, 2, 12, 30)
    want = sorted(map(tuple, boilerplate.furniture(df).collect()))
    old = boilerplate.BROADCAST_ROLES, boilerplate.BROADCAST_HOSTS
    try:
        boilerplate.BROADCAST_ROLES = boilerplate.BROADCAST_HOSTS = 0
        assert sorted(map(tuple, boilerplate.furniture(df).collect())) == want
        joined = sorted(map(tuple, boilerplate.main_texts(df).collect()))
    finally:
        boilerplate.BROADCAST_ROLES, boilerplate.BROADCAST_HOSTS = old
    assert sorted(map(tuple, boilerplate.main_texts(df).collect())) == joined


def test_templates_serve_all_operators(spark, common):
    df, _ = _unseen(spark, 2, 12, 30)
    f = boilerplate.Furniture(df)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(boilerplate.furniture(df, f), boilerplate.furniture(df)) and same(boilerplate.main_texts(df, f), boilerplate.main_texts(df))
    assert same(quality.scores(df.withColumn("lang", F.lit("pl")), common, f), quality.scores(df.withColumn("lang", F.lit("pl")), common))
    assert same(neardup.NearDuplicates(df, furniture=f).all_pairs(), neardup.NearDuplicates(df).all_pairs())


def test_own_title_is_main_text():
    assert boilerplate.is_title("the old mill of soba", "The Old Mill of Soba - Green Post", "www.green-post.example")
    assert boilerplate.is_title("fwd : the old mill", "The old mill", "a.example")
    assert not boilerplate.is_title("related : the old mill / the new bridge", "The old mill", "a.example")
    assert not boilerplate.is_title("home", "Home", "a.example")


def test_roles_cover_whole_lines():
    text = " ".join(f"w{k}x" for k in range(5000))  # depths 1 2 3 6 24 96 384 1536, and 2 4 16 ... 4096 from the end
    a, b = lines.Lines([text, text + " end"], [None, None]), lines.Lines(["q " + text], [None])
    line, role, parent, kind, depth = a.roles()
    assert depth[kind == lines.WHOLE].tolist() == [5000, 5001]
    first, second = ({(int(r), int(k)) for r, k, x in zip(role, kind, line, strict=True) if x == i} for i in (0, 1))
    assert len([1 for _, k in first & second if k == lines.FROM_BEGIN]) == 8 and not [1 for _, k in first & second if k in (lines.WHOLE, lines.FROM_END)]
    other = {(int(r), int(k)) for r, k in zip(b.roles()[1], b.roles()[3], strict=True)}
    assert len([1 for _, k in first & other if k == lines.FROM_END]) == 7
    assert set(parent[(kind == lines.FROM_BEGIN) & (depth > 1)].tolist()) <= set(role.tolist())


def test_copies_make_no_template(spark):
    rng = random.Random(9)
    words = [f"w{i}x" for i in range(300)]
    body = "\n".join(" ".join(rng.choice(words) for _ in range(9)) + "." for _ in range(6))
    rows = [(i, body, f"h{i % 5}.example") for i in range(80)] + [(500 + i, " ".join(rng.choice(words) for _ in range(20)), None) for i in range(80)]
    assert boilerplate.furniture(spark.createDataFrame(rows, "doc_id bigint, text string, site string")).count() == 0


def test_lines_keep_their_numbers():
    t = "a\n<b>x</b> &amp;\n\n&#10; y\r\n"
    assert len(lines.plain(t)) == len(t.split("\n"))
    assert lines.site_words("m.green-post.example") == "green post" and lines.site_words(None) == ""


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("- red stone\n- blue mill\n- old field\n- wide road", "list"), ("Apple, 3, 5\nPear, 7\nPlum, 9, 12", "list"), ("mill, valve, river, stone, tide\nfield, road, harbour, tower, gate", "list"),
        ("a\t1\t2\nb\t3\t4\nc\t5\t6\nd\t7\t8", "table"), ("x;1;2\ny;3;4\nz;5;6", "table"), ("18 4b 94 e7 bb ca 16 58\n2f 84 40 b9 49 1c 38 fc", "junk"), ("xkcd qwrt zzzpl mnbv lkjh gfds\nqqrw tplkj mnbb vvcx", "junk"),
        ("Wczesnym rankiem mieszkańcy wsi wyszli na pole, aby zebrać zboże przed deszczem. Nikt nie wiedział, że burza nadejdzie tak szybko.", "prose"), ("Aamulla kyläläiset lähtivät pellolle korjaamaan viljaa ennen sadetta. Kukaan ei tiennyt, että myrsky tulisi niin nopeasti ja että silta tuhoutuisi.", "prose"),
        ("name,age,city\nanna,12,oslo\nbob,33,bergen\ncarl,45,moss", "table"), ("mill 12 4.5\nriver 8 3.1\nstone 7 2.2", "table"), ("Cisza nad wodą\nptak nad lasem\nsen o morzu\ndom we mgle\nświt za górą\ndroga do domu", "prose"), ("I wandered by the river\nthe morning slow and grey\nno bird had come to answer", "prose"),
        ("t h e q u i c k b r o w n\nf o x j u m p s o v e r", "junk"), ("The mill of the village stood by the river.\n- red stone\nIt was the pride of the valley.", "prose"), ("THE MILL OF THE VILLAGE STOOD BY THE RIVER.", "prose"), ("Short one.", "prose"),
    ],
)
def test_make_up_of_lines(text, kind):
    k = quality.lines_by_kind(text, frozenset("the of by it was and".split()))
    assert max(k, key=k.get) == kind and k[kind] > 0.5 * sum(k.values())


@pytest.mark.parametrize("n", [1, 5])
def test_records_all_alike(spark, common, n):
    text = "- red stone\n- blue mill\n- old field\n- wide road"
    df = spark.createDataFrame([(i, text, None, "en") for i in range(n)], "doc_id bigint, text string, site string, lang string")
    assert sorted(map(tuple, quality.no_prose(df, common).collect())) == [(i, "list") for i in range(n)]


def test_scores_by_hand(spark, common):
    """Scores against a plain computation, with values sent to workers and without."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "of", "mill", "river", "stones", "a"]) for _ in range(rng.randint(3, 30))) + rng.choice([".", "", "!"]) for _ in range(150)]
    rows = [(i, t, None, rng.choice(["en", "EN-us", "pl", None, "und"])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, site string, lang string")
    stats = {r["doc_id"]: r for r in quality.statistics(df, common).collect()}
    total = {}
    for i, r in stats.items():
        s = 0.0
        for name, side in quality.FIGURES.items():
            tails = []
            for group in ([x for x in stats.values() if x["lang"] == r["lang"]], list(stats.values())):
                high, low = (sum(f(x[name]) for x in group) / len(group) for f in (lambda v, r=r, n=name: v >= r[n], lambda v, r=r, n=name: v <= r[n]))
                tails.append(high if side > 0 else low if side < 0 else min(1.0, 2 * min(high, low)))
            s -= np.log(min(tails))
        total[i] = s
    old = quality.BROADCAST_VALUES, quality.HEAVY
    try:
        for quality.BROADCAST_VALUES, quality.HEAVY in (old, (0, old[1]), (old[0], 0.2)):
            got = {r["doc_id"]: r["score"] for r in quality.scores(df, common).collect()}
            assert got == pytest.approx(total, abs=2e-6)
    finally:
        quality.BROADCAST_VALUES, quality.HEAVY = old
    assert {quality.language(x) for x in ("en", "EN-us", " eng ", "en_GB")} == {"en"} and quality.language("und") == quality.language(None) == quality.OTHER


def test_columns_with_blocks(spark):
    """Many entries of one shingle are divided into blocks; no pair is lost or doubled."""
    rng = random.Random(6)
    base = [f"v{i}" for i in range(40)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(40)] = f"u{i}"
        rows.append((i, " ".join(w), None))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, site string")
    want = neardup.NearDuplicates(df).all_pairs().count()
    old = neardup.COLUMN
    try:
        neardup.COLUMN = 16
        small = {tuple(r) for r in neardup.NearDuplicates(df).all_pairs().collect()}
    finally:
        neardup.COLUMN = old
    sets = [{tuple(t.split()[k : k + 3]) for k in range(38)} for _, t, _ in rows]
    true = {(a, b) for a in range(60) for b in range(a + 1, 60) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert small == true and want == len(true)


def test_large_classes_are_divided(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(30)), None) for i in range(40)], "doc_id bigint, text string, site string")
    old = neardup.COLUMN
    try:
        neardup.COLUMN = 7
        got = sorted(map(tuple, neardup.NearDuplicates(df).all_pairs().collect()))
    finally:
        neardup.COLUMN = old
    assert got == [(a, b) for a in range(40) for b in range(a + 1, 40)]


def test_frequent_terms_beyond_the_broadcast(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, [f"t{int(rng.random() ** 3 * 80)}" for _ in range(30)]) for i in range(120)], "doc_id bigint, terms array<string>")
    a = sorted(map(tuple, distinct_terms.most_distinctive(df).collect()))
    old = distinct_terms.BROADCAST_TERMS
    try:
        every = sorted(map(tuple, distinct_terms.record_weights(df).collect()))
        distinct_terms.BROADCAST_TERMS = 0
        b = sorted(map(tuple, distinct_terms.most_distinctive(df).collect()))
        assert sorted(map(tuple, distinct_terms.record_weights(df).collect())) == every and len(every) > 360
    finally:
        distinct_terms.BROADCAST_TERMS = old
    assert a == b and len(a) == 360
    assert F is not None


def _phrase_texts(seed, n=250, phrases=20, of=6, length=20):
    """Texts of phrases out of a small stock: most pairs share some phrase, few share most of them."""
    rng = random.Random(seed)
    return [(i, " ".join(f"p{p}x{k}" for p in rng.sample(range(phrases), of + i % 3) for k in range(length)), None) for i in range(n)]


def _true_pairs(rows, t):
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (text.split() for _, text, _ in rows)]
    return {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def test_texts_that_share_a_phrase_are_not_paired(spark):
    """Few of all pairs leave the product, though most share shingles, and the true ones are among them."""
    rows = _phrase_texts(8, phrases=100, of=10, length=12)
    rows += [(250 + i, " ".join(f"z{i}y{k}" if k < 15 else w for k, w in enumerate(text.split())), None) for i, text, _ in rows[:40]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, site string")
    s = neardup.sets(df).cache()
    blocks = neardup.entries(s, neardup.sketch(s), 0.5).repartition(2, "cell").sortWithinPartitions("cell", "size_at")
    left = {(r["a"], r["b"]) for r in neardup.arrow_map(blocks, neardup._multiply(0.5), "a bigint, b bigint, counts int").collect()}
    true = _true_pairs(rows, 0.5)
    assert len(true) >= 40 and true <= left and len(left) <= 0.06 * len(rows) * (len(rows) - 1) / 2


@pytest.mark.parametrize(("t", "words", "rare"), [(0.3, 8, 0), (0.5, 1, 0), (0.5, 8, 1000), (0.5, 8, 3), (0.8, 2, 0)])
def test_signs_lose_no_pair(spark, t, words, rare):
    rows = _phrase_texts(int(10 * t) + words, n=120, phrases=12, length=9)
    rows += [(120 + i, text + f" u{i} v{i}", None) for i, text, _ in rows[:9]] + [(130 + i, f"a b c d u{i}", None) for i in range(4)]
    rows = [(i, text, None) for i, (_, text, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, site string")
    old = neardup.WORDS, neardup.RARE, neardup.COLUMN
    try:
        neardup.WORDS, neardup.RARE, neardup.COLUMN = words, rare, 32
        got = sorted(map(tuple, neardup.NearDuplicates(df, threshold=t, least_words=1).all_pairs().collect()))
    finally:
        neardup.WORDS, neardup.RARE, neardup.COLUMN = old
    want = _true_pairs(rows, t)
    assert got == sorted(want) and want


@pytest.mark.parametrize("lists", [1, 5, 7, 9])
def test_kind_does_not_depend_on_other_records(spark, common, lists):
    """Lists are found however many there are, also where they are the ordinary records."""
    texts = ["- red stone\n- blue mill\n- old field\n- wide road"] * lists + ["The old mill by the river was as old as the town. The stones of it were red."] * (10 - lists)
    df = spark.createDataFrame([(i, t, None, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, site string, lang string")
    assert sorted(map(tuple, quality.no_prose(df, common).collect())) == [(i, "list") for i in range(lists)]
