"""Queries of the subpackage against SQL, and against brute force on the smallest tables."""

import math
import os
import re
import sys
from collections import Counter, defaultdict

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare  # noqa: E402

from scriptorium.llm import boilerplate, markup, neardup  # noqa: E402
from scriptorium.llm.queries import ORACLES, QUERIES  # noqa: E402
from scriptorium.session import load  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, data, name):
    assert compare(spark, data, QUERIES[name], ORACLES[name]) is None


#: Columns of the queries without SQL, and those that name a row.
SHAPES = {
    "p1_found": ("doc_id kind", "doc_id kind"), "p1_clean": ("doc_id text kinds region_begin region_end", "doc_id"), "p3_found": ("doc_a doc_b", "doc_a doc_b"), "p3_groups": ("doc_id group_id links", "doc_id"),
    "p7_found": ("doc_id line_no", "doc_id line_no"), "p7_main_text": ("doc_id text", "doc_id"), "p8_ids": ("doc_id ids", "doc_id"), "p9_found": ("source", "source"), "p10_found": ("doc_id kind", "doc_id"),
    "p9_shares": ("source target_share rate docs emitted_docs emitted_tokens actual_share", "source"), "p9_mixture": ("doc_id source copy n", "doc_id copy"), "p10_scores": ("doc_id score least_tail list_share table_share junk_share", "doc_id"),
    "p10_statistics": ("doc_id lang words mean_word_length symbol_share ends_share common_share list_share table_share junk_share", "doc_id"),
}
#: Queries with one row for each document, whatever its text.
WHOLE = {"p1_clean", "p3_groups", "p7_main_text", "p8_ids"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_shape(spark, data, name):
    columns, keys = SHAPES[name]
    df = QUERIES[name](spark, data)
    assert df.columns == columns.split()
    rows = [tuple(r[k] for k in keys.split()) for r in df.select(*keys.split()).collect()]
    assert rows and len(set(rows)) == len(rows)
    docs = {r["doc_id"] for r in load(spark, data, "documents").select("doc_id").collect()}
    if name in WHOLE:
        assert {r[0] for r in rows} == docs
    elif keys.startswith("doc"):
        assert {r[0] for r in rows} <= docs


def test_encoding_equals_library(spark, data):
    import base64

    import tiktoken

    from scriptorium.llm.encode import Encoder

    e = Encoder()
    docs = {r["doc_id"]: r["text"] for r in load(spark, data, "documents").select("doc_id", "text").collect()}
    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=e.encoding._pat_str, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in QUERIES["p8_ids"](spark, data).collect()}
    assert got == {d: lib.encode_ordinary(t or "") for d, t in docs.items()}


def _main_words(spark, data):
    docs = load(spark, data, "documents")
    found = {r["doc_id"]: r["lines"] for r in boilerplate.Furniture(docs).marks(docs).collect()}
    out = {}
    for r in docs.select("doc_id", "text").collect():
        if r["text"]:
            t = markup.clean(boilerplate.without_lines(r["text"], found.get(r["doc_id"]))).lower().replace("'", "").replace("’", "")
            out[r["doc_id"]] = re.findall(r"[^\W_]+", t)
    return out


@pytest.mark.parametrize(("run", "t"), [(3, 0.5), (5, 0.8)])
def test_near_duplicates_brute_force(spark, data, run, t):
    sets = {d: {tuple(w[i : i + run]) for i in range(len(w) - run + 1)} for d, w in _main_words(spark, data).items() if len(w) >= 20}
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}
    n = neardup.NearDuplicates(load(spark, data, "documents"), run, t)
    assert {tuple(r) for r in n.all_pairs().collect()} == want
    links = Counter(x for p in want for x in p)
    parent = {d: d for d in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["group_id"], r["links"]) for r in n.groups().collect()}
    assert got == {d: (top(d), links[d]) for d in ids}


def test_mixing_by_hand(spark, data):
    ids = {r["doc_id"]: len(r["ids"]) for r in QUERIES["p8_ids"](spark, data).collect()}
    tokens = defaultdict(int)
    for r in load(spark, data, "documents").select("doc_id", "source").collect():
        tokens[(r["source"] or "").strip(" ").lower()] += ids[r["doc_id"]]
    total = sum(tokens.values())
    t = load(spark, data, "mix_targets").collect()
    want = {r["source"] for r in t if r["target_share"] * total > r["max_repeats"] * tokens[r["source"].strip().lower()]}
    assert {r["source"] for r in QUERIES["p9_found"](spark, data).collect()} == want
    for r in QUERIES["p9_shares"](spark, data).collect():
        planned = r["rate"] * tokens[r["source"]]
        assert abs(r["emitted_tokens"] - planned) <= max(0.25 * planned, 4000)


def test_exact_ranks(spark, data):
    from scriptorium.llm.quality import ranks

    rows = [(g, v, n) for g in ("a", "b", None) for v, n in ((1, 5), (3, 1), (2, 2), (10, 4))]
    df = spark.createDataFrame(rows, "g string, v int, n bigint")
    got = {(r["g"], r["v"]): (r["below"], r["up_to"]) for r in ranks(df, ["g"], "v", "n").collect()}
    assert got == {(g, v): x for g in ("a", "b", None) for v, x in ((1, (0, 5)), (2, (5, 7)), (3, (7, 8)), (10, (8, 12)))}


def test_residual_idf_by_hand(spark):
    from scriptorium.llm.distinct_terms import residual_idf

    df = spark.createDataFrame([(1, ["A ", "a", None, ""]), (2, ["b", "a"]), (3, None), (4, ["c"])], "doc_id bigint, terms array<string>")
    got = {r["term"]: (r["document_count"], r["collection_count"], r["weight"]) for r in residual_idf(df).collect()}
    w = lambda d, c: round(d * (math.log2(3 / d) + math.log2(1 - math.exp(-c / 3))), 4)
    assert got == {"a": (2, 3, pytest.approx(w(2, 3))), "b": (1, 1, pytest.approx(w(1, 1))), "c": (1, 1, pytest.approx(w(1, 1)))}
