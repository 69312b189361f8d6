"""Command line: ``python -m scriptorium.cli VERB ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F


def _engine(spark, path, **params):
    from scriptorium.operators.index import Index
    from scriptorium.operators.retrieval import Engine

    return Engine(Index.open(spark, path), **params)


def _queries(path: str) -> dict[str, str]:
    """Queries of a JSON file ({"queries": [{"number", "text"}]}) or tab-separated lines."""
    with open(path, encoding="utf-8") as f:
        s = f.read()
    if s.lstrip().startswith("{"):
        return {str(q["number"]): q["text"] for q in json.loads(s)["queries"]}
    return dict(line.split("\t", 1) for line in s.splitlines() if "\t" in line)


def build(spark, a) -> None:
    from scriptorium.functions.stemmers import stemmed_postings
    from scriptorium.operators.index import build_from as make
    from scriptorium.operators.index import dense_ids
    from scriptorium.sources.readers import read

    docs = dense_ids(read(spark, a.input, a.format), "name")
    i = make(docs, "docid", name="name")
    for s in a.stemmer or ():
        i.postings = i.postings.unionByName(stemmed_postings(i.postings, s))
    i.save(a.index)
    if a.corpus:
        docs.write.mode("overwrite").parquet(f"{a.index}/corpus")


def search(spark, a) -> None:
    _engine(spark, a.index, scorer=a.scorer).search(a.query, a.k, explain=a.explain).orderBy("rank").show(a.k, truncate=False)


def batch_search(spark, a) -> None:
    from scriptorium.sources import writers

    e = _engine(spark, a.index, scorer=a.scorer)
    q = _queries(a.queries)
    r = e.search_feedback(q, a.k) if a.feedback else e.search_batch(q, a.k)
    writers.run(e.named(r).withColumnRenamed("name", "docno"), a.output)


def evaluate(spark, a) -> None:
    from scriptorium.operators import evaluation as E
    from scriptorium.sources import writers

    judged = E.judgments(writers.read_qrels(spark, a.qrels))
    runs = [E.evaluate(writers.read_run(spark, r).select("qid", "docno", "rank"), judged, a.cut) for r in a.run]
    for r in runs:
        (r if a.details else E.aggregate(r, [c for c in r.columns if c != "qid"])).show(1000, truncate=False)
    if len(runs) > 1:
        print(json.dumps(E.compare(E.pairs(runs[0], runs[1], a.metric)), indent=1))


def dump(spark, a) -> None:
    from scriptorium.operators.index import Index

    i = Index.open(spark, a.index)
    what = {"term-stats": i.term_stats, "field-stats": i.field_stats, "vocabulary": i.vocabulary, "forward": i.forward}
    t = what[a.what]() if a.what in what else getattr(i, a.what)
    if a.term:
        t = t.where(F.col("term") == a.term)
    if a.doc is not None:
        t = t.where(F.col("docid") == a.doc)
    t.show(a.rows, truncate=False)


def count(spark, a) -> None:
    cf, df, top = _engine(spark, a.index).node_statistics(a.query)
    print(json.dumps({"occurrences": cf, "documents": df, "most_in_one": top}))


def plan(spark, a) -> None:
    print(_engine(spark, a.index).plan(a.query))


def operators(spark, a) -> None:
    from scriptorium.plans import rewrites as R

    for name, ops in (("counts", R.COUNTS), ("conditions", R.BOOLS), ("scores", R.SCORES), ("filters", R.MIXED), ("aliases", R.ALIASES)):
        print(f"{name}: {' '.join('#' + o for o in ops)}")


def feedback(spark, a) -> None:
    _engine(spark, a.index).feedback_terms({"q": a.query}, a.docs, a.terms).orderBy(F.desc("weight")).show(a.terms, truncate=False)


def windows(spark, a) -> None:
    from scriptorium.operators.index import tokenized
    from scriptorium.operators.ngrams import frequent_windows

    docs = spark.read.parquet(f"{a.index}/corpus")
    t = tokenized(docs, "docid", name="name")
    if a.stemmer:
        from scriptorium.functions.stemmers import stemmed_tokens

        t = stemmed_tokens(t, a.stemmer)
    frequent_windows(t, a.n, a.width, a.threshold, not a.unordered, not a.occurrences).write.mode("overwrite").parquet(f"{a.index}/windows")


def links(spark, a) -> None:
    from scriptorium.operators import links as L
    from scriptorium.sources.readers import read

    pages = read(spark, a.input, a.format).select(F.col("name").alias("page_id"), F.col("metadata")["url"].alias("url"), F.col("text").alias("html"))
    x = L.resolve(L.extract(pages), pages)
    x.write.mode("overwrite").parquet(f"{a.output}/links")
    L.typed(x).write.mode("overwrite").parquet(f"{a.output}/link-index")
    L.harvest_lines(L.extract(pages), pages).write.mode("overwrite").text(f"{a.output}/harvest")
    r = L.pagerank(x.select(F.col("page").alias("src"), F.col("dest").alias("dst")), pages.select(F.col("page_id").alias("node")))
    r.write.mode("overwrite").parquet(f"{a.output}/pagerank")
    L.rank_lines(r).write.mode("overwrite").text(f"{a.output}/pagerank.txt")


def build_part(spark, a) -> None:
    """Priors or indicators from lines of a name and a value."""
    from scriptorium.operators import parts
    from scriptorium.operators.index import Index

    i = Index.open(spark, a.index)
    lines = spark.read.text(a.lines)
    t = parts.indicators_from_lines(lines, i.names, a.name) if a.kind == "indicator" else parts.values_from_lines(lines, i.names, a.name, a.log)
    i.save_side(a.index, {"indicator": "indicators", "prior": "priors"}[a.kind] + "_" + a.name, t)


def conflate(spark, a) -> None:
    from scriptorium.functions import stemmers
    from scriptorium.operators.index import Index
    from scriptorium.operators.ngrams import conflation

    i = Index.open(spark, a.index)
    v = i.vocabulary()
    i.save_side(a.index, f"conflation_{a.stemmer}", conflation(v, stemmers.dictionary_stems(v) if a.stemmer == "dictionary" else stemmers.stems(v, a.stemmer)))


def document(spark, a) -> None:
    """A document's id, name, length and terms, found by either."""
    from scriptorium.operators.index import Index

    i = Index.open(spark, a.index)
    n = i.names.where((F.col("name") == a.document) | (F.col("docid").cast("string") == a.document))
    found = n.join(i.lengths.where("field = 'document'"), "docid", "left").select("docid", "name", "length")
    found.show(truncate=False)
    if a.terms:
        p = i.postings.where("part = 'postings'").join(F.broadcast(n.limit(1).select("docid")), "docid")
        p.select("docid", F.posexplode("positions").alias("k", "at"), "term").select("docid", "at", "term").orderBy("at").show(a.rows, truncate=False)


def timed_search(spark, a) -> None:
    """Each query alone, with its seconds; and the batch of all."""
    import time

    e = _engine(spark, a.index, scorer=a.scorer)
    out, q = {}, _queries(a.queries)
    for k, t in q.items():
        began = time.time()
        n = len(e.search(t, a.k).collect())
        out[k] = {"seconds": round(time.time() - began, 3), "results": n}
    began = time.time()
    e.search_batch(q, a.k).write.format("noop").mode("overwrite").save()
    print(json.dumps({"queries": out, "batch_seconds": round(time.time() - began, 3)}))


def rerank(spark, a) -> None:
    """Queries of the first file, their best documents scored anew by those of the second."""
    from scriptorium.sources import writers

    e = _engine(spark, a.index, scorer=a.scorer)
    second, out = _queries(a.second), None
    for k, t in _queries(a.first).items():
        one = e.two_pass(t, second.get(k, t), a.k, a.working).select(F.lit(k).alias("qid"), F.col("name").alias("docno"), "score", "rank")
        out = one if out is None else out.unionByName(one)
    writers.run(out, a.output)


def annotate(spark, a) -> None:
    """Every leaf of a query's tree with its occurrences and documents."""
    from scriptorium.plans.query import walk
    from scriptorium.plans.rewrites import SCORERS

    e = _engine(spark, a.index)
    tree = e.plan(a.query)
    counted = list(dict.fromkeys(n.children[0] for n in walk(tree) if n.op in SCORERS))
    got = e.trees.node_stats(counted)
    c = e.trees.collection()
    print(json.dumps({"query": str(tree), "documents": c.documents, "length": c.length, "nodes": [{"node": str(n), "occurrences": got[n][0], "documents": got[n][1], "most_in_one": got[n][2]} for n in counted]}, indent=1))


def token_statistics(spark, a) -> None:
    """Counts over raw input, without an index."""
    from scriptorium.operators.index import tokenized
    from scriptorium.sources.readers import read

    t = tokenized(read(spark, a.input, a.format).withColumn("docid", F.xxhash64("name")), "docid", name="name")
    n = F.size("tokens")
    t.agg(F.count("*").alias("documents"), F.sum(n).alias("tokens"), F.max(n).alias("longest"), F.avg(n).alias("mean")).show()
    t.select(F.explode("tokens").alias("term")).groupBy("term").count().orderBy(F.desc("count"), "term").show(a.rows, truncate=False)


def repair(spark, a) -> None:
    from scriptorium.operators.index import Index

    print(json.dumps({"mended": Index.repair(spark, a.index)}))


def merge_indexes(spark, a) -> None:
    from scriptorium.operators.index import Index, merge

    merge([Index.open(spark, p) for p in a.inputs], renumber=a.renumber).save(a.index)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scriptorium", description="Retrieval and ranking analytics on Spark")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name, f, *args, **options):
        s = sub.add_parser(name)
        for x in args:
            s.add_argument(x)
        for k, v in options.items():
            s.add_argument("--" + k.replace("_", "-"), **(v if isinstance(v, dict) else {"default": v, "type": type(v)} if v is not None else {}))
        s.set_defaults(do=f)

    flag, many = {"action": "store_true"}, {"action": "append"}
    verb("build-index", build, "input", "index", format=None, stemmer=many, corpus=flag)
    verb("search", search, "index", "query", k=10, scorer="dirichlet", explain=flag)
    verb("batch-search", batch_search, "index", "queries", "output", k=1000, scorer="dirichlet", feedback=flag)
    s = sub.add_parser("eval")
    s.add_argument("qrels")
    s.add_argument("run", nargs="+")
    s.add_argument("--cut", type=int, default=10)
    s.add_argument("--metric", default="ap")
    s.add_argument("--details", action="store_true")
    s.set_defaults(do=evaluate)
    s = sub.add_parser("dump-index")
    s.add_argument("index")
    s.add_argument("what", choices=["postings", "lengths", "names", "extents", "fields", "term-stats", "field-stats", "vocabulary", "forward"])
    s.add_argument("--term")
    s.add_argument("--doc", type=int)
    s.add_argument("--rows", type=int, default=50)
    s.set_defaults(do=dump)
    verb("count", count, "index", "query")
    verb("plan", plan, "index", "query")
    verb("operators", operators)
    verb("feedback-terms", feedback, "index", "query", docs=20, terms=50)
    verb("build-windows", windows, "index", n=2, width=1, threshold=2, unordered=flag, occurrences=flag, stemmer=None)
    verb("build-part", build_part, "index", "lines", "name", kind={"choices": ["prior", "indicator"], "default": "prior"}, log=flag)
    verb("build-conflation", conflate, "index", stemmer="porter2")
    verb("document", document, "index", "document", terms=flag, rows=1000)
    verb("timed-search", timed_search, "index", "queries", k=1000, scorer="dirichlet")
    verb("rerank", rerank, "index", "first", "second", "output", k=1000, working=10_000, scorer="dirichlet")
    verb("annotate", annotate, "index", "query")
    verb("token-statistics", token_statistics, "input", format=None, rows=50)
    verb("repair", repair, "index")
    verb("links", links, "input", "output", format=None)
    s = sub.add_parser("merge")
    s.add_argument("index")
    s.add_argument("inputs", nargs="+")
    s.add_argument("--renumber", action="store_true")
    s.set_defaults(do=merge_indexes)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from scriptorium.session import build_session

    a.do(None if a.verb == "operators" else build_session(f"scriptorium {a.verb}"), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
