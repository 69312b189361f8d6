"""Retrieval: single queries, batches in one job, feedback, passages.

A batch of weighted queries is one plan: the postings of its terms meet a small table of query
leaves, scores add up per query and document (partial sums before the shuffle), and only the
best k of each query go on. Leaves a document lacks still count with their background score:
their part depends on the document's length alone and is added in closed form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import scoring as S
from scriptorium.functions.text import STOPWORDS
from scriptorium.operators.index import Index, merge
from scriptorium.plans.query import Node, parse, transform, walk, weights_of
from scriptorium.plans.rewrites import rewrite
from scriptorium.plans.tree import TreePlan, _Context
from scriptorium.session import durable

#: Most rows of results sent to every worker for their names.
BROADCAST_RESULTS = 200_000
_LEAF = "qid string, leaf string, weight double, scorer string, p1 double, p2 double"
_DEFINITION = "leaf string, form string, width int, part string, child int, children int, term string"
#: First and second parameter of each scorer, with defaults. Fixed values.
_PARAMS = {"dirichlet": (("mu", 1500.0), ("", 0.0)), "jm": (("lambda", 0.5), ("", 0.0)), "bm25": (("b", 0.75), ("k", 1.2)), "pl2": (("c", 1.0), ("", 0.0)), "inl2": (("c", 1.0), ("", 0.0)), "bil2": (("c", 1.0), ("", 0.0))}


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame:
    """The k best rows (of each ``by``) with ``rank`` from 1: score descending, then docid, then
    ``extra``. Spark cuts each partition to k rows of a group before it shuffles."""
    w = Window.partitionBy(*(by or (F.lit(0),))).orderBy(F.desc("score"), "docid", *extra)
    if not by:
        scored = scored.orderBy(F.desc("score"), "docid", *extra).limit(k)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Engine:
    """Queries over one index. ``params`` are defaults of all queries (scorer, mu, ...)."""

    def __init__(self, index: Index, priors: DataFrame | None = None, indicators: DataFrame | None = None, **params):
        self.index, self.params = index, params
        self.trees = TreePlan(index, priors, indicators)

    def _stats(self, n: Node, ratio: str | None = None):
        cf, df, _ = self.trees.node_stats([n])[n]
        return (cf / max(1, self.trees.collection(ratio).length)) if ratio else (cf, df)

    def plan(self, query: str | Node, **params) -> Node:
        """The rewritten tree."""
        n = parse(query) if isinstance(query, str) or query is None else query
        return rewrite(n, {**self.params, **params}, self._stats)

    def named(self, result: DataFrame) -> DataFrame:
        """``result`` (a top-k list, written once) with names. A list of up to
        ``BROADCAST_RESULTS`` rows is broadcast to the table of names, which is then scanned but
        never shuffled."""
        top = durable(result, "top")
        few = top.count() <= BROADCAST_RESULTS
        send = F.broadcast if few else (lambda x: x)
        own = self.index.names.join(send(top.select("docid").distinct()), "docid", "left_semi")
        return top.join(send(own), "docid", "left")

    def search(self, query: str | Node, k: int = 1000, working_set: DataFrame | None = None, explain: bool = False, **params) -> DataFrame:
        """(docid, score, rank, name[, leaves]) of one query; any operator may be used."""
        return self.named(top_k(self.trees.scored(self.plan(query, **params), working_set, explain), k))

    def boolean(self, query: str | Node, **params) -> DataFrame:
        """(docid): all documents that satisfy a condition, unranked."""
        return self.trees.scored(self.plan(query, **params)).select("docid")

    def passages(self, query: str | Node, size: int, shift: int, k: int = 1000, best_only: bool = False, working_set: DataFrame | None = None, **params) -> DataFrame:
        """(docid, begin, end, score, rank); ``best_only`` keeps each document's best passage."""
        p = self.trees.passages(self.plan(query, **params), size, shift, working_set)
        if best_only:
            best = F.min_by(F.struct("begin", "end", "score"), F.struct((-F.col("score")).alias("s"), F.col("begin")))
            p = p.groupBy("docid").agg(best.alias("b")).select("docid", "b.*")
        return top_k(p, k, extra=("begin",))

    def two_pass(self, first: str, second: str, k: int = 1000, working: int = 10_000, **params) -> DataFrame:
        """Scores by ``second`` only the best ``working`` documents of ``first``."""
        ws = top_k(self.trees.scored(self.plan(first, **params)), working).select("docid")
        return self.search(second, k, working_set=ws, **params)

    def node_statistics(self, query: str | Node, **params) -> tuple[int, int, int]:
        """(cf, df, max tf) of a counted node, windows included."""
        from scriptorium.plans.rewrites import names

        n = names(parse(query) if isinstance(query, str) else query, {})
        return self.trees.node_stats([n])[n]

    # --- batches ------------------------------------------------------------------------------

    def leaves(self, queries: dict[str, str | Node], **params) -> tuple[list, list] | None:
        """Rows of the leaf and definition tables, or None if a query needs the tree plan."""
        rows, defs, seen = [], [], set()
        for qid, q in queries.items():
            flat = _flat(self.plan(q, **params), 1.0)
            if flat is None:
                return None
            for n, w in flat:
                c = n.children[0]
                form = "term" if c.op == "text" else {"bigram": "ordered", "ubigram": "unordered"}.get(c.op, c.op)
                width = 0 if form == "term" else int(c.get("default", 1 if c.op == "bigram" else -1))
                (k1, d1), (k2, d2) = _PARAMS[n.op]
                scorer = n.op + ("-lite" if n.get("profile") == "lite" else "")
                rows.append((str(qid), str(c), w, scorer, float(n.get(k1, d1)), float(n.get(k2, d2))))
                if c not in seen:
                    seen.add(c)
                    kids = [c] if form == "term" else list(c.children)
                    defs += [(str(c), form, width, str(t.get("part", "postings")), i, len(kids), str(t.get("default"))) for i, t in enumerate(kids)]
        return rows, defs

    def search_batch(self, queries: dict[str, str | Node], k: int = 1000, **params) -> DataFrame:
        """(qid, docid, score, rank) of all queries; those that are weighted sums of terms and
        windows make one job, the others are planned one by one beside it."""
        spark = self.index.postings.sparkSession
        plans = {str(q): self.plan(t, **params) for q, t in queries.items()}
        flat = {q: n for q, n in plans.items() if _flat(n, 1.0) is not None}
        out = None
        if flat or not plans:
            rows, defs = self.leaves(flat, **params)
            out = self.score_leaves(spark.createDataFrame(rows, _LEAF), spark.createDataFrame(defs, _DEFINITION), k, any(r[1] != "term" for r in defs), sorted({(r[3], r[6]) for r in defs}))
        for q, n in plans.items():
            if q not in flat:
                one = top_k(self.trees.scored(n), k).select(F.lit(q).alias("qid"), "docid", "score", "rank")
                out = one if out is None else out.unionByName(one)
        return out

    def score_leaves(self, leaves: DataFrame, definitions: DataFrame, k: int, windows: bool = True, known: list[tuple[str, str]] | None = None) -> DataFrame:
        c = self.trees.collection()
        counts = node_counts(self.index, definitions, windows, known)
        # one row per leaf of the query set, whatever the size of the collection
        stats = counts.groupBy("leaf").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
        # used twice, so it is written: the postings are read once for it and once for the scores
        full = durable(leaves.join(stats, "leaf", "left").fillna({"cf": 0, "df": 0}), "leaves")
        cf, df = F.col("cf").cast("double"), F.col("df").cast("double")
        bg = S.background(cf, c.length)
        lone = F.when(F.col("scorer") == "dirichlet", F.log(F.col("p1") * bg)).when(F.col("scorer") == "jm", F.log((1.0 - F.col("p1")) * bg)).otherwise(0.0)
        # what a document without any leaf would get: lone - the sum of mass x log(length + mu),
        # mass by mu, since leaves of one query may be smoothed differently
        mass = F.when(F.col("scorer") == "dirichlet", F.struct(F.col("p1").alias("mu"), F.col("weight").alias("mass")))
        base = full.groupBy("qid").agg(F.sum(F.col("weight") * lone).alias("lone"), F.collect_list(mass).alias("masses"))
        j = counts.join(F.broadcast(full), "leaf")
        tf, dl = F.col("tf").cast("double"), F.col("length").cast("double")
        p1, p2, n, mean = F.col("p1"), F.col("p2"), c.documents, c.mean_length
        own = (
            F.when(F.col("scorer") == "dirichlet", F.log(tf / (p1 * bg) + 1.0))
            .when(F.col("scorer") == "jm", F.log(p1 * tf / dl + (1.0 - p1) * bg) - F.log((1.0 - p1) * bg))
            .when(F.col("scorer") == "bm25", S.bm25(tf, dl, df, n, mean, p1, p2))
            .when(F.col("scorer") == "bm25-lite", S.bm25(tf, dl, df, n, mean, p1, p2, "lite"))
            .when(F.col("scorer") == "pl2", S.pl2(tf, dl, cf, n, mean, p1))
            .when(F.col("scorer") == "inl2", S.inl2(tf, dl, df, n, mean, p1))
            .otherwise(S.bil2(tf, dl, df, n, mean, p1))
        )
        s = j.groupBy("qid", "docid").agg(F.sum(F.col("weight") * own).alias("own"), F.first("length").alias("length"))
        s = s.join(F.broadcast(base), "qid")
        lost = F.aggregate("masses", F.lit(0.0), lambda x, m: x + m["mass"] * F.log(F.col("length") + m["mu"]))
        score = F.col("own") + F.col("lone") - lost
        return top_k(s.select("qid", "docid", score.alias("score")), k, by=("qid",))

    def feedback_terms(self, queries: dict[str, str], fb_docs: int = 20, fb_terms: int = 100, stopwords: list[str] | None = None, **params) -> DataFrame:
        """(qid, term, weight): relevance-model terms of the best documents of each query.

        A document's weight is the softmax of its score among them; a term's is the mean over
        them of weight x tf / length. Stop words and query words are left out; ties by term.
        """
        spark = self.index.postings.sparkSession
        first = durable(self.search_batch(queries, fb_docs, **params), "first-pass")
        w = Window.partitionBy("qid")
        e = F.exp(F.col("score") - F.max("score").over(w))
        post = first.select("qid", "docid", (e / F.sum(e).over(w) / F.count("*").over(w)).alias("post"))
        # queries x fb_docs rows; the postings are read once, and met where they lie
        t = self.index.postings.where(F.col("part") == "postings").join(F.broadcast(post), "docid")
        g = t.groupBy("qid", "term").agg(F.sum(F.col("post") * F.col("tf") / F.col("length")).alias("weight"))
        own = [(str(q), str(n.get("default"))) for q, x in queries.items() for n in walk(parse(x) if isinstance(x, str) else x) if n.op == "text"]
        g = g.join(F.broadcast(spark.createDataFrame(own or [("", "")], "qid string, term string").distinct()), ["qid", "term"], "left_anti")
        g = g.where(~F.col("term").isin(list(STOPWORDS if stopwords is None else stopwords)))
        r = Window.partitionBy("qid").orderBy(F.desc("weight"), "term")
        return g.withColumn("r", F.row_number().over(r)).where(F.col("r") <= fb_terms).drop("r")

    def search_feedback(self, queries: dict[str, str], k: int = 1000, fb_docs: int = 20, fb_terms: int = 100, fb_weight: float = 0.25, stopwords: list[str] | None = None, **params) -> DataFrame:
        """(qid, docid, score, rank): the query with weight ``fb_weight`` mixed with the feedback
        terms. The expanded queries never leave the cluster."""
        spark = self.index.postings.sparkSession
        scorer = {**self.params, **params}.get("scorer", "dirichlet")
        (k1, d1), (k2, d2) = _PARAMS[scorer]
        get = lambda key, d: float({**self.params, **params}.get(key, d)) if key else d
        both = self.leaves(queries, **params)
        if both is None:
            raise ValueError("feedback needs queries that are weighted sums of terms and windows")
        # queries x fb_terms rows, used four times: cut, so that the first pass runs once
        terms = durable(self.feedback_terms(queries, fb_docs, fb_terms, stopwords, **params), "feedback")
        share = F.col("weight") / F.sum("weight").over(Window.partitionBy("qid"))
        leaf = F.concat(F.lit("#text:"), F.col("term"), F.lit("()"))
        more = terms.select("qid", leaf.alias("leaf"), ((1.0 - fb_weight) * share).alias("weight"), F.lit(scorer).alias("scorer"), F.lit(get(k1, d1)).alias("p1"), F.lit(get(k2, d2)).alias("p2"))
        old = spark.createDataFrame(both[0], _LEAF).withColumn("weight", F.col("weight") * fb_weight)
        defs = terms.select(leaf.alias("leaf"), F.lit("term").alias("form"), F.lit(0).alias("width"), F.lit("postings").alias("part"), F.lit(0).alias("child"), F.lit(1).alias("children"), "term").distinct()
        all_defs = spark.createDataFrame(both[1], _DEFINITION).unionByName(defs).distinct()
        known = None
        if terms.select("term").distinct().count() <= SCAN_TERMS:
            known = sorted({(r[3], r[6]) for r in both[1]} | {("postings", r["term"]) for r in terms.select("term").distinct().collect()})
        return self.score_leaves(old.unionByName(more), all_defs, k, any(r[1] != "term" for r in both[1]), known)

    def with_relevance(self, query: str | Node, relevant: DataFrame, **params) -> Node:
        """The query's tree with ``R`` and ``rt`` of every ``#bm25rf`` counted in ``relevant(docid)``:
        judged documents, or the best of a first pass."""
        tree = self.plan(query, **params)
        wanted = [n for n in walk(tree) if n.op == "bm25rf"]
        if not wanted:
            return tree
        r = relevant.select("docid").distinct()
        rows = self.trees.rows(tree).join(r, "docid", "left_semi")
        got = rows.agg(*[F.count_if(self.trees.matches(n.children[0], _Context())).alias(f"c{i}") for i, n in enumerate(wanted)]).first()
        total = r.count()
        counted = {n: got[f"c{i}"] for i, n in enumerate(wanted)}
        return transform(tree, lambda n: n.with_params(R=total, rt=counted[n]) if n in counted else n)

    def field_weights(self, query: str | Node, fields: list[str], relevant: DataFrame) -> dict[str, float]:
        """Share of each field in the occurrences of the query's terms in relevant documents."""
        words = sorted({str(n.get("default")) for n in walk(parse(query) if isinstance(query, str) else query) if n.op == "text"})
        p = self.index.postings.where(F.col("part").isin([f"field.{f}" for f in fields]) & F.col("term").isin(words)).join(relevant.select("docid").distinct(), "docid", "left_semi")
        n = {r["part"][6:]: r["n"] for r in p.groupBy("part").agg(F.sum("tf").alias("n")).collect()}
        total = sum(n.values())
        return {f: n.get(f, 0) / total if total else 1.0 / len(fields) for f in fields}

    def expand(self, model: str, queries: dict[str, str], k: int = 1000, **params) -> DataFrame:
        """Feedback by a model's name: ``rm1`` the feedback terms alone, ``rm3`` (also ``rm``)
        mixed with the query."""
        if model not in EXPANSIONS:
            raise ValueError(f"unknown expansion model {model}")
        return EXPANSIONS[model](self, queries, k, **params)

    def nonempty(self, query: str | Node, k: int = 1000, **params) -> DataFrame:
        """As ``search``, without documents of length 0."""
        return self.search(query, k, working_set=self.index.lengths.where((F.col("field") == "document") & (F.col("length") > 0)), **params)

    def two_pass_passages(self, first: str, second: str, size: int, shift: int, k: int = 1000, working: int = 2000, **params) -> DataFrame:
        """Passages by ``second`` of the best ``working`` documents of ``first`` only."""
        ws = top_k(self.trees.scored(self.plan(first, **params)), working).select("docid")
        return self.passages(second, size, shift, k, working_set=ws, **params)


def _flat(n: Node, w: float) -> list[tuple[Node, float]] | None:
    """A tree as a weighted sum of scorers over terms and windows of terms; None if it isn't."""
    if n.op in _PARAMS and not n.get("lengths"):
        c = n.children[0]
        plain = c.op == "text" or (c.op in ("ordered", "unordered", "bigram", "ubigram") and all(k.op == "text" for k in c.children))
        return [(n, w)] if plain else None
    if n.op == "combine":
        out = []
        for c, v in zip(n.children, weights_of(n), strict=True):
            part = _flat(c, w * v)
            if part is None:
                return None
            out += part
        return out
    return None


#: Most terms written into a scan's filter; beyond, the join alone picks the postings.
SCAN_TERMS = 5000


def node_counts(index: Index, definitions: DataFrame, windows: bool = True, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(leaf, docid, tf, length) of terms and windows, all leaves at once.

    ``definitions`` has a few rows per leaf and is broadcast. Positions are read only if there
    are windows. ``known`` lists the (part, term) pairs, if the driver has them: as a filter of
    the scan they skip all row groups of postings, sorted by term, that hold none of them.
    """
    d = F.broadcast(definitions)
    p = index.postings
    if known is not None and len(known) <= SCAN_TERMS:
        p = p.where(F.col("part").isin(sorted({x[0] for x in known})) & F.col("term").isin(sorted({x[1] for x in known})))
    p = p.join(d, ["part", "term"])
    terms = p.where(F.col("form") == "term").select("leaf", "docid", F.col("tf").cast("bigint").alias("tf"), "length")
    if not windows:
        return terms
    g = p.where(F.col("form") != "term").groupBy("leaf", "docid", "form", "width", "children", "length")
    g = g.agg(F.sort_array(F.collect_list(F.struct("child", "positions"))).alias("c")).where(F.size("c") == F.col("children"))
    g = g.withColumn("c", F.transform("c", lambda x: x["positions"]))
    tf = F.when(F.col("form") == "ordered", _ordered_count(F.col("c"), F.col("width"))).otherwise(_unordered_count(F.col("c"), F.col("width")))
    wins = g.select("leaf", "docid", tf.cast("bigint").alias("tf"), "length").where(F.col("tf") > 0)
    return terms.unionByName(wins)


def _ordered_count(c, width):
    """Windows of unit extents: for each begin the next position of every further list."""

    def step(ends, q):
        nxt = F.transform(ends, lambda e: F.struct(e.alias("e"), F.array_min(F.filter(q, lambda x: x >= e)).alias("q")))
        good = F.filter(nxt, lambda s: s["q"].isNotNull() & ((width < 0) | (s["q"] - s["e"] < width)))
        return F.transform(good, lambda s: s["q"] + 1)

    first = F.transform(c[0], lambda x: x + 1)
    return F.size(F.aggregate(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(1))), first, step))


def _unordered_count(c, width):
    begins = F.array_distinct(F.flatten(c))

    def fits(p):
        ends = F.transform(c, lambda q: F.array_min(F.filter(q, lambda x: x >= p)))
        return F.forall(ends, lambda e: e.isNotNull()) & ((width < 0) | (F.array_max(ends) + 1 - p <= width))

    return F.size(F.filter(begins, fits))


class Group:
    """Named engines. Several can answer as one (their documents are disjoint; statistics are
    those of all together), or one with the statistics of another."""

    def __init__(self, engines: dict[str, Engine]):
        self.engines = engines

    def merged(self, names: list[str] | None = None) -> Engine:
        picked = [self.engines[n] for n in (names or self.engines)]
        return Engine(merge([e.index for e in picked]), **picked[0].params)

    def search(self, name: str, query: str | Node, k: int = 1000, statistics_of: str | None = None, **params) -> DataFrame:
        e = self.engines[name]
        if statistics_of is None:
            return e.search(query, k, **params)
        other = self.engines[statistics_of]
        mine = Engine(e.index, e.trees.priors, e.trees.indicators, **e.params)
        mine.trees.background(other.trees)
        return mine.search(query, k, **params)


#: Ranking algorithms by name; users add their own.
STRATEGIES: dict[str, Callable] = {
    "rank": Engine.search, "rank-nonempty": Engine.nonempty, "set": Engine.boolean, "passages": Engine.passages, "two-pass": Engine.two_pass, "two-pass-passages": Engine.two_pass_passages,
}
#: Expansion models by name; users add their own.
EXPANSIONS: dict[str, Callable] = {
    "rm1": lambda e, q, k, **p: e.search_feedback(q, k, **{**p, "fb_weight": 0.0}),
    "rm3": lambda e, q, k, **p: e.search_feedback(q, k, **p),
    "rm": lambda e, q, k, **p: e.search_feedback(q, k, **p),
}
