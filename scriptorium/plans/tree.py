"""One query tree as one expression over one row per document.

The postings of all leaves are grouped once by document into a map from leaf to extents; every
operator of the tree is then a Column over that map. Statistics of all counted nodes, windows
included, come from a single aggregation over the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import scoring as S
from scriptorium.functions import windows as W
from scriptorium.operators.index import Index
from scriptorium.plans.query import Node, QueryError, walk, weights_of
from scriptorium.plans.rewrites import COUNTS, CUSTOM, MIXED, SCORERS, kind

_COMPARE = ("greater", "less", "between", "equals")
#: Operators that can hold for documents without any leaf of the query.
_ALL_DOCUMENTS = ("bnot", "logprobnot", "prior", "scores", "indicator", *_COMPARE)


@dataclass(frozen=True)
class Leaf:
    table: str  # postings or extents
    part: str
    term: str

    @property
    def key(self) -> str:
        return f"{self.part}\t{self.term}"


def leaf_of(n: Node) -> Leaf:
    name = str(n.get("default", ""))
    part = str(n.get("part", "postings"))
    return Leaf("extents", part, name) if part == "extents" else Leaf("postings", part, name)


def _leaves(trees: list[Node]) -> set[Leaf]:
    """All leaves, with the tags whose lengths scorers ask for."""
    own = {leaf_of(n) for t in trees for n in walk(t) if n.op in ("text", "counts", "extents")}
    return own | {Leaf("extents", "extents", str(n.get("lengths"))) for t in trees for n in walk(t) if n.get("lengths")}


def _tags_drive(trees: list[Node]) -> bool:
    """Can a document match by a tag alone?"""

    def drives(n: Node) -> bool:
        if n.op in ("text", "counts", "extents"):
            return leaf_of(n).table == "extents"
        return any(drives(c) for c in (n.children[:1] if n.op == "inside" else n.children))

    return any(drives(t) for t in trees)


@dataclass
class CollectionStats:
    documents: int
    length: int
    mean_length: float


class TreePlan:
    """Plans trees against an index; statistics are kept for the life of the object."""

    def __init__(self, index: Index, priors: DataFrame | None = None, indicators: DataFrame | None = None):
        """``priors(part, docid, value)`` serve ``#prior`` and ``#scores``, ``indicators(part,
        docid, value boolean)`` serve ``#indicator``."""
        self.index, self.priors, self.indicators = index, priors, indicators
        self._collection: dict[str, CollectionStats] = {}
        self._nodes: dict[Node, tuple[int, int, int]] = {}

    # --- statistics ---------------------------------------------------------------------

    def collection(self, field: str = "document") -> CollectionStats:
        if field not in self._collection:
            if field == "document":
                r = self.index.lengths.where(F.col("field") == field).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
                n, c = r[0], r[1]
            else:
                n = self.collection().documents
                c = self.index.extents.where(F.col("name") == field).agg(F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0))).first()[0]
            self._collection[field] = CollectionStats(n, c, c / n if n else 0.0)
        return self._collection[field]

    def node_stats(self, nodes: list[Node]) -> dict[Node, tuple[int, int, int]]:
        """(cf, df, max tf) of counted nodes; all unknown ones in one job."""
        new = [n for n in dict.fromkeys(nodes) if n not in self._nodes]
        if new:
            rows = self._grouped(new)
            x = _Context()
            aggs = []
            for i, n in enumerate(new):
                c = self.count(n, x)
                aggs += [F.coalesce(F.sum(c), F.lit(0)).alias(f"cf{i}"), F.count_if(c > 0).alias(f"df{i}"), F.coalesce(F.max(c), F.lit(0)).alias(f"mx{i}")]
            r = rows.agg(*aggs).first()
            for i, n in enumerate(new):
                self._nodes[n] = (r[f"cf{i}"], r[f"df{i}"], r[f"mx{i}"])
        return {n: self._nodes[n] for n in nodes}

    def background(self, other: TreePlan) -> None:
        """Take the statistics of another collection instead of the own ones."""
        self.collection, self.node_stats = other.collection, other.node_stats
        self._stat = other._stat

    # --- rows -----------------------------------------------------------------------------

    def _grouped(self, trees: list[Node]) -> DataFrame:
        """(docid, m map<leaf, extents>, dl) of documents with any leaf; dl is null where only
        tags are found."""
        leaves = _leaves(trees)
        post = [x for x in leaves if x.table == "postings"]
        tags = sorted({x.term for x in leaves if x.table == "extents"})
        parts = []
        if post or not tags:
            hit = F.lit(False)
            for part in sorted({x.part for x in post}):
                terms = sorted({x.term for x in post if x.part == part})
                hit = hit | ((F.col("part") == part) & F.col("term").isin(terms))
            p = self.index.postings.where(hit)
            parts.append(p.select("docid", F.concat_ws("\t", "part", "term").alias("key"), W.unit(F.col("positions")).alias("ext"), F.col("length").cast("int").alias("dl")))
        if tags:
            if self.index.extents is None:
                raise QueryError("the index has no extents")
            e = self.index.extents.where(F.col("name").isin(tags))
            if parts and not _tags_drive(trees):  # tags only restrict terms or give lengths
                e = e.join(parts[0].select("docid").distinct(), "docid", "left_semi")
            e = e.groupBy("docid", "name")
            e = e.agg(F.array_sort(F.collect_list(F.struct(F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end")))).alias("ext"))
            parts.append(e.select("docid", F.concat(F.lit("extents\t"), F.col("name")).alias("key"), "ext", F.lit(None).cast("int").alias("dl")))
        u = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return u.groupBy("docid").agg(F.map_from_entries(F.collect_list(F.struct("key", "ext"))).alias("m"), F.max("dl").alias("dl"))

    def rows(self, tree: Node) -> DataFrame:
        """The rows the tree is evaluated over, with length, typed fields and side values."""
        every = any(n.op in _ALL_DOCUMENTS for n in walk(tree))
        r = self._grouped([tree])
        if every or any(x.table == "extents" for x in _leaves([tree])) and _tags_drive([tree]):
            # otherwise the postings know the length, and no table of all documents is touched
            d = self.index.lengths.where(F.col("field") == "document").select("docid", F.col("length").alias("dl"))
            r = d.join(r.drop("dl"), "docid", "left" if every else "inner")
        fields = sorted({str(c.children[0].get("default")) for c in walk(tree) if c.op in _COMPARE})
        if fields:
            if self.index.fields is None:
                raise QueryError("the index has no typed fields")
            f = self.index.fields.where(F.col("field").isin(fields))
            f = f.groupBy("docid").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("v_string", "v_long", "v_double", "v_timestamp").alias("v")))).alias("fields"))
            r = r.join(f, "docid", "left")
        for op, table, col in (("prior", self.priors, "priors"), ("scores", self.priors, "priors"), ("indicator", self.indicators, "indicators")):
            if any(n.op == op for n in walk(tree)) and col not in r.columns:
                if table is None:
                    raise QueryError(f"#{op} needs a side table")
                r = r.join(table.groupBy("docid").agg(F.map_from_entries(F.collect_list(F.struct("part", "value"))).alias(col)), "docid", "left")
        return r

    # --- expressions ------------------------------------------------------------------------

    def extents(self, n: Node, x: _Context) -> Column:
        if n.op in CUSTOM and CUSTOM[n.op][0] == "extents":
            return CUSTOM[n.op][1](self, n, x)
        if n.op in ("text", "counts", "extents"):
            return x.clipped(W.some(F.col("m")[leaf_of(n).key]))
        c = [self.extents(k, x) for k in n.children if kind(k) == "counts"]
        width = int(n.get("default", -1))
        if n.op == "null":
            return W.none()
        if n.op in ("ordered", "bigram"):
            return W.ordered(c, 1 if n.op == "bigram" else width)
        if n.op in ("unordered", "ubigram"):
            return W.unordered(c, width)
        if n.op == "syn":
            return W.synonym(c)
        if n.op == "inside":
            return W.inside(c[0], c[1])
        if n.op == "passagefilter":
            return x.whole(self.extents(n.children[-1], _Context()))
        if n.op in MIXED:
            keep = self.condition(n.children[0], x)
            return F.when(keep if n.op == "require" else ~keep, c[-1]).otherwise(W.none())
        raise QueryError(f"#{n.op} has no extents")

    def count(self, n: Node, x: _Context) -> Column:
        if n.op in CUSTOM and CUSTOM[n.op][0] == "counts":
            return CUSTOM[n.op][1](self, n, x)
        if n.op == "mincount":
            c = [self.count(k, x) for k in n.children]
            return F.least(*c) if len(c) > 1 else c[0]
        if n.op == "count-sum":
            return sum((self.count(k, x) for k in n.children), F.lit(0))
        if n.op == "bool-to-count":
            return self.condition(n.children[0], x).cast("int")
        return F.size(self.extents(n, x))

    def condition(self, n: Node, x: _Context) -> Column:
        if n.op in CUSTOM and CUSTOM[n.op][0] == "bool":
            return CUSTOM[n.op][1](self, n, x)
        if n.op in COUNTS or (n.op in CUSTOM and kind(n) == "counts"):
            return self.count(n, x) > 0
        if n.op in ("all", "any"):
            c = [self.condition(k, x) for k in n.children]
            out = F.lit(n.op == "all" and bool(c))
            for k in c:
                out = out & k if n.op == "all" else out | k
            return out
        if n.op == "bnot":
            return ~self.condition(n.children[0], x)
        if n.op in _COMPARE:
            return self._compare(n)
        if n.op == "indicator":
            v = F.col("indicators")[str(n.get("default", ""))]
            return F.coalesce(v, F.lit(bool(n.get("fallback", False))))
        if n.op == "threshold":
            p = n.p
            given = [k for k in ("raw", "prob", "logprob") if k in p]
            if not given:
                raise QueryError("#threshold needs raw, prob or logprob")
            t = F.log(F.lit(float(p["prob"]))) if given[0] == "prob" else F.lit(float(p[given[0]]))
            return self.score(n.children[0], x) >= t
        if n.op in MIXED:
            a, b = self.condition(n.children[0], x), self.condition(n.children[-1], x)
            return (a if n.op == "require" else ~a) & b
        return self.matches(n, x)

    def _compare(self, n: Node) -> Column:
        v = F.col("fields")[str(n.children[0].get("default"))]
        values = [str(c.get("default")) for c in n.children[1:]]

        def each(f) -> Column:
            number = [F.expr(f"try_cast('{x}' as double)") for x in values]
            # ISO dates, and the short form of a date in American order
            stamp = [F.expr("coalesce(try_cast('{0}' as timestamp), try_to_timestamp('{0}', 'M/d/yy'), try_to_timestamp('{0}', 'M/d/yyyy'))".format(x.replace("'", ""))) for x in values]
            return F.coalesce(f(v["v_long"].cast("double"), number), f(v["v_double"], number), f(v["v_timestamp"], stamp), f(v["v_string"], [F.lit(x) for x in values]), F.lit(False))

        if any("'" in x or "\\" in x for x in values):
            values = [x.replace("'", "").replace("\\", "") for x in values]
        if n.op == "greater":
            return each(lambda c, a: c > a[0])
        if n.op == "less":
            return each(lambda c, a: c < a[0])
        if n.op == "equals":
            return each(lambda c, a: c == a[0])
        return each(lambda c, a: (c > a[0]) & (c < a[1]))  # both ends excluded

    def score(self, n: Node, x: _Context) -> Column:
        if n.op in CUSTOM and CUSTOM[n.op][0] == "score":
            return CUSTOM[n.op][1](self, n, x)
        p = n.p
        if n.op in SCORERS:
            return self._scorer(n, x)
        if n.op == "combine":
            return sum((w * self.score(c, x) for w, c in zip(weights_of(n), n.children, strict=True)), F.lit(0.0))
        if n.op == "wsum":
            return S.log_sum_exp([self.score(c, x) for c in n.children], weights_of(n))
        if n.op == "scale":
            return float(p.get("default", 1.0)) * self.score(n.children[0], x)
        if n.op == "log":
            return F.log(self.score(n.children[0], x))
        if n.op == "log-count":
            c = self.count(n.children[0], x)
            return F.when(c > 0, F.log(c.cast("double"))).otherwise(F.lit(float("-inf")))
        if n.op == "logprobnot":
            return S.log_not(self.score(n.children[0], x))
        if n.op == "bool":
            return self.condition(n.children[0], x).cast("double")
        if n.op == "boost":
            return F.when(self.condition(n.children[0], x), float(p.get("beta", 0.5))).otherwise(0.0)
        if n.op in ("prior", "scores"):
            v = F.col("priors")[str(p.get("default", ""))]
            return F.coalesce(v, F.lit(float(p.get("fallback", S.FILTERED if n.op == "prior" else 0.0))))
        if n.op == "bm25fcomb":
            *fields, term = n.children
            idf = S.bm25_idf(self._stat(term)[1], self.collection().documents)
            w = [float(p.get(str(i), 1.0)) for i in range(len(fields))]
            return S.bm25f_combine([self.score(f, x) for f in fields], w, idf, float(p.get("K", 0.5)))
        if n.op in MIXED:
            c = self.condition(n.children[0], x)
            return F.when(c if n.op == "require" else ~c, self.score(n.children[-1], x)).otherwise(S.FILTERED)
        raise QueryError(f"#{n.op} has no score")

    def _stat(self, n: Node) -> tuple[int, int, int]:
        return self.node_stats([n])[n]

    def _scorer(self, n: Node, x: _Context) -> Column:
        p, child = n.p, n.children[0]
        tf = self.count(child, x)
        field = p.get("lengths")
        c = self.collection(field or "document")
        length = x.length if field is None else W.covered(x.clipped(W.some(F.col("m")[f"extents\t{field}"])))
        if n.op == "bm25field":
            return F.when(tf > 0, S.bm25_field(tf, length, c.mean_length, float(p.get("b", 0.5)))).otherwise(0.0)
        cf, df, _ = self._stat(child)
        if n.op == "dirichlet":
            return S.dirichlet(tf, length, cf, c.length, float(p.get("mu", 1500.0)))
        if n.op == "jm":
            return S.jelinek_mercer(tf, length, cf, c.length, float(p.get("lambda", 0.5)))
        if n.op == "bm25":
            return S.bm25(tf, length, df, c.documents, c.mean_length, float(p.get("b", 0.75)), float(p.get("k", 1.2)), str(p.get("profile", "classic")))
        if n.op == "bm25rf":
            return S.bm25_feedback(tf > 0, p.get("rt", 0), p.get("R", 0), p.get("ft", df), c.documents, float(p.get("factor", 0.33)))
        if n.op == "pl2":
            return S.pl2(tf, length, cf, c.documents, c.mean_length, float(p.get("c", 1.0)))
        if n.op == "inl2":
            return S.inl2(tf, length, df, c.documents, c.mean_length, float(p.get("c", 1.0)))
        return S.bil2(tf, length, df, c.documents, c.mean_length, float(p.get("c", 1.0)))

    def matches(self, n: Node, x: _Context) -> Column:
        """Does the node have a document as a candidate?"""
        if n.op in COUNTS or (n.op in CUSTOM and kind(n) == "counts"):
            return self.count(n, x) > 0
        if n.op in SCORERS:
            return self.matches(n.children[0], x)
        if n.op == "logprobnot":
            return F.lit(True)
        if n.op in ("prior", "scores"):
            return F.col("priors")[str(n.get("default", ""))].isNotNull()
        if n.op in MIXED or kind(n) == "bool":
            return self.condition(n, x) if kind(n) == "bool" or n.op not in MIXED else (self.condition(n.children[0], x) if n.op == "require" else ~self.condition(n.children[0], x)) & self.matches(n.children[-1], x)
        out = F.lit(False)
        for c in n.children:
            out = out | self.matches(c, x)
        return out

    def scored(self, tree: Node, working_set: DataFrame | None = None, leaves: bool = False) -> DataFrame:
        """(docid, score[, leaves]) of all candidates. ``working_set(docid)`` restricts them.
        ``leaves`` adds an array of (node, tf, score) for each scored node."""
        self.node_stats([c for n in walk(tree) if n.op in SCORERS and n.op != "bm25field" for c in n.children[:1]] + [n.children[-1] for n in walk(tree) if n.op == "bm25fcomb"])
        x = _Context()
        r = self.rows(tree)
        if working_set is not None:
            r = r.join(working_set.select("docid").distinct(), "docid", "left_semi")
        r = r.where(self.matches(tree, x))
        if kind(tree) == "bool":
            return r.select("docid", F.lit(1.0).alias("score"))
        more = []
        if leaves:
            parts = [F.struct(F.lit(str(n)).alias("node"), self.count(n.children[0], x).alias("tf"), self.score(n, x).alias("score")) for n in walk(tree) if n.op in SCORERS]
            more = [F.array(*parts).alias("leaves")]
        return r.select("docid", self.score(tree, x).alias("score"), *more)

    def passages(self, tree: Node, size: int, shift: int, working_set: DataFrame | None = None) -> DataFrame:
        """(docid, begin, end, score) of every passage of every candidate: windows of ``size``
        tokens, ``shift`` apart, the last one cut at the document's end."""
        if size <= 0 or shift <= 0:
            raise QueryError("passage size and shift must be positive")
        self.node_stats([c for n in walk(tree) if n.op in SCORERS and n.op != "bm25field" for c in n.children[:1]])
        r = self.rows(tree)
        if working_set is not None:
            r = r.join(working_set.select("docid").distinct(), "docid", "left_semi")
        r = r.where(self.matches(tree, _Context()))
        last = F.greatest(F.lit(0), F.ceil((F.col("dl") - size) / shift)).cast("int") * shift
        r = r.withColumn("begin", F.explode(F.filter(F.sequence(F.lit(0), last, F.lit(shift)), lambda b: b < F.col("dl"))))
        r = r.withColumn("end", F.least(F.col("begin") + size, F.col("dl")))
        return r.select("docid", "begin", "end", self.score(tree, _Context(F.col("begin"), F.col("end"))).alias("score"))

    def extent_passages(self, tree: Node, tag: str, count: int = 1, step: int = 1) -> DataFrame:
        """(docid, begin, end, score): passages are runs of ``count`` extents of a tag."""
        self.node_stats([c for n in walk(tree) if n.op in SCORERS and n.op != "bm25field" for c in n.children[:1]])
        e = self.index.extents.where(F.col("name") == tag).groupBy("docid").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
        r = self.rows(tree).where(self.matches(tree, _Context())).join(e, "docid")
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("spans") - count), F.lit(step))
        r = r.withColumn("at", F.explode(starts))
        r = r.withColumn("begin", F.col("spans")[F.col("at")]["begin"]).withColumn("end", F.array_max(F.transform(F.slice("spans", F.col("at") + 1, count), lambda s: s["end"])))
        return r.select("docid", "begin", "end", self.score(tree, _Context(F.col("begin"), F.col("end"))).alias("score"))


class _Context:
    """Document or passage in which extents are looked at."""

    def __init__(self, begin: Column | None = None, end: Column | None = None):
        self.begin, self.end = begin, end

    @property
    def length(self) -> Column:
        return F.col("dl") if self.begin is None else self.end - self.begin

    def clipped(self, extents: Column) -> Column:
        return extents if self.begin is None else W.clip(extents, self.begin, self.end)

    def whole(self, extents: Column) -> Column:
        """Only the extents that lie in the passage from begin to end."""
        return extents if self.begin is None else F.filter(extents, lambda e: (e["begin"] >= self.begin) & (e["end"] <= self.end))
