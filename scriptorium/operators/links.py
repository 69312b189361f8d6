"""Links between pages, anchor text, and page rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import join_url, scrub_url
from scriptorium.session import durable, release


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", drop_nofollow: bool = False) -> DataFrame:
    """(page, src_url, dest_url, anchor, nofollow): one row per ``<a href>``, doubles kept.

    Addresses are resolved against ``<base href>`` or the page's own and scrubbed; anchor text
    loses its tags and surplus white space. Mail, script and fragment-only links and pages
    without an address give no row.
    """
    p = pages.where(F.col(url).isNotNull() & F.col(html).isNotNull())
    base = F.regexp_extract(F.col(html), r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    a = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<a\b[^>]*\bhref\s*=[^>]*>.*?</a\s*>)"), F.lit(1))).alias("a")
    x = p.select(F.col(page).alias("page"), F.col(url).alias("own"), F.when(base != "", base).otherwise(F.col(url)).alias("base"), a)
    tag = F.regexp_extract("a", r"(?is)^(<a\b[^>]*>)", 1)
    href = F.regexp_extract(tag, r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 0)
    href = F.regexp_replace(F.regexp_replace(href, r"(?is)^href\s*=\s*", ""), r"^[\"']|[\"']$", "")
    anchor = F.trim(F.regexp_replace(F.regexp_replace("a", "(?s)<[^>]*>", " "), r"\s+", " "))
    out = x.select(
        "page",
        scrub_url(F.col("own")).alias("src_url"),
        scrub_url(join_url(F.col("base"), F.trim(href))).alias("dest_url"),
        anchor.alias("anchor"),
        tag.rlike(r"(?is)\brel\s*=\s*[\"']?[^\"'>]*nofollow").alias("nofollow"),
    ).where(F.col("dest_url").isNotNull())
    return out.where(~F.col("nofollow")) if drop_nofollow else out


def resolve(links: DataFrame, pages: DataFrame, page: str = "page_id", url: str = "url", prefix: str = "ext:") -> DataFrame:
    """Links with ``dest``: the page at that address, or the address with a prefix."""
    known = pages.where(F.col(url).isNotNull()).groupBy(scrub_url(F.col(url)).alias("dest_url")).agg(F.min(F.col(page).cast("string")).alias("dest"))
    return links.join(known, "dest_url", "left").withColumn("dest", F.coalesce("dest", F.concat(F.lit(prefix), "dest_url")))


#: Most anchors in one row of ``anchor_documents``.
ANCHORS = 10_000


def anchor_documents(links: DataFrame, most: int = ANCHORS) -> DataFrame:
    """(dest_url, part, links, text): the anchor texts that point to an address, in order.

    An address with more than ``most`` links has several rows, of about half as many links each,
    numbered by ``part``, so that no row grows with an address's fame; together the parts hold
    every anchor once.
    """
    n = links.groupBy("dest_url").agg(F.count("*").alias("n")).where(F.col("n") > most)  # famous ones only
    parts = n.select("dest_url", F.ceil(2.0 * F.col("n") / most).cast("int").alias("parts"))
    x = links.select("dest_url", "page", "anchor").join(parts, "dest_url", "left")
    x = x.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("page", "anchor"), F.col("parts"))).cast("int"))
    g = x.groupBy("dest_url", "part").agg(F.count("*").alias("links"), F.sort_array(F.collect_list("anchor")).alias("a"))
    return g.select("dest_url", "part", "links", F.array_join("a", " ").alias("text"))


def typed(links: DataFrame, kind: str = "link") -> DataFrame:
    """(src, type, pos, dest): links by their source, kind and place among the source's links of
    that kind; the table of a link index, one row for each. ``links(page, dest_url, ...)``."""
    w = Window.partitionBy("page").orderBy("dest_url", "anchor")
    return links.select(F.col("page").alias("src"), F.lit(kind).alias("type"), (F.row_number().over(w) - 1).alias("pos"), F.col("dest_url").alias("dest"))


def harvest_lines(links: DataFrame, pages: DataFrame, page: str = "page_id", url: str = "url") -> DataFrame:
    """(value): text blocks of the links to each page, as link harvests are exchanged: the target's
    id and address and their number, then for each link its source's address, page and anchor. A
    block per target and part of ``anchor_documents``'s size; write with ``write.text``."""
    known = pages.where(F.col(url).isNotNull()).groupBy(scrub_url(F.col(url)).alias("dest_url")).agg(F.min(F.col(page).cast("string")).alias("dest"))
    n = links.groupBy("dest_url").agg(F.count("*").alias("n")).where(F.col("n") > ANCHORS)
    x = links.join(known, "dest_url").join(n.select("dest_url", F.ceil(2.0 * F.col("n") / ANCHORS).cast("int").alias("parts")), "dest_url", "left")
    x = x.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("page", "anchor"), F.col("parts"))).cast("int"))
    row = F.concat(F.lit("LINKDOCNO="), F.col("page").cast("string"), F.lit("\nLINKFROM="), "src_url", F.lit("\nTEXT="), F.coalesce("anchor", F.lit("")))
    g = x.groupBy("dest", "dest_url", "part").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(row)).alias("rows"))
    return g.select(F.concat(F.lit("DOCNO="), "dest", F.lit("\n"), "dest_url", F.lit("\nLINKS="), F.col("n").cast("string"), F.lit("\n"), F.array_join("rows", "\n")).alias("value"))


def rank_lines(scores: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(value) ``name score`` of page ranks, highest first; without names the node stands there."""
    s = scores if names is None else scores.join(names, "node", "left")
    name = F.coalesce(F.col("name"), F.col("node").cast("string")) if names is not None else F.col("node").cast("string")
    return s.orderBy(F.desc("score"), "node").select(F.concat_ws(" ", name, F.format_string("%.10f", "score")).alias("value"))


def add_text(documents: DataFrame, additional: DataFrame, docid: str = "docid", text: str = "text") -> DataFrame:
    """Documents with the additional texts of their id appended, in order."""
    a = additional.groupBy(docid).agg(F.array_join(F.sort_array(F.collect_list(text)), " ").alias("_more"))
    return documents.join(a, docid, "left").withColumn(text, F.concat_ws(" ", text, "_more")).drop("_more")


def pagerank(edges: DataFrame, nodes: DataFrame, lam: float = 0.5, delta: float = 1e-6, iterations: int = 10) -> DataFrame:
    """(node, score). ``edges(src, dst[, n])``, ``n`` counting repeated links; ``nodes(node)``.

    Links to oneself and to unknown nodes are left out, repeated links kept. Each node passes
    (1 - lam) of its score on in equal parts; nodes without links give theirs to all. It stops
    when no score changes by more than ``delta``. Each round is written, so lineage stays short.
    """
    if "n" not in edges.columns:
        edges = edges.withColumn("n", F.lit(1))
    v = nodes.select("node").distinct()
    e = edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))
    e = e.join(v.withColumnRenamed("node", "src"), "src", "left_semi").join(v.withColumnRenamed("node", "dst"), "dst", "left_semi")
    out = e.groupBy("src").agg(F.sum("n").alias("out"))
    e = durable(e.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("part")), "edges")
    v = durable(v.join(out.withColumnRenamed("src", "node"), "node", "left").select("node", F.col("out").isNull().alias("dangling")), "nodes")
    n = v.count()
    if n == 0:
        return v.select("node", F.lit(0.0).alias("score"))
    score, last = v.withColumn("score", F.lit(1.0 / n)), None
    for _ in range(iterations):
        whole = score.agg(F.sum("score").alias("all"), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0)).alias("lost")).first()
        jump = (lam * whole["all"] + (1.0 - lam) * whole["lost"]) / n
        given = e.join(score.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("part")).alias("given"))
        new = score.withColumnRenamed("score", "old").join(given, "node", "left")
        new = durable(new.select("node", "dangling", "old", (F.lit(jump) + (1.0 - lam) * F.coalesce("given", F.lit(0.0))).alias("score")), "rank")
        change = new.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
        if last is not None:
            release(last)  # only the newest round is read again
        last, score = new, new.drop("old")
        if change <= delta:
            break
    return score.select("node", "score")
