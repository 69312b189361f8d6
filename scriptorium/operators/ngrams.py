"""N-gram windows: extraction, thresholds, sketches, stems brought together, vocabulary pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(documents: DataFrame, n: int = 2, width: int = 1, ordered: bool = True) -> DataFrame:
    """(docid, feature, begin, end) of ``documents(docid, tokens)``.

    Ordered: all sequences of n tokens with each gap at most ``width``. Unordered: all sets of n
    tokens within a span below ``width``, words of the feature sorted. Null tokens are in none.
    All within a document's own row; nothing is shuffled.
    """
    t = documents.select("docid", "tokens", F.posexplode("tokens").alias("begin", "w")).where(F.col("w").isNotNull())
    t = t.withColumn("words", F.array("w")).withColumn("last", F.col("begin"))
    for _ in range(n - 1):
        reach = F.col("last") + width if ordered else F.col("begin") + width - 1
        ahead = F.sequence(F.col("last") + 1, F.least(reach, F.size("tokens") - 1))
        t = t.withColumn("at", F.explode(F.when(F.col("last") + 1 <= F.least(reach, F.size("tokens") - 1), ahead)))
        t = t.withColumn("w", F.col("tokens")[F.col("at")]).where(F.col("w").isNotNull())
        t = t.withColumn("words", F.concat("words", F.array("w"))).withColumn("last", F.col("at"))
    words = F.col("words") if ordered else F.array_sort("words")
    return t.select("docid", F.array_join(words, "~").alias("feature"), "begin", (F.col("last") + 1).alias("end"))


def threshold(w: DataFrame, least: int = 2, by_documents: bool = True) -> DataFrame:
    """(feature, cf, df) with at least ``least`` documents, or occurrences. Counts are summed per
    document first, so frequent features shrink before the exchange by feature."""
    per = w.groupBy("feature", "docid").agg(F.count("*").alias("tf"))
    g = per.groupBy("feature").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    return g.where(F.col("df" if by_documents else "cf") >= least)


def frequent_windows(documents: DataFrame, n: int = 2, width: int = 1, least: int = 2, ordered: bool = True, by_documents: bool = True) -> DataFrame:
    """(docid, feature, begin, end) of features with at least ``least`` documents, or occurrences: counted by their hash
    first, so that only those of the second pass carry text."""
    w = windows(documents, n, width, ordered)
    h = w.select("docid", F.xxhash64("feature").alias("h"))
    keep = (h.distinct() if by_documents else h).groupBy("h").count().where(F.col("count") >= least).select("h")
    return w.withColumn("h", F.xxhash64("feature")).join(keep, "h", "left_semi").drop("h")


def window_postings(w: DataFrame, lengths: DataFrame, part: str) -> DataFrame:
    """Windows as postings of a part of their own; a position is a window's begin. Queries use
    them instead of the terms' postings where the engine's ``windowParts`` names the part."""
    g = w.groupBy("docid", F.col("feature").alias("term")).agg(F.sort_array(F.collect_list("begin")).alias("positions"))
    n = lengths.where(F.col("field") == "document").select("docid", "length")
    return g.join(n, "docid").select(F.lit(part).alias("part"), "term", "docid", F.size("positions").cast("bigint").alias("tf"), "positions", "length")


def sketch(w: DataFrame, rows: int = 3, columns: int = 1 << 20) -> DataFrame:
    """(row, cell, n): counts of hashed features, one table of fixed size whatever the data."""
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.pmod(F.xxhash64(F.lit(r), "feature"), F.lit(columns)).alias("cell")) for r in range(rows)])).alias("c")
    return w.select(cells).groupBy("c.row", "c.cell").agg(F.count("*").alias("n"))


def estimate(features: DataFrame, table: DataFrame, rows: int = 3, columns: int = 1 << 20) -> DataFrame:
    """(feature, estimate): the least count over the rows; never below the true count."""
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.pmod(F.xxhash64(F.lit(r), "feature"), F.lit(columns)).alias("cell")) for r in range(rows)])).alias("c")
    f = features.select("feature").distinct().select("feature", cells).select("feature", "c.row", "c.cell")
    j = f.join(table, ["row", "cell"], "left")
    return j.groupBy("feature").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def conflation(vocabulary: DataFrame, stems: DataFrame) -> DataFrame:
    """(stem, terms): all surface forms of a stem. ``stems(term, stem)``."""
    return vocabulary.join(stems, "term").groupBy("stem").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def close_pairs(vocabulary: DataFrame, distance: int = 1) -> DataFrame:
    """(a, b, distance), a < b: all pairs of terms within an edit distance, without comparing all.

    Two terms within d edits share a piece: cut into d + 1 pieces, at least one survives within
    d places of where it stood. Terms meet on (piece, length class); each meeting is then
    measured. Terms shorter than d + 1 meet on their length alone (there are few).
    """
    v = vocabulary.select("term").where(F.col("term").isNotNull()).distinct().withColumn("len", F.length("term"))
    k = distance + 1
    # every piece of a term at its own place, and every substring another term's piece could be
    own, probe = [], []
    for i in range(k):
        start = F.floor(F.col("len") * i / k)
        size = F.floor(F.col("len") * (i + 1) / k) - start
        own.append(F.struct(F.lit(i).alias("i"), F.col("len").alias("l"), F.col("term").substr((start + 1).cast("int"), size.cast("int")).alias("s")))
        for dl in range(-distance, distance + 1):
            other = F.col("len") + dl
            st = F.floor(other * i / k)
            sz = F.floor(other * (i + 1) / k) - st
            for shift in range(-distance, distance + 1):
                at = (st + shift + 1).cast("int")
                probe.append(F.when((other >= 0) & (at >= 1) & (at + sz - 1 <= F.col("len")), F.struct(F.lit(i).alias("i"), other.cast("int").alias("l"), F.col("term").substr(at, sz.cast("int")).alias("s"))))
    a = v.select(F.col("term").alias("a"), F.explode(F.array(*own)).alias("p"))
    b = v.select(F.col("term").alias("b"), F.explode(F.array_distinct(F.filter(F.array(*probe), lambda x: x.isNotNull()))).alias("p"))
    met = a.join(b, "p").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    d = F.levenshtein("a", "b", distance)
    return met.withColumn("distance", d).where(F.col("distance") >= 0)
