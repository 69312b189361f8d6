"""Extent operators on arrays of half-open intervals, as Columns.

An extent list is ``array<struct<begin:int,end:int>>`` in order of begin; null means none. The
forms below are the closed forms of left-to-right matching: exact for terms and for lists whose
begins are distinct and whose ends do not decrease.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<begin:int,end:int>>"


def none() -> Column:
    return F.array().cast(TYPE)


def some(extents: Column) -> Column:
    return F.coalesce(extents, none())


def unit(positions: Column) -> Column:
    """Extents of single tokens."""
    return F.transform(positions, lambda p: F.struct(p.cast("int").alias("begin"), (p + 1).cast("int").alias("end")))


def _first_from(extents: Column, at: Column) -> Column:
    return F.array_min(F.filter(extents, lambda x: x["begin"] >= at))


def _follow(child: Column, width: int):
    def step(x: Column) -> Column:
        q = _first_from(child, x["end"])
        good = q.isNotNull() if width < 0 else q.isNotNull() & (q["begin"] - x["end"] < width)
        return F.when(good, F.struct(x["begin"].alias("begin"), q["end"].alias("end")))

    return step


def ordered(children: list[Column], width: int = -1) -> Column:
    """From each begin of the first child, the next extent of every further child, each starting
    less than ``width`` after the end of the one before (-1: any gap)."""
    out = F.transform(some(children[0]), lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end")))
    for child in children[1:]:
        out = F.filter(F.transform(out, _follow(some(child), width)), lambda x: x.isNotNull())
    return out


def unordered(children: list[Column], width: int = -1) -> Column:
    """For each distinct begin p, the first extent of every child from p on; kept if all exist
    and the span is at most ``width`` (-1: any)."""
    begins = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.transform(some(c), lambda x: x["begin"]) for c in children]))))

    def at(p: Column) -> Column:
        ends = [_first_from(some(c), p)["end"] for c in children]
        end = F.greatest(*ends) if len(ends) > 1 else ends[0]
        good = F.lit(True)
        for e in ends:
            good = good & e.isNotNull()
        if width >= 0:
            good = good & (end - p <= width)
        return F.when(good, F.struct(p.alias("begin"), end.alias("end")))

    return F.filter(F.transform(begins, at), lambda x: x.isNotNull())


def synonym(children: list[Column]) -> Column:
    """All extents of all children in order; doubles stay."""
    return F.array_sort(F.flatten(F.array(*[some(c) for c in children])))


def inside(inner: Column, outer: Column) -> Column:
    return F.filter(some(inner), lambda i: F.exists(some(outer), lambda o: (o["begin"] <= i["begin"]) & (i["end"] <= o["end"])))


def covered(extents: Column) -> Column:
    """Tokens covered, each extent for itself."""
    return F.aggregate(some(extents), F.lit(0), lambda a, e: a + (e["end"] - e["begin"]))


def clip(extents: Column, begin: Column, end: Column) -> Column:
    """Extents wholly within [begin, end)."""
    return F.filter(some(extents), lambda e: (e["begin"] >= begin) & (e["end"] <= end))
