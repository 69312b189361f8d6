"""Learning of query parameters against judgments.

An evaluation function maps a parameter setting to a metric; ``evaluator`` makes one from an
engine, queries and judgments, where each call is one Spark job over all queries. Grids of any
function are evaluated setting by setting, those of an engine's queries in one batch
(``grid_in_one_job``); coordinate ascent needs one call a step.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import evaluation as E
from scriptorium.operators.retrieval import Engine

Setting = dict[str, float]


@dataclass
class Range:
    low: float
    high: float
    start: float | None = None
    step: float = 0.02


@dataclass
class Result:
    setting: Setting
    score: float
    trace: list[tuple[Setting, float]] = field(default_factory=list)


def evaluator(engine: Engine, queries: dict[str, str], judged: DataFrame, metric: str = "ap", k: int = 100) -> Callable[[Setting], float]:
    """Mean of a metric; names in braces in a query take the setting's values, others are passed
    as parameters of all queries."""

    def f(s: Setting) -> float:
        text = {q: t.format(**s) if "{" in t else t for q, t in queries.items()}
        run = engine.search_batch(text, k, **{p: v for p, v in s.items() if not any("{" + p in t for t in queries.values())})
        run = engine.named(run).select("qid", F.col("name").alias("docno"), "rank")
        return E.aggregate(E.evaluate(run, judged), [metric]).first()[0] or 0.0

    return f


def normalized(s: Setting, names: list[str], rule: str = "sum") -> Setting:
    """``sum`` scales the named values to add up to 1, ``max`` to a largest value of 1, ``min``
    raises them to at least 0."""
    x = {n: s[n] for n in names}
    if rule == "min":
        return s | {n: max(0.0, v) for n, v in x.items()}
    by = sum(abs(v) for v in x.values()) if rule == "sum" else max((abs(v) for v in x.values()), default=0.0)
    return s | ({n: v / by for n, v in x.items()} if by else {})


def grid_search(f: Callable[[Setting], float], ranges: dict[str, Range], size: int = 5) -> Result:
    """All settings of an even grid including both ends; of equal ones the first."""
    axes = [[r.low + (r.high - r.low) * i / max(1, size) for i in range(size + 1)] for r in ranges.values()]
    trace = [(dict(zip(ranges, x, strict=True)), 0.0) for x in product(*axes)]
    trace = [(s, f(s)) for s, _ in trace]
    best = max(trace, key=lambda t: t[1])
    return Result(best[0], best[1], trace)


def grid_in_one_job(engine: Engine, queries: dict[str, str], judged: DataFrame, ranges: dict[str, Range], size: int = 5, metric: str = "ap", k: int = 100) -> Result:
    """As ``grid_search`` over ``evaluator``, but all settings make one batch of queries, and one
    evaluation gives the mean of each: two jobs, whatever the number of settings."""
    axes = [[r.low + (r.high - r.low) * i / max(1, size) for i in range(size + 1)] for r in ranges.values()]
    settings = [dict(zip(ranges, x, strict=True)) for x in product(*axes)]
    batch = {}
    for i, s in enumerate(settings):
        others = {p: v for p, v in s.items() if not any("{" + p in t for t in queries.values())}
        for q, t in queries.items():
            batch[f"{i}\t{q}"] = engine.plan(t.format(**s) if "{" in t else t, **others)
    run = engine.named(engine.search_batch(batch, k)).select("qid", F.col("name").alias("docno"), "rank")
    number = judged.sparkSession.range(len(settings)).withColumnRenamed("id", "i")  # one row a setting
    all_judged = judged.join(F.broadcast(number)).withColumn("qid", F.concat(F.col("i").cast("string"), F.lit("\t"), "qid")).drop("i")
    per = E.evaluate(run, all_judged).groupBy(F.split("qid", "\t")[0].cast("int").alias("i")).agg(F.avg(metric).alias("m"))
    found = {r["i"]: r["m"] or 0.0 for r in per.collect()}
    trace = [(s, found.get(i, 0.0)) for i, s in enumerate(settings)]
    best = max(trace, key=lambda t: t[1])
    return Result(best[0], best[1], trace)


def coordinate_ascent(f: Callable[[Setting], float], ranges: dict[str, Range], restarts: int = 1, iterations: int = 5, scale: float = 2.0, ratio: float = 0.3, seed: int = 1, normalize: tuple[list[str], str] | None = None) -> Result:
    """Sweeps over the coordinates in random order: steps up, else down, growing while the metric
    improves or equals the best; ends with a sweep that changes nothing. The first start is at
    the given values, others are random within the ranges."""
    rng = random.Random(seed)
    fix = (lambda s: normalized(s, *normalize)) if normalize else (lambda s: s)
    best_all: Result | None = None
    for r in range(restarts):
        s = {n: (x.start if x.start is not None and r == 0 else rng.uniform(x.low, x.high)) for n, x in ranges.items()}
        s = fix(s)
        best = f(s)
        trace = [(dict(s), best)]
        for _ in range(iterations):
            changed = False
            order = list(ranges)
            rng.shuffle(order)
            for n in order:
                for sign in (1.0, -1.0):
                    value, step, gain, at = s[n], ranges[n].step, best, 0.0
                    if value and step > abs(value):
                        step = ratio * abs(value)
                    while True:
                        to = value + sign * step
                        stop = not ranges[n].low <= to <= ranges[n].high
                        to = min(max(to, ranges[n].low), ranges[n].high)
                        if to == value or to == at:
                            break
                        got = f(fix(s | {n: to}))
                        trace.append((s | {n: to}, got))
                        if got > gain or (got == best and gain == best):
                            gain, at = got, to
                            step *= scale
                        else:
                            break
                        if stop:
                            break
                    if gain > best:
                        s, best, changed = fix(s | {n: at}), gain, True
                        break
            if not changed:
                break
        if best_all is None or best > best_all.score:
            best_all = Result(s, best, trace)
    return best_all


def cross_validate(make: Callable[[dict[str, str]], Callable[[Setting], float]], queries: dict[str, str], learn: Callable[[Callable[[Setting], float]], Result], folds: int = 5, seed: int = 1) -> list[tuple[Result, float]]:
    """Per fold: what was learned on the other folds' queries, and its metric on the fold's own."""
    names = sorted(queries)
    random.Random(seed).shuffle(names)
    out = []
    for k in range(min(folds, len(names))):
        test = set(names[k::folds])
        r = learn(make({q: t for q, t in queries.items() if q not in test}))
        out.append((r, make({q: queries[q] for q in test})(r.setting)))
    return out
