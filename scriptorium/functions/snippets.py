"""Query-biased snippets of the few documents of a result."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.functions.tagtok import tokenize
from scriptorium.session import arrow_map

#: Tokens shown on each side of a match.
AROUND = 5


def snippet(text: str | None, words: set[str], regions: int = 3) -> tuple[str | None, float]:
    """The best regions around matches, and the score of the snippet: large ones are discounted,
    close and different matches count. Without a match the text's begin, with score 0."""
    terms, _ = tokenize(text)
    hits = [i for i, t in enumerate(terms) if t[0] in words]
    if not terms:
        return (None if text is None else ""), 0.0
    if not hits:
        return text[: terms[min(len(terms) - 1, 4 * AROUND)][2]], 0.0
    spans: list[list] = []
    for i in hits:
        a, b = max(0, i - AROUND), min(len(terms), i + AROUND + 1)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
            spans[-1][2].append(i)
        else:
            spans.append([a, b, [i]])
    best = sorted(sorted(spans, key=lambda s: (-len({terms[i][0] for i in s[2]}), -len(s[2]), s[0]))[:regions])
    size = sum(b - a for a, b, _ in best)
    different = len({terms[i][0] for s in best for i in s[2]})
    score = -(1.2 ** min(0, size - 150)) + sum(2.0 ** len(s[2]) for s in best) + different**2
    return " ... ".join(" ".join(text[terms[a][1] : terms[b - 1][2]].split()) for a, b, _ in best), score


def snippets(results: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """``results(docid, text)`` to (docid, snippet, snippet_score); meant for top-k rows."""
    wanted = {w.lower() for w in words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [snippet(t, wanted) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["docid", "snippet", "snippet_score"])

    return arrow_map(results.select("docid", text), run, "docid bigint, snippet string, snippet_score double")
