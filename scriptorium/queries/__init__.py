"""Registered queries over the test tables and SQL that computes the same."""

from __future__ import annotations

from scriptorium.queries.registry import ORACLES, QUERIES

from . import evaluation, indexing, links, retrieval, skew, text  # noqa: F401  (they register themselves)


def flagship(spark, directory):
    """Top ten of a small batch of weighted queries, with names."""
    return retrieval.bm25_topk(spark, directory)


__all__ = ["ORACLES", "QUERIES", "flagship"]
