"""Nested settings with a fallback, sums of trees of numbers, natural order of names."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import arrow_map


class Settings:
    """A tree of values with an optional fallback, looked up by dotted paths.

    Typed getters convert what they can and raise ``ValueError`` for the rest; without a default a
    missing path is a ``KeyError``. A null value counts as set.
    """

    def __init__(self, values: dict[str, Any] | None = None, fallback: Settings | None = None):
        self.values, self.fallback = dict(values or {}), fallback

    @staticmethod
    def parse(text: str, fallback: Settings | None = None) -> Settings:
        v = json.loads(text)
        if not isinstance(v, dict):
            raise ValueError("settings are an object")
        return Settings(v, fallback)

    def render(self, **options) -> str:
        return json.dumps(self.values, ensure_ascii=False, sort_keys=True, **options)

    def has(self, path: str) -> bool:
        return self._find(path)[0] or (self.fallback is not None and self.fallback.has(path))

    def _find(self, path: str) -> tuple[bool, Any]:
        at: Any = self.values
        for p in path.split("."):
            if not isinstance(at, dict) or p not in at:
                return False, None
            at = at[p]
        return True, at

    def get(self, path: str, *default: Any) -> Any:
        found, v = self._find(path)
        if found:
            return v
        if self.fallback is not None and self.fallback.has(path):
            return self.fallback.get(path)
        if default:
            return default[0]
        raise KeyError(path)

    def number(self, path: str, *default: float) -> float:
        v = self.get(path, *default)
        if isinstance(v, bool) or not isinstance(v, (int, float, str)):
            raise ValueError(f"{path} is no number")
        return float(v)

    def integer(self, path: str, *default: int) -> int:
        v = self.number(path, *default)
        if v != int(v):
            raise ValueError(f"{path} is no whole number")
        return int(v)

    def flag(self, path: str, *default: bool) -> bool:
        v = self.get(path, *default)
        if isinstance(v, str) and v.lower() in ("true", "false"):
            return v.lower() == "true"
        if not isinstance(v, bool):
            raise ValueError(f"{path} is no flag")
        return v

    def items(self, path: str, *default: list) -> list:
        v = self.get(path, *default)
        return v if isinstance(v, list) else [v]

    def set(self, path: str, value: Any) -> Settings:
        *outer, last = path.split(".")
        at = self.values
        for p in outer:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise ValueError(f"{path} runs through a value")
        at[last] = value
        return self

    def merged(self, other: Settings) -> Settings:
        """The values of both, tree by tree; where both have one, that of ``other``."""

        def both(a: dict, b: dict) -> dict:
            return {**a, **{k: both(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}

        return Settings(both(self.values, other.values), self.fallback)


def sum_trees(trees: DataFrame, column: str = "value") -> DataFrame:
    """(path, total): numbers of JSON objects added up place by place, paths dotted. Rows that are
    no objects, and values that are no numbers, add nothing. Batches add up before the exchange."""

    def leaves(at: Any, path: str) -> Iterator[tuple[str, float]]:
        if isinstance(at, dict):
            for k, v in at.items():
                yield from leaves(v, f"{path}.{k}" if path else k)
        elif isinstance(at, (int, float)) and not isinstance(at, bool) and path:
            yield path, float(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[str, float] = {}
            for text in b.column(0).to_pylist():
                try:
                    tree = json.loads(text) if text else None
                except ValueError:
                    continue
                for p, v in leaves(tree, ""):
                    total[p] = total.get(p, 0.0) + v
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())], names=["path", "total"])

    return arrow_map(trees.select(F.col(column).cast("string").alias("value")), run, "path string, total double").groupBy("path").agg(F.sum("total").alias("total"))


def natural_key(name: Column) -> Column:
    """A string by whose order names with numbers sort as people expect: ``a2`` before ``a10``.
    Runs of digits, without leading zeros, are preceded by their length (up to 999 digits)."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    bare = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(bare(p)).cast("string"), 3, "0"), bare(p))).otherwise(p)), "")


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, n): how often each combination of values occurs, nulls included."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))
