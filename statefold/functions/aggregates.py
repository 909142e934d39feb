"""Accumulators for reducing and aggregating state.

An accumulator is a few columns: how inputs make them, how two merge, and the result they finish to. Making and merging
are both Spark aggregates, so they combine before the shuffle and a hot key costs no more than any other. Null inputs
are ignored; a key without inputs has no row, and reading it gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Accumulator:
    """``make``: aggregates over (value, seq) by column; ``merge``: aggregates over the columns; ``result``: of the columns."""

    make: dict[str, Callable[[Column, Column], Column]]
    merge: dict[str, Callable[[], Column]]
    result: Callable[[], Column]


def _one(name: str, make, merge) -> Accumulator:
    return Accumulator({name: make}, {name: lambda: merge(F.col(name))}, lambda: F.col(name))


SUM = _one("sum", lambda v, s: F.sum(v), F.sum)
COUNT = _one("count", lambda v, s: F.count(v), F.sum)
MIN = _one("min", lambda v, s: F.min(v), F.min)
MAX = _one("max", lambda v, s: F.max(v), F.max)
AVG = Accumulator({"sum": lambda v, s: F.sum(v), "count": lambda v, s: F.count(v)}, {"sum": lambda: F.sum("sum"), "count": lambda: F.sum("count")}, lambda: F.col("sum") / F.col("count"))
FIRST = Accumulator({"first": lambda v, s: F.min_by(v, s), "at": lambda v, s: F.min(s)}, {"first": lambda: F.min_by("first", "at"), "at": lambda: F.min("at")}, lambda: F.col("first"))
LAST = Accumulator({"last": lambda v, s: F.max_by(v, s), "at": lambda v, s: F.max(s)}, {"last": lambda: F.max_by("last", "at"), "at": lambda: F.max("at")}, lambda: F.col("last"))


def accumulate(rows: DataFrame, keys: list[str], acc: Accumulator, value: str = "value", seq: str = "seq") -> DataFrame:
    """keys and the accumulator's columns."""
    some = rows.where(F.col(value).isNotNull())
    return some.groupBy(*keys).agg(*[f(F.col(value), F.col(seq)).alias(k) for k, f in acc.make.items()])


def merge(state: DataFrame, keys: list[str], acc: Accumulator) -> DataFrame:
    """Merges accumulators that share ``keys``."""
    return state.groupBy(*keys).agg(*[f().alias(k) for k, f in acc.merge.items()])


def finish(state: DataFrame, keys: list[str], acc: Accumulator, name: str = "result") -> DataFrame:
    return state.select(*keys, acc.result().alias(name))


def distinct_count(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Exact number of distinct non-null values: one shuffle removes repetitions, a second counts."""
    return rows.where(F.col(value).isNotNull()).select(*keys, value).distinct().groupBy(*keys).agg(F.count("*").alias("result"))
