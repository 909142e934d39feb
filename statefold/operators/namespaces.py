"""Namespaced state, (key, namespace) -> value, list or map, and merging of namespaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statefold.functions import aggregates


def require_namespace(rows: DataFrame) -> DataFrame:
    """Fails on a null key or namespace, when a row with one is read."""
    ok = F.col("k").isNotNull() & F.col("ns").isNotNull()
    return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("key and namespace must not be null")).cast("boolean")))


def merge_accumulators(state: DataFrame, target: Column, acc: aggregates.Accumulator, keys: list[str] | None = None) -> DataFrame:
    """Reducing and aggregating state: every namespace goes to its target; a target without state of its own is no special case."""
    return aggregates.merge(state.withColumn("target", target), [*(keys or ["k"]), "target"], acc)


def merge_lists(lists: DataFrame, target: Column, keys: list[str] | None = None) -> DataFrame:
    """keys, target, pos, e: the target's own elements first, then those of the other namespaces in order."""
    keys = [*(keys or ["k"]), "target"]
    rows = lists.withColumn("target", target).withColumn("_own", (F.col("ns") != F.col("target")).cast("int"))
    counts = rows.groupBy(*keys, "_own", "ns").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_own", "ns").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, "ns", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(bases, [*keys, "ns"]).select(*keys, (F.col("_base") + F.col("pos")).cast("long").alias("pos"), "e")


def sessions(rows: DataFrame, gap: str, keys: list[str] | None = None, **aggs: Column) -> DataFrame:
    """Session namespaces merged as rows come: keys, start, end and aggregates of each session."""
    grouped = rows.groupBy(*(keys or ["k"]), F.session_window("ts", gap).alias("w"))
    made = grouped.agg(*[c.alias(n) for n, c in aggs.items()])
    return made.select(*(keys or ["k"]), F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggs)


def by_namespace(entries: DataFrame, value: str = "value") -> DataFrame:
    """k, m: the namespaces of each key with their values, as one map. For use at the edge."""
    return entries.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("ns", value))).alias("m"))


def without_namespace(*_args, **_kwargs):
    raise NotImplementedError("state without a namespace has none to merge")
