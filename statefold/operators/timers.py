"""Timers: a set of (key_group, ts, k, ns), ordered within a key group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statefold.functions.columns import MAX_PARALLELISM, key_group

ORDER = ["ts", "k", "ns"]


def timer_log(rows: DataFrame, groups: int = MAX_PARALLELISM, hashed: bool = True) -> DataFrame:
    """Adds key_group to rows (ts, k, ns, op, seq)."""
    return rows.withColumn("key_group", key_group(F.col("k"), groups, hashed))


def heads(timers: DataFrame) -> DataFrame:
    """The first timer of each key group; least tuples combine before the shuffle."""
    first = timers.groupBy("key_group").agg(F.min(F.struct(*ORDER)).alias("t"))
    return first.select("key_group", *[F.col(f"t.{c}").alias(c) for c in ORDER])


def due(timers: DataFrame, now: Column) -> DataFrame:
    return timers.where(F.col("ts") <= now)


def poll(timers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads of the key groups, the timers without them)."""
    taken = heads(timers)
    return taken, timers.join(taken, ["key_group", *ORDER], "left_anti")


def ordered(timers: DataFrame) -> DataFrame:
    """In the order of key groups and, within them, of timers; a group may be several partitions."""
    return timers.repartitionByRange("key_group", *ORDER).sortWithinPartitions("key_group", *ORDER)
