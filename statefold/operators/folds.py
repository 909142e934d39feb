"""The four folds: what a changelog leaves as value, list, map and timer state.

Folds group by key with aggregates that combine before the shuffle. Where rows must meet their key's last reset or clear,
they do so in an equi-join, which adaptive execution can split for a hot key; no fold gathers a key's rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statefold.sources.changelog import APPEND, CLEAR, DELETE, PUT

K = ["k"]
#: seq numbers are unique, so so many of them in a row hold at most so many rows of a key.
BUCKET = 1 << 16


def fold_value(log: DataFrame, keys: list[str] = K) -> DataFrame:
    """keys, value, seq of keys whose last write is not a DELETE."""
    last = log.groupBy(*keys).agg(F.max_by(F.col("op") != DELETE, "seq").alias("_live"), F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    return last.where("_live").drop("_live")


def list_rows(log: DataFrame, keys: list[str] = K) -> DataFrame:
    """The writes that a list consists of: since the last PUT or DELETE, with that PUT."""
    resets = log.where(F.col("op").isin(PUT, DELETE)).groupBy(*keys).agg(F.max("seq").alias("_reset"))
    kept = log.where(F.col("op").isin(PUT, APPEND)).join(resets, keys, "left")
    # A PUT has the seq of its reset only if it is the last one, a DELETE is no longer here.
    return kept.where(F.col("_reset").isNull() | (F.col("seq") >= F.col("_reset"))).drop("_reset")


def positions(rows: DataFrame, keys: list[str], seq: str = "seq", within: list[str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """Adds pos, a row's place in its key from 0 by (seq, within).

    Ranks are counted within buckets of seq and added to the sizes of the key's earlier buckets, so a hot key is many groups.
    """
    parts = rows.withColumn("_bucket", F.floor(F.col(seq) / bucket))
    local = parts.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(seq, *(within or []))))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return local.join(sizes, [*keys, "_bucket"]).withColumn("pos", (F.col("_base") + F.col("_rank") - 1).cast("long")).drop("_bucket", "_rank", "_base")


def fold_list(log: DataFrame, keys: list[str] = K, bucket: int = BUCKET) -> DataFrame:
    """keys, pos, e, seq: each list's elements, oldest first. A value that is an array is several elements of one write."""
    rows = list_rows(log, keys).drop("op")
    if dict(log.dtypes)["value"].startswith("array"):
        rows = rows.select("*", F.posexplode("value").alias("_i", "e")).drop("value")
        return positions(rows, keys, within=["_i"], bucket=bucket).drop("_i")
    return positions(rows.withColumnRenamed("value", "e"), keys, bucket=bucket)


def fold_map(log: DataFrame, keys: list[str] = K, carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, uk, uv, seq: the last write of each entry, unless it is a DELETE or older than the key's last CLEAR; ``carry`` are more columns of that write."""
    entries = log.where(F.col("op").isin(PUT, DELETE) & F.col("uk").isNotNull())
    last = entries.groupBy(*keys, "uk").agg(F.max_by(F.col("op") == PUT, "seq").alias("_live"), F.max_by("value", "seq").alias("uv"), F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in carry]).where("_live")
    clears = log.where(F.col("op") == CLEAR).groupBy(*keys).agg(F.max("seq").alias("_clear"))
    return last.join(clears, keys, "left").where(F.col("_clear").isNull() | (F.col("seq") > F.col("_clear"))).drop("_live", "_clear")


def fold_timers(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The timers (key_group, ts, k, ns) whose last write is a PUT; a timer set twice is one."""
    keys = keys or [c for c in ("key_group", "ts", "k", "ns") if c in log.columns]
    return log.groupBy(*keys).agg(F.max_by(F.col("op") == PUT, "seq").alias("_live")).where("_live").drop("_live")


def reduce_in_order(rows: DataFrame, keys: list[str], merge, bucket: int = BUCKET) -> DataFrame:
    """keys, acc: an associative function applied to a key's values in the order of seq; it need not commute.

    First within buckets of seq, then over the buckets' results.
    """

    def level(df: DataFrame, by: list[str], order: str) -> DataFrame:
        got = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("value").alias("v")))).alias("xs"))
        folded: Column = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), F.col("xs")[0]["v"], lambda a, x: merge(a, x["v"]))
        return got.select(*by, folded.alias("value"))

    some = rows.where(F.col("value").isNotNull()).withColumn("_bucket", F.floor(F.col("seq") / bucket))
    return level(level(some, [*keys, "_bucket"], "seq"), keys, "_bucket").withColumnRenamed("value", "acc")
