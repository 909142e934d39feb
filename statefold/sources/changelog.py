"""The changelog: one row for each write, with a total order within a state.

Columns: k (key), optional ns (namespace) and uk (user key), op, value, seq (unique in a state), optional ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PUT, APPEND, DELETE, CLEAR = "PUT", "APPEND", "DELETE", "CLEAR"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(rows: DataFrame, k: Column, op: Column | str, seq: Column, value: Column | None = None, **more: Column) -> DataFrame:
    """A changelog from any rows; ``more`` names further columns such as ns, uk and ts."""
    op = F.lit(op) if isinstance(op, str) else op
    return rows.select(k.alias("k"), *[c.alias(n) for n, c in more.items()], op.alias("op"), (F.lit(None).cast("double") if value is None else value).alias("value"), seq.alias("seq"))


def with_verb(rows: DataFrame, op: str, keys: list[str] | None = None) -> DataFrame:
    """Rows (keys, value, seq) as writes of one verb; rows without one of ``keys`` are left out, as bulk calls do."""
    for k in keys or ["k"]:
        rows = rows.where(F.col(k).isNotNull())
    return rows.withColumn("op", F.lit(op))


def after(log_rows: DataFrame, more: DataFrame, order: list[str]) -> DataFrame:
    """``more`` with seq numbers that go on from the log's largest, in the given order.

    The numbers come from ranges of the order, not from one task: rows are told apart by partition and place in it, and
    only their order counts, so numbers may have gaps.
    """
    last = log_rows.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last")).first()["last"]
    ordered = more.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.withColumn("seq", F.monotonically_increasing_id() + F.lit(last + 1))


def events_log(spark: SparkSession, sf_dir: str, verbs: dict[str, str]) -> DataFrame:
    """The events table as a changelog: k user, uk event type, ns day, value, seq event id, ts; verbs by event type, else PUT."""
    e = table(spark, sf_dir, "events")
    op = F.lit(PUT)
    for kind, verb in verbs.items():
        op = F.when(F.col("event_type") == kind, verb).otherwise(op)
    return log(e, F.col("user_id"), op, F.col("event_id"), F.col("value"), uk=F.col("event_type"), ns=F.date_format("ts", "yyyy-MM-dd"), ts=F.col("ts"))


VALUE_VERBS = {"error": DELETE}
LIST_VERBS = {"error": DELETE, "view": APPEND, "signup": APPEND, "purchase": APPEND}
MAP_VERBS = {"error": CLEAR}
