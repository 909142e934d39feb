"""Expiry, compaction, migration and out-of-line values, on changelogs and folded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statefold.functions.columns import live, millis
from statefold.operators.folds import fold_list, fold_map, list_rows
from statefold.sources.changelog import CLEAR, DELETE, PUT

# -- expiry: ``now`` is always given, in milliseconds ----------------------------------------------------------------


def unexpired(rows: DataFrame, ttl: int, now: Column, ts: str = "ts") -> DataFrame:
    return rows.where(live(millis(F.col(ts)), ttl, now))


def value_with_ttl(log: DataFrame, ttl: int, now: Column, keys: list[str] | None = None) -> DataFrame:
    """Values whose last write is not expired; an expired last write does not bring back an older one."""
    keys = keys or ["k"]
    last = log.groupBy(*keys).agg(F.max_by(F.col("op") != DELETE, "seq").alias("_live"), F.max_by("value", "seq").alias("value"), F.max_by(millis(F.col("ts")), "seq").alias("_ms"))
    return last.where(F.col("_live") & live(F.col("_ms"), ttl, now)).drop("_live", "_ms")


def map_with_ttl(log: DataFrame, ttl: int, now: Column) -> DataFrame:
    """Entries by the time of their own last write."""
    return unexpired(fold_map(log, carry=("ts",)), ttl, now)


def list_with_ttl(log: DataFrame, ttl: int, now: Column, whole: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Elements by their own time, or, with ``whole``, all of a list by the time of its newest element."""
    keys = keys or ["k"]
    rows = fold_list(log, keys)  # with the ts of the write that each element comes from
    if not whole:
        return unexpired(rows, ttl, now)
    newest = rows.groupBy(*keys).agg(F.max("ts").alias("_newest"))
    return unexpired(rows.join(newest, keys), ttl, now, "_newest").drop("_newest")


def list_from_first_live(log: DataFrame, ttl: int, now: Column, keys: list[str] | None = None) -> DataFrame:
    """Each list from its first element that is not expired on: a scan that stops at it, as later elements are newer."""
    keys = keys or ["k"]
    rows = fold_list(log, keys)
    first = unexpired(rows, ttl, now).groupBy(*keys).agg(F.min("pos").alias("_first"))
    return rows.join(first, keys).where(F.col("pos") >= F.col("_first")).drop("_first")


# -- rewriting a log as the writes that still count ------------------------------------------------------------------------------------------------------


def compact_values(log: DataFrame, major: bool, keys: list[str] | None = None) -> DataFrame:
    """One row a key: its last write. A minor compaction keeps DELETE rows, as older rows may lie below."""
    keys = keys or ["k"]
    last = log.groupBy(*keys).agg(F.max_by("op", "seq").alias("op"), F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    return last.where(F.col("op") != DELETE) if major else last


def compact_maps(log: DataFrame, major: bool, keys: list[str] | None = None) -> DataFrame:
    """The last write of each entry since the last CLEAR; a minor compaction keeps DELETE rows and the CLEAR."""
    keys = keys or ["k"]
    clears = log.where(F.col("op") == CLEAR).groupBy(*keys).agg(F.max("seq").alias("seq"))
    entries = log.where(F.col("op") != CLEAR).groupBy(*keys, "uk").agg(F.max_by("op", "seq").alias("op"), F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    live_entries = entries.join(clears.withColumnRenamed("seq", "_clear"), keys, "left").where(F.col("_clear").isNull() | (F.col("seq") > F.col("_clear"))).drop("_clear")
    if major:
        return live_entries.where(F.col("op") == PUT)
    gone = clears.withColumn("op", F.lit(CLEAR))
    return live_entries.unionByName(gone, allowMissingColumns=True)


def compact_lists(log: DataFrame, major: bool, keys: list[str] | None = None) -> DataFrame:
    """The writes that each list still consists of; a minor compaction keeps the last DELETE that nothing has replaced."""
    keys = keys or ["k"]
    kept = list_rows(log, keys)
    if major:
        return kept
    resets = log.where(F.col("op").isin(PUT, DELETE)).groupBy(*keys).agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))
    return kept.unionByName(resets.where(F.col("op") == DELETE), allowMissingColumns=True)


def tombstones(log: DataFrame) -> DataFrame:
    """op, n: the DELETE and CLEAR rows of a log."""
    return log.where(F.col("op").isin(DELETE, CLEAR)).groupBy("op").agg(F.count("*").alias("n"))


# -- migration and out-of-line values --------------------------------------------------------------------------------


def migrate(state: DataFrame, **columns: Column) -> DataFrame:
    """State rewritten with new or converted value columns."""
    return state.withColumns(columns)


def separate(rows: DataFrame, threshold: int = 200, value: str = "value", blob: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(rows, blobs): values longer than ``threshold`` move to a table of their own, under the row's seq."""
    large = F.length(value) > threshold
    inline = rows.withColumn("blob_id", F.when(large, F.col(blob))).withColumn(value, F.when(~large, F.col(value)))
    return inline, rows.where(large).select(F.col(blob).alias("blob_id"), F.col(value).alias("blob"))


def resolve(rows: DataFrame, blobs: DataFrame, value: str = "value") -> DataFrame:
    return rows.join(blobs, "blob_id", "left").withColumn(value, F.coalesce(value, "blob")).drop("blob", "blob_id")


def collect_garbage(blobs: DataFrame, rows: DataFrame) -> DataFrame:
    """The blobs that a row still refers to."""
    return blobs.join(rows.where(F.col("blob_id").isNotNull()).select("blob_id"), "blob_id", "left_semi")
