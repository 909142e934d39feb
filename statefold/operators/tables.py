"""What value, list and map state answers: lookups by keys, removals, and scans. State is the frame that a fold returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statefold.sources.changelog import PUT

# -- any state, by a frame of keys ---------------------------------------------------------------------------------


def get_all(state: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of the asked keys; null keys are skipped, missing ones left out, repeated ones asked once."""
    return state.join(keys.select(*on).dropna().distinct(), on)


def get_or_default(state: DataFrame, keys: DataFrame, on: list[str], value: str, default) -> DataFrame:
    """Every asked key with its value, or the default where it has none."""
    return keys.join(state.select(*on, value), on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def contains(state: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The asked keys that have state."""
    return keys.select(*on).join(state.select(*on), on, "left_semi")


def missing(state: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return keys.select(*on).join(state.select(*on), on, "left_anti")


def remove_all(state: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """State without the given keys."""
    return state.join(keys.select(*on), on, "left_anti")


def take(state: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """get-and-remove: (what is taken, what is left)."""
    return state.where(which), state.where(~F.coalesce(which, F.lit(False)))


def keys_of(state: DataFrame, on: list[str] | None = None) -> DataFrame:
    """The live keys, each once."""
    return state.select(*(on or ["k"])).distinct()


def keys_of_namespace(state: DataFrame, ns) -> DataFrame:
    return state.where(F.col("ns") == F.lit(ns)).select("k").distinct()


def keys_and_namespaces(state: DataFrame) -> DataFrame:
    return state.select("k", "ns").distinct()


def entry_count(state: DataFrame) -> DataFrame:
    return state.agg(F.count("*").alias("n"))


# -- lists ----------------------------------------------------------------------------------------------------------


def remove_first(lists: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """Lists without the first occurrence of each given (key, element); a list that is left empty is gone."""
    asked = elements.select(*keys, "e").distinct()
    first = lists.join(asked, [*keys, "e"]).groupBy(*keys, "e").agg(F.min("pos").alias("pos"))
    return lists.join(first.select(*keys, "pos"), [*keys, "pos"], "left_anti")


def remove_every(lists: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """Lists without all occurrences of each given (key, element)."""
    return lists.join(elements.select(*keys, "e").distinct(), [*keys, "e"], "left_anti")


def sizes(lists: DataFrame, keys: list[str]) -> DataFrame:
    return lists.groupBy(*keys).agg(F.count("*").alias("n"))


def update_list(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Replaces whole lists: ``new`` has keys and an array ``es``. Null leaves a list as it is, an empty one removes it."""
    given = new.where(F.col("es").isNotNull())
    kept = current.select(*keys, "pos", "e").join(given.select(*keys), keys, "left_anti")
    return kept.unionByName(given.select(*keys, F.posexplode("es").alias("pos", "e")).withColumn("pos", F.col("pos").cast("long")))


def put_lists(rows: DataFrame) -> DataFrame:
    """Whole lists (k, value, seq; value an array) as writes: a null or empty list does nothing, a null element fails."""
    some = rows.where(F.col("value").isNotNull() & (F.size("value") > 0))
    fine = F.when(F.exists("value", lambda e: e.isNull()), F.raise_error(F.lit("a list put at once must not hold nulls")).cast("boolean")).otherwise(True)
    return some.where(fine).withColumn("op", F.lit(PUT))


def lists_or_default(lists: DataFrame, keys: DataFrame, on: list[str], default: list) -> DataFrame:
    """The asked keys' lists, or the default's elements where a key has none."""
    asked = keys.select(*on).dropna().distinct()
    none = asked.join(lists.select(*on), on, "left_anti").select(*on, F.posexplode(F.array(*map(F.lit, default))).alias("pos", "e"))
    return lists.select(*on, "pos", "e").join(asked, on, "left_semi").unionByName(none.withColumn("pos", F.col("pos").cast("long")))


# -- maps -----------------------------------------------------------------------------------------------------------


def whole_maps(entries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m: each key's entries as one map; keys without entries have no row. For use at the edge, on small maps."""
    return entries.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("uk", "uv"))).alias("m"))


def is_empty(entries: DataFrame, keys_frame: DataFrame, keys: list[str]) -> DataFrame:
    """Every asked key with ``empty``: whether it has no entries."""
    some = entries.select(*keys).distinct().withColumn("_some", F.lit(True))
    return keys_frame.select(*keys).join(some, keys, "left").select(*keys, F.col("_some").isNull().alias("empty"))


def put_entries(spark_rows: DataFrame) -> DataFrame:
    """Map writes without those that have a null user key or value, which do nothing."""
    return spark_rows.where(F.col("uk").isNotNull() & F.col("value").isNotNull())


def entries_of_maps(rows: DataFrame, keys: list[str], column: str = "m") -> DataFrame:
    """Whole maps (keys, ``column``) as PUT rows (keys, uk, value, op), without null user keys and values."""
    return put_entries(rows.select(*keys, F.explode(column).alias("uk", "value")).withColumn("op", F.lit(PUT)))


def replace_map(*_args, **_kwargs):
    """Putting a whole map at once is not offered; write a CLEAR and PUTs."""
    raise NotImplementedError("put of a whole map; write a CLEAR row and PUT rows")
