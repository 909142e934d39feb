"""Scans, expiry, key groups, snapshots, compaction, migration, out-of-line values. A round trip must change nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from statefold.functions.columns import group_range, key_group, live
from statefold.operators import folds, maintenance, tables
from statefold.plans.registry import EVENTS, LISTS, MAPS, VALUES, query
from statefold.plans.state_queries import lists, maps, orders_log, values
from statefold.sources import snapshots
from statefold.sources.changelog import LIST_VERBS, MAP_VERBS, PUT, VALUE_VERBS, events_log, log, table
from statefold.sources.scratch import fresh

GROUPS = 128
LOG_SCHEMA = "k bigint, uk string, ns string, ts timestamp_ntz, op string, value double, seq bigint"

# -- scans -----------------------------------------------------------------------------------------------------------


@query(f"WITH {VALUES} SELECT k FROM vals")
def keys_of_state(spark, sf_dir):
    return tables.keys_of(values(spark, sf_dir))


@query(f"WITH {MAPS} SELECT DISTINCT k FROM maps")
def keys_of_map_state(spark, sf_dir):
    return tables.keys_of(maps(spark, sf_dir))


DAY_VALUES = f"{EVENTS}, nv AS (SELECT k, ns, arg_max(value, seq) AS value FROM ev GROUP BY k, ns HAVING arg_max(vop, seq) <> 'DELETE')"


@query(f"WITH {DAY_VALUES} SELECT DISTINCT k FROM nv WHERE ns = (SELECT min(ns) FROM ev)")
def keys_of_namespace(spark, sf_dir):
    rows = events_log(spark, sf_dir, VALUE_VERBS)
    return tables.keys_of_namespace(folds.fold_value(rows, ["k", "ns"]), rows.agg(F.min("ns")).scalar())


@query(f"WITH {DAY_VALUES} SELECT DISTINCT k, ns FROM nv")
def keys_and_namespaces(spark, sf_dir):
    return tables.keys_and_namespaces(folds.fold_value(events_log(spark, sf_dir, VALUE_VERBS), ["k", "ns"]))


@query(f"WITH {MAPS} SELECT count(*) AS n FROM maps")
def entry_count(spark, sf_dir):
    return tables.entry_count(maps(spark, sf_dir))


@query(f"WITH {VALUES} SELECT k, value, seq FROM vals")
def full_scan_value(spark, sf_dir):
    return values(spark, sf_dir).select("k", "value", "seq")


@query(f"WITH {MAPS} SELECT k, uk, uv, seq FROM maps")
def full_scan_map(spark, sf_dir):
    return maps(spark, sf_dir).select("k", "uk", "uv", "seq")


@query(f"WITH {LISTS} SELECT k, pos, e, seq FROM lists")
def full_scan_list(spark, sf_dir):
    return lists(spark, sf_dir).select("k", "pos", "e", "seq")


@query(f"WITH {MAPS} SELECT uk FROM maps WHERE k = (SELECT min(k) FROM ev)")
def sub_key_scan(spark, sf_dir):
    rows = events_log(spark, sf_dir, MAP_VERBS)
    return folds.fold_map(rows.where(F.col("k") == rows.agg(F.min("k")).scalar())).select("uk")


@query("SELECT trim(w) AS word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM conversations) WHERE w <> '' GROUP BY 1")
def wordcount(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


# -- expiry: a week, read ten days after the first event --------------------------------------------------------------

TTL = 7 * 86_400_000
NOW = "(SELECT (min(epoch_us(ts)) // 1000) + 864000000 FROM events)"


def now(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.unix_millis(F.min("ts").cast("timestamp")) + 864_000_000).scalar()


def live_sql(us: str = "ts") -> str:
    return f"epoch_us({us}) // 1000 + {TTL} > {NOW}"


@query(f"WITH {EVENTS} SELECT k, arg_max(value, seq) AS value FROM ev GROUP BY k HAVING arg_max(vop, seq) <> 'DELETE' AND arg_max(epoch_us(ts) // 1000, seq) + {TTL} > {NOW}")
def ttl_value(spark, sf_dir):
    return maintenance.value_with_ttl(events_log(spark, sf_dir, VALUE_VERBS), TTL, now(spark, sf_dir)).select("k", "value")


@query(f"WITH {MAPS} SELECT maps.k, maps.uk, uv FROM maps JOIN ev USING (seq) WHERE {live_sql()}")
def ttl_map_entry(spark, sf_dir):
    return maintenance.map_with_ttl(events_log(spark, sf_dir, MAP_VERBS), TTL, now(spark, sf_dir)).select("k", "uk", "uv")


@query(f"WITH {LISTS} SELECT k, pos, e FROM lists WHERE {live_sql()}")
def ttl_list_element(spark, sf_dir):
    return maintenance.list_with_ttl(events_log(spark, sf_dir, LIST_VERBS), TTL, now(spark, sf_dir)).select("k", "pos", "e")


@query(f"WITH {LISTS}, newest AS (SELECT k, max(ts) AS t FROM lists GROUP BY k) SELECT k, pos, e FROM lists JOIN newest USING (k) WHERE {live_sql('t')}")
def ttl_list_whole(spark, sf_dir):
    return maintenance.list_with_ttl(events_log(spark, sf_dir, LIST_VERBS), TTL, now(spark, sf_dir), whole=True).select("k", "pos", "e")


@query(f"WITH {LISTS}, f AS (SELECT k, min(pos) AS f FROM lists WHERE {live_sql()} GROUP BY k) SELECT k, pos, e FROM lists JOIN f USING (k) WHERE pos >= f")
def ttl_list_from_first(spark, sf_dir):
    return maintenance.list_from_first_live(events_log(spark, sf_dir, LIST_VERBS), TTL, now(spark, sf_dir)).select("k", "pos", "e")


@query("SELECT * FROM (VALUES ('after', true), ('never', true)) AS t(k, alive)")
def ttl_boundary(spark, sf_dir):
    """A row written ttl before now is expired, one millisecond later it is not; without a ttl nothing is."""
    rows = spark.createDataFrame([("before", 999, 1000), ("at", 1000, 1000), ("after", 1001, 1000), ("never", 0, 0)], "k string, ms bigint, ttl bigint")
    return rows.where(live(F.col("ms"), F.col("ttl"), F.lit(2000))).select("k", F.lit(True).alias("alive"))


# -- key groups and rescaling ------------------------------------------------------------------------------------------


@query("SELECT CAST(c_custkey % 128 AS INTEGER) AS key_group, CAST((c_custkey % 128) * 4 // 128 AS BIGINT) AS part, count(*) AS n FROM customer GROUP BY 1, 2")
def keygroup_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(key_group(F.col("c_custkey"), GROUPS, hashed=False).alias("key_group"))
    part = F.lit(-1)
    for i in range(4):
        part = F.when(F.col("key_group").between(*group_range(i, 4, GROUPS)), i).otherwise(part)
    return rows.groupBy("key_group", part.cast("long").alias("part")).agg(F.count("*").alias("n"))


def snapshot_of(spark, rows, what, **options):
    root = fresh(spark, what)
    snapshots.write(rows, root, "1", groups=GROUPS, hashed=False, **options)
    return root


@query(f"WITH {VALUES} SELECT k, value, CAST(CASE WHEN k % 128 <= 42 THEN 0 WHEN k % 128 <= 85 THEN 1 ELSE 2 END AS INTEGER) AS part FROM vals")
def rescale_out(spark, sf_dir):
    root = snapshot_of(spark, events_log(spark, sf_dir, VALUE_VERBS), "rescale-out")
    parts = [folds.fold_value(p).withColumn("part", F.lit(i)) for i, p in enumerate(snapshots.rescale_out(spark, root, "1", LOG_SCHEMA, 3, GROUPS))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("k", "value", "part")


@query(f"WITH {LISTS} SELECT k, pos, e FROM lists")
def rescale_in(spark, sf_dir):
    rows, root = events_log(spark, sf_dir, LIST_VERBS), fresh(spark, "rescale-in")
    for i in range(2):
        snapshots.write(rows, root, str(i), groups=GROUPS, hashed=False, owned=group_range(i, 2, GROUPS))
    whole, _ = snapshots.restore(spark, root, ["0", "1"], LOG_SCHEMA)
    return folds.fold_list(whole).select("k", "pos", "e")


# -- snapshots ---------------------------------------------------------------------------------------------------------


@query(f"WITH {VALUES} SELECT k, value FROM vals")
def snapshot_full_restore(spark, sf_dir):
    root = snapshot_of(spark, events_log(spark, sf_dir, VALUE_VERBS), "full")
    return folds.fold_value(snapshots.restore(spark, root, ["1"], LOG_SCHEMA)[0]).select("k", "value")


def increments(spark, sf_dir, verbs, steps: int = 3):
    """A full snapshot of the log's first part and incremental ones of the others."""
    rows, root = events_log(spark, sf_dir, verbs), fresh(spark, "incremental")
    last = rows.agg(F.max("seq")).first()[0]
    for i in range(steps):
        upto = rows.where(F.col("seq") <= (i + 1) * last // steps)
        snapshots.write(upto, root, str(i), "incremental" if i else "full", str(i - 1) if i else None, GROUPS, hashed=False)
    return root, str(steps - 1)


@query(f"WITH {MAPS} SELECT k, uk, uv FROM maps")
def snapshot_incremental_restore(spark, sf_dir):
    root, last = increments(spark, sf_dir, MAP_VERBS)
    return folds.fold_map(snapshots.restore(spark, root, [last], LOG_SCHEMA)[0]).select("k", "uk", "uv")


@query(f"WITH {VALUES} SELECT k, value FROM vals")
def savepoint_restore(spark, sf_dir):
    state = values(spark, sf_dir).select("k", "value", "seq")
    root = snapshot_of(spark, state, "savepoint", kind="savepoint")
    return snapshots.restore(spark, root, ["1"], "k bigint, value double, seq bigint")[0].select("k", "value")


@query(f"WITH {EVENTS}, more AS (SELECT k, vop, value, seq FROM ev UNION ALL SELECT c_custkey, 'PUT', -2.0, (SELECT max(seq) FROM ev) + 1 FROM customer) SELECT k, arg_max(value, seq) AS value FROM more GROUP BY k HAVING arg_max(vop, seq) <> 'DELETE'")
def restore_then_write(spark, sf_dir):
    """Writes after a restore get numbers above all restored ones, so they win."""
    root = snapshot_of(spark, events_log(spark, sf_dir, VALUE_VERBS), "then-write")
    rows, seq = snapshots.restore(spark, root, ["1"], LOG_SCHEMA)
    puts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(PUT).alias("op"), F.lit(-2.0).alias("value"), F.lit(seq).alias("seq"))
    return folds.fold_value(rows.select("k", "op", "value", "seq").unionByName(puts)).select("k", "value")


@query(f"WITH {LISTS}, {MAPS.removeprefix(EVENTS + ',').strip()}, vals AS (SELECT k, arg_max(value, seq) AS value FROM ev GROUP BY k HAVING arg_max(vop, seq) <> 'DELETE') SELECT 'values' AS state_name, k, '' AS uk, CAST(-1 AS BIGINT) AS pos, value FROM vals UNION ALL SELECT 'lists', k, '', pos, e FROM lists UNION ALL SELECT 'maps', k, uk, -1, uv FROM maps")
def savepoint_scan_all_states(spark, sf_dir):
    """Several named states in one savepoint, scanned together."""
    root = snapshot_of(spark, named_states(spark, sf_dir), "all-states", kind="savepoint")
    return snapshots.restore(spark, root, ["1"], STATES)[0].select("state_name", "k", F.coalesce("uk", F.lit("")).alias("uk"), F.coalesce("pos", F.lit(-1).cast("bigint")).alias("pos"), "value")


@query(f"WITH {MAPS} SELECT k, uk, uv FROM maps")
def savepoint_restore_one_state(spark, sf_dir):
    """One of several named states; only its files are read."""
    root = snapshot_of(spark, named_states(spark, sf_dir), "one-state", kind="savepoint")
    return snapshots.restore(spark, root, ["1"], STATES)[0].where("state_name = 'maps'").select("k", "uk", F.col("value").alias("uv"))


STATES = "state_name string, k bigint, uk string, pos bigint, value double, seq bigint"


def named_states(spark, sf_dir):
    lists_state = lists(spark, sf_dir).select("k", "pos", F.col("e").alias("value"), "seq")
    maps_state = maps(spark, sf_dir).select("k", "uk", F.col("uv").alias("value"), "seq")
    return snapshots.named(values=values(spark, sf_dir).select("k", "value", "seq"), lists=lists_state, maps=maps_state)


# -- compaction --------------------------------------------------------------------------------------------------------


@query(f"WITH {MAPS} SELECT k, uk, uv FROM maps")
def compact_minor_equiv(spark, sf_dir):
    """Old rows compacted with their tombstones, under new rows: the fold stays the same."""
    rows = events_log(spark, sf_dir, MAP_VERBS).select("k", "uk", "op", "value", "seq")
    half = rows.agg(F.floor(F.max("seq") / 2)).scalar()
    small = maintenance.compact_maps(rows.where(F.col("seq") <= half), major=False)
    return folds.fold_map(small.unionByName(rows.where(F.col("seq") > half))).select("k", "uk", "uv")


@query(f"WITH {LISTS} SELECT k, pos, e FROM lists")
def compact_minor_list_equiv(spark, sf_dir):
    rows = events_log(spark, sf_dir, LIST_VERBS).select("k", "op", "value", "seq")
    half = rows.agg(F.floor(F.max("seq") / 2)).scalar()
    small = maintenance.compact_lists(rows.where(F.col("seq") <= half), major=False)
    return folds.fold_list(small.select(*rows.columns).unionByName(rows.where(F.col("seq") > half))).select("k", "pos", "e")


@query(f"WITH {VALUES} SELECT k, value FROM vals")
def compact_major_equiv(spark, sf_dir):
    return maintenance.compact_values(events_log(spark, sf_dir, VALUE_VERBS), major=True).select("k", "value")


@query(f"WITH {EVENTS}, c AS (SELECT k, arg_max(vop, seq) AS op FROM ev GROUP BY k) SELECT op, count(*) AS n FROM c WHERE op = 'DELETE' GROUP BY op")
def tombstone_count(spark, sf_dir):
    return maintenance.tombstones(maintenance.compact_values(events_log(spark, sf_dir, VALUE_VERBS), major=False))


# -- migration, out-of-line values --------------------------------------------------------------------------------------


@query("SELECT o_custkey AS k, o_orderpriority AS uk, CAST(round(arg_max(o_totalprice, o_orderkey)) AS BIGINT) AS n FROM orders GROUP BY 1, 2 HAVING arg_max(o_orderstatus, o_orderkey) <> 'F'")
def migrate_widen_value(spark, sf_dir):
    state = folds.fold_map(orders_log(spark, sf_dir)).select("k", "uk", F.round("uv").cast("int").alias("n"))
    return maintenance.migrate(state, n=F.col("n").cast("bigint"))


@query(f"WITH {VALUES} SELECT k, value, 'v2' AS note FROM vals")
def migrate_add_column(spark, sf_dir):
    root = snapshot_of(spark, values(spark, sf_dir).select("k", "value", "seq"), "migrate", kind="savepoint")
    old, _ = snapshots.restore(spark, root, ["1"], "k bigint, value double, seq bigint")
    return maintenance.migrate(old, note=F.lit("v2")).select("k", "value", "note")


@query("SELECT doc_id AS k, CAST(length(text) AS INTEGER) AS n, md5(text) AS digest FROM documents")
def kv_separated_values(spark, sf_dir):
    docs = log(table(spark, sf_dir, "documents"), F.col("doc_id"), PUT, F.col("doc_id"), F.col("text"))
    inline, blobs = maintenance.separate(docs)
    whole = maintenance.resolve(inline, blobs)
    return whole.select("k", F.length("value").alias("n"), F.md5("value").alias("digest"))


@query("SELECT count(*) AS blobs FROM documents WHERE length(text) > 200 AND lang <> 'en'")
def kv_blob_garbage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    inline, blobs = maintenance.separate(docs.select(F.col("doc_id").alias("seq"), F.col("text").alias("value"), "lang"))
    return maintenance.collect_garbage(blobs, inline.where("lang <> 'en'")).agg(F.count("*").alias("blobs"))
