"""Value, list, map, aggregating and namespaced state, timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statefold.functions import aggregates as agg
from statefold.operators import folds, namespaces, tables, timers
from statefold.plans.registry import EVENTS, LISTS, MAPS, VALUES, query
from statefold.sources.changelog import APPEND, DELETE, LIST_VERBS, MAP_VERBS, PUT, VALUE_VERBS, after, events_log, log, table, with_verb


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_value(events_log(spark, sf_dir, VALUE_VERBS))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_list(events_log(spark, sf_dir, LIST_VERBS))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_map(events_log(spark, sf_dir, MAP_VERBS))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))


# -- value state -----------------------------------------------------------------------------------------------------


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def value_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    state = folds.fold_value(log(e, F.col("user_id"), PUT, F.col("event_id"), F.col("value")))
    return state.select(F.col("k").alias("user_id"), F.col("seq").alias("event_id"), "value")


@query(f"WITH {VALUES} SELECT k AS user_id, value FROM vals")
def value_latest_with_deletes(spark, sf_dir):
    return values(spark, sf_dir).select(F.col("k").alias("user_id"), "value")


@query(f"WITH {VALUES} SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT k FROM vals)")
def value_contains_semi(spark, sf_dir):
    return tables.contains(values(spark, sf_dir), customers(spark, sf_dir), ["k"])


@query(f"WITH {VALUES} SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT k FROM vals)")
def value_missing_anti(spark, sf_dir):
    return tables.missing(values(spark, sf_dir), customers(spark, sf_dir), ["k"])


@query(f"WITH {VALUES} SELECT c_custkey AS k, coalesce(value, -1.0) AS value FROM customer LEFT JOIN vals ON c_custkey = k")
def value_default(spark, sf_dir):
    return tables.get_or_default(values(spark, sf_dir), customers(spark, sf_dir), ["k"], "value", -1.0)


@query(f"WITH {VALUES} SELECT k, value FROM vals WHERE k IN (SELECT s_suppkey FROM supplier)")
def value_bulk_get(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return tables.get_all(values(spark, sf_dir), keys, ["k"]).select("k", "value")


@query(f"WITH {VALUES} SELECT k, value FROM vals WHERE k NOT IN (SELECT s_suppkey FROM supplier)")
def value_bulk_remove(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return tables.remove_all(values(spark, sf_dir), keys, ["k"]).select("k", "value")


@query(f"""WITH {EVENTS}, more AS (SELECT k, vop, value, seq FROM ev UNION ALL SELECT s_suppkey, 'PUT', s_acctbal, (SELECT max(seq) FROM ev) + s_suppkey + 1 FROM supplier)
SELECT k, arg_max(value, seq) AS value FROM more GROUP BY k HAVING arg_max(vop, seq) <> 'DELETE'""")
def value_bulk_put(spark, sf_dir):
    base = events_log(spark, sf_dir, VALUE_VERBS).select("k", "op", "value", "seq")
    puts = with_verb(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("value")), PUT)
    return folds.fold_value(base.unionByName(after(base, puts, ["k"]).select(*base.columns))).select("k", "value")


@query("SELECT l_suppkey AS k, round(sum(l_quantity), 2) AS acc FROM lineitem GROUP BY l_suppkey")
def reduce_sum(spark, sf_dir):
    state = agg.accumulate(lineitem_log(spark, sf_dir), ["k"], agg.SUM)
    return state.select("k", F.round("sum", 2).alias("acc"))


def lineitem_log(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))


@query("SELECT l_suppkey AS k, max(l_quantity) AS acc FROM lineitem GROUP BY l_suppkey")
def reduce_max(spark, sf_dir):
    return agg.finish(agg.accumulate(lineitem_log(spark, sf_dir), ["k"], agg.MAX), ["k"], agg.MAX, "acc")


@query("SELECT l_suppkey AS k, min(l_quantity) AS acc FROM lineitem GROUP BY l_suppkey")
def reduce_min(spark, sf_dir):
    return agg.finish(agg.accumulate(lineitem_log(spark, sf_dir), ["k"], agg.MIN), ["k"], agg.MIN, "acc")


@query("SELECT user_id AS k, string_agg(event_type, '>' ORDER BY event_id) AS acc FROM events GROUP BY user_id")
def reduce_ordered_noncommutative(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return folds.reduce_in_order(e, ["k"], lambda a, b: F.concat(a, F.lit(">"), b))


@query("SELECT l_suppkey AS k, round(avg(l_quantity), 8) AS result FROM lineitem GROUP BY l_suppkey")
def aggregate_avg(spark, sf_dir):
    done = agg.finish(agg.accumulate(lineitem_log(spark, sf_dir), ["k"], agg.AVG), ["k"], agg.AVG)
    return done.withColumn("result", F.round("result", 8))


@query("SELECT l_suppkey AS k, round(sum(l_quantity), 2) AS acc_sum, count(l_quantity) AS acc_count FROM lineitem GROUP BY l_suppkey")
def aggregate_struct_acc(spark, sf_dir):
    return agg.accumulate(lineitem_log(spark, sf_dir), ["k"], agg.AVG).select("k", F.round("sum", 2).alias("acc_sum"), F.col("count").alias("acc_count"))


@query("SELECT user_id AS k, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, count(value) AS n FROM events GROUP BY user_id")
def aggregate_first_last_count(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "value", F.col("event_id").alias("seq"))
    first, last, n = (agg.finish(agg.accumulate(e, ["k"], a), ["k"], a, name) for a, name in ((agg.FIRST, "first"), (agg.LAST, "last"), (agg.COUNT, "n")))
    return first.join(last, "k").join(n, "k")


@query("SELECT user_id AS k, count(DISTINCT event_type) AS result FROM events GROUP BY user_id")
def aggregate_distinct_count(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("value"))
    return agg.distinct_count(e, ["k"])


@query("SELECT user_id AS k, round(sum(CASE WHEN event_type = 'view' THEN NULL ELSE value END), 2) AS acc FROM events GROUP BY user_id HAVING count(CASE WHEN event_type = 'view' THEN NULL ELSE value END) > 0")
def reduce_ignores_nulls(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.when(F.col("event_type") != "view", F.col("value")).alias("value"), F.col("event_id").alias("seq"))
    return agg.accumulate(e, ["k"], agg.SUM).select("k", F.round("sum", 2).alias("acc"))


# -- list state ------------------------------------------------------------------------------------------------------


@query("SELECT conv_id AS k, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos, role AS e FROM conversations")
def list_append_get(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return folds.fold_list(log(c, F.col("conv_id"), APPEND, F.col("turn"), F.col("role"))).select("k", "pos", "e")


@query(f"WITH {LISTS} SELECT k, pos, e FROM lists")
def list_put_resets(spark, sf_dir):
    return lists(spark, sf_dir).select("k", "pos", "e")


@query(f"WITH {EVENTS}, d AS (SELECT k, max(seq) AS r FROM ev WHERE uk = 'error' GROUP BY k) SELECT ev.k, CAST(row_number() OVER (PARTITION BY ev.k ORDER BY seq) - 1 AS BIGINT) AS pos, value AS e FROM ev LEFT JOIN d ON ev.k = d.k WHERE uk <> 'error' AND (r IS NULL OR seq > r)")
def list_delete_then_append(spark, sf_dir):
    verbs = {"error": DELETE} | dict.fromkeys(("view", "signup", "purchase", "click"), APPEND)
    return folds.fold_list(events_log(spark, sf_dir, verbs)).select("k", "pos", "e")


@query("SELECT o_custkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, i) - 1 AS BIGINT) AS pos, e FROM (SELECT o_custkey, o_orderkey, unnest([1, 2]) AS i, unnest([o_orderstatus, o_orderpriority]) AS e FROM orders)")
def list_add_all(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    made = log(o, F.col("o_custkey"), APPEND, F.col("o_orderkey"), F.array("o_orderstatus", "o_orderpriority"))
    return folds.fold_list(made).select("k", "pos", "e")


def typed_lists(spark, sf_dir):
    """The lists with event types as elements, so that elements repeat."""
    e = events_log(spark, sf_dir, LIST_VERBS)
    return folds.fold_list(e.withColumn("value", F.col("uk")))


@query(f"WITH {LISTS} SELECT k, pos, uk AS e FROM (SELECT *, row_number() OVER (PARTITION BY k, uk ORDER BY pos) AS rn FROM lists) WHERE NOT (uk = 'view' AND rn = 1)")
def list_remove_first(spark, sf_dir):
    state = typed_lists(spark, sf_dir)
    asked = state.select("k").distinct().withColumn("e", F.lit("view"))
    return tables.remove_first(state, asked, ["k"]).select("k", "pos", "e")


@query(f"WITH {LISTS} SELECT k, pos, uk AS e FROM lists WHERE uk NOT IN ('view', 'signup')")
def list_remove_all(spark, sf_dir):
    state = typed_lists(spark, sf_dir)
    asked = state.select("k").distinct().withColumn("e", F.explode(F.array(F.lit("view"), F.lit("signup"))))
    return tables.remove_every(state, asked, ["k"]).select("k", "pos", "e")


@query(f"WITH {LISTS} SELECT k, count(*) AS n FROM lists GROUP BY k")
def list_size_contains(spark, sf_dir):
    return tables.sizes(lists(spark, sf_dir), ["k"])


@query(f"WITH {LISTS} SELECT k, pos, e FROM lists WHERE k % 3 <> 0 UNION ALL SELECT k, 0, -1.0 FROM (SELECT DISTINCT k FROM lists WHERE k % 6 = 0)")
def list_update(spark, sf_dir):
    state = lists(spark, sf_dir)
    keys = state.select("k").distinct()
    new = keys.withColumn("es", F.when(F.col("k") % 6 == 0, F.array(F.lit(-1.0))).when(F.col("k") % 3 == 0, F.array().cast("array<double>")))
    return tables.update_list(state, new, ["k"])


@query(f"WITH {LISTS} SELECT k, pos, e FROM lists WHERE k IN (SELECT s_suppkey FROM supplier)")
def list_bulk_get(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return tables.get_all(lists(spark, sf_dir), keys, ["k"]).select("k", "pos", "e")


@query("SELECT o_custkey AS k, CAST(i AS BIGINT) AS pos, CASE i WHEN 0 THEN a ELSE b END AS e FROM (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS a, arg_max(o_orderstatus, o_orderkey) AS b, unnest([0, 1]) AS i FROM orders WHERE o_orderstatus NOT IN ('F', 'P') GROUP BY o_custkey)")
def list_put_all_rules(spark, sf_dir):
    """Putting a null or an empty list does nothing; any other replaces the list."""
    o = table(spark, sf_dir, "orders")
    es = F.when(F.col("o_orderstatus") == "F", F.array().cast("array<string>")).when(F.col("o_orderstatus") != "P", F.array("o_orderpriority", "o_orderstatus"))
    return folds.fold_list(tables.put_lists(o.select(F.col("o_custkey").alias("k"), es.alias("value"), F.col("o_orderkey").alias("seq")))).select("k", "pos", "e")


@query(f"WITH {LISTS} SELECT k, pos, e FROM lists WHERE k NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, 0, s_acctbal FROM supplier")
def list_bulk_put(spark, sf_dir):
    base = events_log(spark, sf_dir, LIST_VERBS).select("k", "op", "value", "seq")
    puts = with_verb(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("value")), PUT)
    return folds.fold_list(base.unionByName(after(base, puts, ["k"]).select(*base.columns))).select("k", "pos", "e")


@query(f"WITH {LISTS}, s AS (SELECT DISTINCT s_suppkey FROM supplier) SELECT k, pos, e FROM lists UNION ALL SELECT s_suppkey, (SELECT count(*) FROM lists WHERE k = s_suppkey), s_acctbal FROM supplier")
def list_bulk_add(spark, sf_dir):
    base = events_log(spark, sf_dir, LIST_VERBS).select("k", "op", "value", "seq")
    adds = with_verb(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("value")), APPEND)
    return folds.fold_list(base.unionByName(after(base, adds, ["k"]).select(*base.columns))).select("k", "pos", "e")


@query(f"WITH {LISTS} SELECT k, pos, e FROM lists WHERE k NOT IN (SELECT s_suppkey FROM supplier)")
def list_bulk_remove(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return tables.remove_all(lists(spark, sf_dir), keys, ["k"]).select("k", "pos", "e")


@query(f"WITH {LISTS} SELECT k, pos, e FROM lists WHERE k IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 0, -1.0 FROM customer WHERE c_custkey NOT IN (SELECT k FROM lists)")
def list_get_or_default(spark, sf_dir):
    return tables.lists_or_default(lists(spark, sf_dir), customers(spark, sf_dir), ["k"], [-1.0])


# -- map state -------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS k, o_orderpriority AS uk, arg_max(o_totalprice, o_orderkey) AS uv FROM orders GROUP BY o_custkey, o_orderpriority")
def map_put_get(spark, sf_dir):
    return folds.fold_map(orders_log(spark, sf_dir, False)).select("k", "uk", "uv")


def orders_log(spark, sf_dir, deletes: bool = True):
    o = table(spark, sf_dir, "orders")
    op = F.when(F.col("o_orderstatus") == "F", DELETE).otherwise(PUT) if deletes else F.lit(PUT)
    return log(o, F.col("o_custkey"), op, F.col("o_orderkey"), F.col("o_totalprice"), uk=F.col("o_orderpriority"))


ORDERS = "om AS (SELECT o_custkey AS k, o_orderpriority AS uk, arg_max(o_totalprice, o_orderkey) AS uv FROM orders GROUP BY o_custkey, o_orderpriority HAVING arg_max(o_orderstatus, o_orderkey) <> 'F')"


@query(f"WITH {ORDERS} SELECT k, uk, uv FROM om")
def map_remove_entry(spark, sf_dir):
    return folds.fold_map(orders_log(spark, sf_dir)).select("k", "uk", "uv")


@query(f"WITH {MAPS} SELECT k, uk, uv FROM maps")
def map_clear_then_put(spark, sf_dir):
    return maps(spark, sf_dir).select("k", "uk", "uv")


@query(f"WITH {MAPS} SELECT k, uk, uv FROM maps")
def map_entries(spark, sf_dir):
    return maps(spark, sf_dir).select("k", "uk", "uv")


@query(f"WITH {MAPS} SELECT k, uk FROM maps")
def map_keys(spark, sf_dir):
    return maps(spark, sf_dir).select("k", "uk")


@query(f"WITH {MAPS} SELECT k, uv FROM maps")
def map_values(spark, sf_dir):
    return maps(spark, sf_dir).select("k", "uv")


@query(f"WITH {MAPS} SELECT c_custkey AS k, c_custkey NOT IN (SELECT k FROM maps) AS empty FROM customer")
def map_is_empty(spark, sf_dir):
    return tables.is_empty(maps(spark, sf_dir), customers(spark, sf_dir), ["k"])


@query(f"WITH {MAPS} SELECT c_custkey AS k, 'view' AS uk FROM customer WHERE c_custkey IN (SELECT k FROM maps WHERE uk = 'view')")
def map_contains(spark, sf_dir):
    asked = customers(spark, sf_dir).withColumn("uk", F.lit("view"))
    return tables.contains(maps(spark, sf_dir), asked, ["k", "uk"])


@query(f"WITH {MAPS} SELECT k, uk, uv FROM maps WHERE uk IN ('click', 'view') AND k IN (SELECT s_suppkey FROM supplier)")
def map_bulk_get(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.array(F.lit("click"), F.lit("view"))).alias("uk"))
    return tables.get_all(maps(spark, sf_dir), keys, ["k", "uk"]).select("k", "uk", "uv")


@query(f"WITH {MAPS} SELECT k, uk, uv FROM maps WHERE k NOT IN (SELECT s_suppkey FROM supplier)")
def map_bulk_remove(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return tables.remove_all(maps(spark, sf_dir), keys, ["k"]).select("k", "uk", "uv")


@query(f"WITH {MAPS} SELECT k, uk, uv FROM maps WHERE NOT (uk IN ('click', 'view') AND k IN (SELECT s_suppkey FROM supplier))")
def map_bulk_remove_entries(spark, sf_dir):
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.array(F.lit("click"), F.lit("view"))).alias("uk"))
    return tables.remove_all(maps(spark, sf_dir), asked, ["k", "uk"]).select("k", "uk", "uv")


@query(f"WITH {MAPS}, p AS (SELECT s_suppkey AS k, unnest(['view', 'new']) AS uk, s_acctbal AS uv FROM supplier) SELECT k, uk, uv FROM p UNION ALL SELECT k, uk, uv FROM maps WHERE NOT (uk IN ('view', 'new') AND k IN (SELECT s_suppkey FROM supplier))")
def map_bulk_put(spark, sf_dir):
    """Whole maps as writes; null user keys and values do nothing."""
    base = events_log(spark, sf_dir, MAP_VERBS).select("k", "uk", "op", "value", "seq")
    made = F.create_map(F.lit("view"), F.col("s_acctbal"), F.lit("new"), F.col("s_acctbal"), F.lit("none"), F.lit(None).cast("double"))
    puts = tables.entries_of_maps(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), made.alias("m")), ["k"])
    return folds.fold_map(base.unionByName(after(base, puts, ["k", "uk"]).select(*base.columns))).select("k", "uk", "uv")


@query(f"WITH {MAPS} SELECT c_custkey AS k, 'signup' AS uk, coalesce(uv, 0.0) AS uv FROM customer LEFT JOIN (SELECT * FROM maps WHERE uk = 'signup') m ON c_custkey = m.k")
def map_get_or_default(spark, sf_dir):
    asked = customers(spark, sf_dir).withColumn("uk", F.lit("signup"))
    return tables.get_or_default(maps(spark, sf_dir), asked, ["k", "uk"], "uv", 0.0)


@query("SELECT user_id AS k, event_type AS uk, arg_max(value, event_id) AS uv FROM events WHERE event_type <> 'view' AND value >= 50 GROUP BY user_id, event_type")
def map_null_writes_ignored(spark, sf_dir):
    e = events_log(spark, sf_dir, {})
    written = e.withColumn("uk", F.when(F.col("uk") != "view", F.col("uk"))).withColumn("value", F.when(F.col("value") >= 50, F.col("value")))
    return folds.fold_map(tables.put_entries(written)).select("k", "uk", "uv")


# -- namespaces ------------------------------------------------------------------------------------------------------


@query(f"WITH {EVENTS} SELECT k, ns, arg_max(value, seq) AS value FROM ev GROUP BY k, ns HAVING arg_max(vop, seq) <> 'DELETE'")
def ns_value_by_day(spark, sf_dir):
    rows = namespaces.require_namespace(events_log(spark, sf_dir, VALUE_VERBS))
    return folds.fold_value(rows, ["k", "ns"]).select("k", "ns", "value")


@query(f"WITH {EVENTS} SELECT k, ns, round(sum(value), 2) AS v FROM ev GROUP BY k, ns")
def ns_reduce_by_day(spark, sf_dir):
    return agg.accumulate(events_log(spark, sf_dir, {}), ["k", "ns"], agg.SUM).select("k", "ns", F.round("sum", 2).alias("v"))


@query(f"WITH {EVENTS} SELECT k, ns, round(avg(value), 8) AS v FROM ev GROUP BY k, ns")
def ns_aggregate_by_day(spark, sf_dir):
    done = agg.finish(agg.accumulate(events_log(spark, sf_dir, {}), ["k", "ns"], agg.AVG), ["k", "ns"], agg.AVG, "v")
    return done.withColumn("v", F.round("v", 8))


NS_LISTS = f"""{EVENTS}, nr AS (SELECT k, ns, max(seq) AS r FROM ev WHERE lop <> 'APPEND' GROUP BY k, ns),
nl AS (SELECT ev.k, ev.ns, CAST(row_number() OVER (PARTITION BY ev.k, ev.ns ORDER BY seq) - 1 AS BIGINT) AS pos, value AS e, uk, seq FROM ev LEFT JOIN nr ON ev.k = nr.k AND ev.ns = nr.ns WHERE lop <> 'DELETE' AND (r IS NULL OR seq >= r))"""


@query(f"WITH {NS_LISTS} SELECT k, ns, pos, e FROM nl")
def ns_list_by_day(spark, sf_dir):
    return folds.fold_list(events_log(spark, sf_dir, LIST_VERBS), ["k", "ns"]).select("k", "ns", "pos", "e")


#: Keys and namespaces with a purchase: what the bulk verbs ask for.
BOUGHT = "(SELECT k, ns FROM ev WHERE uk = 'purchase')"


def bought(spark, sf_dir):
    return events_log(spark, sf_dir, {}).where(F.col("uk") == "purchase").select("k", "ns").distinct()


def ns_lists(spark, sf_dir):
    return folds.fold_list(events_log(spark, sf_dir, LIST_VERBS), ["k", "ns"])


@query(f"WITH {NS_LISTS} SELECT k, ns, pos, e FROM nl WHERE (k, ns) IN {BOUGHT}")
def ns_list_bulk_get(spark, sf_dir):
    return tables.get_all(ns_lists(spark, sf_dir), bought(spark, sf_dir), ["k", "ns"]).select("k", "ns", "pos", "e")


@query(f"WITH {NS_LISTS} SELECT k, ns, pos, e FROM nl WHERE (k, ns) NOT IN {BOUGHT}")
def ns_list_bulk_remove(spark, sf_dir):
    return tables.remove_all(ns_lists(spark, sf_dir), bought(spark, sf_dir), ["k", "ns"]).select("k", "ns", "pos", "e")


@query(f"WITH {NS_LISTS} SELECT k, ns, count(*) AS n FROM nl GROUP BY k, ns")
def ns_list_size_contains(spark, sf_dir):
    return tables.sizes(ns_lists(spark, sf_dir), ["k", "ns"])


@query(f"WITH {NS_LISTS} SELECT k, ns, pos, uk AS e FROM (SELECT *, row_number() OVER (PARTITION BY k, ns, uk ORDER BY pos) AS rn FROM nl) WHERE NOT (uk = 'view' AND rn = 1)")
def ns_list_remove_first(spark, sf_dir):
    state = folds.fold_list(events_log(spark, sf_dir, LIST_VERBS).withColumn("value", F.col("uk")), ["k", "ns"])
    asked = state.select("k", "ns").distinct().withColumn("e", F.lit("view"))
    return tables.remove_first(state, asked, ["k", "ns"]).select("k", "ns", "pos", "e")


@query(f"WITH {NS_LISTS} SELECT k, ns, pos, e FROM nl WHERE (k, ns) NOT IN {BOUGHT} UNION ALL SELECT DISTINCT k, ns, 0, -1.0 FROM ev WHERE uk = 'purchase'")
def ns_list_update(spark, sf_dir):
    new = bought(spark, sf_dir).withColumn("es", F.array(F.lit(-1.0)))
    return tables.update_list(ns_lists(spark, sf_dir), new, ["k", "ns"])


NS_MAPS = f"""{EVENTS}, nc AS (SELECT k, ns, max(seq) AS c FROM ev WHERE uk = 'error' GROUP BY k, ns),
nm AS (SELECT e.* FROM (SELECT k, ns, uk, arg_max(value, seq) AS uv, max(seq) AS seq FROM ev WHERE uk <> 'error' GROUP BY k, ns, uk) e LEFT JOIN nc ON e.k = nc.k AND e.ns = nc.ns WHERE c IS NULL OR e.seq > c)"""


@query(f"WITH {NS_MAPS} SELECT k, ns, uk, uv FROM nm")
def ns_map_by_day(spark, sf_dir):
    return folds.fold_map(events_log(spark, sf_dir, MAP_VERBS), ["k", "ns"]).select("k", "ns", "uk", "uv")


def ns_maps(spark, sf_dir):
    return folds.fold_map(events_log(spark, sf_dir, MAP_VERBS), ["k", "ns"])


def two_user_keys(spark, sf_dir):
    return bought(spark, sf_dir).withColumn("uk", F.explode(F.array(F.lit("click"), F.lit("view"))))


@query(f"WITH {NS_MAPS} SELECT k, ns, uk, uv FROM nm WHERE uk IN ('click', 'view') AND (k, ns) IN {BOUGHT}")
def ns_map_bulk_get(spark, sf_dir):
    return tables.get_all(ns_maps(spark, sf_dir), two_user_keys(spark, sf_dir), ["k", "ns", "uk"]).select("k", "ns", "uk", "uv")


@query(f"WITH {NS_MAPS} SELECT DISTINCT k, ns, 'view' AS uk FROM ev WHERE uk = 'purchase' AND (k, ns) IN (SELECT k, ns FROM nm WHERE uk = 'view')")
def ns_map_contains(spark, sf_dir):
    return tables.contains(ns_maps(spark, sf_dir), bought(spark, sf_dir).withColumn("uk", F.lit("view")), ["k", "ns", "uk"])


@query(f"WITH {NS_MAPS} SELECT DISTINCT k, ns, (k, ns) NOT IN (SELECT k, ns FROM nm) AS empty FROM ev")
def ns_map_is_empty(spark, sf_dir):
    asked = events_log(spark, sf_dir, {}).select("k", "ns").distinct()
    return tables.is_empty(ns_maps(spark, sf_dir), asked, ["k", "ns"])


@query(f"WITH {NS_MAPS} SELECT k, ns, uk, uv FROM nm WHERE NOT (uk IN ('click', 'view') AND (k, ns) IN {BOUGHT})")
def ns_map_bulk_remove_entries(spark, sf_dir):
    return tables.remove_all(ns_maps(spark, sf_dir), two_user_keys(spark, sf_dir), ["k", "ns", "uk"]).select("k", "ns", "uk", "uv")


@query(f"WITH {NS_MAPS} SELECT k, ns, uk, uv FROM nm WHERE (k, ns) NOT IN {BOUGHT}")
def ns_map_bulk_remove(spark, sf_dir):
    return tables.remove_all(ns_maps(spark, sf_dir), bought(spark, sf_dir), ["k", "ns"]).select("k", "ns", "uk", "uv")


@query(f"WITH {NS_MAPS}, p AS (SELECT k, ns, unnest(['view', 'new']) AS uk, -1.0 AS uv FROM (SELECT DISTINCT k, ns FROM ev WHERE uk = 'purchase')) SELECT k, ns, uk, uv FROM p UNION ALL SELECT k, ns, uk, uv FROM nm WHERE NOT (uk IN ('view', 'new') AND (k, ns) IN {BOUGHT})")
def ns_map_bulk_put(spark, sf_dir):
    base = events_log(spark, sf_dir, MAP_VERBS).select("k", "ns", "uk", "op", "value", "seq")
    made = F.create_map(F.lit("view"), F.lit(-1.0), F.lit("new"), F.lit(-1.0))
    puts = tables.entries_of_maps(bought(spark, sf_dir).withColumn("m", made), ["k", "ns"])
    return folds.fold_map(base.unionByName(after(base, puts, ["k", "ns", "uk"]).select(*base.columns)), ["k", "ns"]).select("k", "ns", "uk", "uv")


@query(f"WITH {EVENTS}, nv AS (SELECT k, ns, arg_max(value, seq) AS value FROM ev GROUP BY k, ns HAVING arg_max(vop, seq) <> 'DELETE') SELECT k, ns, value, ns >= (SELECT max(ns) FROM ev) AS taken FROM nv")
def ns_get_and_remove(spark, sf_dir):
    rows = events_log(spark, sf_dir, VALUE_VERBS)
    state = folds.fold_value(rows, ["k", "ns"]).select("k", "ns", "value")
    taken, left = tables.take(state, F.col("ns") >= rows.agg(F.max("ns")).scalar())
    return taken.withColumn("taken", F.lit(True)).unionByName(left.withColumn("taken", F.lit(False)))


@query(f"WITH {EVENTS}, nv AS (SELECT k, ns, arg_max(value, seq) AS value FROM ev GROUP BY k, ns HAVING arg_max(vop, seq) <> 'DELETE') SELECT k, ns, value FROM nv WHERE k = (SELECT min(k) FROM ev)")
def ns_get_all_of_key(spark, sf_dir):
    rows = events_log(spark, sf_dir, VALUE_VERBS)
    state = folds.fold_value(rows.where(F.col("k") == rows.agg(F.min("k")).scalar()), ["k", "ns"])
    return state.select("k", "ns", "value")


@query(f"WITH {EVENTS}, nv AS (SELECT k, ns, arg_max(value, seq) AS value FROM ev GROUP BY k, ns HAVING arg_max(vop, seq) <> 'DELETE') SELECT k, ns, value FROM nv WHERE k NOT IN (SELECT s_suppkey FROM supplier)")
def ns_remove_all_of_key(spark, sf_dir):
    """All namespaces of the removed keys go."""
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return tables.remove_all(folds.fold_value(events_log(spark, sf_dir, VALUE_VERBS), ["k", "ns"]), keys, ["k"]).select("k", "ns", "value")


WEEK = "strftime(date_trunc('week', CAST(ns AS DATE)), '%Y-%m-%d')"


def week(ns: str = "ns"):
    return F.date_format(F.date_trunc("week", F.col(ns).cast("date")), "yyyy-MM-dd")


@query(f"WITH {EVENTS} SELECT k, {WEEK} AS target, round(sum(value), 2) AS v FROM ev GROUP BY 1, 2")
def ns_merge_reduce(spark, sf_dir):
    daily = agg.accumulate(events_log(spark, sf_dir, {}), ["k", "ns"], agg.SUM)
    return namespaces.merge_accumulators(daily, week(), agg.SUM).select("k", "target", F.round("sum", 2).alias("v"))


@query(f"WITH {EVENTS} SELECT k, {WEEK} AS target, round(avg(value), 8) AS v FROM ev GROUP BY 1, 2")
def ns_merge_aggregate(spark, sf_dir):
    daily = agg.accumulate(events_log(spark, sf_dir, {}), ["k", "ns"], agg.AVG)
    merged = namespaces.merge_accumulators(daily, week(), agg.AVG)
    return agg.finish(merged, ["k", "target"], agg.AVG, "v").withColumn("v", F.round("v", 8))


@query(f"WITH {NS_LISTS} SELECT k, {WEEK} AS target, CAST(row_number() OVER (PARTITION BY k, {WEEK} ORDER BY ns <> {WEEK}, ns, pos) - 1 AS BIGINT) AS pos, e FROM nl")
def ns_merge_list(spark, sf_dir):
    daily = folds.fold_list(events_log(spark, sf_dir, LIST_VERBS), ["k", "ns"])
    return namespaces.merge_lists(daily, week())


@query("""WITH t AS (SELECT user_id AS k, epoch_us(ts) AS ms FROM events), m AS (SELECT k, ms, CASE WHEN ms - lag(ms) OVER w < 21600000000 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY k ORDER BY ms)),
s AS (SELECT k, ms, sum(new) OVER (PARTITION BY k ORDER BY ms) AS g FROM m) SELECT k, CAST(min(ms) AS BIGINT) AS start_us, CAST(max(ms) + 21600000000 AS BIGINT) AS end_us, count(*) AS n FROM s GROUP BY k, g""")
def session_merge_counts(spark, sf_dir):
    rows = events_log(spark, sf_dir, {}).withColumn("ts", F.col("ts").cast("timestamp"))
    made = namespaces.sessions(rows, "6 hours", n=F.count("*"))
    return made.select("k", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


# -- timers ----------------------------------------------------------------------------------------------------------


def timer_rows(spark, sf_dir):
    """A timer an hour after each event, at the hour; purchases remove the timer of their hour."""
    e = events_log(spark, sf_dir, {})
    hour = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3_600_000) + 1
    op = F.when(F.col("uk") == "purchase", DELETE).otherwise(PUT)
    return timers.timer_log(e.select("k", F.col("uk").alias("ns"), hour.alias("ts"), op.alias("op"), "seq").withColumn("ns", F.lit("t")), hashed=False)


def live_timers(spark, sf_dir):
    return folds.fold_timers(timer_rows(spark, sf_dir))


TIMERS = f"""{EVENTS}, tl AS (SELECT k, 't' AS ns, CAST(epoch_us(ts) // 3600000000 + 1 AS BIGINT) AS ts, uk, seq, CAST(k % 128 AS INTEGER) AS key_group FROM ev),
timers AS (SELECT key_group, ts, k, ns FROM tl GROUP BY key_group, ts, k, ns HAVING arg_max(uk, seq) <> 'purchase')"""


@query(f"WITH {TIMERS} SELECT key_group, ts, k, ns FROM timers")
def timers_dedup(spark, sf_dir):
    return live_timers(spark, sf_dir)


@query(f"WITH {TIMERS} SELECT key_group, ts, k, ns FROM timers WHERE ts <= (SELECT min(ts) + 240 FROM tl)")
def timers_due(spark, sf_dir):
    rows = timer_rows(spark, sf_dir)
    return timers.due(folds.fold_timers(rows), rows.agg(F.min("ts") + 240).scalar())


@query(f"WITH {TIMERS}, r AS (SELECT *, row_number() OVER (PARTITION BY key_group ORDER BY ts, k, ns) AS rn FROM timers) SELECT key_group, ts, k, ns FROM r WHERE rn = 1")
def timers_head_per_group(spark, sf_dir):
    return timers.heads(live_timers(spark, sf_dir))


@query(f"WITH {TIMERS}, r AS (SELECT *, row_number() OVER (PARTITION BY key_group ORDER BY ts, k, ns) AS rn FROM timers) SELECT key_group, ts, k, ns FROM r WHERE rn > 1")
def timers_after_poll(spark, sf_dir):
    return timers.poll(live_timers(spark, sf_dir))[1].select("key_group", "ts", "k", "ns")


@query(f"WITH {TIMERS} SELECT DISTINCT key_group, ts, k, ns FROM tl EXCEPT SELECT key_group, ts, k, ns FROM timers")
def timers_removed(spark, sf_dir):
    every = timer_rows(spark, sf_dir).select("key_group", "ts", "k", "ns").distinct()
    return every.join(live_timers(spark, sf_dir), ["key_group", "ts", "k", "ns"], "left_anti")


@query(f"WITH {TIMERS} SELECT key_group, count(*) AS n FROM timers GROUP BY key_group")
def timers_size(spark, sf_dir):
    return live_timers(spark, sf_dir).groupBy("key_group").agg(F.count("*").alias("n"))
