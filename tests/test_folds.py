"""Folds against the replay, and the edge semantics of lists, maps, timers and accumulators."""

import pytest
from model import random_log, replay_list, replay_map, replay_timers, replay_value
from pyspark.sql import functions as F

from statefold.functions import aggregates as agg
from statefold.functions.columns import group_range, key_group
from statefold.operators import folds, maintenance, namespaces, tables, timers
from statefold.sources.changelog import after

SCHEMA = "k string, ns string, uk string, op string, value double, seq bigint"
VALUE_MIX, LIST_MIX, MAP_MIX = {"PUT": 0.9, "DELETE": 0.1}, {"PUT": 0.1, "APPEND": 0.8, "DELETE": 0.1}, {"PUT": 0.85, "DELETE": 0.1, "CLEAR": 0.05}


def frame(spark, log):
    return spark.createDataFrame([tuple(r[c] for c in ("k", "ns", "uk", "op", "value", "seq")) for r in log], SCHEMA)


def as_lists(df, keys=("k",)):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.pos):
        out.setdefault(tuple(r[k] for k in keys), []).append(r.e)
        assert r.pos == len(out[tuple(r[k] for k in keys)]) - 1
    return {k[0] if len(k) == 1 else k: v for k, v in out.items()}


def as_maps(df, keys=("k",)):
    out = {}
    for r in df.collect():
        out.setdefault(r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys), {})[r.uk] = r.uv
    return out


@pytest.mark.parametrize("seed", [24, 25])
def test_folds_equal_the_replay(spark, seed):
    log = random_log(seed, VALUE_MIX)
    assert {r.k: r.value for r in folds.fold_value(frame(spark, log)).collect()} == replay_value(log)
    log = random_log(seed, LIST_MIX)
    assert as_lists(folds.fold_list(frame(spark, log))) == replay_list(log)
    assert as_lists(folds.fold_list(frame(spark, log), ["k", "ns"]), ("k", "ns")) == replay_list(log, lambda r: (r["k"], r["ns"]))
    log = random_log(seed, MAP_MIX)
    assert as_maps(folds.fold_map(frame(spark, log))) == replay_map(log)
    assert as_maps(folds.fold_map(frame(spark, log), ["k", "ns"]), ("k", "ns")) == replay_map(log, lambda r: (r["k"], r["ns"]))


def test_positions_don_t_depend_on_buckets(spark):
    log = random_log(3, {"APPEND": 1.0}, 2000, 3)
    rows = folds.list_rows(frame(spark, log))
    got = [{(r.k, r.seq): r.pos for r in folds.positions(rows, ["k"], bucket=b).collect()} for b in (7, 1 << 16)]
    assert got[0] == got[1]
    log = random_log(4, LIST_MIX | {"DELETE": 0.01, "PUT": 0.01}, 2000, 3)
    for b in (1, 7, 64, 1 << 16):
        assert as_lists(folds.fold_list(frame(spark, log), bucket=b)) == replay_list(log)


def test_lists_of_several_elements_a_write(spark):
    rows = [("a", "APPEND", [1.0, 2.0], 1), ("a", "APPEND", None, 2), ("a", "APPEND", [], 8), ("a", "APPEND", [3.0], 9), ("b", "APPEND", [4.0], 1), ("b", "PUT", [5.0, 6.0], 3), ("b", "APPEND", [7.0], 4), ("c", "PUT", [8.0], 2), ("c", "DELETE", None, 7)]
    log = spark.createDataFrame(rows, "k string, op string, value array<double>, seq bigint")
    for b in (1, 3, 1 << 16):
        assert as_lists(folds.fold_list(log, bucket=b)) == {"a": [1.0, 2.0, 3.0], "b": [5.0, 6.0, 7.0]}


def test_timers_are_a_set(spark):
    log = [{"k": i % 5, "ts": i % 7, "op": "DELETE" if i % 4 == 0 else "PUT", "seq": i * 13 % 101} for i in range(100)]
    rows = spark.createDataFrame([(r["k"], r["ts"], "n", r["op"], r["seq"]) for r in log], "k bigint, ts bigint, ns string, op string, seq bigint")
    live = folds.fold_timers(timers.timer_log(rows))
    assert {(r.ts, r.k) for r in live.collect()} == replay_timers(log)
    heads, rest = timers.poll(live)
    assert heads.count() + rest.count() == live.count()
    assert {(r.key_group, r.ts, r.k) for r in heads.collect()} == {min((x.key_group, x.ts, x.k) for x in live.collect() if x.key_group == g) for g in {x.key_group for x in live.collect()}}


@pytest.mark.parametrize("ops,want", [
    ([("APPEND", 1), ("DELETE", 0), ("APPEND", 2)], [2.0]),  # a deleted list begins anew
    ([("APPEND", 1), ("PUT", 2), ("APPEND", 3)], [2.0, 3.0]),  # a put discards earlier appends
    ([("APPEND", 1), ("DELETE", 0)], None),
    ([("DELETE", 0)], None),
])
def test_list_verbs(spark, ops, want):
    log = [{"k": "a", "ns": "n", "uk": None, "op": op, "value": float(v), "seq": i} for i, (op, v) in enumerate(ops)]
    assert as_lists(folds.fold_list(frame(spark, log))).get("a") == want


def test_removals_of_elements(spark):
    log = [{"k": "a", "ns": "", "uk": None, "op": "APPEND", "value": v, "seq": i} for i, v in enumerate([1.0, 2.0, 1.0, 3.0])] + [{"k": "b", "ns": "", "uk": None, "op": "APPEND", "value": 1.0, "seq": 9}]
    state = folds.fold_list(frame(spark, log))
    asked = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0), ("c", 1.0)], "k string, e double")
    first = {(r.k, r.pos, r.e) for r in tables.remove_first(state, asked, ["k"]).select("k", "pos", "e").collect()}
    assert first == {("a", 1, 2.0), ("a", 2, 1.0), ("a", 3, 3.0)}  # b is left empty and is gone
    every = {(r.k, r.e) for r in tables.remove_every(state, asked, ["k"]).collect()}
    assert every == {("a", 2.0), ("a", 3.0)}


def test_updates_of_whole_lists(spark):
    state = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 1.0), ("c", 0, 1.0)], "k string, pos bigint, e double")
    new = spark.createDataFrame([("a", []), ("b", None), ("c", [5.0, 6.0])], "k string, es array<double>")
    assert {(r.k, r.pos, r.e) for r in tables.update_list(state, new, ["k"]).collect()} == {("b", 0, 1.0), ("c", 0, 5.0), ("c", 1, 6.0)}


def test_a_map_emptied_by_removals_is_gone(spark):
    log = [{"k": "a", "ns": "", "uk": "x", "op": op, "value": 1.0, "seq": i} for i, op in enumerate(["PUT", "DELETE"])]
    state = folds.fold_map(frame(spark, log))
    assert tables.keys_of(state).count() == 0 and tables.whole_maps(state, ["k"]).count() == 0
    asked = spark.createDataFrame([("a",)], "k string")
    assert tables.is_empty(state, asked, ["k"]).first().empty
    with pytest.raises(NotImplementedError):
        tables.replace_map(state)


def test_bulk_calls_skip_nulls_and_leave_out_missing_keys(spark):
    state = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, value double")
    asked = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "k string")
    assert [tuple(r) for r in tables.get_all(state, asked, ["k"]).collect()] == [("a", 1.0)]
    assert {r.k: r.value for r in tables.get_or_default(state, asked, ["k"], "value", 0.0).collect()} == {"a": 1.0, None: 0.0, "z": 0.0}


def test_accumulators_ignore_nulls_and_merge(spark):
    rows = spark.createDataFrame([("a", "1", 1.0, 1), ("a", "1", None, 2), ("a", "2", 4.0, 3), ("b", "1", None, 4)], "k string, ns string, value double, seq bigint")
    ready = (agg.SUM, agg.COUNT, agg.MIN, agg.MAX, agg.AVG, agg.FIRST, agg.LAST)
    whole = [agg.finish(agg.accumulate(rows, ["k"], a), ["k"], a).collect() for a in ready]
    assert [r[0].result for r in whole] == [5.0, 2, 1.0, 4.0, 2.5, 1.0, 4.0] and all(len(r) == 1 for r in whole)
    for a, r in zip(ready, whole):
        merged = namespaces.merge_accumulators(agg.accumulate(rows, ["k", "ns"], a), F.lit("t"), a)
        assert agg.finish(merged, ["k", "target"], a).first().result == r[0].result
    with pytest.raises(NotImplementedError):
        namespaces.without_namespace()


def test_lists_merge_behind_the_target_s_own(spark):
    rows = [("a", "1", 0, 10.0), ("a", "2", 0, 20.0), ("a", "2", 1, 21.0), ("a", "3", 0, 30.0)]
    state = spark.createDataFrame(rows, "k string, ns string, pos bigint, e double")
    assert as_lists(namespaces.merge_lists(state, F.lit("2")), ("k", "target")) == {("a", "2"): [20.0, 21.0, 10.0, 30.0]}
    assert as_lists(namespaces.merge_lists(state, F.lit("9")), ("k", "target")) == {("a", "9"): [10.0, 20.0, 21.0, 30.0]}


def test_a_null_namespace_is_an_error(spark):
    rows = spark.createDataFrame([("a", None)], "k string, ns string")
    with pytest.raises(Exception, match="must not be null"):
        namespaces.require_namespace(rows).collect()


def test_reducing_in_order_needs_no_commutativity(spark):
    rows = spark.createDataFrame([("a", c, i) for i, c in enumerate("fold in order")] + [("a", None, 99)], "k string, value string, seq bigint").repartition(4)
    assert [r.acc for r in folds.reduce_in_order(rows, ["k"], lambda a, b: F.concat(a, b), bucket=4).collect()] == ["fold in order"]


def test_key_groups_cover_without_overlap(spark):
    for parts in (1, 2, 3, 7, 128):
        ranges = [group_range(i, parts) for i in range(parts)]
        assert [g for a, b in ranges for g in range(a, b + 1)] == list(range(128))
    groups = spark.range(1000).select(key_group(F.col("id")).alias("g")).distinct().collect()
    assert {r.g for r in groups} <= set(range(128)) and len(groups) > 100


@pytest.mark.parametrize("kind", ["value", "list", "map"])
def test_compaction_changes_nothing(spark, kind):
    mix, fold, compact = {"value": (VALUE_MIX, folds.fold_value, maintenance.compact_values), "list": (LIST_MIX, folds.fold_list, maintenance.compact_lists), "map": (MAP_MIX, folds.fold_map, maintenance.compact_maps)}[kind]
    log = frame(spark, random_log(7, mix, 3000)).select("k", "uk", "op", "value", "seq")
    low = compact(log.where("seq < 3000"), major=False)
    if kind != "map":
        low = low.withColumn("uk", F.lit(None).cast("string"))
    both = fold(low.select(*log.columns).unionByName(log.where("seq >= 3000")))
    want = fold(log)
    columns = [c for c in want.columns if c != "uk" or kind == "map"]
    assert sorted(map(str, both.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    assert compact(log, major=True).where(F.col("op").isin("DELETE", "CLEAR")).count() == 0


def test_later_writes_get_later_numbers(spark):
    log = frame(spark, random_log(1, VALUE_MIX, 100))
    more = after(log, spark.createDataFrame([(f"x{i}",) for i in range(50)], "k string"), ["k"])
    assert more.agg(F.min("seq")).first()[0] > log.agg(F.max("seq")).first()[0]
    assert [r.k for r in more.orderBy("seq").collect()] == sorted(f"x{i}" for i in range(50))


def test_folds_shuffle_partial_aggregates(spark, small):
    from statefold.plans.state_queries import values

    plan = values(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan and "partial_max_by" in plan and "Python" not in plan
