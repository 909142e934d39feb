"""Snapshots, restores, expiry, streams."""

import pytest
from model import random_log, replay_map, replay_value
from pyspark.sql import functions as F
from test_folds import MAP_MIX, SCHEMA, VALUE_MIX, as_maps, frame

from statefold.functions.columns import group_range, live
from statefold.operators import folds, maintenance, tables
from statefold.sources import snapshots
from statefold.streaming import processors, runs


def test_incremental_snapshots_restore_the_whole_log(spark, tmp_path):
    root, log = str(tmp_path), random_log(5, MAP_MIX, 3000)
    rows = frame(spark, log)
    for i, top in enumerate((1500, 3000, 7000)):
        made = snapshots.write(rows.where(F.col("seq") < top), root, str(i), "incremental" if i else "full", str(i - 1) if i else None)
    assert made["kind"] == "incremental" and made["max_seq"] == max(r["seq"] for r in log)
    back, seq = snapshots.restore(spark, root, ["2"], SCHEMA)
    assert seq == made["max_seq"] + 1 and as_maps(folds.fold_map(back)) == replay_map(log)
    files = snapshots.new_files(spark, root, "2").first()
    assert files.reused > 0 and files.files > 0
    assert snapshots.drop_unused(spark, root, ["0", "1", "2"], ["1"]) == ["2"]
    assert as_maps(folds.fold_map(snapshots.restore(spark, root, ["1"], SCHEMA)[0])) == replay_map([r for r in log if r["seq"] < 3000])


def test_a_pending_snapshot_is_no_parent(spark, tmp_path):
    rows = frame(spark, random_log(5, VALUE_MIX, 50))
    rows.write.parquet(f"{tmp_path}/snap-p/data")
    with pytest.raises(ValueError, match="not complete"):
        snapshots.write(rows, str(tmp_path), "q", "incremental", "p")


@pytest.mark.parametrize("parts", [2, 3])
def test_rescaling_out_and_in(spark, tmp_path, parts):
    root, log = str(tmp_path), random_log(6, VALUE_MIX, 2000)
    rows = frame(spark, log)
    snapshots.write(rows, root, "one")
    split = snapshots.rescale_out(spark, root, "one", SCHEMA, parts)
    found = [{r.k: r.value for r in folds.fold_value(p).collect()} for p in split]
    assert sum(map(len, found)) == len(replay_value(log)) and {k: v for f in found for k, v in f.items()} == replay_value(log)
    for i in range(parts):
        snapshots.write(rows, root, f"part{i}", owned=group_range(i, parts))
    whole, seq = snapshots.restore(spark, root, [f"part{i}" for i in range(parts)], SCHEMA)
    assert {r.k: r.value for r in folds.fold_value(whole).collect()} == replay_value(log) and seq == max(r["seq"] for r in log) + 1


def test_reading_some_key_groups_prunes_partitions(spark, tmp_path):
    snapshots.write(frame(spark, random_log(6, VALUE_MIX, 500)), str(tmp_path), "s")
    plan = snapshots.restore(spark, str(tmp_path), ["s"], SCHEMA, (0, 31))[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key_group" in plan


def test_expiry_at_the_boundary(spark):
    now, ttl = 10_000, 5_000
    rows = spark.createDataFrame([(4_999,), (5_000,), (5_001,)], "ms bigint")
    assert [r.ms for r in rows.where(live(F.col("ms"), ttl, F.lit(now))).collect()] == [5_001]
    assert rows.where(live(F.col("ms"), 0, F.lit(now))).count() == 3


def test_an_expired_write_hides_older_ones(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', 'PUT', 1.0D, 2L, timestamp_millis(1000)), ('a', 'PUT', 2.0D, 1L, timestamp_millis(9000)) AS t(k, op, value, seq, ts)")
    assert maintenance.value_with_ttl(rows, 5_000, F.lit(10_000)).count() == 0


def test_values_out_of_line(spark):
    rows = spark.createDataFrame([(1, "x" * 300), (2, "y"), (3, None)], "seq bigint, value string")
    inline, blobs = maintenance.separate(rows)
    assert blobs.count() == 1 and {r.seq: r.value for r in maintenance.resolve(inline, blobs).collect()} == {1: "x" * 300, 2: "y", 3: None}
    assert maintenance.collect_garbage(blobs, inline.where("seq <> 1")).count() == 0


def log_of(spark, rows):
    return spark.createDataFrame(rows, "k bigint, uk string, op string, value double, seq bigint")


def test_streamed_state_goes_on_between_batches(spark):
    rows = [(i % 3, f"u{i % 4}", ("PUT", "APPEND", "DELETE", "APPEND")[i % 4] if i % 3 else "APPEND", float(i), i) for i in range(40)]
    log = log_of(spark, rows).repartition(3)  # rows of a batch come in any order
    done = runs.run(log, lambda stream: runs.process(stream, processors.ListProcessor()), "t-list")
    assert done.batches == 3
    got = folds.positions(processors.elements_of(done.state("elements")), ["k"])
    want = folds.fold_list(log).select("k", "pos", "e")
    assert sorted(map(tuple, got.select("k", "pos", "e").collect())) == sorted(map(tuple, want.collect()))
    appended = done.written.where("op = 'APPEND'").count()
    assert appended <= 40  # what changed, not whole lists again and again


def handed_over(spark, processor, rows, initial):
    rest = runs.Run(spark, "t-rest", rows.schema)
    rows.write.parquet(rest.source)
    rest.resume(lambda stream: runs.process(stream, processor, initial=initial))
    return rest


def test_state_is_read_from_a_checkpoint_and_handed_over(spark):
    first = runs.run(log_of(spark, [(1, "u", "PUT", 2.0, 1), (2, "u", "PUT", 3.0, 2)]), lambda s: runs.process(s, processors.ReduceProcessor()), "t-first", parts=1)
    old = first.state("acc").select(F.col("key.k").alias("k"), F.col("value.total").alias("total"), F.col("value.n").alias("n"))
    assert {(r.k, r.total, r.n) for r in old.collect()} == {(1, 2.0, 1), (2, 3.0, 1)}
    rest = handed_over(spark, processors.ReduceProcessor(), log_of(spark, [(1, "u", "PUT", 5.0, 3)]), old)
    assert {(r.k, r.total, r.n) for r in rest.written.collect()} == {(1, 7.0, 2)}


def test_lists_are_handed_over(spark):
    old = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 3, 3.0)], "k bigint, seq bigint, e double")
    rest = handed_over(spark, processors.ListProcessor(), log_of(spark, [(1, None, "APPEND", 5.0, 10), (2, None, "DELETE", None, 11)]), old)
    got = folds.positions(processors.elements_of(rest.state("elements")), ["k"]).select("k", "pos", "e").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1.0), (1, 1, 2.0), (1, 2, 5.0)]


def test_an_uncompleted_snapshot_is_aborted(spark, tmp_path):
    rows, root = frame(spark, random_log(5, VALUE_MIX, 50)), str(tmp_path)
    rows.write.parquet(f"{root}/snap-p/data")
    snapshots.abort(spark, root, "p")
    assert not (tmp_path / "snap-p").exists()
    snapshots.write(rows, root, "q")
    with pytest.raises(ValueError, match="complete"):
        snapshots.abort(spark, root, "q")


def test_one_of_several_states_is_a_pruned_read(spark, tmp_path):
    rows = frame(spark, random_log(6, VALUE_MIX, 200)).select("k", "value", "seq")
    snapshots.write(snapshots.named(a=rows, b=rows.withColumn("uk", F.lit("x"))), str(tmp_path), "s", "savepoint")
    back, _ = snapshots.restore(spark, str(tmp_path), ["s"], "state_name string, k bigint, uk string, value double, seq bigint")
    one = back.where("state_name = 'b'")
    assert one.count() == rows.count() and one.where("uk is null").count() == 0
    assert "PartitionFilters: [isnotnull(state_name" in one._jdf.queryExecution().executedPlan().toString()


def test_a_put_list_must_not_hold_nulls(spark):
    rows = spark.createDataFrame([(1, [1.0, None], 1)], "k bigint, value array<double>, seq bigint")
    with pytest.raises(Exception, match="must not hold nulls"):
        tables.put_lists(rows).collect()
    none = spark.createDataFrame([(1, [], 1), (2, None, 2)], "k bigint, value array<double>, seq bigint")
    assert tables.put_lists(none).count() == 0
