"""Snapshots as Parquet with a manifest: full, incremental, savepoint; restore, rescale, retention.

A snapshot is a folder ``snap-<id>`` with data and, written last, a manifest; without a manifest it is pending and can't
be a parent or be restored. An incremental snapshot holds the log rows after its parent's and names its ancestors. Data
are partitioned by key group, and by state_name where there are several states, so reading some key groups or one state
is a partition-pruned read. Rows are dealt in ranges of (key group, key, seq), so a large group or key is many tasks.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statefold.functions.columns import MAX_PARALLELISM, group_range, key_group

#: Columns of a manifest.
MANIFEST = "id string, parent string, kind string, max_parallelism int, first_group int, last_group int, max_seq bigint, ancestors string"


def folder(root: str, snap: str) -> str:
    return f"{root.rstrip('/')}/snap-{snap}"


def manifest(spark: SparkSession, root: str, snap: str) -> dict:
    return spark.read.schema(MANIFEST).json(f"{folder(root, snap)}/manifest").first().asDict()


def complete(spark: SparkSession, root: str, snap: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(root, snap)}/manifest/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write(log: DataFrame, root: str, snap: str, kind: str = "full", parent: str | None = None, groups: int = MAX_PARALLELISM, hashed: bool = True, owned: tuple[int, int] | None = None) -> dict:
    """Writes a changelog ("full", "incremental") or folded state ("savepoint") and completes the snapshot.

    An incremental snapshot takes the rows after its parent's last seq; the parent must be complete.
    """
    spark = log.sparkSession
    ancestors: list[str] = []
    rows = log
    if kind == "incremental":
        if parent is None or not complete(spark, root, parent):
            raise ValueError(f"the parent snapshot {parent} is not complete")
        above = manifest(spark, root, parent)
        ancestors = [*json.loads(above["ancestors"]), parent]
        rows = log.where(F.col("seq") > above["max_seq"])
    placed = rows.withColumn("key_group", key_group(F.col("k"), groups, hashed))
    if owned:
        placed = placed.where(F.col("key_group").between(*owned))
    data = f"{folder(root, snap)}/data"
    by = [c for c in ("state_name",) if c in placed.columns]
    placed.repartitionByRange(*by, "key_group", "k", "seq").sortWithinPartitions(*by, "key_group", "k", "seq").write.partitionBy(*by, "key_group").parquet(data)
    last = log.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    first_group, last_group = owned or (0, groups - 1)
    made = (snap, parent, kind, groups, first_group, last_group, last, json.dumps(ancestors))
    spark.createDataFrame([made], MANIFEST).coalesce(1).write.json(f"{folder(root, snap)}/manifest")
    return manifest(spark, root, snap)


def named(**states: DataFrame) -> DataFrame:
    """Several states, each under its name, as rows of one snapshot; columns that a state lacks are null."""
    parts = [rows.withColumn("state_name", F.lit(name)) for name, rows in states.items()]
    out = parts[0]
    for rows in parts[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def abort(spark: SparkSession, root: str, snap: str) -> None:
    """Deletes what a snapshot that was not completed has written; a complete one can't be aborted."""
    if complete(spark, root, snap):
        raise ValueError(f"the snapshot {snap} is complete")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(root, snap))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def restore(spark: SparkSession, root: str, snaps: list[str], schema, owned: tuple[int, int] | None = None) -> tuple[DataFrame, int]:
    """(rows of the snapshots and their ancestors within the owned key groups, seq to go on from).

    Several snapshots with disjoint key groups make one (scaling in); one snapshot read with several ranges makes several
    (scaling out). New writes get numbers above all of them.
    """
    wanted, top = [], -1
    for s in snaps:
        m = manifest(spark, root, s)
        top = max(top, m["max_seq"])
        wanted += [x for x in [*json.loads(m["ancestors"]), s] if x not in wanted]
    parts = [spark.read.schema(f"{schema}, key_group int").parquet(f"{folder(root, s)}/data") for s in wanted]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if owned:
        rows = rows.where(F.col("key_group").between(*owned))
    return rows.drop("key_group"), top + 1


def rescale_out(spark: SparkSession, root: str, snap: str, schema, parts: int, groups: int = MAX_PARALLELISM) -> list[DataFrame]:
    """The snapshot's rows as ``parts`` frames by ranges of key groups."""
    return [restore(spark, root, [snap], schema, group_range(i, parts, groups))[0] for i in range(parts)]


def new_files(spark: SparkSession, root: str, snap: str) -> DataFrame:
    """id, files, reused: how many data files the snapshot wrote and how many it uses of its ancestors."""
    m = manifest(spark, root, snap)
    count = lambda s: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{folder(root, s)}/data").select("path").count()
    return spark.createDataFrame([(snap, count(snap), sum(count(s) for s in json.loads(m["ancestors"])))], "id string, files bigint, reused bigint")


def drop_unused(spark: SparkSession, root: str, snaps: list[str], kept: list[str]) -> list[str]:
    """Deletes the snapshots that neither are in ``kept`` nor are ancestors of one that is; returns their ids."""
    used = set(kept)
    for s in kept:
        used |= set(json.loads(manifest(spark, root, s)["ancestors"]))
    gone = [s for s in snaps if s not in used]
    for s in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder(root, s))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
