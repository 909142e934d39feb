"""Fresh folders for tables and checkpoints that a query writes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in spark.checkpoint.dir, which all executors share; where that is unset, in a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="statefold-state-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    path = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
