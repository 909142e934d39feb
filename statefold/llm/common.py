"""Shared pieces: reading tables, hold-out folds, written intermediate tables, Arrow text views."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker turns into arrays at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, buckets: int, fold: int) -> Column:
    """True for rows of the hold-out fold; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % buckets == fold, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or, on a local master, one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="statefold-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


def new_shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, deleted when the application's file system closes."""
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts the lineage, outlives executors."""
    path = new_shared_path(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_labels(labels: DataFrame, target: str, bound: int) -> DataFrame:
    """(doc_id, y) for at most ``bound`` labelled documents outside fold 0 of 5, chosen by a hash of the id.

    Repeated labels of a document count once, with the larger value; null ids and null labels are left out.
    """
    kept = labels.where(~held_out(F.col("doc_id"), 5, 0) & F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    one = kept.groupBy("doc_id").agg(F.max(F.col(target)).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def labelled_documents(docs: DataFrame, labels: DataFrame, target: str, bound: int) -> DataFrame:
    """(doc_id, text, y) of the sampled labelled documents; the broadcast side has at most ``bound`` narrow rows."""
    return docs.select("doc_id", "text").join(F.broadcast(bounded_labels(labels, target, bound)), "doc_id")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into runs of rows with about ``most`` text bytes: (rows, UTF-8 bytes, row offsets from 0); null text is empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        if not n:
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def strings_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings data[starts[i]:ends[i]], packed into one Arrow array."""
    lengths = ends - starts
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    if len(starts) and (starts[1:] == ends[:-1]).all():
        packed = data[starts[0] : ends[-1]]
    else:
        packed = data[ragged(starts, lengths)]
    return pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(packed))])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] … starts[i]+lengths[i]-1 for all i, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def coded(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each string, the distinct strings)."""
    made = strings.dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False), made.dictionary


#: Bytes that separate words: space and tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of non-blank bytes; runs never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~BLANK[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(word & (first | np.concatenate(([True], ~word[:-1]))))
    last = np.concatenate((first[1:], [True]))
    ends = np.flatnonzero(word & (last | np.concatenate((~word[1:], [True])))) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights, n)


def out_batch(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f in schema], schema=schema)


def map_texts(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict[str, object]]], schema: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds columns computed from texts, slice by slice. ``make`` runs once a task; the function it returns gets a slice and returns the new columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    full = StructType([f for f in rows.schema.fields if f.name in keep] + list(_parse_datatype_string(schema).fields))
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part, data, offsets in text_slices(batches):
            made = {k: part.column(part.schema.get_field_index(k)) for k in keep} | work(part, data, offsets)
            yield out_batch(arrow, made)

    return rows.mapInArrow(run, full)


def scored_texts(docs: DataFrame, scorer: Callable, threshold: float) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on); ``scorer`` makes a task's function from a slice to scores."""

    def make():
        score = scorer()

        def work(part, data, offsets):
            p = score(data, offsets)
            return {"score": p, "predicted": (p >= threshold).astype(np.int32)}

        return work

    return map_texts(docs, make, "score double, predicted int")


def kept_texts(docs: DataFrame, scorer: Callable, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose score ``keep`` accepts, with all their columns and nothing else."""

    def make():
        score = scorer()
        return lambda part, data, offsets: {"_kept": keep(score(data, offsets))}

    return map_texts(docs, make, "_kept boolean", tuple(docs.columns)).where("_kept").drop("_kept")
