"""Token-id files: flat unsigned integers and 64-bit document offsets, written in ascending order of document ids.

Each part is three files: ``.ids`` (uint16 or uint32, little-endian), ``.offsets`` (uint64, one more than documents) and
``.docs`` (int64 document ids). A manifest table names each part's files and what it holds; a document's place in the
whole is its part's base, the sum of the parts before, plus its own offset. A task writes files under names of its own
attempt, and only those of the attempt that Spark commits get into the manifest, so lost executors do no harm.

Cases: null and empty texts are one end id; null document ids come first; repeated ids stand next to each other; an empty
table gives files without ids.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statefold.llm.chunk_table import IdTable, cutter, hub_encoder, loaded, with_end
from statefold.llm.common import materialize, new_shared_path, text_slices

END_ID = 1
MANIFEST = "part int, name string, n_null bigint, n_docs bigint, n_ids bigint, width int"


def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    url = urlparse(path)
    return (pyarrow.fs.LocalFileSystem(), url.path) if url.scheme in ("", "file") else pyarrow.fs.FileSystem.from_uri(path)


def view(path: str, kind: str) -> np.ndarray:
    """A file's numbers: mapped into memory where the store is a mounted folder, read otherwise."""
    fs, at = store(path)
    if fs.get_file_info(at).size == 0:
        return np.zeros(0, kind)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(at, kind, "r")
    with fs.open_input_stream(at) as f:
        return np.frombuffer(f.read(), kind)


@dataclass
class PartWriter:
    """Streams of the three files of one part."""

    folder: str
    width: int

    def __post_init__(self):
        fs, at = store(self.folder)
        fs.create_dir(at, recursive=True)
        self.name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        self.files = {k: fs.open_output_stream(f"{at}/{self.name}.{k}") for k in ("ids", "offsets", "docs")}
        self.docs = self.ids = self.null = 0
        self.files["offsets"].write(np.zeros(1, "<u8").tobytes())

    def add(self, doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> None:
        self.files["ids"].write(np.ascontiguousarray(ids, f"<u{self.width}").tobytes())
        self.files["offsets"].write((bounds[1:] + self.ids).astype("<u8").tobytes())
        self.files["docs"].write(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        self.null, self.docs, self.ids = self.null + doc_ids.null_count, self.docs + len(doc_ids), self.ids + int(bounds[-1])

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = END_ID) -> DataFrame:
    """Writes the files of ``docs`` to ``folder``; returns the manifest with each part's ``base`` and ``base_docs``."""

    def run(batches):
        table, cuts = IdTable(hub_encoder(tokenizer)), cutter(tokenizer)
        width = 2 if max(loaded(tokenizer)[0].get_vocab_size() - 1, end) < 1 << 16 else 4
        out = PartWriter(folder, width)
        for part, data, offsets in text_slices(batches):
            out.add(part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()), *with_end(*table.ids(data, offsets, cuts(data, offsets)), end))
        out.close()
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "name": out.name, "n_null": out.null, "n_docs": out.docs, "n_ids": out.ids, "width": width}], pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_null", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())]))

    # Texts are dealt in ranges of doc_id; the input partition splits the rows of an id that has very many.
    dealt = docs.select("doc_id", "text").withColumn("_from", F.spark_partition_id()).repartitionByRange(F.col("doc_id").asc_nulls_first(), "_from")
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_from").drop("_from")
    manifest = materialize(ordered.mapInArrow(run, MANIFEST), "manifest")
    rows = manifest.orderBy("part").collect()  # a row a partition
    base = np.cumsum([0, *[r["n_ids"] for r in rows]]).tolist()
    return manifest.sparkSession.createDataFrame([(*r, b) for r, b in zip(rows, base, strict=False)], MANIFEST + ", base bigint")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    parts = max(1, manifest.count())

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, offsets, docs = (view(f"{folder}/{r['name']}.{k}", kind) for k, kind in (("ids", f"<u{r['width']}"), ("offsets", "<u8"), ("docs", "<i8")))
                for at in range(0, r["n_docs"], 20_000):
                    own = np.asarray(offsets[at : at + 20_001]).astype(np.int64)
                    crc = [zlib.crc32(ids[a:z].astype("<u4")) for a, z in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                    doc = pa.array(np.array(docs[at : at + 20_000]), mask=np.arange(at, at + len(own) - 1) < r["n_null"])
                    yield pa.RecordBatch.from_arrays([doc, pa.array(own[:-1] + r["base"]), pa.array(np.diff(own)), pa.array(np.array(crc, np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(parts, "part").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The round trip through files in the shared folder."""
    folder = new_shared_path(docs.sparkSession, "token-files")
    return read(write(docs, tokenizer, folder), folder)
