"""Packing by minimum bin slack.

Documents become ids, end with an end id and are cut into pieces of a window at most. What counts for packing is how many
pieces there are of each length: a bitset subset-sum programme over these counts picks the multiset of lengths that fills
a window closest to its capacity, as often as the counts allow, until none are left. Pieces find their window by their rank
among the pieces of their length; ranks come from prefix sums over partitions.

Cases: null and empty texts are one end id; repeated rows and null ids are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statefold.llm.chunk_table import IdTable, cutter, hub_encoder, with_end
from statefold.llm.common import materialize, text_slices

WINDOW, END_ID = 2048, 1


@dataclass(frozen=True)
class Plan:
    """Parts sorted by (length, first rank): ``each`` pieces of the length go to every one of the sequences from ``sequence`` on, at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def fill(left: dict[int, int], target: int) -> dict[int, int]:
    """The multiset of lengths, within the counts ``left``, whose sum is closest to ``target`` from below."""
    mask, bits, trail = (1 << (target + 1)) - 1, 1, []
    for length in sorted((x for x in left if x <= target), reverse=True):
        count, step = min(left[length], target // length), 1
        while count > 0 and not bits >> target & 1:
            step = min(step, count)
            grown = (bits | bits << (length * step)) & mask
            if grown != bits:
                trail.append((length, step, bits))
                bits = grown
            count, step = count - step, step * 2
    at, used = bits.bit_length() - 1, {}
    for length, step, before in reversed(trail):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + step
            at -= length * step
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """Patterns for all pieces; at most a few for each length, whatever the number of pieces."""
    left = {k: v for k, v in counts.items() if v > 0}
    taken, sequence, parts = dict.fromkeys(left, 0), 0, []
    while left:
        largest = max(left)
        rest = {k: v - (k == largest) for k, v in left.items() if v > (k == largest)}
        pattern = fill(rest, window - largest)
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        offset = 0
        for k, n in sorted(pattern.items(), reverse=True):
            parts.append((k, taken[k], n, sequence, offset))
            taken[k] += n * times
            left[k] -= n * times
            offset += k * n
            if not left[k]:
                del left[k]
        sequence += times
    columns = np.array(sorted(parts), np.int64).reshape(len(parts), 5).T
    return Plan(*columns)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END_ID) -> DataFrame:
    """One row for each piece of each document, with its rank among the task's pieces of that length."""
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, task_rank bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        table, cuts, seen, task = IdTable(hub_encoder(tokenizer)), cutter(tokenizer), np.zeros(window + 1, np.int64), TaskContext.get().partitionId()
        for part, data, offsets in text_slices(batches):
            ids, at = with_end(*table.ids(data, offsets, cuts(data, offsets)), end)
            ids = ids.astype("<u4")
            size = np.diff(at)
            n = -(-size // window)
            row = np.repeat(np.arange(len(size)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * window
            length = np.minimum(window, size[row] - start)
            begin = at[row] + start
            crc = [zlib.crc32(ids[b : b + k]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=window + 1)
            doc = part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([doc, *map(pa.array, (start, length, np.array(crc, np.int64), size[row], np.full(len(row), task, np.int32), rank))], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    cut = materialize(pieces(docs, tokenizer, window, end), "pieces")
    by_task = materialize(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    totals = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    shared = docs.sparkSession.sparkContext.broadcast(plan(totals, window))  # grows with the window, not the input

    def place(batches):
        p = shared.value
        key = p.length << 44 | p.first
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(key, length << 44 | rank, "right") - 1
            turn, slot = np.divmod(rank - p.first[i], p.each[i]) if len(rank) else (rank, rank)
            kept = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p.sequence[i] + turn), pa.array(p.offset[i] + slot * length)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # A base for each task and length grows with the input: it is never broadcast.
    ranked = cut.join(bases.hint("merge"), ["task", "length"]).withColumn("rank", F.col("task_rank") + F.col("base")).drop("task", "task_rank", "base")
    return ranked.mapInArrow(place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
