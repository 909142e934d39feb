"""Exact top-k search by inner product with MaxScore.

A query's terms are the components of its vector; a component's postings are the candidates' values in it. In a shard, each
term has a score bound: the most it can add above the least. Terms are ordered by their bounds. The non-essential ones are
the longest run of smallest bounds which, on top of the least of all other terms, stay below the query's k-th score so far;
the others are essential, and their postings are traversed for all candidates. The non-essential ones are probed, largest
bounds first, only for candidates that are still competitive. Where all terms are non-essential the shard is left out. As
the k-th score rises, fewer terms are essential. Each task merges its shards, and Spark merges the tasks.

Cases: vectors that are null or hold nulls or non-finite components take no part, nor do rows with a null id; vectors of
other lengths count as padded with zeros; a candidate with the query's id is the query's own row; rows with one id twice
are two candidates; ties go to the smaller id; other columns are not looked at; an empty table gives no rows. Sums are exact:
in doubles while they fit 53 bits, in 64-bit integers otherwise; components whose scores might not fit these are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statefold.llm.common import materialize

#: Vectors of a shard of candidates, and of a block of queries (about; 64 components make 32 MB).
SHARD, BLOCK = 16_384, 65_536
#: Components probed at a time.
STEP = 8
SCALE = 1024


def whole(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components as floor(1024 x), padded with zeros)."""
    lists = vectors.cast(pa.large_list(pa.float64()))
    size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(values)  # nulls read as NaN
    row = np.repeat(np.arange(len(size)), size)
    use = np.ones(len(size), bool)
    use[row[bad]] = False
    use &= ~lists.is_null().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    good = ~bad
    scaled = np.floor(values[good] * SCALE)
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        raise ValueError("a component is too large for a score of 64 bits")
    out[row[good], place[good]] = scaled
    return np.flatnonzero(use), out[use]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= kth)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


@dataclass
class Leaders:
    """A task's best k so far for a block of queries; empty places hold the lowest score."""

    ids: np.ndarray
    queries: np.ndarray
    k: int

    def __post_init__(self):
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.ids]
        self.traversed = self.probed = 0

    def visit(self, ids: np.ndarray, candidates: np.ndarray) -> None:
        """MaxScore of all queries of the block in one shard."""
        wide = max(self.queries.shape[1], candidates.shape[1])
        q, c = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (self.queries, candidates))
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(wide, 1)
        if largest >= 2.0**62:
            raise ValueError("scores may not fit 64 bits")
        kind = np.float64 if largest < 2.0**52 else np.int64
        q, postings = q.astype(kind), np.ascontiguousarray(c.T, kind)
        low, high = postings.min(1), postings.max(1)
        most, least = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
        for i in range(len(self.ids)):
            self.search(i, ids, q[i], postings, most[i] - least[i], least[i])

    def search(self, i: int, ids: np.ndarray, weights: np.ndarray, postings: np.ndarray, bounds: np.ndarray, least: np.ndarray) -> None:
        """One query in one shard; ``bounds`` are its terms' score bounds there, above ``least``."""
        base = least.sum()
        best_ids, best_scores = self.found[i]
        terms = np.argsort(-bounds, kind="stable")
        rest = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0)  # what the terms from here on add at most, above the least
        floor = best_scores.min() if len(best_scores) == self.k else None
        if floor is None and len(ids) > self.k:  # those that lead by the largest term give a first score to beat
            first = weights[terms[0]] * postings[terms[0]] if len(terms) else np.zeros(len(ids))
            first = np.where(ids == self.ids[i], -np.inf, first)
            lead = np.argpartition(-first, self.k - 1)[: self.k]
            if np.isfinite(first[lead]).all():
                floor = (weights @ postings[:, lead]).min()
        essential = len(terms) if floor is None else int(np.argmax(base + rest < floor)) if base + rest[-1] < floor else len(terms)
        if floor is not None and base + rest[0] < floor:
            return
        alive = np.flatnonzero(ids != self.ids[i])
        if 2 * essential > len(terms):  # weights of zero leave the other terms out; picking the postings would copy them
            own = np.zeros_like(weights)
            own[terms[:essential]] = weights[terms[:essential]]
            partial = (own @ postings)[alive]
        else:
            partial = (weights[terms[:essential]] @ postings[terms[:essential]])[alive]
        self.traversed += essential * len(ids)
        for at in range(essential, len(terms), STEP):
            # A candidate gets the least of the remaining terms in any case, and above it their bounds at most.
            stay = partial + least[terms[at:]].sum() + rest[at] >= floor
            alive, partial = alive[stay], partial[stay]
            some = terms[at : at + STEP]
            partial = partial + weights[some] @ postings[np.ix_(some, alive)]
            self.probed += len(some) * len(alive)
        all_ids = np.concatenate((best_ids, ids[alive]))
        all_scores = np.concatenate((best_scores, partial.astype(np.int64)))
        top = best(all_scores, all_ids, self.k)
        self.found[i] = all_ids[top], all_scores[top]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of ``vectors``.

    Queries go out in blocks of about ``block``, one after the other, as broadcasts of that size; every block meets all
    candidates, shard by shard, and its result is written before the next goes out. Exact repetitions of a query are one
    query; different vectors under one query id are searched together.
    """
    usable = "vec_id is not null and embedding is not null"
    asked = materialize(queries.select("vec_id", "embedding").where(usable).distinct(), "queries")
    blocks = max(1, -(-asked.count() // block))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = None
    for i in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == i).toArrow().combine_chunks()
        lists = own.column("embedding")
        use, made = whole(lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists)
        ids = own.column("vec_id").to_numpy().astype(np.int64)[use]
        shared = vectors.sparkSession.sparkContext.broadcast((ids, made))
        found = one_block(vectors.where(usable), shared, k, shard)
        part = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        part = materialize(part, "found")
        shared.destroy()
        merged = part if merged is None else merged.unionAll(part)
    if blocks == 1:
        return merged
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # vectors of one query id may be in several blocks


def one_block(vectors: DataFrame, shared, k: int, shard: int) -> DataFrame:
    """Each task's best k of its candidates for one block of queries, a broadcast of (ids, vectors)."""

    def run(batches):
        leaders = Leaders(*shared.value, k)
        for b in batches:
            for at in range(0, b.num_rows, shard):
                part = b.slice(at, shard)
                use, made = whole(part.column(part.schema.get_field_index("embedding")))
                if len(use) and len(leaders.ids):
                    leaders.visit(part.column(part.schema.get_field_index("vec_id")).to_numpy(zero_copy_only=False)[use].astype(np.int64), made)
        size = [len(x) for x, _ in leaders.found]
        if sum(size):
            columns = np.repeat(leaders.ids, size), np.concatenate([x for x, _ in leaders.found]), np.concatenate([x for _, x in leaders.found])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "vec_id", "score"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
