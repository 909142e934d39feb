"""N-gram Jaccard join with token-combination prefixes.

Tokens are hashed five-word shingles. Those that more than FREQUENT documents have are the frequent class; a set's tokens
are taken in the order (class, hash), rare ones first. Of two sets of n and m tokens that link, the least common token is
among the first (1-t)n + 1 of the one and (1-t)m + 1 of the other. Where it is rare, both sets are indexed under it, singly,
and a rare token leads to FREQUENT sets at most. Where it is frequent, neither set has rare tokens enough to fill that
prefix, and each has it extended to 2(1-t)n + 2 tokens: there, two linked sets have two common tokens that are neighbours in
both, because each token that only one of them has keeps at most one pair of common tokens from being neighbours. Frequent
neighbours are indexed as combinations of two. The class is one function of the token, counted over all documents; it
decides how much is compared, never what links.

Counting and indexing deal tokens out by buckets of their leading bits, as packed arrays: a row is what a part of the
documents has in a bucket. A bucket holds a bounded number of tokens, and a token more than FREQUENT documents have is one
number a part, so no text that all documents share makes a bucket large.

Equal sets, told by 128 bits, are one node; its number is its first row's. Pairs under rare tokens are candidates. The
many nodes under a combined key are first compared with one leader of the key, a few times; what links becomes a component,
and afterwards all pairs of nodes from different components are compared, in blocks, so large groups of copies are never
expanded into pairs, and no link that could join two components is left out. Sizes and sketches rule out most pairs; the
sets of the others are made again from their texts and compared in full.

Cases: null and empty texts have no shingles and link with nothing; shorter texts are one shingle; repeated rows link; a
null id stays null and doesn't name a component; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statefold.llm.common import materialize, ragged
from statefold.llm.components import components
from statefold.llm.shingles import FACTORS, Sets, extended, identity, lead, mixed, set_slices, sketch, sketch_distance

PERCENT = 75
#: A token in more documents than this is of the frequent class.
FREQUENT = 32
#: Frequent tokens that are sent to every task; if there are more, tokens and classes meet in a join.
CLASS_BOUND = 1 << 21
#: Documents that are looked up by broadcast ids; if there are more, by a join that shuffles texts.
LOOKUP_BOUND = 1 << 20
#: Tokens that a task gathers before it deals them out, and tokens of a bucket (about).
CHUNK, BUCKET = 1 << 20, 1 << 20
#: Steps in which sizes double, where a size is one byte.
SIZE_STEPS = 12
#: Leaders that each combined key tries before all its pairs are compared, and nodes of a block of these.
ROUNDS, BLOCK = 3, 4096
#: Keys of each node that tell under which key a pair is reported.
HEAD = 8
NO_KEY = np.iinfo(np.int64).max


def signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def numbers_in(column: pa.Array, kind=np.uint64) -> list[np.ndarray]:
    """The rows of a binary column as arrays; null is empty."""
    return [np.frombuffer(v.as_buffer(), kind) if v.is_valid else np.zeros(0, kind) for v in column]


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


# -- buckets ---------------------------------------------------------------------------------------------------------


def bucket_bits(docs: DataFrame, bucket: int = BUCKET) -> int:
    """log2 of the number of buckets: so many that one holds about ``bucket`` tokens, and four to a shuffle partition."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    least = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (6 * bucket))
    return min(30, max(1, int(least - 1).bit_length()))


def places(tokens: np.ndarray, bits: int) -> np.ndarray:
    """What a token is counted and indexed by: its bucket and 32 bits more. Tokens that agree in them count as one, with equal results."""
    return tokens >> np.uint64(32 - bits)


def in_buckets(place: np.ndarray, bits: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(buckets that sorted places fall in, where each begins and ends)."""
    ends = np.searchsorted(place, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32), "left").tolist() + [len(place)]
    spans = [(k, a, z) for k, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if z > a]
    return np.array([k for k, _, _ in spans], np.int32), [(a, z) for _, a, z in spans]


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def grouped(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """The runs of rows that agree in their first ``keys`` columns, whole, from sorted batches."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        key = np.stack([t.column(i).to_numpy().astype(np.int64) for i in range(keys)], 1)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            yield t.slice(i, j - i)
        rest = t.slice(edges[-1])  # may go on in the next batch
    if rest is not None:
        yield rest


def frequent_tokens(texts: DataFrame, bits: int, frequent: int) -> DataFrame:
    """place: of the tokens that more than ``frequent`` documents have; every token of every document is counted."""

    def packed(tokens: list[np.ndarray]) -> pa.RecordBatch:
        place, n = np.unique(places(np.concatenate(tokens), bits), return_counts=True)
        bucket, spans = in_buckets(place, bits)
        low, several = place.astype(np.uint32), n > 1
        once = [low[a:z][~several[a:z]].tobytes() for a, z in spans]
        more, times = ([x[a:z][several[a:z]].astype(np.uint32).tobytes() for a, z in spans] for x in (low, n))
        return batch_of(bucket=bucket, once=pa.array(once, pa.binary()), more=pa.array(more, pa.binary()), times=pa.array(times, pa.binary()))

    def gather(batches):
        held, size = [], 0
        for _, sets in set_slices(batches):
            held.append(sets.tokens)
            size += len(sets.tokens)
            if size >= CHUNK:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def count(batches):
        for t in grouped(batches):
            once, more, times = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint32) for c in ("once", "more", "times"))
            once = np.sort(once)
            first = np.flatnonzero(np.concatenate(([True], once[1:] != once[:-1]))) if len(once) else np.zeros(0, np.int64)
            place, back = np.unique(np.concatenate((once[first], more)), return_inverse=True)
            n = np.bincount(back, np.concatenate((np.diff(np.append(first, len(once))), times)), len(place))
            found = place[n > frequent].astype(np.uint64) | np.uint64(t.column("bucket")[0].as_py() << 32)
            if len(found):
                yield batch_of(place=signed(found))

    rows = texts.select("text").mapInArrow(gather, "bucket int, once binary, more binary, times binary")
    return dealt(rows).mapInArrow(count, "place bigint")


# -- sets and what they are indexed by -------------------------------------------------------------------------------


def prefix(tokens: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(single tokens, keys of combinations) that a set is indexed under; ``often`` tells its tokens of the frequent class."""
    short = lead(len(tokens), percent)
    rare = tokens[~often]
    if len(rare) >= short:
        return rare[:short], rare[:0]
    more = tokens[often][: extended(len(tokens), percent) - len(rare)]
    return rare, np.unique(mixed(more[:-1] * FACTORS[0] + more[1:] * FACTORS[1]))


DESCRIBED = "row bigint, doc_id bigint, n_shingles bigint, high bigint, low bigint, sketch binary, singles binary, combined binary"


class Describer:
    """Rows of DESCRIBED; a task describes each set once, and repetitions have only the first five columns."""

    def __init__(self, percent: int):
        self.percent, self.seen = percent, set()

    def rows(self, row: np.ndarray, doc_id: pa.Array, sets: Sets, often: np.ndarray) -> pa.RecordBatch:
        marks, found, places_of = [], [], list(zip(sets.bounds[:-1].tolist(), sets.bounds[1:].tolist(), strict=True))
        for a, z in places_of:
            own, tokens = identity(sets.tokens[a:z]), sets.tokens[a:z]
            marks.append(own)
            if a == z or own in self.seen:
                found.append((None, None, None))
                continue
            self.seen.add(own)
            single, combined = prefix(tokens, often[a:z], self.percent)
            found.append((sketch(tokens), single.tobytes(), combined.tobytes() if len(combined) else None))
        n = np.diff(sets.bounds)
        names = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
        parts = [pa.array(x, pa.binary()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.binary())] * 3
        return batch_of(
            row=signed(mixed(row.astype(np.uint64))), doc_id=doc_id, n_shingles=n.astype(np.int64), high=pa.array(names[:, 0], mask=n == 0), low=pa.array(names[:, 1], mask=n == 0),
            sketch=parts[0], singles=parts[1], combined=parts[2],
        )


def numbered(texts: DataFrame) -> DataFrame:
    return texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")


def column(part: pa.RecordBatch, name: str) -> pa.Array:
    return part.column(part.schema.get_field_index(name))


def described(texts: DataFrame, often: DataFrame, bits: int, percent: int, bound: int) -> DataFrame:
    """DESCRIBED for each row of ``texts``. Frequent tokens go to every task if there are at most ``bound``."""
    if often.count() > bound:
        return described_by_join(texts, often, bits, percent)
    shared = texts.sparkSession.sparkContext.broadcast(np.sort(often.toArrow().column("place").to_numpy()).astype(np.uint64))

    def run(batches):
        known, describer = shared.value, Describer(percent)
        for part, sets in set_slices(batches):
            place = places(sets.tokens, bits)
            at = np.minimum(np.searchsorted(known, place), max(0, len(known) - 1))
            frequent = known[at] == place if len(known) else np.zeros(len(place), bool)
            yield describer.rows(column(part, "row").to_numpy(), column(part, "doc_id").cast(pa.int64()), sets, frequent)

    return numbered(texts).mapInArrow(run, DESCRIBED)


def described_by_join(texts: DataFrame, often: DataFrame, bits: int, percent: int) -> DataFrame:
    """``described`` for a frequent class of any size: a row's tokens meet the class by key and come back to the row."""

    def make(batches):
        for part, sets in set_slices(batches):
            yield batch_of(row=column(part, "row"), doc_id=column(part, "doc_id").cast(pa.int64()), tokens=pa.array([s.tobytes() for s in sets], pa.binary()))

    def each(batches):
        for b in batches:
            own = [np.unique(places(x, bits)) for x in numbers_in(b.column(1))]
            yield batch_of(row=np.repeat(b.column(0).to_numpy(), [len(x) for x in own]), place=signed(np.concatenate(own)))

    def run(batches):
        describer = Describer(percent)
        for b in batches:
            tokens, size = numbers_in(b.column(2)), b.column(3).value_lengths().fill_null(0).to_numpy()
            bounds = np.cumsum([0, *map(len, tokens)])
            known = np.split(b.column(3).flatten().to_numpy().astype(np.uint64), np.cumsum(size)[:-1])
            frequent = np.concatenate([np.isin(places(x, bits), k) for x, k in zip(tokens, known, strict=True)])
            yield describer.rows(b.column(0).to_numpy(), b.column(1), Sets(np.concatenate(tokens), bounds), frequent)

    rows = materialize(numbered(texts).mapInArrow(make, "row bigint, doc_id bigint, tokens binary"), "tokens", "snappy")
    met = rows.select("row", "tokens").mapInArrow(each, "row bigint, place bigint").join(often, "place")
    return rows.join(met.groupBy("row").agg(F.collect_list("place").alias("often")), "row", "left").mapInArrow(run, DESCRIBED)


def size_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(255, SIZE_STEPS * np.log2(n)).astype(np.uint8)


def single_pairs(rows: DataFrame, bits: int, percent: int) -> DataFrame:
    """a, b: names (``high``) of sets of a fitting size that are indexed under one rare token."""
    widest = int(SIZE_STEPS * np.log2(100 / percent)) + 1

    def packed(tokens: list[np.ndarray], names: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        n = [len(x) for x in tokens]
        place = places(np.concatenate(tokens), bits)
        order = np.argsort(place)
        place, name, size = place[order], np.repeat(names, n)[order], np.repeat(size_class(sizes), n)[order]
        bucket, spans = in_buckets(place, bits)
        low = place.astype(np.uint32)
        return batch_of(bucket=bucket, **{k: pa.array([x[a:z].tobytes() for a, z in spans], pa.binary()) for k, x in (("low", low), ("name", name), ("size", size))})

    def gather(batches):
        held, names, sizes, n = [], [], [], 0
        for b in batches:
            for name, size, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), numbers_in(b.column(2)), strict=True):
                held.append(own), names.append(name), sizes.append(size)
                n += len(own)
                if n >= CHUNK:
                    yield packed(held, np.array(names), np.array(sizes))
                    held, names, sizes, n = [], [], [], 0
        if n:
            yield packed(held, np.array(names), np.array(sizes))

    def meet(batches):
        for t in grouped(batches):
            low, name, size = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("low", np.uint32), ("name", np.int64), ("size", np.uint8)))
            order = np.argsort(low)
            same = low[order][1:] == low[order][:-1]
            order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
            low, name, size = low[order], name[order], size[order].astype(np.int16)
            found, step = [], 1
            while len(at := np.flatnonzero(low[step:] == low[:-step]) if step < len(low) else ()):  # a run has FREQUENT at most
                near_size = at[(np.abs(size[at + step] - size[at]) <= widest) & (name[at + step] != name[at])]
                found.append(np.sort(np.stack((name[near_size], name[near_size + step]), 1), 1))
                step += 1
            if found and len(pairs := np.unique(np.concatenate(found), axis=0)):
                yield batch_of(a=pairs[:, 0], b=pairs[:, 1])

    some = rows.where(F.col("singles").isNotNull()).select("high", "n_shingles", "singles")
    return dealt(some.mapInArrow(gather, "bucket int, low binary, name binary, size binary")).mapInArrow(meet, "a bigint, b bigint").distinct()


def combined_keys(sets: DataFrame) -> DataFrame:
    """key, node, n_shingles of the sets that are indexed under combinations."""

    def run(batches):
        for b in batches:
            keys = numbers_in(b.column(2))
            n = [len(k) for k in keys]
            yield batch_of(key=signed(np.concatenate(keys)), node=np.repeat(b.column(0).to_numpy(), n), n_shingles=np.repeat(b.column(1).to_numpy(), n))

    return sets.where(F.col("combined").isNotNull()).select("node", "n_shingles", "combined").mapInArrow(run, "key bigint, node bigint, n_shingles bigint")


def full_sets(texts: DataFrame, wanted: DataFrame, bound: int) -> DataFrame:
    """node, tokens of the sets ``wanted`` (node, high, low, doc_id), made again from the documents they come from."""

    def run(batches):
        seen = set()
        for _, sets in set_slices(batches):
            made = {own: s for s in sets if len(s) and (own := identity(s)) not in seen}
            seen |= set(made)
            names = np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)
            yield batch_of(high=names[:, 0], low=names[:, 1], tokens=pa.array([s.tobytes() for s in made.values()], pa.binary()))

    ids = wanted.select("doc_id").distinct()
    some = texts.join(F.broadcast(ids) if ids.count() <= bound else ids, texts.doc_id.eqNullSafe(ids.doc_id), "left_semi")
    return some.select("text").mapInArrow(run, "high bigint, low bigint, tokens binary").join(wanted.select("node", "high", "low"), ["high", "low"]).select("node", "tokens")


# -- comparing -------------------------------------------------------------------------------------------------------


def near(pairs: DataFrame, sets: DataFrame, percent: int, name: str = "node") -> DataFrame:
    """a, b: nodes of the pairs of ``name`` that sizes and sketches don't rule out."""
    x, y = (sets.select(F.col(name).alias(c), F.col("node").alias(f"node_{c}"), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    both = pairs.join(x, "a").join(y, "b").where(fits & (F.col("node_a") != F.col("node_b")))

    def run(batches):
        for batch in batches:
            rows = zip(*[column(batch, c).to_pylist() for c in ("na", "nb", "sa", "sb")], strict=True)
            keep = [(100 + percent) * sketch_distance(sa, sb) <= (100 - percent) * (na + nb) for na, nb, sa, sb in rows]
            yield batch_of(a=column(batch, "node_a"), b=column(batch, "node_b")).filter(pa.array(keep, pa.bool_()))

    return both.select("node_a", "node_b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


@dataclass(frozen=True)
class Group:
    """The nodes of one or two blocks under one key; ``heads`` are each node's least open keys."""

    key: int
    ends: tuple[int, int]
    node: np.ndarray
    size: np.ndarray
    comp: np.ndarray
    block: np.ndarray
    sketches: list[bytes]
    heads: np.ndarray

    def reported_here(self, i: int, others: np.ndarray) -> np.ndarray:
        """Whether this is the least key that a node's head shares with the others' heads; true as well where heads share none."""
        same = (self.heads[others][:, :, None] == self.heads[i][None, None, :]).any(2)
        least = np.where(same, self.heads[others], NO_KEY).min(1)
        return (least == self.key) | (least == NO_KEY)

    def near(self, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of nodes of different components and of the blocks ``ends`` that sizes and sketches don't rule out."""
        places = np.array([len(x) for x in self.sketches])
        out = []
        for p in np.unique(places).tolist():  # sizes that fit differ by less than two, so sketches by one folding at most
            low = np.flatnonzero(places == p)
            a = np.frombuffer(b"".join(self.sketches[i] for i in low), np.uint64).reshape(len(low), -1)
            for q in (p, 2 * p):
                high = np.flatnonzero(places == q)
                if not len(high):
                    continue
                b = np.frombuffer(b"".join(self.sketches[i] for i in high), np.uint64).reshape(len(high), -1)
                b = b if q == p else b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
                for i, bits in zip(low.tolist(), a, strict=True):
                    n, m = self.size[i], self.size[high]
                    some = (self.comp[high] != self.comp[i]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                    x, y = self.ends
                    some &= ((self.block[high] == x) & (self.block[i] == y)) | ((self.block[high] == y) & (self.block[i] == x))
                    if p == q:
                        some &= high > i
                    at = np.flatnonzero(some)
                    at = at[(100 + percent) * np.bitwise_count(b[at] ^ bits).sum(1, dtype=np.int64) <= (100 - percent) * (n + m[at])]
                    at = high[at]
                    at = at[self.reported_here(i, at)] if len(at) else at
                    if len(at):
                        out.append((np.minimum(self.node[at], self.node[i]), np.maximum(self.node[at], self.node[i])))
        return out


def near_across(rows: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """a, b: the pairs of nodes under a key (rows: key, node, n_shingles, comp) of different components that may link.

    A key with many nodes is dealt in blocks of about ``block`` and each pair of blocks is a group of its own; what
    sketches rule out never becomes a row. A pair is reported under one key, except for pairs whose heads share none.
    """
    parts = rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    split = rows.join(parts, "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    met = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    heads = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, HEAD).alias("head"))  # of a document's own keys
    known = materialize(heads.join(sets.select("node", "sketch"), "node"), "heads")
    full = met.join(known, "node").select("key", "x", "y", "node", "n_shingles", "comp", "block", "sketch", "head")
    groups = full.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def run(batches):
        for t in grouped(batches, 3):
            if t.num_rows < 2:
                continue
            key, x, y = (t.column(c)[0].as_py() for c in ("key", "x", "y"))
            lists = t.column("head").combine_chunks()
            width = lists.value_lengths().to_numpy()
            heads = np.full((t.num_rows, HEAD), NO_KEY)
            heads[np.repeat(np.arange(t.num_rows), width), ragged(np.zeros(t.num_rows, np.int64), width)] = lists.flatten().to_numpy()
            node, size, comp, own = (t.column(c).to_numpy() for c in ("node", "n_shingles", "comp", "block"))
            found = Group(key, (x, y), node, size, comp, own, t.column("sketch").to_pylist(), heads).near(percent)
            if found:
                pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], 1), axis=0)
                yield batch_of(a=pairs[:, 0], b=pairs[:, 1])

    return groups.mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sets link."""
    x, y = (sets.select(F.col("node").alias(c), F.col("tokens").alias(f"t{c}")) for c in "ab")
    both = pairs.join(x, "a").join(y, "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "ta"), column(batch, "tb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch_of(a=column(batch, "a"), b=column(batch, "b")).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def join(docs: DataFrame, percent: int = PERCENT, frequent: int = FREQUENT, rounds: int = ROUNDS, block: int = BLOCK, class_bound: int = CLASS_BOUND, lookup_bound: int = LOOKUP_BOUND) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``; ``percent`` is the least similarity, 75 at least."""
    if not 75 <= percent <= 100:
        raise ValueError("percent must be between 75 and 100")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    bits = bucket_bits(texts)
    often = materialize(frequent_tokens(texts, bits, frequent), "frequent-tokens")
    every = materialize(described(texts, often, bits, percent, class_bound), "described")
    # A node is the first of the rows that have its set described.
    firsts = every.groupBy("high", "low").agg(F.min(F.when(F.col("sketch").isNotNull(), F.col("row"))).alias("node")).where("high is not null")
    firsts = materialize(firsts, "nodes")
    sets = every.where("sketch is not null").drop("singles").join(firsts.select(F.col("node").alias("row")), "row", "left_semi")
    sets = materialize(sets.withColumnRenamed("row", "node"), "sets")
    few = materialize(near(single_pairs(every, bits, percent), sets, percent, "high"), "near")
    combined = combined_keys(sets)
    shared = combined.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    combined = materialize(combined.join(shared, "key", "left_semi"), "combined")
    needed = few.select(F.col("a").alias("node")).unionAll(few.select("b")).unionAll(combined.select("node")).distinct()
    wanted = materialize(sets.select("node", "high", "low", "doc_id").join(needed, "node", "left_semi"), "wanted")
    full = materialize(full_sets(texts, wanted, lookup_bound), "full-sets", "snappy")
    links = materialize(verified(few, full, percent), "links")
    comps = components(links)
    for turn in range(rounds + 1):
        # Under the combined keys, only pairs of nodes from different components are still of interest.
        rows = materialize(combined.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "labelled")
        spread = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.xxhash64("node", F.lit(turn))).alias("first")).where("lo < hi")
        several = materialize(spread.select("key", "first"), "several")
        if several.isEmpty():
            break
        still = materialize(rows.join(several, "key"), "open")
        if turn < rounds:  # one leader of each key, another each time; its set is shipped to the others'
            leaders = still.where(F.xxhash64("node", F.lit(turn)) == F.col("first")).select("key", F.col("node").alias("leader"), F.col("comp").alias("led"))
            met = still.join(materialize(leaders, "leaders"), "key").where("comp <> led")
            found = near(met.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), sets, percent)
        else:  # all that is left
            found = near_across(still.drop("first"), sets, percent, block)
        more = materialize(verified(materialize(found, "near"), full, percent), "links")
        links = materialize(links.unionAll(more), "links")
        comps = components(links)
    # Documents: the least id of each component.
    own = every.select("doc_id", "n_shingles", "high", "low").join(firsts, ["high", "low"], "left").join(comps, "node", "left")
    placed = materialize(own.select("doc_id", "n_shingles", F.coalesce("comp", "node").alias("comp")), "node-components")
    least = materialize(placed.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "component-names")
    out = placed.join(least, "comp", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those that link, over others, to a row with a smaller doc_id (null: largest; ties: any one row)."""
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")  # numbered once: a second scan might be dealt otherwise
    found = join(rows.select(F.col("_row").alias("doc_id"), "text"), percent).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("comp"))
    placed = materialize(found.join(rows.select("_row", "doc_id"), "_row"), "row-components")
    first = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    firsts = placed.groupBy("comp").agg(F.min(first).alias("first"))
    tied = placed.join(materialize(firsts, "firsts"), "comp").where(first == F.col("first"))
    best = tied.groupBy("comp").agg(F.min("_row").alias("_row"))
    lost = materialize(placed.select("_row").join(best.select("_row"), "_row", "left_anti"), "lost-rows")
    return rows.join(lost, "_row", "left_anti").select(*docs.columns)
