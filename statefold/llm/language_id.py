"""Language identification by language-bitmask n-gram filters.

The n-grams typical of each language go into one Bloom filter whose slots hold a bit for every language: a probe
returns all languages that contain the n-gram. A text's hits are counted per language (a hit of an n-gram of width w
counts w * w), corrected for the filter's false positives, and the largest share decides.

Cases: null text and text without letters give ``und`` with score 0; ties go to the first language in alphabetical order;
rows with null language or a null id are not learned from; without any learned language every text is ``und``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statefold.llm.common import coded, held_out, map_texts, materialize, strings_at, text_slices, word_spans

WIDTHS = (1, 2, 3, 4)
#: An n-gram belongs to a language if it has this share of the language's n-grams of its width at least, and ...
LEAST_SHARE = 2e-5
#: ... its share is at least this part of its largest share in any language.
LEAST_PART = 0.15
#: An n-gram that a language shows less often than this, in all that is learned, is no evidence.
LEAST_COUNT = 2
#: log2 of the filter's slots, and hash functions.
SLOT_BITS, PROBES = 21, 3
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]
    slots: np.ndarray  # (2**SLOT_BITS, words of 64 languages)
    false_rate: np.ndarray  # per language


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram as a number, its width, index of its word) over the letter runs of distinct words, each padded by a blank on both sides; an n-gram has a blank at one end at most."""
    runs = [" ".join(LETTERS.findall(w.lower())) for w in words.to_pylist()]
    text = " " + " ".join(runs) + " "
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(runs)), np.fromiter((len(r) + 1 for r in runs), np.int64, len(runs)))
    owner = np.concatenate(([0], owner)) if len(runs) else np.zeros(len(points), np.int64)
    blank, key, keys, widths, owners = points == 32, np.zeros(len(points), np.uint64), [], [], []
    for n in range(1, max(WIDTHS) + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        key = key[:m] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(1)
        inner = np.zeros(m, bool)  # a blank inside
        for i in range(1, n - 1):
            inner |= blank[i : i + m]
        whole = np.flatnonzero(~inner & ~(blank[:m] & blank[n - 1 :])) if n > 1 else np.flatnonzero(~blank)
        if n in WIDTHS:
            keys.append(key[whole] ^ np.uint64(n)), widths.append(np.full(len(whole), n, np.int8)), owners.append(owner[np.minimum(whole + (blank[whole] & (whole < len(points) - 1)), len(owner) - 1)])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(widths), np.concatenate(owners)


def probes(key: np.ndarray) -> list[np.ndarray]:
    """The slots of n-grams."""
    with np.errstate(over="ignore"):
        x = key ^ (key >> np.uint64(31))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x = x * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    step = (x >> np.uint64(40)) | np.uint64(1)
    return [((x + np.uint64(i) * step) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for i in range(PROBES)]


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, width, gram, n over all learned documents: each task adds up its slices, Spark adds up the tasks."""
    learned = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1)).select("lang", "text")

    def run(batches):
        for part, data, offsets in text_slices(batches):
            lang = part.column(part.schema.get_field_index("lang")).dictionary_encode()
            of_row = lang.indices.to_numpy(zero_copy_only=False)
            starts, ends, row = word_spans(data, offsets)
            code, words = coded(strings_at(data, starts, ends))
            key, width, owner = grams(words)
            for k, name in enumerate(lang.dictionary.to_pylist()):
                weight = np.bincount(code[of_row[row] == k], minlength=len(words))[owner] if len(words) else np.zeros(0)
                some = weight > 0
                found, first, back = np.unique(key[some], return_index=True, return_inverse=True)
                n = np.bincount(back, weight[some], len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(width[some][first].astype(np.int32)), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "width", "gram", "n"])

    return learned.mapInArrow(run, "lang string, width int, gram bigint, n bigint").groupBy("lang", "width", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, least_share: float = LEAST_SHARE, least_part: float = LEAST_PART) -> Filters:
    """Counts cover every learned document. A language keeps at most 1 / least_share n-grams of a width, so what the driver gets is bounded."""
    counted = materialize(gram_counts(docs), "gram-counts")
    totals = counted.groupBy("lang", "width").agg(F.sum("n").alias("total"))
    shares = counted.where(F.col("n") >= LEAST_COUNT).join(totals, ["lang", "width"]).withColumn("share", F.col("n") / F.col("total"))
    return _build(shares.where(F.col("share") >= least_share), least_part)


def _build(shares: DataFrame, least_part: float) -> Filters:
    rows = shares.select("lang", "width", "gram", "share").orderBy("lang", "width", "gram").toPandas()
    languages = tuple(sorted(rows.lang.unique()))
    top = rows.groupby(["width", "gram"]).share.transform("max")
    rows = rows[rows.share >= least_part * top]
    slots = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // 64))), np.uint64)
    false_rate = np.zeros(len(languages))
    for k, name in enumerate(languages):
        bit = np.uint64(1) << np.uint64(k % 64)
        at = probes(rows.gram[rows.lang == name].to_numpy(np.int64).view(np.uint64))
        for p in at:
            slots[p, k // 64] |= bit
        false_rate[k] = (np.unique(np.concatenate(at)).size / (1 << SLOT_BITS)) ** PROBES
    return Filters(languages, slots, false_rate)


def predict(docs: DataFrame, model: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**SLOT_BITS masks

    def make():
        f = shared.value
        kinds = len(f.languages)

        def work(part, data, offsets):
            starts, ends, row = word_spans(data, offsets)
            code, words = coded(strings_at(data, starts, ends))
            key, width, owner = grams(words)
            found, back = np.unique(key, return_inverse=True)
            mask = np.bitwise_and.reduce([f.slots[p] for p in probes(found)])
            n_words, n_rows = len(words), len(offsets) - 1
            weight = width.astype(np.float64) ** 2
            summed = lambda v: np.bincount(row, np.bincount(owner, v, n_words)[code] if n_words else None, n_rows)
            size, share = summed(weight), np.zeros((n_rows, kinds))
            for k in range(kinds):
                hit = (mask[:, k // 64] >> np.uint64(k % 64) & np.uint64(1))[back] * weight
                seen = summed(hit) / np.maximum(size, 1)
                share[:, k] = np.clip((seen - f.false_rate[k]) / (1 - f.false_rate[k]), 0, 1)
            known = (size > 0) & (kinds > 0)
            best = share.argmax(1) if kinds else np.zeros(n_rows, np.int64)
            total = share.sum(1)
            score = np.where(known & (total > 0), share.max(1, initial=0) / np.maximum(total, 1e-12), 0.0)
            names = np.array([*f.languages, UNKNOWN], object)
            return {"lang_pred": pa.array(names[np.where(known, best, kinds)].tolist(), pa.string()), "score": score}

        return work

    out = map_texts(docs, make, "lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
