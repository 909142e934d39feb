"""Hashed five-word shingles of texts, their identity, prefixes and sketches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from statefold.llm.common import BLANK, text_slices

WIDTH = 5
#: Text bytes that are turned into arrays at a time; arrays of this size stay in the processor's cache.
SLICE = 1 << 19
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def byte_values() -> np.ndarray:
    """A number for each byte: none for blanks, the small letter's for A to Z."""
    out = mixed(np.arange(1, 257, dtype=np.uint64) * FACTORS[0])
    out[65:91] = out[97:123]
    out[BLANK] = 0
    return out


BYTE_VALUES = byte_values()


def place_factors(places: int) -> np.ndarray:
    return mixed((np.arange(places, dtype=np.uint64) + np.uint64(1)) * FACTORS[2]) | np.uint64(1)


#: Factors of the first places of a word; those of longer words are made when one is met.
PLACES = place_factors(1 << 10)


@dataclass(frozen=True)
class Sets:
    """The rows' distinct shingle hashes, each row's in ascending order, one row after the other."""

    tokens: np.ndarray
    bounds: np.ndarray

    def __iter__(self) -> Iterator[np.ndarray]:
        for a, z in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            yield self.tokens[a:z]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each row): a word's bytes' values times factors of their places, added up."""
    word = ~BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    starts = np.flatnonzero(word & (first[:-1] | np.concatenate(([True], ~word[:-1]))))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    size = np.diff(np.append(starts, len(data)))  # with the blanks that follow, whose value is 0
    place = np.arange(starts[0], len(data)) - np.repeat(starts, size)
    factor = PLACES if len(PLACES) > (longest := int(size.max())) else place_factors(longest)
    summed = np.add.reduceat(BYTE_VALUES[data[starts[0] :]] * factor[place], starts - starts[0])
    return mixed(summed), np.diff(np.searchsorted(starts, offsets))


def token_sets(data: np.ndarray, offsets: np.ndarray) -> Sets:
    """A text with fewer words than a shingle is one shingle, which depends on their number; without words it has none."""
    word, n = word_hashes(data, offsets)
    first = np.concatenate(([0], np.cumsum(n)))
    window = np.zeros(max(0, len(word) - WIDTH + 1), np.uint64)
    for i in range(WIDTH):
        window += word[i : i + len(window)] * FACTORS[i]
    window = mixed(window)
    made = np.where(n >= WIDTH, n - WIDTH + 1, n > 0)
    bounds = np.concatenate(([0], np.cumsum(made)))
    tokens = np.empty(int(bounds[-1]), np.uint64)
    for k, at, a, z in zip(n.tolist(), first[:-1].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if k >= WIDTH:
            tokens[a:z] = window[at : at + z - a]
            tokens[a:z].sort()
        elif k:
            tokens[a] = mixed((word[at : at + k] * FACTORS[:k]).sum(keepdims=True, dtype=np.uint64) + np.uint64(k))[0]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    new[bounds[:-1][made > 0]] = True
    before = np.concatenate(([0], np.cumsum(new)))
    return Sets(tokens[new], before[bounds])


def set_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Sets]]:
    for part, data, offsets in text_slices(batches, most=SLICE):
        yield part, token_sets(data, offsets)


def identity(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def lead(n: int, percent: int) -> int:
    """Of two linked sets, the least common token in any one order is among so many first tokens of a set of n."""
    return n * (100 - percent) // 100 + 1


def extended(n: int, percent: int) -> int:
    """Among so many first tokens of each, two linked sets have two common tokens that are neighbours in both."""
    return 2 * n * (100 - percent) // 100 + 2


def sketch(tokens: np.ndarray) -> bytes:
    """A bit for each place (as many places as tokens, rounded up to a power of two): whether an odd number of tokens falls there.

    Two sets differ in at least as many tokens as their sketches in bits; a longer sketch folds to a shorter one.
    """
    places = max(64, 1 << int(len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the number of tokens that only one of the sets has."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())
