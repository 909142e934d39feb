"""Distinct-chunk tables: a tokenizer sees each distinct chunk of a task's texts once.

A text is cut only where the tokenizer can have no token on both sides of the cut, so the ids of a text are the ids of
its chunks, joined by position. The table of a task is emptied when it holds ``bound`` chunks; results don't depend on it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

from statefold.llm.common import coded, ragged, strings_at

BOUND = 300_000


def ranges(*pairs: tuple[int, int]) -> np.ndarray:
    """Byte set of the closed ranges."""
    out = np.zeros(256, bool)
    for first, last in pairs:
        out[first : last + 1] = True
    return out


ASCII_LETTER, PLAIN = ranges((65, 90), (97, 122)), ranges((0x21, 0x7E))
POINT = ranges((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))  # without the apostrophe, which begins endings like 's
INNER, LATIN_LEAD = ranges((0x80, 0xBF)), ranges((0xC4, 0xC8))  # U+0100-U+023F are letters


def shifted(data: np.ndarray, n: int) -> np.ndarray:
    """The byte ``n`` places before each byte; after it for a negative ``n``; 0 outside."""
    out = np.zeros(len(data), np.uint8)
    if n > 0:
        out[n:] = data[:-n]
    else:
        out[:n] = data[-n:]
    return out


def latin(lead: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Whether two bytes are a letter of U+00C0-U+023F; the dotted capital I counts as none, as lower case gives it a mark."""
    return LATIN_LEAD[lead] & ~((lead == 0xC4) & (inner == 0xB0)) | (lead == 0xC3) & (inner != 0x97) & (inner != 0xB7)


def cuts_of_words(data: np.ndarray) -> np.ndarray:
    """Bytes at which a new chunk may begin for tokenizers that never join letters, other signs and blanks, but for one blank before a word.

    These are a space or line feed after a character that nobody counts as white space, what follows such a line feed, and the
    border of Latin letters and ASCII signs. Left uncut, to be safe, after characters that might be blanks: controls,
    U+0080-U+00BF and the blocks of U+1000-U+3FFF.
    """
    if len(data) < 5:
        return np.zeros(len(data), bool)
    one, two, three, four = (shifted(data, n) for n in (1, 2, 3, 4))
    in_one, in_two = INNER[one], INNER[two]
    visible = PLAIN[one] | in_one & (two >= 0xC3) & (two < 0xE0) | in_one & in_two & (three >= 0xE4) & (three < 0xEE) | in_one & in_two & INNER[three] & (four >= 0xF0)
    after_letter = ASCII_LETTER[one] | in_one & latin(two, one)
    letter = ASCII_LETTER[data] | latin(data, shifted(data, -1))
    line = (data == 0x0A) & visible
    after_line = (shifted(line.view(np.uint8), 1) > 0) & (PLAIN[data] | letter)
    return (data == 0x20) & visible | line | after_line | POINT[data] & after_letter | letter & POINT[one]


@lru_cache(maxsize=2)
def _loaded(path: str, changed: int, size: int):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        return Tokenizer.from_file(path), json.load(f)


def loaded(path: str):
    """(the library's tokenizer, its file's contents), read once by a Python worker, whose tasks follow one another."""
    of = os.stat(path)
    return _loaded(path, of.st_mtime_ns, of.st_size)


def added_strings(path: str) -> tuple[frozenset[str], bool]:
    """(strings of a vocabulary's added tokens, whether the library looks for all of them as they stand in the raw text)."""
    added = loaded(path)[1].get("added_tokens") or []
    return frozenset(t["content"] for t in added), not any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip", "normalized"))


def cutter(path: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """``cuts_of_words`` for a vocabulary: each occurrence of an added token's string is a chunk of its own.

    Texts are left whole where the library doesn't look for added tokens in the raw text only.
    """
    added, raw = added_strings(path)
    if not raw:
        return lambda data, offsets: np.zeros(len(data), bool)
    found = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(added, key=len, reverse=True))) if added else None

    def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = cuts_of_words(data)
        text = np.ascontiguousarray(data).data
        if found and found.search(text):
            for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for m in found.finditer(text, a, z):
                    out[m.start() : m.end()] = False
                    out[[x for x in m.span() if x < len(out)]] = True
        return out

    return cuts


def cuts_before_spaces(data: np.ndarray) -> np.ndarray:
    """Bytes at which a run of spaces or word markers (U+2581) begins with a space."""
    if len(data) < 3:
        return (data == 0x20) & (shifted(data, 1) != 0x20) if len(data) > 1 else data == 0x20
    return (data == 0x20) & (shifted(data, 1) != 0x20) & ~((shifted(data, 3) == 0xE2) & (shifted(data, 2) == 0x96) & (shifted(data, 1) == 0x81))


def chunks(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray):
    """(code of each chunk, distinct chunks, chunks of each row)."""
    begin = cuts.copy()
    rows = offsets[:-1]
    begin[rows[rows < len(data)]] = True
    starts = np.flatnonzero(begin)
    code, distinct = coded(strings_at(data, starts, np.append(starts[1:], len(data)))) if len(starts) else (np.zeros(0, np.int64), None)
    return code, distinct.to_pylist() if distinct is not None else [], np.diff(np.searchsorted(starts, offsets))


class IdTable:
    """ids of distinct chunks as flat arrays."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], bound: int = BOUND):
        self.encode, self.bound = encode, bound
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def codes(self, distinct: list[str]) -> np.ndarray:
        new = [c for c in distinct if c not in self.at]
        if len(self.at) + len(new) > self.bound and self.at:
            self.clear()
            new = distinct
        if new:
            made = self.encode(new)
            self.size = np.concatenate((self.size, np.fromiter(map(len, made), np.int64, len(made))))
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(made), np.uint32)))
            n = len(self.at)
            self.at.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter((self.at[c] for c in distinct), np.int64, len(distinct))

    def ids(self, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all rows' ids, number of ids of each row)."""
        code, distinct, of_row = chunks(data, offsets, cuts)
        if not len(code):
            return np.zeros(0, np.uint32), np.zeros(len(of_row), np.int64)
        own = self.codes(distinct)[code]
        starts, size = np.cumsum(self.size) - self.size, self.size[own]
        ends = np.concatenate(([0], np.cumsum(size)))
        bounds = np.concatenate(([0], np.cumsum(of_row)))
        return self.flat[ragged(starts[own], size)], np.diff(ends[bounds])


#: A word that is one piece to these tokenizers' splitters; the dotted capital I becomes two characters in lower case.
WORD = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-įı-ȿ]+")


def byte_letters() -> dict[int, int]:
    """The character that byte-level vocabularies write for each byte: itself if it is visible, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(rest)}


def word_form(spec: dict) -> Callable[[str], str] | None:
    """How a tokenizer of a known build normalises a WORD before its model sees it; None for other builds."""
    kind = lambda x: (x or {}).get("type")
    normal, split = spec.get("normalizer"), spec.get("pre_tokenizer")
    if spec["model"].get("dropout") or kind(spec["model"]) != "BPE":
        return None
    if normal is None and kind(split) == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"):
        return lambda word: word
    steps = [kind(x) for x in (normal or {}).get("normalizers", [])]
    parts = (split or {}).get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and [kind(x) for x in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and not parts[1]["use_regex"]:
        return lambda word: word.strip().lower()
    return None


def hub_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Encodes by the tokenizers library as it is, without tokens of a template. Single words go straight to the library's model, each form once."""
    tokenizer, spec = loaded(path)
    form = word_form(spec)
    added, raw = added_strings(path)
    form = form if raw else None
    letters, model = byte_letters(), tokenizer.model

    def encode(chunks: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(chunks)
        other, known = [], {}
        for i, c in enumerate(chunks):
            if form and WORD.fullmatch(c) and c not in added:
                word = form(c)
                if (ids := known.get(word)) is None:
                    ids = known[word] = [t.id for t in model.tokenize(word.encode().decode("latin1").translate(letters))]
                out[i] = ids
            else:
                other.append(i)
        for i, e in zip(other, tokenizer.encode_batch_fast([chunks[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    return encode


def with_end(ids: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' ids with ``end`` after each row, and the rows' offsets in them."""
    bounds = np.concatenate(([0], np.cumsum(n)))
    return np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))
