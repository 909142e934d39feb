"""SentencePiece encoding and decoding with a distinct-chunk table.

Where no piece holds a word marker after another character, nothing a model does crosses the start of a run of markers:
each distinct marked word is segmented once and ids are joined by position. A model with such pieces gets whole texts.

Cases: null and empty texts have no ids and decode to empty text; repeated rows and null ids are encoded each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from statefold.llm.chunk_table import BOUND, chunks, cuts_before_spaces
from statefold.llm.common import map_texts

MARK = "▁"


def splits_at_marks(sp) -> bool:
    """Whether no piece crosses into a marker, and the model adds one marker before a text and changes nothing else."""
    crossing = any(MARK in p.lstrip(MARK) for p in (sp.id_to_piece(i) for i in range(sp.get_piece_size())))
    plain = "a  b ﬁ　c "  # double blanks, a ligature, a wide blank, a blank at the end
    return not crossing and "".join(sp.id_to_piece(i) for i in sp.encode("a  b ")) == f"{MARK}a{MARK}{MARK}b{MARK}" and sp.decode(sp.encode(plain)) == plain


class WordTable:
    """Of each distinct marked word: how many ids, the ids in decimal, the decoded text after a blank."""

    def __init__(self, sp, bound: int = BOUND):
        self.sp, self.bound = sp, bound
        self.lone = [sp.piece_to_id(MARK)]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.count: list[int] = []
        self.ids: list[str] = []
        self.text: list[str] = []

    def codes(self, distinct: list[str]) -> np.ndarray:
        new = [c for c in distinct if c not in self.at]
        if len(self.at) + len(new) > self.bound and self.at:
            self.clear()
            new = distinct
        made = [self.lone if c == " " else ids for c, ids in zip(new, self.sp.encode([c[1:] for c in new], num_threads=1), strict=True)] if new else []
        for c, ids, text in zip(new, made, self.sp.decode(made, num_threads=1) if made else [], strict=True):
            self.at[c] = len(self.count)
            self.count.append(len(ids)), self.ids.append(",".join(map(str, ids))), self.text.append(" " + text)
        return np.fromiter((self.at[c] for c in distinct), np.int64, len(distinct))

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each row."""
        marked = np.insert(data, offsets[:-1], 32)  # the marker that the model puts before a text
        code, distinct, of_row = chunks(marked, offsets + np.arange(len(offsets)), cuts_before_spaces(marked))
        own = self.codes(distinct)[code].tolist()
        out, at = [], 0
        for n, empty in zip(of_row.tolist(), (np.diff(offsets) == 0).tolist(), strict=True):
            mine = [] if empty else own[at : at + n]
            out.append((sum(map(self.count.__getitem__, mine)), ",".join(map(self.ids.__getitem__, mine)), "".join(map(self.text.__getitem__, mine))[1:]))
            at += n
        return out


class WholeTexts:
    """The same by whole texts, for models whose pieces cross markers."""

    def __init__(self, sp):
        self.sp = sp

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, str]]:
        texts = [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        made = self.sp.encode(texts, num_threads=1)
        return [(len(ids), ",".join(map(str, ids)), self.sp.decode(ids)) for ids in made]


def coder(model: str) -> WordTable | WholeTexts:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return WordTable(sp) if splits_at_marks(sp) else WholeTexts(sp)


def encode_decode(docs: DataFrame, model: str, columns: str = "n_tokens bigint, ids_sha256 string, decoded_sha256 string", view: Callable | None = None) -> DataFrame:
    """doc_id and, by default, the number of ids and digests of ids and decoded text; ``view`` makes other ``columns`` of (n, ids, text)."""

    def digests(rows):
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return {"n_tokens": [n for n, _, _ in rows], "ids_sha256": [sha(i) for _, i, _ in rows], "decoded_sha256": [sha(t) for _, _, t in rows]}

    made = view or digests

    def make():
        table = coder(model)
        return lambda part, data, offsets: made(table.rows(data, offsets))

    return map_texts(docs, make, columns)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids array and decoded text: the operator's own output."""
    return encode_decode(docs, model, "ids array<int>, decoded string", lambda rows: {"ids": [[int(x) for x in i.split(",") if x] for _, i, _ in rows], "decoded": [t for _, _, t in rows]})
