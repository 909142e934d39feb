"""Whole-text counts of a slice of documents as numpy columns."""

from __future__ import annotations

import numpy as np

from statefold.llm.common import coded, per_row, strings_at, word_spans

#: Fixed by the quality rules: the symbols that count.
SYMBOLS = b"#*$%&|<>"


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


IS_SYMBOL = byte_set(SYMBOLS)
IS_UPPER, IS_LOWER, IS_DIGIT = (byte_set(bytes(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
IS_POINT, IS_STOP = byte_set(b".,;:?'\"()-"), byte_set(b".?!")
IS_START = np.ones(256, bool)  # of a code point
IS_START[0x80:0xC0] = False


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of per-byte flags in each row."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def pair_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense codes of pairs (a[i], b[i]); exact for codes under 2**31."""
    return np.unique(a.astype(np.int64) << 31 | b, return_inverse=True)[1]


class Counted:
    """Words, lines and 5-word windows of a slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.starts, self.ends, self.row = word_spans(data, offsets)
        self.code, self.words = coded(strings_at(data, self.starts, self.ends))
        self.n_words = per_row(self.row, self.n)
        points = np.concatenate(([0], np.cumsum(IS_START[data], dtype=np.int64)))
        self.word_points = points[self.ends] - points[self.starts]
        self.word_chars = per_row(self.row, self.n, self.word_points).astype(np.int64)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Per row: lines with a word; of these, those equal to an earlier one."""
        if not len(self.data):
            return np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        breaks = np.flatnonzero(self.data == 10)
        inner = self.offsets[:-1]
        starts = np.unique(np.concatenate((inner[inner < len(self.data)], breaks + 1)))
        starts = starts[starts < len(self.data)]
        ends = np.append(starts[1:], len(self.data))
        ends -= self.data[ends - 1] == 10
        worded = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        starts, ends = starts[worded], ends[worded]
        row = np.searchsorted(self.offsets, starts, "right") - 1
        code, _ = coded(strings_at(self.data, starts, ends))
        distinct = np.unique(row.astype(np.int64) << 31 | code) >> 31
        n = per_row(row, self.n)
        return n, n - per_row(distinct, self.n)

    def distinct_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Per row: distinct words, occurrences of the commonest."""
        key, times = np.unique(self.row.astype(np.int64) << 31 | self.code, return_counts=True)
        row, most = key >> 31, np.zeros(self.n, np.int64)
        np.maximum.at(most, row, times)
        return per_row(row, self.n), most

    def repeated_words(self, width: int = 5) -> np.ndarray:
        """Per row: words that lie in a ``width``-word window found twice or more in the row."""
        m = len(self.code) - width + 1
        if m <= 0:
            return np.zeros(self.n, np.int64)
        whole = np.flatnonzero(self.row[:m] == self.row[width - 1 :])
        gram = self.code[whole]
        for i in range(1, width):
            gram = pair_codes(gram, self.code[whole + i])
        _, back, times = np.unique(self.row[whole].astype(np.int64) << 31 | gram, return_inverse=True, return_counts=True)
        again = whole[times[back] > 1]
        cover = np.zeros(len(self.code) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + width, -1)
        return per_row(self.row[np.cumsum(cover[:-1]) > 0], self.n)


#: Order of the columns of ``features``.
FEATURES = (
    "log_bytes log_words mean_word distinct_share commonest_share symbol_share upper_share digit_share point_share bang_share bar_share "
    "wide_share line_words dup_line_share repeat_share same_next_share stop_rate long_word_share short_word_share"
).split()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, len(FEATURES)) document statistics; all zero for a text without bytes."""
    c = Counted(data, offsets)
    n_bytes, words = np.diff(offsets), np.maximum(c.n_words, 1)
    size = np.maximum(n_bytes, 1)
    n_lines, dup = c.lines()
    distinct, most = c.distinct_words()
    share = lambda flags: row_sums(flags, offsets) / size
    same = np.flatnonzero((c.code[1:] == c.code[:-1]) & (c.row[1:] == c.row[:-1]))
    columns = (
        np.log1p(n_bytes), np.log1p(c.n_words), c.word_chars / words, distinct / words, most / words, share(IS_SYMBOL[data]), share(IS_UPPER[data]),
        share(IS_DIGIT[data]), share(IS_POINT[data]), share(data == 33), share(data == 124), share(data >= 128), c.n_words / np.maximum(n_lines, 1), dup / np.maximum(n_lines, 1),
        c.repeated_words() / words, per_row(c.row[same], c.n) / words, row_sums(IS_STOP[data], offsets) / words,
        per_row(c.row[c.word_points > 12], c.n) / words, per_row(c.row[c.word_points < 3], c.n) / words,
    )
    return np.stack(columns, 1).astype(np.float32)
