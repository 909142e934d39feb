"""Packing, SentencePiece tables and token files against the libraries themselves."""

import hashlib
import json
import os
import random
import shutil
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statefold.llm import packing, pieces_codec, token_files
from statefold.llm.chunk_table import IdTable, cutter, hub_encoder
from statefold.llm.common import text_slices

BYTE, WORD, PIECE = (P.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LETTERS = [*"abc XYZ'ß éñ\n\t\r  ,.!?$%&|<>123-_", "▁", "▁", " ", " ", "　", "中", "한", "😀", "​", "\x1c", "\x85", "\x00", "ﬁ", "Σ", "ς", "İ", "ǅ", "́", "'s", " 'll", "<s>", "<|endoftext|>", "<|startoftext|>", "﻿", " "]
texts = st.lists(st.sampled_from(LETTERS), max_size=30).map("".join)


def plain(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def through_table(path, rows, bound=50, most=400):
    table, cuts, out = IdTable(hub_encoder(path), bound), cutter(path), []
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["text"])
    for _, data, offsets in text_slices(iter([batch]), most=most):
        ids, n = table.ids(data, offsets, cuts(data, offsets))
        at = np.concatenate(([0], np.cumsum(n)))
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    return out


@pytest.mark.parametrize("path", [BYTE, WORD])
@given(rows=st.lists(texts, min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_chunks_give_the_ids_of_whole_texts(path, rows):
    tokenizer = plain(path)
    assert through_table(path, rows) == [tokenizer.encode(x, add_special_tokens=False).ids for x in rows]


SPECIAL = st.lists(st.sampled_from([*LETTERS, "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "\n", "e\u0301"]), max_size=20).map("".join)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_added_tokens_are_as_plain(path):
    tokenizer, cuts, table = plain(path), cutter(path), IdTable(hub_encoder(path), 50)

    @given(rows=st.lists(SPECIAL, min_size=1, max_size=20))
    @settings(max_examples=150, deadline=None)
    def check(rows):
        rows, out = ["a <|endoftext|> b", "x<|endof", "text|>", *rows], []
        batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["text"])
        for _, data, offsets in text_slices(iter([batch]), most=400):
            ids, n = table.ids(data, offsets, cuts(data, offsets))
            out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert out == [tokenizer.encode(x, add_special_tokens=False).ids for x in rows]
        assert tokenizer.token_to_id("<|endoftext|>") in out[0]

    check()


@pytest.mark.parametrize("kind", [{"normalized": True}, {"single_word": True}, {"lstrip": True}])
def test_other_added_tokens_are_as_plain(tmp_path, kind):
    with open(BYTE, encoding="utf-8") as f:
        spec = json.load(f)
    token = {"content": "lazydog", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}
    for more in (kind, {}):
        spec["added_tokens"] = [*[t for t in spec["added_tokens"] if t["content"] != "lazydog"], token | more | {"id": 50257}]
        path = str(tmp_path / f"{len(more)}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(spec, f)
        tokenizer, rows = plain(path), ["a lazydog lazydogs x", "lazydog"]
        data = np.frombuffer("".join(rows).encode(), np.uint8)
        offsets = np.cumsum([0, *map(len, rows)])
        ids, n = IdTable(hub_encoder(path)).ids(data, offsets, cutter(path)(data, offsets))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tokenizer.encode(x, add_special_tokens=False).ids for x in rows]


def test_operators_keep_added_tokens(spark):
    docs = spark.createDataFrame([(0, "a <|endoftext|> b"), (1, "<|startoftext|>x<|endoftext|>"), (2, "c")], "doc_id bigint, text string")
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    ids = lambda path: {r.doc_id: [*plain(path).encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    assert {r.doc_id: r.ids_crc32 for r in packing.pack(docs, BYTE).collect()} == {k: crc(x) for k, x in ids(BYTE).items()}
    assert {r.doc_id: r.ids_crc32 for r in token_files.write_and_read(docs, WORD).collect()} == {k: crc(x) for k, x in ids(WORD).items()}


@given(rows=st.lists(texts, min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_marked_words_give_the_pieces_of_whole_texts(rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["text"])
    for table in (pieces_codec.WordTable(sp, bound=20), pieces_codec.WholeTexts(sp)):
        got = [r for _, data, offsets in text_slices(iter([batch]), most=200) for r in table.rows(data, offsets)]
        want = [sp.encode(x) for x in rows]
        assert got == [(len(i), ",".join(map(str, i)), sp.decode(i)) for i in want]


def test_the_model_fits_the_method():
    assert isinstance(pieces_codec.coder(PIECE), pieces_codec.WordTable)


def test_pieces_of_edge_documents(edges, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = sorted(map(tuple, pieces_codec.encode_decode(edges, PIECE).collect()), key=str)
    want = []
    for r in edges.collect():
        ids = sp.encode(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert pieces_codec.encode_decode(nothing, PIECE).count() == 0
    assert {len(r.ids) for r in pieces_codec.encode(edges, PIECE).collect() if r.doc_id in (1, 2)} == {0}


def test_token_files_round_trip(edges, nothing):
    tokenizer = plain(WORD)
    got = token_files.write_and_read(edges, WORD).collect()
    ids = lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want = {(r.doc_id, len(x), crc(x)) for r in edges.collect() for x in [ids(r.text)]}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == edges.count()
    ordered = sorted(got, key=lambda r: r.start)
    keys = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert keys == sorted(keys)
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered[:-1]]]).tolist()
    assert token_files.write_and_read(nothing, WORD).count() == 0


def test_token_files_are_flat_and_mapped(spark, edges, tmp_path):
    folder = str(tmp_path / "files")
    rows = token_files.write(edges, WORD, folder).collect()
    for r in rows:
        ids = token_files.view(f"{folder}/{r.name}.ids", f"<u{r.width}")
        offsets = token_files.view(f"{folder}/{r.name}.offsets", "<u8")
        assert len(ids) == r.n_ids == offsets[-1] and len(offsets) == r.n_docs + 1 and r.width == 2
        assert r.n_ids == 0 or isinstance(ids, np.memmap)


def packed_rows(df):
    return df.toPandas().sort_values(["sequence_id", "offset"])


def check_packing(rows, docs, window=2048):
    """Checks the placement; returns by how many windows it exceeds the least number."""
    tokenizer = plain(BYTE)
    full = rows.groupby("sequence_id").length.sum()
    assert (full <= window).all() and sorted(full.index) == list(range(len(full)))
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()
    left = {}
    for r in docs:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), window):
            part = ids[a : a + window]
            key = (r.doc_id, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))
            left[key] = left.get(key, 0) + 1
    for r in rows.itertuples():
        key = (None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens)
        left[key] -= 1
    assert not any(left.values())
    least = -(-full.sum() // window)
    return len(full) - least


def test_packing_places_every_id_once(spark, small, edges, nothing):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert check_packing(packed_rows(packing.pack(docs, BYTE)), docs.collect()) <= 1
    assert check_packing(packed_rows(packing.pack(edges.repartition(3), BYTE)), edges.collect()) <= 1
    assert packing.pack(nothing, BYTE).count() == 0


def test_fill_finds_the_closest_sum():
    rng = random.Random(2)
    for _ in range(200):
        left = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        target = rng.randint(0, 60)
        sums = {0}
        for k, n in left.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        used = packing.fill(left, target)
        assert all(n <= left[k] for k, n in used.items())
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= target)


def test_a_plan_uses_every_piece_once():
    rng = random.Random(4)
    counts = {k: rng.randint(0, 50) for k in range(1, 65)} | {7: 5000}
    p = packing.plan(counts, 64)
    for k, n in counts.items():
        parts = sorted((f, e, s) for length, f, e, s in zip(p.length, p.first, p.each, p.sequence) if length == k)
        assert not n or parts[0][0] == 0
    assert len(p.length) < 64 * 64
    assert len(packing.plan({}, 64).length) == 0


@pytest.mark.parametrize("vocabulary", [WORD, BYTE])
def test_a_worker_reads_a_tokenizer_once(tmp_path, monkeypatch, vocabulary):
    import tokenizers

    class Counting:
        reads = 0

        def from_file(self, path):
            self.reads += 1
            return tokenizer_class.from_file(path)

    tokenizer_class, counting = tokenizers.Tokenizer, Counting()
    monkeypatch.setattr(tokenizers, "Tokenizer", counting)
    path = shutil.copy(vocabulary, tmp_path / "tokenizer.json")
    words = ["Word", "word", " word", " Word", "\nword", "ÉTÉ", " été", "<|endoftext|>"]
    want = [e.ids for e in tokenizer_class.from_file(str(path)).encode_batch(words, add_special_tokens=False)]
    for _ in range(3):  # tasks
        assert hub_encoder(str(path))(words) == want
        cutter(str(path))
    assert counting.reads == 1
    os.utime(path, ns=(1, 1))  # a file that has changed is read anew
    hub_encoder(str(path))
    assert counting.reads == 2
