from __future__ import annotations

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import fst_tokens, pfor
from ledgerline.llm.queries import op7_fst_token_counts, op8_pfor_token_ids, tokenizer

LIBRARY = Tokenizer.from_file(tokenizer())
SPEC = open(tokenizer(), encoding="utf-8").read()
TOKENS = fst_tokens.Tokens(SPEC)
ENCODER = pfor.Encoder(SPEC)
PARTS = ["'s", "'re", "'", "l", "ll", " ", "  ", "\n", "\t", " \n", "a", "B", "7", "é", "中", "!", "$$", "'v", "'ve", "ing", "the", "<|endoftext|>", "😀", " ", " ", "ſ", "\x1c", "\x85", "²", "٣", "Ж", "\x00", "é"]


def library(texts: list[str]) -> list[list[int]]:
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_counts_and_ids_equal_the_library():
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    want = library(texts)
    assert fst_tokens.count_tokens(texts, TOKENS).tolist() == [len(x) for x in want]
    got = [x for k in range(0, len(texts), 200) for x in ENCODER.encode(texts[k : k + 200])]
    assert all(a.tolist() == b for a, b in zip(got, want, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), max_size=8))
def test_any_texts(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    want = library(texts)
    assert fst_tokens.count_tokens(texts, TOKENS).tolist() == [len(x) for x in want]
    assert [x.tolist() for x in ENCODER.encode(texts)] == want


def test_chunks_and_pieces_do_not_matter(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(PARTS) for _ in range(4000))
    want = len(library([text])[0])
    for chunk, batch in ((1, 50), (7, 1000), (256, 1 << 20)):
        monkeypatch.setattr(fst_tokens, "CHUNK", chunk)
        monkeypatch.setattr(fst_tokens, "BATCH", batch)
        assert fst_tokens.count_tokens([text, "", text], TOKENS).tolist() == [want, 0, want]


def test_dropped_tables_compile_again(monkeypatch):
    tokens = fst_tokens.Tokens(SPEC)
    monkeypatch.setattr(fst_tokens, "MOST_CELLS", 1)
    texts = ["the cat sat", "on the mat's edge", "again the cat sat"]
    for _ in range(2):
        assert fst_tokens.count_tokens(texts, tokens).tolist() == [len(x) for x in library(texts)]


def test_tables_are_dropped_inside_a_long_word(monkeypatch):
    rng = random.Random(9)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    tokens = fst_tokens.Tokens(SPEC)
    monkeypatch.setattr(fst_tokens, "MOST_STATES", 500)
    monkeypatch.setattr(fst_tokens, "MOST_FITS", 300)
    texts = [word, "some words", word[:5000]]
    assert fst_tokens.count_tokens(texts, tokens).tolist() == [len(x) for x in library(texts)]
    assert len(tokens.entries) <= 1001 and len(tokens.fits) <= 300


def thue_morse(n: int) -> str:
    return "".join("ab"[k.bit_count() % 2] for k in range(n))


def test_words_are_told_apart_by_all_their_bytes():
    encoder = pfor.Encoder(SPEC)
    texts = []
    for n in (8, 16, 17, 32, 1024, 2048, 4096):
        texts += [thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))]
    texts += [" ".join(texts), "a\0", "a", "a\0\0", "\0" * 15, "\0" * 16, "\0" * 17, "é" * 8, "é" * 9]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == library(texts)
        assert [encoder.encode([t])[0].tolist() for t in texts] == library(texts)


def test_equal_hashes_do_not_mix_words(monkeypatch):
    monkeypatch.setattr(pfor, "mixed_bytes", lambda lo, hi, length: lo & np.uint64(7))
    encoder = pfor.Encoder(SPEC)
    texts = ["the cat sat on the mat", "another cat and another mat", "numbers 12 and 34"]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == library(texts)


def test_texts_longer_than_a_run_equal_the_library():
    rng = random.Random(12)
    words = ["the", "model's", " counts", "12345", "naïve", "中文字", "\n\n", "  ", "x" * 40, "!?", "tokens"]
    prose = " ".join(rng.choice(words) for _ in range(480_000))
    texts = ["short", prose, "z" * 300_000]
    assert max(map(len, texts)) > pfor.RUN_CHARACTERS > fst_tokens.BATCH
    want = library(texts)
    assert fst_tokens.count_tokens(texts, TOKENS).tolist() == [len(x) for x in want]
    assert all(a.tolist() == b for a, b in zip(ENCODER.encode(texts), want, strict=True))


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        fst_tokens.Tokens(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_op7(spark, small, documents, odd, none):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in op7_fst_token_counts(spark, small).collect():
        n = len(library([texts[r.doc_id]])[0])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in fst_tokens.token_counts(odd, tokenizer()).collect())
    rows = odd.collect()
    assert got == sorted((r.doc_id is None, r.doc_id or 0, len(x)) for r, x in zip(rows, library([r.text or "" for r in rows]), strict=True))
    assert fst_tokens.token_counts(none, tokenizer()).count() == 0


def test_op8_reads_back_what_the_library_gives(spark, small, documents, odd, none):
    at = 0
    want = []
    for r in sorted(documents.collect(), key=lambda r: r.doc_id):
        ids = [*library([r.text])[0], 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, op8_pfor_token_ids(spark, small).collect())) == want
    got = pfor.token_id_files(odd, tokenizer()).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, len(library([r.text or ""])[0]) + 1) for r in odd.collect())
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    assert all(r.start == min(x.start for x in got if x.doc_id is None) or r.doc_id is not None or r.start > 0 for r in got)
    assert pfor.token_id_files(none, tokenizer()).count() == 0


class Source(io.BytesIO):
    def size(self) -> int:
        return len(self.getbuffer())

    def read_at(self, n: int, at: int) -> bytes:
        return bytes(self.getbuffer()[at : at + n])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, (1 << 32) - 1) | st.integers(0, 300), max_size=3000), max_size=6))
def test_files_round_trip(docs):
    sink = Source()
    w = pfor.Writer(sink)
    for k, ids in enumerate(docs):
        w.add(None if k == 1 else f"name\n{k}", np.array(ids, np.uint32))
    w.close()
    r = pfor.Reader(sink)
    got = list(r.documents(run=1000))
    assert [(n, ids.tolist()) for n, _, ids in got] == [(None if k == 1 else f"name\n{k}", ids) for k, ids in enumerate(docs)]
    flat = [x for ids in docs for x in ids]
    assert r.ids(len(flat) // 3, len(flat) // 2).tolist() == flat[len(flat) // 3 : len(flat) // 2]


def test_outliers_are_exceptions_and_widths_small():
    ids = np.arange(1024, dtype=np.uint32) % 16 + 100_000
    ids[::64] += 1 << 30
    block = pfor.encode_blocks(ids)[0]
    low, width, _, n = pfor.HEAD.unpack_from(block)
    assert (low, width, n) == (100_000, 4, 16) and len(block) == pfor.HEAD.size + 4 * 16 * 8 + 16 * 6
    assert pfor.decode_blocks(block, np.array([0])).tolist() == ids.tolist()


def test_runs_keep_order():
    names, texts = pa.array([1, None, 3]), pa.array(["aa", None, "b"])
    assert [x for part in pfor.runs(names, texts, 2) for x in zip(*part, strict=True)] == [(1, "aa"), (None, ""), (3, "b")]
