from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import bloom_lm, decontam, quality_knn
from ledgerline.llm.queries import op2_knn_quality, op4_bloom_lm, op10_minhash_containment, oracle_sql
from ledgerline.llm.text import Words, fold_of, hashed_runs, text_runs
from tests.compare import oracle, same
from tests.llm.conftest import prose


def fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


# -- language model


@pytest.mark.parametrize("table_words", [bloom_lm.TABLE_WORDS, 0])
def test_base_scores_are_exact(spark, small, documents, table_words):
    docs = {r.doc_id: r.text for r in documents.collect()}
    tokens = {i: [*t.encode().lower().split(), 0] for i, t in docs.items()}
    c = Counter(x for i, t in tokens.items() if fold(i) != 1 for x in t)
    n, v = sum(c.values()), len(c)
    rows = (op4_bloom_lm(spark, small) if table_words else bloom_lm.lm_scores(documents, table_words=0)).collect()
    assert len(rows) == len(docs)
    held, base = 0.0, 0.0
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id) == 1, len(t), sum(x in c for x in t), n)
        want = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        assert r.base_score == pytest.approx(want, rel=1e-9) and r.score < 0
        if r.held_out:
            held, base = held + r.score, base + want
    assert held > base  # of texts it has not seen the model expects more than words alone do


def exact_scores(texts: dict, training: set) -> dict:
    """The model's formula on exact counts, quantised as the filter's are, by dictionaries."""
    tokens = {i: [*(t or "").encode().lower().split(), 0] for i, t in texts.items()}
    c = [Counter(), Counter(), Counter()]
    for i in training:
        t = [None, *tokens[i]]
        c[0].update(t[1:])
        c[1].update(zip(t, t[1:], strict=False))
        c[2].update(zip(t, t[1:], t[2:], strict=False))
    level = lambda n: 1 + int(math.log2(n)) if n else 0
    mid = lambda n: 2 ** (level(n) - 0.5) if level(n) > 1 else float(level(n))
    b = [bloom_lm.successor_exponent(Counter(map(level, c[k].values())), len(c[k + 1])) for k in (0, 1)]
    g = sum(n for n in c[2].values() if n > 1) / max(1, sum(c[2].values()))
    n, v = sum(c[0].values()), len(c[0])
    out = {}
    for i, t in tokens.items():
        total = 0.0
        for k, w in enumerate(t):
            p = (mid(c[0][w]) + 0.5) / (n + 0.5 * (v + 1))
            u = t[k - 1] if k else None
            before, pair = mid(c[0][u if k else 0]), mid(c[1][u, w])
            types = max(before, 1.0) ** b[0]
            p = (min(pair, max(before, min(pair, 1))) + types * p) / (before + types)
            context = mid(c[1][t[k - 2] if k > 1 else None, u]) if k else 0.0
            if context:
                triple = c[2][t[k - 2] if k > 1 else None, u, w]
                types = max(context, 1.0) ** b[1]
                triple = min(mid(triple), context) if triple > 1 else 0.0
                p = (triple + (min((1 - g) * context, context - triple) + types) * p) / (context + types)
            total += math.log10(p)
        out[i] = total
    return out


def test_scores_are_those_of_the_exact_model(spark, small, documents, monkeypatch):
    texts = {r.doc_id: r.text for r in documents.collect()}
    want = exact_scores(texts, {i for i in texts if fold(i) != 1})
    got = {r.doc_id: r.score for r in op4_bloom_lm(spark, small).collect()}
    assert sum(abs(got[i] - want[i]) for i in want) < 0.03 * -sum(want.values())
    monkeypatch.setattr(bloom_lm, "BITS_PER_ENTRY", 200)
    got = {r.doc_id: r.score for r in op4_bloom_lm(spark, small).collect()}
    assert all(got[i] == pytest.approx(want[i], rel=2e-3, abs=0.05) for i in want)


def test_texts_that_stand_twice_score_apart(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:60])), "doc_id long, text string")
    rows = {r.doc_id: r.score / r.n_tokens for r in bloom_lm.lm_scores(docs).collect()}
    twice = [rows[k] for k in range(60) if fold(k) != 1 and fold(600 + k) != 1]
    once = sorted(rows[k] for k in range(60, 600))
    assert np.mean([x > once[int(0.95 * len(once))] for x in twice]) > 0.9


def test_filter_holds_levels_and_never_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 64, 20_000, np.uint64)
    counts = rng.integers(1, 5000, 20_000)
    n, bits = 16, 1 << 17
    for kind in bloom_lm.KINDS:
        data = np.zeros(n * bits // 8, np.uint8)
        for s in range(n):
            own = bloom_lm.segment_of(keys, n) == s
            held = {kind: (bloom_lm.keys_in_segment(keys[own], kind), counts[own])}
            data[s * bits // 8 : (s + 1) * bits // 8] = np.frombuffer(bloom_lm.segment_bits(held, bits), np.uint8)
        f = bloom_lm.Filter(data, n, bits)
        got, least = f.counts(keys, kind), bloom_lm.middle(bloom_lm.levels(counts))
        assert (got >= least).all() and (got == least).mean() > 0.95
        assert (f.counts(rng.integers(0, 1 << 64, 20_000, np.uint64), kind) == 0).mean() > 0.9


def test_packed_counts_come_back():
    rng = np.random.default_rng(2)
    for width in (5, 8):
        keys = np.unique(rng.integers(0, 1 << 8 * width - 1, 5000, np.uint64))
        counts = np.where(rng.random(len(keys)) < 0.01, rng.integers(1, 1 << 40, len(keys)), rng.integers(1, 300, len(keys)))
        blob = bloom_lm.pack(keys, counts, width)
        assert all(np.array_equal(a, b) for a, b in zip(bloom_lm.unpack(blob, width), (keys, counts), strict=True))
        twice = bloom_lm.merged([blob, None, blob], width)
        assert np.array_equal(twice[0], keys) and np.array_equal(twice[1], 2 * counts)


def scores(docs):
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in bloom_lm.lm_scores(docs).collect())


def test_a_filter_beyond_the_broadcast_keeps_its_bits(documents, odd, monkeypatch):
    whole = [scores(d) for d in (documents, odd)]
    monkeypatch.setattr(bloom_lm, "MOST_FILTER_BYTES", 1 << 12)
    monkeypatch.setattr(bloom_lm, "CHUNK_BYTES", 1 << 16)
    for docs, want in zip((documents, odd), whole, strict=True):
        got = scores(docs)
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert np.allclose([r[3:] for r in got], [r[3:] for r in want], rtol=1e-9)


def test_keys_stand_by_segment_and_are_probed_in_runs():
    hashes = np.random.default_rng(4).integers(0, 1 << 64, 5000, np.uint64)
    for n in (1, 16, 1973, 100_000):
        segments = bloom_lm.segment_of(np.sort(hashes), n)
        order, names, first = bloom_lm.by_segment(segments, n)
        assert np.array_equal(order, np.argsort(segments, kind="stable"))
        assert np.array_equal(names, np.unique(segments)) and np.array_equal(first, np.unique(segments[order], return_index=True)[1])
    few = hashes % np.uint64(50)
    assert np.array_equal(bloom_lm.distinct(few), np.unique(few)) and np.array_equal(bloom_lm.places(few), np.unique(few, return_inverse=True)[1])
    assert len(bloom_lm.distinct(few[:0])) == len(bloom_lm.places(few[:0])) == len(bloom_lm.runs_of(few[:0])[0]) == 0
    blobs = [b"ab", b"", b"cdef", b"g"]
    assert list(bloom_lm.in_runs(blobs, 3)) == [[b"ab", b"", b"cdef"], [b"g"]] and list(bloom_lm.in_runs([b"", b""], 3)) == [[b"", b""]]


def test_what_segments_are_asked_goes_with_each_pass(spark, documents, monkeypatch):
    """Before, what all chunks asked and all counting tasks sent lay on disk until the end."""
    monkeypatch.setattr(bloom_lm, "MOST_FILTER_BYTES", 1 << 12)
    monkeypatch.setattr(bloom_lm, "CHUNK_BYTES", 1 << 16)
    monkeypatch.setattr(bloom_lm, "ASKED_KEYS", 100)
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    exchanged = lambda: {x.rsplit("/", 1)[-1] for x in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = exchanged()
    out = bloom_lm.lm_scores(documents)
    assert not exchanged() - before
    assert out.count() == documents.count()


def test_segments_beyond_one_exchange_hold_the_same(documents, monkeypatch):
    monkeypatch.setattr(bloom_lm, "SEGMENT_BYTES", 1 << 13)
    want = scores(documents)
    monkeypatch.setattr(bloom_lm, "FAN", 5)
    monkeypatch.setattr(bloom_lm, "HELD_ENTRIES", 5000)
    assert np.allclose([r[1:] for r in scores(documents)], [r[1:] for r in want], rtol=1e-9)


def test_lm_of_odd_rows(odd, none):
    got = bloom_lm.lm_scores(odd).collect()
    assert len(got) == odd.count() and sum(r.n_tokens == 1 for r in got) == 4
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert bloom_lm.lm_scores(none).count() == 0
    only = odd.where(fold_of(odd.doc_id) == 1)
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in bloom_lm.lm_scores(only).collect())


# -- quality


def test_held_out_quality(spark, documents):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op2_knn_quality(spark, sf).collect()]
    assert all(r.held_out == (fold(r.doc_id) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_scores_are_those_of_all_cosines():
    texts = [prose(k, 40) if k % 2 else "JUNK!! " * (k + 5) for k in range(60)]
    own = [np.unique(r, return_counts=True) for r in quality_knn.terms_of([t.encode() for t in texts])]
    y = np.array([k % 2 for k in range(60)])
    x = quality_knn.SparseTerms(np.cumsum([0] + [len(a) for a, _ in own]), np.concatenate([a for a, _ in own]), np.concatenate([b for _, b in own]))
    v = quality_knn.Voters.fit(x, y, 16)
    rows = quality_knn.terms_of([t.encode() for t in ("JUNK!! JUNK!!", prose(77, 30), "", "9")])
    got = v.scores(rows, 7)
    z = v.vectors_of(rows)
    for k in range(3):
        s = z[k] @ v.vectors.T
        at = np.argsort(-s, kind="stable")[:7]
        w = np.clip(s[at], 0, 1).astype(float) ** quality_knn.SHARPNESS
        want = (w * v.labels[at]).sum() / w.sum() if w.sum() > 1e-6 else v.prior
        assert got[k] == pytest.approx(want, abs=1e-3)
    assert got[0] < 0.1 and got[1] > 0.9 and got[2] == pytest.approx(v.prior)


def test_equal_neighbours_count_in_their_order(spark):
    vectors = np.repeat(quality_knn.unit(np.random.default_rng(5).standard_normal((1, 40)).astype(np.float32)), 5000, axis=0)
    for first in (0, 1):
        labels = np.where(np.arange(5000) < 30, first, 1 - first).astype(np.float32)
        v = quality_knn.Voters(np.ones(quality_knn.TERMS, np.float32), np.zeros((quality_knn.TERMS, 40), np.float32), vectors, labels, 0.5)
        v.vectors_of = lambda rows: vectors[: len(rows)] * 1.0
        assert v.scores([None] * 9).round(6).tolist() == [float(first)] * 9  # 25 of the first 30
    text = "some words that stand here"
    docs = spark.createDataFrame([(k, text) for k in range(60)] + [(3, "another text of this id")], "doc_id long, text string")
    order = sorted(map(str, range(60)))
    labels = spark.createDataFrame([(int(d), int(k >= 30)) for k, d in enumerate(order)], "doc_id long, quality int")
    voters = quality_knn.fit(docs, labels, held_out_fold=None)
    assert len(voters.labels) == 60
    scores = {r.doc_id: r.score for r in quality_knn.score(docs.where(docs.text == text), voters).collect()}
    assert max(scores.values()) < 1e-6


def test_accepted_rows_are_those_that_score_enough(spark, documents, small):
    voters = quality_knn.fit(documents, spark.read.parquet(f"{small}/labels.parquet"))
    want = {r.doc_id for r in quality_knn.score(documents, voters).collect() if r.score >= 0.5}
    got = quality_knn.accepted(documents.withColumnRenamed("lang", "a.b"), voters, 0.5)
    assert "a.b" in got.columns and {r.doc_id for r in got.collect()} == want


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(12)] + [(None, 1, None), (5, None, None), (4, 0, None)], "doc_id long, quality int, toxic int")
    got = quality_knn.quality_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_knn.quality_scores(none, labels).count() == 0
    alone = quality_knn.quality_scores(odd, labels.where("false")).collect()
    assert {r.score for r in alone} == {0.5}


# -- decontamination


def test_op10_equals_sql(spark, small):
    same(op10_minhash_containment(spark, small).toPandas(), oracle(small, oracle_sql()["op10_minhash_containment"]))


def test_items_of_all_sizes_at_any_place(spark):
    rng = random.Random(6)
    items = [(k, prose(1000 + k, n)) for k, n in enumerate([1, 2, 4, 5, 6, 9, 17, 40, 130, 400])] + [(50, None), (51, ""), (7, prose(1007, 40))]
    docs, want = [], set()
    for k in range(200):
        body = prose(k, rng.choice([0, 3, 50, 3000])).split()
        if k % 2:
            i, text = items[k % 10]
            words = text.split()
            if len(words) > 30 and k % 4 == 1:
                words[3] = "changed"  # a word in a long item: containment stays above 0.8
            at = rng.randint(0, len(body))
            body[at:at] = words
        docs.append((k, " ".join(body) if k % 11 else (" ".join(body).upper() or None)))

    def shingles(text, width):
        w = (text or "").lower().split()
        return {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}

    for d, text in docs:
        for i, item in items:
            width = min(5, len((item or "").split()))
            own = shingles(item, width) if width else set()
            if own and len(own & shingles(text, width)) / len(own) >= 0.8:
                want.add((d, i))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contained_items(*frames).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) + sum(i == 7 for _, i in want)
    clean = decontam.without_items(*frames)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_blocks_of_items_find_the_same(spark, small, documents, monkeypatch):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    whole = sorted(map(tuple, decontam.contained_items(documents, items).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 20_000)
    assert sorted(map(tuple, decontam.contained_items(documents, items).collect())) == whole and whole
    kept = {r.doc_id for r in decontam.without_items(documents, items).collect()}
    assert kept == {r.doc_id for r in documents.select("doc_id").collect()} - {r[0] for r in whole}
    again = items.unionByName(items.selectExpr("item_id + 100000 AS item_id", *[c for c in items.columns if c != "item_id"]))
    assert len(list(decontam.item_blocks(decontam._keyed(again, "item_id", "text")))) == len(list(decontam.item_blocks(decontam._keyed(items, "item_id", "text"))))
    assert decontam.contained_items(documents, again).count() == 2 * len(whole)


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, prose(1, 30)), (2, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.contained_items(odd, items).collect()) == [6, 7]
    clean = decontam.without_items(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 2
    assert decontam.contained_items(none, items).count() == 0
    assert decontam.contained_items(odd, items.where("false")).count() == 0 and decontam.without_items(odd, items.where("false")).count() == odd.count()


def test_words_of_a_run_are_those_of_each_text():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "B", "é", "中", " ", "  ", "\t", "\n", "\x0b", "\x1f", "\x85", "\0", "x" * 17]) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "", " "]
    hashes: dict[bytes, int] = {}
    for run, own in ((r, Words.of(r)) for r in text_runs(texts, 500)):
        for text, row in zip(run, own.split(own.hashes()), strict=True):
            assert len(row) == len(text.split())
            assert all(hashes.setdefault(w, h) == h for w, h in zip(text.lower().split(), row.tolist(), strict=True))
    assert len(set(hashes.values())) == len(hashes) and sum(len(r) for r in hashed_runs(texts)) == len(texts)


def test_shapes():
    def shape(w):
        w = re.sub(rb"[A-Z]+", b"A", re.sub(rb"[a-z\x80-\xff]+", b"a", w))
        return re.sub(rb"[0-9]+", b"9", w)[:12]

    words = ["abc", "Abc", "ABC", "a1", "12.5", "é", "!!", "!!!", "x-y-z-x-y-z-x-y", "x-y-z-x-y-z-x", "aé1A", "中", "b2"]
    own = Words.of([" ".join(words).encode()])
    seen = dict(zip(words, quality_knn.shape_hashes(own).tolist(), strict=True))
    assert all((seen[a] == seen[b]) == (shape(a.encode()) == shape(b.encode())) for a in words for b in words)
