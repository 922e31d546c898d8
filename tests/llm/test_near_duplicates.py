from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import components, simhash_gph, similar_texts
from ledgerline.llm.queries import op3_gph_simhash
from tests.llm.conftest import prose


def brute_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: dict[int, int], distance: int = 2) -> dict[int, int]:
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_op3_equals_brute_force(spark, small, documents):
    fps = {r.doc_id: brute_fingerprint(r.text) for r in documents.collect()}
    want = brute_components(fps)
    for r in op3_gph_simhash(spark, small).collect():
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])


def test_odd_rows(odd, none):
    got = simhash_gph.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[0].fp == by_id[1].fp == by_id[2].fp == 0 and by_id[2].component_id == 0
    assert by_id[7].component_id == 6 and by_id[3].component_id == 3
    assert all(r.component_id is not None for r in got if r.fp == 0)
    assert simhash_gph.near_duplicates(none).count() == 0


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("hot", [4, 64])
def test_links_connect_dense_clusters_exactly(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash_gph, "HOT", hot)
    rng = random.Random(8)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in components.components(simhash_gph.links(nodes)).collect()}
    got: dict[int, set] = {}
    for x in fps:
        got.setdefault(roots.get(signed(x), signed(x)), set()).add(x)
    want: dict[int, set] = {}
    for i, r in brute_components(dict(enumerate(fps))).items():
        want.setdefault(r, set()).add(fps[i])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_every_allocation_is_complete():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (200, 64)).astype(np.uint8)
    bits[:, 1] = bits[:, 0]
    for distance in (2, 5, 8):
        for m in (2, 3, 5):
            parts = simhash_gph.correlated_partitions(bits, m)
            assert sorted(b for p in parts for b in p) == list(range(64))
            _, t = simhash_gph.allocate(bits, parts, 10**6, distance)
            assert sum(x + 1 for x in t) == distance + 1 and min(t) >= -1
    assert any({0, 1} <= set(p) for p in simhash_gph.correlated_partitions(bits, 4))


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 200), (200, 150), (7, 7), (300, 400), (300, 401), (300, 402)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(51)) and got[200] == got[150] == got[100] == 100 and got[402] == 300 and got[7] == 0
    rounds = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long"), one_task=0).collect()}
    assert rounds == got
    for most in (0, 1 << 18):
        assert components.components(spark.createDataFrame([], "u long, v long"), one_task=most).count() == 0


def jaccard(a: str, b: str) -> float:
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in (a, b)))
    return len(x & y) / len(x | y)


def copies(n: int) -> list[str]:
    rng = random.Random(n)
    base = prose(50, 200).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        out.append(" ".join(w))
    return out


def connected(texts: dict[int, str], similar: float = 0.8) -> dict[int, int]:
    """Least id of each text's group, by brute force."""
    root = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and root[a] != root[b] and jaccard(texts[a], texts[b]) >= similar:
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return root


def by_group(rows) -> list[list[int]]:
    out: dict = {}
    for r in rows:
        out.setdefault(r.group, []).append(r.doc_id)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("members,one_task", [(512, 1 << 18), (4, 0)])
def test_similar_groups(spark, monkeypatch, members, one_task):
    monkeypatch.setattr(similar_texts, "MEMBERS", members)
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    texts = [prose(k, 150) for k in range(20)] + copies(25) + [prose(3, 150).upper(), prose(4, 150) + "  \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want: dict[int, list[int]] = {}
    for k, r in connected(dict(enumerate(texts))).items():
        want.setdefault(r, []).append(k)
    assert by_group(similar_texts.similar_groups(docs).collect()) == sorted(want.values())
    if members > 4:
        kept = {r.doc_id for r in similar_texts.one_of_each_group(docs).collect()}
        assert kept == set(want) and {0, 19} <= kept and not kept & {45, 46}


@pytest.mark.parametrize("members", [512, 2])
def test_fingerprints_alone_find_what_their_index_links(spark, monkeypatch, members):
    monkeypatch.setattr(similar_texts, "bands_of", lambda sets: [(s[:36] >> np.uint64(1)).view(np.int64) ^ int(s.sum() >> np.uint64(8)) for s in sets])  # none in common
    monkeypatch.setattr(similar_texts, "MEMBERS", members)
    words = [prose(k, 900).split() for k in (70, 71, 72)]
    texts = [" ".join(w) for w in words] + [" ".join([*w[:at], "changed", *w[at + 1 :]]) for w in words for at in (100, 500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = {k: brute_fingerprint(t) for k, t in enumerate(texts)}
    linked, similar = brute_components(fps), connected(dict(enumerate(texts)))
    assert len(set(linked.values())) < len(texts)
    want: dict[int, list[int]] = {}
    for k in linked:
        assert similar[k] == similar[linked[k]]
        want.setdefault(linked[k], []).append(k)
    assert by_group(similar_texts.similar_groups(docs).collect()) == sorted(want.values())


def test_a_chain_across_blocks_stays_one_group(spark, monkeypatch):
    monkeypatch.setattr(similar_texts, "MEMBERS", 3)
    words, texts = prose(70, 160).split(), {}
    for k in range(24):  # each differs from the next in a few words, ends of the chain in most
        texts[k] = " ".join(words)
        words[7 * k % 160 : 7 * k % 160 + 7] = prose(700 + k, 7).split()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert set(connected(texts).values()) == {0} and jaccard(texts[0], texts[23]) < 0.3
    assert len(by_group(similar_texts.similar_groups(docs).collect())) == 1


@pytest.mark.parametrize("n", [40, 250, 290, 330, 1500])
def test_bands_of_both_kinds_find_pairs_of_the_least_similarity(n):
    rng = np.random.default_rng(n)
    shared = []
    for _ in range(300):
        a = rng.integers(0, 1 << 64, n, np.uint64)
        b = np.unique(np.concatenate([a, rng.integers(0, 1 << 64, n // 4, np.uint64)]))  # J is 0.8
        x, y = similar_texts.bands_of([np.unique(a), b])
        shared.append(len(np.intersect1d(x, y)))
        assert len(np.intersect1d(x, similar_texts.bands_of([rng.integers(0, 1 << 64, n, np.uint64)])[0])) == 0
    assert min(shared) >= 1 and np.mean(shared) > 10.5  # of 36 bands 11.8 are expected


def test_copies_with_an_added_passage_are_found(spark):
    texts = []
    for k in range(60):
        base = prose(500 + k, 60 + 15 * k)
        texts += [base, base + " " + prose(900 + k, int((60 + 15 * k) * (0.1, 0.16, 0.22)[k % 3]))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r.doc_id: r.group for r in similar_texts.similar_groups(docs).collect()}
    want = {(a, b) for a in group for b in group if a < b and jaccard(texts[a], texts[b]) >= 0.8}
    assert len(want) >= 55 and {(a, b) for a in group for b in group if a < b and group[a] == group[b]} == want


def test_one_of_each_group_of_odd_rows(odd, none):
    kept = similar_texts.one_of_each_group(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    ids = sorted((r.doc_id for r in rows if r.doc_id is not None))
    assert ids.count(3) == 1 and 7 not in ids and 1 not in ids and 0 in ids
    assert sum(r.text is None or not r.text.strip() for r in rows) == 1
    assert similar_texts.one_of_each_group(none).count() == 0


def test_rows_of_one_id_and_names_with_dots(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "other words stand here", "z"), (None, "A b C d e  f", "w"), (2, "a b c d e f", "v"), (3, None, "u"), (4, "", "t")]
    docs = spark.createDataFrame(rows, "`the.id` long, `the text` string, row_hash string")
    kept = similar_texts.one_of_each_group(docs, id_col="the.id", text_col="the text")
    assert kept.columns == docs.columns
    assert sorted((r[0], r[1]) for r in kept.collect()) == [(1, "a b c d e f"), (1, "other words stand here"), (3, None)]


def test_many_copies_make_no_pairs(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one text of some words")).otherwise(F.concat(F.lit("other "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    got = simhash_gph.near_duplicates(docs)
    assert got.where("doc_id % 3 = 0").select("component_id").distinct().count() == 1
