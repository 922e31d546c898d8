from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from ledgerline.llm import decontam, mixing, quality_knn, sharding, similar_texts
from tests.llm.conftest import SCHEMA, odd_rows
from tests.llm.test_near_duplicates import connected
from tests.llm.test_sharding_mixing import water


def test_stages_each_do_their_work(spark, small, documents, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mix", "shards"]
    docs, seen = documents, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert out.columns[:5] == documents.columns and (k == 4 or len(out.columns) == 5)
        seen[name] = (docs, out)
        docs = out
    before, after = ({r.doc_id for r in f.collect()} for f in seen["quality"])
    labels = spark.read.parquet(f"{small}/labels.parquet")
    scores = quality_knn.score(documents, quality_knn.fit(documents, labels)).collect()
    assert after == {r.doc_id for r in scores if r.score >= 0.3} and after < before
    before, after = seen["near_duplicates"]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == set(connected(texts).values()) < set(texts)
    before, after = seen["decontamination"]

    def shingles(text, width):
        w = (text or "").encode().lower().split()
        return {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}

    items = [(min(5, len(r.text.split())), r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    items = [(n, shingles(t, n)) for n, t in items if n]
    texts = {r.doc_id: {n: shingles(r.text, n) for n in {n for n, _ in items}} for r in before.collect()}
    held = {d for d, own in texts.items() if any(len(item & own[n]) >= 0.8 * len(item) for n, item in items)}
    assert {r.doc_id for r in after.collect()} == set(texts) - held and held
    before, after = seen["mix"]
    size = {r.doc_id: (r.source, len(r.text.encode().split())) for r in before.collect()}
    sources, taken, copies = defaultdict(int), defaultdict(int), Counter(r.doc_id for r in after.collect())
    for s, n in size.values():
        sources[s] += n
    for d, n in copies.items():
        taken[size[d][0]] += n * size[d][1]
    want = water(sources)
    assert max(copies.values()) <= 2 and sum(abs(taken[s] - want[s]) for s in sources) < 0.08 * sum(want.values())
    before, after = seen["shards"]
    loads, places = defaultdict(int), defaultdict(list)
    for r in after.collect():
        loads[r.shard] += len(r.text.encode()) + 1
        places[r.shard].append(r.place)
    assert sorted(map(tuple, after.select(*documents.columns).collect())) == sorted(map(tuple, before.collect()))
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(loads) == set(range(16))
    assert max(loads.values()) - min(loads.values()) <= 0.06 * sum(loads.values()) / 16
    whole = corpus_pipeline.run(spark, small)
    assert sorted((r.doc_id, r.text_crc32) for r in whole.collect()) == sorted((r.doc_id, r.text_crc32) for r in after.collect())


def test_odd_rows_pass_every_stage(spark, tmp_path, small):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).withColumnRenamed("k", "a name.with `signs`")
    path = str(tmp_path / "sf")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, path)
    assert got.columns[: len(docs.columns)] == docs.columns and {"_size", "_shard", "place"} <= set(got.columns)
    rows = got.collect()
    assert rows and {r["size"] for r in rows} == {"9"} and len({r._shard for r in rows}) > 1
    assert {r.doc_id for r in rows} <= set(range(14)) | {None}
    empty = str(tmp_path / "none")
    docs.where("false").write.parquet(f"{empty}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_the_operators_are_those_of_the_stages():
    assert all(m.__name__.startswith("ledgerline.llm.") for m in (decontam, mixing, quality_knn, sharding, similar_texts))
