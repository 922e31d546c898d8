"""Segments on disk: packing, recovery rules, pushdown, retention, streams."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import codec
from ledgerline.operators import log
from ledgerline.schema import Behind, LogCorrupt, NoHistory, unsigned_order, unsigned_text
from ledgerline.sources import seglog
from ledgerline.streaming import log_streams

SCHEMA = "crc long, len long, term long, seq long, session long, client_seq long, record_type int, flags int, partition_key long, payload binary"


def rows(first, n, session=1):
    return [(0, 24, 1, k, session, k, 0, 3, 1 + k % 2, b"Z" * 24) for k in range(first, first + n)]


def write(spark, path, data, capacity=240):
    seglog.register(spark)
    spark.createDataFrame(data, SCHEMA).coalesce(1).sortWithinPartitions("seq").write.format("seglog").option("capacity", capacity).mode("append").save(path)


def bases(path):
    return [b for b, _ in seglog.segments(path)]


def test_packing_recovery_and_filters(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, rows(1, 10))
    assert bases(path) == [1, 4, 7, 10]
    df = seglog.open_log(spark, path)
    assert [r.seq for r in df.orderBy("seq").collect()] == list(range(1, 11))
    assert [r.seq for r in df.where("seq >= 5 AND seq < 8").orderBy("seq").collect()] == [5, 6, 7]
    assert df.where("seq >= 7").rdd.getNumPartitions() == 2  # by names alone
    narrow = spark.read.format("seglog").option("payload", "false").load(path)
    assert "payload" not in narrow.columns and narrow.count() == 10
    for name in ("notasegment", "00000000000000000001.seg.tmp", "0000000000000000000x.seg", "00000000000000000000.seg", "18446744073709551617.seg"):
        (tmp_path / "log" / name).write_bytes(b"decoy")
    assert bases(path) == [1, 4, 7, 10]


def test_append_continues_or_refuses(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, rows(1, 3))
    with pytest.raises(Exception, match="does not continue"):
        write(spark, path, rows(5, 2))
    assert bases(path) == [1] and not [n for n in os.listdir(path) if n.endswith(".tmp")]
    write(spark, path, rows(4, 2))
    assert bases(path) == [1, 4]


def test_damage(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, rows(1, 8))
    files = [f for _, f in seglog.segments(path)]
    last = bytearray(open(files[-1], "rb").read())
    last[100] ^= 1  # in the second record of the last segment
    open(files[-1], "wb").write(last)
    assert seglog.open_log(spark, path).count() == 7
    s = {r.seg_base: r for r in seglog.summaries(spark, path).collect()}
    assert s[7].torn and s[7].records == 1 and s[7].end_off == 80
    write(spark, path, rows(8, 1))  # the torn end goes before a new segment follows
    assert not seglog.trim_torn_tail(path)
    assert bases(path) == [1, 4, 7, 8] and seglog.open_log(spark, path).count() == 8
    open(seglog.segments(path)[-1][1], "wb").write(b"\1" * 80)  # a segment of which nothing is whole
    write(spark, path, rows(8, 2))
    assert bases(path) == [1, 4, 7, 8] and seglog.open_log(spark, path).count() == 9
    middle = bytearray(open(files[1], "rb").read())
    middle[200] ^= 1
    open(files[1], "wb").write(middle)
    with pytest.raises(LogCorrupt, match="torn_middle|gap"):
        seglog.open_log(spark, path)
    os.remove(files[1])
    with pytest.raises(LogCorrupt, match="gap"):
        seglog.open_log(spark, path)


def test_retention_of_files(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, rows(1, 15))
    assert seglog.retain(path, 7) == 2 and bases(path) == [7, 10, 13]
    assert seglog.retain(path, 1000) == 2 and bases(path) == [13]


def test_streams(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, rows(1, 6))
    seen = log_streams.subscribe(spark, path, 3, key=1)

    def drain(df, name, **options):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.seq for r in spark.sql(f"SELECT seq FROM {name}").collect())

    assert drain(seen, "first") == [4, 6]
    replica = str(tmp_path / "replica")
    os.makedirs(replica)
    raw = spark.readStream.format("seglog").option("fromSeq", 1).load(path)
    q = raw.writeStream.foreachBatch(log_streams.apply_batches(replica, 240)).option("checkpointLocation", str(tmp_path / "r")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seglog.open_log(spark, replica).count() == 6
    seglog.retain(path, 4)
    with pytest.raises(Exception, match="retained away"):
        drain(log_streams.subscribe(spark, path, 1), "late")


def test_a_batch_of_the_admission_may_run_again(spark, tmp_path):
    path, answers = str(tmp_path / "log"), str(tmp_path / "answers")
    schema = "arrival long, session long, client_seq long, partition_key long, record_type int, flags int, payload binary, status int"
    first = spark.createDataFrame([(k, 5, c, 1, 0, 3, b"x", s) for k, (c, s) in enumerate([(1, 0), (2, 0), (2, -1), (4, 0), (3, -1)])], schema)
    run = log_streams.append_batches(path, answers)
    run(first, 0)
    run(first, 0)
    run(first.withColumn("client_seq", F.col("client_seq") + 10), 1)
    got = seglog.open_log(spark, path).orderBy("seq").collect()
    assert [(r.seq, r.client_seq) for r in got] == [(1, 1), (2, 2), (3, 4), (4, 11), (5, 12), (6, 14)]
    told = spark.read.parquet(answers).where("batch = 0").orderBy("arrival").collect()
    assert [(r.status, r.seq) for r in told] == [(0, 1), (0, 2), (-1, None), (0, 3), (-1, None)]


def test_index_skips_bytes_and_is_not_needed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    write(spark, path, rows(1, 30), capacity=1 << 20)
    (_, file), = seglog.segments(path)
    assert seglog.load_index(path, file)[0] == 30
    monkeypatch.setattr(seglog, "STRIDE", 4)
    open(seglog.index_of(file), "wb").write(seglog.INDEX.pack(30, 2400) + b"".join((k * 80).to_bytes(8, "little") for k in range(0, 30, 4)))  # the writer's stride is longer
    read = []
    load = seglog.load
    monkeypatch.setattr(seglog, "load", lambda p, f, a=0, b=None: read.append((f, a, b)) or load(p, f, a, b))

    def seqs(low, high):
        read.clear()
        part = seglog.Segment(1, file, None, low, high)
        return [x for b in seglog.batches(path, part, ["seq", "off"]) for x in zip(*b.to_pydict().values(), strict=True)]

    for low, high in ((1, None), (1, 3), (9, 10), (13, 28), (30, 30), (31, 40), (4, 5)):
        want = [(k, (k - 1) * 80) for k in range(low, min(high or 30, 30) + 1)]
        assert seqs(low, high) == want
        if (low, high) == (9, 10):
            assert (file, 640, 960) in read
        os.rename(seglog.index_of(file), str(tmp_path / "away"))
        assert seqs(low, high) == want
        os.rename(str(tmp_path / "away"), seglog.index_of(file))
    data = open(file, "rb").read()
    open(file, "wb").write(data[:-8])  # the index is of another size now
    assert seqs(20, None) == [(k, (k - 1) * 80) for k in range(20, 30)] and seglog.next_seq(path) == 30


def test_a_bounded_reader_keeps_its_bound_after_a_restart(spark, tmp_path):
    path, out = str(tmp_path / "log"), []
    write(spark, path, rows(1, 20))
    progress = str(tmp_path / "at")

    def drain():
        stream = log_streams.subscribe(spark, path, 1, most=6, progress=progress)
        q = stream.writeStream.foreachBatch(lambda b, n: out.append(sorted(r.seq for r in b.collect()))).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()

    drain()
    assert out == [list(range(1, 7)), list(range(7, 13)), list(range(13, 19)), [19, 20]]
    write(spark, path, rows(21, 40))
    drain()
    assert sum(out, []) == list(range(1, 61)) and max(map(len, out)) <= 12


def test_deadlines_by_the_clock(spark, tmp_path):
    schema = "seq long, at timestamp, kind string, flags int"
    spark.createDataFrame([(1, None, "write", 12), (2, None, "write", 4), (3, None, "write", 4), (3, None, "durable", 0)], schema).withColumn("at", F.current_timestamp()).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = log_streams.deadline_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 500, "processing")
    q = stream.writeStream.format("memory").queryName("waits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(100):
            got = {(r.seq, r.outcome) for r in spark.sql("SELECT * FROM waits").collect()}
            if len(got) == 3:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert got == {(1, "degraded"), (2, "no_replicas"), (3, "ack")}


def test_stateful_dedup_equals_batch_form(spark, tmp_path):
    from ledgerline.operators.admit import dedup

    data = [(k, k % 3, (k * 7) % 11 + k // 5) for k in range(120)]
    for part in range(2):
        spark.createDataFrame(data[part * 60 : part * 60 + 60], "arrival long, session long, client_seq long").coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema("arrival long, session long, client_seq long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = log_streams.dedup_stream(stream).writeStream.format("memory").queryName("dedup").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.arrival, r.dup) for r in spark.sql("SELECT * FROM dedup").collect()}
    batch = spark.createDataFrame(data, "arrival long, session long, client_seq long")
    assert got == {(r.arrival, r.dup) for r in dedup(batch).collect()}


def test_greedy_packing_equals_a_fold(spark):
    import random

    random.seed(7)
    sizes = [56 + 8 * random.randint(0, 40) for _ in range(3000)]
    want, used, base = [], 1 << 60, 0
    for k, s in enumerate(sizes, 1):
        if used + s > 1000:
            base, used = k, 0
        used += s
        want.append((k, base))
    df = spark.createDataFrame(list(enumerate(sizes, 1)), "seq long, rec_size long")
    for span in (1, 3, 64):
        assert [(r.seq, r.seg_base) for r in log.pack(df, 1000, span=span).orderBy("seq").collect()] == want


def test_barrier_and_bounds():
    from ledgerline.operators import read

    assert read.wait_for(3, iter([1, 2, 3]).__next__, tick=0) == 3
    with pytest.raises(Behind):
        read.wait_for(9, lambda: 1, ticks=2, tick=0)
    assert read.check_seek(11, 1, 10) == 11
    with pytest.raises(NoHistory):
        read.check_seek(12, 1, 10)


def test_unsigned(spark):
    df = spark.createDataFrame([(-1,), (0,), (1 << 62,), (-(1 << 63),)], "x long")
    got = [r.t for r in df.orderBy(unsigned_order(F.col("x"))).select(unsigned_text(F.col("x")).alias("t")).collect()]
    assert got == ["0", str(1 << 62), str(1 << 63), str((1 << 64) - 1)]


def test_running_is_a_window(spark):
    from ledgerline.plans.prefix import numbered, running

    df = spark.createDataFrame([(k % 3, k * 5, (k * 37) % 50) for k in range(200)], "g long, o long, v long")
    got = running(df, ["g"], "o", F.col("v"), "r", "max", inclusive=False, width=64)
    want = df.selectExpr("g", "o", "v", "max(v) OVER (PARTITION BY g ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert [r.n for r in numbered(df, "o", "n", 5, width=64).orderBy("o").collect()] == list(range(5, 205))


def test_codec_scan_rate_is_vectorised():
    from tests.test_codec import record

    data = b"".join(codec.encode([record(k) for k in range(1, 2001)]))
    assert len(codec.scan(data, 1).headers) == 2000
