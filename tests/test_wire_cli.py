"""Captured streams, session ids and the command line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.__main__ import main
from ledgerline.functions import codec
from ledgerline.operators import sessions, wire
from ledgerline.schema import BAD_MAGIC, NO_SESSION, UNSUPPORTED
from tests.test_seglog import rows, write


def test_captures(spark):
    hello, w = codec.frame("HELLO", codec.hello()), [codec.frame("WRITE", b"p%d" % k, 3, k, (1 << 64) - 1) for k in (1, 2)]
    data = [(1, hello + w[0] + w[1]), (2, hello + w[0] + b"\0" * 40 + w[1]), (3, w[0]), (4, None), (5, hello + w[0][:-1])]
    got = wire.decode(spark.createDataFrame(data, "conn long, data binary"))
    seen = [(r.conn, r.op, r.err) for r in got.orderBy("conn", "n").collect()]
    assert seen == [(1, "HELLO", 0), (1, "WRITE", 0), (1, "WRITE", 0), (2, "HELLO", 0), (2, "WRITE", 0), (2, None, BAD_MAGIC), (3, "WRITE", NO_SESSION), (5, "HELLO", 0)]
    r = wire.requests(got.withColumn("session", F.lit(7).cast("long"))).orderBy("arrival").collect()
    assert [(x.client_seq, x.payload, x.partition_key) for x in r] == [(1, b"p1", -1), (2, b"p2", -1), (1, b"p1", -1)]


def test_verbs(spark):
    df = spark.createDataFrame([("WRITE", False), ("WRITE", True), ("DELETE", True), ("ACK", True), ("READ", False), ("PING", False)], "op string, s boolean")
    assert [r[0] for r in df.select(wire.verb_status(F.col("op"), F.col("s"))).collect()] == [NO_SESSION, 0, UNSUPPORTED, 3, 0, 0]


def test_session_ids():
    assert sessions.create([], iter([0, 5]).__next__) == 5
    assert sessions.create([-1], iter([(1 << 64) - 1, 9]).__next__) == 9
    assert sessions.create([], lambda: 0) is None


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "log")
    write(spark, path, rows(1, 15))
    assert main(["inspect", path], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["segments 5 records 15 first 1 last 15", "key 2 first 1 last 15 records 8", "key 1 first 2 last 14 records 7"]
    assert main(["retain", path, "--keep", "2"], spark) == 0 and "removed 3" in capsys.readouterr().out
    (tmp_path / "log" / f"{13:020d}.seg").rename(tmp_path / "log" / f"{14:020d}.seg")
    assert main(["inspect", path], spark) == 1 and "error 12" in capsys.readouterr().out
