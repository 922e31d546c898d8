"""Captured connection streams as rows, and the statuses that verbs get."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..schema import BAD_OP, NO_SESSION, OK, UNSUPPORTED

FRAMES = "conn long, n long, off long, op string, flags int, record_type int, len long, partition_key long, sequence long, err int, payload binary"
SERVER_ONLY = ("NOTIFY", "ACK", "ERR", "PONG")


def decode(captures: DataFrame, most_payload: int = codec.MOST_PAYLOAD) -> DataFrame:
    """Frames of ``captures(conn, data)``, a row a connection; the first that fails is its last row."""

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in FRAMES.split(", ")])
        for batch in batches:
            for r in batch.to_pylist():
                rows = [{"conn": r["conn"], "n": n} | f | {c: signed(f[c]) for c in ("partition_key", "sequence")} for n, f in enumerate(codec.frames(r["data"] or b"", most_payload))]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return captures.select("conn", "data").mapInArrow(run, FRAMES)


def verb_status(op: Column, has_session: Column) -> Column:
    """0, or the code a whole frame is refused with before any handler looks at it.

    A write needs a session; deleting is understood and not supported; verbs
    that only servers send are bad from a client.
    """
    return F.when(op.isin(*SERVER_ONLY), BAD_OP).when(op == "DELETE", UNSUPPORTED).when((op == "WRITE") & ~has_session, NO_SESSION).otherwise(OK).cast("int")


def requests(frames: DataFrame, session: str = "session") -> DataFrame:
    """REQUEST_SCHEMA rows of the whole WRITE frames of ``frames`` with their connection's session; arrival by (conn, n)."""
    rows = frames.where("op = 'WRITE' AND err = 0")
    return rows.select((F.col("conn") * F.lit(1 << 32) + F.col("n")).alias("arrival"), F.col(session).alias("session"), F.col("sequence").alias("client_seq"), "partition_key", "record_type", "flags", "payload")
