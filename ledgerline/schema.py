"""Schemas, flags, codes and limits of the log, and unsigned 64-bit helpers.

Spark has no unsigned types: 64-bit ids are kept as their bit pattern in a
long.  Equality and grouping need nothing more; where order matters, compare
``unsigned_order`` of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_SCHEMA = "crc long, len long, term long, seq long, session long, client_seq long, record_type int, flags int, partition_key long, payload binary"
SCAN_SCHEMA = LOG_SCHEMA + ", seg_base long, off long, rec_size long"
REQUEST_SCHEMA = "arrival long, session long, client_seq long, partition_key long, record_type int, flags int, payload binary"
ACK_SCHEMA = "session long, batch long, client_seq long, wal_seq long, flags int"
SEGMENT_SCHEMA = "seg_base long, records long, last_seq long, end_off long, torn boolean"
KEY_INDEX_SCHEMA = "partition_key long, first_seq long, last_seq long, records long"
SESSION_SCHEMA = "session long, last_client_seq long, last_seq long"
PEER_SCHEMA = "event long, slot int, live boolean, durable long"

# fixed values: flags of a request or response
ACK_REQ, SYNC, REPLICATED, ALLOW_DEGRADED, DEGRADED, LAST, ALL_KEYS = 1, 2, 4, 8, 16, 32, 64
# fixed values: error codes of a response
OK, BAD_MAGIC, BAD_VERSION, BAD_OP, PAYLOAD_TOO_BIG, NOT_LEADER, BEHIND, NO_SESSION, SESSION_UNKNOWN, UNSUPPORTED, NO_REPLICAS, NO_HISTORY, STORAGE = range(13)
# fixed values: sizes
HEADER_BYTES = 56
MOST_PAYLOAD = 1 << 20
FRAME_HEADER_BYTES = 32
REPLICA_FRAME_BYTES = 16 * 1024 - FRAME_HEADER_BYTES
INDEX_CAP = SESSION_CAP = 1024


def unsigned_order(x: Column) -> Column:
    """A signed long in the order of the unsigned values."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def unsigned_text(x: Column) -> Column:
    """The unsigned decimal of a bit pattern."""
    wide = x.cast("decimal(20,0)")
    return F.when(x < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)").cast("string")


def unsigned_pattern(x: int) -> int:
    """The long with the bits of the unsigned ``x``."""
    return x - (1 << 64) if x >> 63 else x


def record_size(length: Column) -> Column:
    """Bytes of a record on disk: header, payload, padding to 8; null for a length out of range."""
    return F.when(length.between(0, MOST_PAYLOAD), F.lit(HEADER_BYTES) + F.floor((length + 7) / 8) * 8).cast("long")


class LogError(Exception):
    """A refusal; ``code`` is the response's error code."""

    code = STORAGE


class LogCorrupt(LogError):
    """The log can't be opened: a gap, an overlap or damage before its end."""


class NoHistory(LogError):
    """The position asked for is not retained, or not yet written."""

    code = NO_HISTORY


class Behind(LogError):
    """The log is not yet durable to the position asked for."""

    code = BEHIND


class Unsupported(LogError):
    """A verb that the log does not have, such as deleting records."""

    code = UNSUPPORTED
