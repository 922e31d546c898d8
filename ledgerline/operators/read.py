"""Bounded reads with a snapshot bound, key filter, barrier and terminator."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BEHIND, LAST, NO_HISTORY, Behind, NoHistory, Unsupported


def notify(records: DataFrame) -> DataFrame:
    """What a reader gets of a record: everything that names its writer is left out."""
    return records.select("seq", "record_type", "len", "partition_key", "payload")


def bounds(log: DataFrame) -> tuple[int, int]:
    """(first seq, durable seq); (1, 0) for an empty log."""
    r = log.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    return (1, 0) if r.a is None else (r.a, r.b)


def read(log: DataFrame, key: int | None = None, from_seq: int | None = None, until: int | None = None, key_bounds: tuple[int, int] | None = None, terminator: bool = False) -> DataFrame:
    """Records of ``key`` (None: of all keys) from ``from_seq`` to ``until``, in ascending seq.

    Both bounds and the key reach the scan.  ``key_bounds``, the index entry
    of the key, narrows them, so that sorted storage skips whole files.  A
    key known to be absent is ``(1, 0)``: the plan is empty, nothing is read.
    """
    low = max(from_seq or 1, key_bounds[0] if key_bounds else 1)
    rows = log.where(F.col("seq") >= low)
    high = min((x for x in (until, key_bounds[1] if key_bounds else None) if x is not None), default=None)
    if high is not None:
        rows = rows.where(F.col("seq") <= high)
    if key is not None:
        rows = rows.where(F.col("partition_key") == key)
    if high is not None and high < low:
        rows = rows.where(F.lit(False))
    rows = notify(rows)
    if not terminator:
        return rows.orderBy("seq")
    last = rows.sparkSession.range(1).select(*[F.lit(high if c == "seq" else None).cast(t).alias(c) for c, t in rows.dtypes], F.lit(LAST).alias("flags"))
    return rows.withColumn("flags", F.lit(0)).unionByName(last).orderBy("seq", "flags")


def seek_status(asked: Column, first: Column, durable: Column) -> Column:
    """0, or no history: a reader may stand anywhere retained, or at the next record to come."""
    return F.when((asked < first) | (asked > durable + 1), NO_HISTORY).otherwise(0).cast("int")


def check_seek(asked: int, first: int, durable: int) -> int:
    if not first <= asked <= durable + 1:
        raise NoHistory(f"{asked} is outside {first} to {durable + 1}")
    return asked


def barrier_status(min_seq: Column, durable: Column) -> Column:
    """0 if the log is durable to ``min_seq``, else behind."""
    return F.when(durable >= min_seq, 0).otherwise(BEHIND).cast("int")


def wait_for(min_seq: int, durable: Callable[[], int], ticks: int = 5, tick: float = 0.1) -> int:
    """Poll until the log is durable to ``min_seq``; Behind after ``ticks``."""
    for k in range(ticks + 1):
        if (now := durable()) >= min_seq:
            return now
        if k < ticks:
            time.sleep(tick)
    raise Behind(f"durable to {now}, asked for {min_seq}")


def delete(*_: object) -> None:
    raise Unsupported("records can't be deleted; retention removes whole segments")
