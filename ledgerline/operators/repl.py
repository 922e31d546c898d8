"""Replication: continuity, apply, quorum, degradation, comparison of logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import before, running
from ..schema import ALLOW_DEGRADED, NO_HISTORY, NOT_LEADER, REPLICA_FRAME_BYTES, UNSUPPORTED
from .admit import has
from .log import pack, packed_segments


def frames(records: DataFrame, room: int = REPLICA_FRAME_BYTES) -> DataFrame:
    """seg_base (a frame's first seq), records, bytes of frames that hold whole records."""
    return packed_segments(pack(records, room))


def breaks(records: DataFrame) -> DataFrame:
    """Records that don't continue the one before: seq, before.

    Neighbours meet by an equi join on seq, so nothing is ordered in one task.
    """
    own = records.select("seq").distinct()
    after = own.select((F.col("seq") + 1).alias("seq"))
    first = own.agg(F.min("seq").alias("first"))
    lone = own.join(after, "seq", "left_anti").crossJoin(F.broadcast(first)).where("seq > first")  # one row
    return lone.select("seq")


def apply_prefix(incoming: DataFrame, next_seq: int) -> DataFrame:
    """Rows of ``incoming(arrival, seq, ok)`` that a replica at ``next_seq`` accepts: all before the first failure."""
    rows = running(incoming, [], "arrival", F.lit(1).cast("long"), "__k")
    good = F.col("ok") & (F.col("seq") == F.lit(next_seq - 1) + F.col("__k"))
    bad = rows.where(~F.coalesce(good, F.lit(False))).agg(F.min("__k").alias("__bad"))
    return rows.crossJoin(F.broadcast(bad)).where("__bad IS NULL OR __k < __bad").drop("__k", "__bad")  # one row


def start_status(asked: Column, first: Column, next_seq: Column, follower: Column, full: Column) -> Column:
    """0 or the code that refuses a replica's start."""
    return F.when(follower, NOT_LEADER).when(full, UNSUPPORTED).when((asked < first) | (asked > next_seq), NO_HISTORY).otherwise(0).cast("int")


def quorum(acks: DataFrame, reports: DataFrame, local_durable: int) -> DataFrame:
    """seq, event: the report at which a second copy of ``acks(seq)`` was durable.

    ``reports(event, slot, live, durable)``; what live replicas have reported
    is a running maximum, so the first event that reaches a seq is the least
    of a new maximum at or above it: new maxima and acks are merged by value
    and each ack takes the nearest maximum from above.
    """
    live = running(reports.where("live"), [], "event", F.col("durable"), "best", "max")
    fresh = live.groupBy("best").agg(F.min("event").alias("event"))
    merged = fresh.select(F.col("best").alias("at"), "event", F.lit(None).cast("long").alias("seq")).unionByName(acks.where(F.col("seq") <= local_durable).select(F.col("seq").alias("at"), F.lit(None).cast("long").alias("event"), "seq"))
    # ascending maxima come at ascending events: the nearest from above is the least event from above
    order = merged.withColumn("__o", -(F.col("at") * 2 + F.col("event").isNotNull().cast("long")))
    order = order.groupBy("__o").agg(F.min("event").alias("event"), F.max("seq").alias("seq"))
    found = running(order, [], "__o", F.col("event"), "reached", "min")
    return found.where("seq IS NOT NULL").select("seq", F.col("reached").alias("event"))


def outcome(flags: Column, satisfied: Column) -> Column:
    """ack, degraded or no_replicas for a replicated write at its deadline."""
    return F.when(satisfied, "ack").when(has(flags, ALLOW_DEGRADED), "degraded").otherwise("no_replicas")


def refusals_to_log(attempts: DataFrame) -> DataFrame:
    """Attempts (slot, attempt, code) to log: those whose code differs from the slot's last."""
    return before(attempts, ["slot"], "attempt", "code", "before").where("code <> 0 AND (before IS NULL OR before <> code)").drop("before")


def progress(applied: DataFrame, batch: Column) -> DataFrame:
    """batch, durable: a replica's reports, one for each flush that advanced it."""
    return applied.groupBy(batch.alias("batch")).agg(F.max("seq").alias("durable"))


def further(logs: dict[str, DataFrame]) -> DataFrame:
    """name, last_seq of stopped logs, for choosing which to promote."""
    parts = [log.agg(F.lit(name).alias("name"), F.max("seq").alias("last_seq")) for name, log in logs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """seq, side of records that only one of two logs has."""
    left = a.join(b, "seq", "left_anti").select("seq", F.lit("left").alias("side"))
    return left.unionByName(b.join(a, "seq", "left_anti").select("seq", F.lit("right").alias("side")))
