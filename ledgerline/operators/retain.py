"""Retention: whole leading segments go, under a count and a replica floor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.prefix import running, runnings
from .views import session_table

MOST_SLOTS = 64


def mark(segments: DataFrame, keep: int) -> DataFrame:
    """One row, keep_from: base of the oldest of the newest ``keep`` segments; 0 if there are no more than that."""
    newest = segments.select("seg_base").distinct().orderBy(F.desc("seg_base")).limit(keep + 1)
    found = newest.agg(F.count("*").alias("n"), F.sort_array(F.collect_list("seg_base"), asc=False).alias("b"))
    return found.select(F.when(F.col("n") > keep, F.get("b", F.lit(keep - 1))).otherwise(0).cast("long").alias("keep_from"))


def drop(segments: DataFrame, keep_from: DataFrame) -> DataFrame:
    """seg_base of the segments that go: their successor starts at or below keep_from; the active one stays."""
    following = F.lead("seg_base").over(Window.orderBy("seg_base"))  # a row a segment
    rows = segments.select("seg_base").distinct().withColumn("next_base", following)
    return rows.crossJoin(F.broadcast(keep_from.select("keep_from"))).where("next_base <= keep_from").select("seg_base")  # one row


def floor(peers: DataFrame, wanted: int) -> DataFrame:
    """event, floor: the least durable seq of live replicas while ``wanted`` are live; it never falls.

    ``peers(event, slot, live, durable)`` are reports; a slot's last report
    stands until its next.  More than ``MOST_SLOTS`` slots are refused.
    """
    slots = [r.slot for r in peers.select("slot").distinct().orderBy("slot").limit(MOST_SLOTS + 1).collect()]
    if len(slots) > MOST_SLOTS:
        raise ValueError(f"reports of more than {MOST_SLOTS} replicas")
    if not slots:
        return peers.select("event", F.lit(0).cast("long").alias("floor"))
    reports = {f"s{k}": F.when(F.col("slot") == s, F.struct("event", "live", "durable")) for k, s in enumerate(slots)}
    rows = runnings(peers, [], "event", reports, "max")
    state = [F.when(F.col(f"{c}.live"), F.col(f"{c}.durable")) for c in reports]
    live = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in state), F.lit(0))
    least = F.least(*state) if len(state) > 1 else state[0]
    now = rows.select("event", F.when(live >= wanted, least).alias("now"))
    return running(now, [], "event", F.col("now"), "floor", "max").select("event", F.coalesce("floor", F.lit(0)).cast("long").alias("floor"))


def retain(segments: DataFrame, keep: int, floor_seq: int | None = None) -> DataFrame:
    """seg_base of what one retention pass drops: under the mark, and under the floor where replicas are wanted."""
    limit = mark(segments, keep)
    if floor_seq is not None:
        limit = limit.select(F.least("keep_from", F.lit(floor_seq + 1)).alias("keep_from"))
    return drop(segments, limit)


def forgotten(log: DataFrame, first_kept: int) -> DataFrame:
    """Sessions without a record left once the log starts at ``first_kept``."""
    kept = session_table(log.where(F.col("seq") >= first_kept), cap=1 << 30)
    return log.where("session <> 0").select("session").distinct().join(kept, "session", "left_anti")
