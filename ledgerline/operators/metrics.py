"""Metrics in long form, and their text rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import seconds_text
from ..schema import DEGRADED
from .admit import has, level_of

#: Bounds of the flush histogram in milliseconds, and the label sets that are always complete.
BOUNDS_MS = (0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0)
ACK_LEVELS = ("append", "sync", "replicated")
REFUSALS = {5: "not_leader", 10: "no_replicas", 6: "behind", 11: "no_history", 12: "storage"}


def filled(counts: DataFrame, metric: str, label: Column, labels: Sequence[str]) -> DataFrame:
    """metric, label, value for every one of ``labels``, 0 where nothing was counted."""
    every = counts.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    n = counts.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return every.join(n, "label", "left").select(F.lit(metric).alias("metric"), "label", F.coalesce("n", F.lit(0)).cast("long").alias("value"))


def acks(answers: DataFrame) -> DataFrame:
    """acks_total by the level that was given, read off the answers' flags; degraded ones are counted again apart."""
    by_level = filled(answers, "acks_total", level_of(F.col("flags")), ACK_LEVELS)
    return by_level.unionByName(filled(answers.where(has(F.col("flags"), DEGRADED)), "acks_degraded_total", F.lit(""), [""]))


def gauges(row: DataFrame, values: dict[str, Column]) -> DataFrame:
    """metric, label (none), value of each of ``values`` over a one-row table."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit("").alias("label"), v.cast("long").alias("value")) for k, v in values.items()])
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def refused(statuses: DataFrame) -> DataFrame:
    """refused_total by kind, of ``statuses(status)`` above 0."""
    kind = F.lit("other")
    for code, name in REFUSALS.items():
        kind = F.when(F.col("status") == code, name).otherwise(kind)
    return filled(statuses.where("status > 0"), "refused_total", kind, [*REFUSALS.values(), "other"])


def histogram(values: DataFrame, value: str, metric: str = "fsync_seconds") -> DataFrame:
    """metric, le, value: cumulative buckets of milliseconds, then sum (in nanoseconds) and count; one pass with conditional sums."""
    v = F.col(value)
    sums = [F.count_if(v <= b).alias(f"b{k}") for k, b in enumerate(BOUNDS_MS)]
    nanoseconds = F.round(v * 1_000_000).cast("long")
    row = values.agg(*sums, F.count(v).alias("n"), F.coalesce(F.sum(nanoseconds), F.lit(0)).alias("s"))
    pairs = [F.struct(F.lit(f"{metric}_bucket").alias("metric"), F.lit(f"{b:g}").alias("le"), F.col(f"b{k}").alias("value")) for k, b in enumerate(BOUNDS_MS)]
    pairs += [F.struct(F.lit(f"{metric}_{name}").alias("metric"), F.lit(le).alias("le"), F.col(c).alias("value")) for name, le, c in (("bucket", "+Inf", "n"), ("sum", "", "s"), ("count", "", "n"))]
    return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def flushes(groups: DataFrame) -> DataFrame:
    """flushes_total of ``groups(batch, ...)``: each flush that made something durable."""
    return gauges(groups.agg(F.count_distinct("batch").alias("n")), {"flushes_total": F.col("n")})


def role(spark, leader: bool) -> DataFrame:
    """Both roles, 1 for the one that holds."""
    return spark.createDataFrame([("role", "leader", int(leader)), ("role", "follower", int(not leader))], "metric string, label string, value long")


def log_gauges(summary: DataFrame, capacity: int) -> DataFrame:
    """first, durable and next seq, segments and bytes, from the one-row summary."""
    return gauges(summary, {"first_seq": F.col("first_seq"), "durable_seq": F.col("last_seq"), "next_seq": F.col("last_seq") + 1, "segments": F.col("segments"), "segment_bytes": F.lit(capacity), "wal_bytes": F.col("segments") * capacity})


def writes(admitted: DataFrame) -> DataFrame:
    """writes_total and dedup_hits_total of ``admitted(status)``."""
    row = admitted.agg(F.count_if(F.col("status") == 0).alias("w"), F.count_if(F.col("status") == -1).alias("d"))
    return gauges(row, {"writes_total": F.col("w"), "dedup_hits_total": F.col("d")})


def retention(passes: DataFrame, keep: int, replicas: int) -> DataFrame:
    """Limits, the newest floor and totals, from ``passes(event, floor, removed, failed)``: a row a retention pass."""
    row = passes.agg(F.coalesce(F.max_by("floor", "event"), F.lit(0)).alias("f"), F.coalesce(F.sum("removed"), F.lit(0)).alias("r"), F.count_if("failed").alias("e"))
    return gauges(row, {"retain_segments": F.lit(keep), "replicas_expected": F.lit(replicas), "retain_floor": F.col("f"), "retain_removed_total": F.col("r"), "retain_errors_total": F.col("e")})


def sessions(evictions: DataFrame) -> DataFrame:
    """sessions and sessions_evicted_total of the one row of ``evictions(evicted, held)``."""
    return gauges(evictions, {"sessions": F.col("held"), "sessions_evicted_total": F.col("evicted")})


def followers(peers: DataFrame, now: Column | None = None) -> DataFrame:
    """Of each slot, from its last report: follower_live, follower_durable_seq, and with ``now`` (a time like
    ``peers.at``, in nanoseconds) follower_ack_age_seconds, in nanoseconds, 0 for a report yet to come."""
    kept = ["live", "durable", *(["at"] if now is not None else [])]
    last = peers.groupBy("slot").agg(F.max(F.struct("event", *kept)).alias("r"))
    values = {"follower_live": F.col("r.live").cast("long"), "follower_durable_seq": F.when(F.col("r.live"), F.col("r.durable")).otherwise(0).cast("long")}
    if now is not None:
        values["follower_ack_age_seconds"] = F.greatest(now - F.col("r.at"), F.lit(0)).cast("long")
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col("slot").cast("string").alias("label"), v.alias("value")) for k, v in values.items()])
    return last.select(F.explode(pairs).alias("x")).select("x.*")


def sent(frames: DataFrame) -> DataFrame:
    """repl_records_total of a leader: records in all ``frames(records)`` sent."""
    return gauges(frames.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")), {"repl_records_total": F.col("n")})


def following(applied: DataFrame, connected: bool) -> DataFrame:
    """leader_connected and repl_applied_total of a follower, from the records it applied."""
    return gauges(applied.agg(F.count("*").alias("n")), {"leader_connected": F.lit(int(connected)), "repl_applied_total": F.col("n")})


#: Metrics whose values are nanoseconds here and seconds in the text.
NANOSECONDS = ("follower_ack_age_seconds", "fsync_seconds_sum")


def render(metrics: DataFrame, prefix: str, label_name: str = "label") -> str:
    """Exposition text of a long-form table, whole: a few dozen rows."""
    lines = []
    value = F.when(F.col("metric").isin(*NANOSECONDS), seconds_text(F.col("value"))).otherwise(F.col("value").cast("string"))
    for r in metrics.withColumn("value", value).orderBy("metric", *metrics.columns[1:]).collect():
        label = r[1]
        lines.append(f"{prefix}_{r.metric}" + (f'{{{label_name}="{label}"}}' if label else "") + f" {r.value}")
    return "\n".join(lines) + "\n"
