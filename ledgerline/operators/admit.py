"""Write admission, session dedup and cumulative acknowledgements, as batch forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import running
from ..schema import ACK_REQ, ALLOW_DEGRADED, DEGRADED, NO_REPLICAS, NO_SESSION, NOT_LEADER, OK, PAYLOAD_TOO_BIG, REPLICATED, SYNC, unsigned_order


def marked(requests: DataFrame) -> DataFrame:
    """``requests`` and ``mark``: the greatest client_seq (unsigned) of the session that arrived before (0 if none).

    The rule is a high-water mark, not a set: a number at or below the mark
    is a duplicate even if it never came.  Duplicates never raise the mark.
    """
    rows = running(requests, ["session"], "arrival", unsigned_order(F.col("client_seq")), "mark", "max", inclusive=False)
    return rows.withColumn("mark", F.coalesce(unsigned_order(F.col("mark")), F.lit(0)).cast("long"))


def dedup(requests: DataFrame) -> DataFrame:
    """``requests`` and ``dup``."""
    return marked(requests).withColumn("dup", unsigned_order(F.col("client_seq")) <= unsigned_order(F.col("mark"))).drop("mark")


def has(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) != 0


def admit(requests: DataFrame, leader: bool | Column = True, replicas: int | Column = 1, most_payload: int = 1 << 20) -> DataFrame:
    """``requests`` and ``status``, an error code (0: accepted) or -1 for an acknowledged duplicate.

    Checks stand in this order: session, leadership, replicas, duplicate,
    size.  Only what is appended raises a session's mark, so a refusal must
    not count there: refusals that come before are filtered from the fold.
    """
    leader = leader if isinstance(leader, Column) else F.lit(leader)
    replicas = replicas if isinstance(replicas, Column) else F.lit(replicas)
    flags = F.col("flags")
    refused = (
        F.when(F.col("session").isNull() | (F.col("session") == 0), NO_SESSION)
        .when(~leader, NOT_LEADER)
        .when(has(flags, REPLICATED) & ~has(flags, ALLOW_DEGRADED) & (replicas == 0), NO_REPLICAS)
    )
    rows = requests.withColumn("__refused", refused)
    number = unsigned_order(F.col("client_seq"))
    counted = F.when(F.col("__refused").isNull() & (F.col("len") <= most_payload), number)
    rows = running(rows, ["session"], "arrival", counted, "__mark", "max", inclusive=False)
    status = F.coalesce(
        F.col("__refused"),
        F.when(number <= F.coalesce("__mark", unsigned_order(F.lit(0).cast("long"))), -1),
        F.when(F.col("len") > most_payload, PAYLOAD_TOO_BIG),
        F.lit(OK),
    )
    return rows.withColumn("status", status.cast("int")).drop("__refused", "__mark")


def answer_flags(flags: Column) -> Column:
    """What of the flags asked for an acknowledgement repeats: level bits, never the leave to degrade."""
    return flags.bitwiseAND(F.lit(ACK_REQ | SYNC | REPLICATED))


def cumulative_acks(accepted: DataFrame, batch: Column) -> DataFrame:
    """session, batch, level, client_seq, wal_seq, flags: one acknowledgement a session, flush and level."""
    rows = accepted.where(has(F.col("flags"), ACK_REQ)).withColumn("batch", batch)
    level = F.when(has(F.col("flags"), REPLICATED), "replicated").otherwise("local")
    return rows.groupBy("session", "batch", level.alias("level")).agg(unsigned_order(F.max(unsigned_order(F.col("client_seq")))).alias("client_seq"), F.max("seq").alias("wal_seq"), F.bit_or(answer_flags(F.col("flags"))).cast("int").alias("flags"))


def ack_route(flags: Column, replicas: Column) -> Column:
    """How an acknowledgement goes: none, local, degraded now, or wait for a replica."""
    return F.when(~has(flags, ACK_REQ), "none").when(~has(flags, REPLICATED), "local").when(replicas > 0, "wait").when(has(flags, ALLOW_DEGRADED), "degraded").otherwise("no_replicas")


def level_of(flags: Column) -> Column:
    """Level that an answer counts under, read off its own flags: one that was degraded is what the flush alone gave."""
    return F.when(has(flags, REPLICATED) & ~has(flags, DEGRADED), "replicated").when(has(flags, SYNC), "sync").otherwise("append")


def refusal_text(status: Column, leader: str) -> Column:
    """Text of an answer: a follower that refuses a write names the leader, in 64 bytes at most; others have none."""
    return F.when(status == NOT_LEADER, F.lit(leader.encode()[:MOST_TEXT].decode(errors="ignore"))).otherwise(F.lit(""))


MOST_TEXT = 64
