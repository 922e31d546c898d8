"""Logs, requests and reports that the queries run on, derived from whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.log import canonical
from ..plans.prefix import numbered
from ..schema import record_size


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(table(spark, sf_dir, "events"))


def documents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, len, rec_size of a log whose payloads are the documents' texts."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("len"))
    return numbered(rows, "doc_id", "seq").select("seq", "len", record_size(F.col("len")).alias("rec_size"))


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of conversations: key conv_id, client_seq turn + 1; one session a conversation."""
    rows = table(spark, sf_dir, "conversations").withColumn("order", F.col("conv_id") * 1024 + F.col("turn"))
    return numbered(rows, "order", "seq").select("seq", (F.col("conv_id") + 1).alias("session"), (F.col("turn") + 1).alias("client_seq"), F.col("conv_id").alias("partition_key"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record once as a request, and every fifth again 37 places later."""
    base = log(spark, sf_dir)
    once = base.select(((F.col("seq") - 1) * 4).alias("arrival"), "session", "client_seq", "partition_key", "flags", "len", F.col("seq").alias("origin"))
    again = base.where((F.col("seq") - 1) % 5 == 0).select(((F.col("seq") + 36) * 4 + 1).alias("arrival"), "session", "client_seq", "partition_key", "flags", "len", F.col("seq").alias("origin"))
    return once.unionByName(again)


def high(rows: DataFrame) -> DataFrame:
    """Client numbers raised by 2^63 - 50, as bit patterns: the 50th of a session is negative as a long."""
    c = F.col("client_seq")
    return rows.withColumn("client_seq", F.when(c >= 50, F.lit(-(1 << 63)) + (c - 50)).otherwise(F.lit((1 << 63) - 50) + c))


def requests_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh write 400 places late."""
    late = (F.col("seq") - 1) % 11 == 0
    arrival = F.when(late, (F.col("seq") + 399) * 4 + 2).otherwise((F.col("seq") - 1) * 4)
    return log(spark, sf_dir).select(arrival.alias("arrival"), "session", "client_seq", F.col("seq").alias("origin"))


def mixed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that meet every refusal: no session, a follower's time, no replicas, large payloads."""
    a = F.col("arrival")
    return requests(spark, sf_dir).select(
        "arrival",
        F.when(a % 97 == 0, F.lit(0)).otherwise(F.col("session")).cast("long").alias("session"),
        "client_seq",
        F.when(a % 13 == 0, F.col("flags").bitwiseOR(F.lit(8))).otherwise(F.col("flags")).cast("int").alias("flags"),
        F.when(a % 89 == 0, F.lit(2_000_000)).otherwise(F.col("len")).cast("long").alias("len"),
        (a % 101 != 0).alias("leader"),
        F.when(a % 5 == 0, 0).otherwise(1).alias("replicas"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seg_base of segments of 500 records each."""
    return log(spark, sf_dir).withColumn("seg_base", F.floor((F.col("seq") - 1) / 500).cast("long") * 500 + 1)


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded rows of segments of 500 records; each third segment has a damaged row, each seventh a wrong seq."""
    rows = segments(spark, sf_dir)
    k, place = F.floor((F.col("seg_base") - 1) / 500), F.col("seq") - F.col("seg_base")
    return rows.select(
        "seg_base",
        (place * 72).alias("off"),
        F.when((k % 7 == 3) & (place == 450), F.col("seq") + 5).otherwise(F.col("seq")).alias("seq"),
        "rec_size",
        (~((k % 3 == 1) & (place == 100 + k))).alias("ok"),
    )


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two replicas by turns; each 50th finds its slot gone."""
    s = F.col("seq")
    return log(spark, sf_dir).select(s.alias("event"), (s % 2).cast("int").alias("slot"), (s % 50 != 0).alias("live"), F.greatest(s - F.when(s % 2 == 0, 5).otherwise(9), F.lit(0)).cast("long").alias("durable"))
