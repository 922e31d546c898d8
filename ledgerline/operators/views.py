"""Aggregate views of a log: summary, key index, session table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.prefix import before
from ..schema import INDEX_CAP, SESSION_CAP, SESSION_UNKNOWN, unsigned_order


def summary(log: DataFrame, seg_base: str = "seg_base") -> DataFrame:
    """records, first_seq, last_seq, segments: one row."""
    return log.agg(F.count("*").alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count_distinct(seg_base).alias("segments"))


def key_index(log: DataFrame, key: str = "partition_key") -> DataFrame:
    """key, first_seq, last_seq, records of every key (combined on the map side)."""
    return log.groupBy(key).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("records"))


def capped_index(log: DataFrame, cap: int = INDEX_CAP, key: str = "partition_key") -> DataFrame:
    """The index of the ``cap`` keys that came first; the records of all others are one row of key null.

    The cap is the feature: a top-k by first_seq, then one aggregate.
    """
    index = key_index(log, key)
    first = index.orderBy("first_seq").limit(cap)
    rest = index.join(first.select(key), key, "left_anti").agg(F.lit(None).cast("long").alias(key), F.lit(None).cast("long").alias("first_seq"), F.lit(None).cast("long").alias("last_seq"), F.coalesce(F.sum("records"), F.lit(0)).cast("long").alias("records"))
    return first.unionByName(rest)


def key_range(index: DataFrame, asked: DataFrame, key: str = "partition_key") -> DataFrame:
    """For ``asked(key, from_seq)``: the clamped range of each key; found is false for a key not in the index."""
    i = index.withColumnRenamed(key, "__key")
    rows = asked.join(i, F.col(key).eqNullSafe(F.col("__key")), "left")
    return rows.select(key, "from_seq", F.col("__key").isNotNull().alias("found"), F.when(F.col("__key").isNotNull(), F.greatest("from_seq", "first_seq")).alias("start_seq"), F.col("last_seq").alias("end_seq"))


def session_table(log: DataFrame, cap: int = SESSION_CAP) -> DataFrame:
    """The ``cap`` sessions seen last: session, last_client_seq, last_seq.  Session 0 is no session.

    Client numbers are unsigned.  Exact while marks rise in the log, which admission guarantees.
    """
    return log.where("session <> 0").groupBy("session").agg(unsigned_order(F.max(unsigned_order(F.col("client_seq")))).alias("last_client_seq"), F.max("seq").alias("last_seq")).orderBy(F.desc("last_seq")).limit(cap)


def resume(asked: DataFrame, sessions: DataFrame) -> DataFrame:
    """``asked(session)`` with mark and status: 0, or session unknown.  An id is never made anew."""
    s = sessions.select(F.col("session").alias("__s"), "last_client_seq")
    rows = asked.join(s, F.col("session") == F.col("__s"), "left")
    return rows.select("session", F.col("last_client_seq").alias("mark"), F.when(F.col("__s").isNull(), SESSION_UNKNOWN).otherwise(0).cast("int").alias("status"))


def marks_rise(log: DataFrame) -> DataFrame:
    """Breaks of the invariant behind ``session_table``: rows whose client_seq is not above the session's last."""
    rows = before(log.where("session <> 0"), ["session"], "seq", "client_seq", "before")
    return rows.where(unsigned_order(F.col("client_seq")) <= unsigned_order(F.col("before"))).select("seq", "session", "client_seq", "before")


def evictions(log: DataFrame, cap: int = SESSION_CAP, width: int = 1 << 20) -> DataFrame:
    """evicted, held: how often a full table replaced its least recently seen session, and what it holds at the end.

    The table at any place of the log is the ``cap`` sessions seen last.  So
    the log is cut into ranges of ``width`` records; a range states its own
    last ``cap`` sessions (a partial aggregate), one task composes these in
    order, ``cap`` rows a range, and every range is played in a task of its
    own from the table that it starts with.
    """
    rows = log.where("session <> 0").select("seq", "session", F.floor(F.col("seq") / width).cast("long").alias("range"))
    newest = Window.partitionBy("range").orderBy(F.desc("seq"))
    seen = rows.groupBy("range", "session").agg(F.max("seq").alias("seq")).withColumn("n", F.row_number().over(newest)).where(F.col("n") <= cap).drop("n")

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: dict[int, None] = {}
        current = None
        for pdf in batches:
            for r, s in zip(pdf["range"].tolist(), pdf["session"].tolist(), strict=True):
                if r != current:
                    current = r
                    yield pd.DataFrame({"range": [r], "start": [list(table)]})
                table.pop(s, None)
                table[s] = None
                if len(table) > cap:
                    del table[next(iter(table))]
        yield pd.DataFrame({"range": [None], "start": [list(table)]}).astype({"range": "Int64"})

    starts = seen.repartition(1).sortWithinPartitions("range", "seq").select("range", "session").mapInPandas(compose, "range long, start array<long>")

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        table: dict[int, None] = dict.fromkeys(pdf["start"].iloc[0])
        evicted = 0
        for s in pdf.sort_values("seq")["session"].tolist():
            if s in table:
                del table[s]
            elif len(table) >= cap:
                del table[next(iter(table))]
                evicted += 1
            table[s] = None
        return pd.DataFrame({"evicted": [evicted]})

    played = rows.join(starts, "range").groupBy("range").applyInPandas(play, "evicted long").agg(F.coalesce(F.sum("evicted"), F.lit(0)).alias("evicted"))
    held = starts.where("range IS NULL").agg(F.coalesce(F.max(F.size("start")), F.lit(0)).cast("long").alias("held"))
    return played.crossJoin(held)  # one row each
