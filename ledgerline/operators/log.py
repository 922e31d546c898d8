"""The log itself: canonical view, sequence assignment, segment packing, scan rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.prefix import numbered, running
from ..schema import record_size

#: Key and flags of an event type in the canonical log; others are 5 and 3.
EVENT_KEYS = {"click": 1, "error": 2, "purchase": 3, "signup": 4}
EVENT_FLAGS = {"error": 1, "purchase": 7}
PACK_SEGMENTS = 64


def canonical(events: DataFrame) -> DataFrame:
    """The log that an ``events`` table stands for: a record an event, payload its props."""

    def chosen(table: dict[str, int], other: int) -> Column:
        out = F.lit(other)
        for k, v in reversed(table.items()):
            out = F.when(F.col("event_type") == k, F.lit(v)).otherwise(out)
        return out

    rows = numbered(events.select("event_id", "user_id", "event_type", "props"), "event_id", "client_seq", by=["user_id"])
    return rows.select(
        (F.col("event_id") + 1).alias("seq"),
        (F.col("user_id") + 1).alias("session"),
        "client_seq",
        chosen(EVENT_KEYS, 5).cast("long").alias("partition_key"),
        F.lit(1).cast("long").alias("term"),
        F.lit(0).alias("record_type"),
        chosen(EVENT_FLAGS, 3).cast("int").alias("flags"),
        F.octet_length("props").cast("long").alias("len"),
        record_size(F.octet_length("props")).alias("rec_size"),
        "props",
    )


def assign_seq(accepted: DataFrame, start: int = 1, order: str = "arrival") -> DataFrame:
    """``seq`` from ``start`` in order of arrival."""
    return numbered(accepted, order, "seq", start)


def segment_name(base: Column) -> Column:
    return F.concat(F.lpad(base.cast("string"), 20, "0"), F.lit(".seg"))


def segment_base(name: Column) -> Column:
    """The base a file's name states; null unless it is exactly 20 digits and .seg, not 0, and fits 64 bits."""
    digits = F.regexp_extract(name, r"^([0-9]{20})\.seg$", 1)
    number = F.when(F.length(digits) == 20, digits).cast("decimal(20,0)")
    return F.when((number > 0) & (number <= F.lit("18446744073709551615").cast("decimal(20,0)")), number)


def pack(records: DataFrame, capacity: int, seq: str = "seq", size: str = "rec_size", span: int = PACK_SEGMENTS) -> DataFrame:
    """seq, size and ``seg_base`` of every record, packed greedily in order.

    A segment ends before the record that would exceed ``capacity``, so each
    start depends on the one before.  Bytes are cut into chunks of ``span``
    segments.  What passes from chunk to chunk is one number, the byte at
    which the open segment is full; a chunk maps it to the next by its first
    record beyond, and only records in its first ``capacity`` bytes can be
    that.  So chunks state their map as runs of equal results (packings that
    start apart soon fall together), one task composes the maps in order, and
    chunks are packed in parallel from their known start.
    """
    rows = running(records.select(F.col(seq).alias("seq"), F.col(size).alias("size")), [], "seq", F.col("size"), "end")
    rows = rows.withColumn("chunk", F.floor((F.col("end") - F.col("size")) / F.lit(capacity * span)).cast("long"))

    def starts(end, size, first: int) -> Iterator[int]:
        """Places of segment starts from place ``first`` on."""
        k = first
        while k < len(end):
            yield k
            k = int(end.searchsorted(end[k] - size[k] + capacity, side="right"))

    def state(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        end, size = pdf["end"].to_numpy(), pdf["size"].to_numpy()
        full = [0] * len(end)
        for k in range(len(end) - 1, -1, -1):  # the limit at the chunk's end, were a segment to start here
            limit = int(end[k] - size[k]) + capacity
            after = int(end.searchsorted(limit, side="right"))
            full[k] = full[after] if after < len(end) else limit
        head = int(end.searchsorted(end[0] - size[0] + capacity, side="right")) + 1
        out = pd.DataFrame({"chunk": int(pdf["chunk"].iloc[0]), "beyond": end[:head], "limit": full[:head], "top": int(end[-1])})
        last = out["limit"].ne(out["limit"].shift(-1))
        return out[last]

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit, chunk, rows = 0, None, []

        def close() -> Iterator[pd.DataFrame]:
            nonlocal limit
            if rows:
                yield pd.DataFrame({"chunk": [chunk], "limit_in": [limit]})
                if limit < rows[0][2]:
                    limit = next(r[1] for r in rows if r[0] > limit)

        for pdf in batches:
            for c, beyond, full, top in pdf.itertuples(index=False):
                if c != chunk:
                    yield from close()
                    chunk, rows = c, []
                rows.append((beyond, full, top))
        yield from close()

    maps = rows.groupBy("chunk").applyInPandas(state, "chunk long, beyond long, limit long, top long")
    entries = maps.repartition(1).sortWithinPartitions("chunk", "beyond").mapInPandas(compose, "chunk long, limit_in long")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        end, size, seqs = pdf["end"].to_numpy(), pdf["size"].to_numpy(), pdf["seq"].to_numpy()
        base = pd.Series([None] * len(pdf), dtype="Int64")
        for k in starts(end, size, int(end.searchsorted(pdf["limit_in"].iloc[0], side="right"))):
            base.iloc[k] = int(seqs[k])
        return pd.DataFrame({"seq": seqs, "size": size, "start": base})

    labelled = rows.join(entries, "chunk").groupBy("chunk").applyInPandas(label, "seq long, size long, start long")
    return running(labelled, [], "seq", F.col("start"), "seg_base", "max").select("seq", "size", "seg_base")


def packed_segments(packed: DataFrame) -> DataFrame:
    """seg_base, records, bytes of each segment."""
    return packed.groupBy("seg_base").agg(F.count("*").alias("records"), F.sum("size").alias("bytes"))


def scan_prefix(decoded: DataFrame) -> DataFrame:
    """Segments as recovery sees them, from decoded rows (seg_base, off, seq, rec_size, ok).

    In a segment, rows are accepted up to the first that fails its checks or
    breaks the sequence, which starts at the segment's base.  ``torn`` tells
    that something was left.
    """
    place = numbered(decoded, "off", "k", 0, by=["seg_base"])
    good = F.col("ok") & (F.col("seq") == F.col("seg_base") + F.col("k"))
    first_bad = F.min(F.when(~good, F.col("k")))
    per = place.groupBy("seg_base").agg(first_bad.alias("bad"), F.count("*").alias("n"))
    kept = place.join(per, "seg_base")
    inside = F.col("k") < F.coalesce("bad", "n")
    return kept.groupBy("seg_base").agg(
        F.count_if(inside).alias("records"),
        F.max(F.when(inside, F.col("seq"))).alias("last_seq"),
        F.coalesce(F.max(F.when(inside, F.col("off") + F.col("rec_size"))), F.lit(0)).cast("long").alias("end_off"),
        F.max(F.col("bad").isNotNull()).alias("torn"),
    )


def open_check(segments: DataFrame) -> DataFrame:
    """seg_base and status of ``segments`` (a row each): ok, torn_middle, gap or overlap against the one before."""
    order = Window.orderBy("seg_base")
    before, last = F.lag("last_seq").over(order), F.lead("seg_base").over(order).isNull()
    before = F.coalesce(before, F.lag("seg_base").over(order) - 1)
    status = F.when(F.col("torn") & ~last, "torn_middle").when(before.isNull() | (before + 1 == F.col("seg_base")), "ok").when(before + 1 < F.col("seg_base"), "gap").otherwise("overlap")
    return segments.select("seg_base", status.alias("status"))
