"""Sharding through fixed virtual slots.

Every record hashes to one of a fixed number of virtual slots.  A record's
shard is what the slot-to-shard map says, so moving data means editing a map
of a few thousand rows and never rehashing records.  The map is versioned:
a run loads the newest stored version, rebalances it for the bytes that it
finds in the slots, and stores the edit, with the slots that it moved, as the
next version; versions are never overwritten.

A record's slot hashes its id.  An id whose records weigh more than a mean
slot would keep one slot, and so one shard, too full: records of such hot ids
hash their text and place in the table as well.  There are at most as many
hot ids as slots.

Plan: one scan gives (id, size, hash), which is written; partial aggregation
gives bytes and rows of each slot (``n_slots`` rows reach the driver); the map
is edited there; rows join the broadcast map and are numbered inside parts of
slots of about ``PART_ROWS`` rows.  Places in a shard are offsets of parts
plus numbers inside them, so no task ever holds a shard, or a slot that is
too large.  With ``keep`` all columns move to the shards in that exchange.

Defined results: a null text counts 0 bytes, an empty one too (size 1); rows
with null id hash by text; repeated rows get places of their own (which of
equal rows gets which is open); an empty table gives no rows; columns of
``docs`` may have any name, result columns that clash get underscores before.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import hadoop, small, written
from .text import col, fresh, text_crc32, utf8_bytes

N_SLOTS = 8192
#: Rows of a slot that are numbered together.
PART_ROWS = 1 << 18


@dataclass(frozen=True)
class SlotMap:
    """Version ``version`` of the map: ``shard_of[slot]``, and the slots moved by its last edit."""

    n_shards: int
    shard_of: tuple[int, ...]
    version: int = 1
    moved: tuple[int, ...] = field(default=())

    @classmethod
    def initial(cls, n_slots: int = N_SLOTS, n_shards: int = 16) -> SlotMap:
        """Slots dealt round to shards."""
        return cls(n_shards, tuple(s % n_shards for s in range(n_slots)))

    def edited(self, shard_of: list[int], n_shards: int) -> SlotMap:
        moved = tuple(s for s, (a, b) in enumerate(zip(self.shard_of, shard_of, strict=True)) if a != b)
        return SlotMap(n_shards, tuple(shard_of), self.version + 1, moved)

    def loads(self, slot_bytes: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += slot_bytes[slot]
        return out

    def rebalanced(self, slot_bytes: list[int]) -> SlotMap:
        """Move slots from the fullest to the emptiest shard while that brings the two closer.

        Of the fullest shard's slots the one nearest half the difference moves.
        Each move lowers the sum of squared loads, so the loop ends.
        """
        shard_of, loads = list(self.shard_of), self.loads(slot_bytes)
        members: list[set[int]] = [set() for _ in range(self.n_shards)]
        for slot, shard in enumerate(shard_of):
            if slot_bytes[slot]:
                members[shard].add(slot)
        while True:
            full = max(range(self.n_shards), key=lambda s: (loads[s], s))
            least = min(range(self.n_shards), key=lambda s: (loads[s], s))
            gap = loads[full] - loads[least]
            fits = [s for s in members[full] if slot_bytes[s] < gap]
            if not fits:
                break
            slot = min(fits, key=lambda s: (abs(2 * slot_bytes[s] - gap), s))
            members[full].remove(slot)
            members[least].add(slot)
            shard_of[slot] = least
            loads[full] -= slot_bytes[slot]
            loads[least] += slot_bytes[slot]
        return self.edited(shard_of, self.n_shards)

    def grown(self, slot_bytes: list[int]) -> SlotMap:
        """One shard more; slots move only into it, from the fullest shards, up to its fair share."""
        new, share = self.n_shards, sum(slot_bytes) / (self.n_shards + 1)
        shard_of, loads = list(self.shard_of), [*self.loads(slot_bytes), 0]
        members: list[list[int]] = [[] for _ in range(new)]
        for slot in sorted(range(len(shard_of)), key=lambda s: (slot_bytes[s], s)):
            members[shard_of[slot]].append(slot)
        while True:
            full = max(range(new), key=lambda s: (loads[s], s))
            while members[full] and loads[new] + slot_bytes[members[full][-1]] > share:
                members[full].pop()
            if not members[full] or loads[full] <= share:
                break
            slot = members[full].pop()
            shard_of[slot] = new
            loads[full] -= slot_bytes[slot]
            loads[new] += slot_bytes[slot]
        return self.edited(shard_of, new + 1)

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row a slot: vslot, shard, n_shards, version, moved (by the edit that made this version)."""
        gone = set(self.moved)
        rows = [(s, k, self.n_shards, self.version, s in gone) for s, k in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "vslot int, shard int, n_shards int, version int, moved boolean")

    def save(self, spark: SparkSession, path: str) -> None:
        """Store this version beside the earlier ones; a version that is there already is an error."""
        self.frame(spark).coalesce(1).write.parquet(f"{path}/v={self.version:06d}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/v={version:06d}").orderBy("vslot").collect()
        return cls(rows[0].n_shards, tuple(r.shard for r in rows), version, tuple(r.vslot for r in rows if r.moved))

    @classmethod
    def newest(cls, spark: SparkSession, path: str) -> SlotMap | None:
        """The newest version whose write was finished; None if there is none."""
        fs, at = hadoop(spark, path)
        found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        done = [name for name in found if name.startswith("v=") and fs.exists(hadoop(spark, f"{path}/{name}/_SUCCESS")[1])]
        return cls.load(spark, path, max(int(name[2:]) for name in done)) if done else None


def virtual_slot(doc_id: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    """The slot of a record: it hashes the id, and the text where there is no id."""
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.when(doc_id.isNull(), text)), F.lit(n_slots)).cast("int")


def slot_stats(records: DataFrame, vslot: str, size: str, n_slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot of ``records``: ``n_slots`` numbers each."""
    sizes, rows = [0] * n_slots, [0] * n_slots
    for r in records.groupBy(F.col(vslot).alias("s")).agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect():
        sizes[r.s], rows[r.s] = r.b, r.n
    return sizes, rows


def current_map(spark: SparkSession, sizes: list[int], n_shards: int, path: str | None) -> SlotMap:
    """The newest map stored at ``path`` (at first one that deals slots round), grown to ``n_shards``, rebalanced and stored."""
    stored = SlotMap.newest(spark, path) if path else None
    if stored and (len(stored.shard_of) != len(sizes) or stored.n_shards > n_shards):
        raise ValueError(f"the map at {path} has {len(stored.shard_of)} slots and {stored.n_shards} shards; slots are fixed and shards only grow")
    edits = [stored or SlotMap.initial(len(sizes), n_shards)]
    while edits[-1].n_shards < n_shards:
        edits.append(edits[-1].grown(sizes))
    balanced = edits[-1].rebalanced(sizes)
    if balanced.moved:
        edits.append(balanced)
    for made in edits[bool(stored) :] if path else ():
        made.save(spark, path)
    return edits[-1]


def assign_shards(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Put every row of ``docs`` into a shard of nearly equal bytes.

    Returns doc_id, or with ``keep`` all columns of ``docs``; then size (bytes
    + 1), text_crc32, vslot, shard, place (gapless from 0 in the shard) and
    map_version.  With ``map_path``, the newest map there is edited, and every
    edit stored there.
    """
    spark = docs.sparkSession
    kept, own_id = (docs.columns, id_col) if keep else (["doc_id"], "doc_id")
    size, crc, vslot, shard, place, version, row, part, base, slot_, part_, hot = fresh(kept, "size", "text_crc32", "vslot", "shard", "place", "map_version", "row", "part", "base", "slot_", "part_", "hot")
    doc_id, text = col(own_id), col(text_col).cast("string")
    own = [col(c) for c in kept] if keep else [col(id_col).alias("doc_id")]
    rows = docs.select(*own, (utf8_bytes(text) + 1).alias(size), text_crc32(text).alias(crc), virtual_slot(col(id_col), text, n_slots).alias(vslot))

    def numbered() -> DataFrame:
        return written(rows.withColumn(row, F.monotonically_increasing_id()), "records")

    if not keep:
        rows = numbered()
    sizes, counts = slot_stats(rows, vslot, size, n_slots)
    by_id = rows.groupBy(doc_id.alias(hot)).agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    hot_ids = written(by_id.where((F.col("n") > 1) & (F.col("b") > F.lit(sum(sizes) / n_slots))).select(hot, F.lit(True).alias(base)), "hot-ids")  # fewer than slots
    if not hot_ids.isEmpty():
        if keep:
            rows = numbered()
        spread = F.pmod(F.xxhash64(doc_id.cast("string"), F.col(crc), F.col(row)), F.lit(n_slots)).cast("int")
        rows = rows.join(F.broadcast(hot_ids), doc_id.eqNullSafe(F.col(hot)), "left").withColumn(vslot, F.when(F.col(base).isNotNull(), spread).otherwise(F.col(vslot))).drop(hot, base)
        sizes, counts = slot_stats(rows, vslot, size, n_slots)
    slot_map = current_map(spark, sizes, n_shards, map_path)
    first, upto = [0] * n_slots, [0] * n_shards
    for s, k in enumerate(slot_map.shard_of):
        first[s] = upto[k]
        upto[k] += counts[s]
    table = spark.createDataFrame([(s, k, first[s]) for s, k in enumerate(slot_map.shard_of)], f"`{slot_}` int, `{shard}` int, `{base}` long")
    n_parts = -(-max(counts) // PART_ROWS)
    tie = [F.col(c) for c in (crc, size, *([row] if row in rows.columns else []))]
    rows = rows.withColumn(part, F.pmod(F.xxhash64(doc_id.cast("string"), *tie), F.lit(max(n_parts, 1))))
    same = F.col(vslot) == F.col(slot_)
    if n_parts > 1:
        in_order = Window.partitionBy(vslot).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        parts = rows.groupBy(vslot, part).agg(F.count("*").alias("n")).withColumn("n", F.coalesce(F.sum("n").over(in_order), F.lit(0)))
        parts = parts.join(F.broadcast(table), same).select(slot_, F.col(part).alias(part_), shard, (F.col(base) + F.col("n")).alias(base))
        rows = rows.join(small(parts, "parts"), same & (F.col(part) == F.col(part_)))
    else:
        rows = rows.join(F.broadcast(table), same)  # n_slots rows: a fixed size
    inside = Window.partitionBy(vslot, part).orderBy(doc_id, *tie)
    placed = rows.withColumn(place, (F.col(base) + F.row_number().over(inside) - 1).cast("long")).withColumn(version, F.lit(slot_map.version))
    return placed.select(*[col(c) for c in kept], *[F.col(c) for c in (size, crc, vslot, shard, place, version)])
