"""Mixing sources to target weights by systematic sampling.

Documents of a source stand in order of size (then of a seeded hash); with
``S`` the prefix sum of expected copies before a document, ``e`` its own and
``u`` the source's one random offset, it is emitted once for each integer in
``(S + u, S + u + e]``.  ``e`` is the source's target over its size.  Size
order makes the sampling stratified: what is taken differs from what is
expected by less than the largest document.  So that a few very long
documents can't spoil a small source, those above ``LARGE`` of the target are
sampled first, as a stratum of their own, and the others share what is left
of the target; the whole then misses the target by less than ``LARGE`` of it,
unless all is large.

The prefix sum is hierarchical, so a source with a third of all rows is no
single task: rows are counted by (source, size, salt), those counts (one row
a group) are summed in order, and rows are numbered inside a group.  A group
gets one salt for each ``GROUP_ROWS`` rows, up to ``MOST_SALTS``.  No text passes a shuffle.

Defined results: null or empty texts have size 0 and add nothing; null
sources form one source of their own, ordered last; a source of size 0 has
target 0; repeated rows are rows of their own (which of rows that are alike in
every column gets a copy is open); an empty table gives no rows; columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import small, written
from .text import col, fresh, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0
#: Rows of one salt, and most salts of one (source, size).
GROUP_ROWS, MOST_SALTS = 1000, 10_000
#: Documents above this share of their source's target are sampled first.
LARGE = 0.01
#: Ranges of the hash of a row by which rows alike in id, source and text are put in order.
RANGES = 1024


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Targets of ``sizes(source, source_size)``, a row a source.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes.  A target stops at ``most`` times its source's
    size; the excess goes to the others by weight until none is above.  That
    end is a water level: in order of size to weight, sources are capped as
    long as the level that is left for the rest is above their cap.
    """
    everyone = Window.partitionBy(F.lit(0))
    by_name = everyone.orderBy(F.col("source").isNull(), F.col("source"))
    k = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    fill = everyone.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(float(most))
    ranked = sizes.withColumn("w", F.array(*map(F.lit, map(float, weights)))[k])
    level = (
        ranked.withColumn("cap", cap.cast("double"))
        .withColumn("w_left", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.greatest(F.col("left") / F.col("w_left"), F.lit(0.0)))
    )
    # past the first source that stays under its cap, the level is that source's
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("source_size") / F.col("w")).alias("o"), "level"))).over(everyone)["level"]
    return level.withColumn("final", first).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("w"), F.col("cap"))).alias("target"))


def boundaries(position: Column, rows: Column, expected: Column, offset: Column) -> Column:
    """Integers that ``rows`` documents from ``position`` on cross, of ``expected`` copies each."""
    return (F.floor((position + rows) * expected + offset) - F.floor(position * expected + offset)).cast("long")


def mix(docs: DataFrame, seed: int = 17, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, crc (of the text), source_size, target, copies of every row of ``docs``; reruns agree."""
    text = col(text_col).cast("string")
    rows = written(
        docs.select(
            col(id_col).alias("doc_id"),
            col(source_col).cast("string").alias("source"),
            word_count(text).alias("size"),
            F.crc32(text).alias("crc"),
            F.xxhash64(F.lit(seed), col(id_col), F.crc32(text)).alias("h"),
        ),
        "mix",
    )
    sized = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(totals, weights, share, most).withColumnRenamed("source", "t_")
    spread = sized.join(targets, F.col("source").eqNullSafe(F.col("t_"))).select(
        F.col("source").alias("s_"), F.col("size").alias("z_"), F.least(F.ceil(F.col("n") / F.lit(GROUP_ROWS)), F.lit(MOST_SALTS)).alias("salts"), "source_size", "target", (F.col("size") > F.lit(LARGE) * F.col("target")).alias("large")
    )
    salted = rows.join(spread, F.col("source").eqNullSafe(F.col("s_")) & (F.col("size") == F.col("z_")))
    salted = salted.withColumn("salt", F.pmod("h", "salts")).select("doc_id", "source", "size", "crc", "h", "salt", "source_size", "target", "large")

    group = salted.groupBy("source", "size", "salt").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("source_size", "target", "large")])
    own, stratum = Window.partitionBy("source"), Window.partitionBy("source", "large")
    earlier = stratum.orderBy("size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    even = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    group = group.withColumns({"u": offset, "even": even, "base": F.coalesce(F.sum("n").over(earlier), F.lit(0))})
    taken = F.col("size") * boundaries(F.col("base"), F.col("n"), F.col("even"), F.col("u"))
    rest = F.sum(F.when(~F.col("large"), F.col("size") * F.col("n"))).over(own)
    left = (F.col("target") - F.coalesce(F.sum(F.when(F.col("large"), taken)).over(own), F.lit(0))) / rest
    group = group.withColumn("expected", F.when(F.col("large"), F.col("even")).when(rest > 0, F.least(F.greatest(left, F.lit(0.0)), F.lit(float(most)))).otherwise(F.lit(0.0)))
    group = group.select(F.col("source").alias("g_source"), F.col("size").alias("g_size"), F.col("salt").alias("g_salt"), "base", "expected", "u")

    inside = Window.partitionBy("source", "size", "salt").orderBy("h", "doc_id")
    numbered = salted.withColumn("k", F.row_number().over(inside) - 1).join(
        group, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("size") == F.col("g_size")) & (F.col("salt") == F.col("g_salt"))
    )
    copies = boundaries(F.col("base") + F.col("k"), F.lit(1), F.col("expected"), F.col("u"))
    return numbered.select("doc_id", "source", "size", "crc", "source_size", "target", copies.alias("copies"))


def mixed_rows(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of ``docs``, all columns, as often as the mix takes them.

    Rows that are alike in id, source and text hash share their copies.  In
    the order of a hash of all their columns, the k-th of them gets the k-th
    part, so a rerun takes the same rows.
    """
    id_, source_, crc_, copies, alike, crc, copy = fresh(docs.columns, "id_", "source_", "crc_", "copies", "alike", "crc", "copy")
    taken = mix(docs, seed, id_col=id_col, text_col=text_col, source_col=source_col)
    totals = taken.groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source_), F.col("crc").alias(crc_)).agg(F.sum("copies").alias(copies), F.count("*").alias(alike))
    totals = small(totals, "copies")
    keyed = docs.withColumn(crc, F.crc32(col(text_col).cast("string")))
    on = col(id_col).eqNullSafe(F.col(id_)) & col(source_col).cast("string").eqNullSafe(F.col(source_)) & F.col(crc).eqNullSafe(F.col(crc_))
    if totals.where(F.col(alike) > 1).isEmpty():
        out = keyed.join(totals, on)
    else:
        out = keyed.join(totals.where(F.col(alike) == 1), on)
        shared = _shared_copies(keyed.join(totals.where(F.col(alike) > 1), on), docs.columns, [id_, source_, crc_], copies, alike)
        out = out.select(*[col(c) for c in docs.columns], copies).unionByName(shared.select(*[col(c) for c in docs.columns], copies))
    return out.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[col(c) for c in docs.columns])


def _shared_copies(rows: DataFrame, columns: list[str], key: list[str], copies: str, alike: str) -> DataFrame:
    """``rows`` with the copies of each; rows of one ``key`` share the number in ``copies``.

    They are numbered inside ranges of a hash of all columns, and inside salts
    where a range has many rows, so no key is one task.
    """
    h, row, part, salt, n, before, place = fresh(rows.columns, "h", "row", "part", "salt", "n", "before", "place")
    whole = F.xxhash64(F.to_json(F.struct(*[col(c) for c in columns]), {"ignoreNullFields": "false"}))
    rows = written(rows.withColumn(h, whole).withColumn(row, F.monotonically_increasing_id()).withColumn(part, F.pmod(F.shiftright(h, 32), F.lit(RANGES))), "alike")

    def joined(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
        """``left`` and the rest of ``right``, which has a row for each of ``names``, null or not."""
        others = fresh([*left.columns, *right.columns], *[f"of_{c}" for c in names])
        right = right.withColumnsRenamed(dict(zip(names, others, strict=True)))
        on = [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(names, others, strict=True)]
        return left.join(right, reduce(Column.__and__, on)).drop(*others)

    ranges = rows.groupBy(*key, part).agg(F.ceil(F.count("*") / F.lit(GROUP_ROWS)).alias(n))
    salted = joined(rows, ranges, [*key, part]).withColumn(salt, F.pmod(F.xxhash64(row), F.col(n))).drop(n)
    groups = salted.groupBy(*key, part, salt).agg(F.count("*").alias(n))
    earlier = Window.partitionBy(*key).orderBy(part, salt).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    inside = Window.partitionBy(*key, part, salt).orderBy(h, row)
    placed = joined(salted, groups, [*key, part, salt]).withColumn(place, F.col(before) + F.row_number().over(inside))
    upto = lambda k: F.floor(k * F.col(copies) / F.col(alike))
    return placed.withColumn(copies, (upto(F.col(place)) - upto(F.col(place) - 1)).cast("long"))
