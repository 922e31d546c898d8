"""SimHash near-duplicates found by the generalised pigeonhole principle.

If 64 bits are cut into partitions with thresholds t_i, -1 or more, and the
sum of t_i + 1 is D + 1, then fingerprints that differ in at most D bits
differ in at most t_i bits of some partition i.  So each fingerprint is
indexed by its bits of every partition with t_i >= 0 and probes all values
within t_i of its own; what meets is verified on all 64 bits.

Bits that are correlated stand together in a partition: then the others are
closer to uniform.  Thresholds are unequal: a dynamic program over partitions
minimises the estimated candidates and probes.  Correlations and estimates
come from ``SAMPLE`` fingerprints (those with the least hashes); they steer
cost only, since every allocation is complete.

Groups of copies collapse before any of this: the index holds distinct
fingerprints.  A partition value with more than ``HOT`` entries is not joined
with itself.  Its fingerprints are linked exactly through hubs instead: two
points are within 2 bits of each other iff some point is within 1 bit of
both.  So each sends itself to the 65 points around it, and those that meet
(65 at most, as they are distinct) are linked to the least of them.  Links
then grow with the fingerprints and not with the square of a group.

Plan: one scan with an Arrow map for fingerprints (the result, 20 bytes a
row, is written to the shared folder), partial aggregation to distinct
fingerprints, one exchange of index and probe rows, equi joins, components
by stars, one join back.

Defined results: a text without words has fingerprint 0 and is linked like
any other; shorter ones than a shingle are one shingle; repeated rows all
return; a null id never names a component unless it has no other; an empty
table gives no rows; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate, combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import written
from .text import words_of

SEED = 42
WIDTH = 3
DISTANCE = 2
SAMPLE = 2048
HOT = 64
SLICE = 1 << 16


def fingerprint(text: str | None, width: int = WIDTH) -> bytes:
    """The 64 bits of a text, highest first: a bit is 1 if set in over half the shingles' XXH64."""
    words = words_of(text)
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_digest
    ends = ends[min(width, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for k in range(0, n, SLICE):
        hashed = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[k : min(n, k + SLICE)], ends[k : k + SLICE], strict=False)])
        ones += np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``extra`` and fp (the bits as a signed long) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *extra, F.col(text_col).alias("text"))
    kept = ["doc_id", *extra]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = b"".join([fingerprint(t.as_py(), width) for t in batch.column("text")])
            fp = np.frombuffer(bits, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fp)], [*kept, "fp"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", fp long")


def bit_matrix(fps: list[int]) -> np.ndarray:
    """(n, 64) bits, column 0 the lowest."""
    return np.unpackbits(np.array(fps, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_partitions(bits: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in ``m`` groups of nearly equal size; each grows by the bit most correlated with it."""
    x = bits.astype(np.float64) - bits.mean(axis=0)
    spread = np.sqrt((x * x).sum(axis=0))
    c = np.abs(x.T @ x) / np.maximum(np.outer(spread, spread), 1e-9)
    np.fill_diagonal(c, 0)
    free, out = set(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (c[b, rest].sum(), -b))]
        free.remove(group[0])
        while len(group) < width:
            b = max(sorted(free), key=lambda b: (c[b, group].sum(), -b))
            group.append(b)
            free.remove(b)
        out.append(sorted(group))
    return out


def ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def allocate(bits: np.ndarray, parts: list[list[int]], n: int, distance: int, row_cost: float = 30.0) -> tuple[float, list[int]]:
    """Cost and thresholds by dynamic programming: least (probes + candidates), sum of t_i + 1 being distance + 1.

    ``row_cost`` is what an index or probe row costs, in verified candidates.
    """
    costs = []
    n = max(n, 1)
    pairs = max(1, len(bits) * (len(bits) - 1))
    for group in parts:
        own = bits[:, group].astype(np.float32)
        apart = own @ (1 - own).T
        apart = apart + apart.T
        cost = [0.0]
        for t in range(distance + 1):
            seen = (np.count_nonzero(apart <= t) - len(bits)) / pairs
            cost.append(row_cost * n * ball(len(group), t) + float(n) * n * max(seen, ball(len(group), t) / 2.0 ** len(group)))
        costs.append(cost)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        best = {
            total: min((best[total - s][0] + c, [*best[total - s][1], s - 1]) for s, c in enumerate(cost) if total - s in best)
            for total in range(distance + 2)
            if any(total - s in best for s in range(len(cost)))
        }
    return best[distance + 1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(group: list[int], radius: int) -> list[int]:
    """All flips of at most ``radius`` bits of ``group``; no flip is first."""
    return [signed(sum(1 << b for b in own)) for r in range(radius + 1) for own in combinations(group, r)]


def probes(nodes: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """part, key, fp, own: the index row and the probe rows of each fingerprint."""
    rows = []
    for k, (group, t) in enumerate(zip(parts, thresholds, strict=True)):
        if t >= 0:
            flips = masks(group, t)
            longs = [F.lit(x).cast("long") for x in flips]
            at = nodes.select("fp", (F.explode(F.array(*longs)) if len(longs) > 1 else longs[0]).alias("flip"))
            bits = F.lit(signed(sum(1 << b for b in group)))
            key = F.col("fp").bitwiseAND(bits).bitwiseXOR(F.col("flip"))
            rows.append(at.select(F.lit(k).alias("part"), key.alias("key"), "fp", (F.col("flip") == 0).alias("own")))
    return reduce(DataFrame.unionByName, rows)


def apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hub_links(fps: DataFrame) -> DataFrame:
    """Links among ``fps(fp)`` that join all that are within 2 bits, through the points within 1 bit."""
    flips = [0, *(signed(1 << b) for b in range(64))]
    at = fps.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    met = at.groupBy("hub").agg(F.collect_list("fp").alias("met")).where(F.size("met") > 1)
    return met.select(F.array_min("met").alias("u"), F.explode("met").alias("v")).where("u <> v").distinct()


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (u, v) that connect all of the distinct ``nodes(fp)`` within ``distance`` (2 at most) bits.

    Every pair outside hot values is a link of its own; inside them links run over the least neighbour.
    """
    if distance > 2:
        raise ValueError("hubs join fingerprints of 2 bits apart at most")
    n = nodes.count()
    sample = bit_matrix([r.fp for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()])
    m = min(3, max(2, round(64 / (log2(max(n, 2)) + 2))))
    parts = correlated_partitions(sample, m) if len(sample) else [list(range(32)), list(range(32, 64))]
    thresholds = allocate(sample, parts, n, distance)[1] if len(sample) else [0, distance - 1]
    rows = probes(nodes, parts, thresholds)
    keys = rows.groupBy("part", "key").agg(F.count("*").alias("n"), F.count_if("own").alias("n_own")).where("n_own > 0 and n > 1").select("part", "key", "n")
    met = written(rows.join(keys, ["part", "key"]), "probes")
    cold, hot = met.where(F.col("n") <= HOT), met.where(F.col("n") > HOT)
    a, b = cold.where("own").select("part", "key", F.col("fp").alias("u")), cold.select("part", "key", F.col("fp").alias("v"))
    pairs = a.join(b, (a.part == b.part) & (a.key == b.key) & (a.u < b.v) & (apart(a.u, b.v) <= distance)).select("u", "v")
    return pairs.unionByName(hub_links(hot.select("fp").distinct()))


def near_duplicates(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the least id reachable) of every row."""
    rows = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(links(nodes, distance)).withColumnRenamed("node", "fp")
    rooted = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
