"""Groups of similar texts: SimHash and MinHash candidates, verified on word shingles.

Two texts are linked if the Jaccard similarity of their five-word shingles is
``SIMILAR`` or more, computed exactly.  Candidates come from two sources.
Fingerprints of ``simhash_gph`` are linked by its index (correlated bits in
partitions, thresholds by dynamic programming, probes and verification), and
texts of one component of these links are candidates, as if they shared a
band.  That finds few of the pairs near ``SIMILAR``: they differ in 10 of 64
bits on average, and a radius that finds nearly all of them finds unrelated
texts as well.  So for the rest, texts are candidates too that share one of
``BANDS`` hashes of ``ROWS`` MinHashes each of the same shingles.  A pair of
similarity j lacks such a band with probability (1 - j ** ROWS) ** BANDS:
6.4e-7 at 0.8 and less above, whatever the texts' length and wherever they
differ.  Texts equal up to the case of A-Z and white space are one node from
the start, so copies never meet as pairs.

MinHashes of at most ``SHORT`` shingles come from a function each.  Longer
texts cut their shingles into ``BINS`` bins by hash, and ``FUNCTIONS``
functions give a minimum in every bin, which costs a shingle 6 evaluations
and not 180.  Texts near the border have bands of both kinds, so any two of
similar size have one kind in common.

1. A row for each text and band; texts of one band value are linked to the
   least of them, so links grow with the texts and not with their pairs.
2. Components of these links hold every candidate pair.  Members of a
   component of at most ``MEMBERS`` meet in one place, a larger one in random
   blocks of that size; candidates that are not yet connected are verified.
3. What is left of a large component are pairs across blocks that share a band
   and are not connected by links found so far.  Bands whose texts are all
   connected are done.  In the others, the texts outside the component's
   largest connected part meet all texts of the band, in blocks.
4. Components of the verified links are the groups.

Only pairs whose ends are already connected are skipped, so no group is cut.
A group of n near copies costs n comparisons with ``MEMBERS`` others, and
what the random blocks did not connect costs its bands' sizes.

Defined results: texts without words (null, empty) are copies of each other;
shorter texts than a shingle are one shingle; repeated rows are copies; an
empty table gives no groups; a group is named by its least key, and the row
that stays of it is that of its least (id, hash of the text), null ids last;
only id and text are read, and stages return all columns as they were,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash_gph import SEED, fingerprint
from .simhash_gph import links as fingerprint_links
from .storage import small, written
from .text import col, fresh, hashed_runs, mixed, shingles_by_text, tidy

WIDTH = 5
SIMILAR = 0.8
ROWS, BANDS = 5, 36
#: Most shingles of a text whose MinHashes have a function each; functions and bins of longer ones.
SHORT = 320
FUNCTIONS, BINS = 6, 30
#: Shingles that are hashed by all functions at once.
BLOCK = 1024
MEMBERS = 512
#: Members of small components that are verified by one call.
TOGETHER = 4096


_RNG = np.random.default_rng(SEED)
_FLIPS, _FACTORS = _RNG.integers(0, 1 << 64, (2, ROWS * BANDS, 1), np.uint64) | np.array([0, 1], np.uint64)[:, None, None]
_STARTS = np.array([k * (1 << 64) // BINS for k in range(1, BINS)], np.uint64)
#: Every (function, bin) once; the rows of a band differ in both.
_PLACES = np.arange(ROWS * BANDS)
_PLACES = _PLACES % FUNCTIONS, (_PLACES % BINS + _PLACES // BINS) % BINS


def _in_bands(least: np.ndarray, kind: int) -> np.ndarray:
    """(texts, BANDS) hashes, as signed longs, of (180, texts) minima; the numbers of kind and band are part of a hash."""
    out = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None] + np.uint64(kind * BANDS), least.shape[1], axis=1)
    by_band = least.reshape(BANDS, ROWS, -1)
    for k in range(ROWS):
        out = mixed(out + by_band[:, k])
    return np.ascontiguousarray(out.T).view(np.int64)


def _short(sets: list[np.ndarray]) -> np.ndarray:
    """Bands of short sets, none of them empty."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    return _in_bands(np.minimum.reduceat((np.concatenate(sets) ^ _FLIPS) * _FACTORS, starts, axis=1), 0)


def _long(x: np.ndarray) -> np.ndarray:
    """Bands of one sorted set."""
    at = np.concatenate([[0], np.searchsorted(x, _STARTS), [len(x)]])
    least = np.full((FUNCTIONS, BINS), ~np.uint64(0))
    full = np.flatnonzero(np.diff(at))
    for k in range(FUNCTIONS):
        least[k, full] = np.minimum.reduceat((x ^ _FLIPS[k]) * _FACTORS[k], at[full])
    return _in_bands(least[_PLACES][:, None], 1)[0]


def bands_of(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Bands of each set of shingles (sorted, distinct): those of a short set, then those of a long one; none of an empty one."""
    short: list[np.ndarray] = [np.empty(0, np.int64)] * len(sets)
    held: list[int] = []
    size = 0
    for k, s in enumerate(sets):
        if 0 < len(s) <= SHORT:
            held.append(k)
            size += len(s)
        if held and (size >= BLOCK or k == len(sets) - 1):
            for j, bands in zip(held, _short([sets[j] for j in held]), strict=True):
                short[j] = bands
            held, size = [], 0
    return [np.concatenate([b, _long(s)]) if len(s) > SIMILAR * SHORT else b for b, s in zip(short, sets, strict=True)]


def aligned(bands: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """A row for each text, the bands of both kinds and SimHash's in columns of their own; where a text has none, a number of its own."""
    out = -1 - np.arange(len(bands) * (2 * BANDS + 1)).reshape(len(bands), 2 * BANDS + 1)
    for k, b in enumerate(bands):
        if len(b) % BANDS:
            out[k, -1], b = b[-1], b[:-1]
        if sizes[k] <= SHORT:
            out[k, : len(b)] = b
        else:
            out[k, BANDS:-1] = b
    return out


def shingle_sets_of(rows: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Hashes of the shingles of each row of word hashes, sorted and distinct; a shorter row is one shingle."""
    return [distinct(x) for x in shingles_by_text(rows, width)]


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def keyed_bands(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (hash of the text as it stands), key (of its words), bands and fp (fingerprint) of every row; rows of one key have the same."""
    rows = docs.select(col(id_col).alias("doc_id"), text_hash(text_col).alias("h"), col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            bands: list[np.ndarray] = []
            for rows in hashed_runs(t.as_py() for t in batch.column("text")):
                keys += [xxhash.xxh3_128_digest(r) for r in rows]
                bands += bands_of(shingle_sets_of(rows, width))
            fps = np.frombuffer(b"".join([fingerprint(t.as_py()) for t in batch.column("text")]), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(fps)], ["doc_id", "h", "key", "bands", "fp"])

    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, h long, key binary, bands array<long>, fp long")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(col(text_col).cast("string"))


def with_simhash_band(texts: DataFrame) -> DataFrame:
    """``texts(node, bands, fp)`` without fp; a band more, behind the others, for those whose fingerprint is linked to another text's."""
    at = texts.select("node", "fp")
    roots = components(fingerprint_links(written(at.select("fp").distinct(), "fingerprints"))).withColumnsRenamed({"node": "fp"})
    at = written(at.join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("root")), "simhash")
    several = at.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    bands = small(at.join(several, "root").select("node", F.xxhash64(F.lit("simhash"), "root").alias("band")).distinct(), "simhash-bands")
    more = F.when(F.col("band").isNull(), F.col("bands")).otherwise(F.concat("bands", F.array("band")))
    return texts.drop("fp").join(bands, "node", "left").withColumn("bands", more).drop("band")


def candidate_links(texts: DataFrame) -> DataFrame:
    """u, v that connect all of ``texts(node, bands)`` that share a band."""
    rows = texts.select("node", F.explode("bands").alias("band"))
    least = rows.groupBy("band").agg(F.min("node").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(least, "band").select("u", F.col("node").alias("v")).where("u <> v").distinct()


def shingle_sets(docs: DataFrame, keys: DataFrame, width: int, text_col: str) -> DataFrame:
    """key, shingles (sorted distinct hashes, packed) of the texts named in ``keys(key, h)``."""
    rows = docs.select(text_hash(text_col).alias("h"), col(text_col).cast("string").alias("text")).join(small(keys, "keys"), "h").select("key", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            own = [k for k, key in enumerate(batch.column("key").to_pylist()) if not (key in done or done.add(key))]  # copies
            part = batch.take(pa.array(own, pa.int64()))
            sets: list[bytes] = []
            for rows in hashed_runs(t.as_py() for t in part.column("text")):
                sets += [s.tobytes() for s in shingle_sets_of(rows, width)]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sets, pa.binary())], ["key", "shingles"])

    return rows.mapInArrow(tidy(run), "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))


class Links:
    """Links among numbered sets that connect all those of enough similarity that were asked for."""

    def __init__(self, sets: list[np.ndarray], similar: float, parts: Iterable | None = None) -> None:
        self.sets, self.similar = sets, similar
        self.sizes = np.array([len(s) for s in sets])
        self.root = list(range(len(sets)))
        self.found: list[tuple[int, int]] = []
        first: dict = {}
        for k, part in enumerate(parts or ()):  # those of one part are connected already
            self.root[k] = first.setdefault(part, k)

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = self.root[k]
        return k

    def among(self, i: int, others: np.ndarray) -> None:
        """Verify (i, j) for each j of ``others`` that is not yet connected with i."""
        n = self.sizes[i]
        fits = np.minimum(self.sizes[others], n) >= self.similar * np.maximum(self.sizes[others], n)
        for j in others[fits].tolist():
            a, b = self.find(i), self.find(j)
            if a != b:
                x, y = self.sets[i], self.sets[j]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= self.similar * (len(x) + len(y) - both):
                    self.root[max(a, b)] = min(a, b)
                    self.found.append((i, j))


def verified(bands: list[np.ndarray], sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Places of links that connect all texts that share a band and have similarity ``similar`` or more."""
    links = Links(sets, similar)
    table = aligned(bands, links.sizes)
    for i in range(len(bands) - 1):
        shared = np.count_nonzero(table[i + 1 :] == table[i], axis=1)
        near = np.flatnonzero(shared)
        links.among(i, near[np.argsort(-shared[near], kind="stable")] + i + 1)
    return links.found


def _numbers(blobs: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(s.as_py(), np.uint64) for s in blobs]


_LINK = pa.schema([("u", pa.binary()), ("v", pa.binary())])


def _named(keys: list[bytes], found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": [keys[i] for i, _ in found], "v": [keys[j] for _, j in found]}, schema=_LINK)


def links_in_blocks(members: DataFrame, similar: float) -> DataFrame:
    """u, v: links inside small components, and inside random blocks of larger ones (``n``, 0 for small ones), of ``members(key, bands, c, n, shingles)``."""
    calls = F.lit(max(1, members.count() // TOGETHER))
    large = F.col("n") > MEMBERS
    place = F.when(large, F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / MEMBERS))).otherwise(F.pmod(F.xxhash64("c"), calls))
    rows = members.withColumn("whole", F.when(large, F.col("c"))).withColumn("block", place)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("c")
        keys, sets = table.column("key").to_pylist(), _numbers(table.column("shingles"))
        bands = [b.values.to_numpy() for b in table.column("bands")]
        c = table.column("c").to_numpy()
        found = []
        for a, b in zip(starts := [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist()], [*starts[1:], len(c)], strict=True):
            found += [(a + i, a + j) for i, j in verified(bands[a:b], sets[a:b], similar)]
        return _named(keys, found)

    return rows.select("whole", "block", "c", "key", "bands", "shingles").groupBy("whole", "block").applyInArrow(run, "u binary, v binary")


def links_across(large: DataFrame, connected: DataFrame, similar: float) -> DataFrame:
    """u, v: links between parts that ``connected(node, root)`` leaves apart, among the large components' members that share a band."""
    parts = connected.withColumnsRenamed({"node": "key", "root": "part"})
    rows = written(large.select("key", "c", "bands").join(parts, "key", "left").withColumn("part", F.coalesce("part", "key")), "parts")
    most = rows.groupBy("c", "part").agg(F.count("*").alias("n")).groupBy("c").agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
    at = rows.join(most, "c").select("key", "part", (F.col("part") != F.col("largest")).alias("rest"), F.explode("bands").alias("band"))
    blocks = lambda n: F.greatest(F.ceil(n / F.lit(MEMBERS)), F.lit(1))
    still = at.groupBy("band").agg(F.min("part").alias("a"), F.max("part").alias("b"), blocks(F.count("*")).alias("n_all"), blocks(F.count_if("rest")).alias("n_rest")).where("a <> b").drop("a", "b")
    met = at.join(still, "band")
    own = lambda salt, n: F.pmod(F.xxhash64("key", F.lit(salt)), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asks = met.where("rest").select("band", "key", "part", F.lit(True).alias("asks"), own("rest", F.col("n_rest")).alias("i"), every(F.col("n_all")).alias("j"))
    asked = met.select("band", "key", "part", F.lit(False).alias("asks"), every(F.col("n_rest")).alias("i"), own("all", F.col("n_all")).alias("j"))
    pairs = asks.unionByName(asked).join(large.select("key", "shingles"), "key")

    def run(table: pa.Table) -> pa.Table:
        keys, asks = table.column("key").to_pylist(), table.column("asks").to_numpy()
        links = Links(_numbers(table.column("shingles")), similar, table.column("part").to_pylist())
        others = np.flatnonzero(~asks)
        for i in np.flatnonzero(asks).tolist():
            links.among(i, others)
        return _named(keys, links.found)

    return pairs.select("band", "i", "j", "key", "part", "asks", "shingles").groupBy("band", "i", "j").applyInArrow(run, "u binary, v binary")


def similar_keys(docs: DataFrame, texts: DataFrame, width: int, similar: float, text_col: str) -> DataFrame:
    """node, root: the key of each text that is similar to another, and its group's least key."""
    found = components(candidate_links(texts)).withColumnRenamed("root", "c")
    members = written(texts.join(found, "node").select("key", "bands", "c", F.col("least.h").alias("h")), "members")
    large = small(members.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS), "large")
    sized = members.drop("h").join(large, "c", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    members = written(sized.join(shingle_sets(docs, members.select("key", "h"), width, text_col), "key"), "sets")
    groups = components(links_in_blocks(members, similar))
    large = members.where(F.col("n") > MEMBERS)
    if large.isEmpty():
        return groups
    star = groups.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    return components(star.unionByName(links_across(large, groups, similar)))


def keyed_texts(docs: DataFrame, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, key of every row; key, bands, least row, rows and node of every text), written."""
    rows = written(keyed_bands(docs, width, id_col, text_col), "keyed")
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    # a node is a hash of the key: two keys of one node would only be one candidate more
    texts = rows.groupBy("key").agg(F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.min(least).alias("least"), F.count("*").alias("rows"), F.xxhash64("key").alias("node"))
    return rows.drop("bands", "fp"), with_simhash_band(written(texts, "texts"))


def similar_groups(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, group of every row; ``group`` is the least text key of the group."""
    rows, texts = keyed_texts(docs, width, id_col, text_col)
    groups = similar_keys(docs, texts, width, similar, text_col).withColumnsRenamed({"node": "key", "root": "group"})
    return rows.select("doc_id", "key").join(groups, "key", "left").select("doc_id", "key", F.coalesce("group", "key").alias("group"))


def one_of_each_group(docs: DataFrame, width: int = WIDTH, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the least id of each group, all columns as in ``docs``; of rows alike in id and text any one."""
    rows, texts = keyed_texts(docs, width, id_col, text_col)
    groups = similar_keys(docs, texts, width, similar, text_col).withColumnsRenamed({"node": "key", "root": "group"})
    named = texts.select("key", "least", "rows").join(groups, "key", "left").withColumn("group", F.coalesce("group", "key"))
    stays = named.groupBy("group").agg(F.min("least").alias("stays"), F.sum("rows").alias("n")).where("n > 1").drop("n")
    choice = rows.join(named.join(stays, "group").select("key", "stays"), "key")
    chosen = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("h") == F.col("stays.h"))
    row, of_id, of_text = fresh(docs.columns, "row_hash", "id_of_row", "hash_of_row")
    choice = choice.groupBy(F.col("doc_id").alias(of_id), F.col("h").alias(of_text)).agg(F.max(chosen).alias("stays"), F.count("*").alias("n"))
    choice = written(choice.where("not stays or n > 1"), "choice")
    goes, twice = (small(choice.where(c).select(of_id, of_text), c.split()[0]) for c in ("not stays", "stays"))
    keyed = docs.withColumn(row, text_hash(text_col))
    on = lambda keys: col(id_col).eqNullSafe(keys[of_id]) & (F.col(row) == keys[of_text])
    kept = keyed.join(goes, on(goes), "left_anti")
    if not twice.isEmpty():
        kept = kept.join(twice, on(twice), "left_anti").unionByName(kept.join(twice, on(twice), "left_semi").dropDuplicates([id_col, row]))
    return kept.drop(row)
