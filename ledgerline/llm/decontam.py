"""Benchmark items inside documents: size-partitioned MinHash containment search.

An item is contained in a document if at least ``CONTAINED`` of its distinct
word shingles are among the document's.  MinHash estimates similarity, which
is tiny between a short item and a long document, so both sides are
partitioned by size.  Items of (U/2, U] shingles form a class, for each power
of two U; for a class, documents are searched in windows of 2U shingles that
step by U, so a passage of U shingles is whole in one of them.  There the
similarity is bounded below by the sizes alone, and with ``HASHES`` minima
compared one by one (bands of one row) an item at the least containment is
missed with a probability of about 1e-6, a whole one far less.

Candidates are verified exactly: words, not hashes, of the whole document
against the item's shingles.

Plan: items of equal text are searched as one.  Their texts are broadcast in
blocks of at most about ``BLOCK_BYTES``, a block a pass; a worker makes a
block's signatures once and keeps them; documents pass one Arrow map each,
with no shuffle.  Pairs then meet the items' ids by the text's hash, in a
join.  Minima of windows are built from minima of blocks, so a document costs
its shingles times ``HASHES`` whatever the classes.

Defined results: items with fewer words than a shingle are one shingle of
that width; items without words (null, empty) match nothing; nor do documents
without words; every repeated row of either side gives its own pairs; an
empty side gives no pairs; only ids and texts are read, so other columns may
have any name.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import shared, small
from .text import col, hashed_runs, mapped_rows, mixed, shingles_by_text, tidy, utf8_bytes, words_of

WIDTH = 5
CONTAINED = 0.8
HASHES = 64
BLOCK_BYTES = 4 << 20
SIEVE = 1 << 16
#: Items whose shingles a worker keeps.
KEPT_ITEMS = 4096


def shingles(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    """Distinct shingles of the words."""
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def permuted(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th random order of shingles."""
    return mixed(hashes ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


class Items:
    """Signatures of items of one shingle width, by class."""

    def __init__(self, width: int, items: list[tuple[str, list[bytes]]]) -> None:
        self.width = width
        self.keys = [k for k, _ in items]
        self.words = [w for _, w in items]
        self.sets: dict[int, set[tuple[bytes, ...]]] = {}
        hashed = [r for rows in hashed_runs(b" ".join(w).decode("utf-8", "surrogatepass") for w in self.words) for r in rows]
        rows = [np.unique(x) for x in shingles_by_text(hashed, width)]
        #: class (log2 of its upper size) -> items
        self.classes: dict[int, list[int]] = defaultdict(list)
        for k, x in enumerate(rows):
            self.classes[max(0, (len(x) - 1).bit_length())].append(k)
        self.low = min(self.classes)
        #: (class, hash) -> sieve by low bits, sorted minima, items in that order
        self.minima = {}
        for c, members in self.classes.items():
            sizes = np.array([len(rows[k]) for k in members])
            x, starts = np.concatenate([rows[k] for k in members]), np.cumsum(sizes) - sizes
            for h in range(HASHES):
                least = np.minimum.reduceat(permuted(x, h), starts)
                sieve = np.zeros(SIEVE, bool)
                sieve[least & np.uint64(SIEVE - 1)] = True
                order = np.argsort(least)
                self.minima[c, h] = sieve, least[order], np.array(members)[order]

    def shingles_of(self, k: int) -> set[tuple[bytes, ...]]:
        if k not in self.sets:
            if len(self.sets) >= KEPT_ITEMS:
                self.sets.clear()
            self.sets[k] = shingles(self.words[k], self.width)
        return self.sets[k]

    def candidates(self, documents: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) for those that share a minimum in some window; documents are shingle hashes."""
        sizes = np.array([len(d) for d in documents])
        x = np.concatenate(documents) if len(documents) else np.empty(0, np.uint64)
        out: set[tuple[int, int]] = set()
        if not len(x):
            return out
        block = 1 << self.low
        starts = np.arange(0, len(x), block)
        ends = np.cumsum(sizes)
        for h in range(HASHES):
            minima = permuted(x, h)
            if block > 1:
                minima = np.minimum.reduceat(minima, starts)
            level, at = self.low, minima
            for c in sorted(self.classes):
                while level < c:  # at: minima of steps of 2 ** level shingles, whole blocks
                    at = np.minimum(at[::2], np.append(at[1::2], at[-1:]) if len(at) % 2 else at[1::2])
                    level += 1
                window = np.minimum(at, np.append(at[1:], at[-1:]))
                sieve, least, members = self.minima[c, h]
                for w in np.flatnonzero(sieve[window & np.uint64(SIEVE - 1)]).tolist():
                    a, b = np.searchsorted(least, window[w]), np.searchsorted(least, window[w], side="right")
                    if a < b:
                        first, last = np.searchsorted(ends, [w << c, min(len(x), (w + 2) << c) - 1], side="right")
                        out |= {(d, int(k)) for d in range(first, last + 1) for k in members[a:b]}
        return out


class Search:
    """Items of all widths."""

    def __init__(self, items: Iterable[tuple[str, str | None]], width: int = WIDTH, contained: float = CONTAINED) -> None:
        by_width: dict[int, list] = defaultdict(list)
        for key, text in items:
            if words := words_of(text):
                by_width[min(width, len(words))].append((key, words))
        self.groups = [Items(w, own) for w, own in sorted(by_width.items())]
        self.contained = contained

    def pairs(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, float]]:
        """(place of the text, item, containment) of every match."""
        texts = list(texts)
        at = 0
        for rows in hashed_runs(texts):
            for d, key, share in self._matches(rows, texts[at : at + len(rows)]):
                yield at + d, key, share
            at += len(rows)

    def _matches(self, rows: list[np.ndarray], texts: list[str | None]) -> Iterator[tuple[int, str, float]]:
        for items in self.groups:
            found = defaultdict(list)
            own = [x if len(r) >= items.width else x[:0] for r, x in zip(rows, shingles_by_text(rows, items.width), strict=True)]
            for d, k in items.candidates(own):
                found[d].append(k)
            for d, members in sorted(found.items()):
                whole = shingles(words_of(texts[d]), items.width)
                for k in sorted(members):
                    item = items.shingles_of(k)
                    share = len(item & whole) / len(item)
                    if share >= self.contained:
                        yield d, items.keys[k], share


#: The search of the block that this worker had last, by the block's name.
_made: dict[str, Search] = {}


def _search(name: str, items: list[tuple[str, str]], width: int, contained: float) -> Search:
    if name not in _made:
        _made.clear()
        _made[name] = Search(items, width, contained)
    return _made[name]


def item_blocks(items: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Different texts of ``items(key, text)`` in blocks of about ``BLOCK_BYTES``; the number of blocks follows from the table's size."""
    texts = items.where("text IS NOT NULL").dropDuplicates(["key"])
    total = texts.agg(F.sum(utf8_bytes(F.col("text")))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        yield [(r.key, r.text) for r in texts.where(F.pmod(F.xxhash64("key"), F.lit(n)) == k).collect()]


def _keyed(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    text = col(text_col).cast("string")
    return items.select(col(item_col).alias("item_id"), text.alias("text"), F.sha2(text, 256).alias("key"))


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, containment for every row of ``docs`` and item that it contains."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    own = _keyed(items, item_col, item_text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def with_block(block: list[tuple[str, str]]) -> DataFrame:
        texts, name = shared(docs.sparkSession, block), uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                search = _search(name, texts.value, width, contained)
                found = list(search.pairs(t.as_py() for t in batch.column("text")))
                places, keys, shares = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(places, pa.int64())), pa.array(keys, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "key", "containment"])

        return rows.mapInArrow(tidy(run), f"doc_id {kind}, key string, containment double")

    pairs = reduce(DataFrame.unionByName, map(with_block, item_blocks(own)))
    return pairs.join(small(own.select("key", "item_id"), "items"), "key").select("doc_id", "item_id", "containment")


def without_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, contained: float = CONTAINED, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose text holds no item; the decision is made where the row is."""
    out = docs
    at = docs.columns.index(text_col)
    for block in item_blocks(_keyed(items, item_col, item_text_col)):
        texts, name = shared(docs.sparkSession, block), uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch], texts=texts, name=name) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                search = _search(name, texts.value, width, contained)
                held = {k for k, _, _ in search.pairs(t.as_py() for t in batch.column(at).cast(pa.string()))}
                yield batch.filter(pa.array([k not in held for k in range(batch.num_rows)], pa.bool_()))

        out = mapped_rows(out, run)
    return out
