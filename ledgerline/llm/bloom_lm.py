"""Language-model scores from a log-frequency Bloom filter.

**Filter.**  Counts of the training documents' words, word pairs and word
triples are quantised on a log scale, level = 1 + floor(log(count) / log(base)),
and an n-gram is entered once for each level up to its own.  A count is read
back by probing levels 1, 2, ... until one is missing, so a false hit can only
raise it, and frequent n-grams, probed deepest, are least likely to be raised.
Triples are entered from a count of ``LEAST_TRIPLE`` on: nearly all others
stand in one text only.  The filter is blocked: an n-gram's hash names its
segment, so every segment is built whole by one task, from the counts that
were exchanged by segment.

**Probabilities.**  Probes give counts c as the geometric middle of their
level.  Each order is mixed with the one below by Witten and Bell's rule, and
the lowest is smoothed as the base score is:

    P(w)       = (c(w) + 0.5) / (N + 0.5 (V + 1))
    P(w | u)   = (c(u, w) + T(u) P(w)) / (c(u) + T(u))
    P(w | t u) = (c(t, u, w) + (r + T(t, u)) P(w | u)) / (c(t, u) + T(t, u))

T, the different successors of a context, follows a power law T = c ** b; b
is fitted for words and for pairs so that their T add up to the distinct pairs
and triples, from the number of n-grams at each level.  r = min((1 - g) c(t, u),
c(t, u) - c(t, u, w)), where g is the share of all triples that is entered:
what the others weigh falls to the pair estimate.  A context that was never
seen leaves the estimate below as it is.

**Base score.**  Exact counts by 64-bit word hash.  The table of the V words
of training goes to the workers if it has at most ``TABLE_WORDS`` words (12
bytes each).  Beyond that each document's words are joined with the table by
hash, summed by document.

Plan: every task of the counting scan merges what its documents hold and
emits one packed row per segment, so a word in every document is one entry a
task, and the exchange carries rows of many n-grams.  There are at most
``FAN`` segments a row can go to; a corpus that needs more segments exchanges
twice, first by ranges of segments, whose rows are merged before they are
split.  The reduce side sums segments; it returns their filter bits and, in a
second column, their words' counts.  What is gathered grows with the distinct
n-grams of the corpus.  The filter has ``BITS_PER_ENTRY`` bits for each entry,
whatever their number.  Up to ``MOST_FILTER_BYTES``, the size that workers and
driver can hold, it is gathered and broadcast.  A larger one is never in one
place: documents are put together in chunks of ``CHUNK_BYTES``, each chunk's
distinct n-grams go to their segments, a segment's bits are probed by all
chunks that ask it, and levels (with the words' exact counts) come back to the
chunk.  That is done for a share of the chunks at a time, ``PASSES`` in all.

Defined results: a null or empty text is the end token alone; repeated rows
count and score each; a null id is the empty text to the fold; an empty
training set leaves every count at 0 (N = V = 0), a score of log10(1) a
token; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop_path, shared, shuffles_dropped, written, written_at
from .text import RUN_BYTES, col, fold_of, hashed_runs, mixed, tidy

QUANT_BASE = 2.0
BITS_PER_ENTRY = 8
N_HASHES = 3
LEAST_TRIPLE = 2
MOST_FILTER_BYTES = 96 << 20
TABLE_WORDS = 6_000_000
#: Documents' bytes for each segment of the exchange, and segments that one exchange tells apart.
SEGMENT_BYTES = 4 << 20
FAN = 8192
#: Documents' bytes that are scored together where the filter is too large to broadcast.
CHUNK_BYTES = 8 << 20
#: Shares of the chunks that ask the segments one after another: what one asks and is told goes before the next.
PASSES = 4
#: Keys of one segment that are probed by one call.
ASKED_KEYS = 1 << 18
MERGE_WORDS = 1 << 19
#: Distinct n-grams that a counting task holds before it passes them on.
HELD_ENTRIES = 3_000_000
#: Hashes of the end token, of the start of a text, and what tells pairs and triples from words.
END = np.uint64(0x9AE16A3B2F90404F)
START = np.uint64(0xC3A5C85C97CB3127)
PAIR = np.uint64(0xB492B66FBE98F273)
TRIPLE = np.uint64(0xD6E8FEB86659FD93)
KINDS = ("words", "pairs", "triples")
#: Bytes of a kind's keys inside a segment, and what tells its probes from the others'.
KEY_BYTES = {"words": 8, "pairs": 5, "triples": 5}
_SALTS = {"words": np.uint64(0), "pairs": np.uint64(1 << 62), "triples": np.uint64(1 << 63)}
_LOW32 = np.uint64((1 << 32) - 1)


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(u ^ PAIR) + w)


def token_runs(texts: Iterable, most: int = RUN_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the words of each text with an end behind them, where each text starts) of runs of texts, given as Arrow's scalars."""
    for rows in hashed_runs((t.as_py() for t in texts), most):
        sizes = np.array([len(r) + 1 for r in rows])
        upto = np.cumsum(sizes)
        tokens = np.empty(upto[-1], np.uint64)
        ends = np.zeros(upto[-1], bool)
        ends[upto - 1] = True
        tokens[ends], tokens[~ends] = END, np.concatenate(rows)
        yield tokens, upto - sizes


def predecessors(tokens: np.ndarray) -> np.ndarray:
    """The token before each; the start after an end."""
    u = np.append(START, tokens[:-1])
    u[1:][tokens[:-1] == END] = START
    return u


@dataclass
class Grams:
    """Texts' tokens in a row, and the hashes of the pair and of the triple that end with each (a triple only behind a text's first token)."""

    tokens: np.ndarray
    pairs: np.ndarray
    triples: np.ndarray
    begins: np.ndarray

    @classmethod
    def of(cls, tokens: np.ndarray) -> Grams:
        u = predecessors(tokens)
        pairs = pair_hash(u, tokens)
        triples = mixed(mixed(np.append(START, pairs[:-1]) ^ TRIPLE) + tokens)
        return cls(tokens, pairs, triples, u == START)

    def each(self) -> Iterator[tuple[str, np.ndarray]]:
        yield "words", self.tokens
        yield "pairs", self.pairs
        yield "triples", self.triples[~self.begins]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def distinct(x: np.ndarray) -> np.ndarray:
    """Ascending, without repeats; a sort is several times faster here than ``np.unique``, which hashes."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of ``x`` (ascending) and where each starts."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return x[first], first


def places(x: np.ndarray) -> np.ndarray:
    """For each of ``x`` its place among the distinct values, ascending."""
    order = np.argsort(x)
    ordered = x[order]
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1])[: len(x)])
    return back


def in_runs(blobs: list[bytes], most: int) -> Iterator[list[bytes]]:
    """``blobs`` in runs of about ``most`` bytes."""
    held: list[bytes] = []
    size = 0
    for b in blobs:
        held.append(b)
        size += len(b)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def segment_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes >> np.uint64(40)) % np.uint64(n)


def by_segment(segments: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stable order of ``segments``, all below ``n``, those that occur, and their first places in that order."""
    order = np.argsort(segments.astype(np.uint16) if n <= 1 << 16 else segments, kind="stable")  # 16 bits are sorted by digits
    return order, *runs_of(segments[order])


def keys_in_segment(hashes: np.ndarray, kind: str) -> np.ndarray:
    """What tells n-grams of a kind apart inside their segment: the low bytes of their hashes."""
    width = KEY_BYTES[kind]
    return hashes & np.uint64((1 << 8 * width) - 1) if width < 8 else hashes


class Counter:
    """Counts of one kind of n-gram, merged now and then."""

    def __init__(self) -> None:
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.single: list[np.ndarray] = []
        self.counted: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            self.single.append(keys)
        else:
            self.counted.append((keys, counts))
        self.size += len(keys)
        if self.size > max(MERGE_WORDS, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        if self.single:
            self.counted.append(np.unique(np.concatenate(self.single), return_counts=True))
        if self.counted:
            self.keys, self.counts = summed(*(np.concatenate(x) for x in zip((self.keys, self.counts), *self.counted, strict=True)))
        self.single, self.counted, self.size = [], [], 0


def pack(keys: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """Numbers of entries and of counts above 255; keys of ``width`` bytes; counts of one byte; places and values of those above."""
    above = np.flatnonzero(counts > 255)
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return struct.pack("<II", len(keys), len(above)) + low.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + above.astype("<u4").tobytes() + counts[above].astype("<i8").tobytes()


def unpack(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, above = struct.unpack_from("<II", blob)
    at = 8 + n * width
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8, n * width, 8).reshape(n, width)
    counts = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
    counts[np.frombuffer(blob, "<u4", above, at + n)] = np.frombuffer(blob, "<i8", above, at + n + 4 * above)
    return raw.view("<u8").ravel(), counts


def merged(blobs: Iterable[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all blobs, ascending, and the sums of their counts."""
    parts = [unpack(b, width) for b in blobs if b]
    return summed(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))


BLOBS = "words binary, pairs binary, triples binary"
_BLOB_SCHEMA = pa.schema([("segment", pa.int64()), *[(kind, pa.binary()) for kind in KINDS]])


def dealt(counters: dict[str, Counter], n: int, own: int | None = None, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Packed counts by segment of ``n``, some segments a batch; with ``own``, ranges of that many segments instead; ``whole`` keeps all of a hash."""
    parts: dict[str, dict[int, bytes]] = {}
    for kind, counter in counters.items():
        counter.merge()
        order, names, first = by_segment(segment_of(counter.keys, n) // np.uint64(own or 1), n)
        keys = counter.keys[order] if whole else keys_in_segment(counter.keys[order], kind)
        counts, ends = counter.counts[order], [*first[1:].tolist(), len(keys)][: len(first)]
        parts[kind] = {s: pack(keys[a:b], counts[a:b], 8 if whole else KEY_BYTES[kind]) for s, a, b in zip(names.tolist(), first.tolist(), ends, strict=True)}
    every = sorted(set().union(*parts.values()))
    for k in range(0, len(every), 64):
        yield pa.RecordBatch.from_pydict({"segment": every[k : k + 64], **{kind: [parts[kind].get(s) for s in every[k : k + 64]] for kind in KINDS}}, _BLOB_SCHEMA)


def count_ngrams(docs: DataFrame, n_segments: int) -> DataFrame:
    """segment, words, pairs, triples (packed counts) of ``docs(text)``: a row per task and segment, or more in a large task.

    A task passes on what it holds beyond ``HELD_ENTRIES``, so its memory is bounded.
    """
    own = -(-n_segments // FAN) if n_segments > FAN else None

    def counted(texts: Iterable, add, n: int, own: int | None, whole: bool) -> Iterator[pa.RecordBatch]:
        counters = {kind: Counter() for kind in KINDS}
        for x in texts:
            add(counters, x)
            if sum(len(c.keys) for c in counters.values()) > HELD_ENTRIES:
                yield from dealt(counters, n, own, whole)
                counters = {kind: Counter() for kind in KINDS}
        yield from dealt(counters, n, own, whole)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(counters: dict[str, Counter], run: tuple[np.ndarray, np.ndarray]) -> None:
            for kind, grams in Grams.of(run[0]).each():
                counters[kind].add(grams)

        yield from counted(token_runs(t for b in batches for t in b.column("text")), add, n_segments, own, own is not None)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(counters: dict[str, Counter], row: dict) -> None:
            for kind in KINDS:
                if row[kind]:
                    counters[kind].add(*unpack(row[kind], 8))

        yield from counted((r for b in batches for r in b.to_pylist()), add, n_segments, None, False)

    rows = docs.select("text").mapInArrow(tidy(scan), f"segment long, {BLOBS}")
    if own:  # ranges of segments in a few parts each, so that none is one task
        rows = rows.repartition(F.col("segment"), (F.rand(3) * 16).cast("int")).mapInArrow(tidy(split), f"segment long, {BLOBS}")
    return rows


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised log of counts, 1 for a count of 1."""
    return 1 + np.floor(np.log(counts) / np.log(QUANT_BASE) + 1e-9).astype(np.int64)


def middle(level):
    """The count that stands for a level."""
    return np.where(level > 1, QUANT_BASE ** (np.asarray(level) - 0.5), level)


#: ``middle`` of every level.
STANDS_FOR = middle(np.arange(64))


def _hashed(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """What the bits of (n-gram, level) follow from: a start and a step."""
    h = mixed(keys + np.uint64(0x9E3779B97F4A7C15 * level & (1 << 64) - 1))
    return h, (h >> np.uint64(32)) | np.uint64(1)


def _bit(h: np.ndarray, step: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th bit inside a segment of ``bits`` bits."""
    return ((h + step * np.uint64(k)) & _LOW32) * np.uint64(bits) >> np.uint64(32)


def segment_bits(grams: dict[str, tuple[np.ndarray, np.ndarray]], bits: int) -> bytes:
    """The bits of one segment, of kind -> (keys, counts)."""
    out = np.zeros(bits, bool)
    for kind, (keys, counts) in grams.items():
        level, salted = levels(counts), keys | _SALTS[kind]
        for at in range(1, int(level.max(initial=0)) + 1):
            h, step = _hashed(salted[level >= at], at)
            for k in range(N_HASHES):
                out[_bit(h, step, k, bits)] = True
    return np.packbits(out, bitorder="little").tobytes()


def probe(data: np.ndarray, base: np.ndarray | None, keys: np.ndarray, kind: str, bits: int) -> np.ndarray:
    """Levels as probed in ``data``, whose segment for each key starts at bit ``base`` (None: 0); 0 if level 1 is missing."""
    level = np.zeros(len(keys), np.uint8)
    live, salted = np.arange(len(keys)), keys | _SALTS[kind]
    for at in range(1, 64):
        h, step = _hashed(salted[live], at)
        for k in range(N_HASHES):  # a miss ends this n-gram; its other bits don't matter
            where = _bit(h, step, k, bits)
            if base is not None:
                where = where + base[live]
            on = np.flatnonzero(data[(where >> np.uint64(3)).view(np.int64)] >> (where & np.uint64(7)).astype(np.uint8) & np.uint8(1))
            live, h, step = live[on], h[on], step[on]
        if not len(live):
            break
        level[live] = at
    return level


@dataclass
class Filter:
    """All segments' bits (None where they are too many to gather), and the corpus totals that the probabilities need."""

    data: np.ndarray | None
    n_segments: int
    bits: int
    tokens: int = 0
    words: int = 0
    entered: float = 0.0  # g
    exponents: tuple[float, float] = (1.0, 1.0)

    def counts(self, hashes: np.ndarray, kind: str = "words") -> np.ndarray:
        """Counts as probed, the geometric middle of their level; 0 if level 1 is missing."""
        base = segment_of(hashes, self.n_segments) * np.uint64(self.bits)
        return middle(probe(self.data, base, keys_in_segment(hashes, kind), kind, self.bits).astype(np.int64))

    def log10_probability(self, tokens: np.ndarray) -> np.ndarray:
        """log10 P of every token of one text, or of several in a row, after its predecessors."""
        distinct, back = np.unique(tokens, return_inverse=True)
        return self.log10_of(Grams.of(tokens), self.counts(distinct)[back])

    def log10_of(self, grams: Grams, own: np.ndarray) -> np.ndarray:
        return self.estimates(grams.begins, own, self.counts(grams.pairs, "pairs"), self.counts(grams.triples, "triples"), self.ends)

    def estimates(self, begins: np.ndarray, own: np.ndarray, pair: np.ndarray, triple: np.ndarray, ends: float) -> np.ndarray:
        """log10 P from the counts of tokens, of the pairs and triples that end with them, and of ends."""
        word = (own + 0.5) / (self.tokens + 0.5 * (self.words + 1))
        before = np.where(begins, ends, np.append(ends, own[:-1]))
        successors = np.maximum(before, 1.0) ** self.exponents[0]
        after_one = (np.minimum(pair, np.maximum(before, pair.clip(max=1))) + successors * word) / (before + successors)
        context = np.where(begins, 0.0, np.append(0.0, pair[:-1]))
        successors = np.where(context > 0, np.maximum(context, 1.0) ** self.exponents[1], 1.0)
        triple = np.where(triple >= LEAST_TRIPLE, np.minimum(triple, context), 0.0)
        rest = np.minimum((1 - self.entered) * context, context - triple)
        return np.log10((triple + (rest + successors) * after_one) / (context + successors))

    @property
    def ends(self) -> float:
        """Times that a text starts: as often as one ends."""
        if not hasattr(self, "_ends"):
            self._ends = float(self.counts(np.array([END], np.uint64))[0])
        return self._ends


@dataclass
class Model:
    """What training leaves: the filter, and the exact counts by segment."""

    filter: Filter
    table: DataFrame  # segment, words (packed), bits (of the filter)


TOTALS = ("tokens", "n_words", "n_pairs", "n_triples", "all_triples", "kept_triples", "entries")
SEGMENT_SCHEMA = f"segment long, {BLOBS}, " + ", ".join(f"{c} long" for c in TOTALS) + ", word_levels array<long>, pair_levels array<long>"


def _merge_segment(rows: pa.Table) -> pa.Table:
    """One segment: the rows of all tasks summed, triples from ``LEAST_TRIPLE`` on kept."""
    out, n = {"segment": rows.column("segment")[0].as_py()}, dict.fromkeys(TOTALS, 0)
    for kind in KINDS:
        keys, counts = merged((b.as_py() for b in rows.column(kind)), KEY_BYTES[kind])
        n[f"n_{kind}"] = len(keys)
        if kind == "triples":
            n["all_triples"] = int(counts.sum())
            keys, counts = keys[counts >= LEAST_TRIPLE], counts[counts >= LEAST_TRIPLE]
            n["kept_triples"] = int(counts.sum())
        level = levels(counts)
        n["entries"] += int(level.sum())
        if kind != "triples":
            out[f"{kind[:-1]}_levels"] = np.bincount(level, minlength=64).tolist()
        if kind == "words":
            n["tokens"] = int(counts.sum())
        out[kind] = pack(keys, counts, KEY_BYTES[kind])
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.Table.from_pylist([out | n], pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SEGMENT_SCHEMA.split(", ")]))


def grams_of(row: dict) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    return {kind: unpack(row[kind], KEY_BYTES[kind]) for kind in KINDS if row[kind]}


def train(docs: DataFrame) -> Model:
    """Fit on ``docs(text)``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_segments = max(16, -(-size // SEGMENT_BYTES))
    with shuffles_dropped(docs.sparkSession):
        table, path = written_at(count_ngrams(docs, n_segments).groupBy("segment").applyInArrow(_merge_segment, SEGMENT_SCHEMA), "ngrams")
    sums = table.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS]).first()
    total = max(1 << 16, BITS_PER_ENTRY * sums.entries)
    bits = -(-total // (n_segments * 8)) * 8

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({"segment": [r["segment"]], "words": [r["words"]], "bits": [segment_bits(grams_of(r), bits)]})

    made = written(table.select("segment", *KINDS).mapInArrow(tidy(build), "segment long, words binary, bits binary"), "filter")
    data = None
    if total <= MOST_FILTER_BYTES * 8:
        data = np.zeros(n_segments * bits // 8, np.uint8)
        for r in made.select("segment", "bits").toLocalIterator():  # MOST_FILTER_BYTES, and a byte a segment, at most
            at = r.segment * bits // 8
            data[at : at + bits // 8] = np.frombuffer(r.bits, np.uint8)
    exponents = []
    for c, n in (("word_levels", sums.n_pairs), ("pair_levels", sums.n_triples)):
        at = table.select(F.posexplode(c).alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).where("n > 0").collect()  # 64 rows
        exponents.append(successor_exponent({r.k: r.n for r in at}, n))
    fitted = Filter(data, n_segments, bits, sums.tokens, sums.n_words, sums.kept_triples / max(1, sums.all_triples), tuple(exponents))
    drop_path(docs.sparkSession, path)
    return Model(fitted, made)


def successor_exponent(at: dict[int, int], successors: int) -> float:
    """b in [0, 1] such that the sum of count ** b over n-grams, of which ``at`` has the number at each level, is ``successors``."""
    low, high = 0.0, 1.0
    for _ in range(40):
        b = (low + high) / 2
        if sum(n * float(middle(k)) ** b for k, n in at.items() if k) < successors:
            low = b
        else:
            high = b
    return low


def word_table(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of all words; only for a table of checked size."""
    parts = [unpack(r.words, 8) for r in model.table.select("words").toLocalIterator()]
    keys, counts = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, t) for k, t in ((0, np.uint64), (1, np.int64)))
    order = np.argsort(keys)
    counts = counts[order]
    return keys[order], counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64)


def looked_up(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Counts of ``asked`` by the table (keys ascending), 0 for those it lacks."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, counts[at], 0).astype(np.int64)


def base_term(counts: np.ndarray, tokens: int, words: int) -> np.ndarray:
    return np.log10((counts + 0.5) / (tokens + 0.5 * (words + 1)))


def score(docs: DataFrame, model: Model, table_words: int = TABLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of ``docs``."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    if model.filter.data is None:
        return _score_by_segment(rows, model)
    if model.filter.words <= table_words:
        return _score_with_table(rows, model)
    return _score_by_join(rows, model)


SCORES = "n_tokens long, n_known long, base_score double, score double"


def _sums(first: np.ndarray, counts: np.ndarray, p: np.ndarray, f: Filter) -> tuple[np.ndarray, ...]:
    """The columns of ``SCORES`` of each text, from its tokens' exact counts and log10 P."""
    added = [np.add.reduceat(x, first) for x in ((counts > 0).astype(np.int64), base_term(counts, f.tokens, f.words), p)]
    return np.diff(np.append(first, len(p))), *added


def _score_with_table(rows: DataFrame, model: Model) -> DataFrame:
    spark = rows.sparkSession
    fitted, table = shared(spark, model.filter), shared(spark, word_table(model))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = fitted.value
        for batch in batches:
            out = []
            for tokens, first in token_runs(batch.column("text")):
                distinct, back = np.unique(tokens, return_inverse=True)
                p = f.log10_of(Grams.of(tokens), f.counts(distinct)[back])
                out.append(_sums(first, looked_up(*table.value, distinct)[back], p, f))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.concatenate(x)) for x in zip(*out, strict=True))], ["doc_id", *(c.split()[0] for c in SCORES.split(", "))])

    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, {SCORES}")


def _score_by_join(rows: DataFrame, model: Model) -> DataFrame:
    """As above for a table of any size: a document's distinct words meet the table by hash."""
    fitted = shared(rows.sparkSession, model.filter)
    kind = dict(rows.dtypes)["doc_id"]
    scored = written(rows.withColumn("row", F.concat_ws(":", F.monotonically_increasing_id(), F.uuid())), "numbered")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for tokens, first in token_runs(batch.column("text")):
                totals = np.add.reduceat(fitted.value.log10_probability(tokens), first)
                found += [(np.unique(t, return_counts=True), s) for t, s in zip(np.split(tokens, first[1:]), totals.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array([int(n.sum()) for (_, n), _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64()), pa.array([k.view(np.int64) for (k, _), _ in found], pa.list_(pa.int64())), pa.array([n for (_, n), _ in found], pa.list_(pa.int64()))],
                ["doc_id", "row", "n_tokens", "score", "words", "times"],
            )

    docs = written(scored.mapInArrow(tidy(run), f"doc_id {kind}, row string, n_tokens long, score double, words array<long>, times array<long>"), "scored")

    def flat(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("words"):
                keys, counts = unpack(blob.as_py(), 8)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "c"])

    table = model.table.select("words").mapInArrow(flat, "word long, c long")
    each = docs.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("n"))
    n, v = model.filter.tokens, model.filter.words
    c = F.coalesce("c", F.lit(0))
    sums = each.join(table, "word", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"), F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(n + 0.5 * (v + 1)))).alias("base_score"))
    return docs.join(sums, "row").select("doc_id", "n_tokens", "n_known", "base_score", "score")


def zipped(table: pa.Table) -> bytes:
    """Arrow's stream format, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unzipped(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _score_by_segment(rows: DataFrame, model: Model) -> DataFrame:
    """As above for a filter of any size: n-grams go to their segments, levels and exact counts of words come back."""
    id_type = rows.schema["doc_id"].dataType
    f = model.filter
    n_segments, bits = f.n_segments, f.bits

    def together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a chunk, so that a chunk is never in two tasks."""
        held: list[pa.RecordBatch] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column("doc_id").combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), ids, pa.array([zipped(table.select(["text"]))])], ["chunk", "ids", "texts"])

        for batch in batches:
            a = 0
            for k, text in enumerate(batch.column("text")):
                size += text.as_buffer().size if text.is_valid else 0
                if size >= CHUNK_BYTES or k == batch.num_rows - 1:
                    held.append(batch.slice(a, k + 1 - a))
                    a = k + 1
                if size >= CHUNK_BYTES:
                    yield chunk()
                    held, size = [], 0
        if held:
            yield chunk()

    def ngrams(texts: bytes) -> tuple[Grams, np.ndarray]:
        (tokens, first), = token_runs(unzipped(texts).column("text"), 1 << 62)
        return Grams.of(tokens), first

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts in zip(batch.column("chunk").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                parts: dict[str, dict[int, bytes]] = {}
                for kind, hashes in ngrams(texts)[0].each():
                    hashes, width = distinct(hashes), KEY_BYTES[kind]
                    order, names, first = by_segment(segment_of(hashes, n_segments), n_segments)
                    keys = np.ascontiguousarray(hashes[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
                    ends = [*first[1:].tolist(), len(hashes)][: len(first)]
                    parts[kind] = {s: keys[a * width : b * width] for s, a, b in zip(names.tolist(), first.tolist(), ends, strict=True)}
                every = sorted(set().union(*parts.values()))
                yield pa.RecordBatch.from_pydict({"segment": every, "chunk": [chunk] * len(every), **{kind: [parts[kind].get(s) for s in every] for kind in KINDS}}, pa.schema([("segment", pa.int64()), ("chunk", pa.string()), *[(kind, pa.binary()) for kind in KINDS]]))

    def answer(asked: pa.Table, counted: pa.Table) -> pa.Table:
        made = counted.to_pylist()[0] if counted.num_rows else {"words": pack(*merged([], 8), 8), "bits": bytes(bits // 8)}
        data, known = np.frombuffer(made["bits"], np.uint8), unpack(made["words"], 8)
        out: dict[str, list] = {**{kind: [] for kind in KINDS}, "counts": []}
        for kind in KINDS:
            width = KEY_BYTES[kind]
            blobs = [b or b"" for b in asked.column(kind).to_pylist()]
            for run in in_runs(blobs, ASKED_KEYS * width):  # a call for the keys of many chunks, as one chunk has few in a segment
                raw = np.frombuffer(b"".join(run), np.uint8).reshape(-1, width)
                keys = np.zeros((len(raw), 8), np.uint8)
                keys[:, :width] = raw
                keys = keys.view("<u8").ravel()
                upto = [0, *accumulate(len(b) // width for b in run)]
                level = probe(data, None, keys, kind, bits).tobytes()
                out[kind] += [level[a:b] for a, b in pairwise(upto)]
                if kind == "words":
                    counts = looked_up(*known, keys).tobytes()
                    out["counts"] += [counts[8 * a : 8 * b] for a, b in pairwise(upto)]
        return pa.table({"chunk": asked.column("chunk"), "segment": asked.column("segment"), **{c: pa.array(v, pa.binary()) for c, v in out.items()}})

    def finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids = docs.column("ids")[0].values
        grams, first = ngrams(docs.column("texts")[0].as_py())
        answers = answers.sort_by("segment")

        def returned(column: str, dtype: type = np.uint8) -> np.ndarray:
            return np.frombuffer(b"".join(answers.column(column).to_pylist()), dtype)

        at = {}  # the place of each n-gram among what came back
        for kind, hashes in grams.each():
            back = places(hashes)
            different = np.empty(int(back.max(initial=-1)) + 1, np.uint64)
            different[back] = hashes
            order = by_segment(segment_of(different, n_segments), n_segments)[0]
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at[kind] = place[back]
        own, pair = (STANDS_FOR[returned(kind)][at[kind]] for kind in ("words", "pairs"))
        triple = np.zeros(len(own))
        triple[~grams.begins] = STANDS_FOR[returned("triples")][at["triples"]]
        p = f.estimates(grams.begins, own, pair, triple, float(own[grams.tokens == END][0]))
        sums = _sums(first, returned("counts", np.int64)[at["words"]], p, f)
        return pa.table({"doc_id": ids, **{c.split()[0]: pa.array(x) for c, x in zip(SCORES.split(", "), sums, strict=True)}})

    kind = id_type.simpleString()
    chunks = written(rows.mapInArrow(tidy(together), f"chunk string, ids array<{kind}>, texts binary"), "chunks")

    def scored(docs: DataFrame) -> DataFrame:
        asked = docs.select("chunk", "texts").mapInArrow(tidy(ask), f"segment long, chunk string, {BLOBS}")
        answers = asked.groupBy("segment").cogroup(model.table.groupBy("segment")).applyInArrow(answer, f"chunk string, segment long, {BLOBS}, counts binary")
        return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"doc_id {kind}, {SCORES}")

    parts = []
    for k in range(PASSES):
        with shuffles_dropped(rows.sparkSession):
            parts.append(written(scored(chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(PASSES)) == k)), "scores"))
    return reduce(DataFrame.unionByName, parts)


def lm_scores(docs: DataFrame, held_out_fold: int = 1, table_words: int = TABLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all rows outside the fold and score every row."""
    training = docs.where(fold_of(col(id_col)) != held_out_fold).select(col(text_col).cast("string").alias("text"))
    model = train(training)
    out = score(docs, model, table_words, id_col, text_col)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == held_out_fold).alias("held_out"), "n_tokens", "n_known", F.lit(model.filter.tokens).cast("long").alias("train_tokens"), "base_score", "score")
