"""Token ids in binary files of patched frame-of-reference blocks.

A file holds whole documents in ascending id order.  Its ids are one long
sequence in blocks of 1024.  A block stores its minimum, a width that covers
``PERCENTILE`` per cent of its differences to the minimum, the low bits of
all differences packed at that width, and for the outliers a list of places
and of high bits.  An index has the offset of every block's start, so a
reader can decode any range of ids alone.

Layout, little-endian::

    header   "LPFR" version u32
    blocks   minimum u32, width u8, pad u8, exceptions u16, width * 16 words
             u64, places u16 each, high parts u32 each
    tables   block starts u64 each; document ids as a JSON array of texts and
             nulls; ids of each document u64 each
    footer   blocks u64, ids u64, documents u64, start of tables u64,
             bytes of document ids u64, "LPFR"

Packing is vertical: 16 lanes of 64 values, a lane's values one after the
other in its own 64-bit words, so all blocks of a width pack together.

Plan: a range exchange by document id (its sampling bounds the ranges), one
task a range encodes and writes one file in the shared folder; per-file
totals (a row a file) give every file's first position; one task a file
reads it back in runs of blocks.  Files are written under a task-own name
and renamed, and their content depends on the range alone, so a repeated
task is harmless.

Defined results: a null or empty text is the end id alone; null ids come
first; rows of one id stand in order of their texts' hashes; an empty table
makes no document; only id and text are read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fst_tokens import PART, cut, word_starts
from .storage import scratch_path, shared, written
from .text import col, mixed_bytes, packed

BLOCK = 1024
LANES, ROWS = 16, 64
PERCENTILE = 90
MAGIC = b"LPFR"
FOOTER = struct.Struct("<QQQQQ4s")
HEAD = struct.Struct("<IBBH")
GROUP = 256
#: Places of the table of words, ids and bytes of each, and characters encoded together.
SLOTS, MOST_IDS, SHORT = 1 << 20, 12, 16
RUN_CHARACTERS = 1 << 21


def _pack(d: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 1024) values below 2 ** width as (blocks, width * 16) words."""
    words = np.zeros((len(d), max(width, 1), LANES), np.uint64)
    rows = d.reshape(len(d), ROWS, LANES).astype(np.uint64)
    for r in range(ROWS if width else 0):
        word, off = divmod(r * width, 64)
        words[:, word] |= rows[:, r] << np.uint64(off)
        if off + width > 64:
            words[:, word + 1] |= rows[:, r] >> np.uint64(64 - off)
    return words[:, :width].reshape(len(d), width * LANES)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    words = words.reshape(len(words), width, LANES)
    out = np.zeros((len(words), ROWS, LANES), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for r in range(ROWS if width else 0):
        word, off = divmod(r * width, 64)
        v = words[:, word] >> np.uint64(off)
        if off + width > 64:
            v = v | (words[:, word + 1] << np.uint64(64 - off))
        out[:, r] = v & mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of ``ids``; the last is filled up with its own minimum."""
    n = -(-len(ids) // BLOCK)
    x = np.zeros(n * BLOCK, np.uint32)
    x[: len(ids)] = ids
    if len(ids) % BLOCK:
        x[len(ids) :] = x[(n - 1) * BLOCK : len(ids)].min()
    x = x.reshape(n, BLOCK)
    low = x.min(axis=1)
    d = x - low[:, None]
    rank = BLOCK * PERCENTILE // 100 - 1
    widths = np.ceil(np.log2(np.partition(d, rank, axis=1)[:, rank].astype(np.float64) + 1)).astype(int)
    out: list[bytes] = [b""] * n
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        own = d[rows]
        packed = _pack(own & np.uint32((1 << width) - 1), width)
        high = own >> np.uint32(width) if width < 32 else np.zeros_like(own)
        for k, row in enumerate(rows.tolist()):
            places = np.flatnonzero(high[k])
            out[row] = HEAD.pack(int(low[row]), width, 0, len(places)) + packed[k].tobytes() + places.astype("<u2").tobytes() + high[k][places].astype("<u4").tobytes()
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """All ids of the blocks that start at ``starts`` in ``data``."""
    heads = [HEAD.unpack_from(data, s) for s in starts.tolist()]
    out = np.empty((len(heads), BLOCK), np.uint32)
    widths = np.array([h[1] for h in heads])
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        words = np.stack([np.frombuffer(data, "<u8", width * LANES, int(starts[r]) + HEAD.size) for r in rows]) if width else np.zeros((len(rows), 0), np.uint64)
        out[rows] = _unpack(words, width).astype(np.uint32)
    for k, (low, width, _, n) in enumerate(heads):
        if n:
            at = int(starts[k]) + HEAD.size + width * LANES * 8
            places = np.frombuffer(data, "<u2", n, at)
            out[k, places] |= np.frombuffer(data, "<u4", n, at + 2 * n) << np.uint32(width)
        out[k] += np.uint32(low)
    return out.ravel()


class Writer:
    """One file; documents are appended in order."""

    def __init__(self, sink) -> None:
        self.sink, self.at = sink, 0
        self.starts: list[int] = []
        self.names: list[str | None] = []
        self.sizes: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self._put(MAGIC + struct.pack("<I", 1))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: str | None, ids: np.ndarray) -> None:
        self.names.append(doc_id)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= GROUP * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        if not self.waiting:
            return
        ids = np.concatenate(self.waiting)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, whole, GROUP * BLOCK):
            for block in encode_blocks(ids[k : min(k + GROUP * BLOCK, whole)]):
                self.starts.append(self.at)
                self._put(block)
        self.waiting = [ids[whole:]] if whole < len(ids) else []
        self.n_waiting = len(ids) - whole

    def close(self) -> int:
        self._flush(True)
        tables, names = self.at, json.dumps(self.names).encode()
        self._put(np.array(self.starts, "<u8").tobytes() + names + np.array(self.sizes, "<u8").tobytes())
        self._put(FOOTER.pack(len(self.starts), sum(self.sizes), len(self.sizes), tables, len(names), MAGIC))
        return sum(self.sizes)


class Reader:
    """Random access to one file through its block index."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        blocks, self.n_ids, docs, tables, names, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token-id blocks")
        data = source.read_at(size - FOOTER.size - tables, tables)
        self.starts = np.append(np.frombuffer(data, "<u8", blocks), tables).astype(np.int64)
        self.names = json.loads(data[8 * blocks : 8 * blocks + names])
        self.sizes = np.frombuffer(data, "<u8", docs, 8 * blocks + names).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file, decoding only the blocks that hold them."""
        if end <= start:
            return np.empty(0, np.uint32)
        a, b = start // BLOCK, -(-end // BLOCK)
        first = self.starts[a]
        data = self.source.read_at(int(self.starts[b] - first), int(first))
        return decode_blocks(data, self.starts[a:b] - first)[start - a * BLOCK : end - a * BLOCK]

    def documents(self, run: int = GROUP * BLOCK) -> Iterator[tuple[str | None, int, np.ndarray]]:
        """(id, start in the file, ids) of every document, reading ``run`` ids or one document at a time."""
        ends = np.cumsum(self.sizes)
        k = 0
        while k < len(self.sizes):
            start = int(ends[k] - self.sizes[k])
            upto = max(k + 1, int(np.searchsorted(ends, start + run, side="right")))
            ids = self.ids(start, int(ends[upto - 1]))
            for j in range(k, upto):
                a = int(ends[j] - self.sizes[j])
                yield self.names[j], a, ids[a - start : int(ends[j]) - start]
            k = upto


def distinct(lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each, a place of each different (lo, hi, length), which of them each is)."""
    h = mixed_bytes(lo, hi, length)
    _, one, back = np.unique(h, return_index=True, return_inverse=True)
    first = one[back]
    if not (np.array_equal(lo[first], lo) and np.array_equal(hi[first], hi) and np.array_equal(length[first], length)):  # two of one hash
        _, one, back = np.unique(np.stack([lo, hi, length.astype(np.uint64)], axis=1), axis=0, return_index=True, return_inverse=True)
    return h, one, back.ravel()


class Encoder:
    """The library's ids of whole texts, asked for once for each distinct word.

    The byte-level pre-tokenizer's words, found by its transducer (see
    ``fst_tokens``), are encoded each on its own by the library, so equal
    words may share one answer.  Words are told apart by all their bytes: up
    to ``SHORT`` bytes are two integers and a length, longer words are keys of
    a dictionary of their run.  Answers for short words stay in a table of
    ``SLOTS`` places in which a later word replaces an earlier one.
    """

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(spec)
        pre = json.loads(spec)["pre_tokenizer"]
        self.by_word = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lo, self.hi = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.length, self.size = np.zeros(SLOTS, np.uint8), np.zeros(SLOTS, np.uint8)
        self.ids = np.zeros((SLOTS, MOST_IDS), np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``words`` by the library, and the size of each.

        Those that start with a space and go on with another character are
        joined: of such a word's ids the first alone starts with a space.
        """
        joins = np.array([w[0] == " " and len(w) > 1 and not w[1].isspace() for w in words])
        sizes, found = np.zeros(len(words), np.int64), []
        where = [np.flatnonzero(joins), np.flatnonzero(~joins)]
        if len(where[0]):
            ids = np.array(self.tokenizer.encode_batch_fast(["".join([words[k] for k in where[0]])], add_special_tokens=False)[0].ids, np.uint32)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(where[0]):
                raise ValueError("a space does not start a word here")
            sizes[where[0]] = np.diff(np.append(starts, len(ids)))
            found.append(ids)
        if len(where[1]):
            each = [e.ids for e in self.tokenizer.encode_batch_fast([words[k] for k in where[1]], add_special_tokens=False)]
            sizes[where[1]] = [len(e) for e in each]
            found.append(np.array([i for e in each for i in e], np.uint32))
        # both kinds in the order of words
        order = np.concatenate(where)
        n = sizes[order]
        ids, starts = np.concatenate(found), np.empty(len(words), np.int64)
        starts[order] = np.cumsum(n) - n
        return gathered(ids, starts, sizes), sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; long ones pass in pieces that end where a word does in any case."""
        if not self.by_word or any(len(t) > RUN_CHARACTERS for t in texts):
            long = [[self._encode([p])[0] for p in cut(t, RUN_CHARACTERS)] if self.by_word and not self.special(t) else [self.whole(t)] for t in texts]
            return [np.concatenate(x) for x in long]
        return self._encode(texts)

    def special(self, text: str) -> bool:
        return any(a in text for a in self.added)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        own = []
        for k, text in enumerate(texts):
            if self.special(text):
                out[k] = self.whole(text)
            elif text:
                own.append(k)
        if not own:
            return out
        joined = PART.join([texts[k] for k in own]) + PART
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = joined.encode("utf-8", "surrogatepass")
        at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        first = np.flatnonzero(word_starts(codes))
        begin, end = at[first], np.append(at[first[1:]], len(raw))
        part = codes[first] == ord(PART)
        length = end - begin
        short = np.flatnonzero(length <= SHORT)
        size = length[short]
        lo, hi = packed(raw, begin[short], size)
        h, one, back_short = distinct(lo, hi, size)
        lo, hi, size, h = lo[one], hi[one], size[one], h[one]
        back = np.empty(len(begin), np.int64)
        back[short] = back_short
        place, longer = short[one], {}  # a place of each different word; those that are longer
        for k in np.flatnonzero(length > SHORT).tolist():
            word = raw[begin[k] : end[k]]
            if word not in longer:
                longer[word] = len(place) + len(longer)
            back[k] = longer[word]
        slot = (h >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)
        known = (self.lo[slot] == lo) & (self.hi[slot] == hi) & (self.length[slot] == size) & (self.size[slot] > 0)
        new = np.flatnonzero(~known & ~part[place])
        sizes = np.zeros(len(place) + len(longer), np.int64)
        sizes[: len(place)] = np.where(known, self.size[slot], 0)
        table, starts = self.ids[slot].ravel(), np.arange(len(sizes)) * MOST_IDS
        if len(new) or longer:
            words = [raw[a:b].decode() for a, b in zip(begin[place[new]].tolist(), end[place[new]].tolist(), strict=True)]
            ids, n = self.ask(words + [w.decode() for w in longer])
            asked = np.concatenate([new, np.arange(len(place), len(sizes))])
            sizes[asked], starts[asked] = n, len(table) + np.cumsum(n) - n
            fits = np.flatnonzero(n[: len(new)] <= MOST_IDS)
            last = np.unique(slot[new[fits]][::-1], return_index=True)[1]  # of several for one slot, one
            keep = fits[len(fits) - 1 - last]
            to = slot[new[keep]]
            self.lo[to], self.hi[to], self.length[to], self.size[to] = lo[new[keep]], hi[new[keep]], size[new[keep]], n[keep]
            padded = np.concatenate([ids, np.zeros(MOST_IDS, np.uint32)])
            self.ids[to] = padded[(np.cumsum(n) - n)[keep][:, None] + np.arange(MOST_IDS)]
            table = np.concatenate([table, ids])
        sizes[: len(place)][part[place]] = 0
        n = sizes[back]
        ids = gathered(table, starts[back], n)
        upto = np.append(0, np.cumsum(n)[part])
        for k, a, b in zip(own, upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            out[k] = ids[a:b]
        return out


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``ids[start : start + size]``, one after the other."""
    at = np.cumsum(sizes) - sizes
    return ids[np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def open_file(uri: str) -> Reader:
    fs, path = pafs.FileSystem.from_uri(uri)
    return Reader(fs.open_input_file(path))


def runs(names: pa.Array, texts: pa.Array, size: int = RUN_CHARACTERS) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts in runs of about ``size`` characters."""
    held: tuple[list, list[str]] = [], []
    n = 0
    for name, text in zip(names, texts, strict=True):
        held[0].append(name.as_py())
        held[1].append(text.as_py() or "")
        n += len(held[1][-1])
        if n >= size:
            yield held
            held, n = ([], []), 0
    yield held


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every row and write the files; file (its number, in id order), path, n_docs and n_ids of each."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = shared(docs.sparkSession, f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, writer, out = TaskContext.get().partitionId(), None, None
        fs, base = pafs.FileSystem.from_uri(folder)
        own, final = f"{base}/.{number:06d}-{uuid.uuid4().hex}", f"{base}/ids-{number:06d}.lpfr"
        for batch in batches:
            if writer is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(own)
                writer = Writer(out)
            encoder = _encoder(spec.value)
            for names, texts in runs(batch.column("doc_id"), batch.column("text")):
                for doc_id, ids in zip(names, encoder.encode(texts), strict=True):
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            n_ids = writer.close()
            out.close()
            fs.move(own, final)
            yield pa.RecordBatch.from_pylist([{"file": number, "path": f"{folder}/ids-{number:06d}.lpfr", "n_docs": len(writer.sizes), "n_ids": n_ids}])

    # the id is dealt and sorted in its own type and written as text
    rows = docs.select(col(id_col).alias("key"), col(text_col).cast("string").alias("text"))
    # rows of one id and text are equal here: a salt lets them fall into several ranges
    order = F.col("key").asc_nulls_first(), F.xxhash64("text"), F.col("salt")
    dealt = rows.withColumn("salt", F.rand(7)).repartitionByRange(*order).sortWithinPartitions(*order)
    files = dealt.select(F.col("key").cast("string").alias("doc_id"), "text").mapInArrow(run, "file long, path string, n_docs long, n_ids long")
    return written(files, "token-files")


def read_token_files(spark: SparkSession, files: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from ``files``."""
    base, rows = 0, []
    for r in files.select("file", "path", "n_ids").orderBy("file").collect():  # a row a file
        rows.append((r.path, base))
        base += r.n_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for doc_id, at, ids in open_file(r["path"]).documents():
                    for name, v in zip(found, (doc_id, r["base"] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        found[name].append(v)
                yield pa.RecordBatch.from_pydict(found, pa.schema([("doc_id", pa.string()), *[(c, pa.int64()) for c in ("start", "n_tokens", "ids_crc32")]]))

    todo = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)), "path")
    return todo.mapInArrow(run, "doc_id string, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast(id_type))


def token_id_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files in ``folder`` (a new one in the shared folder) and digest them as read back."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "ids")
    files = write_token_files(docs, tokenizer_path, folder, id_col=id_col, text_col=text_col)
    return read_token_files(spark, files, dict(docs.dtypes)[id_col])
