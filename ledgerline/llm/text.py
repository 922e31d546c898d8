"""Words and the other text measures that several operators share.

A word is a maximal run of characters other than space and U+0009 to U+000D.
In UTF-8 that is what ``bytes.split()`` gives, and ``bytes.lower()`` lowers
A-Z alone, so the Python operators work on bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import trim_python

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of ``text`` as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    """UTF-8 bytes of ``text``; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty (0)."""
    return F.crc32(F.coalesce(text, F.lit(""))).cast("long")


def fold_of(doc_id: Column) -> Column:
    """``crc32(doc_id as text) mod 5``; a null id is in fold 0 as the empty text's CRC is 0."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5).cast("int")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text, as UTF-8; none for null."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


RUN_BYTES = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def text_runs(texts: Iterable[str | None], most: int = RUN_BYTES) -> Iterator[list[bytes]]:
    """Texts as UTF-8 (null: empty), in runs of about ``most`` bytes; none is empty."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(b"" if text is None else text.encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class Words:
    """The words of some texts: data[begin : end] of each, and where the words of each text start (and, last, how many there are)."""

    data: bytes
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        data = b" ".join([b"", *texts, b""])
        blank = _BLANK[np.frombuffer(data, np.uint8)]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # data starts and ends with a blank
        begin = edges[::2]
        at = np.cumsum([1, *(len(t) + 1 for t in texts)])
        return cls(data, begin, edges[1::2], np.searchsorted(begin, at))

    def split(self, values: np.ndarray) -> list[np.ndarray]:
        """What ``values``, one a word, has for each text."""
        return np.split(values, self.first[1:-1])

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words with A-Z lowered."""
        return span_hashes(self.data.lower(), self.begin, self.end)


#: Low bytes that a word of 0 to 8 bytes has in an integer.
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def packed(data: bytes, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and second eight bytes of each span of ``data``, zeros behind its end."""
    held = data + bytes(2 * 8)
    at = np.ndarray((len(data) + 8 + 1,), "<u8", held, strides=(1,))  # the integer that starts at each byte
    return at[begin] & _LOW[np.minimum(length, 8)], at[begin + np.minimum(length, 8)] & _LOW[np.clip(length - 8, 0, 8)]


def mixed_bytes(lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> np.ndarray:
    """One 64-bit hash of the bytes and the length of each word of 16 bytes at most."""
    return mixed(lo ^ mixed(hi + (length.astype(np.uint64) << np.uint64(56))))


def span_hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of ``data``, without a step a word but for those longer than 16 bytes."""
    length = end - begin
    out = mixed_bytes(*packed(data, begin, length), length)
    for k in np.flatnonzero(length > 16).tolist():
        out[k] = xxhash.xxh64_intdigest(data[begin[k] : end[k]], 42)
    return out


def hashed_runs(texts: Iterable[str | None], most: int = RUN_BYTES) -> Iterator[list[np.ndarray]]:
    """64-bit hashes of the words (A-Z lowered) of each text, in runs of texts."""
    for run in text_runs(texts, most):
        words = Words.of(run)
        yield words.split(words.hashes())


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them (all in uint64 arithmetic)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words; none if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0 or not width:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mixed(out + words[k : k + n] + np.uint64(k + 1))
    return out


def shingles_by_text(rows: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Shingle hashes, with repeats, of each row of word hashes; a row of fewer words is one shingle.  Rows are hashed together."""
    x = shingle_hashes(np.concatenate(rows), width) if rows else np.empty(0, np.uint64)
    out, at = [], 0
    for row in rows:
        n = len(row)
        out.append(x[at : at + n - width + 1] if n >= width else shingle_hashes(row, n))
        at += n
    return out


def col(name: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column has (Spark's names don't tell cases apart)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def mapped_rows(docs: DataFrame, run) -> DataFrame:
    """``docs`` through an Arrow map that keeps its columns, which may have any names (Arrow maps refuse some, so they are renamed for it)."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(tidy(run), plain.schema).toDF(*docs.columns)


def tidy(run):
    """``run`` for an Arrow map; when its batches end, the worker, which lives on, gives freed memory back to the machine."""

    def wrapped(batches):
        yield from run(batches)
        trim_python()

    return wrapped
