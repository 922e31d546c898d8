"""Token counts by a compiled tokenizer: two deterministic transducers.

**Words.**  The byte-level pre-tokenizer (contractions, letters, numbers,
other signs, white space) is a transducer over 11 character classes with 11
states.  A transition says whether a word starts at this character, and
whether one starts at the character before (its two look-aheads resolve one
character late).  A text is cut into chunks; each chunk's state map is an
element of the transducer's finite transition monoid, found by one table
look-up a character; a parallel prefix scan composes the maps, which gives
every chunk's first state; a second pass emits the starts.

**Tokens.**  A byte-pair encoding of every prefix ends with one token, and a
token may follow another iff no merge crosses their seam.  After some bytes
of a word, what still matters is, for each place before which the encoding
may be cut and from which the rest is a proper prefix of a token: that
trie node, the token before the place, and the count there against the count
here.  These are the states of a deterministic transducer from bytes to
counts; a transition is annotated with the change of the count.  States are
compiled as texts need them and kept in the worker; all words of a batch run
in lockstep.  A token before a place is kept only as far as it restricts
what may follow.

Plan: one scan and one Arrow map, no shuffle.  The tokenizer file (a few MB,
its size does not depend on the data) is read on the driver and broadcast.
Memory: texts are joined up to ``BATCH`` characters; longer ones are cut
before white space that follows another character, where a word always
starts.  Tables that grow beyond ``MOST_CELLS`` cells or ``MOST_STATES`` states
are dropped, inside a long word too: the states that words are in stay and the
others are compiled again when needed.  What is known of seams is dropped on
its own beyond ``MOST_FITS``.

Defined results: a null or empty text has no bytes and no tokens; an added
token's string inside a text is that one token, as the library has it by
default; repeated rows count alike; other columns are not read; an empty
table gives no rows.  Files other than byte-level BPE with the library's own
pattern are refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import shared
from .text import col, tidy, utf8_bytes

BATCH = 1 << 20
CHUNK = 256
MOST_CELLS, MOST_STATES, MOST_FITS = 36 << 20, 1 << 17, 1 << 19
SMALL_SUBTREE = 12
#: No string that Arrow carries holds a lone surrogate, so it can part texts.
PART = "\ud800"

# character classes
END, LETTER, STMD, RV, E, L, NUMBER, SPACE, WHITE, QUOTE, OTHER = range(11)
LETTERS = (LETTER, STMD, RV, E, L)
# states: a word starts whatever comes; runs; a fresh quote and what may follow it; white space, first and later
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AT_QUOTE, QUOTE_RV, QUOTE_L, SPACE_1, WHITE_1, SPACE_N, WHITE_N = range(11)


def _fresh(c: int) -> int:
    return {END: FRESH, NUMBER: IN_NUMBERS, SPACE: SPACE_1, WHITE: WHITE_1, QUOTE: AT_QUOTE, OTHER: IN_OTHER}.get(c, IN_LETTERS)


def _step(state: int, c: int) -> tuple[int, int, int]:
    """(next state, a word starts here, one starts at the character before)."""
    blank = c in (SPACE, WHITE)
    if state in (SPACE_1, SPACE_N, WHITE_1, WHITE_N):
        if blank:
            return (SPACE_N if c == SPACE else WHITE_N), 0, 0
        late = int(state in (SPACE_N, WHITE_N) and c != END)
        if c == END or state in (WHITE_1, WHITE_N):
            return _fresh(c), 1, late
        return (IN_OTHER if c == QUOTE else _fresh(c)), 0, late  # the space belongs to what follows
    if state in (QUOTE_RV, QUOTE_L):
        if c == (E if state == QUOTE_RV else L):
            return FRESH, 0, 0
        return (_fresh(c), int(c not in LETTERS), 1)
    if state == AT_QUOTE:
        after = {STMD: FRESH, RV: QUOTE_RV, L: QUOTE_L, OTHER: IN_OTHER, QUOTE: IN_OTHER}
        return (after[c], 0, 0) if c in after else (_fresh(c), 1, 0)
    same = {IN_LETTERS: LETTERS, IN_NUMBERS: (NUMBER,), IN_OTHER: (OTHER, QUOTE)}.get(state, ())
    return (state, 0, 0) if c in same else (_fresh(c), 1, 0)


@cache
def word_transducer() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """next[state * 11 + c], start, late; the monoid's step[map * 11 + c] and compose[map, map]."""
    n = 11
    table = [[_step(s, c) for c in range(n)] for s in range(n)]
    maps = [tuple(range(n))]
    known = {maps[0]: 0}
    step = []
    for m in maps:  # grows as new maps are found
        for c in range(n):
            to = tuple(table[s][c][0] for s in m)
            if to not in known:
                known[to] = len(maps)
                maps.append(to)
            step.append(known[to])
    compose = np.array([[known[tuple(b[s] for s in a)] for b in maps] for a in maps], np.int32)
    flat = [np.array([table[s][c][k] for s in range(n) for c in range(n)], np.uint8) for k in range(3)]
    return *flat, np.array(step, np.int32), np.concatenate([compose.ravel(), np.array(maps, np.int32).ravel()])


@cache
def character_classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        out[np.frombuffer("".join(regex.findall(pattern, everything)).encode("utf-32-le"), np.uint32)] = kind
    for kind, signs in ((STMD, "stmd"), (RV, "rv"), (E, "e"), (L, "l"), (SPACE, " "), (QUOTE, "'"), (END, PART)):
        out[[ord(c) for c in signs]] = kind
    return out


def word_starts(codes: np.ndarray) -> np.ndarray:
    """Whether a word starts at each code point; texts are parted by PART."""
    following, start, late, step, packed = word_transducer()
    n_maps = len(step) // 11
    compose, maps = packed[: n_maps * n_maps], packed[n_maps * n_maps :]
    n = len(codes)
    chunks = -(-n // CHUNK)
    kinds = np.zeros(chunks * CHUNK, np.uint8)
    kinds[:n] = character_classes()[codes]
    kinds = np.ascontiguousarray(kinds.reshape(chunks, CHUNK).T)
    m = np.zeros(chunks, np.int32)
    for row in kinds:
        m = step[m * 11 + row]
    d = 1
    while d < chunks:  # the scan: m[i] becomes the map of chunks 0 to i
        m[d:] = compose[m[:-d] * n_maps + m[d:]]
        d *= 2
    state = np.zeros(chunks, np.int32)
    state[1:] = maps[m[:-1] * 11 + FRESH]
    out = np.zeros((CHUNK + 1, chunks), np.uint8)
    for k, row in enumerate(kinds):
        key = state * 11 + row
        out[k + 1] = start[key]
        out[k] |= late[key]
        state = following[key].astype(np.int32)
    flags = np.ascontiguousarray(out[1:].T).ravel()
    flags[CHUNK - 1 : -1 : CHUNK] |= out[0, 1:]  # a late start at the end of the chunk before
    return flags[:n]


class Tokens:
    """The transducer from the bytes of a word to its count, compiled as needed."""

    def __init__(self, spec: str) -> None:
        model = json.loads(spec)
        pre = model["pre_tokenizer"]
        if model["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model.get("normalizer") or model["model"].get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        self.added = [t["content"] for t in model["added_tokens"]]
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printed))}
        ids = model["model"]["vocab"]
        added = set(self.added)
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in ids.items() if s not in added}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, merge in enumerate(model["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, z = ids[a], ids[b], ids[a + b]
            self.rank[x, y] = k, z
            self.parts.setdefault(z, (x, y, k))
        self.child: dict[tuple[int, int], int] = {}
        self.token_at: dict[int, int] = {}
        inner, nodes = {0: []}, 1
        for i, s in self.bytes_of.items():
            node = 0
            for b in s:
                inner.setdefault(node, []).append(i)
                if (node, b) not in self.child:
                    self.child[node, b] = nodes
                    nodes += 1
                node = self.child[node, b]
            self.token_at[node] = i
        #: tokens strictly below a node, where they are few
        self.below = {k: tuple(v) for k, v in inner.items() if len(v) <= SMALL_SUBTREE}
        self.inner = set(inner)
        self.reset()

    def reset(self) -> None:
        self.spine: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, int] = {}
        self.entries: list[tuple] = []
        self.column = np.full(256, -1, np.int64)
        self.n_columns = 0
        self.to = np.full((1024, 64), -1, np.int32)
        self.change = np.zeros((1024, 64), np.int8)
        self.state(((0, -1, 0),))

    # -- which token may follow which

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Pieces at one edge of a token from its byte up, each with the rank at which it is merged away."""
        key = token, side
        if key not in self.spine:
            out, until = [], 1 << 60
            while token in self.parts:
                out.append((token, until))
                *pair, until = self.parts[token]
                token = pair[side]
            out.append((token, until))
            self.spine[key] = out[::-1]
        return self.spine[key]

    def whole(self, token: int) -> bool:
        """Whether the token's bytes alone are encoded as this token."""
        seq = [self.byte_ids[b] for b in self.bytes_of[token]]
        while len(seq) > 1:
            found = [(self.rank[p][0], k) for k, p in enumerate(zip(seq, seq[1:], strict=False)) if p in self.rank]
            if not found:
                break
            _, k = min(found)
            seq[k : k + 2] = [self.rank[seq[k], seq[k + 1]][1]]
        return seq == [token]

    @property
    def byte_ids(self) -> dict[int, int]:
        if not hasattr(self, "_byte_ids"):
            self._byte_ids = {s[0]: i for i, s in self.bytes_of.items() if len(s) == 1}
        return self._byte_ids

    def may_follow(self, before: int, token: int) -> bool:
        """Whether ``token`` may stand after ``before`` (-1: at the start of a word)."""
        key = before, token
        if key not in self.fits:
            if len(self.fits) >= MOST_FITS:
                self.fits.clear()
                self.spine.clear()
            self.fits[key] = self.whole(token) if before < 0 else self.may_follow(-1, token) and self.seam_holds(before, token)
        return self.fits[key]

    def seam_holds(self, before: int, token: int) -> bool:
        """No merge joins a right edge of ``before`` with a left edge of ``token`` while both exist.

        Of equal ranks the leftmost pair merges first.
        """
        left, right, i, j = self.edge(before, 1), self.edge(token, 0), 0, 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            found = self.rank.get((x, y))
            if found and found[0] < x_until and found[0] <= y_until:
                return False
            if i == len(left) - 1 and j == len(right) - 1:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    # -- states

    def state(self, entries: tuple) -> int:
        if entries not in self.states:
            self.states[entries] = len(self.entries)
            self.entries.append(entries)
            if len(self.entries) > len(self.to):
                self.to = np.concatenate([self.to, np.full_like(self.to, -1)])
                self.change = np.concatenate([self.change, np.zeros_like(self.change)])
        return self.states[entries]

    def fill(self) -> float:
        """Share of what the tables may hold; above 1 they are dropped."""
        return max(self.to.size / MOST_CELLS, len(self.entries) / MOST_STATES)

    def columns_for(self, used: np.ndarray) -> None:
        for b in np.flatnonzero(used & (self.column < 0)):
            self.column[b] = self.n_columns
            self.n_columns += 1
        while self.n_columns > self.to.shape[1]:
            self.to = np.concatenate([self.to, np.full_like(self.to, -1)], axis=1)
            self.change = np.concatenate([self.change, np.zeros_like(self.change)], axis=1)

    def restriction(self, node: int, before):
        """``before`` as far as it matters below ``node``: itself, or the few tokens that may follow."""
        below = self.below.get(node)
        if below is None:
            return before
        if isinstance(before, tuple):
            allowed = set(before)
            return tuple(t for t in below if t in allowed)
        return tuple(t for t in below if self.may_follow(before, t))

    def compile(self, state: int, byte: int) -> None:
        """One transition: of the open places exactly one lets a token end here."""
        moved, token, count = [], None, 0
        for node, before, rel in self.entries[state]:
            to = self.child.get((node, byte))
            if to is None:
                continue
            moved.append((to, before, rel))
            t = self.token_at.get(to)
            if t is not None and token is None and (t in before if isinstance(before, tuple) else self.may_follow(before, t)):
                token, count = t, rel + 1
        if token is None:
            raise ValueError("no token ends here: the file is not a complete byte-level vocabulary")
        kept = []
        for node, before, rel in moved:
            if node in self.inner:
                limit = self.restriction(node, before)
                if limit != ():
                    kept.append((node, limit, rel - count))
        kept.append((0, token, 0))
        to = self.state(tuple(kept))
        c = self.column[byte]
        self.to[state, c], self.change[state, c] = to, count

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of every word data[start : start + length]."""
        if self.fill() > 1:
            self.reset()
        used = np.bincount(data, minlength=256) > 0
        self.columns_for(used)
        most = 1.0
        order = np.argsort(-lengths, kind="stable")
        begin, length = starts[order], lengths[order]
        state = np.zeros(len(order), np.int64)
        out = np.zeros(len(order), np.int32)
        ascending = length[::-1]
        for k in range(int(length[0]) if len(length) else 0):
            n = len(length) - int(np.searchsorted(ascending, k, side="right"))
            byte = data[begin[:n] + k]
            column = self.column[byte]
            to = self.to[state[:n], column]
            new = np.flatnonzero(to < 0)
            if len(new):
                for key in np.unique(state[new] * 256 + byte[new]).tolist():
                    self.compile(key >> 8, key & 255)
                to = self.to[state[:n], column]
            out[:n] += self.change[state[:n], column]
            state[:n] = to
            if len(new) and self.fill() > most:
                live, back = np.unique(state[:n], return_inverse=True)
                kept = [self.entries[s] for s in live.tolist()]
                self.reset()
                self.columns_for(used)
                state[:n] = np.array([self.state(x) for x in kept])[back]
                most = max(1.0, 2 * self.fill())  # states of many words at once may need more
        back = np.empty_like(out)
        back[order] = out
        return back


def cut(text: str, size: int = BATCH) -> Iterator[str]:
    """``text`` in pieces of ``size`` characters or more, cut where a word starts in any case."""
    at = 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


SAFE = re.compile(r"\S(?=[ \n\t])")


def count_tokens(texts: list[str], tokens: Tokens) -> np.ndarray:
    """Tokens of each text."""
    out = np.zeros(len(texts), np.int64)
    special = re.compile("|".join(map(re.escape, sorted(tokens.added, key=len, reverse=True)))) if tokens.added else None
    pieces: list[tuple[int, str]] = []
    size = 0

    def flush() -> None:
        nonlocal pieces, size
        if pieces:
            np.add.at(out, [i for i, _ in pieces], _count_pieces([p for _, p in pieces], tokens))
        pieces, size = [], 0

    for i, text in enumerate(texts):
        parts = [text]
        if special and any(a in text for a in tokens.added):
            parts = special.split(text)
            out[i] += len(parts) - 1
        for part in parts:
            for piece in cut(part):
                if piece:
                    pieces.append((i, piece))
                    size += len(piece)
                    if size >= BATCH:
                        flush()
    flush()
    return out


def _count_pieces(pieces: list[str], tokens: Tokens) -> np.ndarray:
    joined = PART.join(pieces) + PART
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # where characters start
    first = np.flatnonzero(word_starts(codes))
    ends = np.append(at[first[1:]], len(data))
    word = codes[first] != ord(PART)
    begin, length = at[first][word], (ends - at[first])[word]
    piece = np.searchsorted(np.flatnonzero(codes == ord(PART)), first[word])
    return np.bincount(piece, tokens.counts(data, begin, length), minlength=len(pieces)).astype(np.int64)


_COMPILED: dict[int, Tokens] = {}


def _compiled(spec: str) -> Tokens:
    key = hash(spec)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Tokens(spec)
    return _COMPILED[key]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row's whole text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = shared(docs.sparkSession, f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                counts = count_tokens(texts, _compiled(spec.value))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    text = col(text_col).cast("string")
    rows = docs.select(col(id_col).alias("doc_id"), text.alias("text"), utf8_bytes(text).alias("n_bytes"))
    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long")
