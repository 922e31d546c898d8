"""Quality by nearest-neighbour voting among latent-semantic vectors.

A text's terms are its words and its words' shapes, hashed into fixed
buckets, with terms for repeated neighbours and repeated lines.  Square-root
term shares times inverse document frequency go through a truncated SVD
fitted on labelled documents.  The labelled vectors are broadcast; for every
document all their cosines are computed, in blocks of matrix products, and
its ``NEIGHBOURS`` nearest vote, each with the power ``SHARPNESS`` of its
similarity; the score is the share of the votes for label 1.

Labelled rows are bounded: the ``MOST_LABELLED`` with the least hash of their
id, so the broadcast (vectors, projection, frequencies) is a few MB whatever
the tables' sizes, and any labelled row is as likely to be among them.

Plan: ids and labels meet in one join without texts, bounded by a top-k; the
texts of those rows are fetched by a broadcast join and turned into term
counts on the workers; one task fits, and only its model (vectors, projection,
frequencies) passes through the driver to the broadcast.  Scoring is a scan
and one Arrow map, no shuffle.

Defined results: a null or empty text, or one whose terms were never seen,
has no direction and gets the labelled rows' share of label 1; so does every
text where no row is labelled (0.5 then); neighbours whose similarity is equal
to 1 in ``GRID`` count in the labelled rows' order (id as text, then label);
rows repeated in ``labels`` count each; of documents that share an id the one
whose text has the least hash is learned from, and each is scored; null ids
and null labels are not learned from; other columns are not read, so they may
have any name; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import shared, written
from .text import Words, col, fold_of, mapped_rows, span_hashes, text_runs, tidy

WORD_TERMS, SHAPE_TERMS = 3072, 1020
TERMS = WORD_TERMS + SHAPE_TERMS + 3
REPEAT, DUPLICATE_LINE, ANY = range(TERMS - 3, TERMS)
DIMENSIONS = 96
NEIGHBOURS = 25
SHARPNESS = 8
MOST_LABELLED = 8192
BLOCK_DOCS, BLOCK_LABELLED = 256, 4096
#: Similarities are compared in steps of 1 / GRID: equal vectors must tie wherever they stand in a matrix.
GRID = 1 << 20
THRESHOLD = 0.3
#: What a byte is in a word's shape: a for a-z and non-ASCII, A for A-Z, 9 for digits, else itself.
_SIGNS = np.arange(256, dtype=np.uint8)
_SIGNS[np.r_[97:123, 128:256]], _SIGNS[65:91], _SIGNS[48:58] = 97, 65, 57
_RUNS = np.isin(np.arange(256), [97, 65, 57])
MOST_SHAPE = 12


def shape_hashes(words: Words) -> np.ndarray:
    """Hashes of the words' shapes: runs of one of the signs a, A, 9 as one; ``MOST_SHAPE`` signs at most."""
    signs = _SIGNS[np.frombuffer(words.data, np.uint8)]
    kept = np.append(True, ~_RUNS[signs[1:]] | (signs[1:] != signs[:-1]))  # a word's first byte follows a blank
    at = np.append(0, np.cumsum(kept))
    begin = at[words.begin]
    return span_hashes(signs[kept].tobytes(), begin, np.minimum(at[words.end], begin + MOST_SHAPE))


def terms_of(texts: list[bytes]) -> list[np.ndarray]:
    """Buckets of all terms of each text, with repeats; none of a text without words."""
    words = Words.of(texts)
    bucket = words.hashes() % np.uint64(WORD_TERMS), np.uint64(WORD_TERMS) + shape_hashes(words) % np.uint64(SHAPE_TERMS)
    same = np.append(False, (bucket[0][1:] == bucket[0][:-1]) & (bucket[1][1:] == bucket[1][:-1]))
    out = []
    for text, a, b in zip(texts, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if a == b:
            out.append(np.empty(0, np.int64))
            continue
        lines = [x for x in text.split(b"\n") if x.strip()]
        copies = len(lines) - len(set(lines))
        structure = [np.full(n, t) for t, n in ((REPEAT, int(np.count_nonzero(same[a + 1 : b]))), (DUPLICATE_LINE, copies * (b - a) // len(lines)), (ANY, 1))]
        out.append(np.concatenate([*(x[a:b].astype(np.int64) for x in bucket), *structure]))
    return out


def term_matrix(rows: list[np.ndarray]) -> np.ndarray:
    """(texts, TERMS) square roots of each term's share."""
    n = np.array([len(r) for r in rows])
    cells = np.repeat(np.arange(len(rows)) * TERMS, n) + (np.concatenate(rows) if len(rows) else 0)
    counts = np.bincount(cells.astype(np.int64), minlength=len(rows) * TERMS).reshape(len(rows), TERMS).astype(np.float32)
    return np.sqrt(counts / np.maximum(n, 1)[:, None].astype(np.float32))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in place; rows of zeros stay."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, norm, out=x, where=norm > 1e-12)


@dataclass
class SparseTerms:
    """Term counts of rows: a row's terms are terms[bounds[k] : bounds[k + 1]], each once, with their times."""

    bounds: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    def blocks(self, weights: np.ndarray, rows: int = 512) -> Iterator[np.ndarray]:
        """Dense unit rows of weighted square roots of shares, ``rows`` at a time."""
        for a in range(0, len(self.bounds) - 1, rows):
            bounds = self.bounds[a : a + rows + 1]
            x = np.zeros((len(bounds) - 1, TERMS), np.float32)
            x[np.repeat(np.arange(len(x)), np.diff(bounds)), self.terms[bounds[0] : bounds[-1]]] = self.times[bounds[0] : bounds[-1]]
            x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
            yield unit(np.sqrt(x, out=x) * weights)


@dataclass
class Voters:
    """The labelled vectors, and what turns a text into a vector."""

    weights: np.ndarray  # inverse document frequency of each term
    projection: np.ndarray  # (TERMS, dimensions)
    vectors: np.ndarray  # (labelled, dimensions), unit
    labels: np.ndarray
    prior: float

    @classmethod
    def fit(cls, x: SparseTerms, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Voters:
        """From the labelled rows' term shares.  Rows become dense in blocks, so the fit holds their terms and little else."""
        n = len(labels)
        if not n:
            return cls(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
        weights = (np.log((1 + n) / (1 + np.bincount(x.terms, minlength=TERMS))) + 1).astype(np.float32)
        weights[[REPEAT, DUPLICATE_LINE]] = 4
        rng = np.random.default_rng(11)
        k = min(dimensions + 16, n, TERMS)
        q = rng.standard_normal((TERMS, k), np.float32)
        for _ in range(3):  # subspace iteration for the leading right singular vectors
            q, _ = np.linalg.qr(sum(own.T @ (own @ q) for own in x.blocks(weights)))
        _, _, v = np.linalg.svd(np.concatenate([own @ q for own in x.blocks(weights)]), full_matrices=False)
        projection = np.ascontiguousarray((q @ v.T)[:, : min(dimensions, k)], np.float32)
        vectors = unit(np.concatenate([own @ projection for own in x.blocks(weights)]))
        return cls(weights, projection, vectors, np.asarray(labels, np.float32), float(np.mean(labels)))

    def vectors_of(self, rows: list[np.ndarray]) -> np.ndarray:
        return unit((term_matrix(rows) * self.weights) @ self.projection)

    def scores(self, rows: list[np.ndarray], neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of votes for label 1 of each text."""
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        z = self.vectors_of(rows)
        best = np.empty((len(z), 0), np.int64)  # similarity in steps, then what is left of 2 ** 32 - 1 by the place: the larger the nearer
        for a in range(0, len(self.labels), BLOCK_LABELLED):
            steps = np.rint((z @ self.vectors[a : a + BLOCK_LABELLED].T) * GRID).astype(np.int64)
            key = steps << 32 | (LAST - np.arange(a, a + steps.shape[1]))
            best = np.concatenate([best, _largest(key, neighbours)], axis=1)
        best = _largest(best, neighbours)
        vote = ((best >> 32) / GRID).clip(0, 1) ** SHARPNESS
        voted = self.labels[LAST - (best & LAST)]
        return (((vote * voted).sum(axis=1) + 1e-9 * self.prior) / (vote.sum(axis=1) + 1e-9)).clip(0, 1)


LAST = (1 << 32) - 1


def _largest(keys: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest of each row, which are all different."""
    return np.partition(keys, keys.shape[1] - k, axis=1)[:, -k:] if keys.shape[1] > k else keys


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, held_out_fold: int | None, most: int, id_col: str, text_col: str) -> DataFrame:
    """doc, text, label of at most ``most`` labelled rows outside the fold."""
    own = labels.select(F.col("doc_id").alias("id"), col(label).cast("double").alias("label")).dropna()
    if held_out_fold is not None:
        own = own.where(fold_of(F.col("id")) != held_out_fold)
    ids = docs.select(col(id_col).alias("doc"))
    chosen = written(own.join(ids, F.col("id") == F.col("doc"), "left_semi").orderBy(F.xxhash64("id", F.lit("voter")), "id", "label").limit(most), "voters")
    texts = docs.select(col(id_col).alias("doc"), col(text_col).cast("string").alias("text"))
    # ``most`` rows are broadcast; rows of one id become one before they leave their task
    texts = texts.join(F.broadcast(chosen.select("id")), F.col("doc") == F.col("id"), "left_semi")
    texts = texts.groupBy("doc").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return chosen.join(texts, F.col("doc") == F.col("id")).select("doc", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out_fold: int | None = 0, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Voters:
    """Voters from the labelled rows: term counts on the workers, the fit (of ``most`` rows) in one task."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.unique(r, return_counts=True) for run in text_runs(t.as_py() for t in batch.column("text")) for r in terms_of(run)]
            # counts beyond 2 ** 20 of one term say no more
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").cast(pa.string()), batch.column("label"), pa.array([a.astype(np.int32) for a, _ in rows], pa.list_(pa.int32())), pa.array([np.minimum(n, 1 << 20).astype(np.int32) for _, n in rows], pa.list_(pa.int32()))],
                ["doc", "label", "terms", "times"],
            )

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            got = pa.Table.from_batches(held).sort_by([("doc", "ascending"), ("label", "ascending")])
            terms, times = (got.column(c).combine_chunks() for c in ("terms", "times"))
            voters = Voters.fit(SparseTerms(terms.offsets.to_numpy(), terms.flatten().to_numpy(), times.flatten().to_numpy()), got.column("label").to_numpy())
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(voters)]})

    rows = labelled_rows(docs, labels, label, held_out_fold, most, id_col, text_col)
    counted = rows.mapInArrow(tidy(count), "doc string, label double, terms array<int>, times array<int>")
    models = counted.repartition(1).mapInArrow(tidy(learn), "model binary").collect()
    return pickle.loads(models[0].model) if models else Voters.fit(SparseTerms(*np.zeros((3, 1), np.int64)), np.empty(0))


def score(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    model = shared(docs.sparkSession, voters)
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in _scored(batches, model.value, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def accepted(docs: DataFrame, voters: Voters, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, that score ``threshold`` or more; the decision is made where the row is."""
    model = shared(docs.sparkSession, voters)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in _scored(batches, model.value, at):
            yield part.filter(pa.array(scores >= threshold))

    return mapped_rows(docs, run)


def _scored(batches: Iterable[pa.RecordBatch], voters: Voters, text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_DOCS):
            part = batch.slice(a, BLOCK_DOCS)
            texts = (t.as_py() for t in part.column(text_at))
            yield part, voters.scores([r for run in text_runs(texts) for r in terms_of(run)])


def quality_scores(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    out = score(docs, fit(docs, labels, "quality", held_out_fold, id_col=id_col, text_col=text_col), id_col, text_col)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == held_out_fold).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
