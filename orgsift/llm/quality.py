"""Text quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are hashed three-byte shapes (lower case, upper case, digit, blank, line end, bytes
over 127, and each other sign for itself) and a term for words that repeat the word before.  Term
weights are 1 + log(count) times the inverse document frequency in the labelled sample; a truncated
singular value decomposition of the sample gives the latent space.  The sample's vectors and labels
have a fixed size and go to every task; every document is compared with all of them by blocked
matrix products, exactly, and its nearest ones vote with their cosines as weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import one_row_each
from .textscan import NOT_SPACE, batch_slices, words_of

SHAPES = 4096
REPEATS = SHAPES  # the column of repeated words
TERMS = SHAPES + 1
SAMPLE_ROWS = 4000  # bound of the labelled rows; they are the neighbours
DIMENSIONS, NEIGHBOURS, GOOD_AT = 64, 15, 0.7


def _classes() -> np.ndarray:
    out = np.arange(256)
    out[0x61:0x7B], out[0x41:0x5B], out[0x30:0x3A], out[0x80:] = 1, 2, 3, 4
    return out.astype(np.uint32)


_CLASS = _classes()


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of all terms, one row per text of a slice."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    if len(data) > 2:
        kind = _CLASS[data]
        code = (kind[:-2] * np.uint32(65599) + kind[1:-1]) * np.uint32(65599) + kind[2:]
        column = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        inside = owner[:-2] == owner[2:]
        out[:, :SHAPES] = np.bincount(owner[:-2][inside] * SHAPES + column[inside], minlength=n * SHAPES).reshape(n, SHAPES)
    words, owner, _, _ = words_of(data, offsets, NOT_SPACE)
    again = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1])) + 1
    out[:, REPEATS] = np.bincount(owner[again], minlength=n)
    return out


@dataclass
class QualityModel:
    weights: np.ndarray  # inverse document frequency of each term
    basis: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # the labelled neighbours, of length 1
    labels: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit((np.log1p(counts) * self.weights) @ self.basis)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest neighbours, weighted by their cosines.

        A text without terms, or one that no neighbour resembles, gets the share in the sample;
        without any labels the score is one half.
        """
        prior = self.labels.mean() if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(counts), prior)
        cosine = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(float)
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.clip(np.where(total > 1e-6, votes / np.maximum(total, 1e-6), prior), 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _term_batches(batches):
    for batch in batches:
        quality = batch.column(batch.schema.get_field_index("quality"))
        for i, j, data, offsets in batch_slices(batch, "text"):
            counts = term_counts(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [quality.slice(i, j - i), pa.array([np.flatnonzero(r).astype("<u2").tobytes() for r in counts], pa.binary()),
                 pa.array([r[r > 0].astype("<f4").tobytes() for r in counts], pa.binary())], names=["quality", "terms", "counts"])


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> QualityModel:
    """Term weights and the latent space of the labelled counts, by subspace iteration from a fixed start."""
    n = len(labels)
    weights = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32)
    x = unit(np.log1p(counts) * weights)
    basis = np.random.default_rng(1).standard_normal((TERMS, min(dimensions, max(1, n)))).astype(np.float32)
    for _ in range(8):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    model = QualityModel(weights, basis, np.zeros((0, basis.shape[1]), np.float32), labels.astype(float))
    model.vectors = model.latent(counts)
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> QualityModel:
    """A model from at most `most` labelled rows that are not held out, chosen by a hash of the doc_id; a repeated doc_id gives one row."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` rows of two numbers, so they may be sent to every task
    rows = (one_row_each(docs, F.broadcast(chosen)).select(F.col("quality").cast("int").alias("quality"), "text")
            .mapInArrow(_term_batches, "quality int, terms binary, counts binary").toArrow())
    counts = np.zeros((rows.num_rows, TERMS), np.float32)
    for i, (terms, values) in enumerate(zip(rows.column("terms"), rows.column("counts"))):
        counts[i, np.frombuffer(terms.as_py(), "<u2")] = np.frombuffer(values.as_py(), "<f4")
    return fit(counts, rows.column("quality").to_numpy())


def _score_batches(model: QualityModel):
    def run(batches):
        for batch in batches:
            ids, held = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out"))
            for i, j, data, offsets in batch_slices(batch, "text"):
                score = np.concatenate([model.score(term_counts(data[offsets[a]:offsets[min(a + 256, j - i)]], offsets[a:min(a + 256, j - i) + 1] - offsets[a]))
                                        for a in range(0, j - i, 256)])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), held.slice(i, j - i), pa.array(score), pa.array((score >= GOOD_AT).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])
    return run


def quality_scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text, ..).

    Only the text is scored.  Null and empty texts have no terms and get the sample's share of label
    1.  Repeated rows are scored alike; no rows give no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_score_batches(model), "doc_id long, held_out boolean, score double, predicted int")
