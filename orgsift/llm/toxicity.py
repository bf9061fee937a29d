"""Severity of toxic language by cumulative-link ordinal regression on sparse word features.

Features are the distinct words of a whole text (runs of letters, A-Z lower-cased), hashed to 2^18
columns.  One weight vector serves all grades; ordered thresholds t_1 < t_2 < .. cut the score, so
P(grade >= k) = 1 / (1 + exp(t_k - w x)).  Outputs are these probabilities, the most likely grade and
the expected severity, the sum of P(grade >= k).

Labels say only toxic or not.  Grades of toxic texts are made from how many distinct words they have
that are tied to toxic labels in the sample (a smoothed log odds): thirds of that count are grades
1, 2 and 3, and grade 0 is a text that is not toxic.

The fit uses a bounded sample of labelled rows; all other work is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import one_row_each, small_batches
from .textscan import LETTERS, batch_slices, long_lists, slices, text_bytes, words_of

COLUMNS = 1 << 18
SAMPLE_ROWS = 16_000  # bound of the labelled rows that the model is fitted on
REJECT_AT = 0.5  # P(grade >= 1) from which a document counts as toxic
_U = np.uint64


@dataclass
class OrdinalModel:
    weights: np.ndarray  # one per column
    thresholds: np.ndarray  # ascending, one per grade above 0

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..; one row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def features(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, column) of the distinct words of each text; only columns flagged in `kept`."""
    hashes, owner, _, _ = words_of(data, offsets, LETTERS)
    column = (hashes >> _U(46)).astype(np.int64)
    if kept is not None:
        use = kept[column]
        column, owner = column[use], owner[use]
    both = np.unique(owner * COLUMNS + column)
    return both // COLUMNS, both % COLUMNS


def _feature_batches(batches):
    for batch in batches:
        toxic = batch.column(batch.schema.get_field_index("toxic"))
        for i, j, data, offsets in batch_slices(batch, "text"):
            owner, column = features(data, offsets)
            yield pa.RecordBatch.from_arrays([toxic.slice(i, j - i), long_lists(column, np.bincount(owner, minlength=j - i))],
                                             names=["toxic", "columns"])


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS):
    """(toxic flags, columns of all rows in one array, row starts): at most `most` labelled rows, chosen by a hash.

    A doc_id that stands on several rows gives one of them, so the bound holds for rows.
    """
    chosen = (labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    # the sample has at most `most` rows of two numbers, so it may be sent to every task
    rows = (one_row_each(docs, F.broadcast(chosen)).select(F.col("toxic").cast("int").alias("toxic"), "text")
            .mapInArrow(_feature_batches, "toxic int, columns array<long>").toArrow().combine_chunks())
    if not rows.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    lists = rows.column("columns").combine_chunks()
    return (rows.column("toxic").to_numpy(), lists.flatten().to_numpy(),
            np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]))


def graded(toxic: np.ndarray, columns: np.ndarray, starts: np.ndarray, grades: int = 3) -> np.ndarray:
    """Grades 0..grades of the sample rows, from labels and from how many words tied to toxic labels they have."""
    row = np.repeat(np.arange(len(toxic)), np.diff(starts))
    pos = np.bincount(columns, weights=toxic[row], minlength=COLUMNS)
    neg = np.bincount(columns, minlength=COLUMNS) - pos
    n1, n0 = max(1, toxic.sum()), max(1, len(toxic) - toxic.sum())
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
    tied = (odds > 2) & (pos >= 4)
    hits = np.bincount(row, weights=tied[columns], minlength=len(toxic))
    if not toxic.any():
        return np.zeros(len(toxic), np.int64)
    cuts = np.unique(np.quantile(hits[toxic == 1], np.arange(1, grades) / grades))
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, hits, "left"), 0)


def _telling(columns: np.ndarray, toxic: np.ndarray, share: float, least: float = 15.0) -> np.ndarray:
    """Columns whose share of toxic rows is further from `share` than chance allows (chi-square of one degree)."""
    seen = np.bincount(columns, minlength=COLUMNS)
    pos = np.bincount(columns, weights=toxic, minlength=COLUMNS)
    chi = (pos - seen * share) ** 2 / np.maximum(seen * share * (1 - share), 1e-9)
    return np.flatnonzero((chi >= least) & (seen >= 2))


def loss_and_gradient(x: np.ndarray, words: int, row: np.ndarray, col: np.ndarray, grade: np.ndarray, shrink: float = 2e-5) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the cumulative logit model with a penalty on weights, and its gradient.

    x holds the weights of `words` columns, the first threshold, and the logarithms of the steps
    between thresholds; (row, col) are the words of the rows.
    """
    n, top = len(grade), len(x) - words
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    w, cuts = x[:words], x[words] + np.concatenate([[0], np.cumsum(np.exp(x[words + 1:]))])
    score = np.bincount(row, weights=w[col], minlength=n)
    edge = np.concatenate([[-np.inf], cuts, [np.inf]])
    upper, lower = sigmoid(edge[grade + 1] - score), sigmoid(edge[grade] - score)
    inside = np.maximum(upper - lower, 1e-12)
    du, dl = upper * (1 - upper) / inside, lower * (1 - lower) / inside  # of -log P by score: du - dl
    grad = np.empty_like(x)
    grad[:words] = np.bincount(col, weights=(du - dl)[row], minlength=words) / n + shrink * w
    by_cut = np.array([(dl[grade == k].sum() - du[grade == k - 1].sum()) / n for k in range(1, top + 1)])
    tail = np.cumsum(by_cut[::-1])[::-1]
    grad[words] = tail[0]
    grad[words + 1:] = tail[1:] * np.exp(x[words + 1:])
    return float(-np.log(inside).mean() + shrink / 2 * (w * w).sum()), grad


def fit(columns: np.ndarray, starts: np.ndarray, grade: np.ndarray, steps: int = 400, rate: float = 0.1, shrink: float = 2e-5) -> OrdinalModel:
    """Maximum likelihood of the cumulative logit model with shared weights, by Adam steps over all rows.

    Only telling columns get a weight: the others would share out the score among accidents.
    """
    grade = np.searchsorted(np.unique(grade), grade)  # grades that no row has get no threshold
    n, top = len(grade), int(grade.max()) if len(grade) else 0
    if not top:
        return OrdinalModel(np.zeros(COLUMNS, np.float32), np.array([30.0]))
    used = _telling(columns, np.repeat(grade > 0, np.diff(starts)), (grade > 0).mean())
    number = np.full(COLUMNS, -1)
    number[used] = np.arange(len(used))
    row = np.repeat(np.arange(n), np.diff(starts))
    keep = number[columns] >= 0
    row, col = row[keep], number[columns][keep]
    x = np.zeros(len(used) + top)
    share = np.array([(grade >= k).mean() for k in range(1, top + 1)])
    x[len(used)] = -np.log(share[0] / (1 - share[0]))
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        _, grad = loss_and_gradient(x, len(used), row, col, grade, shrink)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        x = x - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros(COLUMNS, np.float32)
    weights[used] = x[:len(used)]
    return OrdinalModel(weights, x[len(used)] + np.concatenate([[0], np.cumsum(np.exp(x[len(used) + 1:]))]))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> OrdinalModel:
    """A model from at most `most` labelled rows; without toxic labels every text gets grade 0."""
    toxic, columns, starts = training_sample(docs, labels, most)
    return fit(columns, starts, graded(toxic, columns, starts))


_OUT = {"severity": "double", "p_toxic": "double", "grade": "long"}


def _scores(model: OrdinalModel):
    """A function of a text column that gives the fields of _OUT; only these come back from Python, not the text."""
    kept = model.weights != 0

    @F.arrow_udf("struct<" + ", ".join(f"{k}: {t}" for k, t in _OUT.items()) + ">")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            data, offsets = text_bytes(column)
            parts = [np.zeros((0, len(model.thresholds)))]
            for i, j in slices(offsets):
                at = offsets[i:j + 1]
                owner, columns = features(data[at[0]:at[-1]], at - at[0], kept)
                parts.append(model.at_least(np.bincount(owner, weights=model.weights[columns], minlength=j - i)))
            p = np.concatenate(parts)
            yield pa.StructArray.from_arrays([pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(axis=1))], names=list(_OUT))
    return score


def severity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The columns of docs with severity (expected grade), p_toxic (P(grade >= 1)) and grade.

    Null and empty texts have no features and get the severity of the thresholds alone.  Columns of
    docs that have the names of the results are replaced.  Repeated rows are scored alike; no rows
    give no rows.
    """
    rows = small_batches(docs).withColumn("_tox", _scores(model)("text"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in _OUT], *[F.col(f"_tox.{k}").alias(k) for k in _OUT])


def without_toxic(docs: DataFrame, model: OrdinalModel, reject_at: float = REJECT_AT) -> DataFrame:
    """docs without the rows whose P(grade >= 1) is `reject_at` or more; columns stay as they are.

    Null and empty texts are judged by the thresholds alone.  Repeated rows are judged alike; no rows give no rows.
    """
    return small_batches(docs).where(_scores(model)("text")["p_toxic"] < reject_at)
