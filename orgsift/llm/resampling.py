"""Documents drawn by importance weights that favour the n-grams of a target collection.

Features are all runs of 1 to `most_n` consecutive words (A-Z lower-cased; a word is a run of a-z,
0-9 and characters over 127).  Separators collapse to single spaces, and one regular expression per
length, searched with overlapping matches between word boundaries, gives the spans of the runs; the
CRC-32 of a span's bytes modulo the number of buckets is its feature.

A bucket's gain is 1000 times the log ratio of its smoothed shares in the target and in the corpus,
rounded down; a document weighs the floored mean of the gains of its features.  Weights get Gumbel
noise from a hash of the doc_id, so the highest scores are a draw without replacement in proportion
to the exponentiated weights.

Texts are scanned once: what a text has in buckets is written (two bytes a feature) and read again
for the scores.  The driver sees two numbers per bucket, one number per distinct score of an
eligible document (an integer within some tens of thousands), and one count per range.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import global_places
from .store import stored
from .textscan import ALNUM, batch_slices

BUCKETS = 10_000
MOST_N = 1
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024

_AS_SPACE = bytes(b if ALNUM[b] else 0x20 for b in range(256))


@lru_cache(16)
def run_pattern(n: int) -> regex.Pattern:
    """Runs of n words in a text with single spaces, from the start of a word to the end of one."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def collapsed(raw: bytes) -> bytes:
    """A-Z in lower case, and every run of separators one space."""
    return b" ".join(raw.lower().translate(_AS_SPACE).split())


def feature_buckets(text: bytes, most_n: int = MOST_N, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every feature of a collapsed text, repeats included."""
    spans = (crc32(m.group()) for n in range(1, most_n + 1) for m in run_pattern(n).finditer(text, overlapped=True))
    return np.fromiter(spans, np.uint32) % np.uint32(buckets)


def _scan_batches(most_n, buckets):
    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for i, j, data, offsets in batch_slices(batch, "text"):
                raw, ends, found, words = data.tobytes(), offsets.tolist(), [], []
                for a, b in zip(ends, ends[1:]):
                    text = collapsed(raw[a:b])
                    found.append(np.sort(feature_buckets(text, most_n, buckets)).astype("<u4" if buckets > 1 << 16 else "<u2"))
                    words.append(text.count(b" ") + (len(text) > 0))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(words, pa.int64()), pa.array([len(f) for f in found], pa.int64()),
                     pa.array([f.tobytes() for f in found], pa.binary())],
                    names=["doc_id", "n_words", "n_features", "buckets"])
    return run


def scanned(docs: DataFrame, most_n: int = MOST_N, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the buckets of the features of docs(doc_id, text, ..), as sorted numbers."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scan_batches(most_n, buckets), "doc_id long, n_words long, n_features long, buckets binary")


def _numbers(column, buckets):
    kind = "<u4" if buckets > 1 << 16 else "<u2"
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def bucket_counts(scans: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all scanned texts fall into each bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in _numbers(batch.column(0), buckets):
                total += np.bincount(x, minlength=buckets) if len(x) > buckets // 8 else 0
                if len(x) <= buckets // 8:
                    np.add.at(total, x, 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])
    rows = scans.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) per bucket, one added to each count, in doubles."""
    n, t_all, s_all = len(corpus), float(target.sum()), float(corpus.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for t, s in zip(target.tolist(), corpus.tolist())], np.int64)


def _weigh_batches(gain):
    def run(batches):
        for batch in batches:
            weights = [int(gain[x].sum()) // len(x) if len(x) else 0 for x in _numbers(batch.column(batch.schema.get_field_index("buckets")), len(gain))]
            rest = [k for k, name in enumerate(batch.schema.names) if name != "buckets"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in rest], pa.array(weights, pa.int64())],
                                             names=[*[batch.schema.names[k] for k in rest], "weight"])
    return run


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), where u comes from the first 32 bits of SHA-256 of "seed:doc_id"."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def weighed(scans: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of scanned(); the gains (one number per bucket) go along with the tasks."""
    rows = scans.mapInArrow(_weigh_batches(gain), "doc_id long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


@dataclass
class Cut:
    """The lowest drawn score, and how many rows are drawn."""

    score: int
    rows: int


def draw_cut(scores: DataFrame, percent: float) -> Cut:
    """The cut for the highest `percent` of scores(score): one count per distinct score comes to the driver.

    Scores are integers between the extremes of a log ratio and of Gumbel noise of 32 bits, both
    some tens of thousands apart, whatever the number of rows is.
    """
    found = sorted(((r.score, r.n) for r in scores.groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    wanted, upto = math.floor(percent * sum(n for _, n in found) / 100), 0
    for score, n in found:
        upto += n
        if upto >= wanted > 0:
            return Cut(score, wanted)
    return Cut(0, 0)


def resample(docs: DataFrame, target: DataFrame, most_n: int = MOST_N, buckets: int = BUCKETS, percent: float = PERCENT,
             least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs(doc_id, text, ..); rank is null where a row is not drawn.

    Of the rows with `least_words` words or more, floor(percent * rows / 100) are drawn: the highest
    scores, of equal ones those with smaller doc_id.  The gains count all rows of docs and of
    target(text, ..).

    Null and empty texts, and texts without words, have no features and weight 0.  A null doc_id is
    hashed as the empty string and comes last among equal scores.  Rows that repeat a doc_id are
    scored one by one with the same noise; rows equal in score and doc_id are ordered by weight and
    number of features, then by where they stand.  No documents give no rows; an empty target has
    no counts, so gains come from the added ones.  Other columns are ignored.
    """
    scans = stored(scanned(docs, most_n, buckets), "zstd")
    aims = scanned(target.select(F.lit(0).alias("doc_id"), "text"), most_n, buckets)
    rows = stored(weighed(scans, gains(bucket_counts(aims, buckets), bucket_counts(scans, buckets)), seed))
    eligible = F.col("n_words") >= least_words
    cut = draw_cut(rows.where(eligible).select("score"), percent)
    high = eligible & (F.col("score") >= cut.score) & F.lit(cut.rows > 0)
    tied = F.monotonically_increasing_id()
    placed = global_places(rows.where(high).withColumn("_at_row", tied),
                           [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), "n_features", "_at_row"], "_place")
    drawn = placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("_place") <= cut.rows, F.col("_place")).alias("rank"))
    rest = rows.where(~high).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)
