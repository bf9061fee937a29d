"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word (a run of letters or bytes over 127, A-Z lower-cased) in both
directions and gives every position a distribution over the languages.  Its state begins anew with
each word, so equal words get equal labels and each distinct word of a slice of texts is run once.
Words of over 48 bytes are read in windows of that size.  A document's probabilities are the mean
over all of its positions.

The weights are learned in numpy by backpropagation through time on a bounded sample of words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .quality import held_out
from .store import one_row_each
from .textscan import LETTERS, LOWER, batch_slices, word_bounds, word_hashes

HIDDEN, WINDOW = 12, 48
SAMPLE_ROWS, SAMPLE_WORDS = 3000, 60  # bounds of the documents and of the distinct words of each that training reads
SLICE = 4 << 20
STEPS, BATCH, RATE = 900, 512, 0.02


@dataclass
class Direction:
    """One reading direction: a row of gate inputs for each byte, and the recurrent weights (update, reset, new)."""

    table: np.ndarray  # 256 x 3H
    gates: np.ndarray  # H x 2H
    fresh: np.ndarray  # H x H


@dataclass
class LanguageModel:
    languages: list[str]
    ways: list[Direction]  # forward, backward
    out: np.ndarray  # 2H x languages
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def states(way: Direction, words: np.ndarray, trace: list | None = None) -> np.ndarray:
    """The state after every byte of words(n, length), read from the left: length x n x H."""
    n, length = words.shape
    size = len(way.fresh)
    h = np.zeros((n, size), np.float32)
    out = np.empty((length, n, size), np.float32)
    for t in range(length):
        a = way.table[words[:, t]]
        zr = _sigmoid(a[:, :2 * size] + h @ way.gates)
        z, r = zr[:, :size], zr[:, size:]
        g = np.tanh(a[:, 2 * size:] + (r * h) @ way.fresh)
        if trace is not None:
            trace.append((h, z, r, g))
        h = h + z * (g - h)
        out[t] = h
    return out


def back_through_time(way: Direction, words: np.ndarray, trace: list, grad: np.ndarray) -> Direction:
    """Gradients of one direction, given the gradient of every state."""
    n, length = words.shape
    size = len(way.fresh)
    by_input = np.empty((length, n, 3 * size), np.float32)
    d_gates, d_fresh = np.zeros_like(way.gates), np.zeros_like(way.fresh)
    later = np.zeros((n, size), np.float32)
    for t in range(length - 1, -1, -1):
        h, z, r, g = trace[t]
        d = grad[t] + later
        new = d * z * (1 - g * g)
        reset_h = new @ way.fresh.T
        d_fresh += (r * h).T @ new
        gate = np.concatenate([d * (g - h) * z * (1 - z), reset_h * h * r * (1 - r)], axis=1)
        d_gates += h.T @ gate
        by_input[t] = np.concatenate([gate, new], axis=1)
        later = d * (1 - z) + reset_h * r + gate @ way.gates.T
    flat, values = words.T.ravel(), by_input.reshape(-1, 3 * size)
    order = np.argsort(flat, kind="stable")
    seen, first = np.unique(flat[order], return_index=True)
    table = np.zeros_like(way.table)
    table[seen] = np.add.reduceat(values[order], first, axis=0)
    return Direction(table, d_gates, d_fresh)


def position_labels(model: LanguageModel, words: np.ndarray) -> np.ndarray:
    """P(language) at every position of words(n, length): length x n x languages."""
    left = states(model.ways[0], words)
    right = states(model.ways[1], words[:, ::-1])[::-1]
    raw = np.concatenate([left, right], axis=2) @ model.out + model.bias
    raw = np.exp(raw - raw.max(axis=2, keepdims=True))
    return raw / raw.sum(axis=2, keepdims=True)


def fit(words: list[bytes], labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 1) -> LanguageModel:
    """Adam over batches of words of one length, all languages with the same weight."""
    rng = np.random.default_rng(seed)
    count = max(1, len(languages))
    init = lambda *shape: (rng.standard_normal(shape) * 0.25).astype(np.float32)
    ways = [Direction(init(256, 3 * HIDDEN), init(HIDDEN, 2 * HIDDEN), init(HIDDEN, HIDDEN)) for _ in range(2)]
    model = LanguageModel(languages, ways, init(2 * HIDDEN, count), np.zeros(count, np.float32))
    sizes = np.array([len(w) for w in words], np.int64)
    groups = {}
    for length in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == length)
        groups[length] = (np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(-1, length), labels[at])
    if not groups or count < 2:
        return model
    weight = 1 / np.maximum(np.bincount(labels, minlength=count), 1)
    weight = (weight * len(labels) / count).astype(np.float32)
    lengths = list(groups)
    chance = np.array([len(groups[k][1]) * k for k in lengths], float)
    params = lambda: [p for w in model.ways for p in (w.table, w.gates, w.fresh)] + [model.out, model.bias]
    first, second = [np.zeros_like(p) for p in params()], [np.zeros_like(p) for p in params()]
    for step in range(1, steps + 1):
        bytes_, label = groups[lengths[rng.choice(len(lengths), p=chance / chance.sum())]]
        pick = rng.integers(0, len(label), min(BATCH, len(label)))
        x, y = bytes_[pick], label[pick]
        traces = [[], []]
        left = states(model.ways[0], x, traces[0])
        right = states(model.ways[1], x[:, ::-1], traces[1])[::-1]
        both = np.concatenate([left, right], axis=2)
        raw = both @ model.out + model.bias
        p = np.exp(raw - raw.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(y)), y] -= 1
        p *= (weight[y] / (len(y) * x.shape[1]))[None, :, None]
        d_both = p @ model.out.T
        grads = []
        for way, words_, trace, d in ((model.ways[0], x, traces[0], d_both[:, :, :HIDDEN]),
                                      (model.ways[1], x[:, ::-1], traces[1], d_both[::-1, :, HIDDEN:])):
            g = back_through_time(way, words_, trace, d)
            grads += [g.table, g.gates, g.fresh]
        grads += [np.einsum("tnh,tnc->hc", both, p), p.sum(axis=(0, 1))]
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, (value, grad) in enumerate(zip(params(), grads)):
            grad = np.clip(grad, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            value -= (rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


# ------------------------------------------------------------------ words of texts

def windows(data: np.ndarray, offsets: np.ndarray):
    """(lower-cased bytes, starts, ends) of the words of a slice, long ones cut into windows."""
    data = LOWER[data]
    starts, ends = word_bounds(data, offsets, LETTERS)
    if len(starts) and (ends - starts).max() > WINDOW:
        many = -(-(ends - starts) // WINDOW)
        number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        cut = np.repeat(starts, many) + number * WINDOW
        starts, ends = cut, np.minimum(cut + WINDOW, np.repeat(ends, many))
    return data, starts, ends


def pooled(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean P(language) over all positions, positions) of each text of a slice."""
    n, count = len(offsets) - 1, len(model.languages)
    data, starts, ends = windows(data, offsets)
    if not len(starts) or not count:
        return np.zeros((n, count)), np.zeros(n)
    owner = np.searchsorted(offsets, starts, "right") - 1
    _, at, word = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = (ends - starts)[at]
    sums = np.empty((len(at), count), np.float32)
    for length in np.unique(size).tolist():
        group = np.flatnonzero(size == length)
        for part in np.array_split(group, -(-len(group) // 8192)):
            x = data[starts[at[part]][:, None] + np.arange(length)]
            sums[part] = position_labels(model, x).sum(axis=0)
    positions = np.bincount(owner, weights=ends - starts, minlength=n)
    # distinct words of each text with their counts, then one product per language
    both, times = np.unique(owner * len(at) + word, return_counts=True)
    text, word = both // len(at), both % len(at)
    total = np.stack([np.bincount(text, weights=sums[word, k] * times, minlength=n) for k in range(count)], axis=1)
    return total / np.maximum(positions, 1)[:, None], positions


def _sample_batches(batches):
    for batch in batches:
        lang = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        for i, j, data, offsets in batch_slices(batch, "text"):
            data, starts, ends = windows(data, offsets)
            owner = np.searchsorted(offsets, starts, "right") - 1
            hashes = word_hashes(data, starts, ends)
            langs, words = [], []
            for t in range(j - i):
                own = np.flatnonzero(owner == t)
                _, first = np.unique(hashes[own], return_index=True)
                for k in own[first[:SAMPLE_WORDS]].tolist():  # in the order of their hashes
                    langs.append(lang[i + t])
                    words.append(data[starts[k]:ends[k]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary())], names=["lang", "word"])


def train(docs: DataFrame, most: int = SAMPLE_ROWS) -> LanguageModel:
    """A model from the words of at most `most` documents with a language that are not held out.

    Documents are ranked by a hash within their language, and lower ranks are taken first, so every
    language is learned before any gets a second document.  A repeated doc_id gives one row a language.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    mixed = F.xxhash64("doc_id")
    ranked = known.select("lang", "doc_id").distinct().withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(mixed, "doc_id")))
    chosen = ranked.where(F.col("rank") <= most).orderBy("rank", mixed, "doc_id", "lang").limit(most).select("doc_id", F.col("lang").alias("of"))
    # at most `most` rows, so they may be sent to every task
    pairs = known.select(F.struct("lang", "doc_id").alias("doc_id"), "text")
    rows = one_row_each(pairs, F.broadcast(chosen.select(F.struct(F.col("of").alias("lang"), "doc_id").alias("doc_id")))).select("doc_id.lang", "text").mapInArrow(
        _sample_batches, "lang string, word binary").toArrow()
    lang, words = rows.column("lang").to_pylist(), rows.column("word").to_pylist()
    order = sorted(range(len(words)), key=lambda i: (lang[i], words[i]))  # batches arrive in any order
    languages = sorted(set(lang))
    number = {x: k for k, x in enumerate(languages)}
    return fit([words[i] for i in order], np.array([number[lang[i]] for i in order], np.int64), languages)


def _predict_batches(model: LanguageModel):
    def run(batches):
        for batch in batches:
            ids, held, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out", "text"))
            for i, j, data, offsets in batch_slices(batch, "text", SLICE):
                p, positions = pooled(model, data, offsets)
                lang, score = [], []
                ascii_letter = np.zeros(len(data) + 1, np.int64)
                np.cumsum(LETTERS[data] & (data < 128), out=ascii_letter[1:])
                for t in range(j - i):
                    letters = ascii_letter[offsets[t + 1]] > ascii_letter[offsets[t]] or (
                        positions[t] > 0 and any(c.isalpha() for c in texts[i + t].as_py()))
                    if letters and len(model.languages):
                        k = int(p[t].argmax())
                        lang.append(model.languages[k])
                        score.append(float(min(1.0, p[t, k])))
                    else:
                        lang.append("und")
                        score.append(0.0 if letters else 1.0)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), held.slice(i, j - i), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, ..).

    Only the text is read.  A null text, and one without a letter of any script, is `und` with score 1;
    with a model of no language all other texts are `und` with score 0.  Ties go to the language that
    sorts first.  Repeated rows get equal results; no rows give no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_predict_batches(model), "doc_id long, held_out boolean, lang_pred string, score double")
