"""Documents packed into windows of 4096 tokens by non-negative least squares on length histograms.

A task reads its documents in blocks of a bounded number of tokens.  Whole windows of a document are
sequences by themselves; what is left of it (under 4096 tokens) goes into a histogram with steps of
eight tokens.  Combinations of up to three steps that fill a window are enumerated, and non-negative
least squares says how often each should be used so that the histogram is used up.  The counts are
rounded within what the histogram has, and the rest is packed greedily, largest first; a gap that no
piece fits is closed by cutting a piece.  What is left open at the end of a block is cut at powers of
two, which need no padding.  So padding comes only from rounding up to eight tokens.

Nothing is shuffled, and a block is at most BLOCK_TOKENS ids and one document in memory.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .store import small_batches
from .textscan import LOWER, batch_slices, byte_class, text_bytes, word_bounds

WINDOW, STEP = 4096, 8
BLOCK_TOKENS = 3_000_000
END_ID = 2
CACHED_WORDS, CACHED_CHARS = 300_000, 64  # of each of two tables
LEFT_OPEN = 8  # a gap of so many tokens is not worth a cut


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------------ token ids

#: Letters that are neither composed nor changed by normalisation, in lower case; marks that may stand behind them.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+").fullmatch
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_BLANK = byte_class([(0x20, 0x20), (0x0A, 0x0A)])


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself where it can be seen, else one after 255."""
    seen = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """Token ids of whole texts; each distinct word of a slice is touched once.

    The tokenizer lower-cases, drops white space and never joins what stands on its two sides, so the
    ids of a text are the ids of its words between blanks and line ends, with A-Z in lower case.  A run
    of plain letters and a run of marks behind it (no apostrophe, which can begin a contraction) are
    token runs of their own; such runs go to the merges many at a time, told apart by the tokens that
    end a word.  Special tokens such as <|endoftext|> are looked for before lower-casing, so a word
    with "<|" keeps its case.  Words seen before come from two tables of bounded size: what is not
    asked for while one of them fills up is forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends_word = np.zeros(1 << 16, bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.known, self.older, self.marks = {}, {}, {b"": b""}
        self.letters = _byte_letters()

    def _merged(self, runs: list[bytes]) -> list[bytes]:
        """The ids of each run of letters or of marks."""
        out = []
        for a in range(0, len(runs), 2_000):
            part = runs[a:a + 2_000]
            text = " ".join([r.decode() if r.isascii() else "".join([self.letters[b] for b in r]) for r in part])
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")
            raw, ends = ids.tobytes(), (2 * np.flatnonzero(self.ends_word[ids]) + 2).tolist()
            out += [raw[p:q] for p, q in zip([0] + ends, ends)]
        return out

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of words that no table has."""
        known, older, marks, found, need, cuts, odd = self.known, self.older, self.marks, {}, [], [], []
        for i, word in enumerate(words):
            stem = word.rstrip(_MARKS)
            tail = word[len(stem):]
            if not (stem.isalpha() and stem.islower()):  # not ASCII letters only
                text = stem.decode() if b"<|" in word else stem.decode().lower()
                stem = text.encode() if _PLAIN(text) else None
            if stem is None or len(tail) > 4:
                odd.append(i)
                continue
            if tail not in marks:
                marks[tail] = self._merged([tail])[0]
            if stem not in found:
                ids = known.get(stem) or older.get(stem)
                found[stem] = ids
                if ids is None:
                    need.append(stem)
            cuts.append((i, word, stem, tail))
        found.update(zip(need, self._merged(need)))
        out = [b""] * len(words)
        for i, word, stem, tail in cuts:
            ids = found[stem]
            if len(word) <= CACHED_CHARS:
                if tail:
                    known[stem] = ids
                    ids = ids + marks[tail]
                out[i] = known[word] = ids
            else:
                out[i] = ids + marks[tail]
        for a in range(0, len(odd), 20_000):
            part = odd[a:a + 20_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([words[i].decode() for i in part], add_special_tokens=False)):
                out[i] = array("H", e.ids).tobytes()
                if len(words[i]) <= CACHED_CHARS:
                    known[words[i]] = out[i]
        if len(marks) > 10_000:
            self.marks = {b"": b""}
        return out

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a slice and the end id, as 16-bit numbers."""
        low = LOWER[data]
        starts, ends = word_bounds(data, offsets, ~_BLANK)
        raw = data.tobytes()
        at = raw.find(b"<|")
        while at >= 0:  # a word with a special token keeps its case
            k = int(np.searchsorted(starts, at, "right")) - 1
            low[starts[k]:ends[k]] = data[starts[k]:ends[k]]
            at = raw.find(b"<|", int(ends[k]))
        packed = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(packed), pa.py_buffer(low[~_BLANK[data]])])
        coded = words.dictionary_encode()
        held, at = text_bytes(coded.dictionary)
        held, at = held.tobytes(), at.tolist()
        distinct = [held[a:b] for a, b in zip(at, at[1:])]
        ids = list(map(self.known.get, distinct))
        missing = []
        for i in [i for i, x in enumerate(ids) if x is None]:
            word = distinct[i]
            if (x := self.older.get(word)) is None:
                missing.append(i)
            else:
                ids[i] = self.known[word] = x
        for i, x in zip(missing, self._learn([distinct[i] for i in missing])):
            ids[i] = x
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        ids.append(np.array([END_ID], "<u2").tobytes())
        # every text is its words and the end
        flat = np.frombuffer(b"".join(ids), "<u2")
        size = np.array([len(x) for x in ids], np.int64) // 2
        begin = np.cumsum(size) - size
        first = np.searchsorted(starts, offsets[1:])
        which = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), first, len(ids) - 1)
        many = size[which]
        upto = np.cumsum(many)
        out = flat[np.repeat(begin[which] - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)]
        return np.split(out, upto[first + np.arange(len(first))][:-1]) if len(first) else []

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text and the end id."""
        return self.encode_slice(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(x) for x in texts]))


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker process, with what it has learned."""
    return Encoder(path)


# ------------------------------------------------------------------ which lengths share a window

@lru_cache(4)
def combinations(bins: int) -> np.ndarray:
    """All ways to write `bins` as one to three bins, largest first; absent parts are 0."""
    out = [(bins, 0, 0)] + [(a, bins - a, 0) for a in range(bins - 1, (bins - 1) // 2, -1) if a >= bins - a]
    for a in range(bins - 2, 0, -1):
        rest = bins - a
        b = np.arange(min(a, rest - 1), (rest - 1) // 2, -1)
        b = b[b >= rest - b]
        out += list(zip([a] * len(b), b.tolist(), (rest - b).tolist()))
    return np.array(out, np.int64)


def repeat_counts(histogram: np.ndarray, combos: np.ndarray, steps: int = 80) -> np.ndarray:
    """x >= 0 that makes the sum of x times each combination close to the histogram, by accelerated projected gradients."""
    h = histogram.astype(float)
    bins = len(h)
    uses = np.bincount(combos.ravel(), minlength=bins)
    uses[0] = 0
    rate = 1 / max(1.0, 3.0 * uses.max())
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        made = np.bincount(combos.ravel(), weights=np.repeat(y, 3), minlength=bins)
        off = made - h
        off[0] = 0
        new = np.maximum(0, y - rate * off[combos].sum(axis=1))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_block(lengths: np.ndarray, window: int = WINDOW, step: int = STEP) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (piece number, start in the piece, length) for pieces shorter than a window."""
    bins = window // step
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in range(bins + 1)]
    for i, n in enumerate(lengths.tolist()):
        if n:
            waiting[-(-n // step)].append((i, 0, n))
    left = np.array([len(w) for w in waiting])
    out = []
    combos = combinations(bins)
    combos = combos[(left[combos] > 0).sum(axis=1) >= (combos > 0).sum(axis=1)]
    if len(combos):
        x = repeat_counts(left, combos)
        for k in np.argsort(-x, kind="stable"):
            if x[k] <= 1e-3:
                break
            parts = [int(b) for b in combos[k] if b]
            room = min(len(waiting[b]) // parts.count(b) for b in parts)
            for _ in range(min(room, max(1, round(float(x[k]))))):
                out.append([waiting[b].pop() for b in parts])
    # the rest: largest first, then the largest that fits; a gap that nothing fits is closed by a cut
    left = np.array([len(w) for w in waiting])
    while True:
        some = np.flatnonzero(left)
        if not len(some):
            break
        now, free = [], window
        while free > LEFT_OPEN:
            fits = some[some * step <= free + step - 1]
            fits = fits[left[fits] > 0]
            took = None
            if len(fits):
                piece = waiting[fits[-1]][-1]
                if piece[2] <= free:
                    took = waiting[fits[-1]].pop()
                    left[fits[-1]] -= 1
                elif len(fits) > 1:
                    took = waiting[fits[-2]].pop()
                    left[fits[-2]] -= 1
            if took is None:
                larger = np.flatnonzero(left)
                if not len(larger):
                    break
                b = int(larger[np.searchsorted(larger, free // step)]) if larger[-1] >= free // step else int(larger[-1])
                i, at, n = waiting[b].pop()
                left[b] -= 1
                if n > free:
                    rest = -(-(n - free) // step)
                    waiting[rest].append((i, at + free, n - free))
                    left[rest] += 1
                    n = free
                took = (i, at, n)
            now.append(took)
            free -= took[2]
        out.append(now)
    return _without_open_end(out, window)


def _without_open_end(sequences, window):
    """The emptiest sequence is cut where powers of two end, if it is far from full."""
    if not sequences:
        return sequences
    total = [sum(p[2] for p in s) for s in sequences]
    last = int(np.argmin(total))
    if window - total[last] <= window // 16:
        return sequences
    pieces, out, need = sequences.pop(last), [], total[last]
    while need:
        size = 1 << (need.bit_length() - 1)
        now, free = [], size
        while free:
            i, at, n = pieces.pop(0)
            if n > free:
                pieces.insert(0, (i, at + free, n - free))
                n = free
            now.append((i, at, n))
            free -= n
        out.append(now)
        need -= size
    return sequences + out


def pack_block(docs: list[np.ndarray], window: int = WINDOW):
    """Sequences as lists of (document number, start, length); no two share a token."""
    out, tails = [], np.array([len(d) % window for d in docs], np.int64)
    base = np.array([len(d) for d in docs], np.int64) - tails
    for i, n in enumerate(base.tolist()):
        out += [[(i, at, window)] for at in range(0, n, window)]
    return out + [[(i, int(base[i]) + at, n) for i, at, n in s] for s in plan_block(tails, window)]


# ------------------------------------------------------------------ the operator

_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _piece_rows(ids, docs, first, window):
    sequences = pack_block(docs, window)
    rows = [(d, at, n, first + s, sum(p[2] for p in q[:k])) for s, q in enumerate(sequences) for k, (d, at, n) in enumerate(q)]
    for a in range(0, len(rows), 2_000):
        part = rows[a:a + 2_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[r[0]] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64()),
             pa.array([len(docs[r[0]]) for r in part], pa.int64()), pa.array([r[3] for r in part], pa.int64()), pa.array([r[4] for r in part], pa.int64()),
             pa.array([docs[r[0]][r[1]:r[1] + r[2]].astype("<u4").tobytes() for r in part], pa.binary())],
            names=[f.split()[0] for f in _PIECES.split(", ")])
    return len(sequences)


def _pack_batches(path, window, block_tokens):
    def run(batches):
        encoder, ids, docs, size = encoder_of(path), [], [], 0
        number = TaskContext.get().partitionId() << 36  # room for 2^36 sequences a task
        for batch in batches:
            ids_here = batch.column(0).to_pylist()
            for i, j, data, offsets in batch_slices(batch, "text"):
                ids += ids_here[i:j]
                got = encoder.encode_slice(data, offsets)
                docs += got
                size += sum(map(len, got))
                if size >= block_tokens:
                    number += yield from _piece_rows(ids, docs, number, window)
                    ids, docs, size = [], [], 0
        if docs:
            yield from _piece_rows(ids, docs, number, window)
    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of docs(doc_id, text, ..): doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ids are the piece's token ids as unsigned little-endian 32-bit numbers.  Every document ends with
    the end id, so null and empty texts are one token.  Texts of any length are cut into windows.
    Rows that repeat a doc_id are packed one by one; a null doc_id is carried along.  No rows give
    no rows; other columns are ignored.  `window` is a power of two.
    """
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _pack_batches(tokenizer or default_tokenizer(), window, block_tokens), _PIECES)


def with_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
