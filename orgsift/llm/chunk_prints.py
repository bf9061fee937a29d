"""Document fingerprints from content-defined chunks.

A gear hash runs over the bytes of a text; a chunk ends where the low bits of the hash are zero.  The
cut is normalised: up to the usual size more bits have to be zero, beyond it fewer, and every chunk
is between MIN_CHUNK and MAX_CHUNK bytes (the last one may be shorter).  The hash depends on the last
32 bytes only, so an edit moves the cuts near it and no others.

The fingerprint is the sorted set of chunk digests (40 bits) with chunk lengths (16 bits), in hex.
Containment is the share of a text's distinct chunks, by length, that another text has as well.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textscan import SLICE_BYTES, mix, word_hashes

MIN_CHUNK, USUAL_CHUNK, MAX_CHUNK = 32, 64, 256
STRICT, LOOSE = np.uint32((1 << 7) - 1), np.uint32((1 << 5) - 1)
PART_BYTES, MOST_PARTS = 16 << 20, 100_000
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_CHUNK = np.dtype([("digest", "V5"), ("length", ">u2")])


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after every byte: the sum of the last 32 table values, each shifted by its distance."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(12)


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of the chunks of all texts of a slice.

    A chunk has at least 32 bytes before a cut, so the hash at a cut never sees another text.
    """
    h = gear(data)
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = loose[(h[loose] & STRICT) == 0]
    far = np.int64(1) << 62

    def ends_after(starts):
        """End of the chunk that begins at each start, as if the text went on."""
        s = np.append(strict, far)[np.searchsorted(strict, starts + (MIN_CHUNK - 1))]
        w = np.append(loose, far)[np.searchsorted(loose, starts + USUAL_CHUNK - 1)]
        return np.where(s < starts + USUAL_CHUNK - 1, s + 1, np.minimum(w + 1, starts + MAX_CHUNK))

    after = ends_after(loose + 1)
    index = dict(zip((loose + 1).tolist(), after.tolist()))
    owner, begin, end = [], [], []
    first = ends_after(offsets[:-1]).tolist()
    for t, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        nxt = first[t]
        while a < b:
            stop = nxt if nxt < b else b
            owner.append(t)
            begin.append(a)
            end.append(stop)
            a = stop
            nxt = index.get(a)
            if nxt is None and a < b:  # the last cut was forced by the largest size
                nxt = int(ends_after(np.array([a]))[0])
    return np.array(owner, np.int64), np.array(begin, np.int64), np.array(end, np.int64)


def chunk_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct (digest, length) records of each text."""
    out, i = [], 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= SLICE_BYTES:
            size += len(texts[j])
            j += 1
        data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts[i:j]])])
        owner, begin, end = chunk_bounds(data, offsets)
        # digest and length in one number: 40 bits and 16 bits
        code = (word_hashes(data, begin, end) >> np.uint64(24) << np.uint64(16)) | (end - begin).astype(np.uint64) if len(begin) else np.zeros(0, np.uint64)
        first = np.searchsorted(owner, np.arange(j - i + 1))
        out += [np.unique(code[first[k]:first[k + 1]]) for k in range(j - i)]
        i = j
    return out


def as_print(chunks: np.ndarray) -> str:
    """14 hex digits per chunk: 10 of the digest, 4 of the length."""
    return chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes().hex()


def from_print(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8).reshape(-1, 7)
    return np.hstack([np.zeros((len(raw), 1), np.uint8), raw]).view(">u8").ravel().astype(np.uint64)


def containment(own: np.ndarray, other: np.ndarray) -> float:
    """The share of own chunks, by length, that the other has too; two empty texts are alike."""
    if not len(own) or not len(other):
        return float(len(own) == len(other))
    lengths = own & np.uint64(0xFFFF)
    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
    return float(lengths[other[at] == own].sum() / lengths.sum())


def edited(text: str, following: str) -> str:
    """text with its second half replaced by as many characters of the following text, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


# ------------------------------------------------------------------ every document with the next one

def _dealt(heads):
    """Adds the number of the part to each row; the first row of a part also ends the part before it."""
    falling = [(-k, -h) for k, h in heads]

    def run(batches):
        for batch in batches:
            keys = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            part = [bisect_left(falling, (-k, -h)) for k, h in keys]
            # a head finds itself; any other row lies in the part of the head before it
            head = [p < len(falling) and falling[p] == (-k, -h) for p, (k, h) in zip(part, keys)]
            part = [p if f else p - 1 for p, f in zip(part, head)]
            again = [i for i, f in enumerate(head) if f]
            before = [(part[i] - 1) % len(falling) for i in again]
            rows = pa.concat_arrays([pa.array(range(len(keys)), pa.int64()), pa.array(again, pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [c.take(rows) for c in batch.columns]
                + [pa.array(part + before, pa.int64()), pa.array([0] * len(keys) + [1] * len(again), pa.int32())],
                names=batch.schema.names + ["part", "tail"])
    return run


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _print_batches(batches):
    before = None  # the row that waits for the next one of its part: part, doc_id, text, chunks
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            rows = batch.slice(at, 128).to_pylist()
            own = chunk_sets([(r["text"] or "").encode() for r in rows])
            pairs = []
            for r, chunks in zip(rows, own):
                text = r["text"] or ""
                if before is not None and before[0] == r["part"]:
                    pairs.append((before[1], before[2], before[3], text, chunks))
                before = None if r["tail"] else (r["part"], r["doc_id"], text, chunks)
            changed = [edited(p[1], p[3]).encode() for p in pairs]
            prints = chunk_sets(changed)
            yield pa.RecordBatch.from_arrays([
                pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(p[1]) for p in pairs], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
                pa.array([as_print(p[2]) for p in pairs], pa.string()), pa.array([as_print(c) for c in prints], pa.string()),
                pa.array([containment(p[2], c) for p, c in zip(pairs, prints)], pa.float64()),
                pa.array([containment(p[2], p[4]) for p in pairs], pa.float64())],
                names=[f.split()[0] for f in _OUT.split(", ")])


def fingerprints_with_next(docs: DataFrame, part_bytes: int = PART_BYTES, most_parts: int = MOST_PARTS) -> DataFrame:
    """Fingerprints of every row of docs(doc_id, text, ..), of its edited text, and how alike they and the next row's are.

    The next row is the one that follows by descending doc_id, and by a hash of the text among rows
    with one doc_id; a null doc_id comes last; the first row follows the last.  One row is its own
    next.  Null is the empty text, whose fingerprint is empty.  No rows give no rows.  Other
    columns are ignored.

    Rows are cut into parts along that order, by the first keys of a range partitioning of the keys
    alone (at most `most_parts` numbers come to the driver), and texts are shuffled once, by part.
    The first row of a part is sent to the part before it as well, so no part waits for another.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"),
                        F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(most_parts, max(1, -(-size // part_bytes))))
    heads = (keyed.select("k", "h").repartitionByRange(parts, F.desc("k"), F.desc("h")).groupBy(F.spark_partition_id().alias("p"))
             .agg(F.max(F.struct("k", "h")).alias("head")).select("head.k", "head.h").collect())
    heads = sorted(((r.k, r.h) for r in heads), reverse=True)
    if not heads:
        return docs.sparkSession.createDataFrame([], _OUT)
    schema = "doc_id long, text string, k long, h long, part long, tail int"
    dealt = keyed.mapInArrow(_dealt(heads), schema).repartition(parts, "part").sortWithinPartitions("part", "tail", F.desc("k"), F.desc("h"))
    return dealt.select("doc_id", "text", "part", "tail").mapInArrow(_print_batches, _OUT)
