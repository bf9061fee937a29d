"""Exact duplicates: binary-fuse filters over immutable snapshots screen the digests of a batch.

A snapshot is a table of documents that no longer changes.  Its distinct digests are dealt into
shards of a bounded number of keys, and every shard becomes one static 3-way binary-fuse filter of
16-bit fingerprints, about 2.4 bytes a key.  A batch sends each distinct digest to the shard it would
be in.  Digests that the filter has not seen are certainly new: they are grouped inside the batch
only.  Positives join the exact buckets of the snapshot, where the whole SHA-256 of the normalised
bytes and their length must agree, so a false positive of the filter never makes a duplicate.

Filters are never broadcast or collected: a shard and the batch digests for it meet in one task.
Before any shuffle, each task reduces its rows to one per digest, so a text with millions of
copies is one row per task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import stored
from .textscan import mix, text_bytes

SHARD_KEYS = 200_000
_U = np.uint64


# ------------------------------------------------------------------ the filter

def _layout(n: int) -> tuple[int, int]:
    """Cells of a segment (a power of two) and the number of segments a key can start in."""
    length = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    room = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    starts = max(1, int(np.ceil(n * room / length)) - 2)
    return length, starts


def _cells(keys: np.ndarray, seed: int, length: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Three cells in three neighbouring segments and the 16-bit fingerprint of each key."""
    h = mix(keys + _U(seed) * _U(0x9E3779B97F4A7C15))
    start = ((h >> _U(32)) * _U(starts) >> _U(32)).astype(np.int64)
    g = mix(h ^ _U(0x2545F4914F6CDD1D))
    inside = np.stack([g, g >> _U(21), g >> _U(42)], axis=1).astype(np.int64) & (length - 1)
    return (start[:, None] + np.arange(3)) * length + inside, (mix(g) & _U(0xFFFF)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, starts, cells) of a filter that answers yes for every key.

    Keys whose cell no other key uses are taken out wave by wave; the cells are then filled in the
    opposite order.  Another seed is tried if a wave is empty before the keys are.
    """
    keys = np.unique(keys)
    length, starts = _layout(len(keys))
    for seed in range(1, 200):
        if seed % 20 == 0:
            starts += max(1, starts // 4)
        at, print_ = _cells(keys, seed, length, starts)
        size = (starts + 2) * length
        degree = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # xor of the numbers of the keys left in a cell
        for k in range(3):
            np.bitwise_xor.at(owner, at[:, k], np.arange(len(keys)))
        waves, left, alone = [], len(keys), np.flatnonzero(degree == 1)
        while len(alone):
            key, pick = np.unique(owner[alone], return_index=True)
            waves.append((key, alone[pick]))
            left -= len(key)
            touched = at[key].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(owner, touched, np.repeat(key, 3))
            touched = np.unique(touched)
            alone = touched[degree[touched] == 1]
        if not left:
            cells = np.zeros(size, np.uint16)
            for key, cell in reversed(waves):
                cells[cell] = 0
                cells[cell] = print_[key] ^ cells[at[key, 0]] ^ cells[at[key, 1]] ^ cells[at[key, 2]]
            return seed, length, starts, cells
    raise RuntimeError("no seed gave a filter")


def in_filter(keys: np.ndarray, seed: int, length: int, starts: int, cells: np.ndarray) -> np.ndarray:
    at, print_ = _cells(keys, seed, length, starts)
    return (cells[at[:, 0]] ^ cells[at[:, 1]] ^ cells[at[:, 2]]) == print_


# ------------------------------------------------------------------ digests

def _digest_batches(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
        raw = memoryview(data)
        found = [hashlib.sha256(bytes(raw[a:b]).lower()).digest() for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), pa.array(np.diff(offsets)),
             pa.array([int.from_bytes(x[:8], "little", signed=True) for x in found], pa.int64()), pa.array(found, pa.binary())],
            names=["doc_id", "n_bytes", "key", "sha"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, bytes, 64-bit key and SHA-256 of every whole text with A-Z lower-cased."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _digest_batches, "doc_id long, n_bytes long, key long, sha binary")


# ------------------------------------------------------------------ snapshot and batch

_FILTER = "shard long, seed long, length long, starts long, cells binary"


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    seed, length, starts, cells = build_filter(rows.key.to_numpy().view(_U))
    return pd.DataFrame({"shard": [rows.shard.iloc[0]], "seed": [seed], "length": [length], "starts": [starts], "cells": [cells.tobytes()]})


def _screen(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    seen = np.zeros(len(rows), bool)
    for f in filters.itertuples():
        seen |= in_filter(rows.key.to_numpy().view(_U), f.seed, f.length, f.starts, np.frombuffer(f.cells, np.uint16))
    return pd.DataFrame({"key": rows.key, "positive": seen})


def _shard(n: int):
    return F.pmod(F.shiftrightunsigned("key", 13), F.lit(n))


def snapshot_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """One filter row per shard of the distinct keys of snapshot(key, ..)."""
    return snapshot.select("key").distinct().withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_build, _FILTER)


def screen(batch: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """(key, positive) for each distinct key of the batch."""
    keys = batch.select("key").distinct().withColumn("shard", _shard(shards))
    return keys.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_screen, "key long, positive boolean")


_SAME = ["key", "sha", "n_bytes"]


def exact_duplicates(snapshot: DataFrame, batch: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Group the digests of a batch with those of an immutable snapshot.

    Both are tables of digests().  Returns each row of both with keep_id (the largest doc_id of its
    group), group_size and kept.  Null and empty texts are one and the same empty text.  Rows that
    repeat a doc_id all count; each of them carries the group's keep_id, and all rows with that
    doc_id are kept.  A null doc_id counts in group_size, and is kept only if its group has no
    other doc_id.  Empty tables are allowed on either side.
    """
    groups = lambda df: df.groupBy(*_SAME).agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    buckets, fresh = groups(snapshot), groups(batch)
    shards = max(1, -(-snapshot.select(F.approx_count_distinct("key")).first()[0] * 5 // 4 // shard_keys))
    filters = stored(snapshot_filters(buckets, shards))
    seen = screen(fresh, filters, shards)
    told = stored(fresh.join(seen, "key"))
    positive, negative = told.where("positive").drop("positive"), told.where("not positive").drop("positive")
    old = positive.select(*_SAME, F.col("top").alias("new_top"), F.col("n").alias("new_n"))
    # exact buckets: positives and the snapshot's rows agree in all 256 bits and in length
    merged = buckets.join(old, _SAME, "full").select(
        *_SAME, F.greatest("top", "new_top").alias("keep_id"), (F.coalesce("n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("group_size"))
    alone = negative.select(*_SAME, F.col("top").alias("keep_id"), F.col("n").alias("group_size"))
    rows = snapshot.unionByName(batch)
    # a group of one row needs no join key but its own; larger groups go back to their rows
    final = merged.unionByName(alone)
    return rows.join(final, _SAME).select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """exact_duplicates over one table: half of its rows are the snapshot, the others the batch.

    Every row is in one of the halves (by a hash of its doc_id), so the result is about all rows.
    """
    rows = stored(digests(docs).withColumn("in_batch", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1))
    return exact_duplicates(rows.where("not in_batch").drop("in_batch"), rows.where("in_batch").drop("in_batch"), shard_keys)
