"""Near-duplicate documents by HyperMinHash sketches, banding and exact verification.

Every text becomes its set of five-word shingles (64-bit hashes).  A sketch has 128 registers; a
register keeps the smallest hash of its bucket as the number of leading zeros (6 bits) and the ten
bits after the first one.  Four registers make a band.  Texts that share a band are candidates;
the collision-corrected Jaccard estimate of the two sketches drops those that cannot reach the
threshold; the rest is decided on the full sets.

At a similarity of 0.75 a pair misses all 32 bands with probability (1 - 0.75^4)^32 = 5e-6, and the
estimate is allowed six standard deviations, so links are lost with about that probability only.

No large group is ever expanded into all pairs.  Equal sets are folded into one first.  Then every
band group is compared with one of its members, the one that shares most bands with others; the
components found so far leave only pairs of *different* components open.  In large groups these are
compared in blocks inside tasks, which give one verified link for each two components that meet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .store import small_batches, stored
from .textscan import NOT_SPACE, as_long, batch_slices, first_index, mix, words_of

REGISTERS, ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS
EMPTY = np.uint16(0xFFFF)
SHINGLE, SIMILARITY = 5, 0.75
SMALL = 64  # a band group of up to so many members is joined with itself
STRIP = 256  # members of a block whose pairs are looked at together
BLOCK, BLOCK_SHINGLES = 4096, 1_000_000  # members and shingles of a larger one that a task compares with as many others
_U = np.uint64
_MULT = mix(np.arange(1, 64, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


# ------------------------------------------------------------------ sets and sketches

def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than `width` make one shingle."""
    hashes, owner, _, _ = words_of(data, offsets, NOT_SPACE)
    n = len(offsets) - 1
    first = first_index(owner, n)
    rolled = np.zeros(max(0, len(hashes) - width + 1), _U)
    for k in range(width):
        rolled += hashes[k:k + len(rolled)] * _MULT[k]
    rolled = mix(rolled)
    out = []
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            out.append(np.unique(rolled[a:b - width + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * _MULT[:b - a]).sum(keepdims=True) + _MULT[width + b - a]))
        else:
            out.append(np.zeros(0, _U))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers, one row of 16-bit numbers per set."""
    least = np.zeros((len(sets), REGISTERS), np.float64)
    full = np.zeros((len(sets), REGISTERS), bool)
    for i, s in enumerate(sets):
        down = s[::-1]  # sorted: the last write to a bucket is its smallest hash
        at = (down & _U(REGISTERS - 1)).astype(np.int64)
        least[i, at] = down >> _U(7)
        full[i, at] = True
    part, power = np.frexp(least + 0.5)
    zeros = (58 - power).astype(np.uint16)
    tail = ((part * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    return np.where(full, (zeros << np.uint16(MANTISSA)) | tail, EMPTY)


def band_keys(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band and text, and whether the band has a register in use."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS).astype(_U)
    word = parts[:, :, 0]
    for k in range(1, ROWS):
        word = (word << _U(16)) | parts[:, :, k]
    return mix(word ^ mix(np.arange(1, BANDS + 1, dtype=_U))), (parts != EMPTY).any(axis=2)


def _given_back() -> None:
    """Memory that Arrow has freed goes back to the system: a Python worker stays beside the executor when its task has ended."""
    pa.default_memory_pool().release_unused()


def _sketch_batches(batches):
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for i, j, data, offsets in batch_slices(batch, "text"):
            sets = shingle_sets(data, offsets)
            sketch = registers(sets)
            keys, used = band_keys(sketch)
            sizes = np.array([len(s) for s in sets], np.int64)
            one = np.array([s.sum(dtype=_U) if len(s) else 0 for s in sets], _U)
            two = np.array([mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) if len(s) else 0 for s in sets], _U)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), pa.array(sizes), pa.array(as_long(one)), pa.array(as_long(two)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS),
                                          pa.array(as_long(keys.ravel()), mask=~used.ravel())),
                 pa.array([r.tobytes() for r in sketch], pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"])
    _given_back()


_SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, set size, a 128-bit digest of the set, band keys and registers of every text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch_batches, _SKETCH)


# ------------------------------------------------------------------ estimate and verification

def may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether pairs of sketches can reach the similarity, by the corrected estimate and the set sizes.

    Registers used by either text are trials.  Different smallest hashes agree in the stored bits
    with a chance of about 2^-10 / 3; that share is taken off the matches.
    """
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    same = ((a == b) & (a != EMPTY)).sum(axis=-1)
    chance = 1 / (3 << MANTISSA)
    estimate = (same - used * chance) / (1 - chance)
    least = used * similarity - 6 * np.sqrt(used * similarity * (1 - similarity))
    return (estimate >= least) & (np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), REGISTERS)


def _estimated(similarity):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            ok = may_link(_matrix(col["sa"].to_pylist()), _matrix(col["sb"].to_pylist()),
                          col["na"].to_numpy(), col["nb"].to_numpy(), similarity)
            yield pa.RecordBatch.from_arrays([col["a"], col["b"]], names=["a", "b"]).filter(pa.array(ok))
        _given_back()
    return run


def packed(shingles: np.ndarray) -> bytes:
    """48 bits of each 64-bit shingle hash: the highest 41, and the 7 that name its register."""
    short = ((shingles >> _U(23)) << _U(7)) | (shingles & _U(REGISTERS - 1))
    return np.ascontiguousarray(short.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    """The packed hashes at their places, in order; the 16 bits between are 0.

    Two different shingles of a pair of texts fall together with a probability of 2^-48.  The
    registers are those of the whole hashes while less than 2^31 shingles share a register.
    """
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    short = wide.view(np.uint64).ravel()
    return ((short >> _U(7)) << _U(23)) | (short & _U(REGISTERS - 1))


def _set_batches(batches):
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for i, j, data, offsets in batch_slices(batch, "text"):
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), pa.array([packed(s) for s in shingle_sets(data, offsets)], pa.binary())],
                names=["id", "shingles"])
    _given_back()


def _linked(percent):
    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keep = []
            for x, y in zip(col["xa"], col["xb"]):
                x, y = unpacked(x.as_py()), unpacked(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
            yield pa.RecordBatch.from_arrays([col["a"], col["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        _given_back()
    return run


def stored_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) for ids(id): texts are narrowed to the ids before any set is made, and read once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        ids, F.col("doc_id") == F.col("id"), "left_semi")
    return stored(texts.mapInArrow(_set_batches, "id long, shingles binary"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) that are linked on their full shingle sets.

    Sets of `b` travel first and meet the set of `a` in place, so the set of a hub is not repeated
    on the way.
    """
    both = (pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a"))
    return both.select("a", "b", "xa", "xb").mapInArrow(_linked(round(100 * similarity)), "a long, b long")


# ------------------------------------------------------------------ candidates

def _common(one: list[np.ndarray], two: list[np.ndarray], width: int = 1024) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of another, by products of incidence matrices.

    Only shingles that both lists have take part, some columns at a time.
    """
    flat = [np.concatenate(sets) for sets in (one, two)]
    columns = np.intersect1d(*flat)
    out = np.zeros((len(one), len(two)), np.float32)
    if not len(columns):
        return out

    def placed(sets, all_of_them):
        col = np.searchsorted(columns, all_of_them).astype(np.int32)
        np.minimum(col, len(columns) - 1, out=col)
        hit = np.flatnonzero(columns[col] == all_of_them)
        hit = hit[np.argsort(col[hit], kind="stable")]
        return col[hit], np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[hit]

    sides = [(len(sets), *placed(sets, all_of_them)) for sets, all_of_them in zip((one, two), flat)]
    del flat
    for at in range(0, len(columns), width):
        product = []
        for n, col, row in sides:
            i, j = np.searchsorted(col, (at, at + width))
            m = np.zeros((n, min(width, len(columns) - at)), np.float32)
            m[row[i:j], col[i:j] - at] = 1
            product.append(m)
        out += product[0] @ product[1].T
    return out


def _open_block(similarity):
    """Links that join different components in one pair of blocks of a band group, as a forest.

    A pair is looked at in the first band it shares.  The estimate leaves out what cannot link; the
    others are decided on their full sets.  One link is given for each two components that meet, so
    a block of n members gives fewer than n rows whatever its members have in common.
    """
    percent = round(100 * similarity)

    def run(rows):
        first, second = rows[rows.side == 0], rows[rows.side == 1]
        second = second if rows.low.iloc[0] != rows.high.iloc[0] else first
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if not len(first) or not len(second):
            return none
        band = rows.band.iloc[0]
        sets_a = [unpacked(x) for x in first.shingles]
        sets_b = sets_a if second is first else [unpacked(x) for x in second.shingles]
        sa = registers(sets_a)
        sb = sa if second is first else registers(sets_b)
        wa, wb = (np.ascontiguousarray(s).view(_U) for s in (sa, sb))  # a word is one band
        na, nb = first.n.to_numpy(), second.n.to_numpy()
        ca, cb = first.component.to_numpy(), second.component.to_numpy()
        ia, ib = first.id.to_numpy(), second.id.to_numpy()
        parent, out = {}, []

        def root(c):
            while parent.get(c, c) != c:
                parent[c] = parent.get(parent[c], parent[c])
                c = parent[c]
            return c

        for at in range(0, len(ia), STRIP):
            # components that an earlier strip has joined need no further link
            now_a, now_b = (np.array([root(c) for c in cs.tolist()], np.int64) for cs in (ca[at:at + STRIP], cb))
            left, right = [], []
            for k, i in enumerate(range(at, min(at + STRIP, len(ia)))):
                other = np.flatnonzero((now_b != now_a[k]) & ((ib > ia[i]) if second is first else True))
                shared = (wb[other, :band] == wa[i, :band]) & (wa[i, :band] != ~_U(0))
                other = other[~shared.any(axis=1)]
                other = other[may_link(sa[i], sb[other], na[i], nb[other], similarity)] if len(other) else other
                left.append(np.full(len(other), i))
                right.append(other)
            left, right = np.concatenate(left), np.concatenate(right)
            if not len(left):
                continue
            ua, pa_ = np.unique(left, return_inverse=True)
            ub, pb = np.unique(right, return_inverse=True)
            if len(left) > 4 * (len(ua) + len(ub)):
                both = _common([sets_a[i] for i in ua], [sets_b[i] for i in ub])[pa_, pb]
            else:
                both = np.array([len(np.intersect1d(sets_a[i], sets_b[j], assume_unique=True)) for i, j in zip(left, right)])
            hit = 100 * both >= percent * (na[left] + nb[right] - both)
            for i, j in zip(left[hit], right[hit]):
                x, y = root(int(ca[i])), root(int(cb[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((min(ia[i], ib[j]), max(ia[i], ib[j])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64") if out else none
    return run


def _star_candidates(members: DataFrame) -> DataFrame:
    """Every member of a band group with the member that shares most bands with others."""
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    hub = members.join(degree, "id").groupBy("key").agg(
        F.max_by("id", F.struct("degree", -F.col("id"))).alias("hub"))
    return members.join(hub, "key").where("id <> hub").select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _estimate_pairs(pairs: DataFrame, sketch: DataFrame, similarity: float) -> DataFrame:
    narrow = sketch.select("doc_id", "n_shingles", "sketch")
    both = (pairs.join(narrow.toDF("b", "nb", "sb"), "b").join(narrow.toDF("a", "na", "sa"), "a")
            .select("a", "b", "na", "nb", "sa", "sb"))
    return both.mapInArrow(_estimated(similarity), "a long, b long")


def _open_links(members: DataFrame, labels: DataFrame, sketch: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between different components in band groups, as many as join them.

    Groups of up to SMALL members are joined with themselves, estimated and verified.  A larger
    group is cut into blocks by a hash of the id, so that a block has at most about BLOCK members
    and BLOCK_SHINGLES shingles, and each pair of blocks is a small task group of its own.
    """
    named = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                         F.sum("n").alias("total")).where("lo <> hi")
    cut = stored(named.join(open_keys.select("key", "total"), "key"))
    few = cut.where(F.col("size") <= SMALL)
    one = few.select("key", F.col("id").alias("a"), F.col("component").alias("ca"))
    two = few.select("key", F.col("id").alias("b"), F.col("component").alias("cb"))
    pairs = one.join(two, "key").where("a < b and ca <> cb").select("a", "b").distinct()
    likely = stored(_estimate_pairs(pairs, sketch, similarity))

    many = cut.where(F.col("size") > SMALL).withColumn(
        "blocks", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = many.select("key", "band", "id", "component", "n", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
            F.least("block", other).cast("int").alias("low"), F.greatest("block", other).cast("int").alias("high"),
            F.when(F.col("block") <= other, 0).otherwise(1).alias("side")))).alias("p")).select("key", "band", "id", "component", "n", "p.*")
    blocked = dealt.join(sets, "id").groupBy("key", "low", "high").applyInPandas(_open_block(similarity), "a long, b long")
    return verified(likely, sets, similarity).union(blocked).distinct()


# ------------------------------------------------------------------ the operator

def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text, ..).

    Two texts are linked when their sets of five-word shingles (A-Z lower-cased, words cut at ASCII
    white space) have a Jaccard similarity of `similarity` or more.  component_id is the smallest
    doc_id reachable over links; kept marks the row that carries it.

    Null and empty texts, and texts of white space, have no shingles and link with nothing.  Fewer
    than five words are one shingle.  A null doc_id keeps its row, with null component_id and kept
    false, and takes no part in links.  Rows that repeat a doc_id are rows of one document: its
    sets are linked by the id itself.  No rows give no rows.  Other columns are ignored.
    """
    sketch = stored(sketches(small_batches(docs)))
    known = sketch.where("n_shingles > 0 and doc_id is not null")
    # written, so that a join with it can split the rows of a set with very many copies
    folded = stored(known.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    reps = known.select("doc_id", "d1", "d2", "n_shingles", "bands").join(
        folded.withColumnRenamed("rep", "doc_id"), ["d1", "d2", "n_shingles", "doc_id"], "left_semi")
    bands = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key")).where("key is not null")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(bands.join(shared, "key").select("key", "band", "id", "n", "size"))
    sets = stored_sets(docs, members.select("id").distinct())

    stars = stored(_estimate_pairs(_star_candidates(members), sketch, similarity))
    links = stored(verified(stars, sets, similarity))
    found = components(links)
    more = stored(_open_links(members, found, sketch, sets, similarity))
    if not more.isEmpty():
        found = components(links.union(more))

    copies = known.select("doc_id", "d1", "d2", "n_shingles").join(folded, ["d1", "d2", "n_shingles"])
    labelled = copies.join(found, F.col("rep") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    rest = sketch.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = labelled.unionByName(rest)
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
