"""Prefix trie of rebuilt conversations, shard by shard in ternary search trees.

A turn is known by the first 128 bits of the SHA-256 of its role and text, so texts never travel.
Conversations become arrays of turn ids, are ordered by them and dealt to range shards of about
SHARD_TURNS turns.  A shard gives its turn ids dictionary numbers in the same order, and inserts its
distinct sequences into a ternary search tree, medians first, so the trees of siblings are balanced.
An iterative walk from the last visited node back adds up members, leaves and savings.

Shards follow each other along one order, so a node can have members in other shards only if it lies
on the path to the first or to the last sequence of its shard.  Those boundary nodes are merged
afterwards, FAN neighbouring shards at a time: what is inside the new range is finished, what lies on
its two outer paths goes on to the next round, and the last round ends at the root.  Which members end
at a boundary node travels as chunks of text in order, and a digest reads them one after the other.

One conversation's turn ids (20 bytes a turn) lie in one task; no other group does.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .store import stored

SHARD_TURNS = 400_000
FAN = 32  # neighbouring shards that one task merges
BLOCK, MOST_SHARED = 20, 4  # conversations of a block share up to MOST_SHARED - 1 first turns
CHUNK_IDS = 50_000
NOTHING = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------------ sequences

def turn_id(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of role and text, told apart by the length of the role."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def rebuilt(conversations: DataFrame, block: int = BLOCK, most: int = MOST_SHARED) -> DataFrame:
    """conv_id, ids, words: the rebuilt turns of every conversation, in order.

    The first h = crc32(decimal conv_id) % most turns come from the conversation that opens the block
    (conv_id - conv_id % block), the others are its own.  Turns are ordered by turn, null first, and
    equal ones by their ids.  A null role or text is empty; rows with a null conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    conv = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id is not null").select(
        conv.alias("conv_id"), (conv - conv % block).alias("base"),
        F.struct(F.col("turn"), turn_id(role, text).alias("id"),
                 F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("int").alias("words")).alias("t"))
    # dealt by block once: grouping and the join below need no other exchange
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    first = own.where("conv_id = base").select("base", F.slice("own", 1, most - 1).alias("first"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    shared = F.coalesce(F.when(h > 0, F.slice("first", F.lit(1), h)), F.slice("own", 1, 0))
    rest = F.slice("own", h + 1, F.size("own"))
    both = own.join(first, "base", "left").select("conv_id", F.concat(shared, rest).alias("t"))
    return both.select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


# ------------------------------------------------------------------ one shard

class TernaryTree:
    """A ternary search tree over numbered turns; node 0 stands for the empty sequence.

    `same` leads to the tree of the next turn, `less` and `more` to other turns at the same place.
    """

    def __init__(self):
        self.turn, self.less, self.more, self.same, self.parent, self.depth = [-1], [0], [0], [0], [0], [0]

    def _new(self, turn: int, parent: int) -> int:
        for column, value in ((self.turn, turn), (self.less, 0), (self.more, 0), (self.same, 0), (self.parent, parent), (self.depth, self.depth[parent] + 1)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, sequence) -> int:
        """The node of the whole sequence."""
        at, turn, less, more, same = 0, self.turn, self.less, self.more, self.same
        for x in sequence:
            here = same[at]
            if not here:
                here = same[at] = self._new(x, at)
            while turn[here] != x:
                side = less if x < turn[here] else more
                if not side[here]:
                    side[here] = self._new(x, at)
                here = side[here]
            at = here
        return at

    def path(self, node: int) -> list[int]:
        """The nodes from the root to this one."""
        out = [node]
        while node:
            node = self.parent[node]
            out.append(node)
        return out[::-1]

    def visited(self) -> list[int]:
        """All nodes, every one after its parent, by an explicit stack."""
        out, stack = [0], [self.same[0]] if self.same[0] else []
        while stack:
            v = stack.pop()
            out.append(v)
            stack += [u for u in (self.more[v], self.same[v], self.less[v]) if u]
        return out


def median_first(n: int):
    """0 .. n - 1, the middle of every range before its halves."""
    ranges = [(0, n)] if n else []
    for a, b in ranges:
        middle = (a + b) // 2
        yield middle
        if a < middle:
            ranges.append((a, middle))
        if middle + 1 < b:
            ranges.append((middle + 1, b))


def _prefix_keys(ids: list[bytes]) -> list[bytes]:
    """A 128-bit key for each prefix of a sequence, the empty one first."""
    out = [b"\0" * 16]
    for x in ids:
        out.append(hashlib.sha256(out[-1] + x).digest()[:16])
    return out


_SHARD = ("kind int, shard long, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
          "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, words long, first boolean, last boolean, part long, chunk binary")
_FIELDS = [f.split()[0] for f in _SHARD.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
_ARROW = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in _SHARD.split(", ")])
NODE, SPINE, ENDS = 0, 1, 2


def _rows(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def shard_rows(shard: int, conv: np.ndarray, lengths: np.ndarray, turn_ids: pa.Array, words: np.ndarray):
    """Finished nodes, boundary nodes and chunks of ends of one shard, whose conversations are in order."""
    coded = turn_ids.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    number = rank[coded.indices.to_numpy()] if len(turn_ids) else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    # conversations with one sequence follow each other
    opens = np.ones(len(conv), bool)
    for i in range(1, len(conv)):
        opens[i] = lengths[i] != lengths[i - 1] or bool((number[begin[i]:begin[i + 1]] != number[begin[i - 1]:begin[i]]).any())
    group = np.flatnonzero(opens)
    until = np.append(group[1:], len(conv))

    tree, at_end = TernaryTree(), {}
    for g in median_first(len(group)):
        at_end[tree.insert(number[begin[group[g]]:begin[group[g] + 1]].tolist())] = g
    n = len(tree.turn)
    word_of = np.zeros(max(1, len(rank)), np.int64)
    word_of[number] = words
    own_words = np.where(np.array(tree.turn) < 0, 0, word_of[np.array(tree.turn)]).tolist()

    members, least, leaves, saved, children = [0] * n, [1 << 63] * n, [0] * n, [0] * n, [0] * n
    for v, g in at_end.items():
        members[v], least[v] = int(until[g] - group[g]), int(conv[group[g]])
    node_of = {g: v for v, g in at_end.items()}
    spine = {}
    for name, g in (("first", 0), ("last", len(group) - 1)):
        raw = turn_ids.slice(begin[group[g]], lengths[group[g]]).to_pylist()
        for v, key in zip(tree.path(node_of[g]), _prefix_keys(raw)):
            spine.setdefault(v, [key, False, False])[1 + (name == "last")] = True

    order, parent = tree.visited(), tree.parent
    done = []
    for v in reversed(order):
        p = parent[v]
        if v:
            members[p] += members[v]
            least[p] = min(least[p], least[v])
        if v in spine:
            continue  # what other shards add is not known yet
        leaves[v] = leaves[v] or 1
        saved[v] += (members[v] - 1) * own_words[v]
        children[p] += 1
        leaves[p] += leaves[v]
        saved[p] += saved[v]
        done.append(v)
    for a in range(0, len(done), 20_000):
        part = done[a:a + 20_000]
        yield _rows({
            "kind": [NODE] * len(part), "shard": [shard] * len(part), "parent_key": [spine[parent[v]][0] if parent[v] in spine else None for v in part],
            "conv_id": [least[v] for v in part], "depth": [tree.depth[v] for v in part],
            "parent_conv_id": [None if parent[v] in spine else least[parent[v]] for v in part], "n_convs": [members[v] for v in part],
            "n_children": [children[v] for v in part], "n_leaves": [leaves[v] for v in part], "saved_tokens": [saved[v] for v in part],
            "ends_sha256": [_digest(conv[group[at_end[v]]:until[at_end[v]]]) if v in at_end else NOTHING for v in part]}, len(part))
    edge = list(spine)
    yield _rows({
        "kind": [SPINE] * len(edge), "shard": [shard] * len(edge), "key": [spine[v][0] for v in edge],
        "parent_key": [spine[parent[v]][0] if v else None for v in edge], "conv_id": [least[v] for v in edge], "depth": [tree.depth[v] for v in edge],
        "n_convs": [members[v] for v in edge], "n_children": [children[v] for v in edge], "n_leaves": [leaves[v] for v in edge],
        "saved_tokens": [saved[v] for v in edge], "words": [own_words[v] for v in edge], "first": [spine[v][1] for v in edge], "last": [spine[v][2] for v in edge]}, len(edge))
    for v in edge:
        if v in at_end:
            ends = conv[group[at_end[v]]:until[at_end[v]]]
            for k, a in enumerate(range(0, len(ends), CHUNK_IDS)):
                yield _rows({"kind": [ENDS], "shard": [shard], "key": [spine[v][0]], "part": [k],
                             "chunk": [",".join(map(str, ends[a:a + CHUNK_IDS].tolist())).encode()]}, 1)


def _shard_batches(batches):
    conv, lengths, ids, words = [], [], [], []
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        conv.append(col["conv_id"].to_numpy())
        lengths.append(pc.list_value_length(col["ids"]).to_numpy())
        ids.append(col["ids"].flatten())
        words.append(col["words"].flatten().to_numpy())
    if sum(map(len, conv)):
        flat = pa.concat_arrays([x.cast(pa.large_binary()) for x in ids])
        yield from shard_rows(TaskContext.get().partitionId(), np.concatenate(conv), np.concatenate(lengths), flat, np.concatenate(words))


# ------------------------------------------------------------------ boundary nodes

_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
_SPINE_SCHEMA = ", ".join(f for f in _SHARD.split(", ") if f.split()[0] in (
    "kind", "shard", "key", "parent_key", "conv_id", "depth", *_SUMS, "words", "first", "last"))
_SPINE = [f.split()[0] for f in _SPINE_SCHEMA.split(", ")]


def merge_shards(rows: pd.DataFrame, last_round: bool) -> pd.DataFrame:
    """Boundary nodes of neighbouring shards as one: those inside are finished, the outer paths stay boundaries."""
    low, high = rows["shard"].min(), rows["shard"].max()
    rows = rows.assign(first=rows["first"] & (rows["shard"] == low), last=rows["last"] & (rows["shard"] == high))
    merged = rows.groupby("key", sort=False).agg(
        parent_key=("parent_key", "first"), conv_id=("conv_id", "min"), depth=("depth", "first"), words=("words", "first"),
        first=("first", "any"), last=("last", "any"), **{c: (c, "sum") for c in _SUMS}).sort_values("depth", ascending=False).reset_index()
    number = {k: i for i, k in enumerate(merged["key"])}
    parent = [number.get(p, -1) if p is not None else -1 for p in merged["parent_key"]]
    n, children, leaves, saved = (merged[c].tolist() for c in _SUMS)
    words, outer = merged["words"].tolist(), (merged["first"] | merged["last"]).tolist()
    kind = []
    for v in range(len(merged)):  # deepest first, so every child before its parent
        if outer[v] and not last_round:
            kind.append(SPINE)
            continue
        kind.append(NODE)
        leaves[v] = leaves[v] or 1
        saved[v] += (n[v] - 1) * words[v]
        if parent[v] >= 0:
            p = parent[v]
            children[p] += 1
            leaves[p] += leaves[v]
            saved[p] += saved[v]
    return merged.assign(kind=kind, shard=low, n_convs=n, n_children=children, n_leaves=leaves, saved_tokens=saved)[_SPINE]


def _merging(last_round):
    def run(rows):
        return merge_shards(rows, last_round)
    return run


def merged_boundaries(spine: DataFrame, shards: int) -> DataFrame:
    """One finished row per boundary node, from rounds over FAN neighbouring ranges each."""
    done, now, span = [], spine.select(*_SPINE), 1
    while True:
        span *= FAN
        ends = span >= shards
        out = stored(now.groupBy(F.floor(F.col("shard") / span).alias("range")).applyInPandas(_merging(ends), _SPINE_SCHEMA))
        done.append(out.where(F.col("kind") == NODE))
        if ends:
            break
        now = out.where(F.col("kind") == SPINE)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every


def _hash_chunks(batches):
    """Digests of chunks that are sorted by key, shard and part."""
    key, state, keys, found = None, None, [], []
    for batch in batches:
        for k, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if state is not None:
                    keys.append(key)
                    found.append(state.hexdigest())
                key, state = k, hashlib.sha256(chunk)
            else:
                state.update(b"," + chunk)
    if state is not None:
        keys.append(key)
        found.append(state.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends"])


# ------------------------------------------------------------------ the operator

_OUT = ("conv_id", "depth", "parent_conv_id", *_SUMS[:1], "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of sequences(conv_id, ids, words): see conversation_trie.

    `ids` are the turn ids of a conversation in order, 16 bytes each, `words` the words of each turn;
    equal ids have equal words, and each conv_id stands once.
    """
    sequences = stored(sequences)
    size = sequences.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    shards = max(1, -(-size // shard_turns))
    dealt = sequences.repartitionByRange(shards, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    rows = stored(dealt.mapInArrow(_shard_batches, _SHARD))
    spine = rows.where(F.col("kind") == SPINE)
    top = (spine.agg(F.max("shard")).first()[0] or 0) + 1
    ends = rows.where(F.col("kind") == ENDS).select("key", "shard", "part", "chunk").repartition("key").sortWithinPartitions("key", "shard", "part").select(
        "key", "chunk").mapInArrow(_hash_chunks, "key binary, ends string")
    edge = stored(merged_boundaries(spine, top).join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING))).select(
        "key", "parent_key", "conv_id", "depth", *_SUMS, "ends_sha256"))
    above = edge.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    outer = edge.join(above, "parent_key", "left")
    # children of boundary nodes are looked up per shard, so the root is no hot key
    named = spine.select("shard", "key").join(edge.select("key", F.col("conv_id").alias("_up")), "key").withColumnRenamed("key", "parent_key")
    nodes = rows.where(F.col("kind") == NODE)
    inner = nodes.where("parent_key is null")
    hung = nodes.where("parent_key is not null").drop("parent_conv_id").join(named.withColumnRenamed("_up", "parent_conv_id"), ["shard", "parent_key"])
    return outer.select(*_OUT).unionByName(inner.select(*_OUT)).unionByName(hung.select(*_OUT))


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations(conv_id, turn, role, text, ..).

    A node is a distinct sequence of the first d rebuilt turns; its members are the conversations
    that begin with it.  conv_id is the smallest member, depth is d, parent_conv_id the smallest
    member of the node one turn shorter (null for the root), n_convs the number of members,
    n_children and n_leaves the children and the childless nodes of the subtree, saved_tokens the sum
    of (n_convs - 1) times the words of the last turn over the subtree, and ends_sha256 the SHA-256 of
    the decimal conv_ids that end here, in numerical order with commas between.

    Turns are ordered by turn, null first; turns with equal numbers by the digest of role and text;
    repeated rows are turns of their own.  A null role or text is empty.  Rows with a null conv_id
    take no part.  A conversation without rebuilt turns is a member of the root alone.  Texts of any
    length count whole.  No rows give no nodes, not even a root.  Other columns are ignored.
    """
    return prefix_trie(rebuilt(conversations), shard_turns)
