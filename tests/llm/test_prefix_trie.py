"""The conversation trie against a plain one, over one shard and over many."""

import hashlib
import random
import re
import zlib

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from orgsift.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth string, shard int, first int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", 7, 7) for r in rows], SCHEMA)


def plain(rows):
    """Nodes from the definition, one prefix at a time."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own.setdefault(c, []).append(((turn is not None, turn or 0, tie), role, text))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + t[h:])
    nodes = {s[:d] for s in built.values() for d in range(len(s) + 1)}
    members = {p: sorted(c for c, s in built.items() if s[:len(p)] == p) for p in nodes}
    children = {p: [q for q in nodes if len(q) == len(p) + 1 and q[:-1] == p] for p in nodes}
    out = []
    for p in nodes:
        under = [q for q in nodes if q[:len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", q[-1][1])) for q in under if q)
        ends = ",".join(str(c) for c in members[p] if built[c] == p)
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]),
                    sum(not children[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some(seed, convs=160):
    """Few different turns, so conversations share prefixes; nulls, gaps, ties and negative numbers among them."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-60, 400), convs):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([turn, turn, None, 3]), rng.choice(["user", "assistant", None, ""]),
                         rng.choice(["a", "a b", "a  b c", "", None, "x" * 50])))
        rows.append((c, 0, "user", "hello there"))
    rows += [(c, t, "user", "the same words") for c in range(1000, 1100) for t in range(5)]  # a large group of copies
    return rows + [(None, 1, "user", "without a number")] * 3 + [rows[0]] * 2


@pytest.mark.parametrize("seed, shard_turns, fan", [(1, 10**6, 32), (2, 40, 2), (3, 7, 3)])
def test_like_the_plain_trie(spark, monkeypatch, seed, shard_turns, fan):
    monkeypatch.setattr(T, "FAN", fan)
    rows = some(seed)
    assert found(T.conversation_trie(table(spark, rows).repartition(3), shard_turns)) == plain(rows)


def test_empty_and_turnless(spark):
    assert found(T.conversation_trie(table(spark, []))) == []
    assert found(T.conversation_trie(table(spark, [(None, 1, "user", "x")]))) == []
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)  # its block has no opening conversation
    assert found(T.conversation_trie(table(spark, [(lone, 1, "user", "x")]))) == plain([(lone, 1, "user", "x")])


def test_one_very_long_conversation(spark):
    rows = [(20, t, "user", f"turn {t}") for t in range(3000)] + [(21, 0, "user", "turn 0"), (40, 0, "user", "y " * 100_000)]
    got = T.conversation_trie(table(spark, rows), 500)
    assert {r.depth for r in got.where("conv_id = 20").collect()} == set(range(3001))
    root = got.where("depth = 0").collect()[0]
    assert (root.n_convs, root.parent_conv_id) == (3, None)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=6), max_size=30))
def test_ternary_tree(sequences):
    tree = T.TernaryTree()
    ends = {tuple(s): tree.insert(s) for s in sequences}
    assert len(set(ends.values())) == len(ends)
    for s, v in ends.items():
        path = tree.path(v)
        assert [tree.turn[u] for u in path[1:]] == list(s) and tree.depth[v] == len(s)
    order = tree.visited()
    assert sorted(order) == list(range(len(tree.turn)))
    place = {v: i for i, v in enumerate(order)}
    assert all(place[tree.parent[v]] < place[v] for v in order if v)


def test_medians_first_keep_siblings_balanced():
    assert sorted(T.median_first(37)) == list(range(37)) and list(T.median_first(0)) == []
    tree = T.TernaryTree()
    for k in T.median_first(1023):
        tree.insert([k])

    def height(v):
        return 1 + max(height(tree.less[v]), height(tree.more[v])) if v else 0
    assert height(tree.same[0]) == 10


def test_merging_neighbours_keeps_the_outer_paths():
    base = {"parent_key": None, "depth": 0, "words": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "kind": T.SPINE}
    rows = pd.DataFrame([{**base, "shard": s, "key": b"root", "conv_id": 9 - s, "n_convs": 2, "first": True, "last": True} for s in range(3)]
                        + [{**base, "shard": 1, "key": b"in", "parent_key": b"root", "depth": 1, "words": 4, "conv_id": 8, "n_convs": 2, "first": True, "last": True}])
    out = T.merge_shards(rows, False).set_index("key")
    assert out.loc[b"in", "kind"] == T.NODE and out.loc[b"in", "saved_tokens"] == 4 and out.loc[b"in", "n_leaves"] == 1
    assert out.loc[b"root", "kind"] == T.SPINE and out.loc[b"root", "conv_id"] == 7 and out.loc[b"root", "n_convs"] == 6 and out.loc[b"root", "saved_tokens"] == 4
