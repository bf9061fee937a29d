"""Near and exact duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from orgsift.llm import near_dups
from orgsift.llm.exact_dups import build_filter, deduplicated, digests, exact_duplicates, in_filter
from orgsift.llm.graph import components
from orgsift.llm.near_dups import near_duplicates, registers
from cases import TEXTS, awkward, lowered, none


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Smallest reachable id of each document over all pairs."""
    sets = {d: shingles(t) for d, t in rows if d is not None}
    low = {d: d for d in sets}

    def root(d):
        while low[d] != d:
            d = low[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def families(seed=3, groups=6, copies=40):
    """Groups of texts that differ from their base in a growing number of words, so links form chains and stars."""
    rnd, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rnd.randrange(10**6)}" for _ in range(rnd.choice([8, 60, 200]))]
        for c in range(copies):
            words = list(base)
            for _ in range(rnd.randrange(0, max(2, len(words) // 12))):
                words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**9)}"
            rows.append((g * 1000 + c, " ".join(words)))
    return rows


@pytest.mark.parametrize("small", [64, 2])
def test_near_duplicates_are_those_of_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(near_dups, "SMALL", small)  # 2: all open groups go through blocks
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    rows = families()
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert len({c for _, c in wanted.values()}) > 6  # some copies are too far away


def test_awkward_rows_of_near_duplicates(spark):
    out = near_duplicates(awkward(spark)).collect()
    assert len(out) == len(TEXTS)
    wanted = brute([(d, t) for d, t, *_ in TEXTS])
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id) == wanted[r.doc_id]
    assert near_duplicates(none(spark)).collect() == []


def test_estimate_is_close():
    rng = np.random.default_rng(5)
    pool = rng.permutation(np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64)))
    a, b = pool[:3000], pool[600:3600]
    ra, rb = registers([np.sort(a)])[0], registers([np.sort(b)])[0]
    assert abs((ra == rb).mean() - 2400 / 3600) < 0.17
    assert near_dups.may_link(ra, ra, np.int64(3000), np.int64(3000))
    assert not near_dups.may_link(ra, registers([np.sort(pool[3700:])])[0], np.int64(3000), np.int64(1300))


def test_components_of_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(100, 180)]
    hub = [(500, i) for i in range(501, 560)]
    edges = spark.createDataFrame(path + hub + [(7, 7), (None, 3), (500, 501)], "a long, b long")
    out = {r.id: r.component for r in components(edges).collect()}
    assert out == {**{i: 100 for i in range(100, 181)}, **{i: 500 for i in range(500, 560)}}
    assert components(edges.where("false")).collect() == []


def test_filter_knows_its_keys():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 17, 1000, 30_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        made = build_filter(np.concatenate([keys, keys[:1]]))
        assert in_filter(keys, *made).all()
        assert in_filter(rng.integers(0, 2**63, 20_000).astype(np.uint64), *made).mean() < 0.002


def wanted_copies(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(hashlib.sha256(lowered(t).encode()).hexdigest(), []).append(d)
    out = []
    for sha, ids in groups.items():
        top = max((d for d in ids if d is not None), default=None)
        out += [(d, top, len(ids), d == top, sha) for d in ids]
    return Counter(out)


def test_exact_duplicates(spark):
    rows = [(d, t) for d, t, *_ in TEXTS] + [(100 + i, f"copy {i % 7}") for i in range(300)]
    docs = awkward(spark, [(d, t, None, None) for d, t in rows])
    for keys in (200_000, 5):  # one shard, and many
        assert Counter(map(tuple, deduplicated(docs, keys).collect())) == wanted_copies(rows)
    assert deduplicated(none(spark)).collect() == []


def test_batch_against_a_snapshot(spark):
    old = spark.createDataFrame([(1, "Aa"), (2, "b"), (3, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(4, "aA"), (5, "c"), (6, "C"), (7, "d")], "doc_id long, text string")
    out = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(digests(old), digests(new)).collect()}
    assert out == {1: (4, 2, False), 4: (4, 2, True), 2: (3, 2, False), 3: (3, 2, True), 5: (6, 2, False), 6: (6, 2, True), 7: (7, 1, True)}
    empty = digests(old.where("false"))
    assert {r.doc_id for r in exact_duplicates(empty, digests(new)).collect() if r.kept} == {4, 6, 7}
    assert {r.doc_id for r in exact_duplicates(digests(old), empty).collect() if r.kept} == {1, 3}


def test_packed_hashes_keep_order_registers_and_sizes():
    import numpy as np
    from orgsift.llm import near_dups as D
    rng = np.random.default_rng(5)
    for n in (0, 1, 400, 100_000):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64))
        back = D.unpacked(D.packed(s))
        assert len(back) == len(s) and (np.diff(back.astype(np.float64)) >= 0).all() and len(D.packed(s)) == 6 * len(s)
        assert (D.registers([back]) == D.registers([s])).all()


def test_workers_give_arrow_memory_back(monkeypatch):
    import pyarrow as pa
    given = []
    monkeypatch.setattr(near_dups, "_given_back", lambda: given.append(1), raising=False)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array(["a b c", None])], names=["doc_id", "text"])
    assert sum(b.num_rows for b in near_dups._set_batches([batch])) == 2 and sum(b.num_rows for b in near_dups._sketch_batches([batch])) == 2
    assert len(given) == 2


def test_common_counts_equal_brute_force():
    rng = np.random.default_rng(3)
    one, two = ([np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in sizes] for sizes in ((5, 0, 900, 40), (700, 1, 0)))
    want = [[len(np.intersect1d(a, b)) for b in two] for a in one]
    assert near_dups._common(one, two, 64).tolist() == want and near_dups._common(one[:1], [np.zeros(0, np.uint64)]).tolist() == [[0]]
