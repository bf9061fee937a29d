"""Tree search against brute force: exact where all leaves are visited, recall where they are not."""

import math

import numpy as np
import pytest

from orgsift.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int, leaf string, query_id string, rank string, score int, block int, ids string"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 7, "x", "x", "x", 7, 7, "x") for i, v in rows], SCHEMA.replace("float", kind))


def plain(rows, most=20, step=20):
    """All pairs, from the definition."""
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    sizes = sorted((-sum(len(v) == n for _, v in fine), n) for n in {len(v) for _, v in fine})
    one = {}
    for i, v in fine:
        if len(v) == sizes[0][1]:
            v = [float(x) for x in v]
            one[i] = min(one.get(i, v), v)
    out = []
    for q, x in one.items():
        if q % step == 0:
            near = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in one.items() if i != q)
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near[:most])]
    return sorted(out)


def found(df):
    assert [t for _, t in df.dtypes] == ["bigint", "int", "bigint", "double"]
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def close(a, b):
    return len(a) == len(b) and all(x[:3] == y[:3] and abs(x[3] - y[3]) < 1e-9 for x, y in zip(a, b))


def awkward(seed=1, n=300, dim=6):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=dim)]) for i in rng.permutation(np.arange(-40, n - 40))]
    copy = rows[0][1]
    rows += [(int(1000 + i), copy) for i in range(150)] + [(2000 + i, [0.5] * dim) for i in range(30)]  # copies, so ties
    rows += [rows[3], rows[3], (rows[4][0], [9.0] * dim)]  # repeated rows, one vec_id on two vectors
    rows += [(3000, None), (3020, []), (3040, [0.0] * dim), (3060, [-0.0] * dim), (3080, [1.0] * (dim - 1)), (None, [1.0] * dim),
             (3100, [float("nan")] * dim), (3120, [float("inf")] + [0.0] * (dim - 1)), (3140, [None] + [1.0] * (dim - 1))]
    return rows


@pytest.mark.parametrize("kind, leaf_rows", [("float", 1024), ("double", 40), ("float", 8)])
def test_all_leaves_give_the_exact_answers(spark, kind, leaf_rows):
    rows = awkward()
    got = N.nearest(table(spark, rows, kind).repartition(4), leaf_rows=leaf_rows, target=2.0)  # a target beyond 1 visits every leaf
    assert close(found(got), plain(rows))


def test_few_rows(spark):
    assert found(N.nearest(table(spark, []))) == []
    assert found(N.nearest(table(spark, [(20, [1.0, 2.0])]))) == []
    assert found(N.nearest(table(spark, [(3, None), (20, [0.0])]))) == []
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [1.0, 0.0]), (41, [2.0, 0.0])]
    assert close(found(N.nearest(table(spark, rows))), plain(rows))  # fewer than 20: all of them


def test_small_blocks_groups_and_lists(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 7), ("GROUP_ROWS", 3), ("ID_LIST", 2)):
        monkeypatch.setattr(N, name, value)
    rows = awkward(2, 120)
    assert close(found(N.nearest(table(spark, rows), neighbours=5, query_step=4, leaf_rows=16, target=2.0)), plain(rows, 5, 4))


@pytest.mark.parametrize("spread", [0.15, 1.0])
def test_recall_where_leaves_are_left_out(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + spread * rng.normal(size=(4000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    index = N.build_index(table(spark, rows), leaf_rows=100)
    assert index.recall >= 0.9 and (spread > 0.5 or index.visits < index.tree.leaves)
    exact = {(q, i) for q, _, i, _ in plain(rows)}
    got = found(N.search(index))
    assert len(got) == 20 * 200 and len(exact & {(q, i) for q, _, i, _ in got}) >= 0.9 * len(exact)
    flat = x.astype(np.float64)
    assert all(abs(s - flat[q] @ flat[i]) < 1e-9 for q, _, i, s in got)


def test_answers_are_filled_up_where_leaves_are_small(spark):
    """Visits go on until the visited leaves hold as many rows as are asked for."""
    tree = N.fit_tree(np.random.default_rng(0).normal(size=(64, 4)), 4)
    order = N.visit_order(tree, np.ones((1, 4)), 1, [3] * tree.leaves, 21)[0]
    assert len(order) == 7 and len(set(order)) == 7 and order == N.visit_order(tree, np.ones((1, 4)), tree.leaves)[0][:7]


def test_tree_holds_every_vector_once():
    x = np.vstack([np.random.default_rng(4).normal(size=(500, 5)), np.ones((100, 5))])
    tree = N.fit_tree(x, 20)
    leaf = N.leaf_of(tree, x)
    assert set(leaf.tolist()) <= set(range(tree.leaves)) and sorted(k for k in tree.leaf.tolist() if k >= 0) == list(range(tree.leaves))
    assert len(set(leaf[500:].tolist())) == 1  # copies share a leaf
    assert all(len(set(o)) == tree.leaves for o in N.visit_order(tree, x[:5], tree.leaves))
