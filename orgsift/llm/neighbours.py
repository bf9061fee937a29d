"""Nearest neighbours by inner product with a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded sample of vectors; every vector is then put into its leaf.  Vectors
are ordered by leaf and value, so copies meet: a vector stands once with the smallest of its ids, as
many as any answer can hold.  Leaves are kept as blocks of at most BLOCK_ROWS vectors.

A query walks the tree with a priority queue: the node whose vectors promise the largest product
(the product with its centre and two standard deviations of its spread) is opened first, and leaves
are visited in the order in which they leave the queue.  How many leaves a query visits is calibrated:
for a bounded sample of queries the exact answers over all rows are found once, and the visits are
widened until TARGET_RECALL of these answers lie in visited leaves.

Queries that begin at one leaf form groups.  A group meets the blocks of the leaves that its queries
visit one after the other, and keeps the best answers so far, so a query sends on as many answers as
are asked for and one more.  All products are in double precision; the scores of the answers are
computed pair by pair on the original vectors.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .store import stored

NEIGHBOURS, QUERY_STEP = 20, 20
SAMPLE_ROWS = 20_000  # bound of the vectors that the tree is fitted on
CALIBRATION_ROWS = 128  # bound of the queries whose exact answers are found for calibration
TARGET_RECALL = 0.96
BRANCHES, LEAF_ROWS, LEAF_SAMPLE = 8, 1024, 8
BLOCK_ROWS, GROUP_ROWS, ID_LIST = 1024, 1024, 1000


# ------------------------------------------------------------------ the tree

@dataclass
class KMeansTree:
    """Nodes of a hierarchical k-means tree; node 0 is the root."""

    centre: np.ndarray  # one row per node
    spread: np.ndarray  # standard deviation of a node's vectors along a direction
    children: list[list[int]]
    leaf: np.ndarray  # number of the leaf, or -1

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())


def _split(x: np.ndarray, parts: int, rng, rounds: int = 12) -> np.ndarray:
    """Which of at most `parts` means each vector is nearest to."""
    means = x[rng.choice(len(x), parts, replace=False)]
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        new = (x @ means.T - 0.5 * (means * means).sum(axis=1)).argmax(axis=1)
        if (new == near).all() and _:
            break
        near = new
        sums = np.zeros_like(means)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=parts)
        means[n > 0] = sums[n > 0] / n[n > 0, None]
    return near


def fit_tree(sample: np.ndarray, leaf_size: int, branches: int = BRANCHES, seed: int = 0) -> KMeansTree:
    """A tree whose leaves hold at most `leaf_size` vectors of the sample, unless those are all equal."""
    rng, x = np.random.default_rng(seed), sample.astype(np.float64)
    centre, spread, children, leaf = [], [], [], []

    def node(rows):
        c = x[rows].mean(axis=0) if len(rows) else np.zeros(x.shape[1])
        centre.append(c)
        spread.append(float(np.sqrt(((x[rows] - c) ** 2).mean())) if len(rows) else 0.0)
        children.append([])
        leaf.append(-1)
        return len(centre) - 1

    waiting = [(node(np.arange(len(x))), np.arange(len(x)))]
    for v, rows in waiting:
        groups = []
        if len(rows) > leaf_size:
            parts = min(branches, -(-len(rows) // leaf_size))
            near = _split(x[rows], parts, rng)
            groups = [rows[near == k] for k in range(parts) if (near == k).any()]
        if len(groups) < 2:
            leaf[v] = sum(k >= 0 for k in leaf)
            continue
        for g in groups:
            u = node(g)
            children[v].append(u)
            waiting.append((u, g))
    return KMeansTree(np.array(centre), np.array(spread), children, np.array(leaf))


def leaf_of(tree: KMeansTree, x: np.ndarray) -> np.ndarray:
    """The leaf of each vector: down the nearest centres."""
    at = np.zeros(len(x), np.int64)
    waiting = [(0, np.arange(len(x)))]
    for v, rows in waiting:
        below = tree.children[v]
        if not below or not len(rows):
            at[rows] = v
            continue
        c = tree.centre[below]
        near = (x[rows] @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        waiting += [(u, rows[near == k]) for k, u in enumerate(below)]
    return tree.leaf[at]


def visit_order(tree: KMeansTree, queries: np.ndarray, visits: int, rows: list[int] | None = None, least: int = 0) -> list[list[int]]:
    """The leaves that each query visits, best bin first: `visits`, and more until they hold `least` of the leaves' rows."""
    leaf = tree.leaf.tolist()
    hope = queries @ tree.centre.T + 2 * np.linalg.norm(queries, axis=1)[:, None] * tree.spread
    out = []
    for row in hope:
        row, queue, seen, held = row.tolist(), [(0.0, 0)], [], 0
        while queue and (len(seen) < visits or held < least):
            _, v = heapq.heappop(queue)
            if leaf[v] >= 0:
                seen.append(leaf[v])
                held += rows[leaf[v]] if least else 0
            for u in tree.children[v]:
                heapq.heappush(queue, (-row[u], u))
        out.append(seen)
    return out


# ------------------------------------------------------------------ vectors, blocks and query groups

def _kind(vectors: DataFrame):
    return np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and embedding of the rows that take part, one row per vec_id.

    Left out are rows with a null vec_id, vectors that are null, empty, zero or hold null or
    non-finite components, and vectors of another length than the most frequent one (of equally
    frequent ones, the smallest).  A vec_id on several rows stands for the smallest of its vectors.
    """
    kind = vectors.schema[column].dataType.elementType
    as_float = "array<float>" if isinstance(kind, T.FloatType) else "array<double>"
    e = F.col(column).cast(as_float)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.where(F.coalesce(fine & F.col("vec_id").isNotNull(), F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    lengths = sorted((-r.n, r.size) for r in rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not lengths:
        return rows
    rows = rows.where(F.size("embedding") == lengths[0][1])
    again = stored(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"))
    if again.isEmpty():
        return rows
    return rows.join(again, "vec_id", "left_anti").unionByName(
        rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding")))


def _matrix(column, kind) -> np.ndarray:
    flat = column.flatten().to_numpy().astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _leaf_batches(tree, kind, most, step):
    """Each distinct vector of a batch with its leaf, its `most` smallest ids and those of its ids that are queries."""
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), kind)
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            value = np.ascontiguousarray(x + kind(0)).view(f"V{x.shape[1] * x.itemsize}").ravel()  # -0 counts as 0
            groups = {}
            for i in np.argsort(ids, kind="stable").tolist():
                groups.setdefault(value[i].tobytes(), []).append(i)
            first = np.array([g[0] for g in groups.values()])
            leaf = leaf_of(tree, x[first].astype(np.float64))
            kept, asked, rows = [], [], []
            for k, (v, g) in enumerate(groups.items()):
                mine = ids[g]
                q = mine[mine % step == 0]
                for a in range(0, max(1, len(q)), ID_LIST):
                    rows.append((leaf[k], v))
                    kept.append(mine[:most].tolist() if a == 0 else [])
                    asked.append(q[a:a + ID_LIST].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array(kept, pa.list_(pa.int64())), pa.array(asked, pa.list_(pa.int64()))], names=["leaf", "vector", "ids", "queries"])
    return run


_BLOCK = "leaf long, block long, n long, ids binary, counts binary, vectors binary, queries array<long>"
_BLOCK_ARROW = pa.schema([("leaf", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()),
                          ("vectors", pa.binary()), ("queries", pa.list_(pa.int64()))])


def _block_batches(most):
    """Blocks of distinct vectors, and their queries, from rows that are sorted by leaf and vector."""
    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        leaf, vectors, ids = None, [], []
        now, now_ids, now_queries = None, [], []

        def emitted(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_BLOCK_ARROW)], schema=_BLOCK_ARROW)

        def block():
            counts = np.array([len(i) for i in ids], "<i4")
            return emitted([(leaf, number, len(ids), np.array(sum(ids, []), "<i8").tobytes(), counts.tobytes(), b"".join(vectors), None)])

        def asked(n):
            return emitted([(now[0], None, 1, None, None, now[1], now_queries[:n])])

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if now is not None and row[:2] == now:
                    now_ids = sorted({*now_ids, *row[2]})[:most]
                    now_queries += row[3]
                    while len(now_queries) > ID_LIST:
                        yield asked(ID_LIST)
                        now_queries = now_queries[ID_LIST:]
                    continue
                if now is not None:
                    if now_queries:
                        yield asked(ID_LIST)
                    vectors.append(now[1])
                    ids.append(now_ids)
                if ids and (row[0] != leaf or len(ids) == BLOCK_ROWS):
                    yield block()
                    number, vectors, ids = number + 1, [], []
                now, now_ids, now_queries, leaf = row[:2], sorted(row[2])[:most], row[3], row[0]
        if now is not None:
            if now_queries:
                yield asked(ID_LIST)
            vectors.append(now[1])
            ids.append(now_ids)
            yield block()
    return run


def _visit_batches(tree, kind, visits, leaf_rows, least):
    """Each query vector with its ids and the leaves it visits, the best one named apart."""
    def run(batches):
        for batch in batches:
            raw, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(raw), 1000):
                x = np.frombuffer(b"".join(raw[a:a + 1000]), kind).reshape(len(raw[a:a + 1000]), -1).astype(np.float64)
                order = visit_order(tree, x, visits, leaf_rows, least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in order], pa.int64()), pa.array(raw[a:a + 1000], pa.binary()), pa.array(lists[a:a + 1000], pa.list_(pa.int64())),
                     pa.array(order, pa.list_(pa.int64()))], names=["best", "vector", "queries", "visits"])
    return run


def _group_batches(batches):
    """Groups of at most GROUP_ROWS query vectors that follow each other, with all the leaves that any of them visits."""
    from pyspark import TaskContext
    number, rows = TaskContext.get().partitionId() << 32, []

    def group():
        flat = lambda lists: (np.concatenate([np.array(x, "<i8") for x in lists]).tobytes(), np.array([len(x) for x in lists], "<i4").tobytes())
        one = [number, len(rows), b"".join(r[0] for r in rows), *flat([r[1] for r in rows]), *flat([r[2] for r in rows]),
               sorted({v for r in rows for v in r[2]})]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(one, _GROUP_ARROW)], schema=_GROUP_ARROW)

    for batch in batches:
        for row in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            rows.append(row)
            if len(rows) == GROUP_ROWS:
                yield group()
                number, rows = number + 1, []
    if rows:
        yield group()


_GROUP = "group long, n long, vectors binary, ids binary, counts binary, visits binary, visit_counts binary, leaves array<long>"
_GROUP_ARROW = pa.schema([(f.split()[0], {"long": pa.int64(), "binary": pa.binary()}.get(f.split()[1], pa.list_(pa.int64()))) for f in _GROUP.split(", ")])


# ------------------------------------------------------------------ products

def _lists(flat: bytes, counts: bytes) -> list[np.ndarray]:
    n = np.frombuffer(counts, "<i4")
    return np.split(np.frombuffer(flat, "<i8"), np.cumsum(n)[:-1]) if len(n) else []


def products_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each pair of rows, added up in the order of the components."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def best_of_block(queries: np.ndarray, vectors: np.ndarray, ids: list[np.ndarray], most: int):
    """(query number, id, score) of the `most` best ids of a block for each query, ties to smaller ids."""
    products = queries @ vectors.T
    k = min(most, products.shape[1])
    least = np.partition(products, products.shape[1] - k, axis=1)[:, products.shape[1] - k]
    # products of a block may round otherwise than those of a pair: a little more is looked at
    room = 1e-12 * (np.linalg.norm(queries, axis=1) * (np.linalg.norm(vectors, axis=1).max() if len(vectors) else 0) + 1e-300)
    row, col = np.nonzero(products >= (least - room)[:, None])
    score = products_of(queries[row], vectors[col])
    counts = np.array([len(i) for i in ids])
    many = counts[col]
    row, score = np.repeat(row, many), np.repeat(score, many)
    found = np.concatenate([ids[c] for c in col.tolist()]) if len(col) else np.zeros(0, np.int64)
    order = np.lexsort((found, -score, row))
    row, score, found = row[order], score[order], found[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < most
    return row[keep], found[keep], score[keep]


class _Asking:
    """A group of query vectors with their best answers so far."""

    def __init__(self, row, kind, most):
        self.most = most
        self.x = np.frombuffer(row["vectors"], kind).reshape(row["n"], -1).astype(np.float64)
        self.asker = np.array([q[0] for q in _lists(row["ids"], row["counts"])])
        self.visits = {}
        for q, leaves in enumerate(_lists(row["visits"], row["visit_counts"])):
            for leaf in leaves.tolist():
                self.visits.setdefault(leaf, []).append(q)
        self.row, self.found, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, row, kind):
        """Better the answers of the queries that visit the leaf of this block."""
        mine = np.array(self.visits[row["leaf"]])
        vectors = np.frombuffer(row["vectors"], kind).reshape(row["n"], -1).astype(np.float64)
        q, found, score = best_of_block(self.x[mine], vectors, _lists(row["ids"], row["counts"]), self.most)
        q, found, score = (np.concatenate(p) for p in ((self.row, mine[q]), (self.found, found), (self.score, score)))
        order = np.lexsort((found, -score, q))
        q, found, score = q[order], found[order], score[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.most
        self.row, self.found, self.score = q[keep], found[keep], score[keep]

    def answers(self):
        n = np.bincount(self.row, minlength=len(self.x))
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array(self.found), pa.array(self.score)], names=["vec_id", "score"])
        return pa.RecordBatch.from_arrays([pa.array(self.asker), pa.ListArray.from_arrays(ends, pairs)], names=["asker", "found"])


def _answer_batches(kind, most):
    """Answers of query groups: a group's own row comes first, then the blocks of the leaves it visits."""
    def run(batches):
        now = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                if row["leaf"] is None:
                    if now is not None:
                        yield now.answers()
                    now = _Asking(row, kind, most)
                else:
                    now.meet(row, kind)
        if now is not None:
            yield now.answers()
    return run


def _exact_batches(kind, queries, most):
    """The best of a task's blocks for each calibration query, with the leaf of each answer."""
    def run(batches):
        best = [np.zeros((0, 3)) for _ in queries]
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                vectors = np.frombuffer(col["vectors"][i].as_py(), kind).reshape(col["n"][i].as_py(), -1).astype(np.float64)
                row, found, score = best_of_block(queries, vectors, _lists(col["ids"][i].as_py(), col["counts"][i].as_py()), most)
                for q in np.unique(row).tolist():
                    mine = row == q
                    both = np.vstack([best[q], np.column_stack([score[mine], np.arange(mine.sum()), np.full(mine.sum(), col["leaf"][i].as_py())])])
                    best[q] = both[np.argsort(-both[:, 0], kind="stable")[:most]]
        n = [len(b) for b in best]
        every = np.vstack(best) if len(best) else np.zeros((0, 3))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), n)), pa.array(every[:, 0]), pa.array(every[:, 2].astype(np.int64))],
                                         names=["query", "score", "leaf"])
    return run


# ------------------------------------------------------------------ the operator

@dataclass
class Index:
    """Blocks of all vectors by leaf, with the tree and the calibrated number of visits."""

    tree: KMeansTree
    blocks: DataFrame
    queries: DataFrame
    kind: type
    leaf_rows: list[int]
    visits: int
    recall: float  # of the calibration queries at these visits


def calibrated(tree: KMeansTree, queries: np.ndarray, answers: list[np.ndarray], target: float = TARGET_RECALL) -> tuple[int, float]:
    """The visits, widened step by step, at which the share of answers in visited leaves reaches the target; and that share."""
    if not len(queries) or tree.leaves == 1:
        return 1, 1.0
    order = visit_order(tree, queries, tree.leaves)
    places = [np.array([o.index(leaf) for leaf in a.tolist()]) for o, a in zip(order, answers)]
    places = np.concatenate(places)
    visits = 1
    while visits < tree.leaves and (places < visits).mean() < target:
        visits = min(tree.leaves, max(visits + 1, visits * 9 // 8))
    return visits, float((places < visits).mean())


def build_index(vectors: DataFrame, neighbours: int = NEIGHBOURS, query_step: int = QUERY_STEP, sample_rows: int = SAMPLE_ROWS,
                leaf_rows: int = LEAF_ROWS, target: float = TARGET_RECALL) -> Index:
    """An index of all usable rows; the tree is fitted on at most `sample_rows` of them, chosen by a hash of vec_id.

    The sample and the calibration queries come to the driver, both bounded by parameters.  Leaves are as many
    as rows fill with `leaf_rows` each, up to one for LEAF_SAMPLE rows of the sample.
    """
    kind, rows = _kind(vectors), usable(vectors)
    total = rows.count()
    mixed = [F.xxhash64("vec_id"), F.col("vec_id")]
    sample = _matrix(rows.orderBy(*mixed).limit(sample_rows).select("embedding").toArrow().column(0).combine_chunks(), kind)
    leaves = max(1, min(total // leaf_rows, len(sample) // LEAF_SAMPLE))
    tree = fit_tree(sample, max(1, -(-len(sample) // leaves))) if len(sample) else fit_tree(np.zeros((0, 1)), 1)
    most = neighbours + 1
    placed = rows.mapInArrow(_leaf_batches(tree, kind, most, query_step), "leaf long, vector binary, ids array<long>, queries array<long>")
    # equal vectors are equal in the order, so they meet in one range
    dealt = stored(stored(placed).repartitionByRange("leaf", "vector").sortWithinPartitions("leaf", "vector").mapInArrow(_block_batches(most), _BLOCK))
    blocks = dealt.where("block is not null").drop("queries")
    queries = dealt.where("block is null").select("vectors", "queries")
    asked = queries.orderBy(F.xxhash64("vectors"), F.col("queries")[0]).limit(CALIBRATION_ROWS).select("vectors").collect()
    x = np.array([np.frombuffer(r.vectors, kind) for r in asked], np.float64)
    answers = []
    if len(x) and tree.leaves > 1:
        exact = blocks.mapInArrow(_exact_batches(kind, x, most), "query long, score double, leaf long")
        top = exact.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))).where(F.col("r") <= most).toPandas()
        answers = [top.leaf[top["query"] == q].to_numpy() for q in range(len(x))]
    visits, recall = calibrated(tree, x, answers, target)
    filled = [0] * tree.leaves  # one number per leaf
    for r in blocks.groupBy("leaf").agg(F.sum(F.octet_length("ids") / 8).alias("n")).collect():
        filled[r.leaf] = int(r.n)
    return Index(tree, blocks, queries, kind, filled, visits, recall)


def search(index: Index, neighbours: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for each query of the index."""
    most = neighbours + 1
    visiting = index.queries.mapInArrow(_visit_batches(index.tree, index.kind, index.visits, index.leaf_rows, most),
                                        "best long, vector binary, queries array<long>, visits array<long>")
    # queries that begin at one leaf share most of their way, so they make a group
    groups = stored(visiting.repartitionByRange("best", "vector").sortWithinPartitions("best", "vector").select("vector", "queries", "visits")
                    .mapInArrow(_group_batches, _GROUP))
    columns = ["group", "leaf", "n", "vectors", "ids", "counts", "visits", "visit_counts"]
    ask = groups.withColumn("leaf", F.lit(None).cast("long")).select(*columns)
    meet = groups.select("group", F.explode("leaves").alias("leaf")).join(index.blocks, "leaf").withColumns(
        {c: F.lit(None).cast("binary") for c in ("visits", "visit_counts")}).select(*columns)
    dealt = ask.unionByName(meet).repartition("group").sortWithinPartitions("group", F.asc_nulls_first("leaf"))
    packed = dealt.mapInArrow(_answer_batches(index.kind, most), "asker long, found array<struct<vec_id: long, score: double>>")
    # a row of queries holds at most ID_LIST ids of one vector; they share the answers but for themselves
    lists = index.queries.select(F.col("queries")[0].alias("asker"), "queries")
    each = lists.join(packed, "asker").select(F.explode("queries").alias("query_id"), "found")
    own = each.select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, neighbours).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def nearest(vectors: DataFrame, neighbours: int = NEIGHBOURS, query_step: int = QUERY_STEP, sample_rows: int = SAMPLE_ROWS,
            leaf_rows: int = LEAF_ROWS, target: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors(vec_id, embedding, ..) whose vec_id is divisible by `query_step`.

    Candidates are all rows but the query's own; nearness is the inner product in double precision,
    largest first, ties to the smaller vec_id.  All candidates are returned where there are fewer
    than `neighbours`.  The score is computed on the original vectors.

    Null, empty and zero vectors, vectors with null or non-finite components or of another length
    than the most frequent one, and null vec_ids take no part, as a query or as a candidate.  A
    vec_id on several rows counts once, with the smallest of its vectors.  Copies of a vector are
    searched together.  No rows, and a single row, give no rows.  Other columns are ignored.
    """
    return search(build_index(vectors, neighbours, query_step, sample_rows, leaf_rows, target), neighbours)
