"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

Inner product search becomes distance search by one more coordinate,
``sqrt(M^2 - |x|^2)``, with M the largest norm of all vectors. The tree is fitted
on a bounded sample; every vector is then put into its leaf. A query walks the
tree best bin first: a priority queue holds the nodes seen so far by their
distance, the nearest is opened next, and leaves are visited until the number
calibrated for the wanted recall is reached: that with which some sampled queries
find their exact neighbours in the whole table. Leaves are cut into tiles of bounded
size on both sides, and each tile is one block of exact scores. What the sample's
vectors in a query's visited leaves score bounds its k-th score from below, so a
tile returns only rows that can still be among the nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

NEIGHBOURS = 20
EVERY = 20
#: Vectors that the tree is fitted on at most, chosen by a hash.
SAMPLE = 20_000
BRANCH = 8
#: Vectors of the whole table a leaf should hold, as far as the sample allows.
LEAF_ROWS = 500
LEAST_SAMPLE_PER_LEAF = 8
#: Recall that calibration asks for, and the number of sampled queries that are compared with the whole table for it.
RECALL = 0.94
CALIBRATION_QUERIES = 200
#: Largest tile: vectors and queries.
TILE_VECTORS = 20_000
TILE_QUERIES = 4_000


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v, d1, d2``: finite nonzero vectors with an id, and a digest of them; repeated rows once."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    return v.withColumns({"d1": F.xxhash64("v"), "d2": F.xxhash64(F.lit(1), "v")}).dropDuplicates(["vec_id", "d1", "d2"])


def build_tree(x: np.ndarray, leaf: int, branch: int = BRANCH, seed: int = 7) -> dict[str, np.ndarray]:
    """Hierarchical k-means: ``centre`` of each node, its ``first`` child and number of children, and ``leaf`` number (-1: inner)."""
    rng = np.random.default_rng(seed)
    centre, first, kids, leaves = [x.mean(axis=0)], [0], [0], [-1]
    todo = [(0, np.arange(len(x)))]
    n_leaves = 0
    while todo:
        node, rows = todo.pop(0)
        groups = _kmeans(x, rows, branch, rng) if len(rows) > leaf else []
        if len(groups) < 2:
            leaves[node] = n_leaves
            n_leaves += 1
            continue
        first[node], kids[node] = len(centre), len(groups)
        for g in groups:
            todo.append((len(centre), g))
            centre.append(x[g].mean(axis=0))
            first.append(0)
            kids.append(0)
            leaves.append(-1)
    return {"centre": np.array(centre), "first": np.array(first), "kids": np.array(kids), "leaf": np.array(leaves)}


def _kmeans(x: np.ndarray, rows: np.ndarray, branch: int, rng: np.random.Generator, rounds: int = 8) -> list[np.ndarray]:
    c = x[rng.choice(rows, min(branch, len(rows)), replace=False)]
    own = np.zeros(len(rows), np.int64)
    for _ in range(rounds):
        own = ((c**2).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
        c = np.array([x[rows[own == k]].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
    return [rows[own == k] for k in range(len(c)) if (own == k).any()]


def leaf_of(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf that each row of ``x`` falls into, going to the nearest child at each level."""
    node = np.zeros(len(x), np.int64)
    while (inner := np.flatnonzero(tree["leaf"][node] < 0)).size:
        for n in np.unique(node[inner]):
            at = inner[node[inner] == n]
            kids = np.arange(tree["first"][n], tree["first"][n] + tree["kids"][n])
            c = tree["centre"][kids]
            node[at] = kids[((c**2).sum(axis=1) - 2 * x[at] @ c.T).argmin(axis=1)]
    return tree["leaf"][node]


def leaves_by_distance(tree: dict[str, np.ndarray], q: np.ndarray, visits: int) -> list[int]:
    """The first ``visits`` leaves of a best-bin-first walk for one query."""
    heap, out = [(0.0, 0)], []
    while heap and len(out) < visits:
        _, n = heapq.heappop(heap)
        if tree["leaf"][n] >= 0:
            out.append(int(tree["leaf"][n]))
            continue
        kids = range(tree["first"][n], tree["first"][n] + tree["kids"][n])
        c = tree["centre"][kids.start : kids.stop]
        for d, k in zip(((c**2).sum(axis=1) - 2 * c @ q).tolist(), kids, strict=True):
            heapq.heappush(heap, (d, k))
    return out


def visits_for(tree: dict[str, np.ndarray], queries: np.ndarray, near: list[np.ndarray], recall: float) -> int:
    """Leaf visits after which ``queries`` have found ``recall`` of their exact neighbours, given the leaves these lie in."""
    n_leaves = int(tree["leaf"].max()) + 1
    found, n = np.zeros(n_leaves), 0
    for q, leaves in zip(queries, near, strict=True):
        if len(leaves):
            order = np.empty(n_leaves, np.int64)
            order[leaves_by_distance(tree, np.append(q, 0.0), n_leaves)] = np.arange(n_leaves)
            found += np.bincount(order[leaves], minlength=n_leaves) / len(leaves)
            n += 1
    return min(n_leaves, int(np.searchsorted(found.cumsum() / max(n, 1), recall - 1e-12) + 1)) if n else n_leaves


def exact_leaves(placed: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """For each of a few queries the leaves of its exact ``k`` nearest in the whole table, of which every task returns its own ``k``."""
    sent = placed.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = sent.value
        best = np.full((len(ids), k), -np.inf)
        leaf = np.full((len(ids), k), -1, np.int32)
        for b in batches:
            if len(b):
                s = queries @ _matrix(b.column(1)).T
                s[ids[:, None] == b.column(0).to_numpy()] = -np.inf
                s, at = np.append(best, s, axis=1), np.append(leaf, np.broadcast_to(b.column(2).to_numpy(), s.shape), axis=1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best, leaf = np.take_along_axis(s, top, axis=1), np.take_along_axis(at, top, axis=1)
        i, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(best[i, j]), pa.array(leaf[i, j])], ["q", "score", "leaf"])

    found = placed.select("vec_id", "v", "leaf").mapInArrow(run, "q int, score double, leaf int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))
    rows = found.withColumn("r", rank).where(F.col("r") <= k).groupBy("q").agg(F.collect_list("leaf").alias("leaves")).collect()  # a row for each query
    by_q = {r["q"]: np.array(r["leaves"]) for r in rows}
    return [by_q.get(i, np.empty(0, np.int64)) for i in range(len(ids))]


def widened(v: np.ndarray, most: float) -> np.ndarray:
    return np.append(v, np.sqrt(np.maximum(0, most - (v**2).sum(axis=1)))[:, None], axis=1)


def _matrix(col: pa.Array) -> np.ndarray:
    """The vectors of a list column, float64."""
    return np.array(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(col), -1)


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows whose id is divisible by ``every``, the ``k`` nearest found among all other ids.

    The score is the inner product of the original vectors in double precision;
    ties go to the smaller vec_id. Rows with a null id, and vectors that are null,
    zero or hold null or non-finite components take no part, nor do vectors
    whose length is not the most common one. Repeated rows count once; if an id
    has several vectors its best score counts. No rows give no rows. Extra
    columns are not read.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = usable(vectors, id_col, vector_col)
    sizes = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most"))
    top = sizes.orderBy(F.desc("n"), "dim").first()
    if top is None:
        return empty
    dim, n, most = top["dim"], top["n"], top["most"]
    v = v.where(F.size("v") == dim)
    # copies of a vector tie, so beyond the k + 1 smallest ids none can be among the k nearest; Spark limits each task's groups before it shuffles
    small = Window.partitionBy("d1", "d2").orderBy("vec_id")
    base = materialize(v.withColumn("nth", F.row_number().over(small)).where(F.col("nth") <= k + 1).select("vec_id", "v", "d1", "nth"), "ann-base")
    # a walk is much work for few bytes: as many tasks as the session shuffles to
    queries = v.where(F.col("vec_id") % every == 0).select("vec_id", "v").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")

    sample = base.where("nth = 1").orderBy("d1", "vec_id").limit(SAMPLE).select("vec_id", "v").toPandas()
    x = widened(np.array(sample["v"].tolist(), dtype=np.float64), most)
    leaf_rows = max(LEAST_SAMPLE_PER_LEAF, int(LEAF_ROWS * min(1.0, len(x) / n)))
    tree = build_tree(x, leaf_rows)
    planted = spark.sparkContext.broadcast(tree)  # a few nodes for each of its leaves

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = leaf_of(planted.value, widened(_matrix(b.column(1)), most)) if len(b) else np.empty(0, np.int64)
            yield b.append_column("leaf", pa.array(leaf.astype(np.int32)))

    placed = materialize(base.select("vec_id", "v").mapInArrow(to_leaf, "vec_id long, v array<double>, leaf int"), "ann-leaves")
    # the visits that the whole table needs: sampled neighbours lie farther off than its own, so the sample would ask for more
    picked = np.unique(np.linspace(0, len(x) - 1, min(len(x), CALIBRATION_QUERIES)).astype(int))
    ids, known_vectors = sample["vec_id"].to_numpy(), x[:, :-1]
    visits = visits_for(tree, known_vectors[picked], exact_leaves(placed, ids[picked], known_vectors[picked], k), recall)
    # at most SAMPLE vectors and their tree
    sent = spark.sparkContext.broadcast((tree, visits, ids, known_vectors, leaf_of(tree, x)))

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, visits, ids, known, at = sent.value
        for b in batches:
            m = _matrix(b.column(1)) if len(b) else np.empty((0, dim))
            walks, floors = [], []
            for own, q in zip(b.column(0).to_numpy(), m, strict=True):
                walks.append(leaves_by_distance(tree, np.append(q, 0.0), visits))
                s = (known @ q)[np.isin(at, walks[-1]) & (ids != own)]
                floors.append(float(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else -np.inf)
            yield b.append_column("leaves", pa.array(walks, pa.list_(pa.int32()))).append_column("least", pa.array(floors, pa.float64()))

    asked = materialize(queries.mapInArrow(to_leaves, "vec_id long, v array<double>, leaves array<int>, least double"), "ann-queries")
    per_leaf = placed.groupBy("leaf").agg(F.ceil(F.count("*") / TILE_VECTORS).cast("int").alias("vparts"))
    per_query = asked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / TILE_QUERIES).cast("int").alias("qparts"))
    tiles = F.broadcast(per_leaf.join(per_query, "leaf"))  # a row for each leaf: at most SAMPLE / LEAST_SAMPLE_PER_LEAF times BRANCH
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tile = lambda own, n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int").alias(own)
    left = placed.join(tiles, "leaf").select("leaf", tile("vt", "vparts"), to("qparts").alias("qt"), "vec_id", "v")
    right = asked.select("vec_id", "v", "least", F.explode("leaves").alias("leaf")).join(tiles, "leaf").select("leaf", to("vparts").alias("vt"), tile("qt", "qparts"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "least")

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        ids, m = a["vec_id"].to_numpy(), np.stack(a["v"].to_numpy()).astype(np.float64)
        qids, qm, least = b["query_id"].to_numpy(), np.stack(b["q"].to_numpy()).astype(np.float64), b["least"].to_numpy()
        out = []
        for at in range(0, len(qids), 128):
            s = qm[at : at + 128] @ m.T
            s[qids[at : at + 128, None] == ids] = -np.inf
            floor = np.partition(s, max(0, len(ids) - k - 1), axis=1)[:, max(0, len(ids) - k - 1)] if len(ids) > k else np.full(len(s), -np.inf)
            floor = np.maximum(floor, least[at : at + 128])
            qi, vi = np.nonzero((s >= np.where(np.isfinite(floor), floor - 1e-9 * np.maximum(1, np.abs(floor)), -np.inf)[:, None]) & (s > -np.inf))
            exact = (qm[at + qi] * m[vi]).sum(axis=1)  # summed in one order everywhere, so that copies tie
            order = np.lexsort((ids[vi], -exact, qi))
            qi, vi, exact = qi[order], vi[order], exact[order]
            starts = np.searchsorted(qi, np.arange(len(s)))
            keep = np.arange(len(qi)) - starts[qi] < k
            out.append(pd.DataFrame({"query_id": qids[at + qi[keep]], "vec_id": ids[vi[keep]], "score": exact[keep]}))
        return pd.concat(out)

    found = left.groupBy("leaf", "vt", "qt").cogroup(right.groupBy("leaf", "vt", "qt")).applyInPandas(block, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
