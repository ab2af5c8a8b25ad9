"""Exact nearest distances in feature space over references of any size, by a metric tree.

References are put into the leaves of a tree of pivots. Of every leaf the exact
counts and the smallest and largest distance from its pivot are known, so the
triangle inequality bounds the distance of a target to all rows of a leaf from
both sides without reading one. A target meets only leaves that can hold one of
its nearest:

* few neighbours: first the leaves that surely hold enough of them, which gives
  the true distance of the last one; then those that may hold a nearer one;
* many (a share of all references): in few coordinates and without folds by boxes
  (see ``shares``). Otherwise a leaf returns counts and sums over bins of the shell
  in which the last distance lies. The bin that holds it is the next, thinner
  shell, until what is in it is few enough to be listed. Leaves within the shell's
  inner side are settled and not read again.

No list of a target's neighbours longer than FEW is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shares
from .session import cut

#: Rows of the bounded sample that pivots are taken from, and leaves at most (times folds: LEAF_FOLDS).
SAMPLE = 20_000
LEAVES = 2_048
LEAF_FOLDS = 400_000
#: Rows a leaf should hold.
LEAF_ROWS = 1_000
#: Neighbours that are listed; more are counted in bins.
FEW = 128
BINS = 64
#: Largest tile: references and targets.
TILE_ROWS = 20_000
TILE_TARGETS = 4_000


def pivots(x: np.ndarray, leaves: int) -> np.ndarray:
    """Up to ``leaves`` rows of ``x``, each the farthest from those before it (so that leaves are as round as the data allow)."""
    first = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    chosen, gap = [first], ((x - x[first]) ** 2).sum(axis=1)
    while len(chosen) < min(leaves, len(x)):
        nxt = int(gap.argmax())
        if gap[nxt] <= 0:
            break
        chosen.append(nxt)
        gap = np.minimum(gap, ((x - x[nxt]) ** 2).sum(axis=1))
    return x[chosen]


def _distances(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows, each summed over the coordinates in one order."""
    out = np.zeros((len(x), len(m)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - m[:, j]) ** 2
    return np.sqrt(out)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.array(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(col), -1)


class Tree:
    """Pivots and, for each leaf, its counts (also by fold) and the distances it spans; small enough to be sent to every task."""

    def __init__(self, centres: np.ndarray, leaf: np.ndarray, fold: np.ndarray, n: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        self.centres, size = centres, len(centres)
        self.total, self.near, self.far = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
        np.add.at(self.total, leaf, n)
        np.minimum.at(self.near, leaf, near)
        np.maximum.at(self.far, leaf, far)
        self.folds, at = np.unique(fold, return_inverse=True)
        self.by_fold = np.zeros((len(self.folds), size), np.int64)
        np.add.at(self.by_fold, (at, leaf), n)

    def leaf_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = [(d.argmin(axis=1), d.min(axis=1)) for at in range(0, len(x), 512) for d in [_distances(x[at : at + 512], self.centres)]]
        return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (np.empty(0, np.int64), np.empty(0))

    def bounds(self, x: np.ndarray, f: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row and leaf: rows of other folds, and the least and largest distance of any of them (with room for rounding)."""
        d = _distances(x, self.centres)
        n = np.broadcast_to(self.total, d.shape)
        if f is not None and len(self.folds):
            at = np.minimum(np.searchsorted(self.folds, f), len(self.folds) - 1)
            n = n - np.where((self.folds[at] == f)[:, None], self.by_fold[at], 0)
        slack = 1e-9 * (d + self.far)
        return n, np.maximum(np.maximum(d - self.far, self.near - d) - slack, 0.0), d + self.far + slack


def enough(n: np.ndarray, high: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the leaves, by their largest distance, that together hold ``k``, and that distance (infinite if all hold fewer)."""
    order = np.argsort(high, axis=1, kind="stable")
    held = np.take_along_axis(n, order, axis=1).cumsum(axis=1)
    last = (held < k[:, None]).sum(axis=1)
    first = np.zeros(n.shape, bool)
    np.put_along_axis(first, order, np.arange(n.shape[1]) <= last[:, None], axis=1)
    short = last >= n.shape[1]
    reach = np.take_along_axis(high, np.take_along_axis(order, np.minimum(last, n.shape[1] - 1)[:, None], axis=1), axis=1)[:, 0]
    return first & (n > 0), np.where(short, np.inf, reach)


def plant(reference: DataFrame, n: int, folds: int) -> tuple[Tree, DataFrame]:
    """The tree over ``reference(v, f, n)``, ``n`` copies each, and its rows with their ``leaf``."""
    spark = reference.sparkSession
    sample = np.array(reference.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toPandas()["v"].tolist(), dtype=np.float64)  # at most SAMPLE rows
    centres = pivots(sample, max(1, min(LEAVES, LEAF_FOLDS // max(1, folds), -(-n // LEAF_ROWS))))
    bare = spark.sparkContext.broadcast(Tree(centres, *(np.empty(0, t) for t in (np.int64, np.int64, np.int64, float, float))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, d = bare.value.leaf_of(_matrix(b.column(0)) if len(b) else np.empty((0, centres.shape[1])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(leaf.astype(np.int32)), pa.array(d)], ["v", "f", "n", "leaf", "d"])

    placed = cut(reference.select("v", "f", "n").mapInArrow(place, "v array<double>, f long, n long, leaf int, d double"))
    # a row for each leaf and fold: at most LEAF_FOLDS
    rows = placed.groupBy("leaf", "f").agg(F.sum("n").alias("n"), F.min("d").alias("near"), F.max("d").alias("far")).toPandas()
    return Tree(centres, *(rows[c].to_numpy() for c in ("leaf", "f", "n", "near", "far"))), placed.select("v", "f", "n", "leaf")


def _tiles(visits: DataFrame, placed: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(references, targets)`` over tiles of each leaf's references and the targets that visit it, both sides cut to bounded size."""
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("rows"))
    asked = visits.groupBy("leaf").agg(F.ceil(F.count("*") / TILE_TARGETS).cast("int").alias("asks"))
    parts = F.broadcast(sizes.join(asked, "leaf"))  # a row for each leaf
    # equal vectors are spread by a number of their own
    left = placed.withColumn("_nth", F.monotonically_increasing_id()).join(parts, "leaf")
    left = left.select("leaf", F.pmod(F.xxhash64("_nth"), F.col("rows")).cast("int").alias("r"), to("asks").alias("t"), "v", "f", "n")
    right = visits.join(parts, "leaf").select("leaf", to("rows").alias("r"), F.pmod(F.xxhash64("id"), F.col("asks")).cast("int").alias("t"), *[c for c in visits.columns if c != "leaf"])
    return left.groupBy("leaf", "r", "t").cogroup(right.groupBy("leaf", "r", "t")).applyInPandas(fn, schema)


def _shell(a: pd.DataFrame, b: pd.DataFrame, folded: bool) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Slices of the targets with their distances to all references, infinite outside of their shell or within their fold."""
    m, f = np.stack(a["v"].to_numpy()), a["f"].to_numpy()
    for at in range(0, len(b), 256):  # bounded memory
        part = b.iloc[at : at + 256]
        d = _distances(np.stack(part["v"].to_numpy()), m)
        out = (d < part["lo"].to_numpy()[:, None]) | (d > part["hi"].to_numpy()[:, None])
        if folded:
            out |= part["f"].to_numpy()[:, None] == f
        d[out] = np.inf
        yield part, d


def _listed(visits: DataFrame, placed: DataFrame, kind: str, k: int, folded: bool) -> DataFrame:
    """``id, d, n``: the ``k`` nearest references within each target's shell, from each tile, and how many copies each is."""

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids, ds, ns = [], [], []
        copies = a["n"].to_numpy()
        for part, d in _shell(a, b, folded) if len(a) and len(b) else ():
            at = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
            few = np.take_along_axis(d, at, axis=1)
            i, j = np.nonzero(np.isfinite(few))
            ids += part["id"].to_numpy()[i].tolist()
            ds += few[i, j].tolist()
            ns += copies[at[i, j]].tolist()
        return pd.DataFrame({"id": pd.Series(ids, dtype=b["id"].dtype if len(b) else "object"), "d": np.array(ds, dtype=float), "n": np.array(ns, dtype=np.int64)})

    return _tiles(visits, placed, tile, f"id {kind}, d double, n long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The nearest of each target that together are ``k``, copies counted, the last with as many as are still wanted (``n``); Spark limits each task's groups before it shuffles."""
    w = Window.partitionBy("id").orderBy("d")
    few = found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("upto", upto).withColumn("n", F.least("n", F.col("n") + k - F.col("upto"))).where("n > 0").drop("upto")


def finite(df: DataFrame) -> DataFrame:
    """The rows whose vector ``v`` has a distance to others."""
    return df.where(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))


def by_boxes(k: int, folded: bool, width: int) -> bool:
    """Whether ``k`` neighbours are a share that ``shares`` finds."""
    return k > FEW and not folded and width <= shares.COORDINATES


class Search:
    """The mean distance of targets to their ``k`` nearest references; a reference is ``n`` rows (1 without that column); ``visited`` counts the leaf visits of each pass, against ``pairs`` of targets and leaves.

    With ``sample``, some of the references, a share is found by boxes; ``reference`` is then ``x0, x1, ..., n``, and is read once.
    """

    def __init__(self, target: DataFrame, reference: DataFrame, n: int, k: int, folded: bool, sample: np.ndarray | None = None) -> None:
        if "n" not in reference.columns:
            reference = reference.withColumn("n", F.lit(1).cast("long"))
        self.shares = None
        if sample is not None:
            self.placed, self.target = reference, cut(target)
            self.shares = shares.Shares(shares.blocks(reference, sample, n), sample.shape[1], k)
            self.targets = self.target.count()
            self.visited, self.pairs = self.shares.visited, self.targets * len(self.shares.map.block)
            return
        folds = reference.select("f").distinct().count() if folded else 1
        self.tree, self.placed = plant(reference, n, folds)
        self.target, self.k, self.folded = cut(target), k, folded
        self.kind = target.schema["id"].dataType.simpleString()
        self.sent = target.sparkSession.sparkContext.broadcast(self.tree)
        self.pairs = self.target.count() * len(self.tree.centres)
        self.visited: list[int] = []

    def _visits(self, state: DataFrame, choose) -> DataFrame:
        """``state(id, v, f, lo, hi, ...)`` for each leaf that ``choose(n, low, high, lo, hi)`` names; it may change ``hi``."""
        sent, folded, names = self.sent, self.folded, state.columns
        at = {c: names.index(c) for c in ("v", "f", "lo", "hi")}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in (b.slice(i, 512) for i in range(0, len(b), 512)):
                    x, f = _matrix(part.column(at["v"])), part.column(at["f"]).to_numpy(zero_copy_only=False) if folded else None
                    n, low, high = sent.value.bounds(x, f)
                    wanted, reach = choose(n, low, high, part.column(at["lo"]).to_numpy(), part.column(at["hi"]).to_numpy())
                    i, leaf = np.nonzero(wanted)
                    rows = pa.RecordBatch.from_arrays([pa.array(reach) if k == at["hi"] else part.column(k) for k in range(len(names))], names).take(pa.array(i))
                    yield rows.append_column("leaf", pa.array(leaf.astype(np.int32)))

        schema = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in names) + ", leaf int"
        out = cut(state.mapInArrow(run, schema))
        self.visited.append(out.count())
        return out

    def run(self) -> DataFrame:
        """``id, distance``; null where no reference is of another fold."""
        if self.shares:
            return self.target.select("id").join(self.shares.run(finite(self.target), self.targets), "id", "left")
        start = self.target.select("id", "v", "f", F.lit(-1.0).alias("lo"), F.lit(float("inf")).alias("hi"))
        found = self._few(start) if self.k <= FEW else self._many(start)
        return self.target.select("id").join(found, "id", "left").select("id", "distance")

    def _few(self, start: DataFrame) -> DataFrame:
        k, folded = self.k, self.folded

        def nearest_leaves(n, low, high, lo, hi):
            return enough(n, high, np.full(len(n), k))[0], hi

        def others(n, low, high, lo, hi):
            return (n > 0) & (low <= hi[:, None]) & ~enough(n, high, np.full(len(n), k))[0], hi

        first = cut(_first(_listed(self._visits(start, nearest_leaves), self.placed, self.kind, k, folded), k).select("id", "d", "n"))
        reach = first.groupBy("id").agg(F.max("d").alias("hi"), F.sum("n").alias("n")).where(F.col("n") == k).select("id", "hi")
        rest = _listed(self._visits(start.drop("hi").join(reach, "id"), others), self.placed, self.kind, k, folded)
        return _first(first.unionAll(rest), k).groupBy("id").agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("distance"))

    def _many(self, start: DataFrame) -> DataFrame:
        k, folded, bins = self.k, self.folded, BINS

        def within(n, low, high, lo, hi):
            # the first shell ends where enough references surely lie
            reach = np.where(np.isinf(hi), enough(n, high, np.minimum(k, n.sum(axis=1)))[1], hi)
            return (n > 0) & (low <= reach[:, None]) & (high >= lo[:, None]), reach

        def counted(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out, copies = [], a["n"].to_numpy()
            for part, d in _shell(a, b, folded) if len(a) and len(b) else ():
                lo, hi = np.maximum(part["lo"].to_numpy(), 0.0)[:, None], part["hi"].to_numpy()[:, None]
                i, j = np.nonzero(np.isfinite(d))
                own, many = d[i, j], copies[j]
                edges = np.clip(np.ceil((own - lo[i, 0]) / np.maximum(hi[i, 0] - lo[i, 0], 1e-300) * bins).astype(np.int64) - 1, 0, bins - 1)
                at = i * bins + edges
                c, s = np.rint(np.bincount(at, many, minlength=len(part) * bins)).astype(np.int64), np.bincount(at, own * many, minlength=len(part) * bins)
                least = np.full(len(part) * bins, np.inf)
                most = np.full(len(part) * bins, -np.inf)
                np.minimum.at(least, at, own)
                np.maximum.at(most, at, own)
                some = np.flatnonzero(c)
                out.append(pd.DataFrame({"id": part["id"].to_numpy()[some // bins], "bin": (some % bins).astype(np.int32), "n": c[some], "s": s[some], "least": least[some], "most": most[some]}))
            return pd.concat(out) if out else pd.DataFrame({"id": b["id"].iloc[:0], "bin": [], "n": [], "s": [], "least": [], "most": []})

        state = start.withColumns({"need": F.lit(k).cast("long"), "total": F.lit(0.0), "taken": F.lit(0).cast("long")})
        done = None
        while True:
            visits = self._visits(state, within)
            per = _tiles(visits, self.placed, counted, f"id {self.kind}, bin int, n long, s double, least double, most double")
            per = per.groupBy("id", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("least").alias("least"), F.max("most").alias("most"))
            order = Window.partitionBy("id").orderBy("bin")  # at most BINS rows each
            per = per.withColumns({"upto": F.sum("n").over(order), "sum_upto": F.sum("s").over(order)}).join(state.select("id", "need", "total", "taken"), "id")
            whole = F.col("upto") <= F.col("need")
            # bins that are taken whole, and the one in which the last neighbour lies
            told = per.groupBy("id").agg(
                F.first("need").alias("need"), F.first("total").alias("total"), F.first("taken").alias("taken"),
                F.coalesce(F.max(F.when(whole, F.col("upto"))), F.lit(0)).alias("inner"), F.coalesce(F.max(F.when(whole, F.col("sum_upto"))), F.lit(0.0)).alias("inner_sum"),
                F.min(F.when(~whole, F.struct("bin", "n", "least", "most"))).alias("edge"),
            )
            told = told.withColumns({"need": F.col("need") - F.col("inner"), "taken": F.col("taken") + F.col("inner"), "total": F.col("total") + F.col("inner_sum")})
            told = cut(told)
            # nothing is left to find (also: fewer references than wanted), or all that is left is equally far
            flat = F.col("edge").isNull() | (F.col("need") == 0) | (F.col("edge.least") == F.col("edge.most"))
            tied = F.when(F.col("edge").isNotNull() & (F.col("need") > 0), F.col("need")).otherwise(0)
            end = told.where(flat).select("id", ((F.col("total") + tied * F.coalesce("edge.least", F.lit(0.0))) / (F.col("taken") + tied)).alias("distance"))
            done = end if done is None else done.unionAll(end)
            left = told.where(~flat).select("id", F.col("edge.least").alias("lo"), F.col("edge.most").alias("hi"), "need", "total", "taken", F.col("edge.n").alias("n"))
            state = cut(self.target.join(left, "id").select("id", "v", "f", "lo", "hi", "need", "total", "taken", "n"))
            thick = state.where(F.col("n") > FEW).count()
            few = state.where(F.col("n") <= FEW).drop("n")
            if not few.isEmpty():
                listed = _first(_listed(self._visits(few, within), self.placed, self.kind, FEW, folded), FEW).join(few.select("id", "need", "total", "taken"), "id")
                before = F.coalesce(F.sum("n").over(Window.partitionBy("id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                listed = listed.withColumn("n", F.least(F.col("n"), F.col("need") - before)).where("n > 0")
                end = listed.groupBy("id").agg(((F.first("total") + F.sum(F.col("d") * F.col("n"))) / (F.first("taken") + F.sum("n"))).alias("distance"))
                done = done.unionAll(end)
            if not thick:
                return done
            state = state.where(F.col("n") > FEW).drop("n")
