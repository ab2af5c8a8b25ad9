"""Mean distance of targets to their nearest share of all references, in few coordinates.

A share grows with the references, so even one look at each of them is as much
as targets times references. Here no reference is looked at that a box around it
decides:

* references are dealt into blocks, one row each, and lie in a block in the order
  of a balanced tree, so that any part of it is a slice with a box around it;
* a box that lies between two edges adds its count; the distances to a box far
  enough off are those to NODES points for each coordinate, weighted so that every
  polynomial of that order is summed exactly (an error below rounding, see APART);
* only what an edge cuts, and what lies next to the target, is looked at.

The edges of a target close in on its last neighbour: first around a guess from
the counted parts of the blocks, then around the place that its rank has between
them. What lies between the last two is listed, so the count is exact, however
wrong a guess is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut

#: Coordinates that a tree of boxes is used for.
COORDINATES = 3
#: Distinct references that a block and a leaf of its tree should hold, and blocks at most.
BLOCK_ROWS = 524_288
LEAF_ROWS = 32
BLOCKS = 4_096
#: Rows that a task deals at a time.
DEALT = 500_000
#: Rows of the sample that the blocks' sides are taken from.
SAMPLE = 40_000
#: Points that stand for a box, for each coordinate, if it is APART times its half diagonal away or more.
NODES = 14
APART = 3.0
#: Counted parts that the first guess is made from, all blocks together, and at least of each block.
PARTS = 16_384
PARTS_LEAST = 32
#: Between two looks a target's neighbours are counted in BINS; so few distinct ones are listed.
BINS = 7
FEW = 128
#: So many are, if no more than LISTED are listed in all.
MOST = 32_768
LISTED = 10_000_000
#: Distances that differ in their last bits only count as one: so many of the smallest steps.
TIED = 64
#: Targets that a task makes first guesses for, and visits that it gets for one block.
TASK_TARGETS = 500
TILE_VISITS = 4_000
#: Numbers that a step holds at once, and in its innermost part, where they should stay in a core's cache.
HELD = 1_000_000
CACHED = 32_768

_POINTS = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
_WEIGHTS = np.cos(np.arange(NODES)[:, None] * np.arccos(_POINTS)) * np.where(np.arange(NODES) == 0, 1.0, 2.0)[:, None] / NODES


def _basis(z: np.ndarray) -> np.ndarray:
    """The polynomials that are 1 at one of the points and 0 at the others, at ``z`` within -1 to 1."""
    t = np.empty((NODES, *z.shape))
    t[0], t[1] = 1.0, z
    for i in range(2, NODES):
        t[i] = 2.0 * z * t[i - 1] - t[i - 2]
    return np.moveaxis(t, 0, -1) @ _WEIGHTS


def _length(parts: list[np.ndarray]) -> np.ndarray:
    """Euclidean length, always summed in one order, so that it grows with each part."""
    out = parts[0] * parts[0]
    for p in parts[1:]:
        out += p * p
    return np.sqrt(out, out=out)


def plant(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Columns ``x`` and their numbers ``n`` in the order of a balanced tree, and its levels; filled up with columns of the number 0."""
    levels = max(0, math.ceil(math.log2(len(n) / LEAF_ROWS)))
    fill = (-(-len(n) >> levels) << levels) - len(n)
    x, n = np.concatenate([x, np.repeat(x[:, :1], fill, axis=1)], axis=1), np.concatenate([n, np.zeros(fill, np.int64)])
    for level in range(levels):
        parts = x.reshape(len(x), 1 << level, -1)
        widest = (parts.max(axis=2) - parts.min(axis=2)).argmax(axis=0)
        key = parts[widest, np.arange(1 << level)]
        order = (np.argpartition(key, key.shape[1] // 2, axis=1) + key.shape[1] * np.arange(1 << level)[:, None]).ravel()
        x, n = x.take(order, axis=1), n[order]
    return x, n, levels


class Tree:
    """Boxes over planted rows: of part ``j`` of ``level`` the sides, the rows and how many distinct ones these are."""

    def __init__(self, x: np.ndarray, n: np.ndarray, levels: int) -> None:
        self.x, self.n, self.levels, self.width = x, n, levels, len(x)
        self.weight = n.astype(float)
        leaves = x.reshape(self.width, 1 << levels, -1)
        self.lo, self.hi = [leaves.min(axis=2).T], [leaves.max(axis=2).T]
        self.rows, self.kinds = [n.reshape(1 << levels, -1).sum(axis=1)], [(n > 0).reshape(1 << levels, -1).sum(axis=1)]
        for _ in range(levels):
            self.lo.insert(0, np.minimum(self.lo[0][0::2], self.lo[0][1::2]))
            self.hi.insert(0, np.maximum(self.hi[0][0::2], self.hi[0][1::2]))
            self.rows.insert(0, self.rows[0][0::2] + self.rows[0][1::2])
            self.kinds.insert(0, self.kinds[0][0::2] + self.kinds[0][1::2])
        # points stand for parts that hold at least twice as many rows
        self.pointed = next((k for k in range(levels + 1) if len(n) >> k < 2 * NODES**self.width), levels + 1)
        self._stand: dict[int, np.ndarray] = {}

    def _middles(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The middle and half the width of each part."""
        return (self.lo[level] + self.hi[level]) / 2, (self.hi[level] - self.lo[level]) / 2

    def stand(self, level: int) -> np.ndarray:
        """The weights of the points of each part: of the finest level from the rows, of the others from the points of their halves."""
        if level in self._stand:
            return self._stand[level]
        mid, half = self._middles(level)
        unit = np.where(half > 0, half, 1.0)  # on a flat side all is in the middle
        if level < self.pointed - 1:
            out, (own_mid, own_half) = self.stand(level + 1), self._middles(level + 1)
            up = np.arange(len(out)) // 2
            for c in range(self.width):
                z = (own_mid[:, c, None] + own_half[:, c, None] * _POINTS - mid[up, c, None]) / unit[up, c, None]
                # the coordinate in front is summed and goes to the end
                out = np.swapaxes(out.reshape(len(up), NODES, -1), 1, 2) @ _basis(np.clip(z, -1.0, 1.0))
            out = out.reshape(1 << level, 2, -1).sum(axis=1)
        else:
            size, x = len(self.n) >> level, self.x.reshape(self.width, 1 << level, -1)
            out, step = np.empty((1 << level, NODES**self.width)), max(1, HELD // (size * NODES ** max(1, self.width - 1)))
            for at in range(0, 1 << level, step):
                part = slice(at, min(at + step, 1 << level))
                b = [_basis(np.clip((x[c, part] - mid[part, c, None]) / unit[part, c, None], -1.0, 1.0)) for c in range(self.width)]
                left = self.weight.reshape(1 << level, size, 1)[part]
                for own in b[:-1]:
                    left = (left[:, :, :, None] * own[:, :, None, :]).reshape(len(left), size, -1)
                out[part] = (np.swapaxes(left, 1, 2) @ b[-1]).reshape(len(left), -1)
        self._stand[level] = out
        return out

    def _far(self, t: np.ndarray, level: int, j: np.ndarray) -> np.ndarray:
        """Sum of the distances of each ``t`` to the rows of part ``j``, by the points that stand for them."""
        weights, (mid, half), out, step = self.stand(level), self._middles(level), np.empty(len(j)), max(1, CACHED // NODES**self.width)
        for at in range(0, len(j), step):
            part, x = j[at : at + step], t[at : at + step]
            d = np.zeros((len(part), 1))
            for c in range(self.width):
                own = (x[:, c, None] - mid[part, c, None] - half[part, c, None] * _POINTS) ** 2
                d = (d[:, :, None] + own[:, None, :]).reshape(len(part), -1)
            out[at : at + step] = np.einsum("ij,ij->i", np.sqrt(d, out=d), weights.take(part, axis=0))
        return out

    def _near(self, t: np.ndarray, level: int, j: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Slices of the pairs with the distances to all rows of their parts, and the rows' numbers."""
        size = len(self.n) >> level
        x, n = self.x.reshape(self.width, 1 << level, size), self.weight.reshape(1 << level, size)
        step = max(1, CACHED // size)
        for at in range(0, len(j), step):
            part = j[at : at + step]
            yield slice(at, at + len(part)), _length([t[at : at + step, c, None] - x[c].take(part, axis=0) for c in range(self.width)]), n.take(part, axis=0)

    def walk(self, t: np.ndarray, edges: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Parts that together hold all rows between the first and the last of a target's ``edges``: ``how, level, target, part, bin``.

        ``far``: in one bin and far off; ``whole``: in one bin; ``cut``: a leaf that an edge may cut.
        """
        q, j = np.arange(len(t)), np.zeros(len(t), np.int64)
        for level in range(self.levels + 1):
            lo, hi, x, e = self.lo[level][j], self.hi[level][j], t[q], edges[q]
            low = _length([np.maximum(np.maximum(lo[:, c] - x[:, c], x[:, c] - hi[:, c]), 0.0) for c in range(self.width)])
            high = _length([np.maximum(np.abs(x[:, c] - lo[:, c]), np.abs(x[:, c] - hi[:, c])) for c in range(self.width)])
            first, last = (e < low[:, None]).sum(axis=1), (e < high[:, None]).sum(axis=1)
            open_, one = (last > 0) & (first < e.shape[1]), first == last
            if level < self.pointed:
                mid, half = (lo + hi) / 2, (hi - lo) / 2
                off = ((x - mid) ** 2).sum(axis=1) >= APART**2 * (half**2).sum(axis=1)
                done = open_ & one & off
                if done.any():
                    yield "far", level, q[done], j[done], first[done] - 1
            else:
                done = open_ & one
                if done.any():
                    yield "whole", level, q[done], j[done], first[done] - 1
            rest = open_ & ~done
            if level == self.levels:
                if rest.any():
                    yield "cut", level, q[rest], j[rest], first[rest] - 1
                return
            q, j = np.repeat(q[rest], 2), (2 * j[rest][:, None] + np.arange(2)).ravel()
            if not len(q):
                return

    def count(self, t: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each target and bin, over its first edge up to its last: distinct rows, rows, and the sum of their distances."""
        bins = edges.shape[1] - 1
        size = len(t) * bins
        kinds, rows, sums = np.zeros(size), np.zeros(size), np.zeros(size)

        def add(at: np.ndarray, k: np.ndarray, r: np.ndarray, s: np.ndarray) -> None:
            if len(at):
                first = int(at.min())
                for out, own in ((kinds, k), (rows, r), (sums, s)):
                    found = np.bincount(at - first, own)
                    out[first : first + len(found)] += found

        for how, level, q, j, b in self.walk(t, edges):
            if how == "cut":
                for own, d, n in self._near(t[q], level, j):
                    at = np.zeros(d.shape, np.int8)
                    for c in range(bins + 1):
                        at += (d > edges[q[own], c, None]).view(np.int8)
                    i, k = np.nonzero((at > 0) & (at <= bins) & (n > 0))
                    d, n = d[i, k], n[i, k]
                    add(q[own][i] * bins + at[i, k] - 1, np.ones(len(i)), n, d * n)
                continue
            s = self._far(t[q], level, j) if how == "far" else np.concatenate([np.einsum("ij,ij->i", d, n) for _, d, n in self._near(t[q], level, j)])
            add(q * bins + b, self.kinds[level][j], self.rows[level][j], s)
        return np.rint(kinds).astype(np.int64).reshape(-1, bins), np.rint(rows).astype(np.int64).reshape(-1, bins), sums.reshape(-1, bins)

    def listed(self, t: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows over the first edge of a target up to its last: ``target, distance, number``."""
        out = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        for _, level, q, j, _ in self.walk(t, edges):
            for own, d, n in self._near(t[q], level, j):
                i, k = np.nonzero((d > edges[q[own], :1]) & (d <= edges[q[own], -1:]) & (n > 0))
                out.append((q[own][i], d[i, k], n[i, k].astype(np.int64)))
        return tuple(np.concatenate(o) for o in zip(*out, strict=True))


class Sides:
    """The halvings of a sample that deal rows into blocks."""

    def __init__(self, sample: np.ndarray, blocks: int) -> None:
        self.levels = max(0, round(math.log2(blocks)))
        self.axis, self.at = np.zeros((1 << self.levels) - 1, np.int64), np.full((1 << self.levels) - 1, np.inf)
        parts = [sample]
        for node in range(len(self.axis)):
            own = parts[node]
            if len(own) and (own.max(axis=0) > own.min(axis=0)).any():
                self.axis[node] = (own.max(axis=0) - own.min(axis=0)).argmax()
                x = own[:, self.axis[node]]
                self.at[node] = np.sort(x)[(len(x) - 1) // 2]
                if self.at[node] == x.max():  # so that no side is empty
                    self.at[node] = x[x < x.max()].max()
            right = own[:, self.axis[node]] > self.at[node]
            parts += [own[~right], own[right]]

    def block(self, x: np.ndarray) -> np.ndarray:
        node, each = np.zeros(x.shape[1], np.int64), np.arange(x.shape[1])
        for _ in range(self.levels):
            node = 2 * node + 1 + (x[self.axis[node], each] > self.at[node])
        return node - len(self.axis)


def _list(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _rows(col: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(col), width)


def _merged(x: np.ndarray, n: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns in the order of their blocks, equal ones as one with the sum of their numbers."""
    order = np.lexsort((*x, block))
    x, n, block = x.take(order, axis=1), n[order], block[order]
    new = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (x[:, 1:] != x[:, :-1]).any(axis=0)))
    return x.take(new, axis=1), np.add.reduceat(n, new), block[new]


def blocks(reference: DataFrame, sample: np.ndarray, n: int) -> DataFrame:
    """``reference(x0, x1, ..., n)``, about ``n`` distinct finite rows, as one row for each block: ``block, x, n, levels``, its tree, and ``parts``, the sides, middles and rows of a part of PARTS."""
    width = sample.shape[1]
    sides = Sides(sample, max(1, min(BLOCKS, -(-n // BLOCK_ROWS))))
    sent = reference.sparkSession.sparkContext.broadcast(sides)

    def dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = np.stack([np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(width)])
        x, number, block = _merged(x, np.concatenate([b.column(width).to_numpy() for b in held]), sent.value.block(x))
        at = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
        ends = list(zip(at[:-1], at[1:], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(block[at[:-1]].astype(np.int32)), pa.array([x[:, i:j].tobytes() for i, j in ends]), pa.array([number[i:j].tobytes() for i, j in ends])], ["block", "x", "n"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if len(b):
                held.append(b)
                size += len(b)
            if size >= DEALT:
                yield dealt(held)
                held, size = [], 0
        if held:
            yield dealt(held)

    def pack(a: pa.Table) -> pa.Table:
        x = np.concatenate([np.frombuffer(v).reshape(width, -1) for v in a.column("x").to_pylist()], axis=1)
        x, n, _ = _merged(x, np.concatenate([np.frombuffer(v, np.int64) for v in a.column("n").to_pylist()]), np.zeros(x.shape[1], np.int8))
        x, n, levels = plant(x, n)
        tree = Tree(x, n, levels)
        level = min(levels, split)
        rows = tree.rows[level]
        mid = np.stack([(tree.x[c] * n).reshape(1 << level, -1).sum(axis=1) / np.maximum(rows, 1) for c in range(width)], axis=1)
        parts = np.column_stack([tree.lo[level], tree.hi[level], mid, rows])
        return pa.table({"block": a.column("block")[:1], "x": [x.tobytes()], "n": [n.astype(np.int64).tobytes()], "levels": pa.array([levels], pa.int32()), "parts": [parts.tobytes()]})

    split = max(PARTS_LEAST, PARTS >> sides.levels).bit_length() - 1
    names = [f"x{c}" for c in range(width)]
    chunks = reference.select(*names, F.col("n").cast("long")).mapInArrow(deal, "block int, x binary, n binary")
    # by number, so that blocks of few bytes and much work are not put into one task
    chunks = chunks.repartition(max(8, min(2000, 2 << sides.levels)), "block")
    return cut(chunks.groupBy("block").applyInArrow(pack, "block int, x binary, n binary, levels int, parts binary"))


class Map:
    """Where the blocks lie, and the counted parts of each; small enough to be sent to every task."""

    def __init__(self, rows: pd.DataFrame, width: int) -> None:
        self.block, self.width = rows["block"].to_numpy(), width
        parts = [np.frombuffer(p).reshape(-1, 3 * width + 1) for p in rows["parts"]]
        self.lo, self.hi = np.stack([p[:, :width].min(axis=0) for p in parts]), np.stack([p[:, width : 2 * width].max(axis=0) for p in parts])
        self.rows = np.array([p[:, -1].sum() for p in parts])
        size = max(len(p) for p in parts)
        # blocks of fewer parts are filled up with parts of no rows
        self.parts = np.stack([np.concatenate([p, np.repeat(np.append(p[0, :-1], 0.0)[None], size - len(p), axis=0)]) for p in parts])

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest distance of each of ``x`` to any row of each block."""
        low = _length([np.maximum(np.maximum(self.lo[:, c] - x[:, c, None], x[:, c, None] - self.hi[:, c]), 0.0) for c in range(self.width)])
        return low, _length([np.maximum(np.abs(x[:, c, None] - self.lo[:, c]), np.abs(x[:, c, None] - self.hi[:, c])) for c in range(self.width)])

    def guess(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First edges of each of ``x``, around the distance of its ``k``-th neighbour, and a distance that this surely does not exceed."""
        low, high = self.bounds(x)

        def reached(d: np.ndarray) -> np.ndarray:
            order = np.argsort(d, axis=1)
            last = (np.take_along_axis(np.broadcast_to(self.rows, d.shape), order, axis=1).cumsum(axis=1) < k).sum(axis=1)
            return np.take_along_axis(d, np.take_along_axis(order, np.minimum(last, d.shape[1] - 1)[:, None], axis=1), axis=1)[:, 0]

        least, most = reached(low), reached(high)
        edges = np.empty((len(x), BINS + 1))
        for i in range(len(x)):
            inside = high[i] <= least[i]
            own = self.parts[~inside & (low[i] <= most[i])].reshape(-1, 3 * self.width + 1)
            away = own[:, 2 * self.width : 3 * self.width] - x[i]
            d = np.sqrt((away**2).sum(axis=1))
            order = np.argsort(d)
            n, held = own[:, -1], self.rows[inside].sum()
            at = np.interp(k, held + n[order].cumsum() - n[order] / 2, d[order])
            # of a part that this cuts, the share within a distance grows evenly
            deep = np.sqrt(((own[:, self.width : 2 * self.width] - own[:, : self.width]) ** 2 * away**2).sum(axis=1)) / 2 / np.maximum(d, 1e-300)
            cut_ = np.abs(d - at) <= 2.0 * deep + 0.02 * at
            held, d, n, deep = held + n[~cut_ & (d < at)].sum(), d[cut_], n[cut_], np.maximum(deep[cut_], 1e-9 * at + 1e-300)
            ends, slopes = np.concatenate([d - deep, d + deep]), np.concatenate([n, -n]) / np.tile(2 * deep, 2)
            order = np.argsort(ends)
            ends, slopes = ends[order], slopes[order].cumsum()
            upto = np.maximum.accumulate(held + np.concatenate([[0.0], (slopes[:-1] * np.diff(ends)).cumsum()]))
            at = np.interp(k, upto, ends)
            sigma = max(0.08 * math.sqrt((n[np.abs(d - at) <= deep] ** 2).sum()), 0.5 * math.sqrt(k))
            edges[i] = np.interp(k + sigma * np.array([0, -5, -2.5, -1, 1, 2.5, 5, 5]), upto, ends)
        edges[:, 0] = -1.0
        return np.maximum.accumulate(np.minimum(edges, most[:, None]), axis=1), most


def _next(lo: np.ndarray, hi: np.ndarray, rows: np.ndarray, need: np.ndarray, mean: np.ndarray, even: np.ndarray) -> np.ndarray:
    """Edges from ``lo`` to ``hi``: close around the place of rank ``need`` of the ``rows`` between them, or ``even`` ones and two close around their ``mean``, where all are if they are equally far."""
    share = need / np.maximum(rows, 1)
    off = 2.0 / np.sqrt(np.maximum(rows, 1))  # four deviations of a rank among evenly spread rows, at most
    close = lo[:, None] + (hi - lo)[:, None] * (share[:, None] + off[:, None] * np.array([-9, -1, -0.6, -0.2, 0.2, 0.6, 1, 9]))
    wide = lo[:, None] + (hi - lo)[:, None] * np.array([0, 0.25, 0.5, 0.75, 0.125, 0.875, 1, 1])
    known = np.isfinite(mean)
    wide[known, 4:6] = mean[known, None] + TIED / 4 * np.spacing(mean[known, None]) * np.array([-1, 1])
    out = np.sort(np.clip(np.where(even[:, None], wide, close), lo[:, None], hi[:, None]), axis=1)
    out[:, 0], out[:, -1] = lo, hi
    return out


class Shares:
    """Mean distances to the ``k`` nearest of the references in ``packed`` blocks."""

    def __init__(self, packed: DataFrame, width: int, k: int) -> None:
        sc = packed.sparkSession.sparkContext
        self.packed, self.width = packed, width
        self.map = Map(packed.select("block", "parts").toPandas(), width)  # at most BLOCKS rows, give or take the sides' rounding
        self.k = min(k, int(self.map.rows.sum()))
        self.sent = sc.broadcast(self.map)
        self.visited: list[int] = []

    def _tiles(self, state: DataFrame, fn, schema: str) -> DataFrame:
        """``fn(tree, targets, edges)`` over each block and the targets with an edge in it; ids come before what it returns."""
        sent, width, step = self.sent, self.width, max(1, HELD // (4 * len(self.map.block)))
        kind = state.schema["id"].dataType.simpleString()

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in (b.slice(at, step) for at in range(0, len(b), step)):
                    edges = _rows(part.column(2), -1)
                    low, high = sent.value.bounds(_rows(part.column(1), width))
                    i, j = np.nonzero((low <= edges[:, -1:]) & (high > edges[:, :1]))
                    yield part.take(pa.array(i)).append_column("block", pa.array(sent.value.block[j], pa.int32()))

        asked = cut(state.select("id", "v", "edges").mapInArrow(visits, f"id {kind}, v array<double>, edges array<double>, block int"))
        sizes = asked.groupBy("block").agg(F.count("*").alias("visits")).withColumn("tiles", F.ceil(F.col("visits") / TILE_VISITS).cast("int"))
        sums = sizes.agg(F.sum("visits"), F.sum("tiles")).first()
        self.visited.append(sums[0] or 0)
        sizes = F.broadcast(sizes)  # a row for each block
        names = [c.strip().split(" ")[0] for c in schema.split(",")]

        def tile(a: pa.Table, b: pa.Table) -> pa.Table:
            found = []
            if len(a) and len(b):
                n = np.frombuffer(a.column("n")[0].as_py(), np.int64)
                tree = Tree(np.frombuffer(a.column("x")[0].as_py()).reshape(width, len(n)), n, a.column("levels")[0].as_py())
                for part in (b.slice(at, 2048) for at in range(0, len(b), 2048)):
                    who, cols = fn(tree, _rows(part.column("v"), width), _rows(part.column("edges"), -1))
                    found.append(pa.table([part.column("id").take(pa.array(who)), *[pa.array(c) for c in cols]], ["id", *names]))
            return pa.concat_tables(found) if found else pa.table([b.column("id").slice(0, 0), *[pa.array([], pa.int64() if f" {n} long" in f" {schema}" else pa.float64()) for n in names]], ["id", *names])

        left = self.packed.join(sizes, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"), "x", "n", "levels")
        right = asked.join(sizes, "block").select("block", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("t"), "id", "v", "edges")
        parts = max(1, min(2000, 2 * (sums[1] or 0)))
        # by number, so that blocks of few bytes and much work are not put into one task
        dealt = lambda d: d.repartition(parts, "block", "t").groupBy("block", "t")
        return dealt(left).cogroup(dealt(right)).applyInArrow(tile, f"id {kind}, {schema}")

    def run(self, target: DataFrame, n: int) -> DataFrame:
        """``id, distance`` of each of ``n`` rows ``target(id, v)``, whose coordinates are finite."""
        sent, width, k, step = self.sent, self.width, self.k, max(1, HELD // (4 * len(self.map.block)))
        kind = target.schema["id"].dataType.simpleString()
        counts = [f"{c}{b}" for c in ("kinds", "rows", "sums") for b in range(BINS)]
        fields = f"id {kind}, v array<double>, edges array<double>, most double, need long, total double, size long"

        def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in (b.slice(at, step) for at in range(0, len(b), step)):
                    edges, most = sent.value.guess(_rows(part.column(1), width), k)
                    whole = [np.full(len(part), k, np.int64), np.zeros(len(part)), np.full(len(part), 2**62, np.int64)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _list(edges), pa.array(most), *map(pa.array, whole)], ["id", "v", "edges", "most", "need", "total", "size"])

        def counted(tree: Tree, t: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
            kinds, rows, sums = tree.count(t, edges)
            who = np.flatnonzero(kinds.any(axis=1))
            return who, [*kinds[who].T, *rows[who].T, *sums[who].T]

        def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                edges, most, need, total, size = _rows(b.column(2), BINS + 1), *(b.column(c).to_numpy() for c in range(3, 7))
                kinds, rows, sums = (np.stack([b.column(7 + g * BINS + c).to_numpy() for c in range(BINS)], axis=1) for g in range(3))
                upto, each = rows.cumsum(axis=1), np.arange(len(b))
                at = (upto < need[:, None]).sum(axis=1)  # the bin of the last neighbour
                over = at == BINS  # it lies beyond the last edge
                own = np.minimum(at, BINS - 1)
                before = np.where(np.arange(BINS) < at[:, None], sums, 0.0).sum(axis=1)
                need = need - np.where(at > 0, upto[each, np.maximum(at, 1) - 1], 0)
                total = total + before
                lo, hi = np.where(over, edges[:, -1], edges[each, own]), np.where(over, most, edges[each, own + 1])
                k_, n_, s_ = (np.where(over, 2**62, kinds[each, own]), np.where(over, 2**62, rows[each, own]), np.where(over, 0.0, sums[each, own]))
                # all of the bin is taken, or all of it is equally far
                tied = ~over & ((k_ == 1) | (hi - lo <= TIED * np.spacing(hi)))
                done = tied | (n_ == need)
                total = np.where(done, total + s_ * np.where(n_ == need, 1.0, need / np.maximum(n_, 1)), total)
                follow = _next(np.maximum(lo, 0.0), hi, n_, need, np.where(over, np.nan, s_ / np.maximum(n_, 1)), over | (lo < 0) | (k_ > size // 4))
                follow[:, 0] = lo
                few = ~done & (k_ <= FEW)
                follow[few, 1:] = hi[few, None]
                how = np.where(done, 0, np.where(few, 1, 2)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _list(follow), *map(pa.array, (hi, need, total, k_, how))], ["id", "v", "edges", "most", "need", "total", "size", "how"])

        state, ended = cut(target.select("id", "v").repartition(max(1, min(2000, n // TASK_TARGETS))).mapInArrow(begin, fields)), []
        while True:
            per = self._tiles(state, counted, ", ".join(f"{c} {'double' if c.startswith('sums') else 'long'}" for c in counts))
            per = per.groupBy("id").agg(*[F.sum(c).alias(c) for c in counts])
            joined = state.join(per, "id", "left").select(*state.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
            state = cut(joined.mapInArrow(advance, f"{fields}, how int"))
            left, short = F.col("how") == 2, (F.col("how") == 2) & (F.col("size") <= MOST)
            sizes = state.agg(F.sum(F.when(short, F.col("size"))).alias("listed"), F.count(F.when(left, 1)).alias("left")).first()
            if (sizes["listed"] or 0) <= LISTED:
                left = left & ~short
            ended.append(state.where(~left))
            state = state.where(left).drop("how")
            if not sizes["left"] or state.isEmpty():
                break
        end = ended[0]
        for e in ended[1:]:
            end = end.unionAll(e)

        def within(tree: Tree, t: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
            who, d, n = tree.listed(t, edges)
            return who, [d, n]

        few = end.where("how > 0").select("id", "v", "edges", "need")
        listed = self._tiles(few, within, "d double, n long").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "n"))).alias("near"))  # at most MOST each
        none = F.struct(F.col("need").alias("need"), F.lit(0.0).alias("sum"))
        took = lambda a, x: F.least(a["need"], x["n"])
        last = F.aggregate("near", none, lambda a, x: F.struct((a["need"] - took(a, x)).alias("need"), (a["sum"] + took(a, x) * x["d"]).alias("sum")))["sum"]
        return end.select("id", "need", "total").join(listed, "id", "left").select("id", ((F.col("total") + F.coalesce(last, F.lit(0.0))) / k).alias("distance"))
