"""Extrapolation diagnostics: exDet, MOP, Shape, AOA and their consensus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import neighbours, shares
from .session import cut
from .stats import covariance, trimmed_max

#: Reference rows that go to every task whole; larger references are cut into blocks of about so many.
REFERENCE_ROWS = 20_000
#: From so many coordinates on a tree prunes next to nothing: all pairs of blocks are multiplied instead.
WIDE = 16
#: Distances that a task holds at once.
HELD = 2_000_000


def nt1(target: DataFrame, reference: DataFrame, columns: list[str]) -> DataFrame:
    """``target`` with ``nt1`` (under 0: outside a training range) and ``nt1_most``, its predictor of the largest deviation."""
    ends = reference.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    d = target.crossJoin(F.broadcast(ends))  # one row
    u = [F.least(F.col(c) - F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(c), F.lit(0.0)) / F.greatest(F.col(f"{c}_hi") - F.col(f"{c}_lo"), F.lit(1e-12)) for c in columns]
    names = F.array(*[F.lit(c) for c in columns])
    most = F.element_at(names, F.array_position(F.array(*u), F.array_min(F.array(*u))).cast("int"))
    return d.withColumns({"nt1": sum(u, F.lit(0.0)), "nt1_most": most}).drop(*ends.columns)


def _squared(columns: list[str], mean: list[float], inverse: np.ndarray) -> Column:
    x = [F.col(c) - float(m) for c, m in zip(columns, mean, strict=True)]
    return sum((x[i] * x[j] * float(inverse[i, j]) for i in range(len(x)) for j in range(len(x))), F.lit(0.0))


def nt2(target: DataFrame, reference: DataFrame, columns: list[str]) -> DataFrame:
    """``target`` with ``nt2`` (over 1: a new combination) and ``nt2_most``, the predictor whose removal lowers it most."""
    mean, cov, _ = covariance(reference, columns)
    c = np.array(cov)
    full = _squared(columns, mean, np.linalg.pinv(c))
    top = reference.agg(F.max(full)).first()[0] or float("nan")
    gains = []
    for j in range(len(columns)):
        rest = [i for i in range(len(columns)) if i != j]
        gains.append(full - (_squared([columns[i] for i in rest], [mean[i] for i in rest], np.linalg.pinv(c[np.ix_(rest, rest)])) if rest else F.lit(0.0)))
    names = F.array(*[F.lit(n) for n in columns])
    return target.withColumns({"nt2": full / float(top), "nt2_most": F.element_at(names, F.array_position(F.array(*gains), F.array_max(F.array(*gains))).cast("int"))})


def _vector(column: str | list[str]) -> Column:
    return F.transform(F.col(column), lambda x: x.cast("double")) if isinstance(column, str) else F.array(*[F.col(c).cast("double") for c in column])


def _nearest(x: np.ndarray, m: np.ndarray, k: int, fx: np.ndarray | None, fm: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distances from each row of ``x`` to its ``k`` nearest rows of ``m`` in other folds (infinite where there are fewer), and which rows these are."""
    square, n, out, which = (m**2).sum(axis=1), min(k, len(m)), [], []
    step = max(1, min(512, HELD // len(m)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        d = part @ m.T
        d *= -2
        d += square  # the row's own square changes no order
        if fx is not None:
            d[fx[at : at + step, None] == fm] = np.inf
        near = d.argmin(axis=1)[:, None] if n == 1 else np.argpartition(d, n - 1, axis=1)[:, :n]
        exact = np.sqrt(((part[:, None, :] - m[near]) ** 2).sum(axis=2))
        exact[np.isinf(np.take_along_axis(d, near, axis=1))] = np.inf
        out.append(exact)
        which.append(near)
    return (np.concatenate(out), np.concatenate(which)) if out else (np.empty((0, n)), np.empty((0, n), np.int64))


def _in_blocks(target: DataFrame, reference: DataFrame, n: int, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` of each block of targets with each block of the ``n`` references, both dealt by a hash of their rows."""
    blocks = -(-n // REFERENCE_ROWS)
    parts = max(1, -(-target.count() // (2 * REFERENCE_ROWS)))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = lambda m: F.pmod(F.xxhash64("v", "_nth"), F.lit(m)).cast("int")
    # equal vectors are spread by a number of their own, kept so that a repeated task deals them alike
    t = target.withColumn("_nth", F.xxhash64("id")).withColumn("_t", own(parts)).withColumn("_r", every(blocks))
    r = cut(reference.withColumn("_nth", F.monotonically_increasing_id())).withColumn("_r", own(blocks)).withColumn("_t", every(parts))
    # by number, so that blocks of few bytes and much work are not put into one task
    dealt = lambda d: d.repartition(min(2 * blocks * parts, 2000), "_t", "_r").groupBy("_t", "_r")
    return dealt(t).cogroup(dealt(r)).applyInPandas(fn, schema)


def nearest_distance(target: DataFrame, reference: DataFrame, id_col: str, vector: str | list[str], fold: str | None = None, k: int = 1) -> DataFrame:
    """``id, distance``: mean Euclidean distance to the ``k`` nearest reference rows; with ``fold``, to those of other folds.

    A counted reference of at most REFERENCE_ROWS rows goes to every task once
    and targets stream past it; a larger one is searched by a metric tree or boxes
    (see ``neighbours`` and ``shares``). The mean is over those there are, if fewer than ``k``; null
    if there is none. Ids tell targets apart.
    """
    spark, kind = target.sparkSession, target.schema[id_col].dataType.simpleString()
    folds = F.col(fold).cast("long") if fold else F.lit(0).cast("long")
    ref = reference.select(_vector(vector).alias("v"), folds.alias("f"))
    given = target.select(F.col(id_col).alias("id"), _vector(vector).alias("v"), folds.alias("f"))
    n = ref.count()
    if not n:
        return target.select(id_col, F.lit(None).cast("double").alias("distance"))
    if n > REFERENCE_ROWS:
        return _of_distinct(given, ref, n, k, bool(fold)).withColumnRenamed("id", id_col)
    rows = ref.toPandas()  # at most REFERENCE_ROWS
    sent = spark.sparkContext.broadcast((np.array(rows["v"].tolist()), rows["f"].to_numpy() if fold else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, fm = sent.value
        for b in batches:
            x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(len(b), -1)
            d, _ = _nearest(x, m, k, b.column(2).to_numpy() if fold else None, fm)
            found = np.isfinite(d)
            count = found.sum(axis=1)
            mean = np.where(found, d, 0.0).sum(axis=1) / np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mean, mask=count == 0)], [id_col, "distance"])

    return given.mapInArrow(run, f"{id_col} {kind}, distance double")


def _by_blocks(asked: DataFrame, counted: DataFrame, n: int, k: int, folded: bool) -> DataFrame:
    """``id, distance`` of all targets by all blocks of references: quadratic, in tasks of bounded size."""

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": np.empty(0, np.int64), "d": np.empty(0), "n": np.empty(0, np.int64)})
        d, near = _nearest(np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()), k, a["f"].to_numpy() if folded else None, b["f"].to_numpy())
        i, j = np.nonzero(np.isfinite(d))
        return pd.DataFrame({"id": a["id"].to_numpy()[i], "d": d[i, j], "n": b["n"].to_numpy()[near[i, j]]})

    found = neighbours._first(_in_blocks(asked, counted, n, tile, "id long, d double, n long"), k)
    means = found.groupBy("id").agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("distance"))
    return asked.select("id").join(means, "id", "left")


def _of_distinct(given: DataFrame, ref: DataFrame, n: int, k: int, folded: bool) -> DataFrame:
    """``id, distance`` by a metric tree or boxes (few coordinates) or all blocks (many) over the distinct of ``n`` references, each with the number of its rows; equal targets are searched once."""
    given = cut(given)
    asked = given.select("v", "f").distinct().select(F.monotonically_increasing_id().alias("id"), "v", "f")
    width = ref.select(F.size("v")).first()[0]
    if neighbours.by_boxes(k, folded, width):
        names = [f"x{c}" for c in range(width)]
        flat = ref.select(*[F.col("v")[c].alias(name) for c, name in enumerate(names)])
        for name in names:
            flat = flat.where(F.abs(name) < float("inf"))  # others have no distance
        sample = flat.sample(min(1.0, shares.SAMPLE / n), 0).toPandas().to_numpy()  # about SAMPLE rows
        sample = sample if len(sample) else flat.limit(shares.SAMPLE).toPandas().to_numpy()
        if not len(sample):
            return given.select("id", F.lit(None).cast("double").alias("distance"))
        distinct = flat.agg(F.approx_count_distinct(F.xxhash64(*names))).first()[0]
        # few copies are merged within their blocks, at the price of one shuffle less
        counted = flat.groupBy(*names).agg(F.count("*").alias("n")) if distinct <= n / 2 else flat.withColumn("n", F.lit(1).cast("long"))
        search = neighbours.Search(asked, counted, distinct, k, folded, sample)
        asked, found = search.target, search.run()
    else:
        counted = cut(ref.groupBy("v", "f").agg(F.count("*").alias("n")))
        n = counted.count()
        if k <= neighbours.FEW and width >= WIDE:
            asked = cut(asked)
            found = _by_blocks(asked, counted, n, k, folded)
        else:
            search = neighbours.Search(asked, counted, n, k, folded)
            asked, found = search.target, search.run()
    told = asked.select(F.col("id").alias("_nth"), "v", "f").join(found.select(F.col("id").alias("_nth"), "distance"), "_nth").select(F.col("v").alias("_v"), F.col("f").alias("_f"), "distance")
    return given.join(told, F.col("v").eqNullSafe(F.col("_v")) & F.col("f").eqNullSafe(F.col("_f")), "left").select("id", "distance")


def mean_pair_distance(df: DataFrame, vector: str) -> float:
    """Mean Euclidean distance of all pairs of rows, from the sums of pairs of blocks."""
    rows = df.select(F.monotonically_increasing_id().alias("id"), _vector(vector).alias("v"))
    rows = cut(rows)
    n = rows.count()
    if n < 2:
        return float("nan")

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        total = 0.0
        if len(a) and len(b):
            x, m = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
            for at in range(0, len(x), 512):
                part = x[at : at + 512]
                total += float(np.sqrt(np.maximum((part**2).sum(axis=1)[:, None] - 2 * part @ m.T + (m**2).sum(axis=1), 0)).sum())
        return pd.DataFrame({"total": [total]})

    return float(_in_blocks(rows, rows.select("v"), n, block, "total double").agg(F.sum("total")).first()[0]) / (n * (n - 1.0))


def _threshold(reference: DataFrame, vector: str, fold: str, k: int, divide: float) -> float:
    """Trimmed largest distance of training rows to those of other folds; rows of a single fold leave out themselves instead."""
    if reference.select(fold).distinct().limit(2).count() < 2:
        # the row itself is its nearest, at distance 0: of k + 1 it adds nothing to the sum
        found = F.least(F.lit(k), F.lit(reference.count() - 1))
        d = nearest_distance(reference, reference, "_id", vector, None, k + 1).withColumn("x", F.try_divide(F.col("distance") * (found + 1), found) / divide)
    else:
        d = nearest_distance(reference, reference, "_id", vector, fold, k).withColumn("x", F.col("distance") / divide)
    out = trimmed_max(d, "x").first()[0]
    return float("inf") if out is None else out


def distances(target: DataFrame, reference: DataFrame, columns: list[str], fold: str, weights: dict[str, float] | None = None, percentage: float = 1.0) -> DataFrame:
    """``target`` with ``mop``, ``shape`` and ``aoa`` and whether each is over its cross-fold training threshold."""
    mean, cov, n = covariance(reference, columns)
    c = np.array(cov)
    std = np.sqrt(np.where(np.diag(c) > 0, np.diag(c), 1.0))
    values, vectors = np.linalg.eigh(c)
    ok = values > max(float(values.max()), 0.0) * 1e-10
    whiten = vectors[:, ok] / np.sqrt(values[ok])
    w = np.array([(weights or {}).get(col, 1.0) for col in columns])
    w = w / (w.max() or 1.0)
    z = [(F.col(col) - float(m)) / float(s) for col, m, s in zip(columns, mean, std, strict=True)]
    spaces = {
        "mop": F.array(*z), "aoa": F.array(*[a * float(b) for a, b in zip(z, w, strict=True)]),
        "shape": F.array(*[sum((F.col(col) * float(whiten[i, j]) for i, col in enumerate(columns)), F.lit(0.0)) for j in range(whiten.shape[1])]),
    }
    ref = cut(reference).select(F.monotonically_increasing_id().alias("_id"), fold, *[e.alias(f"_{k}") for k, e in spaces.items()], *columns)
    base = ref.agg(F.avg(F.sqrt(_squared(columns, mean, np.linalg.pinv(c))))).first()[0] or float("nan")
    mean_pair = mean_pair_distance(ref, "_aoa") or float("nan")
    k = {"mop": max(1, round(n * percentage / 100)), "shape": 1, "aoa": 1}
    unit = {"mop": 1.0, "shape": base / 100.0, "aoa": mean_pair}
    out = target.withColumn("_id", F.struct("row", "col"))
    for name, e in spaces.items():
        cut_off = _threshold(ref, f"_{name}", fold, k[name], unit[name])
        d = nearest_distance(out.select(F.col("_id"), e.alias("_v")).select((F.col("_id.row") * 100000 + F.col("_id.col")).cast("long").alias("_key"), "_v"), ref.select(F.col(f"_{name}").alias("_v")), "_key", "_v", k=k[name])
        d = d.select("_key", (F.col("distance") / unit[name]).alias(name), (F.col("distance") / unit[name] > float(cut_off)).alias(f"{name}_out"))
        out = out.withColumn("_key", (F.col("row") * 100000 + F.col("col")).cast("long")).join(d, "_key").drop("_key")
    return out.drop("_id")


def consensus(flags: list[Column]) -> Column:
    """How many diagnostics flag a cell (nulls do not)."""
    return sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0))
