"""Sampling, thinning and outlier operators with explicit, seeded orders."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florascope.functions.geo import EARTH_KM, hav_km

from .order import bucketed, quantiles, running
from .session import cut
from .spatial import XY
from .stats import covariance


def seeded(id_: Column, seed: int) -> Column:
    """A digest that orders ids in a way of the seed's own; the same in any partitioning, and in any SQL engine that has MD5."""
    return F.md5(F.concat(id_.cast("string"), F.lit(f":{seed}")).cast("binary"))


def uniform(id_: Column, seed: int) -> Column:
    """A number in (0, 1) for an id and a seed: 52 bits of their digest."""
    return (F.conv(F.substring(seeded(id_, seed), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def quota(df: DataFrame, strata: list[str], id_col: str, n: int, seed: int) -> DataFrame:
    """``ceil(n * share)`` rows of each stratum in seeded order."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_c"))
    total = sizes.agg(F.sum("_c").alias("_t"))
    sizes = sizes.crossJoin(F.broadcast(total)).select(*[F.col(s).alias(f"_{s}") for s in strata], F.ceil(n * (F.col("_c") / F.col("_t"))).alias("_take"))
    nth = F.row_number().over(Window.partitionBy(*strata).orderBy(seeded(F.col(id_col), seed), id_col))
    on = None
    for s in strata:
        e = F.col(s).eqNullSafe(F.col(f"_{s}"))
        on = e if on is None else on & e
    # a stratum gives at most n rows, so Spark can limit each task's group before it shuffles
    ranked = df.withColumn("_nth", nth).where(F.col("_nth") <= n)
    return ranked.join(sizes, on).where(F.col("_nth") <= F.col("_take")).select(*df.columns)


def weighted_without_replacement(df: DataFrame, id_col: str, weight: str, n: int, seed: int) -> DataFrame:
    """``n`` rows by exponential keys: the smallest ``-ln(u) / w``."""
    return df.where(F.col(weight) > 0).orderBy(-F.ln(uniform(F.col(id_col), seed)) / F.col(weight), id_col).limit(n)


def weighted_with_replacement(df: DataFrame, id_col: str, weight: str, n: int, seed: int) -> DataFrame:
    """``n`` draws in proportion to the weights, numbered by ``draw``; ids are numbers, each once.

    In the order of their ids rows divide the total weight into intervals, and a
    draw takes the row in whose interval (start, end] its seeded number falls.
    Rows and draws are merged by place: range buckets, and in each one pass that
    carries the last row on, so the work is rows plus draws. Rounding loses no
    draw: one past the last end takes the last row.
    """
    rows = df.where(F.col(weight) > 0)
    placed = cut(running(rows, id_col, {"_start": F.col(weight)}))
    total = placed.agg(F.sum(weight).alias("_all"))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(F.col("id"), seed).alias("_u")).crossJoin(F.broadcast(total))  # one row
    # a row begins just behind its start: at equal places draws come first
    merged = placed.select(F.col("_start").cast("double").alias("_at"), F.lit(1).alias("_kind"), F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.lit(None).cast("long").alias("draw"))
    merged = merged.unionAll(draws.select((F.col("_u") * F.col("_all")).cast("double"), F.lit(0), F.lit(None).cast(merged.schema["_row"].dataType), "draw"))
    bucket = bucketed(cut(merged), "_at")
    order = [F.col("_at"), F.col("_kind"), F.col(f"_row.{id_col}")]
    # the last row of each bucket goes on to the next: a row for each bucket
    ends = bucket.where("_kind = 1").groupBy("_bucket").agg(F.max_by("_row", F.struct("_at", f"_row.{id_col}")).alias("_end"))
    ends = bucket.select("_bucket").distinct().join(ends, "_bucket", "left")
    before = ends.select("_bucket", F.last("_end", ignorenulls=True).over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    within = F.last("_row", ignorenulls=True).over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = bucket.withColumn("_hit", within).where("_kind = 0").join(F.broadcast(before), "_bucket")
    return hit.select("draw", F.coalesce("_hit", "_before").alias("_r")).select("draw", "_r.*")


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows in seeded order."""
    return df.orderBy(seeded(F.col(id_col), seed), id_col).limit(n)


def pair_distances(df: DataFrame, id_col: str, value: str | None = None) -> DataFrame:
    """Distances of all pairs of a small sample (the caller bounds it)."""
    cols = [id_col, *XY, *([value] if value else [])]
    a, b = df.select(*[F.col(c).alias(f"a_{c}") for c in cols]), df.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = a.join(F.broadcast(b), F.col(f"a_{id_col}") < F.col(f"b_{id_col}"))
    return pairs.withColumn("km", hav_km(F.col(f"a_{XY[0]}"), F.col(f"a_{XY[1]}"), F.col(f"b_{XY[0]}"), F.col(f"b_{XY[1]}")))


def variogram(df: DataFrame, id_col: str, value: str, bins: int = 20, sample: int = 1000, seed: int = 9) -> DataFrame:
    """``bin, n, km, gamma``: half squared differences by distance, up to half the largest distance, of the pairs of a seeded sample."""
    d = pair_distances(seeded_sample(df, id_col, sample, seed), id_col, value).withColumn("g", 0.5 * (F.col(f"a_{value}") - F.col(f"b_{value}")) * (F.col(f"a_{value}") - F.col(f"b_{value}")))
    half = d.agg((F.max("km") / 2.0).alias("half"))
    d = d.crossJoin(F.broadcast(half)).where(F.col("km") <= F.col("half"))  # one row
    return d.groupBy(F.least(F.floor(F.col("km") / (F.col("half") / float(bins))), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("km").alias("km"), F.avg("g").alias("gamma"))


def autocorrelation_range(df: DataFrame, id_col: str, value: str, lo: float = 1.0, hi: float = 500.0) -> DataFrame:
    """``range_km``: the practical range of an exponential variogram fitted to the bins, clamped."""
    rows = variogram(df, id_col, value).orderBy("bin").collect()  # one row for each bin
    h, g, w = (np.array([r[c] for r in rows], dtype=float) for c in ("km", "gamma", "n"))
    best = (np.inf, lo)
    for a in np.geomspace(lo, hi, 400) if len(h) >= 3 else ():
        m = np.stack([np.ones_like(h), 1 - np.exp(-h / a)], axis=1)
        c = np.linalg.lstsq(m * np.sqrt(w)[:, None], g * np.sqrt(w), rcond=None)[0]
        best = min(best, (float((w * (m @ np.maximum(c, 0) - g) ** 2).sum()), float(a)))
    return df.sparkSession.createDataFrame([(float(min(max(3 * best[1], lo), hi)),)], "range_km double")


def autocorrelation_ranges(df: DataFrame, id_col: str, values: list[str], least: int = 30) -> DataFrame:
    """``predictor, range_km`` for each predictor (scale does not matter to it), and their median under a null name; ``least`` points are needed."""
    if df.limit(least).count() < least:
        raise ValueError(f"a variogram needs {least} points")
    found = [(v, autocorrelation_range(df, id_col, v).first()[0]) for v in values]
    return df.sparkSession.createDataFrame([*found, (None, float(np.median([r for _, r in found])))], "predictor string, range_km double")


def _thin_cell(km: float) -> tuple[float, Callable[[Column], Column]]:
    """Cells in which no two points are ``km`` apart: the height of a band in degrees, and the number of cells around a band."""
    height = min(180.0, math.degrees(0.49 * km / EARTH_KM))

    def around(band: Column) -> Column:
        low, high = band * height - 90.0, band * height - 90.0 + height
        nearest = F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high)))
        return F.greatest(F.ceil(2 * math.pi * EARTH_KM * F.cos(F.radians(nearest)) / (0.49 * km)), F.lit(1)).cast("long")

    return height, around


def _own_cell(km: float) -> Column:
    height, around = _thin_cell(km)
    band = F.least(F.floor((F.col(XY[1]) + 90.0) / height), F.lit(math.ceil(180.0 / height) - 1)).cast("long")
    return F.struct(band.alias("band"), F.pmod(F.floor((F.col(XY[0]) + 180.0) / 360.0 * around(band)).cast("long"), around(band)).alias("x"))


def _reached_cells(km: float) -> Column:
    """The cells that a circle of ``km`` around a point can touch."""
    height, around = _thin_cell(km)
    lon, lat, reach = F.col(XY[0]), F.col(XY[1]), math.degrees(km / EARTH_KM) * 1.000001
    ratio = F.sin(F.lit(min(km / EARTH_KM, math.pi / 2))) / F.cos(F.radians(F.least(F.abs(lat), F.lit(89.999999))))
    # all round once the circle holds a pole
    wide = F.when(F.abs(lat) + reach >= 89.9, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.000001)
    last = F.lit(math.ceil(180.0 / height) - 1)
    bands = F.sequence(F.greatest(F.floor((lat - reach + 90.0) / height), F.lit(0)).cast("long"), F.least(F.floor((lat + reach + 90.0) / height), last).cast("long"))

    def cells(band: Column) -> Column:
        n = around(band)
        first, end = (F.floor((lon + side * wide + 180.0) / 360.0 * n).cast("long") for side in (-1, 1))
        xs = F.when(end - first + 1 >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.transform(F.sequence(first, end), lambda x: F.pmod(x, n)))
        return F.transform(xs, lambda x: F.struct(band.alias("band"), x.alias("x")))

    return F.flatten(F.transform(bands, cells))


def distance_thin(df: DataFrame, id_col: str, km: float, seed: int) -> DataFrame:
    """Rows such that no two kept ones are under ``km`` apart: greedy in seeded order; rows without coordinates are kept.

    No pair of points is ever listed. Points fall into cells narrower than
    ``km``, which keep one point at most. In each round the first undecided point
    of a cell is kept if it comes before the first ones of all cells that its
    circle can touch, and undecided points meet the kept ones that reach their
    cell, a bounded number. The first of all undecided points is always decided.
    """
    points = df.where(F.col(XY[0]).isNotNull() & F.col(XY[1]).isNotNull()).select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in XY])
    todo = cut(points.select("id", *XY, seeded(F.col("id"), seed).alias("o"), _own_cell(km).alias("cell")))
    kept = None
    while not todo.isEmpty():
        first = cut(todo.groupBy("cell").agg(F.min(F.struct("o", "id", *XY)).alias("p")).select("cell", "p.*"))
        reached = first.select("o", "id", *XY, F.explode(_reached_cells(km)).alias("cell"))
        rivals = reached.join(first.select("cell", F.struct("o", "id").alias("rival")), "cell").groupBy("id").agg(F.min(F.struct("o", "id")).alias("own"), F.min("rival").alias("rival"))
        keep = cut(first.join(rivals.where("own <= rival").select("id"), "id", "left_semi").select("id", *XY))
        kept = keep.select("id") if kept is None else kept.unionAll(keep.select("id"))
        near = keep.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in XY], F.explode(_reached_cells(km)).alias("_cell"))
        gone = (F.col("cell") == F.col("_cell")) & ((F.col("id") == F.col("_id")) | (hav_km(F.col(XY[0]), F.col(XY[1]), F.col(f"_{XY[0]}"), F.col(f"_{XY[1]}")) < km))
        todo = cut(todo.join(near, gone, "left_anti"))
    bare = F.col(XY[0]).isNull() | F.col(XY[1]).isNull()
    if kept is None:
        return df.where(bare)
    return df.where(~bare).join(kept.select(F.col("id").alias(id_col)), id_col, "left_semi").unionByName(df.where(bare))


def environmental_thin(df: DataFrame, columns: list[str], id_col: str, bins: int = 20) -> DataFrame:
    """One row, the smallest id, for each cell of a grid over the first two principal axes of the standardised columns."""
    mean, cov, _ = covariance(df, columns)
    c = np.array(cov)
    std = np.sqrt(np.where(np.diag(c) > 0, np.diag(c), 1.0))
    values, vectors = np.linalg.eigh(c / np.outer(std, std))
    axes = vectors[:, np.argsort(-values)[:2]]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])] < 0, -1, 1)
    score = {f"_pc{k}": sum((F.col(col) - m) / float(s) * float(axes[j, k]) for j, (col, m, s) in enumerate(zip(columns, mean, std, strict=True))) for k in range(axes.shape[1])}
    d = df.withColumns(score)
    ends = d.agg(*[f(k).alias(f"{k}_{n}") for k in score for n, f in (("lo", F.min), ("hi", F.max))])
    d = d.crossJoin(F.broadcast(ends))  # one row
    cell = [F.least(F.floor((F.col(k) - F.col(f"{k}_lo")) / F.greatest((F.col(f"{k}_hi") - F.col(f"{k}_lo")) / bins, F.lit(1e-12))), F.lit(bins - 1)).alias(f"{k}_b") for k in score]
    return d.groupBy(*cell).agg(F.min(id_col).alias(id_col)).select(id_col)


def chi_square_quantile(p: float, df: int) -> float:
    """The value that a chi-square variable of ``df`` degrees stays below with probability ``p``, by halving an interval."""

    def below(x: float) -> float:  # the regularised lower gamma function as a series
        a, term, n = df / 2, 1.0 / (df / 2), 0
        total = term
        while term > total * 1e-16:
            n += 1
            term *= x / 2 / (a + n)
            total += term
        return total * math.exp(a * math.log(x / 2) - x / 2 - math.lgamma(a)) if x > 0 else 0.0

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(200):
        low, high = (low, (low + high) / 2) if below((low + high) / 2) >= p else ((low + high) / 2, high)
    return (low + high) / 2


#: Robust covariance: rows of a subset, subsets, random starts in each, and candidates that each round hands on.
SUBSET, SUBSETS, STARTS, CANDIDATES = 300, 5, 100, 10


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(axis=0), np.cov(x.T, bias=True).reshape(x.shape[1], -1)


def _squares(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean)


def concentrate(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Determinant, mean and covariance of the nearer half after some concentration steps."""
    h = (len(x) + x.shape[1] + 1) // 2
    for _ in range(steps):
        mean, cov = _moments(x[np.argsort(_squares(x, mean, cov), kind="stable")[:h]])
    return float(np.linalg.det(cov)), mean, cov


def start_candidates(x: np.ndarray, seed: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The best of many concentrations of one subset, each begun from a few rows of it."""
    rng, p = np.random.default_rng(seed), x.shape[1]
    found = [concentrate(x, *_moments(x[rng.choice(len(x), min(p + 1, len(x)), replace=False)]), 2) for _ in range(STARTS)]
    return sorted(found, key=lambda c: c[0])[:CANDIDATES]


def robust_covariance(df: DataFrame, id_col: str, columns: list[str], seed: int = 0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the half of the rows with the smallest determinant, corrected and reweighted.

    Subsets of a seeded sample (SUBSETS of SUBSET rows) are each searched from
    many starts in a task of their own; the best candidates go on over the whole
    sample, and the best two of those over all rows, by aggregations, until their
    determinant stays. Distances are then scaled to the chi-square median, and
    mean and covariance taken over all rows within its 97.5 % quantile.
    """
    p = len(columns)
    x = df.dropna(subset=columns).select(F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    cols = [f"_x{i}" for i in range(p)]
    sample = seeded_sample(x, "_id", SUBSET * SUBSETS, seed).withColumn("_k", F.pmod(F.xxhash64("_id"), F.lit(SUBSETS)).cast("int"))
    sample = cut(sample)

    def search(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_id")
        found = start_candidates(part[cols].to_numpy(), seed + k[0]) if len(part) > p else []
        return pd.DataFrame({"mean": [m.tolist() for _, m, _ in found], "cov": [c.ravel().tolist() for _, _, c in found]})

    # SUBSETS times CANDIDATES rows, and the bounded sample
    begun = sample.groupBy("_k").applyInPandas(search, "mean array<double>, cov array<double>").collect()
    whole = sample.orderBy("_id").select(*cols).toPandas().to_numpy()
    pooled = sorted((concentrate(whole, np.array(r["mean"]), np.array(r["cov"]).reshape(p, p), 2) for r in begun), key=lambda c: c[0])[:2]
    pooled = pooled or [(0.0, *_moments(whole))]

    def squares(mean: np.ndarray, cov: np.ndarray) -> Column:
        inverse = np.linalg.pinv(cov)
        d = [F.col(c) - float(m) for c, m in zip(cols, mean, strict=True)]
        return sum((d[i] * d[j] * float(inverse[i, j]) for i in range(p) for j in range(p)), F.lit(0.0))

    def within(mean: np.ndarray, cov: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
        m, c, n = covariance(x.where(squares(mean, cov) <= bound), cols)
        return np.array(m), np.array(c) * ((n - 1) / n)

    n = x.count()
    half = {"h": min(1.0, ((n + p + 1) // 2 - 1) / max(n - 1, 1))}
    ends = []
    for det, mean, cov in pooled:
        for _ in range(rounds):
            bound = quantiles(x.select(squares(mean, cov).alias("d")), "d", half).first()[0]
            mean, cov = within(mean, cov, bound * (1 + 1e-12))
            last, det = det, float(np.linalg.det(cov))
            if abs(last - det) <= 1e-9 * abs(last):
                break
        ends.append((det, mean, cov))
    _, mean, cov = min(ends, key=lambda c: c[0])
    middle = quantiles(x.select(squares(mean, cov).alias("d")), "d", {"m": 0.5}).first()[0]
    cov = cov * (middle / chi_square_quantile(0.5, p) or 1.0)
    return within(mean, cov, chi_square_quantile(0.975, p))


def environmental_outliers(df: DataFrame, id_col: str, columns: list[str], least: int = 30, probability: float = 0.999, seed: int = 0) -> DataFrame:
    """``df`` with ``outlier``: squared robust distance above the chi-square quantile; false for rows with nulls, and for all if fewer than ``least`` have none."""
    complete = df.dropna(subset=columns)
    if complete.count() < max(least, len(columns) + 2):
        return df.withColumn("outlier", F.lit(False))
    r = complete.agg(*[f(F.col(c).cast("double")) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    z = {c: (F.col(c) - float(r[2 * i])) / float(r[2 * i + 1] or 1.0) for i, c in enumerate(columns)}
    scaled = complete.select(F.col(id_col).alias("_rid"), *[e.alias(f"_z{i}") for i, e in enumerate(z.values())])
    mean, cov = robust_covariance(cut(scaled), "_rid", [f"_z{i}" for i in range(len(columns))], seed)
    inverse = np.linalg.pinv(cov)
    d = [e - float(m) for e, m in zip(z.values(), mean, strict=True)]
    square = sum((d[i] * d[j] * float(inverse[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return df.withColumn("outlier", F.coalesce(square > chi_square_quantile(probability, len(columns)), F.lit(False)))


def best_thinning(df: DataFrame, id_col: str, km: float, repetitions: int) -> DataFrame:
    """The repetition of distance thinning that keeps most rows (the first of equal ones), with its rows' ids."""
    best = None
    for rep in range(repetitions):
        kept = cut(distance_thin(df, id_col, km, seed=rep).select(id_col))
        n = kept.count()
        if best is None or n > best[0]:
            best = (n, rep, kept)
    return best[2].withColumn("repetition", F.lit(best[1]))
