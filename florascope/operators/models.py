"""Model fitting and prediction on Spark.

Fits are Newton or proximal-gradient iterations whose sums over rows are one
Spark aggregation each; only the p x p sums reach the driver. A fitted model is
a small dict of coefficients and predicts as a column expression, so that
projection stays inside generated code.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florascope.functions.geo import hav_km
from florascope.functions.scalars import cloglog

from . import stats
from .order import ends, quantiles
from .sampling import seeded
from .session import cut
from .spatial import XY, _sides, nearest_km


#: Knots of a predictor's cubic splines, evenly from its smallest to its largest value.
KNOTS = 5


def standardiser(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float, float]]:
    """Mean and population deviation (1 if zero) of each column, and its ends in those units."""
    r = df.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop, F.min, F.max)]).first()
    out = {}
    for i, c in enumerate(columns):
        mean, dev, low, high = (float(x or 0.0) for x in r[4 * i : 4 * i + 4])
        out[c] = (mean, dev or 1.0, (low - mean) / (dev or 1.0), (high - mean) / (dev or 1.0))
    return out


def _bump(v: str) -> str:
    """SQL for the cubic B-spline over the whole numbers 0 to 4: its recursion, written out for each piece."""
    a, b, c = f"({v} - 1)", f"({v} - 2)", f"(4 - {v})"
    return (
        f"CASE WHEN {v} <= 0 OR {v} >= 4 THEN 0D WHEN {v} < 1 THEN {v} * {v} * {v} / 6 WHEN {v} < 2 THEN (1 + {a} * (3 + {a} * (3 - 3 * {a}))) / 6 "
        f"WHEN {v} < 3 THEN (4 + {b} * {b} * (3 * {b} - 6)) / 6 ELSE {c} * {c} * {c} / 6 END"
    )


def splines(z: str, low: float, high: float, knots: int = KNOTS) -> list[Column]:
    """``knots + 2`` cubic B-spline bases of a SQL expression between two ends; beyond them each goes on as a straight line."""
    step = (high - low) / (knots - 1) or 1.0
    u = f"((greatest(least({z}, {high!r}D), {low!r}D) - {low!r}D) / {step!r}D)"
    # slopes at an end: of the three bases that do not vanish there only the outer two have one
    slope = {0: -0.5 / step, 2: 0.5 / step}
    out = []
    for i in range(knots + 2):
        base = _bump(f"({u} + {3 - i}D)")
        for end, outside, k in ((low, f"{z} < {low!r}D", i), (high, f"{z} > {high!r}D", i - knots + 1)):
            if k in slope:
                base += f" + CASE WHEN {outside} THEN ({z} - {end!r}D) * {slope[k]!r}D ELSE 0D END"
        out.append(F.expr(base))
    return out


def features(columns: list[str], scale: dict[str, tuple], kinds: str = "lq", knots: int = KNOTS, hold: dict[str, float] | None = None) -> dict[str, Column]:
    """Linear (l), quadratic (q), product (p), hinge (h) and cubic spline (s) features of standardised predictors; ``hold`` fixes some of them."""
    z = {c: ((F.lit(float(hold[c])) if hold and c in hold else F.col(c)) - scale[c][0]) / scale[c][1] for c in columns}
    out: dict[str, Column] = {}
    for c in columns:
        if "l" in kinds:
            out[c] = z[c]
        if "q" in kinds:
            out[f"{c}^2"] = z[c] * z[c]
        if "h" in kinds:
            for k in range(1, knots + 1):
                at = -2.0 + 4.0 * k / (knots + 1)
                out[f"{c}>{k}"] = F.greatest(z[c] - at, F.lit(0.0))
        if "s" in kinds:
            mean, dev, low, high = scale[c]
            at = f"(({float(hold[c])!r}D" if hold and c in hold else f"((CAST(`{c}` AS DOUBLE)"
            out |= {f"{c}~{k}": b for k, b in enumerate(splines(f"{at} - {mean!r}D) / {dev!r}D)", low, high, knots))}
    if "p" in kinds:
        out |= {f"{a}*{b}": z[a] * z[b] for i, a in enumerate(columns) for b in columns[i + 1 :]}
    return out


def _linear(feats: dict[str, Column], beta: np.ndarray) -> Column:
    return sum((f * float(b) for f, b in zip(feats.values(), beta[1:], strict=True)), F.lit(float(beta[0])))


def _newton(df: DataFrame, feats: dict[str, Column], mu: Callable[[np.ndarray], np.ndarray], variance: Callable[[np.ndarray], np.ndarray], y: str, weight: Column, offset: Column, ridge: float, rounds: int, tol: float) -> dict:
    """Ridge Newton steps; a step is one pass in which every task sums its rows' gradient and curvature, merged by an aggregation."""
    names = list(feats)
    p = len(names) + 1
    # features are made once; a step reads them as one array
    base = cut(df.select(F.col(y).cast("double").alias("_y"), weight.cast("double").alias("_w"), offset.cast("double").alias("_o"), F.array(F.lit(1.0), *feats.values()).alias("_f")).dropna())
    beta = np.zeros(p)
    for step in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], beta: np.ndarray = beta) -> Iterator[pa.RecordBatch]:
            total = np.zeros(p + p * p)
            for b in batches:
                if len(b):
                    f = np.array(b.column(3).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(b), p)
                    seen, w, o = (b.column(k).to_numpy() for k in range(3))
                    m = mu(f @ beta + o)
                    total += np.r_[f.T @ ((seen - m) * w), ((f.T * (variance(m) * w)) @ f).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "v"])

        # p + p * p sums reach the driver
        r = dict(base.mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect())
        total = np.array([r.get(k, 0.0) for k in range(p + p * p)])
        grad = total[:p] - ridge * np.r_[0, beta[1:]]
        h = total[p:].reshape(p, p) + np.diag(np.r_[1e-9, np.full(p - 1, ridge)])
        move = np.linalg.lstsq(h, grad, rcond=None)[0]
        size = float(np.abs(move).max())
        beta = beta + move * min(1.0, 5.0 / max(size, 1e-12))
        if size < tol:
            break
    return {"names": names, "beta": beta.tolist(), "rounds": step + 1}


def fit_glm(df: DataFrame, columns: list[str], y: str = "y", kinds: str = "lq", ridge: float = 1e-3, rounds: int = 25, tol: float = 1e-6, balanced: bool = True) -> dict:
    """Logistic regression on features of the predictors; classes have equal weight if ``balanced``."""
    df = cut(df.select(y, *columns))  # features then refer to plain columns, whatever made them
    scale = standardiser(df, columns)
    feats = features(columns, scale, kinds)
    n = df.agg(F.sum(F.col(y).cast("double")), F.count("*")).first()
    n1, n0 = n[0] or 1.0, (n[1] - (n[0] or 0.0)) or 1.0
    weight = F.when(F.col(y) == 1, n[1] / (2.0 * n1)).otherwise(n[1] / (2.0 * n0)) if balanced else F.lit(1.0)
    mu = lambda eta: 1.0 / (1.0 + np.exp(-np.clip(eta, -30.0, 30.0)))
    m = _newton(df, feats, mu, lambda p: p * (1.0 - p), y, weight, F.lit(0.0), ridge, rounds, tol)
    return m | {"kind": "glm", "columns": columns, "scale": scale, "kinds": kinds}


def fit_ppm(df: DataFrame, columns: list[str], y: str = "y", area: float = 1.0, offset: str | None = None, kinds: str = "lq", ridge: float = 1e-3, rounds: int = 40, tol: float = 1e-6) -> dict:
    """Poisson point process by weighted Poisson regression: presences with a tiny weight, quadrature cells with their area."""
    scale = standardiser(df, columns)
    feats = features(columns, scale, kinds)
    q = df.where(F.col(y) == 0).count() or 1
    tiny = 1e-6
    d = df.withColumns({"_rate": F.when(F.col(y) == 1, 1.0 / tiny).otherwise(0.0), "_weight": F.when(F.col(y) == 1, tiny).otherwise(area / q)})
    mu = lambda eta: np.exp(np.clip(eta, -30.0, 30.0))
    m = _newton(d, feats, mu, lambda v: v, "_rate", F.col("_weight"), F.col(offset).cast("double") if offset else F.lit(0.0), ridge, rounds, tol)
    return m | {"kind": "ppm", "columns": columns, "scale": scale, "kinds": kinds}


def fit_maxent(df: DataFrame, columns: list[str], y: str = "y", kinds: str = "lqh", multiplier: float = 1.0, rounds: int = 150) -> dict:
    """MaxEnt as an L1-regularised Gibbs density over background, fitted by proximal gradient steps.

    Background is summed per distinct feature row first, so a step is one pass over distinct cells.
    """
    scale = standardiser(df, columns)
    feats = features(columns, scale, kinds)
    names = list(feats)
    d = df.select(F.col(y).alias("_y"), *[f.alias(f"_f{i}") for i, f in enumerate(feats.values())])
    ends = d.where("_y = 0").agg(*[f(F.col(f"_f{i}")) for i in range(len(names)) for f in (F.min, F.max)]).first()
    lo = np.array([ends[2 * i] for i in range(len(names))])
    span = np.array([max(ends[2 * i + 1] - ends[2 * i], 1e-12) for i in range(len(names))])
    unit = [(F.col(f"_f{i}") - float(lo[i])) / float(span[i]) for i in range(len(names))]
    pres = d.where("_y = 1").agg(F.count("*"), *[F.avg(u) for u in unit], *[F.stddev_pop(u) for u in unit]).first()
    m, target, dev = pres[0], np.array(pres[1 : 1 + len(names)]), np.array(pres[1 + len(names) :])
    penalty = multiplier * np.maximum(dev, 0.05) / math.sqrt(max(m, 1))
    bg = d.where("_y = 0").groupBy(*[F.round(u, 6).alias(f"u{i}") for i, u in enumerate(unit)]).agg(F.count("*").alias("n"))
    bg = cut(bg)
    beta, velocity, rate = np.zeros(len(names)), np.zeros(len(names)), 2.0
    last = math.inf
    for step in range(rounds):
        look = beta + velocity
        eta = sum((F.col(f"u{i}") * float(b) for i, b in enumerate(look)), F.lit(0.0))
        w = F.exp(eta) * F.col("n")
        r = bg.agg(F.sum(w), *[F.sum(w * F.col(f"u{i}")) for i in range(len(names))]).first()
        grad = np.array(r[1:]) / r[0] - target
        moved = look - rate * grad
        nxt = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        loss = math.log(r[0]) - float(look @ target) + float(np.abs(look) @ penalty)
        if loss > last + 1e-9:
            velocity, rate = np.zeros(len(names)), rate / 2
        else:
            velocity = (nxt - beta) * (step / (step + 3.0))
        if np.abs(nxt - beta).max() < 1e-4:
            beta = nxt
            break
        beta, last = nxt, loss
    eta = sum((F.col(f"u{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))
    z, total = bg.agg(F.sum(F.exp(eta) * F.col("n")), F.sum("n")).first()
    p = F.exp(eta) / float(z)
    entropy = bg.agg(-F.sum(p * F.ln(p) * F.col("n"))).first()[0]
    return {"kind": "maxent", "columns": columns, "scale": scale, "kinds": kinds, "names": names, "beta": beta.tolist(), "lo": lo.tolist(), "span": span.tolist(), "log_z": math.log(z), "entropy": float(entropy), "rounds": step + 1}


def predict(model: dict, hold: dict[str, float] | None = None) -> Column:
    """Suitability in [0, 1] as a column expression; ``hold`` fixes predictors at given values."""
    scale = model["scale"]
    feats = features(model["columns"], scale, model["kinds"], hold=hold)
    if model["kind"] == "maxent":
        eta = sum(((f - lo) / span * float(b) for f, b, lo, span in zip(feats.values(), model["beta"], model["lo"], model["span"], strict=True)), F.lit(0.0))
        return cloglog(eta - model["log_z"] + model["entropy"])
    eta = _linear(feats, np.array(model["beta"]))
    if model["kind"] == "glm":
        return 1.0 / (1.0 + F.exp(-F.greatest(F.least(eta, F.lit(30.0)), F.lit(-30.0))))
    return cloglog(eta)


def spatial_blocks(df: DataFrame, k: int, seed: int, rounds: int = 12, anchors: DataFrame | None = None) -> DataFrame:
    """``df`` with ``fold``: nearest of ``k`` centres of ``anchors`` (``df`` itself) on the unit sphere, found by Lloyd rounds (k rows reach the driver)."""
    lon, lat = F.radians(XY[0]), F.radians(XY[1])
    xyz = {"_x": F.cos(lat) * F.cos(lon), "_y3": F.cos(lat) * F.sin(lon), "_z": F.sin(lat)}
    a = (df if anchors is None else anchors).withColumns(xyz)
    start = a.orderBy(F.xxhash64("_x", "_y3", F.lit(seed)), "_x", "_y3").limit(k).select("_x", "_y3", "_z").collect()
    centres = [tuple(r) for r in start]

    def nearest(centres: list[tuple]) -> Column:
        dots = F.array(*[F.col("_x") * float(a) + F.col("_y3") * float(b) + F.col("_z") * float(c) for a, b, c in centres])
        return (F.array_position(dots, F.array_max(dots)) - 1).cast("int")

    for _ in range(rounds):
        sums = a.groupBy(nearest(centres).alias("fold")).agg(F.sum("_x"), F.sum("_y3"), F.sum("_z")).collect()
        new = list(centres)
        for r in sums:
            n = math.sqrt(sum(v * v for v in r[1:])) or 1.0
            new[r["fold"]] = tuple(v / n for v in r[1:])
        if max(abs(a - b) for x, y in zip(new, centres, strict=True) for a, b in zip(x, y, strict=True)) < 1e-9:
            break
        centres = new
    return df.withColumns(xyz).withColumn("fold", nearest(centres)).drop(*xyz)


def tune_maxent(df: DataFrame, columns: list[str], grid: list[tuple[str, float]], folds: int, rounds: int) -> tuple[dict, list[tuple]]:
    """The model of the setting with the best mean (CBI, AUC) over ``fold``, and every setting with its means.

    Settings are feature kinds and a regularisation multiplier; the first of equal ones wins.
    """
    table = []
    for kinds, multiplier in grid:
        scores = []
        for f in range(folds):
            model = fit_maxent(df.where(F.col("fold") != f), columns, kinds=kinds, multiplier=multiplier, rounds=rounds)
            s = cut(df.where(F.col("fold") == f).select("y", predict(model).alias("s")))
            scores.append((stats.boyce(s).first()[0], stats.auc(s).first()[0]))
        means = [float(np.mean([x for x in column if x is not None] or [-math.inf])) for column in zip(*scores, strict=True)]
        table.append((kinds, multiplier, *means))
    best = max(table, key=lambda r: (r[2], r[3]))
    return fit_maxent(df, columns, kinds=best[0], multiplier=best[1], rounds=rounds), table


def cross_validate(df: DataFrame, fit: Callable[[DataFrame], dict], folds: int) -> DataFrame:
    """``fold, auc, tss`` of a model fitted on the other folds."""
    out = None
    for f in range(folds):
        model = fit(df.where(F.col("fold") != f))
        scored = df.where(F.col("fold") == f).select(F.lit(f).alias("fold"), "y", predict(model).alias("s"))
        part = stats.auc(scored, ["fold"]).join(stats.tss(scored, ["fold"]).drop("threshold"), "fold")
        out = part if out is None else out.unionAll(part)
    return out


def compare_sets(df: DataFrame, sets: dict[str, list[str]], fit: Callable[[DataFrame, list[str]], dict], folds: int) -> DataFrame:
    """``set_name, cbi, auc, rank`` of predictor sets: every row is scored by a model of the other folds; the best Boyce index, then AUC, is first, nulls last."""
    out = None
    for name, columns in sets.items():
        scored = None
        for f in range(folds):
            part = df.where(F.col("fold") == f).select("y", predict(fit(df.where(F.col("fold") != f), columns)).alias("s"))
            scored = part if scored is None else scored.unionAll(part)
        scored = cut(scored)
        one = stats.boyce(scored).crossJoin(stats.auc(scored)).select(F.lit(name).alias("set_name"), "cbi", "auc")  # one row each
        out = one if out is None else out.unionAll(one)
    best = Window.orderBy(F.desc_nulls_last("cbi"), F.desc_nulls_last("auc"), "set_name")  # a row for each set
    return out.withColumn("rank", F.row_number().over(best))


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``df`` with row numbers from 1 in ``order``: sorted in range partitions, each of which begins where the one before ends."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut(df.withColumn("_order", order).repartitionByRange(parts, "_order").withColumn("_part", F.spark_partition_id()))
    sizes = d.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("_order"))
    return d.withColumn(name, (F.col("_before") + nth).cast("long")).select(*df.columns, name)


def permutation_importance(df: DataFrame, columns: list[str], score: Callable[[dict[str, Column]], Column], repeats: int = 3) -> DataFrame:
    """``predictor, importance``: mean loss of AUC when a column is permuted, in percent of all losses.

    A permutation pairs rows by two seeded orders; all (column, repeat) runs share one pass of AUC.
    """
    ranked = cut(numbered(df, F.struct("id", "y"), "_i"))
    runs = None
    base = ranked.select(F.lit("").alias("predictor"), F.lit(-1).alias("repeat"), "y", score({c: F.col(c) for c in columns}).alias("s"))
    for k, c in enumerate(columns):
        for r in range(repeats):
            shuffled = numbered(ranked.select("_i", F.col(c).alias("_p")), F.struct(seeded(F.col("_i"), 31 * k + r + 1), "_i"), "_j").select(F.col("_j").alias("_i"), "_p")
            run = ranked.join(shuffled, "_i").select(F.lit(c).alias("predictor"), F.lit(r).alias("repeat"), "y", score({n: (F.col("_p") if n == c else F.col(n)) for n in columns}).alias("s"))
            runs = run if runs is None else runs.unionAll(run)
    a = stats.auc(base.unionAll(runs), ["predictor", "repeat"])
    whole = a.where("repeat = -1").select(F.col("auc").alias("whole"))
    drops = a.where("repeat >= 0").crossJoin(F.broadcast(whole)).groupBy("predictor").agg(F.greatest(F.avg(F.col("whole") - F.col("auc")), F.lit(0.0)).alias("d"))  # whole is one row
    total = F.sum("d").over(Window.partitionBy())
    return drops.select("predictor", F.round(F.when(total > 0, F.col("d") / total * 100.0).otherwise(0.0), 2).alias("importance"))


def response_curves(df: DataFrame, model: dict, points: int = 40, rows: int = 400, seed: int = 1) -> DataFrame:
    """``predictor, x, mean``: the mean prediction over a sample with one predictor set to each of a range of values."""
    sample = df.orderBy(seeded(F.col("id"), seed), "id").limit(rows)
    limits = ends(df, {c: {f"{c}_lo": 0.01, f"{c}_hi": 0.99} for c in model["columns"]})
    out = None
    for c in model["columns"]:
        grid = limits.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_k"), f"{c}_lo", f"{c}_hi")
        grid = grid.select((F.col(f"{c}_lo") + (F.col(f"{c}_hi") - F.col(f"{c}_lo")) * F.col("_k") / float(points - 1)).alias("x"))
        curve = sample.drop(c).crossJoin(F.broadcast(grid)).withColumn(c, F.col("x"))  # points rows
        part = curve.groupBy("x").agg(F.avg(predict(model)).alias("mean")).select(F.lit(c).alias("predictor"), "x", "mean")
        out = part if out is None else out.unionAll(part)
    return out


def clusters(df: DataFrame, id_col: str, km: float, least: int = 3) -> DataFrame:
    """``id, cluster``: density clusters of points (cores have ``least`` points within ``km``, themselves included); noise is left out.

    Labels only fall, and rounds go on until none changes.
    """
    points = df.select(F.col(id_col).alias("id"), *XY)
    left, right = _sides(points, points, km, ["id"])
    near = left.join(right, (left["by"] == right["by"]) & (left["bx"] == right["bx"])).where(hav_km(F.col(XY[0]), F.col(XY[1]), F.col("_lon"), F.col("_lat")) <= km)
    near = cut(near.select("id", F.col("_id").alias("other")))
    cores = cut(near.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("id"))
    edges = cut(near.join(cores, "id", "left_semi").join(cores.select(F.col("id").alias("other")), "other", "left_semi"))
    label = cut(cores.withColumn("cluster", F.col("id")))
    while True:
        low = edges.join(label.select(F.col("id").alias("other"), "cluster"), "other").groupBy("id").agg(F.min("cluster").alias("cluster"))
        # jump: a label is itself a core, whose own label may be smaller
        jump = low.select("id", F.col("cluster").alias("c")).join(label.select(F.col("id").alias("c"), F.col("cluster").alias("root")), "c").select("id", F.least("c", "root").alias("cluster"))
        nxt = cut(jump)
        changed = nxt.join(label.withColumnRenamed("cluster", "old"), "id").where("cluster <> old").limit(1).count()
        label = nxt
        if not changed:
            break
    border = near.join(label.select(F.col("id").alias("other"), "cluster"), "other").groupBy("id").agg(F.min("cluster").alias("cluster"))
    return border


def native_range(df: DataFrame, id_col: str, eps_km: float = 750.0, least_labelled: int = 5) -> DataFrame:
    """The records a native-range draft is built from: labelled native ones if there are enough, else the largest cluster."""
    native = df.where("range_label = 'native'")
    if native.limit(least_labelled).count() >= least_labelled:
        return native.select(id_col)
    cells = df.where("range_label <> 'introduced'").withColumns({"_r": F.floor(F.col(XY[1]) / 0.5), "_c": F.floor(F.col(XY[0]) / 0.5)})
    first = cells.groupBy("_r", "_c").agg(F.min(id_col).alias(id_col), F.min_by(XY[0], id_col).alias(XY[0]), F.min_by(XY[1], id_col).alias(XY[1]))
    c = clusters(first, id_col, eps_km)
    top = c.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(1)
    members = c.join(top, "cluster", "left_semi").select(F.col("id").alias(id_col))
    return cells.join(first.join(members, id_col, "left_semi").select("_r", "_c"), ["_r", "_c"], "left_semi").select(id_col)


def density_factor(df: DataFrame, key: list[str], k: int = 5) -> DataFrame:
    """``df`` with ``density``: mean distance to the ``k`` nearest other points by its median, within 0.1 and 10; 1 if it cannot be told."""
    near = cut(nearest_km(df, df, key, k=k, exclude_self=True, mean=True))
    middle = quantiles(near, "km", {"_middle": 0.5})
    ratio = F.when(F.col("_middle") > 0, F.greatest(F.least(F.col("km") / F.col("_middle"), F.lit(10.0)), F.lit(0.1)))
    near = near.crossJoin(F.broadcast(middle)).select(*key, F.coalesce(ratio, F.lit(1.0)).alias("density"))  # one row
    return df.join(near, key)


def presence_weights(df: DataFrame, tier: Column, density: Column) -> DataFrame:
    """``df`` with ``weight``: tier weight times density factor, rescaled to mean 1."""
    w = F.when(tier == "A", 1.0).when(tier == "B", 0.75).otherwise(0.5) * density
    d = df.withColumn("_w", w)
    mean = d.agg(F.avg("_w").alias("_m"))
    return d.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("_w") / F.col("_m")).drop("_w", "_m")  # one row


def likelihood_ratio_p(statistic: float) -> float:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return math.erfc(math.sqrt(max(statistic, 0.0) / 2))


def poisson_log_likelihood(df: DataFrame, model: dict, offset: str | None = None) -> float:
    """Log likelihood of a point process at presences less its integral over the quadrature cells."""
    eta = _linear(features(model["columns"], model["scale"], model["kinds"]), np.array(model["beta"])) + (F.col(offset) if offset else F.lit(0.0))
    q = F.count_if(F.col("y") == 0)
    r = df.agg(F.sum(F.when(F.col("y") == 1, eta)), F.sum(F.when(F.col("y") == 0, F.exp(F.least(eta, F.lit(30.0))))), q).first()
    return float((r[0] or 0.0) - (r[1] or 0.0) / max(r[2], 1))


def offset_test(df: DataFrame, columns: list[str], bias: str) -> DataFrame:
    """Does effort act as a plain offset? Likelihood ratio of a free bias coefficient against the offset."""
    fixed = fit_ppm(df, columns, offset=bias, kinds="lq", rounds=15)
    free = fit_ppm(df, [*columns, bias], kinds="lq", rounds=15)
    a, b = poisson_log_likelihood(df, fixed, bias), poisson_log_likelihood(df, free)
    lr = max(0.0, 2 * (b - a))
    return df.sparkSession.createDataFrame([(a, b, lr, likelihood_ratio_p(lr))], "offset_ll double, free_ll double, statistic double, p_value double")


def shared_bias(df: DataFrame, species: str, columns: list[str], bias: str, rounds: int = 12) -> DataFrame:
    """``species, coefficient``: bias coefficient of all species together (species null) and of each alone.

    The joint fit has one intercept and climate response for each species and a
    common bias term; species are few, so their dummies are columns.
    """
    names = sorted(r[0] for r in df.select(species).distinct().collect())  # the peers of one target group
    wide, cols = df, []
    for s in names:
        on = (F.col(species) == s).cast("double")
        wide = wide.withColumn(f"_s{s}", on)
        cols.append(f"_s{s}")
        for c in columns:
            wide = wide.withColumn(f"_s{s}_{c}", on * F.col(c))
            cols.append(f"_s{s}_{c}")
    m = fit_ppm(wide, [*cols, bias], kinds="l", rounds=rounds)
    rows = [(None, m["beta"][-1] / m["scale"][bias][1])]
    for s in names:
        one = fit_ppm(df.where(F.col(species) == s), [*columns, bias], kinds="l", rounds=rounds)
        rows.append((str(s), one["beta"][-1] / one["scale"][bias][1]))
    return df.sparkSession.createDataFrame(rows, "species string, coefficient double")


def fit_integrated(presence_only: DataFrame, survey: DataFrame, columns: list[str], rounds: int = 20, ridge: float = 1e-3) -> dict:
    """Presence-only point process and survey presence/absence with one response: Fisher scoring on the summed likelihoods.

    Surveys follow a complementary log-log link with their own intercept, so
    both parts share the slopes.
    """
    scale = standardiser(presence_only, columns)
    feats = features(columns, scale, "lq")
    p = len(feats) + 2  # two intercepts
    q = presence_only.where("y = 0").count() or 1
    make = lambda d, first: d.select(F.col("y").cast("double").alias("_y"), F.lit(1.0 - first).alias("_f0"), F.lit(float(first)).alias("_f1"), *[f.alias(f"_f{i + 2}") for i, f in enumerate(feats.values())])
    po, pa = make(presence_only, 0), make(survey, 1)
    both = cut(po.withColumn("_po", F.lit(True)).unionByName(pa.withColumn("_po", F.lit(False))))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    beta = np.zeros(p)
    for step in range(rounds):
        eta = F.greatest(F.least(sum((F.col(f"_f{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0)), F.lit(20.0)), F.lit(-20.0))
        lam = F.exp(eta)
        hit = F.greatest(1.0 - F.exp(-lam), F.lit(1e-12))
        g = F.when(F.col("_po"), F.when(F.col("_y") == 1, 1.0).otherwise(-lam / float(q))).otherwise(F.when(F.col("_y") == 1, lam * F.exp(-lam) / hit).otherwise(-lam))
        v = F.when(F.col("_po"), F.when(F.col("_y") == 1, 0.0).otherwise(lam / float(q))).otherwise(lam * lam * F.exp(-lam) / hit)
        d = both.withColumns({"_g": g, "_v": v})
        r = d.agg(*[F.sum(F.col(f"_f{i}") * F.col("_g")) for i in range(p)], *[F.sum(F.col(f"_f{i}") * F.col(f"_f{j}") * F.col("_v")) for i, j in pairs]).first()
        h = np.diag(np.r_[1e-6, 1e-6, np.full(p - 2, ridge)])
        for (i, j), x in zip(pairs, r[p:], strict=True):
            h[i, j] += x or 0.0
            if i != j:
                h[j, i] += x or 0.0
        move = np.linalg.lstsq(h, np.array([x or 0.0 for x in r[:p]]) - ridge * np.r_[0, 0, beta[2:]], rcond=None)[0]
        size = float(np.abs(move).max())
        beta = beta + move * min(1.0, 3.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return {"kind": "integrated", "columns": columns, "scale": scale, "kinds": "lq", "names": list(feats), "beta": [beta[1], *beta[2:].tolist()], "rounds": step + 1}
