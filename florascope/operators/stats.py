"""Evaluation statistics as aggregations and windows over distinct scores.

Rows are first counted per distinct value; ordered sums then run over range
buckets of the values (see ``order``), never over all of them in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import quantile_points, quantiles, running


def _score_counts(pred: DataFrame, by: list[str]) -> DataFrame:
    return pred.groupBy(*by, "s").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))


def auc(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mann-Whitney AUC of ``y`` (1, 0) over ``s``; ties count half. Null without both classes."""
    by = list(by)
    t = running(_score_counts(pred, by), "s", {"below": F.col("n1") + F.col("n0")}, by)
    r = t.withColumn("rank", F.col("below") + (F.col("n1") + F.col("n0") + 1) / 2.0)
    g = r.groupBy(*by).agg(F.sum(F.col("n1") * F.col("rank")).alias("r1"), F.sum("n1").alias("p"), F.sum("n0").alias("q"))
    return g.select(*by, F.try_divide(F.col("r1") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * F.col("q") * 1.0).alias("auc"))


def tss(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    """Largest true positive rate less false positive rate and its threshold: the highest score that reaches it, at most 1. Null without both classes."""
    by = list(by)
    counts = _score_counts(pred, by)
    whole = counts.groupBy(*[F.col(c).alias(f"_t_{c}") for c in by]).agg(F.sum("n1").alias("p"), F.sum("n0").alias("q"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    t = running(counts, "s", {"b1": F.col("n1"), "b0": F.col("n0")}, by).join(F.broadcast(whole), on)  # a row for each group
    rate = lambda below, all_of: F.try_divide((F.col(all_of) - F.col(below)) * 1.0, F.col(all_of))
    k = t.withColumn("j", rate("b1", "p") - rate("b0", "q"))
    best = F.max_by("s", F.when(F.col("j").isNotNull(), F.struct("j", "s")))
    # `least` skips nulls
    return k.groupBy(*by).agg(F.max("j").alias("tss"), F.when(best.isNotNull(), F.least(best, F.lit(1.0))).alias("threshold"))


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the average rank of ``value``; null for nulls."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_rv")).agg(F.count("*").alias("_rn"))
    ranks = running(counts, "_rv", {"_less": F.col("_rn")}).select("_rv", (F.col("_less") + (F.col("_rn") + 1) / 2.0).alias(name))
    return df.join(ranks, F.col(value) == F.col("_rv"), "left").drop("_rv")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks over rows where both are finite; null under three rows."""
    inf = float("inf")
    ok = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < inf) & (F.abs(b) < inf))
    ranked = average_rank(average_rank(ok, a, "_ra"), b, "_rb")
    return ranked.agg(F.when(F.count("*") >= 3, F.corr("_ra", "_rb")).alias("rho"))


def boyce(pred: DataFrame, windows: int = 101, width: float = 0.1) -> DataFrame:
    """Continuous Boyce index: rank correlation of the predicted-to-expected ratio with the window's place.

    Windows overlap and include both ends. Every score knows the first and last
    window that can hold it, is counted per window, and the exact bounds decide.
    """
    counts = _score_counts(pred, [])
    b = counts.agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum("n1").alias("p"), F.sum("n0").alias("q"))
    d = counts.crossJoin(F.broadcast(b)).where("hi > lo")  # b is one row
    step = (F.col("hi") - (F.col("hi") - F.col("lo")) * width - F.col("lo")) / float(windows - 1)
    at = (F.col("s") - F.col("lo")) / step
    span = width * (windows - 1) / (1 - width)
    first = F.greatest(F.floor(at - span - 1).cast("int"), F.lit(0))
    last = F.least(F.ceil(at + 1).cast("int"), F.lit(windows - 1))
    d = d.withColumn("k", F.explode(F.sequence(first, last)))
    start = F.col("lo") + F.col("k") * (F.col("hi") - (F.col("hi") - F.col("lo")) * width - F.col("lo")) / float(windows - 1)
    d = d.withColumn("a", start).where((F.col("s") >= F.col("a")) & (F.col("s") <= F.col("a") + (F.col("hi") - F.col("lo")) * width))
    f = d.groupBy("k", "p", "q").agg(F.sum("n1").alias("w1"), F.sum("n0").alias("w0")).where("w0 > 0")
    f = f.withColumn("f", (F.col("w1") / F.col("p")) / (F.col("w0") / F.col("q")))
    order = Window.orderBy("k")  # at most ``windows`` rows
    prev = F.lag("f").over(order)
    kept = f.withColumn("prev", prev).where(F.col("prev").isNull() | (F.col("f") != F.col("prev")))
    ties = Window.partitionBy("f")
    rank = F.rank().over(Window.orderBy("f")) + (F.count("*").over(ties) - 1) / 2.0
    ranked = kept.withColumns({"r1": rank, "r2": F.row_number().over(order).cast("double")})
    return ranked.agg(F.when(F.count("*") >= 3, F.corr("r1", "r2")).alias("cbi"))


def schoener_d(df: DataFrame, a: str, b: str) -> DataFrame:
    """Niche overlap of two nonnegative surfaces; null if one of them is zero everywhere."""
    d = df.select(F.greatest(a, F.lit(0.0)).alias("a"), F.greatest(b, F.lit(0.0)).alias("b"))
    t = d.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return d.crossJoin(F.broadcast(t)).agg((1 - 0.5 * F.sum(F.abs(F.try_divide("a", "ta") - F.try_divide("b", "tb")))).alias("d"))  # t is one row


def kappa(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Agreement and Cohen's kappa of two yes/no columns."""
    x, y = a.cast("double"), b.cast("double")
    m = df.agg(F.avg((a == b).cast("double")).alias("agreement"), F.avg(x).alias("a"), F.avg(y).alias("b"))
    pe = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return m.select("agreement", F.when(pe < 1, (F.col("agreement") - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))


def predictor_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation, mean differences and ratio of median sizes; null under three rows."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = F.count("*") >= 3
    out = d.agg(
        F.when(n, F.corr(a, b)).alias("pearson_r"), F.when(n, F.avg(F.col(b) - F.col(a))).alias("mean_diff"),
        F.when(n, F.avg(F.abs(F.col(b) - F.col(a)))).alias("mean_abs_diff"), n.alias("_enough"),
    )
    # three tables of one row each
    for name, c in (("_ma", a), ("_mb", b)):
        out = out.crossJoin(F.broadcast(quantiles(d, F.abs(F.col(c)), {name: 0.5})))
    return out.withColumn("scale_ratio", F.when(F.col("_enough") & (F.col("_ma") > 0), F.col("_mb") / F.col("_ma"))).drop("_enough", "_ma", "_mb")


def rates(pred: DataFrame, threshold: Column) -> tuple[Column, Column]:
    """Sensitivity and background specificity at a threshold, as aggregate expressions."""
    sens = F.avg(F.when(F.col("y") == 1, (F.col("s") >= threshold).cast("double")))
    spec = F.avg(F.when(F.col("y") == 0, (F.col("s") < threshold).cast("double")))
    return sens, spec


def equal_rates_threshold(pred: DataFrame, points: int = 201) -> DataFrame:
    """The threshold among presence scores and background quantiles where sensitivity and specificity are closest (lowest of equal ones); null without both classes."""
    background = quantile_points(pred.where("y = 0"), "s", [i / (points - 1) for i in range(points)])
    grid = background.select(F.col("v").alias("s")).unionAll(pred.where("y = 1").select("s")).distinct()
    # counts below each grid point
    t = _score_counts(pred, []).withColumn("g", F.lit(0)).unionByName(grid.select("s", F.lit(0).cast("long").alias("n1"), F.lit(0).cast("long").alias("n0"), F.lit(1).alias("g")))
    t = t.groupBy("s").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.max("g").alias("g"))
    whole = pred.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    t = running(t, "s", {"b1": F.col("n1"), "b0": F.col("n0")}).crossJoin(F.broadcast(whole))  # one row
    gap = F.abs(F.try_divide(F.col("p") - F.col("b1"), F.col("p")) - F.try_divide("b0", "q"))
    return t.where("g = 1").agg(F.min_by("s", F.when(gap.isNotNull(), F.struct(gap, F.col("s")))).alias("threshold"))


def percentiles(df: DataFrame, column: str, at: dict[str, float]) -> DataFrame:
    """Exact percentiles by linear interpolation."""
    return quantiles(df, column, at)


def trimmed_max(df: DataFrame, column: str) -> DataFrame:
    """The third quartile plus 1.5 interquartile ranges, at most the largest finite value."""
    inf = float("inf")
    d = df.where(~F.isnan(column) & (F.abs(column) < inf))
    q = quantiles(d, column, {"q1": 0.25, "q3": 0.75, "m": 1.0})
    return q.select(F.least(F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")), F.col("m")).alias("trimmed_max"))


def covariance(df: DataFrame, columns: list[str]) -> tuple[list[float], list[list[float]], int]:
    """Means, sample covariance matrix and row count from one aggregation (p x p numbers reach the driver)."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    r = df.dropna(subset=columns).agg(F.count("*"), *[F.avg(c) for c in columns], *[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).first()
    p = len(columns)
    cov = [[0.0] * p for _ in range(p)]
    for (i, j), v in zip(pairs, r[1 + p :], strict=True):
        cov[i][j] = cov[j][i] = v
    return list(r[1 : 1 + p]), cov, r[0]


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation factors from the correlation matrix; infinite for an exact dependence or a constant."""
    import numpy as np

    _, cov, _ = covariance(df, columns)
    c = np.array(cov, dtype=float)
    out = {}
    for j, name in enumerate(columns):
        rest = [i for i in range(len(columns)) if i != j]
        if not rest:
            out[name] = 1.0
            continue
        beta = np.linalg.lstsq(c[np.ix_(rest, rest)], c[rest, j], rcond=1e-12)[0]
        r2 = float(c[j, rest] @ beta / c[j, j]) if c[j, j] > 0 else 1.0
        out[name] = float("inf") if r2 >= 1 - 1e-10 else 1 / (1 - r2)
    return out


def low_collinearity(df: DataFrame, columns: list[str], limit: float = 5.0, protected: tuple[str, ...] = ()) -> list[str]:
    """Drop the largest factor until all are under ``limit``; protected columns and the last two stay."""
    kept = list(columns)
    while len(kept) > 2:
        factors = vif(df, kept)
        worst = max((c for c in kept if c not in protected), key=lambda c: (factors[c], -kept.index(c)), default=None)
        if worst is None or factors[worst] < limit:
            break
        kept.remove(worst)
    return kept
