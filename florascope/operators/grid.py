"""Grid operators: a grid is a table of cells keyed by row and column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florascope.functions.geo import cell_area_km2

from .order import running

#: Distinct reference values of a predictor that are sent to the cells at most.
LOOK_UP = 200_000

#: Zone and change codes.
ZONES = {0: "not suitable", 1: "native range (suitable)", 2: "established outside native range", 3: "candidate invasion / expansion zone"}
CHANGES = {0: "stable unsuitable", 1: "gain", 2: "loss", 3: "stable suitable"}
LIMITING_NONE = 254


def zones(suitable: Column, native: Column, occupied: Column) -> Column:
    """Zone code; the native range wins over occupied cells."""
    return F.when(suitable & native, 1).when(suitable & occupied, 2).when(suitable, 3).otherwise(0)


def similarity(f: Column, t: Column, lo: Column, hi: Column) -> Column:
    """MESS similarity from the percentage ``f`` of reference values under ``t``."""
    span = F.when(hi > lo, hi - lo).otherwise(1e-12)
    return F.when(f == 0, (t - lo) / span * 100.0).when(f <= 50, f * 2.0).when(f < 100, (F.lit(100.0) - f) * 2.0).otherwise((hi - t) / span * 100.0)


def mess_one(reference: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """``target`` with ``sim_<column>``: exact counts strictly below, from the ordered union of distinct values in range buckets."""
    ref = _reference_values(reference, column)
    n = ref.agg(F.sum("m").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
    own = _number(column)
    both = ref.unionAll(target.where(own.isNotNull()).select(own.alias("v"), F.lit(0).cast("long").alias("m"))).groupBy("v").agg(F.sum("m").alias("m"))
    f = running(both, "v", {"below": F.col("m")}).crossJoin(F.broadcast(n))  # one row
    f = f.select("v", similarity(F.col("below") * 100.0 / F.col("n"), F.col("v"), F.col("mn"), F.col("mx")).alias(f"sim_{column}"))
    return target.withColumn("_own", own).join(f, F.col("_own") == F.col("v"), "left").drop("v", "_own")


def _number(column: str) -> Column:
    """A predictor as a double; null and NaN are no value, on the side of the reference and on that of the cells."""
    v = F.col(column).cast("double")
    return F.when(~F.isnan(v), v + F.lit(0.0))


def _reference_values(reference: DataFrame, column: str) -> DataFrame:
    """``v, m``: the distinct values of a predictor and their counts."""
    return reference.select(_number(column).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("m"))


def _mess_looked_up(target: DataFrame, tables: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``target`` with ``sim_<column>`` for each table of distinct reference values and their counts; cells are not moved."""
    sent = target.sparkSession.sparkContext.broadcast(tables)

    def look_up(column: str) -> Column:
        @F.pandas_udf("double")
        def sim(v: pd.Series) -> pd.Series:
            values, counts = sent.value[column]
            below = np.append(0, counts.cumsum())
            t = v.to_numpy(dtype=float)
            f = below[np.searchsorted(values, t, side="left")] * 100.0 / below[-1]
            lo, hi = values[0], values[-1]
            span = hi - lo if hi > lo else 1e-12
            out = np.where(f == 0, (t - lo) / span * 100.0, np.where(f <= 50, f * 2.0, np.where(f < 100, (100.0 - f) * 2.0, (hi - t) / span * 100.0)))
            return pd.Series(out).where(~np.isnan(t), None)

        return sim(F.col(column).cast("double"))

    return target.withColumns({f"sim_{c}": look_up(c) for c in tables})


def mess(reference: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """``target`` with ``mess`` and ``most_dissimilar``, the first predictor of the smallest similarity; null if any predictor is null.

    NaN is null, in the reference and in the cells. A predictor whose distinct
    reference values are counted and few goes to the cells as a sorted table; for
    others the cells are ordered against it, with the same result.
    """
    d, tables = target, {}
    for c in columns:
        few = _reference_values(reference, c).limit(LOOK_UP + 1).toPandas()
        if 0 < len(few) <= LOOK_UP:
            few = few.sort_values("v")
            tables[c] = (few["v"].to_numpy(), few["m"].to_numpy())
        else:
            d = mess_one(reference, d, c)
    d = _mess_looked_up(d, tables) if tables else d
    sims = F.array(*[f"sim_{c}" for c in columns])
    complete = F.forall(sims, lambda x: x.isNotNull())
    names = F.array(*[F.lit(c) for c in columns])
    least = F.array_min(sims)
    return d.withColumns({"mess": F.when(complete, least), "most_dissimilar": F.when(complete, F.element_at(names, F.array_position(sims, least).cast("int")))}).drop(*[f"sim_{c}" for c in columns])


def change_code(before: Column, after: Column) -> Column:
    return after.cast("int") + before.cast("int") * 2


def priority(suitability: Column, effort: Column, most_effort: Column, uncertainty: Column) -> Column:
    """Suitable, little surveyed and uncertain cells score highest."""
    e = F.log10(effort + 1.0) / F.when(most_effort > 0, F.log10(most_effort + 1.0)).otherwise(1.0)
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    return clip(suitability) * (1 - clip(e)) * (0.5 + 0.5 * uncertainty)


def area(lat: str = "lat", res: float = 1.0) -> Column:
    return cell_area_km2(F.col(lat), res)


def tile_label(lat: Column, lon: Column) -> Column:
    """Name of the 10 degree tile that holds a place."""
    top, left = (F.floor(lat / 10) * 10 + 10).cast("int"), (F.floor(lon / 10) * 10).cast("int")
    side = lambda x, pos, neg: F.concat(F.abs(x).cast("string"), F.when(x >= 0, pos).otherwise(neg))
    return F.concat(side(top, "N", "S"), F.lit(" "), side(left, "E", "W"))


def overlay(grids: dict[str, DataFrame], value: str) -> DataFrame:
    """Grids on the same cells side by side, one column each (cells that are in all)."""
    out = None
    for name, g in grids.items():
        part = g.select("row", "col", F.col(value).alias(name))
        out = part if out is None else out.join(part, ["row", "col"])
    return out


def ensemble(members: DataFrame, threshold: float) -> DataFrame:
    """Per cell over scenario members: mean, votes, any and all extrapolated; cells that at least two members share."""
    return members.groupBy("row", "col", "lat").agg(
        F.avg("suitability").alias("mean_suitability"), F.count_if(F.col("suitability") >= threshold).alias("votes"), F.count("*").alias("members"),
        F.bool_or("extrapolated").alias("any_extrapolated"), F.bool_and("extrapolated").alias("all_extrapolated"),
    ).where("members >= 2")


def limiting(base: Column, gains: dict[str, Column]) -> Column:
    """The predictor whose replacement raises the prediction most, ``none`` if none raises it (first of equal ones)."""
    diffs = F.array(*[g - base for g in gains.values()])
    names = F.array(*[F.lit(n) for n in gains])
    top = F.array_max(diffs)
    return F.when(top <= 1e-6, "none").otherwise(F.element_at(names, F.array_position(diffs, top).cast("int")))
