"""Severity composite, confidence rules and ensemble weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the components.
WEIGHTS = {"suitability": 0.35, "climate_analogy": 0.25, "spread_rate": 0.20, "ecological_impact_prior": 0.20}


def _clip(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def score(suitability: Column, fraction: Column, envelope: Column, cells_per_year: Column, impact: Column | float = 0.5, saturation: float = 0.10, half: float = 5.0, weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the four components, weights normalised."""
    total = sum(weights.values())
    rate = F.greatest(cells_per_year, F.lit(0.0))
    parts = {
        "suitability": _clip(suitability * F.least(F.lit(1.0), fraction / saturation)), "climate_analogy": _clip(envelope), "spread_rate": rate / (rate + half),
        "ecological_impact_prior": impact if isinstance(impact, Column) else F.lit(float(impact)),
    }
    return sum((parts[k] * (weights[k] / total) for k in weights), F.lit(0.0))


def category(s: Column) -> Column:
    return F.when(s >= 0.75, "very high").when(s >= 0.5, "high").when(s >= 0.25, "moderate").otherwise("low")


def confidence(model_type: Column, extrapolated: Column, analog: Column, mess_out: Column, cbi: Column, low: float = 0.25, moderate: float = 0.10, least_analog: float = 0.60, most_mess: float = 0.25, least_cbi: float = 0.20):
    """A function from the reasons to the level, and the array of reasons that lower it."""
    reasons = F.array_compact(F.array(
        F.when(model_type == "A", F.lit("model_a")), F.when(extrapolated > low, F.lit("extrapolated_low")).when(extrapolated > moderate, F.lit("extrapolated_moderate")),
        F.when(analog < least_analog, F.lit("few_analogs")), F.when(mess_out > most_mess, F.lit("mess_cap")), F.when(cbi < least_cbi, F.lit("cbi_floor")),
    ))
    strong = F.array(F.lit("model_a"), F.lit("extrapolated_low"))
    return lambda r: F.when(F.arrays_overlap(r, strong), "low").when(F.size(r) > 0, "moderate").otherwise("high"), reasons


def ensemble_weights(members: DataFrame, least: float) -> DataFrame:
    """Weights by AUC above one half for members that reach ``least``; equal weights if none does."""
    every = Window.partitionBy()  # a row for each member
    w = F.when(F.max("auc").over(every) >= least, F.when(F.col("auc") >= least, F.col("auc") - 0.5).otherwise(0.0)).otherwise(1.0)
    d = members.withColumn("w", w)
    return d.withColumn("weight", F.col("w") / F.sum("w").over(every)).where("w > 0").drop("w")
