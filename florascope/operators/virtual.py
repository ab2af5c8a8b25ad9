"""Virtual species: a known truth, biased sampling and how well models recover it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models, sampling, stats


def benchmark(cells: DataFrame, effort: DataFrame, n: int = 800, seed: int = 5) -> DataFrame:
    """``variant, schoener_d, rho`` of a model fitted on unbiased and on effort-biased draws, with and without the effort offset."""
    e = effort.groupBy(F.floor(F.col("px_row") / 2.0).cast("int").alias("row"), F.floor(F.col("px_col") / 2.0).cast("int").alias("col")).agg(F.sum("cnt").alias("effort"))
    truth = cells.join(e, ["row", "col"], "left").na.fill(0, ["effort"]).withColumns({
        "id": (F.col("row") * 360 + F.col("col")).cast("long"),
        "truth": F.exp(-0.5 * F.pow((F.col("bio1") - 16.0) / 5.0, F.lit(2.0)) - 0.5 * F.pow((F.col("bio12") - 1100.0) / 500.0, F.lit(2.0))),
    })
    background = truth.select(F.lit(0).alias("y"), "bio1", "bio12", F.log1p("effort").alias("o"))
    out = None
    for variant, weight, offset in (("unbiased", F.col("truth"), None), ("biased", F.col("truth") * (F.col("effort") + 0.2), None), ("biased with offset", F.col("truth") * (F.col("effort") + 0.2), "o")):
        drawn = sampling.weighted_with_replacement(truth.withColumn("w", weight), "id", "w", n, seed).select(F.lit(1).alias("y"), "bio1", "bio12", F.log1p("effort").alias("o"))
        model = models.fit_ppm(drawn.unionByName(background), ["bio1", "bio12"], area=1000.0, offset=offset, rounds=10)
        scored = truth.select("truth", models.predict(model).alias("p"))
        part = stats.schoener_d(scored, "truth", "p").crossJoin(stats.spearman(scored, "truth", "p")).select(F.lit(variant).alias("variant"), F.col("d").alias("schoener_d"), "rho")  # one row each
        out = part if out is None else out.unionAll(part)
    return out
