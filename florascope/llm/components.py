"""Connected components of an edge list by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize, new_path


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return r["n"], r["x"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(u, v)`` long pairs to ``(node, root)``; root is the smallest node of the component.

    Nodes without an edge are not returned. Every round is two aggregations and
    joins on the node; the edge list never grows and is written to the shared
    folder each round, so lineage stays short. Only two numbers a round reach
    the driver. A round's table is deleted once the next one is written.
    """
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", path)
    state = _state(e)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        last, path = path, new_path(spark, "edges")
        e = materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct(),
            "edges",
            path,
        )
        new = _state(e)
        drop_path(spark, last)
        if new == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = new
    if state[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
