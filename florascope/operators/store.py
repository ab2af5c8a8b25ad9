"""Relational store operations on DataFrames: keyed appends, patches, pages and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_nth = 1").drop("_nth")


def append_fill_once(old: DataFrame, new: DataFrame, key: list[str], fill: list[str]) -> DataFrame:
    """Old rows unchanged but for ``fill`` columns that are still null; new keys added once. ``inserted`` tells them apart."""
    fresh = new.dropDuplicates(key)
    joined = old.withColumn("_old", F.lit(1)).alias("o").join(fresh.alias("n"), key, "full_outer")
    known = F.col("o._old").isNotNull()
    cols = [F.when(known, F.coalesce(f"o.{c}", f"n.{c}") if c in fill else F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns if c not in key]
    return joined.select(*key, *cols, (~known).alias("inserted"))


def append_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows and the new ones with a new key (first of repeated keys is arbitrary)."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def fill_where_null(df: DataFrame, values: DataFrame, key: list[str], columns: list[str], guard: str) -> DataFrame:
    """``columns`` taken from ``values`` on rows whose ``guard`` column is null."""
    v = values.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    filled = {c: F.when(F.col(guard).isNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return df.join(v, key, "left").withColumns(filled).drop(*[f"_{c}" for c in columns])


def upsert(old: DataFrame, new: DataFrame, key: list[str], ts: str) -> DataFrame:
    """The last write per key; on equal times the new row wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_per_key(both, key, [F.desc(ts), F.desc("_new")]).drop("_new")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page and the total number of rows on each of its rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def after_id(df: DataFrame, id_col: str, cursor: int, size: int) -> DataFrame:
    """Keyset page: the next ``size`` rows above ``cursor``."""
    return df.where(F.col(id_col) > cursor).orderBy(id_col).limit(size)


def effective_annotations(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest value of each kind for each record, with the number of events and the last author and time."""
    by = F.struct(*order)
    kinds = ["range_label", "exclude", "cultivated", "verified"]
    values = log.groupBy(*key).agg(
        *[F.max_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, by)).alias(k) for k in kinds],
        F.count("*").alias("n_annotations"), F.max_by("author", by).alias("last_author"), F.max(order[0]).alias("last_ts"),
    )
    return values.withColumns({k: F.col(k) == "true" for k in kinds[1:]})


def apply_annotations(occ: DataFrame, effective: DataFrame, key: list[str], excluded: str = "excluded", label: str = "range_label") -> DataFrame:
    """Exclusion and range label after expert annotations; ``rescued`` rows are kept by a verification."""
    e = effective.select(*key, *[F.col(c).alias(f"_{c}") for c in ("range_label", "exclude", "cultivated", "verified")])
    d = occ.join(e, key, "left")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    drop = on("_exclude") | on("_cultivated")
    return d.withColumns({
        "rescued": F.col(excluded) & on("_verified") & ~drop,
        "relabelled": F.col("_range_label").isNotNull() & ~F.col("_range_label").eqNullSafe(F.col(label)),
        "by_annotation": drop,
        excluded: (F.col(excluded) & ~on("_verified")) | drop,
        label: F.coalesce("_range_label", label),
    }).drop("_range_label", "_exclude", "_cultivated", "_verified")
