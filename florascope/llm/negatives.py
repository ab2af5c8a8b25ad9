"""Hard-negative mining by a full sort of every anchor's integer scores.

Vectors and anchors are cut into parts of bounded size, and a tile is one block
of exact integer scores. Within a tile each anchor's scores are sorted by score
and id: the first walk reads its positives, the second searches every positive's
upper limit in the sorted order and reads the next rows of other labels down to
its lower limit. What tiles return is merged by the same order, so cutting
changes nothing, and no task holds all scores of an anchor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ANCHORS_EVERY = 100
RELABEL_EVERY = 7
LABELS = 10
SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: Per cent of a positive's score between which a negative's score lies.
LOWER, UPPER = 30, 90
#: Largest tile: vectors and anchors.
TILE_VECTORS = 20_000
TILE_ANCHORS = 4_000


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, x``: rows that take part, with their integer components; of rows that share an id the smallest by label and vector."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("given"), F.transform(F.col(vector_col), lambda c: c.cast("double")).alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    v = v.where(F.col("vec_id").isNotNull() & F.col("given").isNotNull() & F.col("v").isNotNull() & ~bad)
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("given") + 1) % LABELS).otherwise(F.col("given"))
    v = v.select("vec_id", moved.alias("label"), F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE)))).alias("x"))
    return v.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, as long as they fit 64 bits."""
    bound = max(rows.shape[1], 1) * max(1, int(abs(anchors).max(initial=0))) * max(1, int(abs(rows).max(initial=0)))
    if bound < 2**53:  # every partial sum is exact in double precision
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    if bound < 2**63:
        return anchors @ rows.T
    raise OverflowError("scores exceed 64 bits")


def _tile(a: pd.DataFrame, b: pd.DataFrame, read: Callable[[pd.Series, np.ndarray, np.ndarray, np.ndarray], list[tuple]], columns: list[str]) -> pd.DataFrame:
    """Sort the scores of each anchor in ``b`` over the rows of ``a``; ``read(anchor, ids, scores, same)`` takes its own from them."""
    out: list[tuple] = []
    if len(a) and len(b):
        a = a.sort_values("vec_id", kind="stable")  # a stable sort by score then leaves ties by id
        ids, labels, rows = a["vec_id"].to_numpy(), a["label"].to_numpy(), np.stack(a["x"].to_numpy())
        anchors = np.stack(b["x"].to_numpy())
        for at in range(0, len(b), 64):  # bounded memory
            s = scores(anchors[at : at + 64], rows)
            for i, order in enumerate(np.argsort(-s, axis=1, kind="stable")):
                anchor = b.iloc[at + i]
                order = order[ids[order] != anchor["anchor_id"]]
                out += read(anchor, ids[order], s[i, order], labels[order] == anchor["label"])
    return pd.DataFrame(out, columns=columns).astype("int64")


def limits(score: np.ndarray, positive: int, lower: int, upper: int) -> tuple[int, int]:
    """Where in descending scores those of ``lower * positive <= 100 * score <= upper * positive`` begin and end."""
    return int(np.searchsorted(-100 * score, -upper * positive, "left")), int(np.searchsorted(-100 * score, -lower * positive, "right"))


def mine(
    vectors: DataFrame, every: int = ANCHORS_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for anchors, whose ids are divisible by ``every``.

    Scores are inner products of ``floor(256 * c)``; higher ones come first, ties
    by smaller id. Rows with a null id, label or vector, or with null or
    non-finite components, take no part, nor do vectors whose length is not the
    most common one (ties: the shorter). Repeated rows count once; of different
    rows that share an id the smallest by label, then by vector, counts. Labels
    are changed before that as the module's constants say. An anchor without
    positives, and a positive without negatives in its limits (as any below zero),
    have no rows. Scores beyond 64 bits raise. No rows give no rows. Extra
    columns are not read.
    """
    v = usable(vectors, id_col, vector_col, label_col)
    top = v.where(F.size("x") > 0).groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    v = materialize(v.where(F.size("x") == (top["dim"] if top else -1)), "negatives-rows")
    anchors = v.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "anchor_id")
    vparts, aparts = (max(1, -(-rows.count() // size)) for rows, size in ((v, TILE_VECTORS), (anchors, TILE_ANCHORS)))
    part = lambda name, parts: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    every_part = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = v.select(part("vec_id", vparts).alias("vp"), every_part(aparts).alias("ap"), "vec_id", "label", "x").groupBy("vp", "ap")

    def tiles(asked: DataFrame, read: Callable, columns: list[str]) -> DataFrame:
        asked = asked.select(every_part(vparts).alias("vp"), part("anchor_id", aparts).alias("ap"), "*").groupBy("vp", "ap")
        return dealt.cogroup(asked).applyInPandas(lambda a, b: _tile(a, b, read, columns), ", ".join(f"{c} long" for c in columns))

    def alike(anchor: pd.Series, ids: np.ndarray, s: np.ndarray, same: np.ndarray) -> list[tuple]:
        at = np.flatnonzero(same)[:positives]
        return [(anchor["anchor_id"], i, x) for i, x in zip(ids[at].tolist(), s[at].tolist(), strict=True)]

    def unlike(anchor: pd.Series, ids: np.ndarray, s: np.ndarray, same: np.ndarray) -> list[tuple]:
        ids, s, out = ids[~same], s[~same], []
        for positive in anchor["positives"]:
            start, end = limits(s, positive["score"], lower, upper)
            at = slice(start, min(end, start + negatives))
            out += [(anchor["anchor_id"], positive["id"], i, positive["score"], x) for i, x in zip(ids[at].tolist(), s[at].tolist(), strict=True)]
        return out

    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    found = tiles(anchors, alike, ["anchor_id", "positive_id", "score"]).withColumn("r", first).where(F.col("r") <= positives)
    found = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(F.col("positive_id").alias("id"), "score"))).alias("positives"))
    asked = materialize(anchors.join(found, "anchor_id"), "negatives-anchors")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    got = tiles(asked, unlike, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]).withColumn("rank", rank)
    return got.where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
