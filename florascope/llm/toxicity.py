"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of a text (UTF-8 bytes, ASCII
lower-cased), hashed to ``2**BITS`` buckets. Each is scaled by the log ratio of
its smoothed document frequencies in the two classes, and a logistic regression
is fitted on the scaled features. The model is fitted in one task on a sample of
labelled rows that is bounded by ``MAX_TRAIN`` rows and ``MAX_BYTES`` for each
class; every text is scored whole, where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, text_key

ORDERS = (3, 4, 5)
BITS = 20
#: Labelled rows of each class that a model is fitted on at most, chosen by a hash of their ids.
MAX_TRAIN = {1: 1500, 0: 2500}
#: Bytes of UTF-8 text of each class that a model is fitted on at most.
MAX_BYTES = 32 << 20
#: N-grams that the model keeps: those whose frequency differs most between the classes (the README gives the cost in AUC).
FEATURES = 4_000
THRESHOLD = 0.7
RIDGE = 1.0
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint32)
_SLICE = 1 << 21


def ngram_buckets(raw: bytes, order: int) -> np.ndarray:
    """A bucket for each position of an n-gram of ``order`` bytes."""
    a = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
    if len(a) < order:
        return np.empty(0, np.int32)
    h = a[: len(a) - order + 1].copy()
    for k in range(1, order):
        h *= np.uint32(0x01000193)
        h ^= a[k : len(a) - order + 1 + k]
    h *= np.uint32(2654435761)
    h += np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def distinct_buckets(raw: bytes) -> np.ndarray:
    """The distinct buckets of a whole text; long texts are hashed in slices."""
    seen = [np.unique(ngram_buckets(raw[max(0, at - n + 1) : at + _SLICE], n)) for n in ORDERS for at in range(0, max(len(raw), 1), _SLICE)]
    return np.unique(np.concatenate(seen))


def fit(texts: list[bytes], y: np.ndarray, prior: float, features: int = FEATURES, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, float]:
    """``buckets, weights, intercept``; rows are weighted so that the classes have their share in all labelled rows."""
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    found = [distinct_buckets(t) for t in texts]
    counts = np.zeros((2, 1 << BITS))
    for b, c in zip(found, y, strict=True):
        counts[int(c), b] += 1
    p, q = (counts[1] + 1) / (n1 + 2), (counts[0] + 1) / (n0 + 2)
    ratio = np.log(p / q)
    gain = np.abs(p - q) / np.sqrt(p * (1 - p) / n1 + q * (1 - q) / n0)
    gain[counts.sum(axis=0) < 3] = 0
    chosen = np.sort(np.argsort(-gain, kind="stable")[:features])
    chosen = chosen[gain[chosen] > 0]
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    rows = [place[b] for b in found]
    rows = [r[r >= 0] for r in rows]
    sizes = np.array([len(r) for r in rows])
    cols = np.concatenate(rows) if len(rows) else np.empty(0, np.int32)
    of = np.repeat(np.arange(len(rows)), sizes)
    r = ratio[chosen]
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, prior / n1, (1 - prior) / n0) * len(y)
    value = r[cols]

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(of, weights=v[:-1][cols] * value, minlength=len(rows)) + v[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        f = float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * ridge * (v[:-1] ** 2).sum())
        g = weight * (s - y)
        return f, np.append(np.bincount(cols, weights=g[of] * value, minlength=len(r)) + ridge * v[:-1], g.sum())

    v = minimise(loss, np.zeros(len(r) + 1))
    w = v[:-1] * r
    return chosen, w, float(v[-1])


def minimise(loss, x: np.ndarray, rounds: int = 40, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search."""
    f, g = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alphas = -g, []
        for s, t in reversed(pairs):
            alphas.append(s @ d / (s @ t))
            d = d - alphas[-1] * t
        if pairs:
            d = d * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]))
        for (s, t), a in zip(pairs, reversed(alphas), strict=True):
            d = d + (a - t @ d / (s @ t)) * s
        step, slope = (1.0 if pairs else 1.0 / max(1.0, np.abs(g).sum())), g @ d
        while True:
            f2, g2 = loss(x + step * d)
            if f2 <= f + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, t = step * d, g2 - g
        if s @ t > 1e-12:
            pairs = [*pairs, (s, t)][-memory:]
        done = abs(f - f2) <= 1e-5 * max(1.0, abs(f))
        x, f, g = x + s, f2, g2
        if done:
            break
    return x


def train_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, most: dict[int, int], id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MAX_BYTES
) -> tuple[DataFrame, float]:
    """``text, y, _id`` of a bounded sample of the labelled rows that ``learn`` admits, and the share of label 1 in all of them.

    An id gives one row: ids labelled both ways teach nothing, and of several
    texts under one id the one with the smallest digest is taken. Within a class
    rows are taken in the order of a hash of their ids, at most ``most`` and at
    most ``most_bytes`` of text in all; a text that no longer fits is left out.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & learn).groupBy(F.col(id_col).alias("_id"))
    known = known.agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("y2")).where("y = y2").select("_id", "y")
    share = known.agg(F.avg("y")).first()[0]
    picked = None
    for c, n in most.items():
        part = known.where(F.col("y") == c).orderBy(F.xxhash64("_id"), "_id").limit(n)
        picked = part if picked is None else picked.unionAll(part)
    picked = F.broadcast(materialize(picked, "train-ids"))  # at most sum(most) ids
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # one text for each id, known by its digest, before any text is moved
    keyed = given.select("_id", text_key(F.col("text")).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).join(picked, "_id")
    keyed = keyed.groupBy("_id", "y").agg(F.min(F.struct("key", "size")).alias("k")).select("_id", "y", "k.*")
    so_far = Window.partitionBy("y").orderBy(F.xxhash64("_id"), "_id")  # over at most sum(most) rows
    fits = materialize(keyed.withColumn("bytes", F.sum("size").over(so_far)).where(F.col("bytes") <= most_bytes).select(F.col("_id").alias("_id2"), "y", F.col("key").alias("key2")), "train-rows")
    texts = given.join(F.broadcast(fits), (F.col("_id") == F.col("_id2")) & (text_key(F.col("text")) == F.col("key2")))
    return texts.groupBy("_id", "y").agg(F.first("text").alias("text")).select("text", "y", "_id"), float(share if share is not None else 0.0)


def model_of(sample: DataFrame, prior: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """The fitted model, or none if no labelled row of either class is given."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(i, (t or "").encode(), y) for p in parts for i, t, y in zip(p["_id"], p["text"], p["y"], strict=True)]
        rows.sort()  # the same fit whatever the order of arrival
        y = np.array([r[2] for r in rows], dtype=np.int64)
        if len(rows) and 0 < y.sum() < len(y):
            b, w, c = fit([r[1] for r in rows], y, prior)
            yield pd.DataFrame({"b": [b.astype("<i4").tobytes()], "w": [w.astype("<f8").tobytes()], "c": [c]})

    got = sample.repartition(1).mapInPandas(run, "b binary, w binary, c double").collect()  # one row
    return [(np.frombuffer(bytes(r["b"]), "<i4"), np.frombuffer(bytes(r["w"]), "<f8"), r["c"]) for r in got]


def text_score(raw: bytes, table: np.ndarray, c: float) -> float:
    hits = []
    for n in ORDERS:
        for at in range(0, max(len(raw), 1), _SLICE):
            h = ngram_buckets(raw[max(0, at - n + 1) : at + _SLICE], n)
            hits.append(h[table[h] != 0])
    z = c + float(table[np.unique(np.concatenate(hits))].sum())
    return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def score(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """``doc_id, score`` for every row, or all columns of ``docs`` and the score under the name ``keep``.

    Labels, language, source and ids are never features. Null and empty texts
    get the intercept's score; very long texts are scored whole. Labels that are
    null or neither 0 nor 1 are ignored, as are ids labelled both ways; without
    labels of both classes every score is the share of label 1 (0 if there are
    none). Repeated rows are scored alike; no rows give no rows. Other columns,
    whatever their names, are not read, and with ``keep`` pass through unchanged.
    """
    spark = docs.sparkSession
    sample, prior = train_sample(docs, labels, "toxic", learn, MAX_TRAIN, id_col, text_col)
    fitted = model_of(sample, prior)
    sent = spark.sparkContext.broadcast(fitted[0] if fitted else None)  # at most FEATURES buckets
    given = docs if keep else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    at = given.columns.index(text_col if keep else "text")
    names = [*given.columns, keep] if keep else ["doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        table = np.zeros(1 << BITS)
        if model is not None:
            table[model[0]] = model[1]
        for b in batches:
            texts = b.column(at).cast(pa.binary())
            s = [prior if model is None else text_score(t.as_buffer().to_pybytes() if t.is_valid else b"", table, model[2]) for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.columns if keep else b.columns[:1]), pa.array(s, pa.float64())], names)

    kept = T.StructType([*(given.schema if keep else given.select("doc_id").schema), T.StructField(names[-1], T.DoubleType())])
    return given.mapInArrow(run, kept)


def held_out(id_col: str, divisor: int, remainder: int) -> Column:
    """crc32 of the id as text leaves ``remainder``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor == remainder


def drop_toxic(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic.

    A row goes by its own text alone, so rows that share an id or have none may
    differ; repeated rows share their fate. Null, empty and very long texts are
    scored like any other (see ``score``); without labels nothing can be told, and
    no row goes unless the share of label 1 reaches the threshold. No rows give no
    rows. Other columns, whatever their names, pass through unchanged.
    """
    name = fresh(docs.columns, "score")
    return score(docs, labels, learn, id_col, text_col, keep=name).where(F.col(name) < THRESHOLD).drop(name)
