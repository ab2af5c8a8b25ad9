"""Quality: histogram gradient-boosted trees over document statistics.

Statistics are computed from a whole text with numpy; trees are grown level by
level from histograms of quantile bins, and stored as flat arrays of split
features and thresholds, so that a batch of rows walks all trees at once. The
model is fitted in one task on a sample of labelled rows bounded by ``MAX_TRAIN``
rows and ``toxicity.MAX_BYTES`` for each class; every text is scored whole, where
it lies.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .toxicity import train_sample

#: Labelled rows of each class that a model is fitted on at most, chosen by a hash of their ids.
MAX_TRAIN = {1: 3000, 0: 3000}
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.15
RIDGE = 1.0
THRESHOLD = 0.3

#: Byte classes whose shares are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n\r",
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*@^~<>=+\\/_{}[]",
    "quote": b"\"'`()-",
    "high": bytes(range(128, 256)),
}
_TABLE = np.array([[b in members for members in CLASSES.values()] for b in range(256)], dtype=np.float64)
STATISTICS = [
    "log_bytes", "log_words", "log_lines", "word_length", "longest_word", "line_length", "distinct_words", "top_word", "top_bigram",
    "distinct_lines", "no_letter_words", "capital_words", "marked_words", "entropy", "squeeze", *CLASSES,
]


def statistics(raw: bytes) -> list[float]:
    """The statistics of one UTF-8 text, in the order of STATISTICS; all zero for an empty text."""
    if not raw:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    k = max(1, len(words))
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    share = counts[counts > 0] / n
    kinds = seen.items()
    no_letter = sum(c for w, c in kinds if not w.lower().islower())
    capital = sum(c for w, c in kinds if w.isupper() and len(w) > 1)
    marked = sum(c for w, c in kinds if not w.rstrip(b".,").isalnum() and not any(x > 127 for x in w))
    squeezed = sum(len(zlib.compress(raw[at : at + 65536], 1)) for at in range(0, n, 65536))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), sum(len(w) * c for w, c in kinds) / k, float(np.log1p(max(map(len, seen), default=0))), float(np.log1p(n / len(lines))),
        len(seen) / k, max(seen.values(), default=0) / k, max(pairs.values(), default=0) / k, len(set(lines)) / len(lines), no_letter / k, capital / k, marked / k,
        float(-(share * np.log2(share)).sum()), squeezed / n, *(counts @ _TABLE / n).tolist(),
    ]


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> dict[str, np.ndarray]:
    """Boosted trees for the logistic loss, flattened: inner nodes ``2**depth - 1`` and leaves ``2**depth`` of each tree."""
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # x <= edge goes left
    p0 = float((weight * y).sum() / weight.sum())
    base = float(np.log(p0 / (1 - p0)))
    z = np.full(n, base)
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, value = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    columns = np.arange(f) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            width = 1 << d
            at = ((node * f * BINS)[:, None] + columns + binned).ravel()
            gs = np.bincount(at, np.repeat(g, f), width * f * BINS).reshape(width, f, BINS).cumsum(axis=2)
            hs = np.bincount(at, np.repeat(h, f), width * f * BINS).reshape(width, f, BINS).cumsum(axis=2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + RIDGE) + (ga - gs) ** 2 / (ha - hs + RIDGE) - ga**2 / (ha + RIDGE)
            gain[(hs < 1) | (ha - hs < 1)] = -np.inf
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            j, b = best // BINS, best % BINS
            ok = gain[np.arange(width), j, b] > 1e-9
            cut = np.where(ok, b, BINS)
            feature[t, width - 1 : 2 * width - 1] = j
            threshold[t, width - 1 : 2 * width - 1] = [edges[a][c] if o else np.inf for a, c, o in zip(j, b, ok, strict=True)]
            node = 2 * node + (binned[np.arange(n), j[node]] > cut[node])
        gl, hl = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        value[t] = -RATE * gl / (hl + RIDGE)
        z += value[t][node]
    return {"feature": feature, "threshold": threshold, "value": value, "base": np.array([base])}


def walk(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Scores of the rows of ``x``: every row is at one node of each tree, and goes a level down in one step."""
    feature, threshold, value = model["feature"], model["threshold"], model["value"]
    trees, inner = feature.shape
    tree = np.arange(trees)
    node = np.zeros((len(x), trees), np.int64)
    for _ in range(int(np.log2(inner + 1))):
        down = np.take_along_axis(x, feature[tree, node], axis=1) > threshold[tree, node]
        node = 2 * node + 1 + down
    z = model["base"][0] + value[tree, node - inner].sum(axis=1)
    return 1 / (1 + np.exp(-z))


def _pack(model: dict[str, np.ndarray]) -> bytes:
    import io

    out = io.BytesIO()
    np.savez(out, **model)
    return out.getvalue()


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    import io

    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


def score(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row: the probability of label 1.

    Labels, language, source and ids are never features. Null and empty texts
    have all statistics zero; very long texts are scored whole. Labels that are
    null or neither 0 nor 1 are ignored, as are ids labelled both ways; without labels of both classes every score is the share of label 1
    (0 if there are none). Repeated rows are scored alike; no rows give no rows.
    Extra columns are not read.
    """
    spark = docs.sparkSession
    sample, prior = train_sample(docs, labels, "quality", learn, MAX_TRAIN, id_col, text_col)

    def train(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((i, y, statistics((t or "").encode())) for p in parts for i, t, y in zip(p["_id"], p["text"], p["y"], strict=True))
        y = np.array([r[1] for r in rows], dtype=np.float64)
        if len(rows) and 0 < y.sum() < len(y):
            share = min(max(prior, 1e-3), 1 - 1e-3)
            weight = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum())) * len(y)
            yield pd.DataFrame({"m": [_pack(grow(np.array([r[2] for r in rows]), y, weight))]})

    got = sample.repartition(1).mapInPandas(train, "m binary").collect()  # one row
    sent = spark.sparkContext.broadcast(bytes(got[0]["m"]) if got else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _unpack(sent.value) if sent.value is not None else None
        for b in batches:
            x = np.array([statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1).cast(pa.binary())]).reshape(-1, len(STATISTICS))
            s = np.full(len(x), prior) if model is None else np.concatenate([walk(model, x[at : at + 1024]) for at in range(0, len(x), 1024)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
