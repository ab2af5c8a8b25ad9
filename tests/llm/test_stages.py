"""The pipeline's stages and both classifiers against plain versions, over one table with every awkward case."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from florascope.llm import near, quality, toxicity
from tests.llm.test_llm import dedup_plain, jaccard, window_similarity

CLASH = ("score", "_text", "_id", "_nth", "n_lines", "n_dropped", "node", "row", "key", "id", "keep_id", "text2", "id2", "nth")
rng = random.Random(5)
WORDS = [f"w{k}" for k in range(300)]
prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
ITEM = prose(30)
BASE = prose(120)
NEAR = " ".join(w if k not in (50, 90) else "changed" for k, w in enumerate(BASE.split()))
LONG = prose(30_000)
CASES = [
    (1, None), (2, ""), (3, "  \r\n\t"), (None, BASE), (10, NEAR), (4, BASE), (4, BASE), (4, prose(40)), (5, f"{prose(20)} {ITEM.upper()}. {prose(20)}"), (5, prose(50)), (None, ITEM), (None, prose(60)), (None, prose(60)),
    (6, LONG), (7, f"{LONG} {ITEM}"), (8, f"menu\r\n\r\n{prose(30)}\r\nmenu\r"), (9, f"menu\r\n{prose(30)}"), (11, " ".join(ITEM.split()[:-1])), (12, "you horrible pest " * 3), (None, "you horrible pest " * 3), (12, prose(30)),
]


def table(spark):
    d = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in CASES], "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({c: F.lit("mine") for c in CLASH})


def rows(df):
    assert all(r[c] == "mine" for r in df.collect() for c in CLASH) and df.columns[-len(CLASH) :] == list(CLASH)
    return sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())


def listed(cases):
    return sorted((str(i), str(t)) for i, t in cases)


def test_line_stage(spark):
    want = dedup_plain([(i, t, "a") for i, t in CASES], 0.02, by_text=True)
    got = corpus_pipeline.drop_boilerplate(spark, table(spark), "")
    assert rows(got) == listed([(i, t) for (i, _), t in zip(CASES, want, strict=True)])
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect() if r["text"] is not None)


def test_near_duplicate_stage(spark):
    root = list(range(len(CASES)))
    for a, (_, s) in enumerate(CASES):
        for b, (_, t) in enumerate(CASES[:a]):
            if (not (s or "").split() and not (t or "").split()) or ((s or "").split() and (t or "").split() and jaccard(s, t) >= 0.8):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    groups = {}
    for r, case in zip(root, CASES, strict=True):
        groups.setdefault(r, []).append(case)
    want = [min(g, key=lambda c: (c[0] is None, c[0] or 0)) for g in groups.values()]
    got = rows(near.keep_one(table(spark)))
    assert [i for i, _ in got] == [str(i) for i, _ in listed(want)] and len(got) == len(groups)
    # texts of an id's own group only; the blank ones are one group
    assert {t for _, t in got if t.split() and t != "None"} == {t for _, t in want if t and t.split()}


def test_decontamination_stage(spark, monkeypatch):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: bench)

    def leaks(t):
        short = " ".join(ITEM.split()[:-1])
        return bool(t) and (t == short or window_similarity(t, ITEM) >= 0.8)

    assert rows(corpus_pipeline.drop_contaminated(spark, table(spark), "")) == listed([c for c in CASES if not leaks(c[1])])


def test_toxicity_stage(spark, monkeypatch):
    labels = spark.createDataFrame([(i, int(i == 12), 0) for i, _ in CASES if i] + [(9, 1, 0), (2, None, 0)], "doc_id long, toxic int, score int")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: labels)
    got = corpus_pipeline.drop_toxic(spark, table(spark), "")
    scores = {t: s for t, s in ((r["text"], r["p"]) for r in toxicity.score(table(spark), labels, ~toxicity.held_out("doc_id", 3, 1), keep="p").collect())}
    assert rows(got) == listed([c for c in CASES if scores[c[1]] < toxicity.THRESHOLD]) and len(scores) == len({t for _, t in CASES})


def test_training_sample_is_bounded_and_settled(spark):
    docs = spark.createDataFrame([(1, "same")] * 50 + [(1, "other"), (2, "x" * 900), (3, "y" * 200), (4, "z" * 200), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0), (4, 1), (5, 0), (1, 1), (None, 1)], "doc_id long, toxic int")
    sample, share = toxicity.train_sample(docs, labels, "toxic", F.lit(True), {1: 10, 0: 10}, most_bytes=500)
    got = {r["_id"]: (r["text"], r["y"]) for r in sample.collect()}
    # one text for an id, ids labelled both ways and texts beyond the bytes left out
    assert share == 0.25 and sample.count() == len(got) and got[1][1] == 1 and got[1][0] in ("same", "other") and 4 not in got and 2 not in got
    assert sum(len(t or "") for t, y in got.values() if y == 0) <= 500


def plain_bucket(gram: bytes, order: int) -> int:
    h = gram[0]
    for b in gram[1:]:
        h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
    h = h * 2654435761 & 0xFFFFFFFF
    h = (h + (order * 0x9E3779B1 & 0xFFFFFFFF)) & 0xFFFFFFFF
    h ^= h >> 15
    return (h * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - toxicity.BITS)


def test_ngram_model_equals_a_plain_one():
    texts = [f"{prose(6)} {'horrible pest' if k % 3 == 0 else 'green river'} {k}".encode() for k in range(60)] + [b"", b"ab", "Ünï É".encode()]
    y = np.array([int(k % 3 == 0) for k in range(60)] + [0, 0, 0])

    def grams(t):
        t = bytes(b + 32 if 65 <= b <= 90 else b for b in t)
        return {plain_bucket(t[i : i + n], n) for n in toxicity.ORDERS for i in range(len(t) - n + 1)}

    found = [grams(t) for t in texts]
    assert all(set(toxicity.distinct_buckets(t).tolist()) == g for t, g in zip(texts, found, strict=True))
    chosen, w, c = toxicity.fit(texts, y, prior=0.3, features=200)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    counts = [Counter(b for g, v in zip(found, y, strict=True) if v == k for b in g) for k in (0, 1)]
    ratio = {b: math.log(((counts[1][b] + 1) / (n1 + 2)) / ((counts[0][b] + 1) / (n0 + 2))) for b in chosen.tolist()}
    weight = np.where(y == 1, 0.3 / n1, 0.7 / n0) * len(y)
    x = np.array([[ratio[b] if b in g else 0.0 for b in chosen.tolist()] for g in found])

    def loss(v, bias):
        z = x @ v + bias
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * toxicity.RIDGE * (v**2).sum())

    v = w / np.array([ratio[b] for b in chosen.tolist()])
    plain, bias = np.zeros(len(chosen)), 0.0
    step = 1.0 / (0.25 * (weight[:, None] * np.append(x, np.ones((len(y), 1)), axis=1) ** 2).sum() + toxicity.RIDGE)
    for _ in range(4000):  # plain gradient descent
        g = weight * (1 / (1 + np.exp(-(x @ plain + bias))) - y)
        plain, bias = plain - step * (x.T @ g + toxicity.RIDGE * plain), bias - step * g.sum()
    assert loss(v, c) <= loss(plain, bias) + 0.01
    table = np.zeros(1 << toxicity.BITS)
    table[chosen] = w
    for t, g in zip(texts, found, strict=True):
        z = c + sum(table[b] for b in g)
        assert math.isclose(toxicity.text_score(t, table, c), 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_statistics_equal_plain_ones():
    for text in ("One TWO two\n\nthree 3 x,y. é É!", "a", prose(50), "|| ## 12\t12\n" * 5):
        raw = text.encode()
        words, lines, n = raw.split(), raw.split(b"\n"), len(raw)
        got = dict(zip(quality.STATISTICS, quality.statistics(raw), strict=True))
        want = {
            "log_bytes": math.log1p(n), "log_words": math.log1p(len(words)), "log_lines": math.log1p(len(lines)), "word_length": sum(map(len, words)) / len(words), "longest_word": math.log1p(max(map(len, words))),
            "line_length": math.log1p(n / len(lines)), "distinct_words": len(set(words)) / len(words), "top_word": max(Counter(words).values()) / len(words), "distinct_lines": len(set(lines)) / len(lines),
            "no_letter_words": sum(not w.lower().islower() for w in words) / len(words), "capital_words": sum(w.isupper() and len(w) > 1 for w in words) / len(words),
            "entropy": -sum(c / n * math.log2(c / n) for c in Counter(raw).values()), "squeeze": len(zlib.compress(raw, 1)) / n,
        } | {k: sum(b in m for b in raw) / n for k, m in quality.CLASSES.items()}
        assert all(math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-12) for k, v in want.items())
    assert quality.statistics(b"") == [0.0] * len(quality.STATISTICS)


def test_trees_equal_plainly_grown_ones():
    r = np.random.default_rng(1)
    x = r.normal(size=(80, 3)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    weight = np.where(y == 1, 1.5, 1.0)
    m = quality.grow(x, y, weight, trees=3, depth=2)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for j in range(3)]
    p0 = (weight * y).sum() / weight.sum()
    z = np.full(80, math.log(p0 / (1 - p0)))

    def best(at, g, h):
        top = (-math.inf, None)
        for j in range(3):
            for e in edges[j]:
                left, right = at[x[at, j] <= e], at[x[at, j] > e]
                if h[left].sum() >= 1 and h[right].sum() >= 1:
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE) for s in (left, right)) - g[at].sum() ** 2 / (h[at].sum() + quality.RIDGE)
                    top = max(top, (round(gain, 9), (-j, -e)), key=lambda t: t[0])
        return top[0]

    for t in range(3):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), weight * p * (1 - p)
        leaves = np.zeros(80, int)
        for node, at in ((0, np.arange(80)),):
            j, e = m["feature"][t, node], m["threshold"][t, node]
            left, right = at[x[at, j] <= e], at[x[at, j] > e]
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE) for s in (left, right)) - g[at].sum() ** 2 / (h[at].sum() + quality.RIDGE)
            assert math.isclose(gain, best(at, g, h), rel_tol=1e-6)
            for child, part in ((1, left), (2, right)):
                j, e = m["feature"][t, child], m["threshold"][t, child]
                leaves[part] = 2 * (child - 1) + (x[part, j] > e)
                if np.isfinite(e):
                    split = [part[x[part, j] <= e], part[x[part, j] > e]]
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE) for s in split) - g[part].sum() ** 2 / (h[part].sum() + quality.RIDGE)
                    assert math.isclose(gain, best(part, g, h), rel_tol=1e-6)
        value = np.array([-quality.RATE * g[leaves == k].sum() / (h[leaves == k].sum() + quality.RIDGE) for k in range(4)])
        assert np.allclose(m["value"][t], value)
        z += value[leaves]
    assert np.allclose(quality.walk(m, x), 1 / (1 + np.exp(-z)))
