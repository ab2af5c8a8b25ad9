"""The set join, the hard negatives and the whitening against plain versions, with every awkward case."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from florascope.llm import jaccard, negatives, whitening
from florascope.llm import queries as llm
from tests.compare import same
from tests.llm.test_llm import EDGE, LONG, docs_of

VECTORS = "vec_id long, embedding array<float>, label int, score double, x array<long>, node string, root int, n string"


def vectors_of(spark, rows):
    """Embeddings with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, y, 0.5, [1], "a", 2, "b") for i, v, y in rows], VECTORS)


def shingles_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([" ".join(w)] if w else [])


def plain_join(rows, percent):
    """Component and number of links of each row, from all pairs of distinct sets."""
    sets = [shingles_of(t) for _, t, _ in rows]
    copies, root = {}, {}
    for s in sets:
        if s:
            copies[s], root[s] = copies.get(s, 0) + 1, s

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    linked = dict(copies)
    distinct = list(copies)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if 100 * len(a & b) >= percent * len(a | b):
                linked[a] += copies[b]
                linked[b] += copies[a]
                root[find(a)] = find(b)
    least = {}
    for (i, _, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    return sorted(str((i, len(s), least.get(find(s)) if s else i, linked[s] - 1 if s else 0)) for (i, _, _), s in zip(rows, sets, strict=True))


def families(rng):
    """Groups of copies and of near copies at all distances from the limit, texts that share a passage, and unrelated ones."""
    words = [f"w{k}" for k in range(3000)]
    out = [*EDGE, (8, "", "a"), (9, "one", "a"), (10, "ONE", "a"), (11, "one two", "a"), (None, "one two", "a"), (None, LONG + "end", "b")]
    k = 100
    for size in (10, 12, 20, 40, 80, 200):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                w = w[rng.randrange(3) :]
            if rng.random() < 0.3:
                w += [rng.choice(words)]
            text = " ".join(w)
            out.append((k, text.upper() if rng.random() < 0.2 else text, "s"))
            k += 1
            if rng.random() < 0.2:
                out.append((rng.choice([k, None, k - 1]), text, "s"))
    passage = [rng.choice(words) for _ in range(60)]
    for _ in range(40):
        out.append((k, " ".join(passage + [rng.choice(words) for _ in range(rng.choice([2, 6, 30]))]), "s"))
        k += 1
    return out


@pytest.mark.parametrize(("stars", "tile", "percent"), [(2, 1000, 90), (0, 7, 90), (1, 1000, 80)])
def test_jaccard_join_equals_all_pairs(spark, monkeypatch, stars, tile, percent):
    monkeypatch.setattr(jaccard, "STARS", stars)
    monkeypatch.setattr(jaccard, "TILE_SETS", tile)
    rows = families(random.Random(stars))
    rows = rows if stars == 2 else [r for r in rows if r[1] is None or len(r[1]) < 10_000]
    got = jaccard.join(docs_of(spark, rows), percent=percent).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_join(rows, percent)
    assert len({r["component_id"] for r in got if r["n_links"]}) > 6


def test_a_group_of_near_copies_costs_no_pairs(spark, monkeypatch):
    """Of 300 near copies only stars are compared, not their 44850 pairs."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for k in range(300):
        w = list(base)
        w[rng.randrange(150)] = f"x{k}"
        rows.append((k, " ".join(w), "s"))
    compared = []
    verified = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, found, percent: (compared.append(pairs.count()), verified(pairs, found, percent))[1])
    got = jaccard.join(docs_of(spark, rows)).collect()
    assert sum(compared) < 3000
    assert {r["component_id"] for r in got} == {0} and sorted(str(tuple(r)) for r in got) == plain_join(rows, 90)


def test_jaccard_join_of_nothing(spark):
    for rows in ([], [(1, "", "a")], [(1, "alone here now", "a")]):
        got = jaccard.join(docs_of(spark, rows)).collect()
        assert sorted(str(tuple(r)) for r in got) == plain_join(rows, 90)


def plain_negatives(rows):
    seen = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        r = ((int(math.fmod(y + 1, 10)) if i % 7 == 0 else y), [math.floor(256 * float(np.float32(c))) for c in v])
        seen[i] = min(seen.get(i, r), r)
    sizes = [len(x) for _, x in seen.values() if x]
    dim = max(sorted(set(sizes)), key=sizes.count) if sizes else -1
    seen = {i: r for i, r in seen.items() if len(r[1]) == dim}
    out = []
    for a, (y, x) in seen.items():
        if a % 100 == 0:
            s = sorted(((-sum(p * q for p, q in zip(x, z, strict=True)), i, label) for i, (label, z) in seen.items() if i != a))
            for p, pid, _ in [t for t in s if t[2] == y][:5]:
                ok = [(n, nid) for n, nid, label in s if label != y and 30 * -p <= 100 * -n <= 90 * -p]
                out += [(a, pid, k + 1, nid, -p, -n) for k, (n, nid) in enumerate(ok[:10])]
    return sorted(out)


def awkward_vectors(rng, n=700):
    rows = []
    for i in range(-100, n):
        v = [round(rng.gauss(0.2, 0.3), 1) for _ in range(4)]  # many ties
        rows.append((i, v, rng.choice([0, 1, 2, 9, -3])))
    rows += [(n, None, 1), (n + 1, [None, 1.0, 1.0, 1.0], 1), (n + 2, [float("nan")] * 4, 1), (n + 3, [float("inf")] * 4, 1), (n + 4, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    rows += [(n + 5, [1.0, 2.0], 1), (n + 6, [], 1), (200, [0.0] * 4, 1), rows[50], rows[50], (100, [0.5] * 4, 0), (100, [0.1] * 4, 0)]
    return rows


@pytest.mark.parametrize(("vectors", "anchors"), [(20_000, 4_000), (60, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, vectors, anchors):
    monkeypatch.setattr(negatives, "TILE_VECTORS", vectors)
    monkeypatch.setattr(negatives, "TILE_ANCHORS", anchors)
    rows = awkward_vectors(random.Random(5))
    got = sorted(tuple(r) for r in negatives.mine(vectors_of(spark, rows)).collect())
    assert got == plain_negatives(rows) and len(got) > 100


def test_scores_stay_exact_or_raise(spark):
    big = np.array([[3 * 10**8, 1], [5, 10**9]])
    assert negatives.scores(big, big).tolist() == [[9 * 10**16 + 1, 25 * 10**8], [25 * 10**8, 10**18 + 25]]
    with pytest.raises(OverflowError):
        negatives.scores(big * 100, big)
    assert negatives.limits(np.array([9, 9, 5, 5, 3, 2]), 10, 30, 90) == (0, 5)
    for rows in ([], [(100, None, 1)], [(100, [1.0, 2.0], 1)]):
        assert negatives.mine(vectors_of(spark, rows)).collect() == []


@pytest.mark.parametrize("name", ["op11_ngram_jaccard_join", "op12_hard_negatives"])
def test_join_queries_match_sql(name, spark, duck, sf_dir):
    assert same(llm.queries()[name](spark, sf_dir).toPandas(), duck.execute(llm.oracle_sql()[name]).fetchdf())


def plain_whitening(rows):
    """Rows by brute force: id, exact deviation, and the first components from a library's solver."""
    kept = [(i, v) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in kept]
    dim = max(sorted(set(sizes)), key=sizes.count)
    ids, x = zip(*[(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in kept if len(v) == dim], strict=True)
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    far = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    values, basis = np.linalg.eigh(np.cov(np.array(x, float).T, bias=True).reshape(dim, dim))
    return ids, np.array(x, float), n, far, values[::-1], basis[:, ::-1]


def check_whitening(got, rows, expected):
    ids, x, n, far, values, basis = plain_whitening(rows)
    kept = min(8, expected)
    w = (x - x.mean(axis=0)) @ basis[:, :kept] / np.sqrt(values[:kept])
    assert len(got) == n * kept and {r["component"] for r in got} == set(range(1, kept + 1))
    key = lambda r: (str(r[0]), r[1])
    for k in range(kept):
        mine = sorted([(r["vec_id"], r["deviation"], r["whitened"]) for r in got if r["component"] == k + 1], key=lambda r: (key(r), abs(r[2])))
        want = sorted([(i, d, v) for i, d, v in zip(ids, far, w[:, k].tolist(), strict=True)], key=lambda r: (key(r), abs(r[2])))
        assert [m[:2] for m in mine] == [m[:2] for m in want]
        sign = np.sign(np.dot([m[2] for m in mine], [m[2] for m in want]))
        assert np.allclose([sign * m[2] for m in mine], [m[2] for m in want], atol=1e-6)
        assert all(math.isclose(r["explained"], values[k] / values.sum(), rel_tol=1e-9) for r in got if r["component"] == k + 1)
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_equals_numpy(spark):
    rng = random.Random(7)
    rows = [(i, v, y) for i, v, y in awkward_vectors(rng) if i != 705 or len(v) == 4]
    check_whitening(whitening.whiten(vectors_of(spark, rows).repartition(5)).collect(), rows, 4)
    wide = [(i, [rng.gauss(0, 1 + k) for k in range(12)], 0) for i in range(300)]
    check_whitening(whitening.whiten(vectors_of(spark, wide).repartition(40, F.col("vec_id"))).collect(), wide, 12)


def test_whitening_of_flat_data(spark):
    flat = [(i, [float(i % 5), 2.0 * (i % 5), 1.0], 0) for i in range(40)]
    check_whitening(whitening.whiten(vectors_of(spark, flat)).collect(), flat, 1)
    for rows in ([], [(1, None, 0)], [(1, [], 0)], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 5):
        assert whitening.whiten(vectors_of(spark, rows)).collect() == []


def test_eigen_and_merged_moments_equal_numpy():
    rng = np.random.default_rng(2)
    for d in (1, 2, 3, 17):
        a = rng.normal(1e5, 3, (200, d))
        parts = []
        for cut in np.split(a, [1, 90, 91, 150]):
            state = (0, np.zeros(d), np.zeros((d, d)))
            for rows in np.array_split(cut, 3):
                state = whitening.update(*state, rows)
            parts.append(state)
        n, mean, m2 = (0, np.zeros(d), np.zeros((d, d)))
        for p in parts:
            n, mean, m2 = whitening.merge((n, mean, m2), p)
        cov = np.cov(a.T, bias=True).reshape(d, d)
        assert n == 200 and np.allclose(mean, a.mean(axis=0), rtol=1e-13) and np.allclose(m2 / n, cov, atol=1e-10)
        values, basis = whitening.eigen(cov)
        assert np.allclose(values, np.linalg.eigvalsh(cov)[::-1]) and np.allclose(basis @ np.diag(values) @ basis.T, cov) and np.allclose(basis.T @ basis, np.eye(d))
    for special in (np.zeros((3, 3)), np.eye(4), np.diag([1.0, 5.0, 3.0]), np.ones((5, 5))):
        values, basis = whitening.eigen(special)
        assert np.allclose(basis @ np.diag(values) @ basis.T, special)
    assert whitening._deviations(np.array([[2**40, 0], [0, 2**40]]), 2, [2**40, 2**40]) == [None, None]
