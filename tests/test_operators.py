"""Operators without an SQL twin against brute force, and their invariants."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from florascope.operators import diagnostics, grid, models, neighbours, order, sampling, shares, spatial, stats
from florascope.plans import registry
from florascope.plans.catalog import Views
from florascope.plans.scalars import tile_bytes
from florascope.sources import fixtures, readers, tiles


def hav(a, b):
    (x1, y1), (x2, y2) = a, b
    p, q = math.radians(y1), math.radians(y2)
    s = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(s))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 200), rng.uniform(-89.9, 89.9, 200), strict=True))]
    rows += [(200, 179.99, 10.0), (201, -179.99, 10.0), (202, 0.0, 89.99), (203, 180.0, 89.99)]
    return spark.createDataFrame(rows, "record_id long, longitude double, latitude double").cache(), rows


def test_radius_join_wraps_and_reaches_over_the_pole(points):
    df, rows = points
    refs = df.where("record_id % 3 = 0 OR record_id >= 200")
    want = {a[0] for a in rows for b in rows if (b[0] % 3 == 0 or b[0] >= 200) and hav(a[1:], b[1:]) <= 900}
    assert {r[0] for r in spatial.within(df, refs, 900.0).select("record_id").collect()} == want


def test_nearest_other_equals_brute_force(points):
    df, rows = points
    got = {r["record_id"]: r["km"] for r in spatial.nearest_km(df, df, ["record_id"], exclude_self=True).collect()}
    for a in rows:
        assert got[a[0]] == pytest.approx(min(hav(a[1:], b[1:]) for b in rows if b[0] != a[0]), abs=1e-6)


def test_third_nearest_equals_brute_force(points):
    df, rows = points
    got = {r["record_id"]: r["km"] for r in spatial.nearest_km(df, df, ["record_id"], k=3, exclude_self=True).collect()}
    for a in rows:
        assert got[a[0]] == pytest.approx(sorted(hav(a[1:], b[1:]) for b in rows if b[0] != a[0])[2], abs=1e-6)


def test_nearest_searches_places_not_rows(spark, monkeypatch):
    """Copies of a place are counted: those that hold enough rows are not searched, others once each; own rows elsewhere are left out too."""
    rows = [(i, 10.0 + (i % 3) * 0.01, 50.0) for i in range(300)] + [(1000, 10.5, 50.0), (1001, 10.5, 50.0), (1002, None, 1.0), (1003, -0.0, 0.0), (1004, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "record_id long, longitude double, latitude double")
    searched, sides = [], spatial._sides
    monkeypatch.setattr(spatial, "_sides", lambda points, *a: (searched.append(points.count()), sides(points, *a))[1])
    for k, mean, first in ((1, False, 0), (3, False, 2), (3, True, 2)):
        for refs in (df, df.select("*")):
            searched.clear()
            got = {r["record_id"]: r["km"] for r in spatial.nearest_km(df, refs, ["record_id"], k=k, exclude_self=True, mean=mean).collect()}
            assert searched[:1] == ([first] if first else []) and len(got) == len(rows) and got.pop(1002) is None
            for a in rows:
                if a[0] in (0, 299, 1000, 1001, 1003, 1004):
                    d = sorted(hav(a[1:], b[1:]) for b in rows if b[0] not in (a[0], 1002))[:k]
                    assert got[a[0]] == pytest.approx(sum(d) / k if mean else d[-1], abs=1e-6)
    moved = df.withColumn("longitude", F.col("longitude") + 0.001)
    got = {r["record_id"]: r["km"] for r in spatial.nearest_km(df.where("record_id >= 1000"), moved, ["record_id"], exclude_self=True).collect()}
    assert got[1000] == pytest.approx(hav((10.5, 50.0), (10.501, 50.0)), abs=1e-6)


@pytest.mark.parametrize("name", ["DQ19_spatial_isolate", "JOIN8_nearest_other"])
def test_copies_of_events_add_no_search(spark, sf_dir, tmp_path, monkeypatch, name):
    """Events repeated at the same places: their rows are counted, only places that hold one row are searched, with the result they had before."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 10 < 2")
    copies = [events.where("event_id % 2 = 0").withColumns({"event_id": F.col("event_id") + 4001 * 1000 * c, "user_id": F.col("user_id") + 300 * c}) for c in (1, 2)]
    events.write.parquet(f"{tmp_path}/once/events.parquet")
    events.unionAll(copies[0]).unionAll(copies[1]).write.parquet(f"{tmp_path}/thrice/events.parquet")
    places = fixtures.view(spark, f"{tmp_path}/thrice", "occ").groupBy("longitude", "latitude").agg(F.count("*").alias("n"))
    once = registry.QUERIES[name](spark, f"{tmp_path}/once").where("record_id % 2 = 1").toPandas().sort_values("record_id")
    searched, sides = [], spatial._sides
    monkeypatch.setattr(spatial, "_sides", lambda points, *a: (searched.append(points.count()), sides(points, *a))[1])
    got = registry.QUERIES[name](spark, f"{tmp_path}/thrice").toPandas().sort_values("record_id")
    assert searched[0] == places.where("n = 1").count() > 50
    odd = got[got["record_id"] % 2 == 1]
    assert len(odd) > 0 and odd.values.tolist() == once.values.tolist()
    assert "km" in got or len(got) == len(odd)  # the copied rows are no isolates


def test_thinning_keeps_distance_and_is_the_greedy_set(points):
    df, rows = points
    kept = {r[0] for r in sampling.distance_thin(df, "record_id", 1500.0, seed=4).select("record_id").collect()}
    greedy = []
    for a in sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}:4".encode()).hexdigest(), r[0])):
        if all(hav(a[1:], b[1:]) >= 1500 for b in greedy):
            greedy.append(a)
    assert kept == {a[0] for a in greedy}


def test_thinning_of_a_crowd_wraps_and_lists_no_pairs(spark):
    """3000 points within a few metres, others around a pole and the date line; repeated places; the greedy set all the same."""
    rng = np.random.default_rng(6)
    at = [(10 + a, 50 + b) for a, b in rng.normal(scale=1e-4, size=(3000, 2)).round(6)]
    at += [(x, 89.9) for x in range(-180, 180, 15)] + [(x, 0.01 * (i % 3)) for i, x in enumerate([-179.99, 179.99, -180.0, 180.0, 179.9])] + [(0.0, -90.0), (120.0, -90.0), (0.0, 90.0)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(9999, None, 1.0)], "record_id long, longitude double, latitude double")
    for km in (5.0, 30.0):
        kept = {r[0] for r in sampling.distance_thin(df, "record_id", km, seed=1).select("record_id").collect()}
        greedy = []
        for i in sorted(range(len(at)), key=lambda i: hashlib.md5(f"{i}:1".encode()).hexdigest()):
            if all(hav(at[i], at[k]) >= km for k in greedy):
                greedy.append(i)
        assert kept == {*greedy, 9999}
    assert sampling.distance_thin(df.where("record_id < 0"), "record_id", 5.0, seed=1).count() == 0


def test_quota_and_weighted_draws(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") % 10).cast("double").alias("w"))
    assert {r["g"]: r["n"] for r in sampling.quota(df, ["g"], "id", 100, 1).groupBy("g").agg(F.count("*").alias("n")).collect()} == {0: 34, 1: 34, 2: 34}
    drawn = sampling.weighted_with_replacement(df, "id", "w", 4000, 2).toPandas()
    assert len(drawn) == 4000 and drawn["draw"].is_unique and (drawn["w"] > 0).all()
    assert abs(drawn["w"].mean() - 285 / 45) < 0.2


def test_draws_near_the_ends_are_not_lost(spark):
    df = spark.createDataFrame([(i, 0.1 if i % 2 else 1e-17) for i in range(50)], "id long, w double")
    drawn = sampling.weighted_with_replacement(df, "id", "w", 3000, 4).toPandas()
    assert sorted(drawn["draw"]) == list(range(3000))


def test_percentiles_and_ranks_over_buckets_equal_numpy(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.lognormal(size=3000), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(9999, None)], "id long, s double")
    at = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.975, "e": 1.0}
    assert list(stats.percentiles(df, "s", at).first()) == pytest.approx([np.quantile(x, p) for p in at.values()])
    points = {r["p"]: r["v"] for r in order.quantile_points(df, "s", [i / 50 for i in range(51)]).collect()}
    assert points == pytest.approx({i / 50: np.quantile(x, i / 50) for i in range(51)})
    ranks = {r["id"]: r["r"] for r in stats.average_rank(df, "s", "r").collect()}
    assert all(ranks[i] == (x < v).sum() + ((x == v).sum() + 1) / 2 for i, v in enumerate(x)) and ranks[9999] is None


@pytest.mark.parametrize(("folds", "k"), [(0, 1), (3, 5), (70, 4), (3, 60), (0, 40)])
def test_distances_by_tree_equal_whole_ones(spark, monkeypatch, folds, k):
    rng = np.random.default_rng(2)
    x, m = rng.normal(size=(90, 4)).round(2), rng.normal(size=(200, 4)).round(2)
    m[:40] = m[40]  # copies tie
    x[5] = m[0]
    target = spark.createDataFrame([(i, v.tolist(), i % max(folds, 1)) for i, v in enumerate(x)], "id long, v array<double>, f int")
    ref = spark.createDataFrame([(v.tolist(), i % max(folds, 1)) for i, v in enumerate(m)], "v array<double>, f int")
    d = np.sqrt(((x[:, None] - m[None]) ** 2).sum(axis=2))
    if folds:
        d[np.arange(90)[:, None] % folds == np.arange(200)[None] % folds] = np.inf
    want = dict(enumerate(np.sort(d, axis=1)[:, :k].mean(axis=1)))
    for name, value in (("LEAF_ROWS", 8), ("FEW", 6), ("BINS", 4), ("TILE_ROWS", 10), ("TILE_TARGETS", 7)):
        monkeypatch.setattr(neighbours, name, value)
    for rows in (20_000, 16):
        monkeypatch.setattr(diagnostics, "REFERENCE_ROWS", rows)
        got = {r["id"]: r["distance"] for r in diagnostics.nearest_distance(target, ref, "id", "v", fold="f" if folds else None, k=k).collect()}
        assert got == pytest.approx(want)


def test_tree_holds_distinct_references_with_their_copies(spark, monkeypatch):
    """Copies of references and targets are counted, not searched again: for few neighbours and for a share of all."""
    rng = np.random.default_rng(3)
    m = np.repeat(rng.uniform(size=(30, 2)), 9, axis=0)
    x = np.repeat(rng.uniform(size=(4, 2)), 5, axis=0)
    target = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    ref = spark.createDataFrame([(v.tolist(),) for v in m], "v array<double>")
    made, before = [], neighbours.Search
    monkeypatch.setattr(neighbours, "Search", lambda *a: (made.append(before(*a)), made[-1])[1])
    monkeypatch.setattr(diagnostics, "REFERENCE_ROWS", 50)
    for k in (4, 200):
        got = {r["id"]: r["distance"] for r in diagnostics.nearest_distance(target, ref, "id", "v", k=k).collect()}
        assert got == pytest.approx(dict(enumerate(np.sort(np.sqrt(((x[:, None] - m[None]) ** 2).sum(axis=2)), axis=1)[:, :k].mean(axis=1))))
        assert made[-1].placed.count() == 30 and made[-1].target.count() == 4


@pytest.mark.parametrize("width", [1, 2, 3])
def test_a_share_is_summed_by_boxes(spark, monkeypatch, width):
    """The nearest share of all references, without a distance to each: copies, lines, ties, rows without a distance, targets far off."""
    rng = np.random.default_rng(6)
    m = rng.uniform(size=(3000, width)) * [9.0, 5.0, 3.0][:width]
    m[:, -1] = np.ceil(m[:, -1] * 4) if width > 1 else m[:, -1]
    m[:600] = m[600:1200]
    x = np.concatenate([rng.uniform(-2, 8, size=(12, width)), m[:3], np.full((1, width), 500.0)])
    target = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (98, [None] * width), (99, [float("nan")] * width)], "id long, v array<double>")
    ref = spark.createDataFrame([*((v.tolist(),) for v in m), ([None] * width,), ([float("nan")] * width,), ([float("inf")] * width,)], "v array<double>").repartition(7)
    d = np.sort(np.sqrt(((x[:, None] - m[None]) ** 2).sum(axis=2)), axis=1)
    monkeypatch.setattr(neighbours, "_distances", None)  # no leaf is read whole
    for name, value in (("BLOCK_ROWS", 400), ("LEAF_ROWS", 4), ("FEW", 3), ("LISTED", 300), ("PARTS", 16), ("PARTS_LEAST", 2), ("TILE_VISITS", 5), ("DEALT", 250), ("TASK_TARGETS", 4)):
        monkeypatch.setattr(shares, name, value)
    monkeypatch.setattr(diagnostics, "REFERENCE_ROWS", 100)
    for k in (140, 9000):
        got = {r["id"]: r["distance"] for r in diagnostics.nearest_distance(target, ref, "id", "v", k=k).collect()}
        assert got[98] is None and got[99] is None and len(got) == len(x) + 2
        assert [got[i] for i in range(len(x))] == pytest.approx(d[:, :k].mean(axis=1), rel=1e-12)


def test_a_share_of_equally_far_references(spark, monkeypatch):
    """Ties that no edge can part, and guesses that the references mislead."""
    turn = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    m = np.concatenate([np.stack([np.repeat([3.0, -3.0], 200), np.tile(np.arange(200) % 2 * 8.0 - 4.0, 2)], axis=1) + 0.0, np.round(np.stack([np.cos(turn), np.sin(turn)], axis=1) * 40, 3), np.full((500, 2), 7.0)])
    m = np.concatenate([m, 1e-7 * np.random.default_rng(1).normal(size=(300, 2))])
    x = np.array([[0.0, 0.0], [3.0, 4.0], [7.0, 7.0]])
    df = lambda a: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, v array<double>")
    for name, value in (("BLOCK_ROWS", 300), ("LEAF_ROWS", 4), ("FEW", 3), ("MOST", 60)):
        monkeypatch.setattr(shares, name, value)
    monkeypatch.setattr(diagnostics, "REFERENCE_ROWS", 100)
    d = np.sort(np.sqrt(((x[:, None] - m[None]) ** 2).sum(axis=2)), axis=1)
    for k in (150, 1100):
        got = {r["id"]: r["distance"] for r in diagnostics.nearest_distance(df(x), df(m), "id", "v", k=k).collect()}
        assert [got[i] for i in range(3)] == pytest.approx(d[:, :k].mean(axis=1), rel=1e-12, abs=1e-15)


def test_a_share_needs_few_looks_at_references():
    rng = np.random.default_rng(7)
    n = 1_000_000
    m, x = rng.uniform(size=(2, n)), rng.uniform(size=(12, 2))
    tree = shares.Tree(*shares.plant(m, np.ones(n, np.int64)))
    d = np.sqrt(((x[:, :, None] - m) ** 2).sum(axis=1))
    reach = np.sort(d, axis=1)[:, n // 10]
    edges = np.stack([np.full(12, -1.0), reach], axis=1)
    kinds, rows, sums = tree.count(x, edges)
    assert (rows[:, 0] == (d <= reach[:, None]).sum(axis=1)).all() and (kinds == rows).all()
    assert sums[:, 0] == pytest.approx(np.where(d <= reach[:, None], d, 0.0).sum(axis=1), rel=1e-13)
    looked = sum(len(q) * (shares.NODES**2 if how == "far" else len(tree.n) >> level) for how, level, q, _, _ in tree.walk(x, edges))
    assert looked < rows.sum() / 2, looked


def test_wide_vectors_are_searched_by_blocks_of_bounded_size(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 20))
    m[:9] = m[9]
    df = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(m)], "id long, v array<double>, f int")
    monkeypatch.setattr(diagnostics, "REFERENCE_ROWS", 10)
    monkeypatch.setattr(diagnostics, "HELD", 30)
    monkeypatch.setattr(neighbours, "Search", None)
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(axis=2))
    d[np.arange(60)[:, None] % 4 == np.arange(60)[None] % 4] = np.inf
    for k in (1, 5):
        got = {r["id"]: r["distance"] for r in diagnostics.nearest_distance(df, df, "id", "v", fold="f", k=k).collect()}
        assert got == pytest.approx(dict(enumerate(np.sort(d, axis=1)[:, :k].mean(axis=1))), abs=1e-6)


def test_distances_without_other_folds_are_null(spark, monkeypatch):
    ref = spark.createDataFrame([(i, [float(i), 0.0], 1) for i in range(30)], "id long, v array<double>, f int")
    for rows in (20_000, 4):
        monkeypatch.setattr(diagnostics, "REFERENCE_ROWS", rows)
        assert {r["distance"] for r in diagnostics.nearest_distance(ref, ref, "id", "v", fold="f", k=2).collect()} == {None}
        ids = ref.withColumnRenamed("id", "_id")
        # one fold only: each row leaves out itself, so all have a neighbour at 1
        assert diagnostics._threshold(ids, "v", "f", 1, 1.0) == pytest.approx(1.0)


def test_tree_visits_a_falling_share_of_leaves(spark):
    """Low-dimensional references: the larger they are, the smaller the share of leaves that a target meets."""
    rng = np.random.default_rng(5)
    target = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rng.uniform(size=(200, 2)))], "id long, v array<double>, f long")
    shares = []
    for n in (4_000, 40_000):
        m = rng.uniform(size=(n, 2))
        search = neighbours.Search(target, spark.createDataFrame([(v.tolist(), 0) for v in m], "v array<double>, f long"), n, 3, False)
        got = {r["id"]: r["distance"] for r in search.run().collect()}
        rows = [np.sort(np.sqrt(((np.array(r["v"]) - m) ** 2).sum(axis=1)))[:3].mean() for r in target.orderBy("id").collect()]
        assert got == pytest.approx(dict(enumerate(rows)))
        shares.append(sum(search.visited) / search.pairs)
    assert shares[1] < shares[0] / 2 and shares[1] < 0.2, shares


def test_mean_of_all_pairs(spark, monkeypatch):
    m = np.random.default_rng(2).normal(size=(70, 4))
    ref = spark.createDataFrame([(v.tolist(),) for v in m], "v array<double>")
    pairs = np.sqrt(((m[:, None] - m[None]) ** 2).sum(axis=2)).sum() / (70 * 69)
    for rows in (20_000, 16):
        monkeypatch.setattr(diagnostics, "REFERENCE_ROWS", rows)
        assert diagnostics.mean_pair_distance(ref, "v") == pytest.approx(pairs)


def test_statistics_of_an_empty_class_are_null(spark):
    """A fold without presences, and one without absences: null, not an error."""
    pred = spark.createDataFrame([(f, y, s) for f, y in ((0, 0), (1, 1), (2, 0), (2, 1)) for s in (0.2, 0.4, 0.9)], "fold int, y int, s double")
    assert {r["fold"]: (r["tss"] is None, r["threshold"] is None) for r in stats.tss(pred, ["fold"]).collect()} == {0: (True, True), 1: (True, True), 2: (False, False)}
    assert {r["fold"]: r["auc"] for r in stats.auc(pred, ["fold"]).collect()} == {0: None, 1: None, 2: 0.5}
    for y in (0, 1):
        assert stats.equal_rates_threshold(pred.where(f"y = {y}")).first()["threshold"] is None
    zero = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "a double, b double")
    assert stats.schoener_d(zero, "a", "b").first()["d"] is None and stats.schoener_d(zero, "b", "b").first()["d"] == pytest.approx(1.0)


def test_mess_treats_nan_as_null_on_both_paths(spark, monkeypatch):
    nan = float("nan")
    ref = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (nan,), (None,)], "a double")
    target = spark.createDataFrame([(1, 0.5), (2, 2.5), (3, nan), (4, 9.0), (5, None), (6, -0.0)], "id int, a double")
    seen = []
    for most in (200_000, 1):
        monkeypatch.setattr(grid, "LOOK_UP", most)
        seen.append({r["id"]: r["mess"] for r in grid.mess(ref, target, ["a"]).collect()})
    assert seen[0] == seen[1] and seen[0][1] == -25 and seen[0][2] == pytest.approx(200 / 3) and seen[0][3] is None and seen[0][4] == -300


def test_mess_looked_up_equals_ordered(spark, monkeypatch):
    rng = np.random.default_rng(4)
    ref = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(200, 2)).round(1)], "a double, b double")
    target = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(150, 2)).round(1) * 2)] + [(900, None, 1.0)], "id long, a double, b double")
    first = {r["id"]: (r["mess"], r["most_dissimilar"]) for r in grid.mess(ref, target, ["a", "b"]).collect()}
    monkeypatch.setattr(grid, "LOOK_UP", 1)
    second = {r["id"]: (r["mess"], r["most_dissimilar"]) for r in grid.mess(ref, target, ["a", "b"]).collect()}
    assert first[900] == second[900] == (None, None)
    assert {k: v[1] for k, v in first.items()} == {k: v[1] for k, v in second.items()} and {k: v[0] for k, v in first.items() if k != 900} == pytest.approx({k: v[0] for k, v in second.items() if k != 900})


def test_rows_are_numbered_across_partitions(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("id"))
    assert sorted((r["id"], r["n"]) for r in models.numbered(df, F.col("id"), "n").collect()) == [(i, i + 1) for i in range(500)]


def test_statistics_equal_definitions(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.uniform(size=300), 2)
    y = (rng.uniform(size=300) < s).astype(int)
    pred = spark.createDataFrame([(int(i), int(a), float(b)) for i, (a, b) in enumerate(zip(y, s, strict=True))], "id long, y int, s double")
    p, q = s[y == 1], s[y == 0]
    pairs = (p[:, None] > q).mean() + 0.5 * (p[:, None] == q).mean()
    assert stats.auc(pred).first()["auc"] == pytest.approx(pairs)
    best = max((p >= t).mean() - (q >= t).mean() for t in s)
    assert stats.tss(pred).first()["tss"] == pytest.approx(best)


def test_collinear_predictor_has_infinite_factor(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0 + 1).alias("b"), F.sin("id").alias("c"))
    f = stats.vif(df, ["a", "b", "c"])
    assert f["a"] == math.inf and f["c"] < 2
    assert len(stats.low_collinearity(df, ["a", "b", "c"])) == 2


def test_models_recover_a_gaussian_response(spark, sf_dir):
    v = Views(spark, sf_dir)
    cells = v.cells.withColumn("truth", F.exp(-0.5 * F.pow((F.col("bio1") - 15.0) / 4.0, F.lit(2.0))))
    presence = sampling.weighted_with_replacement(cells.withColumn("id", F.col("row") * 360 + F.col("col")), "id", "truth", 600, 1).select(F.lit(1).alias("y"), "bio1")
    d = presence.unionByName(cells.where("(row * 360 + col) % 9 = 0").select(F.lit(0).alias("y"), "bio1")).cache()
    for model in (models.fit_glm(d, ["bio1"]), models.fit_ppm(d, ["bio1"], area=100.0), models.fit_maxent(d, ["bio1"], kinds="lq", rounds=60)):
        rho = stats.spearman(cells.select("truth", models.predict(model).alias("p")), "truth", "p").first()["rho"]
        assert rho > 0.95, model["kind"]


def test_clusters_join_chains_and_leave_noise(spark):
    df = spark.createDataFrame([(i, 0.5 * i, 0.0) for i in range(8)] + [(100, 50.0, 50.0)], "record_id long, longitude double, latitude double")
    got = {r["id"]: r["cluster"] for r in models.clusters(df, "record_id", 60.0, least=3).collect()}
    assert set(got) == set(range(8)) and len(set(got.values())) == 1


def test_tiles_round_trip():
    pts = [(3, 4, 7), (500, 0, 300), (600, 1, 5)]
    got = [(x, y, int(p["total"])) for x, y, _, p in tiles.tile_points(tile_bytes(pts), "occurrence")]
    assert got == pts[:2]  # the last lies outside the tile
    assert list(tiles.tile_points(tile_bytes(pts), "other")) == []


def test_upload_columns_and_delimiter(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("﻿X coord;Decimal_Longitude;lat;Presence\n999;12,5;45,25;1\n998;13,5;;absent\n", encoding="utf-8")
    up = readers.read_upload(spark, str(f))
    c = readers.detect_columns(up, least=0.5)
    assert c["longitude"] == "Decimal_Longitude" and c["latitude"] == "lat"
    got = up.select(readers.decimal(F.col(c["longitude"])).alias("x"), readers.upload_status(F.col(c["status"])).alias("s")).collect()
    assert [(r["x"], r["s"]) for r in got] == [(12.5, "present"), (13.5, "absent")]


def test_plans_push_filters_and_do_not_loop(spark, sf_dir):
    v = Views(spark, sf_dir)
    plan = v.events.where("event_id < 10").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(event_id,10)" in plan and "ReadSchema: struct<event_id:bigint>" in plan
    join = spatial.within(v.occ, v.gaz, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in join and "Cartesian" not in join


def test_scalars_at_their_edges(spark):
    from florascope.functions import geo
    from florascope.functions import scalars as sc

    texts = spark.createDataFrame([(" 7 ",), ("-3",), ("99999999999999999999",), ("1.0",), ("",), (None,)], "s string")
    assert [r[0] for r in texts.select(sc.integer(F.col("s"))).collect()] == [7, -3, None, None, None, None]
    lons = spark.createDataFrame([(180.0,), (-180.0,), (540.5,), (-190.0,)], "x double")
    assert [r[0] for r in lons.select(geo.wrap_lon(F.col("x"))).collect()] == [-180.0, -180.0, -179.5, 170.0]
    years = spark.createDataFrame([(2015.0,), (15.0,), (None,)], "y double")
    assert [str(r[0]) for r in years.select(sc.year_start(F.col("y"))).collect()] == ["2015-01-01", "None", "None"]
    tops = spark.createDataFrame([(40, 110), (0, -10), (5, -5)], "t int, w int")
    labels = ["30–40°N, 110–120°E", "0–10°S, 0–10°W", "5°S–5°N, 5°W–5°E"]
    assert [r[0] for r in tops.select(sc.tile_label(F.col("t"), F.col("w"))).collect()] == labels
    boxes = spark.createDataFrame([(-180.0, -90.0, 180.0, 90.0), (5.0, 5.0, 6.0, 6.0)], "w double, s double, e double, n double")
    zoom = geo.zoom(F.col("w"), F.col("s"), F.col("e"), F.col("n"), pixel=1 / 60, tile_px=512, most=64, deepest=6)
    assert [r[0] for r in boxes.select(zoom).collect()] == [2, 5]


def test_robust_outliers_withstand_masked_contamination(spark):
    """Three rows in ten lie together far off: a single start may settle on a mixture, many starts find the majority."""
    rng = np.random.default_rng(12)
    good = rng.multivariate_normal([0, 0, 0], [[1, 0.8, 0.2], [0.8, 1, 0.1], [0.2, 0.1, 1]], 1400)
    bad = rng.normal([4, -4, 3], 0.3, size=(600, 3))
    x = np.vstack([good, bad])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(9000, None, 0.0, 0.0)], "id long, a double, b double, c double")
    got = {r["id"] for r in sampling.environmental_outliers(df, "id", ["a", "b", "c"]).where("outlier").collect()}
    # the same steps over all rows in numpy
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    best = min((sampling.concentrate(z, m, c, 30) for _, m, c in sampling.start_candidates(z, 1)), key=lambda c: c[0])
    cov = best[2] * np.median(sampling._squares(z, *best[1:])) / sampling.chi_square_quantile(0.5, 3)
    mean, cov = sampling._moments(z[sampling._squares(z, best[1], cov) <= sampling.chi_square_quantile(0.975, 3)])
    want = set(np.flatnonzero(sampling._squares(z, mean, cov) > sampling.chi_square_quantile(0.999, 3)).tolist())
    assert got == want and set(range(1400, 2000)) <= got and len(got) < 620


def test_chi_square_quantiles():
    # fixed values from tables
    for p, df, want in ((0.5, 1, 0.454936), (0.95, 1, 3.841459), (0.95, 3, 7.814728), (0.975, 5, 12.832502), (0.999, 10, 29.588298)):
        assert sampling.chi_square_quantile(p, df) == pytest.approx(want, abs=1e-6)


def plain_spline(z, low, high, i, degree, order=None):
    """B-spline ``i`` at a number, by the recursion over evenly spaced knots, with straight lines beyond the ends."""
    h = (high - low) / 4
    knot = lambda j: low + (j - 3) * h

    def value(x, i, k):
        if k == 0:
            return float(knot(i) <= x < knot(i + 1))
        return (x - knot(i)) / (k * h) * value(x, i, k - 1) + (knot(i + k + 1) - x) / (k * h) * value(x, i + 1, k - 1)

    at = min(max(z, low), high)
    slope = (value(at, i, 2) - value(at, i + 1, 2)) / h
    return value(at, i, 3) + (z - at) * slope


def test_spline_bases_and_fit_equal_plain_ones(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(-2, 3, size=400)
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(3 * np.sin(2 * x)))).astype(int)
    df = spark.createDataFrame([(int(b), float(a)) for a, b in zip(x, y, strict=True)], "y int, x double")
    scale = models.standardiser(df, ["x"])
    probe = np.r_[x[:50], x.min(), x.max(), -4.0, 5.5]
    bases = models.features(["x"], scale, "s")
    assert len(bases) == 7
    got = np.array(spark.createDataFrame([(float(v),) for v in probe], "x double").select(*bases.values()).toPandas())
    z = (probe - x.mean()) / x.std()
    low, high = (x.min() - x.mean()) / x.std(), (x.max() - x.mean()) / x.std()
    want = np.array([[plain_spline(v, low, high, i, 3) for i in range(7)] for v in z])
    assert np.allclose(got, want, atol=1e-9) and np.allclose(got.sum(axis=1), 1.0)
    # the fit is the minimum of the plain ridge loss
    model = models.fit_glm(df, ["x"], kinds="s", ridge=2.0, rounds=60, tol=1e-9)
    f = np.c_[np.ones(400), [[plain_spline(v, low, high, i, 3) for i in range(7)] for v in (x - x.mean()) / x.std()]]
    w = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (1 - y).sum()))
    beta = np.zeros(8)
    for _ in range(100):
        mu = 1 / (1 + np.exp(-f @ beta))
        beta += np.linalg.solve((f.T * (w * mu * (1 - mu))) @ f + np.diag([1e-9] + [2.0] * 7), f.T @ (w * (y - mu)) - np.r_[0, 2.0 * beta[1:]])
    fitted = np.array([r[0] for r in df.select(models.predict(model)).collect()])
    assert np.allclose(fitted, 1 / (1 + np.exp(-f @ beta)), atol=1e-6)
    held = spark.createDataFrame([(0.0,)], "other double").select(models.predict(model, {"x": 1.0})).first()[0]
    assert held == pytest.approx(spark.createDataFrame([(1.0,)], "x double").select(models.predict(model)).first()[0])


def test_predictor_sets_are_ranked_on_rows_they_have_not_seen(spark):
    rng = np.random.default_rng(5)
    x, noise = rng.normal(size=600), rng.normal(size=600)
    y = (rng.uniform(size=600) < 1 / (1 + np.exp(-2.5 * x))).astype(int)
    df = spark.createDataFrame([(int(a), float(b), float(c), i % 3) for i, (a, b, c) in enumerate(zip(y, x, noise, strict=True))], "y int, x double, noise double, fold int")
    got = {r["set_name"]: r for r in models.compare_sets(df, {"noise": ["noise"], "signal": ["x"]}, lambda d, c: models.fit_glm(d, c, rounds=6), 3).collect()}
    assert got["signal"]["rank"] == 1 and got["noise"]["rank"] == 2 and got["signal"]["auc"] > 0.8 and abs(got["noise"]["auc"] - 0.5) < 0.1
