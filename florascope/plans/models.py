"""Queries that fit and apply models."""

from __future__ import annotations

from pyspark.sql import functions as F

from florascope.operators import models, quality, sampling, severity, spatial, stats, virtual
from florascope.operators.session import cut

from .catalog import query
from .spatial import _ASSESSED_SQL, HAV_AB, HAV_OG

COLS = ["bio1", "bio12"]


def _predictions(v, model, name):
    return v.cells.select("row", "col", F.lit(name).alias("model"), F.round(models.predict(model), 6).alias("suitability"))


def _effort_cells(v):
    """Cells with the survey records of their target group (``records``) and ``effort``, their logarithm."""
    e = v.eff.groupBy(F.floor(F.col("px_row") / 2.0).cast("int").alias("row"), F.floor(F.col("px_col") / 2.0).cast("int").alias("col")).agg(F.sum("cnt").alias("records"))
    return v.cells.join(e, ["row", "col"], "left").withColumn("records", F.coalesce("records", F.lit(0))).withColumn("effort", F.log1p("records"))


def _training(v, where="range_label = 'native'", extra=()):
    """Presences of the records ``where`` and all cells as background, with places, predictors and effort."""
    keep = ["longitude", "latitude", "effort", *COLS]
    cells = cut(_effort_cells(v).withColumnsRenamed({"lon": "longitude", "lat": "latitude"}))
    seen = v.occ_cells.where(where).select("row", "col", *extra).join(cells, ["row", "col"])
    return seen.select(F.lit(1).alias("y"), *extra, *keep), cells.select(F.lit(0).alias("y"), *keep)


def _folds(v, k):
    """Presences and background with their spatial block."""
    seen, cells = _training(v)
    return cut(models.spatial_blocks(seen.unionByName(cells), k, seed=3, anchors=seen))


@query("MOD1_maxent")
def mod1(v):
    """The setting with the best Boyce index and AUC over spatial blocks."""
    model, _ = models.tune_maxent(_folds(v, 2), COLS, [("l", 1.0), ("lq", 1.0), ("lq", 2.0)], folds=2, rounds=20)
    return _predictions(v, model, "maxent")


@query("MOD2_glm")
def mod2(v):
    return _predictions(v, models.fit_glm(v.pred, COLS), "glm")


@query("MOD2_random_forest")
def mod2b(v):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    # as many absences as presences for each of the repeats, whose predictions are averaged
    make = VectorAssembler(inputCols=COLS, outputCol="features")
    seen, rest = v.pred.where("y = 1"), v.pred.where("y = 0")
    n, out = seen.count(), None
    for r in range(3):
        d = make.transform(seen.unionAll(rest.orderBy(sampling.seeded(F.col("id"), r), "id").limit(n)))
        m = RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=6, seed=1 + r).fit(d)
        part = m.transform(make.transform(v.cells)).select("row", "col", vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionAll(part)
    return out.groupBy("row", "col").agg(F.lit("rf").alias("model"), F.round(F.avg("p"), 6).alias("suitability"))


@query("MOD2_gam")
def mod2d(v):
    """Ridge logistic regression on cubic splines of the predictors."""
    return _predictions(v, models.fit_glm(v.pred, COLS, kinds="s", ridge=2.0), "gam")


@query("MOD2_boosted_trees")
def mod2c(v):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    make = VectorAssembler(inputCols=COLS, outputCol="features")
    m = GBTClassifier(labelCol="y", maxIter=10, maxDepth=3, seed=1).fit(make.transform(v.pred))
    return m.transform(make.transform(v.cells)).select("row", "col", F.lit("brt").alias("model"), F.round(vector_to_array("probability")[1], 6).alias("suitability"))


@query("MOD3_weighted_ensemble")
def mod3(v):
    """Members weighed by their AUC over spatial blocks."""
    d = _folds(v, 2)
    fits = {
        "glm": lambda x: models.fit_glm(x, COLS, rounds=8), "gam": lambda x: models.fit_glm(x, COLS, kinds="s", ridge=2.0, rounds=8),
        "ppm": lambda x: models.fit_ppm(x, COLS, area=1000.0, rounds=10),
    }
    scored = [(name, models.cross_validate(d, fit, 2).agg(F.avg("auc")).first()[0]) for name, fit in fits.items()]
    weights = severity.ensemble_weights(v.spark.createDataFrame(scored, "member string, auc double"), 0.7).select("member", "weight").collect()  # a row for each member
    total = sum((models.predict(fits[r["member"]](d)) * r["weight"] for r in weights), F.lit(0.0))
    return v.cells.select("row", "col", F.round(total, 6).alias("suitability"))


@query("MOD4_spatial_blocks")
def mod4(v):
    return models.spatial_blocks(v.occ.where("range_label = 'native'"), 4, seed=3).select("source", "record_id", "fold")


@query("MOD4_cross_validation")
def mod4b(v):
    return models.cross_validate(_folds(v, 3), lambda x: models.fit_glm(x, COLS, rounds=6), 3)


@query("MOD5_point_process")
def mod5(v):
    return _predictions(v, models.fit_ppm(v.pred, COLS, area=1000.0, rounds=15), "ppm")


@query("MOD5_offset_test")
def mod5b(v):
    seen, cells = _training(v)
    return models.offset_test(cut(seen.unionByName(cells)), ["bio1"], "effort")


@query("MOD6_shared_bias")
def mod6(v):
    seen, cells = _training(v, "taxon_key IN (5000001, 5000002)", ["taxon_key"])
    d = seen.select(F.col("taxon_key").alias("species"), "y", "bio1", "effort")
    background = cells.select(F.explode(F.array(F.lit(5000001), F.lit(5000002))).alias("species"), "y", "bio1", "effort")
    return models.shared_bias(cut(d.unionByName(background)), "species", ["bio1"], "effort")


@query("MOD7_integrated_model")
def mod7(v):
    survey = v.ref_rec.select((F.col("occurrence_status") == "present").cast("int").alias("y"), F.floor(90.0 - F.col("latitude")).cast("int").alias("row"), F.floor(F.col("longitude") + 180.0).cast("int").alias("col"))
    survey = survey.join(v.cells.select("row", "col", *COLS), ["row", "col"]).select("y", *COLS)
    return _predictions(v, models.fit_integrated(v.pred.select("y", *COLS), survey, COLS, rounds=15), "integrated")


@query("MOD8_bias_conditioned")
def mod8(v):
    """Survey effort is a covariate of the fit; predictions hold it at its 95th percentile."""
    seen, cells = _training(v)
    model = models.fit_glm(cut(seen.unionByName(cells)), [*COLS, "effort"], rounds=8)
    top = stats.percentiles(cells, "effort", {"p95": 0.95}).first()[0]
    return _effort_cells(v).select("row", "col", F.round(models.predict(model, hold={"effort": top}), 6).alias("suitability"))


@query("MOD9_response_curves")
def mod9(v):
    return models.response_curves(v.pred, models.fit_glm(v.pred, COLS, rounds=8)).select("predictor", F.round("x", 6).alias("x"), F.round("mean", 6).alias("mean"))


_WEIGHTS = f"""{_ASSESSED_SQL}, t as (select record_id, longitude, latitude, tier from a where taxon_key = 5000001 and tier <> 'excluded'),
 k as (select a.record_id, {HAV_AB} as km from t a join t b on a.record_id <> b.record_id qualify row_number() over (partition by a.record_id order by km) <= 5),
 m as (select record_id, avg(km) as km from k group by 1), q as (select quantile_cont(km, 0.5) as middle from m),
 w as (select record_id, case tier when 'A' then 1e0 when 'B' then 0.75e0 else 0.5e0 end * greatest(least(km / middle, 10e0), 0.1e0) as w from t join m using (record_id) cross join q)
select record_id, round(w / avg(w) over (), 5) as weight from w"""


@query("MOD10_presence_weights", _WEIGHTS)
def mod10(v):
    """Weights by quality tier and by distance to the nearest other records."""
    t = cut(quality.assess(v.occ).where("taxon_key = 5000001 AND tier <> 'excluded'").select("record_id", "longitude", "latitude", "tier"))
    return models.presence_weights(models.density_factor(t, ["record_id"]), F.col("tier"), F.col("density")).select("record_id", F.round("weight", 5).alias("weight"))


@query("MOD11_native_range", "select record_id from occ where taxon_key = 5000001 and range_label = 'native'")
def mod11(v):
    return models.native_range(v.occ.where("taxon_key = 5000001"), "record_id")


@query("MOD11_native_range_cells", f"select row, col from (select row, col, lon as longitude, lat as latitude from cells) o where exists (select 1 from occ g where g.taxon_key = 5000001 and g.range_label = 'native' and abs(g.latitude - o.latitude) < 2e0 and {HAV_OG} <= 150e0)")
def mod11c(v):
    """The draft's area: cells within 150 km of its records."""
    occ = v.occ.where("taxon_key = 5000001")
    members = occ.join(models.native_range(occ, "record_id"), "record_id", "left_semi")
    cells = v.cells.select("row", "col", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"))
    return spatial.within(cells, members, 150.0).select("row", "col")


@query("MOD11_largest_cluster")
def mod11b(v):
    return models.native_range(v.occ.where("taxon_key = 5000001 AND range_label <> 'native'"), "record_id")


@query("MOD12_climate_crosscheck", "with r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2e0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2e0 as rb from (select c.suitability as a, s.suitability as b from cells c join scen s on s.row = c.row and s.col = c.col where s.name = 'g1_ssp245_p1') t) select round(corr(ra, rb), 5) as rho, case when corr(ra, rb) >= 0.9e0 then 'consistent' when corr(ra, rb) >= 0.7e0 then 'partly consistent' else 'inconsistent' end as verdict from r")
def mod12(v):
    d = v.cells.select("row", "col", F.col("suitability").alias("a")).join(v.scen.where("name = 'g1_ssp245_p1'").select("row", "col", F.col("suitability").alias("b")), ["row", "col"])
    rho = F.col("rho")
    return stats.spearman(d, "a", "b").select(F.round(rho, 5).alias("rho"), F.when(rho >= 0.9, "consistent").when(rho >= 0.7, "partly consistent").otherwise("inconsistent").alias("verdict"))


@query("MOD13_predictor_sets")
def mod13(v):
    """Predictor sets ranked by models that are scored on the spatial blocks they have not seen."""
    return models.compare_sets(_folds(v, 3), {"temperature": ["bio1"], "both": COLS}, lambda d, cols: models.fit_glm(d, cols, rounds=6), 3)


_ABSENT = f"""with e as (select cast(floor(px_row / 2e0) as int) as row, cast(floor(px_col / 2e0) as int) as col from eff group by 1, 2 having sum(cnt) >= 30),
 g as (select c.row, c.col, c.lon as longitude, c.lat as latitude, c.suitability from cells c join e using (row, col) where (select count(*) from edges p where p.poly = 0 and ((p.y1 > c.lat) <> (p.y2 > c.lat)) and c.lon < (p.x2 - p.x1) * (c.lat - p.y1) / (p.y2 - p.y1) + p.x1) % 2 = 1),
 n as (select g.suitability as s, 0 as y from g where not exists (select 1 from occ o where abs(o.latitude - g.latitude) < 1e0 and {HAV_OG} <= 100e0)),
 b as (select * from n union all select c.suitability, 1 from occ_cells o join cells c on c.row = o.row and c.col = o.col where o.range_label = 'native'),
 r as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2e0 as rank from b), u as (select sum(rank) filter (y = 1) as r1, count(*) filter (y = 1) as p, count(*) filter (y = 0) as q from r)
select (select count(*) from n) as n, round((select avg(s) from n), 6) as mean, round((r1 - p * (p + 1) / 2e0) / (p * 1e0 * q), 6) as auc from u"""


@query("MOD14_inferred_absences", _ABSENT)
def mod14(v):
    """Well-surveyed cells of the native range without a record within 100 km, scored against the presences."""
    cells = _effort_cells(v).where("records >= 30").select("row", "col", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), "suitability")
    native = cells.join(spatial.in_polygons(cells, v.edges.where("poly = 0"), ["row", "col"]), ["row", "col"], "left_semi")
    absent = cut(spatial.within(native, v.occ, 100.0, how="left_anti").select(F.lit(0).alias("y"), F.col("suitability").alias("s")))
    scored = absent.unionAll(v.pred.where("y = 1").select("y", "s"))
    return absent.agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean")).crossJoin(stats.auc(scored).select(F.round("auc", 6).alias("auc")))  # one row each


@query("MOD15_transferability")
def mod15(v):
    d = v.occ_cells.join(v.cells, ["row", "col"])
    background = v.cells.select(F.lit(0).alias("y"), *COLS)
    train = d.where("range_label = 'native'").select(F.lit(1).alias("y"), *COLS).unionByName(background)
    test = d.where("range_label = 'introduced'").select(F.lit(1).alias("y"), *COLS).unionByName(background)
    scored = cut(test.select("y", models.predict(models.fit_glm(train, COLS, rounds=8)).alias("s")))
    return stats.auc(scored).crossJoin(stats.boyce(scored))  # one row each


@query("GRD19_virtual_species")
def grd19(v):
    return virtual.benchmark(v.cells, v.eff)


@query("SMP5_completeness_absences")
def smp5c(v):
    e = v.eff.groupBy(F.floor(F.col("px_row") / 2.0).cast("int").alias("row"), F.floor(F.col("px_col") / 2.0).cast("int").alias("col")).agg(F.sum("cnt").alias("effort")).where("effort >= 30")
    cells = v.cells.join(e, ["row", "col"]).select((F.col("row") * 360 + F.col("col")).cast("long").alias("id"), F.col("lon").alias("longitude"), F.col("lat").alias("latitude"))
    from florascope.operators.spatial import within

    return sampling.distance_thin(within(cells, v.occ, 100.0, how="left_anti"), "id", 300.0, seed=2).select("id")
