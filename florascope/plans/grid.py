"""Queries over grids: projections, zones, diagnostics, scenarios and zonal sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from florascope.operators import diagnostics, grid, order, spatial
from florascope.plans.spatial import _DISK, _IN_POLYGON

from .catalog import query

_KM2 = "12392.1424e0 * cos(radians({}))"
#: Zones from a threshold, a native polygon and occupied disks; every zonal query starts from this table.
_NATIVE = _IN_POLYGON.replace("o.record_id", "o.row, o.col").replace("from occ o", "from (select row, col, lon as longitude, lat as latitude from cells) o").replace("group by 1, 2", "group by 1, 2, 3")
_ZONED = f"""with nat as (select distinct row, col from ({_NATIVE}) t where poly = 0), oc as (select row, col from (select row, col, lon as longitude, lat as latitude from cells) o where {_DISK}),
 z as (select c.*, {_KM2.format('c.lat')} as area, n.row is not null as native, oc.row is not null as occupied, c.suitability >= 0.3e0 as suitable, case when c.suitability >= 0.3e0 and n.row is not null then 1 when c.suitability >= 0.3e0 and oc.row is not null then 2 when c.suitability >= 0.3e0 then 3 else 0 end as zone
 from cells c left join nat n on n.row = c.row and n.col = c.col left join oc on oc.row = c.row and oc.col = c.col)"""


def zoned(v):
    cells = v.cells
    points = cells.select("row", "col", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"))
    native = spatial.in_polygons(points, v.edges.where("poly = 0"), ["row", "col"]).select("row", "col").distinct().withColumn("_n", F.lit(True))
    occupied = spatial.within_degrees(points, v.occ.where("range_label = 'native'"), 1.5).select("row", "col").withColumn("_o", F.lit(True))
    d = cells.join(native, ["row", "col"], "left").join(occupied, ["row", "col"], "left")
    d = d.withColumns({"native": F.coalesce("_n", F.lit(False)), "occupied": F.coalesce("_o", F.lit(False)), "suitable": F.col("suitability") >= 0.3, "area": grid.area()}).drop("_n", "_o")
    return d.withColumn("zone", grid.zones(F.col("suitable"), F.col("native"), F.col("occupied")))


@query("GRD1_suitability", "select row, col, round(1e0 / (1e0 + ((bio1 - 15e0) / 8e0) * ((bio1 - 15e0) / 8e0) + ((bio12 - 900e0) / 700e0) * ((bio12 - 900e0) / 700e0)), 6) as suitability from grid")
def grd1(v):
    a, b = (F.col("bio1") - 15.0) / 8.0, (F.col("bio12") - 900.0) / 700.0
    return v.grid.select("row", "col", F.round(1.0 / (1.0 + a * a + b * b), 6).alias("suitability"))


def _mess_sql(c: str) -> str:
    return f"""n_{c} as (select count(*) as n, min(v) as mn, max(v) as mx from (select {c} as v from pred) t), u_{c} as (select v, sum(m) as m from (select {c} as v, 1 as m from pred union all select {c}, 0 from tgt) t group by v),
 f_{c} as (select v, (sum(m) over (order by v) - m) * 100e0 / n as f, mn, mx from u_{c} cross join n_{c}), s_{c} as (select v, case when f = 0 then (v - mn) / (mx - mn) * 100e0 when f <= 50 then 2e0 * f when f < 100 then 2e0 * (100e0 - f) else (mx - v) / (mx - mn) * 100e0 end as sim from f_{c})"""


_MESS = f"with tgt as (select row, col, lat, bio1, bio12, suitability from cells), {_mess_sql('bio1')}, {_mess_sql('bio12')}, m as (select t.row, t.col, t.lat, t.suitability, least(a.sim, b.sim) as mess, case when a.sim <= b.sim then 'bio1' else 'bio12' end as most_dissimilar from tgt t join s_bio1 a on a.v = t.bio1 join s_bio12 b on b.v = t.bio12)"


def _mess(v):
    return grid.mess(v.pred.select("bio1", "bio12"), v.cells, ["bio1", "bio12"])


@query("GRD2_mess", _MESS + " select row, col, round(mess, 4) as mess, most_dissimilar from m")
def grd2(v):
    return _mess(v).select("row", "col", F.round("mess", 4).alias("mess"), "most_dissimilar")


@query("GRD7_extrapolation_mask", _MESS + f" select mess < 0 as extrapolated, count(*) as n, round(sum({_KM2.format('lat')}), 2) as km2 from m group by 1")
def grd7(v):
    return _mess(v).groupBy((F.col("mess") < 0).alias("extrapolated")).agg(F.count("*").alias("n"), F.round(F.sum(grid.area()), 2).alias("km2"))


_NT1 = "with r as (select min(bio1) as a1, max(bio1) as z1, min(bio12) as a2, max(bio12) as z2 from pred where s > 0.4e0), n as (select row, col, least(bio1 - a1, z1 - bio1, 0) / (z1 - a1) as u1, least(bio12 - a2, z2 - bio12, 0) / (z2 - a2) as u2 from cells cross join r)"


@query("GRD3_exdet_nt1", _NT1 + " select row, col, round(u1 + u2, 6) as nt1, case when u1 <= u2 then 'bio1' else 'bio12' end as most from n")
def grd3(v):
    d = diagnostics.nt1(v.cells, v.pred.where("s > 0.4"), ["bio1", "bio12"])
    return d.select("row", "col", F.round("nt1", 6).alias("nt1"), F.col("nt1_most").alias("most"))


@query("GRD3_exdet_nt2", "with m as (select avg(bio1) as m1, avg(bio12) as m2, var_samp(bio1) as v1, var_samp(bio12) as v2, covar_samp(bio1, bio12) as c from pred), q as (select m1, m2, v2 / (v1 * v2 - c * c) as i11, v1 / (v1 * v2 - c * c) as i22, -c / (v1 * v2 - c * c) as i12 from m), d as (select max((bio1 - m1) * (bio1 - m1) * i11 + (bio12 - m2) * (bio12 - m2) * i22 + 2e0 * (bio1 - m1) * (bio12 - m2) * i12) as top from pred cross join q) select row, col, round(((bio1 - m1) * (bio1 - m1) * i11 + (bio12 - m2) * (bio12 - m2) * i22 + 2e0 * (bio1 - m1) * (bio12 - m2) * i12) / top, 5) as nt2 from cells cross join q cross join d")
def grd3b(v):
    d = diagnostics.nt2(v.cells, v.pred, ["bio1", "bio12"])
    return d.select("row", "col", F.round("nt2", 5).alias("nt2"))


_KNN = "select a.vec_id, round(min(sqrt(list_sum(list_transform(list_zip(cast(a.embedding as double[]), cast(b.embedding as double[])), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))), 5) as distance from embeddings a join embeddings b on {} group by 1"


@query("JOIN9_nearest_in_feature_space", _KNN.format("b.label = 0 and a.label <> 0"))
def join9(v):
    d = diagnostics.nearest_distance(v.embeddings.where("label <> 0"), v.embeddings.where("label = 0"), "vec_id", "embedding")
    return d.select("vec_id", F.round("distance", 5).alias("distance"))


@query("JOIN9_cross_fold", _KNN.format("a.label <> b.label"))
def join9b(v):
    d = diagnostics.nearest_distance(v.embeddings, v.embeddings, "vec_id", "embedding", fold="label")
    return d.select("vec_id", F.round("distance", 5).alias("distance"))


_SPACE = "with r as (select cast(l_extendedprice as double) / 1000e0 as a, cast(l_quantity as double) as b from lineitem), d as (select t.id, row_number() over (partition by t.id order by sqrt((t.a - r.a) * (t.a - r.a) + (t.b - r.b) * (t.b - r.b))) as nth, sqrt((t.a - r.a) * (t.a - r.a) + (t.b - r.b) * (t.b - r.b)) as d, count(*) over (partition by t.id) as n from ({}) t cross join r) select id, round(avg(d), 5) as distance from d where nth <= {} group by id"


def _prices(v):
    return v.lineitem.select(F.array(F.col("l_extendedprice").cast("double") / 1000.0, F.col("l_quantity").cast("double")).alias("v"))


@query("JOIN9_metric_tree", "with r as (select cast(l_extendedprice as double) / 1000e0 as a, cast(l_quantity as double) as b from lineitem), t as (select p_partkey as id, cast(p_retailprice as double) / 10e0 as a, cast(p_size as double) as b from part) select id, round(list_avg(min(sqrt((t.a - r.a) * (t.a - r.a) + (t.b - r.b) * (t.b - r.b)), 3)), 5) as distance from t cross join r group by id")
def join9c(v):
    """The three nearest of all line items for each part: a reference beyond the broadcast bound from some 20 000 rows on."""
    t = v.part.select(F.col("p_partkey").alias("id"), F.array(F.col("p_retailprice").cast("double") / 10.0, F.col("p_size").cast("double")).alias("v"))
    return diagnostics.nearest_distance(t, _prices(v), "id", "v", k=3).select("id", F.round("distance", 5).alias("distance"))


@query("GRD4_nearest_percent", _SPACE.format("select s_suppkey as id, cast(s_acctbal as double) / 100e0 as a, cast(s_nationkey as double) as b from supplier", "greatest(1, round(n / 100e0))"))
def grd4b(v):
    """The mean distance to the nearest 1 % of all line items, by shells of counted bins."""
    t = v.supplier.select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal").cast("double") / 100.0, F.col("s_nationkey").cast("double")).alias("v"))
    ref = _prices(v)
    return diagnostics.nearest_distance(t, ref, "id", "v", k=max(1, round(ref.count() / 100))).select("id", F.round("distance", 5).alias("distance"))


@query("GRD4_mop_shape_aoa")
def grd4(v):
    cols = ["bio1", "bio4", "bio12"]
    ref = v.cells.where("suitability > 0.5").select(*cols, (F.col("row") % 4).alias("fold"))
    return diagnostics.distances(v.cells, ref, cols, "fold").select("row", "col", "mop", "shape", "aoa", "mop_out", "shape_out", "aoa_out")


_FLAGS = "select row, col, cast(bio1 < 0 as int) + cast(bio1 > 25 as int) + cast(bio12 < 600 as int) + cast(bio4 > 900 as int) + cast(suitability < 0.1e0 as int) as consensus"


@query("GRD5_consensus", _FLAGS + " from cells")
def grd5(v):
    flags = [F.col("bio1") < 0, F.col("bio1") > 25, F.col("bio12") < 600, F.col("bio4") > 900, F.col("suitability") < 0.1]
    return v.cells.select("row", "col", diagnostics.consensus(flags).alias("consensus"))


@query("AGG27_consensus_areas", f"select consensus, round(sum({_KM2.format('lat')}), 2) as km2 from ({_FLAGS}, lat from cells) t group by 1")
def agg27(v):
    flags = [F.col("bio1") < 0, F.col("bio1") > 25, F.col("bio12") < 600, F.col("bio4") > 900, F.col("suitability") < 0.1]
    return v.cells.groupBy(diagnostics.consensus(flags).alias("consensus")).agg(F.round(F.sum(grid.area()), 2).alias("km2"))


@query("GRD6_zones", _ZONED + " select row, col, zone from z")
def grd6(v):
    return zoned(v).select("row", "col", "zone")


@query("AGG26_zonal_sums", _ZONED + """ select round(sum(area), 1) as land, round(sum(area) filter (not native), 1) as nonnative, round(sum(area) filter (suitable and native), 1) as native_suitable, round(sum(area) filter (zone = 2), 1) as established, round(sum(area) filter (zone = 3), 1) as candidate,
 round(sum(area * suitability) filter (zone = 3), 1) as candidate_suitability, round(sum(area) filter (zone = 3 and bio1 between 5e0 and 25e0), 1) as candidate_envelope from z""")
def agg26(v):
    total = lambda cond, x=F.col("area"): F.round(F.sum(F.when(cond, x)), 1)
    cand = F.col("zone") == 3
    return zoned(v).agg(
        F.round(F.sum("area"), 1).alias("land"), total(~F.col("native")).alias("nonnative"), total(F.col("suitable") & F.col("native")).alias("native_suitable"), total(F.col("zone") == 2).alias("established"),
        total(cand).alias("candidate"), total(cand, F.col("area") * F.col("suitability")).alias("candidate_suitability"), total(cand & F.col("bio1").between(5.0, 25.0)).alias("candidate_envelope"),
    )


@query("AGG28_tile_ranking", _ZONED + " select tile, km2 from (select concat(cast(abs(cast(floor(lat / 10) * 10 + 10 as int)) as varchar), case when floor(lat / 10) * 10 + 10 >= 0 then 'N' else 'S' end, ' ', cast(abs(cast(floor(lon / 10) * 10 as int)) as varchar), case when floor(lon / 10) * 10 >= 0 then 'E' else 'W' end) as tile, round(sum(area), 1) as km2 from z where zone = 3 group by 1) t order by km2 desc, tile limit 5")
def agg28(v):
    t = zoned(v).where("zone = 3").groupBy(grid.tile_label(F.col("lat"), F.col("lon")).alias("tile")).agg(F.round(F.sum("area"), 1).alias("km2"))
    return t.orderBy(F.desc("km2"), "tile").limit(5)


@query("AGG34_unsampled_share", _ZONED + ", e as (select cast(floor(px_row / 2e0) as int) as row, cast(floor(px_col / 2e0) as int) as col, sum(cnt) as cnt from eff group by 1, 2) select zone, round(sum(case when coalesce(e.cnt, 0) <= 0 then area else 0e0 end) / sum(area), 6) as share from z left join e on e.row = z.row and e.col = z.col group by 1")
def agg34(v):
    e = v.eff.groupBy(F.floor(F.col("px_row") / 2.0).cast("int").alias("row"), F.floor(F.col("px_col") / 2.0).cast("int").alias("col")).agg(F.sum("cnt").alias("cnt"))
    d = zoned(v).join(e, ["row", "col"], "left")
    return d.groupBy("zone").agg(F.round(F.sum(F.when(F.coalesce("cnt", F.lit(0)) <= 0, F.col("area")).otherwise(0.0)) / F.sum("area"), 6).alias("share"))


@query("GRD8_envelope", "with e as (select quantile_cont(bio1, 0.05) as a1, quantile_cont(bio1, 0.95) as z1, quantile_cont(bio12, 0.05) as a2, quantile_cont(bio12, 0.95) as z2 from pred where y = 1) select row, col from cells cross join e where bio1 between a1 and z1 and bio12 between a2 and z2")
def grd8(v):
    e = order.ends(v.pred.where("y = 1"), {c: {f"{c}a": 0.05, f"{c}z": 0.95} for c in ("bio1", "bio12")})
    return v.cells.crossJoin(F.broadcast(e)).where("bio1 BETWEEN bio1a AND bio1z AND bio12 BETWEEN bio12a AND bio12z").select("row", "col")  # e is one row


_S = "1e0 / (1e0 + (({a} - 15e0) / 8e0) * (({a} - 15e0) / 8e0) + (({b} - 900e0) / 700e0) * (({b} - 900e0) / 700e0))"


@query("GRD9_limiting_factor", f"with g as (select row, col, {_S.format(a='14e0', b='bio12')} - suitability as g1, {_S.format(a='bio1', b='950e0')} - suitability as g2 from cells) select case when greatest(g1, g2) <= 1e-6 then 'none' when g1 >= g2 then 'bio1' else 'bio12' end as limiting, count(*) as n from g group by 1")
def grd9(v):
    s = lambda a, b: 1.0 / (1.0 + ((a - 15.0) / 8.0) * ((a - 15.0) / 8.0) + ((b - 900.0) / 700.0) * ((b - 900.0) / 700.0))
    gains = {"bio1": s(F.lit(14.0), F.col("bio12")), "bio12": s(F.col("bio1"), F.lit(950.0))}
    return v.cells.groupBy(grid.limiting(F.col("suitability"), gains).alias("limiting")).agg(F.count("*").alias("n"))


@query("GRD10_ensemble_agreement", "with m as (select row, col, 0.5e0 * (suitability >= 0.3e0)::int + 0.3e0 * (bio1 > 10)::int + 0.2e0 * (bio12 > 900)::int as yes, 0.5e0 * suitability + 0.3e0 * (bio1 > 10)::int + 0.2e0 * (bio12 > 900)::int >= 0.3e0 as called from cells) select row, col, round(case when called then yes else 1e0 - yes end, 6) as agreement from m")
def grd10(v):
    a, b = (F.col("bio1") > 10).cast("double"), (F.col("bio12") > 900).cast("double")
    yes = (F.col("suitability") >= 0.3).cast("double") * 0.5 + a * 0.3 + b * 0.2
    called = F.col("suitability") * 0.5 + a * 0.3 + b * 0.2 >= 0.3
    return v.cells.select("row", "col", F.round(F.when(called, yes).otherwise(1.0 - yes), 6).alias("agreement"))


@query("GRD11_binary_map", "select row, col, cast(suitability >= 0.3e0 as int) as suitable from cells")
def grd11(v):
    return v.cells.select("row", "col", (F.col("suitability") >= 0.3).cast("int").alias("suitable"))


_CHANGE = "select c.row, c.col, c.lat, cast(s.suitability >= 0.25e0 as int) + 2 * cast(c.suitability >= 0.3e0 as int) as code from cells c join scen s on s.row = c.row and s.col = c.col where s.name = 'g1_ssp585_p1'"


def _change(v):
    after = v.scen.where("name = 'g1_ssp585_p1'").select("row", "col", F.col("suitability").alias("later"))
    return v.cells.join(after, ["row", "col"]).withColumn("code", grid.change_code(F.col("suitability") >= 0.3, F.col("later") >= 0.25))


@query("GRD12_change_map", f"select row, col, code from ({_CHANGE}) t")
def grd12(v):
    return _change(v).select("row", "col", "code")


@query("AGG31_change_areas", f"select code, count(*) as n, round(sum({_KM2.format('lat')}), 1) as km2 from ({_CHANGE}) t group by 1")
def agg31(v):
    return _change(v).groupBy("code").agg(F.count("*").alias("n"), F.round(F.sum(grid.area()), 1).alias("km2"))


@query("JOIN15_grid_overlay", "with a as materialized (select row, col, suitability from scen where name = 'g1_ssp245_p1'), b as materialized (select row, col, suitability from scen where name = 'g2_ssp245_p1') select row, col, round(a.suitability, 6) as g1, round(b.suitability, 6) as g2 from a join b using (row, col)")
def join15(v):
    o = grid.overlay({"g1": v.scen.where("name = 'g1_ssp245_p1'"), "g2": v.scen.where("name = 'g2_ssp245_p1'")}, "suitability")
    return o.select("row", "col", F.round("g1", 6).alias("g1"), F.round("g2", 6).alias("g2"))


@query("JOIN16_coarse_lookup", "select c.row, c.col, coalesce(e.cnt, 0) as cnt from cells c left join (select px_row, px_col, cast(sum(cnt) as bigint) as cnt from eff group by 1, 2) e on e.px_row = least(greatest(cast(floor((90e0 - c.lat) / 0.5e0) as int), 0), 359) and e.px_col = least(greatest(cast(floor((c.lon + 180e0) / 0.5e0) as int), 0), 719)")
def join16(v):
    clip = lambda c, top: F.least(F.greatest(F.floor(c / 0.5).cast("int"), F.lit(0)), F.lit(top))
    e = v.eff.groupBy("px_row", "px_col").agg(F.sum("cnt").alias("cnt"))
    c = v.cells.select("row", "col", clip(90.0 - F.col("lat"), 359).alias("px_row"), clip(F.col("lon") + 180.0, 719).alias("px_col"))
    return c.join(e, ["px_row", "px_col"], "left").select("row", "col", F.coalesce("cnt", F.lit(0)).alias("cnt"))


_PRIORITY = "with e as (select cast(floor(px_row / 2e0) as int) as row, cast(floor(px_col / 2e0) as int) as col, sum(cnt) as cnt from eff group by 1, 2), x as (select max(cnt) as top from e), p as (select c.row, c.col, c.suitability * (1 - log10(coalesce(e.cnt, 0) + 1e0) / log10(top + 1e0)) * (0.5e0 + 0.5e0 * (case when bio1 > 20 then 1e0 else 0e0 end)) as score from cells c left join e on e.row = c.row and e.col = c.col cross join x)"


def _priority(v):
    e = v.eff.groupBy(F.floor(F.col("px_row") / 2.0).cast("int").alias("row"), F.floor(F.col("px_col") / 2.0).cast("int").alias("col")).agg(F.sum("cnt").alias("cnt"))
    d = v.cells.join(e, ["row", "col"], "left").crossJoin(F.broadcast(e.agg(F.max("cnt").alias("top"))))  # one row
    return d.withColumn("score", grid.priority(F.col("suitability"), F.coalesce("cnt", F.lit(0)), F.col("top"), (F.col("bio1") > 20).cast("double")))


@query("GRD13_priority_map", _PRIORITY + " select row, col, round(score, 6) as score from p")
def grd13(v):
    return _priority(v).select("row", "col", F.round("score", 6).alias("score"))


@query("WIN7_top_priority_cells", _PRIORITY + " select row, col, round(score, 6) as score from p order by round(score, 6) desc, row, col limit 25")
def win7(v):
    return _priority(v).select("row", "col", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "row", "col").limit(25)


@query("GRD14_scenario_projection", "select row, col, round(suitability, 6) as suitability, extrapolated from scen where name = 'g2_ssp245_p1'")
def grd14(v):
    return v.scen.where("name = 'g2_ssp245_p1'").select("row", "col", F.round("suitability", 6).alias("suitability"), "extrapolated")


_GCM = "select row, col, lat, avg(suitability) as mean_suitability, count(*) filter (suitability >= 0.3e0) as votes, bool_or(extrapolated) as any_x from (select s.*, 90e0 - s.row - 0.5e0 as lat0 from scen s) s where name like '%ssp245%' group by 1, 2, 3 having count(*) >= 2"


@query("GRD15_gcm_ensemble", f"select row, col, round(mean_suitability, 6) as mean_suitability, votes, any_x from ({_GCM}) t")
def grd15(v):
    e = grid.ensemble(v.scen.where("name LIKE '%ssp245%'"), 0.3)
    return e.select("row", "col", F.round("mean_suitability", 6).alias("mean_suitability"), "votes", F.col("any_extrapolated").alias("any_x"))


@query("AGG32_votes_by_area", f"select votes, round(sum({_KM2.format('lat')}), 1) as km2 from ({_GCM}) t group by 1")
def agg32(v):
    return grid.ensemble(v.scen.where("name LIKE '%ssp245%'"), 0.3).groupBy("votes").agg(F.round(F.sum(grid.area()), 1).alias("km2"))


@query("AGG33_scenario_groups", "select regexp_extract(name, '_([^_]*_[^_]*)$', 1) as grp, count(distinct name) as n from scen group by 1 having count(distinct name) >= 2")
def agg33(v):
    from florascope.functions.scalars import scenario_group

    return v.scen.groupBy(scenario_group(F.col("name")).alias("grp")).agg(F.count_distinct("name").alias("n")).where("n >= 2")


@query("GRD16_regional_projection", f"select row, col, round({_S.format(a='bio1', b='bio12')}, 6) as suitability from grid where row between 30 and 59 and col between 175 and 229 and (select count(*) from grid where row between 30 and 59 and col between 175 and 229) <= 16000000")
def grd16(v):
    a, b = (F.col("bio1") - 15.0) / 8.0, (F.col("bio12") - 900.0) / 700.0
    window = v.grid.where("row BETWEEN 30 AND 59 AND col BETWEEN 175 AND 229")
    allowed = window.agg((F.count("*") <= 16_000_000).alias("ok"))
    return window.crossJoin(F.broadcast(allowed)).where("ok").select("row", "col", F.round(1.0 / (1.0 + a * a + b * b), 6).alias("suitability"))  # one row


@query("GRD17_effort_layer", "select px_row, px_col, round(log10(cnt + 1e0), 6) as log_effort, case when cnt >= 60 then 'expansion' when cnt >= 1 then 'discovery' else 'unknown' end as class from eff")
def grd17(v):
    c = F.col("cnt")
    return v.eff.select("px_row", "px_col", F.round(F.log10(c + 1.0), 6).alias("log_effort"), F.when(c >= 60, "expansion").when(c >= 1, "discovery").otherwise("unknown").alias("class"))


@query("GRD18_legend_bins", "select case when suitability < 0.1e0 then 0 when suitability < 0.3e0 then 1 when suitability < 0.5e0 then 2 when suitability < 0.7e0 then 3 else 4 end as bin, count(*) as n from cells group by 1")
def grd18(v):
    s = F.col("suitability")
    return v.cells.groupBy(F.when(s < 0.1, 0).when(s < 0.3, 1).when(s < 0.5, 2).when(s < 0.7, 3).otherwise(4).alias("bin")).agg(F.count("*").alias("n"))


_BOXES = "(values ('iberia', -10e0, 35e0, 4e0, 44e0, true), ('sahara', 0e0, 15e0, 30e0, 30e0, false), ('plains', -105e0, 35e0, -90e0, 49e0, true)) b(name, west, south, east, north, expect)"
_BOX_STATS = f"select name, expect, sum(area) as land, sum(area * suitability) / sum(area) as mean, sum(case when suitability >= 0.3e0 then area else 0e0 end) / sum(area) as fraction from (select *, {_KM2.format('lat')} as area from cells) c join {_BOXES} on lon between west and east and lat between south and north group by 1, 2"


def _box_stats(v):
    boxes = v.spark.createDataFrame([("iberia", -10.0, 35.0, 4.0, 44.0, True), ("sahara", 0.0, 15.0, 30.0, 30.0, False), ("plains", -105.0, 35.0, -90.0, 49.0, True)], "name string, west double, south double, east double, north double, expect boolean")
    d = v.cells.withColumn("area", grid.area()).join(F.broadcast(boxes), F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north")))  # a row for each named region
    return d.groupBy("name", "expect").agg(F.sum("area").alias("land"), (F.sum(F.col("area") * F.col("suitability")) / F.sum("area")).alias("mean"), (F.sum(F.when(F.col("suitability") >= 0.3, F.col("area")).otherwise(0.0)) / F.sum("area")).alias("fraction"))


@query("AGG29_box_stats", f"select name, round(land, 1) as land, round(mean, 6) as mean, round(fraction, 6) as fraction from ({_BOX_STATS}) t")
def agg29(v):
    return _box_stats(v).select("name", F.round("land", 1).alias("land"), F.round("mean", 6).alias("mean"), F.round("fraction", 6).alias("fraction"))


@query("AGG30_region_checks", f"with r as (select expect, case when expect then fraction >= 0.25e0 else fraction <= 0.1e0 end as ok from ({_BOX_STATS}) t) select avg(case when ok then 1e0 else 0e0 end) filter (expect) >= 0.75e0 and bool_and(ok) filter (not expect) as passes, count(*) filter (ok) as n_ok from r")
def agg30(v):
    r = _box_stats(v).withColumn("ok", F.when(F.col("expect"), F.col("fraction") >= 0.25).otherwise(F.col("fraction") <= 0.1))
    return r.agg(((F.avg(F.when(F.col("expect"), F.col("ok").cast("double"))) >= 0.75) & F.bool_and(F.when(~F.col("expect"), F.col("ok")))).alias("passes"), F.count_if("ok").alias("n_ok"))


@query("AGG45_soil_mean", "select row, col, round((v1 * 5e0 + coalesce(v2 * 10e0, 0e0) + v3 * 15e0) / (5e0 + case when v2 is not null then 10e0 else 0e0 end + 15e0), 6) as ph from (select row, col, 5e0 + bio1 / 40e0 as v1, case when (row + col) % 3 <> 0 then 6e0 + bio4 / 2000e0 end as v2, 7e0 - bio12 / 4000e0 as v3 from cells) t")
def agg45(v):
    d = v.cells.select("row", "col", (F.col("bio1") / 40.0 + 5.0).alias("v1"), F.when((F.col("row") + F.col("col")) % 3 != 0, F.col("bio4") / 2000.0 + 6.0).alias("v2"), (7.0 - F.col("bio12") / 4000.0).alias("v3"))
    depth = {"v1": 5.0, "v2": 10.0, "v3": 15.0}
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in depth.items()), F.lit(0.0))
    return d.select("row", "col", F.round(top / sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in depth.items()), F.lit(0.0)), 6).alias("ph"))


@query("AGG46_average_resampling", "select cast(floor(row / 2e0) as int) as trow, cast(floor(col / 2e0) as int) as tcol, round(avg(bio1 * 10e0 * 0.1e0 - 273.15e0), 5) as value from cells group by 1, 2")
def agg46(v):
    return v.cells.groupBy(F.floor(F.col("row") / 2.0).cast("int").alias("trow"), F.floor(F.col("col") / 2.0).cast("int").alias("tcol")).agg(F.round(F.avg(F.col("bio1") * 10.0 * 0.1 - 273.15), 5).alias("value"))


@query("MOD_expr_cloglog", "select row, col, round(1e0 - exp(-exp(greatest(least((bio1 - 20e0) / 4e0, 30e0), -30e0))), 6) as p from cells")
def mod_expr(v):
    from florascope.functions.scalars import cloglog

    return v.cells.select("row", "col", F.round(cloglog((F.col("bio1") - 20.0) / 4.0), 6).alias("p"))
