"""Queries of spatial joins, quality tests and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from florascope.functions import scalars as sc
from florascope.functions.geo import HAV_SQL, cell_area_km2, hav_km, mercator_x, mercator_y
from florascope.operators import order, quality, sampling, spatial
from florascope.operators.store import first_per_key

from .catalog import query

KEY = ["source", "record_id"]
HAV_OG, HAV_AB = HAV_SQL.format(a="o", b="g"), HAV_SQL.format(a="a", b="b")


@query("JOIN1_left_equi", "select o.source, o.record_id, count(a.kind) as n from occ o left join ann a on a.source = o.source and a.record_id = o.record_id group by 1, 2")
def join1(v):
    n = v.ann.groupBy(*KEY).agg(F.count("kind").alias("n"))
    return v.occ.select(*KEY).join(n, KEY, "left").select(*KEY, F.coalesce("n", F.lit(0)).alias("n"))


@query("JOIN2_cross_source_anti", "select record_id from occ where source = 'iNaturalist' and record_id not in (select inat_crossref_id from occ where inat_crossref_id is not null)")
def join2(v):
    ids = v.occ.where("inat_crossref_id IS NOT NULL").select(F.col("inat_crossref_id").alias("record_id"))
    return v.occ.where("source = 'iNaturalist'").select("record_id").join(ids, "record_id", "left_anti")


_IN_POLYGON = "select o.record_id, e.poly from occ o join edges e on (e.y1 > o.latitude) <> (e.y2 > o.latitude) and o.longitude < (e.x2 - e.x1) * (o.latitude - e.y1) / (e.y2 - e.y1) + e.x1 group by 1, 2 having count(*) % 2 = 1"


@query("JOIN3_point_in_polygon", _IN_POLYGON)
def join3(v):
    return spatial.in_polygons(v.occ, v.edges, ["record_id"])


@query("FLT9_label_derivation", f"with p as ({_IN_POLYGON}) select o.record_id, case when range_label <> 'unknown' then range_label when p.record_id is not null then 'native' else 'introduced' end as label from occ o left join (select record_id from p where poly = 0) p on p.record_id = o.record_id")
def flt9(v):
    inside = spatial.in_polygons(v.occ.where("range_label = 'unknown'"), v.edges.where("poly = 0"), ["record_id"]).select("record_id", F.lit(1).alias("i"))
    return v.occ.join(inside, "record_id", "left").select("record_id", F.when(F.col("range_label") != "unknown", F.col("range_label")).when(F.col("i") == 1, "native").otherwise("introduced").alias("label"))


@query("JOIN4_point_to_cell", "select o.record_id, c.suitability from occ_cells o join cells c on c.row = o.row and c.col = o.col")
def join4(v):
    return v.occ_cells.select("record_id", "row", "col").join(v.cells.select("row", "col", "suitability"), ["row", "col"]).select("record_id", "suitability")


@query("JOIN5_nearest_reference", f"select o.record_id, round(min({HAV_OG}), 3) as km from occ o cross join (select * from gaz where kind = 'capital') g group by 1")
def join5(v):
    return spatial.nearest_km(v.occ, v.gaz.where("kind = 'capital'"), ["record_id"]).select("record_id", F.round("km", 3).alias("km"))


@query("JOIN6_radius_semi", f"select record_id from occ o where exists (select 1 from gaz g where g.kind = 'institution' and abs(g.latitude - o.latitude) < 0.1e0 and {HAV_OG} <= 1e0)")
def join6(v):
    return spatial.within(v.occ.select("record_id", "longitude", "latitude"), v.gaz.where("kind = 'institution'"), 1.0).select("record_id")


@query("JOIN7_space_time_semi", f"select o.dataset_id, o.record_id from ref_rec o where exists (select 1 from occ g where g.taxon_key = o.taxon_key and abs(g.latitude - o.latitude) < 0.01e0 and {HAV_OG} <= 0.1e0 and (g.event_date is null or o.event_date is null or abs(date_diff('day', g.event_date, o.event_date)) <= 1))")
def join7(v):
    same = (F.col("taxon_key") == F.col("_taxon_key")) & (F.col("event_date").isNull() | F.col("_event_date").isNull() | (F.abs(F.datediff("event_date", "_event_date")) <= 1))
    return spatial.within(v.ref_rec, v.occ, 0.1, same, ["taxon_key", "event_date"]).select("dataset_id", "record_id")


@query("JOIN8_nearest_other", f"select a.record_id, round(min({HAV_AB}), 3) as km from occ a join occ b on a.record_id <> b.record_id group by 1")
def join8(v):
    occ = v.occ
    return spatial.nearest_km(occ, occ, ["record_id"], exclude_self=True).select("record_id", F.round("km", 3).alias("km"))


@query("JOIN8_third_nearest")
def join8k(v):
    occ = v.occ
    return spatial.nearest_km(occ, occ, ["record_id"], k=3, exclude_self=True).select("record_id", F.round("km", 3).alias("km"))


@query("JOIN10_pairwise_mean", f"with s as (select * from occ order by md5(concat(record_id, ':9')), record_id limit 1000) select count(*) as n_pairs, round(avg({HAV_AB}), 2) as mean_km from s a join s b on a.record_id < b.record_id")
def join10(v):
    return sampling.pair_distances(sampling.seeded_sample(v.occ, "record_id", 1000, 9), "record_id").agg(F.count("*").alias("n_pairs"), F.round(F.avg("km"), 2).alias("mean_km"))


_EFFORT = "select px_row, px_col, cast(sum(cnt) as bigint) as cnt from eff group by 1, 2"


@query("JOIN11_effort_lookup", f"with e as ({_EFFORT}) select o.record_id, round(ln(1 + coalesce(e.cnt, 0)), 6) as effort from occ o left join e on e.px_row = cast(floor((90e0 - o.latitude) / 0.5e0) as int) and e.px_col = cast(floor((o.longitude + 180e0) / 0.5e0) as int)")
def join11(v):
    e = v.eff.groupBy("px_row", "px_col").agg(F.sum("cnt").alias("cnt"))
    o = v.occ.select("record_id", F.floor((90.0 - F.col("latitude")) / 0.5).cast("int").alias("px_row"), F.floor((F.col("longitude") + 180.0) / 0.5).cast("int").alias("px_col"))
    return o.join(e, ["px_row", "px_col"], "left").select("record_id", F.round(F.log1p(F.coalesce("cnt", F.lit(0))), 6).alias("effort"))


@query("AGG9_effort_grid", "select cast(floor(px_row / 4e0) as int) as prow, cast(floor(px_col / 4e0) as int) as pcol, cast(sum(cnt) as bigint) as cnt from eff group by 1, 2")
def agg9(v):
    return v.eff.groupBy(F.floor(F.col("px_row") / 4.0).cast("int").alias("prow"), F.floor(F.col("px_col") / 4.0).cast("int").alias("pcol")).agg(F.sum("cnt").alias("cnt"))


LISTS = "(values ('alpha', ['1', '5', '999999']), ('beta', ['2', '5', '7'])) l(list, entries)"


@query("JOIN12_registry_lists", f"with e as (select list, cast(unnest(entries) as bigint) as k from {LISTS}), o as (select o_custkey, count(*) as n from orders group by 1) select list, count(*) as n_entries, count(distinct c_custkey) as n_registered, count(o_custkey) as n_trained from e left join customer on c_custkey = k left join o on o_custkey = c_custkey group by list")
def join12(v):
    lists = v.spark.createDataFrame([("alpha", [1, 5, 999999]), ("beta", [2, 5, 7])], "list string, entries array<long>").select("list", F.explode("entries").alias("c_custkey"))
    known = v.customer.select("c_custkey", F.lit(1).alias("known"))
    trained = v.orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("trained", F.lit(1))
    d = lists.join(known, "c_custkey", "left").join(trained, "c_custkey", "left")
    return d.groupBy("list").agg(F.count("*").alias("n_entries"), F.count_distinct(F.when(F.col("known") == 1, F.col("c_custkey"))).alias("n_registered"), F.count(F.when(F.col("known") == 1, F.col("trained"))).alias("n_trained"))


@query("JOIN13_current_version", "select c_custkey, o_orderkey as model_version, o_totalprice as severity from customer left join (select o_custkey, max(o_orderkey) as o_orderkey from orders group by 1) m on m.o_custkey = c_custkey left join orders using (o_orderkey)")
def join13(v):
    current = v.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("model_version"), F.max_by("o_totalprice", "o_orderkey").alias("severity"))
    return v.customer.join(current, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "model_version", "severity")


@query("JOIN14_page_enrichment", "with p as (select source, record_id, locality from occ order by ingested_ts desc, record_id limit 100) select p.source, p.record_id, locality, count(a.kind) as n_annotations from p left join ann a on a.source = p.source and a.record_id = p.record_id group by 1, 2, 3")
def join14(v):
    p = v.occ.orderBy(F.desc("ingested_ts"), "record_id").limit(100).select(*KEY, "locality")
    n = v.ann.groupBy(*KEY).agg(F.count("kind").alias("n_annotations"))
    return p.join(n, KEY, "left").na.fill(0, ["n_annotations"])


@query("JOIN17_datasets_by_versions", "select dataset_id, t as threshold, count(*) filter (occurrence_status = 'present' and s >= t) as hits, count(*) filter (occurrence_status = 'absent' and s < t) as rejections from (select r.*, c.suitability as s from ref_rec r join cells c on c.row = cast(floor(90e0 - r.latitude) as int) and c.col = cast(floor(r.longitude + 180e0) as int)) r cross join (values (0.2e0), (0.5e0)) m(t) group by 1, 2")
def join17(v):
    versions = v.spark.createDataFrame([(0.2,), (0.5,)], "threshold double")
    at = v.ref_rec.select("dataset_id", "occurrence_status", F.floor(90.0 - F.col("latitude")).cast("int").alias("row"), F.floor(F.col("longitude") + 180.0).cast("int").alias("col")).join(v.cells.select("row", "col", "suitability"), ["row", "col"])
    d = at.crossJoin(F.broadcast(versions))  # a row for each version of the species
    return d.groupBy("dataset_id", "threshold").agg(F.count_if((F.col("occurrence_status") == "present") & (F.col("suitability") >= F.col("threshold"))).alias("hits"), F.count_if((F.col("occurrence_status") == "absent") & (F.col("suitability") < F.col("threshold"))).alias("rejections"))


@query("JOIN18_peer_species", "select a.s_suppkey, count(*) as n_peers from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey and b.s_acctbal > 0 group by 1")
def join18(v):
    n = v.supplier.groupBy("s_nationkey").agg(F.count_if(F.col("s_acctbal") > 0).alias("n"))
    d = v.supplier.join(n, "s_nationkey").withColumn("n_peers", F.col("n") - (F.col("s_acctbal") > 0).cast("int"))
    return d.where("n_peers > 0").select("s_suppkey", "n_peers")


@query("JOIN19_not_known_or_alerted", "select record_id from occ where source = 'iNaturalist' and record_id not in (select record_id from occ where range_label = 'native') and record_id not in (select unnest([event_id, event_id + 7]) from events where event_type = 'purchase')")
def join19(v):
    known = v.occ.where("range_label = 'native'").select("record_id")
    alerted = v.events.where("event_type = 'purchase'").select(F.explode(F.array(F.col("event_id"), F.col("event_id") + 7)).alias("record_id"))
    return v.occ.where("source = 'iNaturalist'").select("record_id").join(known.unionAll(alerted), "record_id", "left_anti")


@query("JOIN20_tile_envelope", "select record_id from occ where longitude between 0e0 and 22.5e0 and latitude between 40.97989806962013e0 and 55.77657301866769e0")
def join20(v):
    return v.occ.where(F.col("longitude").between(0.0, 22.5) & F.col("latitude").between(40.97989806962013, 55.77657301866769)).select("record_id")


_DISK = "exists (select 1 from occ p where p.range_label = 'native' and (p.longitude - o.longitude) * (p.longitude - o.longitude) + (p.latitude - o.latitude) * (p.latitude - o.latitude) <= 2.25e0)"


@query("JOIN21_buffer_membership", f"select record_id from occ o where {_DISK}")
def join21(v):
    return spatial.within_degrees(v.occ, v.occ.where("range_label = 'native'"), 1.5).select("record_id")


@query("JOIN22_rasterise", f"select row, col from (select row, col, lon as longitude, lat as latitude from cells) o where {_DISK}")
def join22(v):
    cells = v.cells.select("row", "col", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"))
    return spatial.within_degrees(cells, v.occ.where("range_label = 'native'"), 1.5).select("row", "col")


@query("AGG5_tile_grid", "select cast(round(20037508.342789244e0 / 180e0 * longitude / 156543.03392804097e0) as bigint) as gx, cast(round(ln(tan((90e0 + latitude) * 3.141592653589793e0 / 360e0)) * 6378137e0 / 156543.03392804097e0) as bigint) as gy, count(*) as n, count(*) filter (range_label = 'native') as n_native, count(*) filter (range_label = 'introduced') as n_introduced from occ where abs(latitude) < 85e0 group by 1, 2")
def agg5(v):
    cell = 156543.03392804097
    d = v.occ.where(F.abs("latitude") < 85.0).select(F.round(mercator_x(F.col("longitude")) / cell).cast("long").alias("gx"), F.round(mercator_y(F.col("latitude")) / cell).cast("long").alias("gy"), "range_label")
    return d.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.count_if(F.col("range_label") == "native").alias("n_native"), F.count_if(F.col("range_label") == "introduced").alias("n_introduced"))


@query("AGG6_cell_dedupe", "select source, record_id from (select source, record_id, row_number() over (partition by row, col order by source, record_id) as rn from occ_cells) t where rn = 1")
def agg6(v):
    return first_per_key(v.occ_cells, ["row", "col"], [F.col("source"), F.col("record_id")]).select(*KEY)


@query("AGG7_distinct_cells", "select taxon_key, count(distinct (row, col)) as n_cells from occ_cells group by 1")
def agg7(v):
    return v.occ_cells.groupBy("taxon_key").agg(F.count_distinct("row", "col").alias("n_cells"))


@query("AGG8_effort_weights", "select cast(floor(px_row / 2e0) as int) as row, cast(floor(px_col / 2e0) as int) as col, cast(sum(greatest(cnt, 0)) as bigint) as effort, round(sqrt(sum(greatest(cnt, 0))), 6) as weight from eff group by 1, 2")
def agg8(v):
    n = v.eff.groupBy(F.floor(F.col("px_row") / 2.0).cast("int").alias("row"), F.floor(F.col("px_col") / 2.0).cast("int").alias("col")).agg(F.sum(F.greatest("cnt", F.lit(0))).alias("effort"))
    return n.withColumn("weight", F.round(F.sqrt("effort"), 6))


@query("AGG35_spread_rate", "with c1 as (select cast(floor(longitude) as int) as x, cast(floor(latitude) as int) as y, min(year(event_date)) as fy from occ where taxon_key = 5000001 and range_label <> 'native' and event_date is not null group by 1, 2) select round(count(*) / 10e0, 4) as cells_per_year from c1 where fy between 2015 and 2024")
def agg35(v):
    d = v.occ.where("taxon_key = 5000001 AND range_label <> 'native' AND event_date IS NOT NULL")
    first = d.groupBy(F.floor("longitude").alias("x"), F.floor("latitude").alias("y")).agg(F.min(F.year("event_date")).alias("fy"))
    return first.where(F.col("fy").between(2015, 2024)).agg(F.round(F.count("*") / 10.0, 4).alias("cells_per_year"))


@query("WIN1_duplicate_specimens", """with k as (select source, record_id, regexp_replace(lower(coalesce(recorded_by, '')), '[^0-9a-z]', '', 'g') as c, regexp_replace(lower(coalesce(record_number, '')), '[^0-9a-z]', '', 'g') as n, event_date from occ where basis_of_record in ('PRESERVED_SPECIMEN', 'MATERIAL_SAMPLE', 'MATERIAL_CITATION') and event_date is not null)
select source, record_id from (select *, row_number() over (partition by c, n, event_date order by source, record_id) as rn from k where c <> '' and n not in ('', 'sn', 'none', 'na', 'nan', 'unknown', '0')) t where rn > 1""")
def win1(v):
    return quality.duplicate_specimens(v.occ).where("duplicate_specimen").select(*KEY)


@query("WIN10_seeded_order", "select record_id from occ order by md5(concat(record_id, ':17')), record_id limit 100")
def win10(v):
    return v.occ.orderBy(sampling.seeded(F.col("record_id"), 17), "record_id").limit(100).select("record_id")


@query("SMP3_proportional_quota", "with s as (select country_code, record_id, row_number() over (partition by country_code order by md5(concat(record_id, ':3')), record_id) as rn, count(*) over (partition by country_code) as c, count(*) over () as t from occ) select country_code, record_id from s where rn <= ceil(500 * (c * 1e0 / t))")
def smp3(v):
    return sampling.quota(v.occ, ["country_code"], "record_id", 500, seed=3).select("country_code", "record_id")


@query("SMP4_random_cells", "select row, col from cells order by md5(concat(row * 360 + col, ':5')), row, col limit 1000")
def smp4(v):
    return v.cells.orderBy(sampling.seeded(F.col("row") * 360 + F.col("col"), 5), "row", "col").limit(1000).select("row", "col")


@query("SMP5_disk_pseudo_absences", f"select row, col from (select row, col, lon as longitude, lat as latitude from cells) o where not exists (select 1 from occ g where abs(g.latitude - o.latitude) < 2e0 and {HAV_OG} < 200e0)")
def smp5(v):
    cells = v.cells.select("row", "col", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"))
    return spatial.within(cells, v.occ, 200.0, inclusive=False, how="left_anti").select("row", "col")


@query("SMP5_profile_pseudo_absences", "with e as (select quantile_cont(bio1, 0.025) as a1, quantile_cont(bio1, 0.975) as z1, quantile_cont(bio12, 0.025) as a2, quantile_cont(bio12, 0.975) as z2 from pred where y = 1) select row, col from cells cross join e where not (bio1 between a1 and z1 and bio12 between a2 and z2)")
def smp5b(v):
    cols = ["bio1", "bio12"]
    e = order.ends(v.pred.where("y = 1"), {c: {f"{c}_lo": 0.025, f"{c}_hi": 0.975} for c in cols})
    inside = F.col("bio1").between(F.col("bio1_lo"), F.col("bio1_hi")) & F.col("bio12").between(F.col("bio12_lo"), F.col("bio12_hi"))
    return v.cells.crossJoin(F.broadcast(e)).where(~inside).select("row", "col")  # e is one row


@query("SMP6_target_group_cells", "with e as (select cast(floor(px_row / 2e0) as int) as row, cast(floor(px_col / 2e0) as int) as col, sum(cnt) as cnt from eff group by 1, 2) select c.row, c.col, cast(e.cnt as bigint) as effort from cells c join e on e.row = c.row and e.col = c.col where e.cnt >= 20")
def smp6(v):
    e = v.eff.groupBy(F.floor(F.col("px_row") / 2.0).cast("int").alias("row"), F.floor(F.col("px_col") / 2.0).cast("int").alias("col")).agg(F.sum("cnt").alias("effort")).where("effort >= 20")
    return v.cells.select("row", "col").join(e, ["row", "col"])


@query("SMP1_area_weighted_background", "select row, col from cells order by -ln((cast('0x' || substr(md5(concat(row * 360 + col, ':11')), 1, 13) as bigint) + 0.5e0) / 4503599627370496e0) / cos(radians(lat)), row * 360 + col limit 2000")
def smp1(v):
    c = v.cells.withColumns({"id": F.col("row") * 360 + F.col("col"), "w": F.cos(F.radians("lat"))})
    return sampling.weighted_without_replacement(c, "id", "w", 2000, seed=11).select("row", "col")


@query("SMP2_effort_weighted_with_replacement", """with c as (select px_row * 1000 + px_col as id, px_row, px_col, cast(cnt as double) as w from eff where cnt > 0), h as (select *, sum(w) over (order by id rows unbounded preceding) as fin, sum(w) over () as total from c),
 d as (select draw, (cast('0x' || substr(md5(concat(draw, ':13')), 1, 13) as bigint) + 0.5e0) / 4503599627370496e0 * (select max(total) from h) as x from (select range as draw from range(2000)) r) select draw, px_row, px_col from d asof join h on d.x <= h.fin""")
def smp2(v):
    c = v.eff.select((F.col("px_row") * 1000 + F.col("px_col")).cast("long").alias("id"), "px_row", "px_col", F.col("cnt").cast("double").alias("w"))
    return sampling.weighted_with_replacement(c, "id", "w", 2000, seed=13).select("draw", "px_row", "px_col")


@query("THN1_distance_thinning")
def thn1(v):
    return sampling.distance_thin(v.occ.where("taxon_key = 5000001"), "record_id", 50.0, seed=1).select("record_id")


@query("THN2_environmental_thinning")
def thn2(v):
    d = v.occ_cells.join(v.cells.select("row", "col", "bio1", "bio4", "bio12"), ["row", "col"])
    return sampling.environmental_thin(d, ["bio1", "bio4", "bio12"], "record_id", bins=20).select("record_id")


@query("THN3_autocorrelation_range")
def thn3(v):
    d = v.occ_cells.join(v.cells.select("row", "col", "bio1", "bio4", "bio12"), ["row", "col"])
    return sampling.autocorrelation_ranges(d, "record_id", ["bio1", "bio4", "bio12"])


@query("AGG40_variogram_bins", f"with p as (select o.record_id as id, o.longitude, o.latitude, c.bio1 as z from occ_cells o join cells c on c.row = o.row and c.col = o.col order by md5(concat(o.record_id, ':9')), o.record_id limit 1000), d as (select {HAV_AB} as km, 0.5e0 * (a.z - b.z) * (a.z - b.z) as g from p a join p b on a.id < b.id), m as (select max(km) / 2e0 as half from d) select cast(least(floor(km / (half / 20e0)), 19) as int) as bin, count(*) as n, round(avg(g), 6) as gamma from d cross join m where km <= half group by 1")
def agg40(v):
    d = v.occ_cells.join(v.cells.select("row", "col", "bio1"), ["row", "col"])
    return sampling.variogram(d, "record_id", "bio1").select("bin", "n", F.round("gamma", 6).alias("gamma"))


_DQ = ["select source, record_id from occ o where "]


def _dq(name: str, sql: str, plan) -> None:
    @query(name, _DQ[0] + sql)
    def run(v, plan=plan):
        return plan(v).select(*KEY)


_ISSUE = "exists (select 1 from (select unnest(string_split(o.issues_csv, ';')) as i) t where upper(trim(i)) in ({}))"
_near = lambda where, km: f"exists (select 1 from gaz g where {where} and abs(g.latitude - o.latitude) < {km / 100 + 0.01}e0 and {HAV_OG} <= {float(km)}e0)"
_flag = lambda t: lambda v: quality.near_places(v.occ, v.gaz).where(t)
_issues = lambda t: lambda v: v.occ.where(quality.has_issue(t, sc.issue_set(F.col("issues_csv"))))
_dq("DQ1_equal_coordinates", "abs(longitude - latitude) <= 1e-9", lambda v: v.occ.where(quality.equal_coordinates()))
_dq("DQ2_headquarters", "2e0 * 6371.0088e0 * asin(sqrt(pow(sin(radians(55.6761e0 - latitude) / 2e0), 2e0) + cos(radians(latitude)) * cos(radians(55.6761e0)) * pow(sin(radians(12.5788e0 - longitude) / 2e0), 2e0))) <= 50e0", lambda v: v.occ.where(quality.headquarters(50.0)))
_dq("DQ3_capital", _near("g.kind = 'capital'", 1), _flag("capital"))
_dq("DQ4_near_capital", f"{_near("g.kind = 'capital'", 10)} and not {_near("g.kind = 'capital'", 1)}", _flag("near_capital"))
_dq("DQ5_country_centroid", _near("g.kind = 'country_centroid'", 1), _flag("country_centroid"))
_dq("DQ6_province_centroid", _near("g.kind = 'province_centroid'", 1), _flag("province_centroid"))
_dq("DQ7_institution", _near("g.kind = 'institution'", 0.1), _flag("institution"))
_dq("DQ16_near_botanical_garden", f"{_near("g.kind = 'institution' and contains(g.types, 'BOTANICAL_GARDEN')", 1)} and not {_near("g.kind = 'institution'", 0.1)}", _flag("near_botanical_garden"))
for _no, _test in (("DQ8", "gbif_geospatial_issue"), ("DQ11", "gbif_coordinate_corrected"), ("DQ12", "gbif_taxon_match"), ("DQ13", "gbif_date_issue")):
    _dq(f"{_no}_{_test}", _ISSUE.format(", ".join(f"'{c}'" for c in quality.ISSUES[_test])), _issues(_test))
_DECIMALS = "(case " + " ".join(f"when round({{c}}, {d}) = {{c}} then {d}" for d in range(9)) + " else 9 end)"
_IMPLIED = f"0.5e0 * 111320e0 / pow(10e0, greatest({_DECIMALS.format(c='longitude')}, {_DECIMALS.format(c='latitude')}))"
_dq("DQ9_low_precision", f"coalesce(coordinate_uncertainty_m, {_IMPLIED}) > 111320e0 / 6e0", lambda v: v.occ.where(quality.low_precision(1 / 6)))
_dq("DQ10_duplicate_specimen", "(source, record_id) in (select (source, record_id) from (select *, row_number() over (partition by regexp_replace(lower(recorded_by), '[^0-9a-z]', '', 'g'), regexp_replace(lower(record_number), '[^0-9a-z]', '', 'g'), event_date order by source, record_id) as rn from occ where basis_of_record in ('PRESERVED_SPECIMEN', 'MATERIAL_SAMPLE', 'MATERIAL_CITATION') and event_date is not null and regexp_replace(lower(record_number), '[^0-9a-z]', '', 'g') not in ('', 'sn', '0')) t where rn > 1)", lambda v: quality.duplicate_specimens(v.occ).where("duplicate_specimen"))
_dq("DQ14_before_baseline", "year(event_date) < 1970", lambda v: v.occ.where(quality.before_baseline()))
_dq("DQ15_cultivation_text", "regexp_matches(locality, '" + quality.CULTIVATION + "')", lambda v: v.occ.where(quality.cultivation_text("locality")))
_dq("DQ17_weak_identification", "source = 'iNaturalist' and (id_disagreements > 0 or (observer_id_from_vision and id_agreements <= 2))", lambda v: v.occ.where(quality.weak_identification()))
_dq("DQ19_spatial_isolate", f"not exists (select 1 from occ g where g.record_id <> o.record_id and {HAV_OG} <= 100e0)", lambda v: spatial.nearest_km(occ := v.occ, occ, KEY, exclude_self=True).where(F.col("km") > 100.0))


@query("DQ18_environmental_outlier")
def dq18(v):
    d = v.occ_cells.join(v.cells.select("row", "col", "bio1", "bio4", "bio12"), ["row", "col"])
    return sampling.environmental_outliers(d, "record_id", ["bio1", "bio4", "bio12"]).where("outlier").select(*KEY)


_RUN = [t for t in quality.TESTS if t not in (*quality.BUFFERS_KM, "environmental_outlier", "spatial_isolate")]
_SQL_TESTS = {
    "equal_coordinates": "abs(longitude - latitude) <= 1e-9", "gbif_headquarters": "2e0 * 6371.0088e0 * asin(sqrt(pow(sin(radians(55.6761e0 - latitude) / 2e0), 2e0) + cos(radians(latitude)) * cos(radians(55.6761e0)) * pow(sin(radians(12.5788e0 - longitude) / 2e0), 2e0))) <= 1e0",
    "low_precision": f"coalesce(coordinate_uncertainty_m, {_IMPLIED}) > 111320e0 / 6e0",
    "duplicate_specimen": "basis_of_record in ('PRESERVED_SPECIMEN', 'MATERIAL_SAMPLE', 'MATERIAL_CITATION') and event_date is not null and regexp_replace(lower(record_number), '[^0-9a-z]', '', 'g') not in ('', 'sn', '0') and row_number() over (partition by basis_of_record in ('PRESERVED_SPECIMEN', 'MATERIAL_SAMPLE', 'MATERIAL_CITATION'), regexp_replace(lower(recorded_by), '[^0-9a-z]', '', 'g'), regexp_replace(lower(record_number), '[^0-9a-z]', '', 'g'), event_date order by source, record_id) > 1",
    "before_climate_baseline": "coalesce(year(event_date) < 1970, false)", "cultivation_text": "coalesce(regexp_matches(locality, '" + quality.CULTIVATION + "'), false)",
    "weak_identification": "source = 'iNaturalist' and (id_disagreements > 0 or (observer_id_from_vision and id_agreements <= 2))",
    **{t: f"coalesce(len(list_intersect(list_transform(string_split(issues_csv, ';'), lambda x: upper(trim(x))), [{', '.join(repr(c) for c in codes)}])) > 0, false)" for t, codes in quality.ISSUES.items()},
}
_FLAGS_SQL = "list_filter([" + ", ".join(f"case when {_SQL_TESTS[t]} then '{t}' end" for t in _RUN) + "], lambda x: x is not null)"
_ERRORS_SQL = "[" + ", ".join(f"'{t}'" for t, s in quality.TESTS.items() if s == "error") + "]"
_ASSESSED_SQL = f"""with f as (select *, {_FLAGS_SQL} as flags from occ), x as (select *, len(list_intersect(flags, {_ERRORS_SQL})) > 0 as excluded, len(list_filter(flags, lambda t: t not in ({_ERRORS_SQL[1:-1]}))) > 0 as warned from f),
 a as (select *, case when excluded then 'excluded' when warned or coordinate_uncertainty_m is null then 'C' when basis_of_record in ('PRESERVED_SPECIMEN', 'MATERIAL_SAMPLE', 'MATERIAL_CITATION') and coordinate_uncertainty_m <= 1000 then 'A' else 'B' end as tier from x)"""


def assessed(v):
    return quality.assess(v.occ)


@query("DQ_T_tiers", _ASSESSED_SQL + " select source, record_id, array_to_string(flags, ';') as quality_flags, tier, excluded from a")
def dq_t(v):
    return assessed(v).select(*KEY, F.array_join("flags", ";").alias("quality_flags"), "tier", "excluded")


@query("DQ_S_summary", _ASSESSED_SQL + ", n as (select unnest(flags) as test, 1 as one from a) select t.test, t.severity, case when t.run then 'run' else 'skipped' end as status, case when t.run then (select count(*) from n where n.test = t.test) end as n_flagged from (values " + ", ".join(f"('{t}', '{s}', {str(t in _RUN).lower()})" for t, s in quality.TESTS.items()) + ") t(test, severity, run)")
def dq_s(v):
    return quality.summary(assessed(v), _RUN)


@query("AGG12_quality_counts", _ASSESSED_SQL + " select unnest(flags) as test, count(*) as n from a group by 1")
def agg12(v):
    return assessed(v).select(F.explode("flags").alias("test")).groupBy("test").agg(F.count("*").alias("n"))


FLAGSHIP_SQL = _ASSESSED_SQL + " select cast(year(event_date) as int) as yr, tier, count(*) as n from a where taxon_key = 5000001 group by 1, 2"


@query("FLAGSHIP_timeline_quality", FLAGSHIP_SQL)
def flagship(v):
    return quality.assess(v.occ).where("taxon_key = 5000001").groupBy(F.year("event_date").alias("yr"), "tier").agg(F.count("*").alias("n"))


@query("GEO2_cell_area", "select row, round(12392.1424e0 * cos(radians(90e0 - row - 0.5e0)), 4) as km2 from (select distinct row from grid) t")
def geo2(v):
    return v.grid.select("row").distinct().select("row", F.round(cell_area_km2(90.0 - F.col("row") - 0.5), 4).alias("km2"))
