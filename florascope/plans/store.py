"""Queries over the occurrence store: scans, writes, filters, listings and counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from florascope.functions import scalars as sc
from florascope.operators import order, store
from florascope.operators.session import ensure_checkpoint_dir
from florascope.sources.tables import Tables

from .catalog import query

KEY = ["source", "record_id"]
TAXON = 5000001
#: The keys of a delta that overlaps the store: half re-delivered, half new.
DELTA = "SELECT taxon_key, source, CASE WHEN record_id % 2 = 0 THEN record_id ELSE record_id + 1000000 END AS record_id, longitude, latitude, event_date, 'late' AS issues_csv FROM occ"


@query("SRC1_load_occurrences", f"select source, record_id, longitude, latitude, event_date, coordinate_uncertainty_m, range_label from occ where taxon_key = {TAXON}")
def src1(v):
    return v.occ.where(F.col("taxon_key") == TAXON).select("source", "record_id", "longitude", "latitude", "event_date", "coordinate_uncertainty_m", "range_label")


@query("SRC2_load_reference_records", f"select record_id, occurrence_status, longitude, latitude from ref_rec where taxon_key = {TAXON} and dataset_id = 'upload-a'")
def src2(v):
    return v.ref_rec.where((F.col("taxon_key") == TAXON) & (F.col("dataset_id") == "upload-a")).select("record_id", "occurrence_status", "longitude", "latitude")


@query("SRC6_keyset_page", "select record_id, longitude, latitude from occ where record_id > 4200 order by record_id limit 200")
def src6(v):
    return store.after_id(v.occ, "record_id", 4200, 200).select("record_id", "longitude", "latitude")


@query("SRC7_label_by_id_sets", """with i as (select record_id from occ where range_label = 'introduced'), n as (select record_id from occ where range_label = 'native')
select o.record_id, case when i.record_id is not null then 'introduced' when n.record_id is not null then 'native' else 'unknown' end as label from occ o left join i using (record_id) left join n using (record_id) where o.source = 'iNaturalist'""")
def src7(v):
    introduced, native = (v.occ.where(F.col("range_label") == k).select("record_id", F.lit(1).alias(c)) for k, c in (("introduced", "i"), ("native", "n")))
    o = v.occ.where(F.col("source") == "iNaturalist").select("record_id").join(introduced, "record_id", "left").join(native, "record_id", "left")
    return o.select("record_id", F.when(F.col("i").isNotNull(), "introduced").when(F.col("n").isNotNull(), "native").otherwise("unknown").alias("label"))


@query("SRC11_coordinate_columns", "select avg(case when abs(x) <= 90 then 1e0 else 0e0 end) >= 0.99e0 as lat_ok, avg(case when abs(y) <= 180 then 1e0 else 0e0 end) >= 0.99e0 as lon_ok, count(x) as n from (select try_cast(replace(replace(cast(latitude as varchar), '.', ','), ',', '.') as double) as x, try_cast(cast(longitude as varchar) as double) as y from occ) t")
def src11(v):
    comma = F.replace(F.col("latitude").cast("string"), F.lit("."), F.lit(","))
    d = v.occ.select(F.replace(comma, F.lit(","), F.lit(".")).try_cast("double").alias("x"), F.col("longitude").cast("string").try_cast("double").alias("y"))
    share = lambda c, most: F.avg(F.when(F.abs(c) <= most, 1.0).otherwise(0.0)) >= 0.99
    return d.agg(share("x", 90).alias("lat_ok"), share("y", 180).alias("lon_ok"), F.count("x").alias("n"))


UPLOAD = """SELECT record_id, CASE WHEN record_id % 17 = 0 THEN 'Other species' ELSE 'Species  one' END AS species, CASE WHEN record_id % 13 = 0 THEN NULL ELSE longitude END AS lon,
 CASE WHEN record_id % 19 = 0 THEN 0e0 WHEN record_id % 23 = 0 THEN 95e0 ELSE latitude END AS lat, CASE record_id % 5 WHEN 0 THEN 'present' WHEN 1 THEN '1' WHEN 2 THEN 'Absent' WHEN 3 THEN '0' ELSE 'maybe' END AS status FROM {occ}"""
_REASON = """case when lower(regexp_replace(trim(species), '\\s+', ' ', 'g')) <> 'species one' then 'other_species' when lon is null or lat is null then 'missing_coordinates' when abs(lon) > 180 or abs(lat) > 90 then 'out_of_range'
 when record_id % 29 = 0 and lat = 0 then 'zero_coordinates' when lower(status) not in ('present', '1', 'absent', '0') then 'unknown_status' else 'kept' end"""


def _upload_reason():
    name = F.lower(sc.collapse_spaces(F.col("species")))
    return (
        F.when(name != "species one", "other_species").when(F.col("lon").isNull() | F.col("lat").isNull(), "missing_coordinates").when((F.abs("lon") > 180) | (F.abs("lat") > 90), "out_of_range")
        .when((F.col("record_id") % 29 == 0) & (F.col("lat") == 0), "zero_coordinates").when(~F.lower("status").isin("present", "1", "absent", "0"), "unknown_status").otherwise("kept")
    )


@query("SRC12_upload_drop_reasons", f"select reason, count(*) as n from (select {_REASON} as reason from ({UPLOAD.format(occ='occ')}) u) t group by reason")
def src12(v):
    return v.spark.sql(UPLOAD, occ=v.occ).select(_upload_reason().alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("AGG13_skipped_row_reasons", f"select reason, count(*) as n from (select {_REASON} as reason from ({UPLOAD.format(occ='occ')}) u) t where reason <> 'kept' group by reason")
def agg13(v):
    return v.spark.sql(UPLOAD, occ=v.occ).select(_upload_reason().alias("reason")).where("reason <> 'kept'").groupBy("reason").agg(F.count("*").alias("n"))


@query("SRC13_gazetteer", "select kind, count(*) as n, count(types) as n_types, min(longitude) as west, max(longitude) as east from gaz group by kind")
def src13(v):
    return v.gaz.groupBy("kind").agg(F.count("*").alias("n"), F.count("types").alias("n_types"), F.min("longitude").alias("west"), F.max("longitude").alias("east"))


@query("SRC15_point_sample", "select o.record_id, c.bio1, c.bio12 from occ_cells o left join cells c on c.row = o.row and c.col = o.col")
def src15(v):
    return v.occ_cells.join(v.cells.select("row", "col", "bio1", "bio12"), ["row", "col"], "left").select("record_id", "bio1", "bio12")


@query("SRC17_window_subset", "select row, col, bio1 from cells where row between 30 and 59 and col between 175 and 229")
def src17(v):
    return v.cells.where(F.col("row").between(30, 59) & F.col("col").between(175, 229)).select("row", "col", "bio1")


@query("SRC18_overview", "select cast(floor(row / 4e0) as int) as orow, cast(floor(col / 4e0) as int) as ocol, round(avg(bio4), 4) as bio4, count(*) as n from cells group by 1, 2")
def src18(v):
    return v.cells.groupBy(F.floor(F.col("row") / 4.0).cast("int").alias("orow"), F.floor(F.col("col") / 4.0).cast("int").alias("ocol")).agg(F.round(F.avg("bio4"), 4).alias("bio4"), F.count("*").alias("n"))


@query("SRC19_snapshot_columns", "select range_label as role, longitude, latitude from occ where basis_of_record = 'HUMAN_OBSERVATION'")
def src19(v):
    return v.occ.where(F.col("basis_of_record") == "HUMAN_OBSERVATION").select(F.col("range_label").alias("role"), "longitude", "latitude")


@query("SRC20_scenario_resolution", "with w as (select * from (values ('g1_ssp245_p1'), ('g9_missing_p1')) v(wanted)), have as (select distinct name from scen) select wanted, coalesce(name, 'present') as used from w left join have on wanted = name")
def src20(v):
    wanted = v.spark.createDataFrame([("g1_ssp245_p1",), ("g9_missing_p1",)], "wanted string")
    have = v.scen.select("name").distinct()
    return wanted.join(have, F.col("wanted") == F.col("name"), "left").select("wanted", F.coalesce("name", F.lit("present")).alias("used"))


@query("SRC21_finest_version", "select p_brand as version, min(p_size) as finest, arg_min(p_partkey, struct_pack(a := p_size, b := p_partkey)) as partkey from part group by p_brand")
def src21(v):
    return v.part.groupBy(F.col("p_brand").alias("version")).agg(F.min("p_size").alias("finest"), F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("partkey"))


@query("SRC22_suggestion_merge", "select s.p_name as name, r.c_custkey is not null as registered, p2.p_partkey as parent from part s left join customer r on r.c_custkey = s.p_partkey left join part p2 on p2.p_partkey = s.p_partkey + 1 and p2.p_size = s.p_size where s.p_size <= 10")
def src22(v):
    s, r = v.part, v.customer.select(F.col("c_custkey").alias("k"))
    p2 = v.part.select((F.col("p_partkey") - 1).alias("k2"), F.col("p_size").alias("z"), F.col("p_partkey").alias("parent"))
    out = s.where("p_size <= 10").join(r, F.col("p_partkey") == F.col("k"), "left").join(p2, (F.col("k2") == F.col("p_partkey")) & (F.col("z") == F.col("p_size")), "left")
    return out.select(F.col("p_name").alias("name"), F.col("k").isNotNull().alias("registered"), "parent")


@query("SRC23_name_match", """with q as (select n_nationkey, case n_nationkey % 3 when 0 then upper(n_name) when 1 then concat(n_name, 'x') else 'zzzzzzzz' end as given from nation)
select q.n_nationkey, case when e.n_name is not null then 'EXACT' when f.n_name is not null then 'FUZZY' else 'NONE' end as match, coalesce(e.n_name, f.n_name) as matched
from q left join nation e on lower(e.n_name) = lower(q.given) left join (select q.n_nationkey as k, min(n.n_name) as n_name from q join nation n on levenshtein(lower(n.n_name), lower(q.given)) = 1 group by 1) f on f.k = q.n_nationkey""")
def src23(v):
    n = v.nation.select("n_nationkey", "n_name")
    k = F.col("n_nationkey") % 3
    q = n.select("n_nationkey", F.when(k == 0, F.upper("n_name")).when(k == 1, F.concat("n_name", F.lit("x"))).otherwise("zzzzzzzz").alias("given"))
    exact = n.select(F.lower("n_name").alias("low"), F.col("n_name").alias("exact"))
    # one edit changes the length by one at most and leaves one half of the name alone
    halves = lambda c: F.array(F.concat(F.lit("a"), F.substring(c, 1, 2)), F.concat(F.lit("z"), F.substring(c, -2, 2)))
    left = q.select("n_nationkey", F.lower("given").alias("g"), F.explode(F.array_distinct(halves(F.lower("given")))).alias("h"))
    right = n.select(F.lower("n_name").alias("low"), F.col("n_name").alias("fuzzy"), F.explode(F.array_distinct(halves(F.lower("n_name")))).alias("h"))
    fuzzy = left.join(right, "h").where(F.levenshtein("g", "low") == 1).groupBy("n_nationkey").agg(F.min("fuzzy").alias("fuzzy"))
    out = q.join(exact, F.lower("given") == F.col("low"), "left").join(fuzzy, "n_nationkey", "left")
    return out.select("n_nationkey", F.when(F.col("exact").isNotNull(), "EXACT").when(F.col("fuzzy").isNotNull(), "FUZZY").otherwise("NONE").alias("match"), F.coalesce("exact", "fuzzy").alias("matched"))


@query("SRC25_point_lookup", "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey = 97")
def src25(v):
    return v.orders.where("o_orderkey = 97").select("o_orderkey", "o_orderstatus", "o_totalprice")


def _delta(v):
    return v.spark.sql(DELTA.replace("FROM occ", "FROM {occ}"), occ=v.occ)


@query("SNK1_append_fill_once", f"""with old as (select taxon_key, source, record_id, longitude, latitude, event_date, issues_csv from occ), d as ({DELTA})
select source, record_id, case when o.record_id is not null then coalesce(o.issues_csv, d.issues_csv) else d.issues_csv end as issues_csv, o.record_id is null as inserted from old o full join (select distinct on (source, record_id) * from d) d using (source, record_id)""")
def snk1(v):
    old = v.occ.select("taxon_key", "source", "record_id", "longitude", "latitude", "event_date", "issues_csv")
    return store.append_fill_once(old, _delta(v), KEY, ["issues_csv"]).select(*KEY, "issues_csv", "inserted")


@query("SNK5_committed_versions", f"""with o as (select taxon_key, source, record_id, issues_csv from occ), d as ({DELTA}),
 m as (select coalesce(o.taxon_key, d.taxon_key) as taxon_key, coalesce(o.issues_csv, d.issues_csv) as issues_csv from o full join d using (source, record_id)),
 u as (select 1 as version, taxon_key, issues_csv from o union all select 2, taxon_key, issues_csv from m union all select 3, taxon_key, issues_csv from m where taxon_key <> {TAXON})
select version, count(*) as n, count(issues_csv) as with_issues, count(*) filter (issues_csv = 'late') as late, cast(sum(taxon_key) as bigint) as taxa from u group by version""")
def snk5b(v):
    """A stored table through its commits: created, appended to with a filled column, one taxon deleted; each version read back."""
    ensure_checkpoint_dir(v.spark)
    tables = Tables(v.spark, f"{v.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables-{uuid.uuid4().hex}")
    tables.create("occurrences", v.occ.select("taxon_key", "source", "record_id", "longitude", "latitude", "event_date", "issues_csv"), KEY, by=["taxon_key"])
    tables.append_fill_once("occurrences", _delta(v), ["issues_csv"])
    tables.delete("taxon_key", TAXON)
    out = None
    for version in (1, 2, 3):
        d = tables.read("occurrences", version)
        n = d.agg(F.lit(version).alias("version"), F.count("*").alias("n"), F.count("issues_csv").alias("with_issues"), F.count_if(F.col("issues_csv") == "late").alias("late"), F.sum(F.col("taxon_key").cast("long")).alias("taxa"))
        out = n if out is None else out.unionAll(n)
    return out


@query("SNK2_append_ignore", f"with d as ({DELTA}) select source, record_id from occ union select source, record_id from d")
def snk2(v):
    return store.append_ignore(v.occ.select(*KEY), _delta(v).select(*KEY), KEY)


@query("SNK3_fill_features", "select o.record_id, case when o.record_id % 3 = 0 then c.bio1 else -1e0 end as bio1 from occ_cells o left join cells c on c.row = o.row and c.col = o.col")
def snk3(v):
    have = v.occ_cells.select("record_id", "row", "col", F.when(F.col("record_id") % 3 != 0, -1.0).alias("bio1"))
    values = v.occ_cells.select("record_id", "row", "col").join(v.cells.select("row", "col", "bio1"), ["row", "col"], "left").select("record_id", "bio1")
    return store.fill_where_null(have, values, ["record_id"], ["bio1"], "bio1").select("record_id", "bio1")


@query("SNK4_upsert", """with b as (select o_custkey, o_orderkey, o_orderdate, o_totalprice, case when o_orderstatus = 'F' then 0 else 1 end as n from orders)
select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, n desc, o_orderkey desc) as rn from b) t where rn = 1""")
def snk4(v):
    rows = v.orders.select("o_custkey", "o_orderkey", "o_totalprice",  "o_orderdate", F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("_new"))
    both = rows.where("_new = 0").unionByName(rows.where("_new = 1"))
    return store.first_per_key(both, ["o_custkey"], [F.desc("o_orderdate"), F.desc("_new"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SNK5_cascading_delete", f"select 'occurrences' as tbl, count(*) as deleted from occ where taxon_key = {TAXON} union all select 'annotations', count(*) from ann where taxon_key = {TAXON} union all select 'reference_records', count(*) from ref_rec where taxon_key = {TAXON}")
def snk5(v):
    out = None
    for name, df in (("occurrences", v.occ), ("annotations", v.ann), ("reference_records", v.ref_rec)):
        n = df.where(F.col("taxon_key") == TAXON).agg(F.lit(name).alias("tbl"), F.count("*").alias("deleted"))
        out = n if out is None else out.unionAll(n)
    return out.select("tbl", "deleted")


@query("SNK6_patched_rows", "select o_custkey as id, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) as status, count(*) as n_events from orders group by o_custkey")
def snk6(v):
    return v.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.count("*").alias("n_events"))


@query("SNK7_training_snapshot", """with u as (select 'presence' as role, source, record_id, longitude, latitude, cast(null as double) as sample_weight from occ where range_label = 'native' union all select 'background', 'grid', row * 360 + col, lon, lat, 1e0 from cells)
select role, count(*) as n, bit_xor(cast(('0x' || substr(sha256(concat_ws('|', role, source, record_id)), 1, 15)) as bigint)) as digest from u group by role""")
def snk7(v):
    presence = v.occ.where("range_label = 'native'").select(F.lit("presence").alias("role"), "source", "record_id", "longitude", "latitude")
    background = v.cells.select(
        F.lit("background").alias("role"), F.lit("grid").alias("source"), (F.col("row") * 360 + F.col("col")).cast("long").alias("record_id"), F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), F.lit(1.0).alias("sample_weight")
    )
    u = presence.unionByName(background, allowMissingColumns=True)
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", "role", "source", F.col("record_id").cast("string")), 256), 1, 15), 16, 10).cast("long")
    return u.groupBy("role").agg(F.count("*").alias("n"), F.bit_xor(digest).alias("digest"))


@query("SNK9_export_join", "select o.source, o.record_id, o.locality, e.n as n_annotations from occ o left join (select source, record_id, count(*) as n from ann group by 1, 2) e on e.source = o.source and e.record_id = o.record_id")
def snk9(v):
    e = v.ann.groupBy(*KEY).agg(F.count("*").alias("n_annotations"))
    return v.occ.join(e, KEY, "left").select(*KEY, "locality", "n_annotations")


@query("SNK11_archive_inactive", "select c_custkey from customer left join (select o_custkey, max(o_orderdate) as last_ts from orders group by 1) o on o_custkey = c_custkey where coalesce(last_ts, timestamp '1990-01-01 00:00:00') < timestamp '1998-01-01 00:00:00'")
def snk11(v):
    last = v.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_ts"))
    floor, cutoff = (F.lit(t).cast("timestamp") for t in ("1990-01-01 00:00:00", "1998-01-01 00:00:00"))
    return v.customer.join(last, "c_custkey", "left").where(F.coalesce("last_ts", floor) < cutoff).select("c_custkey")


@query("SNK13_grid_registration", "select g.row, g.col, g.bio1, g.bio4, c.suitability from grid g join cells c on c.row = g.row and c.col = g.col")
def snk13(v):
    return v.grid.select("row", "col", "bio1", "bio4").join(v.cells.select("row", "col", "suitability"), ["row", "col"])


RAW = """SELECT event_id AS key, CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 37 = 0 THEN 'x1' ELSE CAST((event_id * 57) % 9001 - 4500 AS STRING) END AS lat100, CASE WHEN event_id % 29 = 0 THEN '' ELSE CAST((event_id * 31) % 38001 - 19000 AS STRING) END AS lon100,
 CASE event_id % 7 WHEN 0 THEN 'FOSSIL_SPECIMEN' WHEN 1 THEN 'LIVING_SPECIMEN' ELSE 'HUMAN_OBSERVATION' END AS basis, CASE event_id % 9 WHEN 0 THEN 'Managed' WHEN 1 THEN 'NATIVE' WHEN 2 THEN 'introduced: assisted' WHEN 3 THEN 'Invasive' ELSE NULL END AS means,
 CASE event_id % 11 WHEN 0 THEN 'cultivated' WHEN 1 THEN 'native' WHEN 2 THEN ' Casual ' WHEN 3 THEN 'Established' ELSE NULL END AS degree, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value * 100e0 END AS unc, CASE WHEN event_id % 8 = 0 THEN 'absent' WHEN event_id % 8 = 1 THEN NULL ELSE 'PRESENT' END AS status,
 CASE WHEN event_id % 3 = 0 THEN '50c9509d-22c7-4a22-a47d-8c48425ef4a7' ELSE 'other' END AS dataset, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(event_id AS STRING) END AS catalog FROM {events}"""
_USABLE = """try_cast(lat100 as double) is not null and try_cast(nullif(lon100, '') as double) is not null and abs(try_cast(lat100 as double) / 100e0) <= 90 and abs(try_cast(nullif(lon100, '') as double) / 100e0) <= 180
 and not (try_cast(lat100 as double) = 0 and try_cast(nullif(lon100, '') as double) = 0) and basis not in ('FOSSIL_SPECIMEN', 'LIVING_SPECIMEN') and lower(coalesce(means, '')) not in ('managed', 'cultivated', 'captive') and lower(coalesce(degree, '')) not in ('managed', 'cultivated', 'captive') and (unc is null or unc <= 5000)"""


def _raw(v):
    d = v.spark.sql(RAW, events=v.events)
    return d.withColumns({"lat": sc.number(F.col("lat100")) / 100.0, "lon": sc.number(F.col("lon100")) / 100.0})


def _usable(max_uncertainty_m: float = 5000.0):
    return (
        F.col("key").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0)) & ~F.coalesce(F.col("basis").isin(sc.EXCLUDED_BASIS), F.lit(False))
        & ~F.lower(F.coalesce("means", F.lit(""))).isin(sc.EXCLUDED_ESTABLISHMENT) & ~F.lower(F.coalesce("degree", F.lit(""))).isin(sc.EXCLUDED_ESTABLISHMENT) & (F.col("unc").isNull() | (F.col("unc") <= max_uncertainty_m))
    )


@query("FLT1_usable_records", f"select key from ({RAW.format(events='events')}) r where {_USABLE}")
def flt1(v):
    return _raw(v).where(_usable()).select("key")


@query("FLT2_presence_absence", f"select case when upper(coalesce(status, 'PRESENT')) = 'ABSENT' then 'absent' else 'present' end as occurrence_status, key, case when upper(coalesce(status, 'PRESENT')) <> 'ABSENT' and dataset = '50c9509d-22c7-4a22-a47d-8c48425ef4a7' then try_cast(catalog as bigint) end as crossref from ({RAW.format(events='events')}) r where {_USABLE}")
def flt2(v):
    absent = F.upper(F.coalesce("status", F.lit("PRESENT"))) == "ABSENT"
    crossref = F.when(~absent & (F.col("dataset") == "50c9509d-22c7-4a22-a47d-8c48425ef4a7"), F.col("catalog").try_cast("long"))
    return _raw(v).where(_usable()).select(F.when(absent, "absent").otherwise("present").alias("occurrence_status"), "key", crossref.alias("crossref"))


OBS = """SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat(CAST((event_id * 57) % 91 AS STRING), ',', CAST((event_id * 31) % 181 AS STRING)) END AS location, event_id % 12 = 0 AS obscured, event_id % 15 = 0 AS captive, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value * 50e0 END AS accuracy FROM {events}"""


@query("FLT3_observation_normaliser", f"select id, try_cast(split_part(location, ',', 2) as double) as lon, try_cast(split_part(location, ',', 1) as double) as lat from ({OBS.format(events='events')}) o where location is not null and not obscured and not captive and (accuracy is null or accuracy <= 3000) and not (try_cast(split_part(location, ',', 2) as double) = 0 and try_cast(split_part(location, ',', 1) as double) = 0)")
def flt3(v):
    d = v.spark.sql(OBS, events=v.events).where(F.col("location").isNotNull() & ~F.col("obscured") & ~F.col("captive") & (F.col("accuracy").isNull() | (F.col("accuracy") <= 3000)))
    xy = F.split("location", ",", 2)
    d = d.select("id", xy[1].try_cast("double").alias("lon"), xy[0].try_cast("double").alias("lat"))
    return d.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0)))


@query("FLT4_range_label", f"""select key, case when starts_with(lower(trim(coalesce(means, ''))), 'native') or lower(trim(coalesce(degree, ''))) = 'native' then 'native' when starts_with(lower(trim(coalesce(means, ''))), 'introduced') or lower(trim(coalesce(means, ''))) in ('invasive', 'naturalised', 'naturalized')
 or lower(trim(coalesce(degree, ''))) in ('invasive', 'naturalised', 'naturalized', 'established', 'colonising', 'casual') then 'introduced' else 'unknown' end as label from ({RAW.format(events='events')}) r""")
def flt4(v):
    return _raw(v).select("key", sc.range_label(F.col("means"), F.col("degree")).alias("label"))


@query("FLT5_page_filters", "select record_id from occ where source = 'GBIF' and range_label = 'introduced'")
def flt5(v):
    return v.occ.where("source = 'GBIF' AND range_label = 'introduced'").select("record_id")


@query("FLT6_region_clip", "select count(*) filter (inside) as n_inside, count(*) filter (not inside) as n_outside from (select longitude between -20e0 and 60e0 and latitude between 0e0 and 50e0 as inside from occ) t")
def flt6(v):
    inside = F.col("longitude").between(-20.0, 60.0) & F.col("latitude").between(0.0, 50.0)
    return v.occ.agg(F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside"))


@query("FLT7_complete_cases", "select count(*) filter (b is not null) as n_complete, count(*) filter (b is null) as n_dropped from (select c.bio1 + c.bio12 as b from occ_cells o left join cells c on c.row = o.row and c.col = o.col) t")
def flt7(v):
    d = v.occ_cells.join(v.cells.select("row", "col", "bio1", "bio12"), ["row", "col"], "left")
    ok = sc.finite(F.col("bio1")).isNotNull() & sc.finite(F.col("bio12")).isNotNull()
    return d.agg(F.count_if(ok).alias("n_complete"), F.count_if(~ok).alias("n_dropped"))


@query("FLT8_year_or_undated", "select record_id from occ where event_date is null or year(event_date) <= 1990")
def flt8(v):
    return v.occ.where(F.col("event_date").isNull() | (F.year("event_date") <= 1990)).select("record_id")


@query("FLT10_model_type", "with n as (select taxon_key, count(*) filter (range_label = 'introduced') as n_intro, count(*) filter (range_label = 'native') as n_native from occ group by taxon_key) select taxon_key, case when n_intro >= 5 then 'B' else 'A' end as model_type, case when n_intro >= 5 then n_native + n_intro else n_native end as n_training from n")
def flt10(v):
    n = v.occ.groupBy("taxon_key").agg(F.count_if(F.col("range_label") == "introduced").alias("i"), F.count_if(F.col("range_label") == "native").alias("n"))
    return n.select("taxon_key", F.when(F.col("i") >= 5, "B").otherwise("A").alias("model_type"), F.when(F.col("i") >= 5, F.col("n") + F.col("i")).otherwise(F.col("n")).alias("n_training"))


_EFFECTIVE_SQL = """with l as (select source, record_id, kind, arg_max(value, struct_pack(a := created_ts, b := seq1, c := seq2, d := seq3)) as value from ann group by 1, 2, 3),
 e as (select source, record_id, max(value) filter (kind = 'range_label') as range_label, bool_or(value = 'true') filter (kind = 'exclude') as exclude, bool_or(value = 'true') filter (kind = 'cultivated') as cultivated, bool_or(value = 'true') filter (kind = 'verified') as verified from l group by 1, 2)"""


def _effective(v):
    return store.effective_annotations(v.ann, KEY, ["created_ts", "seq1", "seq2", "seq3"])


def _annotated(v):
    return store.apply_annotations(v.occ.withColumn("excluded", F.col("record_id") % 4 == 0), _effective(v), KEY)


@query("FLT11_annotation_exclusions", _EFFECTIVE_SQL + """, m as (select o.record_id % 4 = 0 as q, coalesce(exclude, false) or coalesce(cultivated, false) as drp, coalesce(verified, false) as ver from occ o left join e on e.source = o.source and e.record_id = o.record_id)
 select count(*) filter ((q and not ver) or drp) as n_excluded, count(*) filter (q and ver and not drp) as n_rescued, count(*) filter (drp) as n_by_annotation from m""")
def flt11(v):
    return _annotated(v).agg(F.count_if("excluded").alias("n_excluded"), F.count_if("rescued").alias("n_rescued"), F.count_if("by_annotation").alias("n_by_annotation"))


@query("FLT12_label_override", _EFFECTIVE_SQL + " select coalesce(e.range_label, o.range_label) as range_label, count(*) as n, count(*) filter (e.range_label is not null and e.range_label <> o.range_label) as n_changed from occ o left join e on e.source = o.source and e.record_id = o.record_id group by 1")
def flt12(v):
    return _annotated(v).groupBy("range_label").agg(F.count("*").alias("n"), F.count_if("relabelled").alias("n_changed"))


@query("AGG47_effective_annotations", _EFFECTIVE_SQL + " select source, record_id, range_label, exclude, cultivated, verified, n_annotations, last_author, last_ts from e join (select source, record_id, count(*) as n_annotations, arg_max(author, struct_pack(a := created_ts, b := seq1, c := seq2, d := seq3)) as last_author, max(created_ts) as last_ts from ann group by 1, 2) x using (source, record_id)")
def agg47(v):
    return _effective(v)


@query("AGG48_annotation_summary", _EFFECTIVE_SQL + " select count(*) as n_records, count(range_label) as n_relabel, count(*) filter (exclude) as n_exclude, count(*) filter (cultivated) as n_cultivated, count(*) filter (verified) as n_verified from e")
def agg48(v):
    return _effective(v).agg(F.count("*").alias("n_records"), F.count("range_label").alias("n_relabel"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"n_{c}") for c in ("exclude", "cultivated", "verified")])


@query("FLT13_effort_filters", "with s as (select basis_of_record, count(*) * 1e0 / sum(count(*)) over () as share from occ group by 1), y as (select cast(quantile_cont(year(event_date), 0.05) as int) as y0, cast(quantile_cont(year(event_date), 0.95) as int) as y1 from occ where event_date is not null) select basis_of_record, round(share, 6) as share, y0, y1 from s cross join y where share >= 0.05e0 and basis_of_record in ('HUMAN_OBSERVATION', 'OBSERVATION', 'PRESERVED_SPECIMEN')")
def flt13(v):
    s = v.occ.groupBy("basis_of_record").agg(F.count("*").alias("n"))
    years = order.quantiles(v.occ, F.year("event_date"), {"y0": 0.05, "y1": 0.95}).select(F.col("y0").cast("int").alias("y0"), F.col("y1").cast("int").alias("y1"))
    total = v.occ.agg(F.count("*").alias("total")).crossJoin(F.broadcast(years))  # one row
    d = s.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total"))
    return d.where((F.col("share") >= 0.05) & F.col("basis_of_record").isin("HUMAN_OBSERVATION", "OBSERVATION", "PRESERVED_SPECIMEN")).select("basis_of_record", F.round("share", 6).alias("share"), "y0", "y1")


@query("FLT17_valid_annotations", "select count(*) as n, count(*) filter (case when kind = 'range_label' then value in ('native', 'introduced', 'unknown') else value in ('true', 'false') end) as n_valid from ann")
def flt17(v):
    value = F.lower(F.trim("value"))
    ok = F.when(F.col("kind") == "range_label", value.isin(sc.RANGE_LABELS)).when(F.col("kind").isin(sc.ANNOTATION_KINDS), value.isin("true", "false")).otherwise(F.lit(False))
    return v.ann.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"))


SUBS = "(values ('a', cast(null as int), 'outside_envelope'), ('b', 5000001, 'outside_envelope;outside_known_range'), ('c', 5000002, 'outside_known_range')) s(channel, taxon, kinds)"


def _subscriptions(v):
    return v.spark.createDataFrame([("a", None, ["outside_envelope"]), ("b", 5000001, ["outside_envelope", "outside_known_range"]), ("c", 5000002, ["outside_known_range"])], "channel string, taxon int, kinds array<string>")


@query("FLT18_subscription_match", f"select channel, kind, count(*) as n from (select taxon_key, case when record_id % 2 = 0 then 'outside_envelope' else 'outside_known_range' end as kind from occ) a join {SUBS} on (taxon is null or taxon = taxon_key) and list_contains(string_split(kinds, ';'), kind) group by 1, 2")
def flt18(v):
    alerts = v.occ.select("taxon_key", F.when(F.col("record_id") % 2 == 0, "outside_envelope").otherwise("outside_known_range").alias("kind"))
    s = _subscriptions(v)
    by_kind = s.select("channel", "taxon", F.explode("kinds").alias("kind"))
    hit = alerts.join(F.broadcast(by_kind), "kind").where(F.col("taxon").isNull() | (F.col("taxon") == F.col("taxon_key")))
    return hit.groupBy("channel", "kind").agg(F.count("*").alias("n"))


@query("FLT20_polygon_bounds", "select poly, count(*) as n_edges, min(least(x1, x2)) as west, max(greatest(x1, x2)) as east, min(least(y1, y2)) >= -90 and max(greatest(y1, y2)) <= 90 and min(least(x1, x2)) >= -180 and max(greatest(x1, x2)) <= 180 as valid from edges group by poly")
def flt20(v):
    box = v.edges.groupBy("poly").agg(F.count("*").alias("n_edges"), F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"), F.min(F.least("y1", "y2")).alias("s"), F.max(F.greatest("y1", "y2")).alias("n"))
    return box.select("poly", "n_edges", "west", "east", ((F.col("s") >= -90) & (F.col("n") <= 90) & (F.col("west") >= -180) & (F.col("east") <= 180)).alias("valid"))


@query("FLT21_region_request", "select id, greatest(west, -180e0) as west, least(east, 180e0) as east, west < east and south < north as ordered, cast(round((least(east, 180e0) - greatest(west, -180e0)) * 120) * round((north - south) * 120) as bigint) as cells, round((least(east, 180e0) - greatest(west, -180e0)) * 120) * round((north - south) * 120) <= 1600000 as accepted from box_rows")
def flt21(v):
    west, east = F.greatest("west", F.lit(-180.0)), F.least("east", F.lit(180.0))
    cells = F.round((east - west) * 120) * F.round((F.col("north") - F.col("south")) * 120)
    return v.box_rows.select("id", west.alias("west"), east.alias("east"), ((F.col("west") < F.col("east")) & (F.col("south") < F.col("north"))).alias("ordered"), cells.cast("long").alias("cells"), (cells <= 1_600_000).alias("accepted"))


@query("FLT14_requested_predictors", f"select id, array_to_string(list_filter(list_sort(list_distinct(wanted)), lambda x: x in ('bio1', 'bio4', 'bio12')), ',') as used, len(list_filter(list_distinct(wanted), lambda x: x in ('bio1', 'bio4', 'bio12'))) < 2 as automatic from wanted_rows")
def flt14(v):
    used = F.array_intersect(F.array_distinct("wanted"), F.array(F.lit("bio1"), F.lit("bio4"), F.lit("bio12")))
    return v.wanted_rows.select("id", F.array_join(F.array_sort(used), ",").alias("used"), (F.size(used) < 2).alias("automatic"))


@query("FLT22_environment_choice", f"select id, len(list_filter(wanted, lambda x: x not in ('bio1', 'bio4', 'bio12'))) as unknown, len(list_distinct(wanted)) >= 2 and len(list_filter(wanted, lambda x: x not in ('bio1', 'bio4', 'bio12'))) = 0 as accepted from wanted_rows")
def flt22(v):
    unknown = F.size(F.array_except("wanted", F.array(F.lit("bio1"), F.lit("bio4"), F.lit("bio12"))))
    return v.wanted_rows.select("id", unknown.cast("long").alias("unknown"), ((F.size(F.array_distinct("wanted")) >= 2) & (unknown == 0)).alias("accepted"))


@query("SET3_offered_and_unavailable", f"select id, array_to_string(list_sort(list_distinct(list_filter(wanted, lambda x: x not in ('bio1', 'bio4', 'bio12')))), ',') as unavailable from wanted_rows")
def set3(v):
    return v.wanted_rows.select("id", F.array_join(F.array_sort(F.array_except("wanted", F.array(F.lit("bio1"), F.lit("bio4"), F.lit("bio12")))), ",").alias("unavailable"))


_GROUP_SQL = """case when regexp_matches(name, '^bio[0-9]+$') then case when cast(substr(name, 4) as int) <= 11 then 'temperature' else 'precipitation' end when starts_with(name, 'soil_') then 'soil' when regexp_matches(name, '^(hurs|vpd)_') then 'humidity' when starts_with(name, 'sfcWind_') then 'wind'
 when regexp_matches(name, '^(cmi|pet_penman)_') then 'water_balance' when regexp_matches(name, '^(rsds|clt)_') then 'radiation' when name in ('ai', 'swb') then 'water_balance' when regexp_matches(name, '^(gdd|ngd)') or name in ('gsl', 'gsp', 'gst', 'fcf', 'scd', 'npp') then 'growing_season' else 'other' end"""


@query("FLT15_predictor_groups", f"select {_GROUP_SQL} as grp, string_agg(name, ',' order by name) as names from predictor_rows t group by 1")
def flt15(v):
    return v.predictor_rows.groupBy(sc.predictor_group(F.col("name")).alias("grp")).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


@query("FLT16_candidate_sets", f"with g as (select {_GROUP_SQL} as grp, name from predictor_rows t), s as (select grp as set_name, list(name order by name) as names from g group by 1 union all select 'climate', list(name order by name) from g where grp in ('temperature', 'precipitation') union all select 'all', list(name order by name) from g) select set_name, len(names) as n from s where len(names) >= 2")
def flt16(v):
    g = v.predictor_rows.withColumn("grp", sc.predictor_group(F.col("name")))
    sets = g.select(F.explode(F.array(F.col("grp"), F.when(F.col("grp").isin("temperature", "precipitation"), F.lit("climate")), F.lit("all"))).alias("set_name"), "name").where("set_name IS NOT NULL")
    return sets.groupBy("set_name").agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") >= 2).select("set_name", F.size("names").cast("long").alias("n"))


@query("FLT23_active_job_guard", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O')")
def flt23(v):
    active = v.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return v.customer.join(active, "c_custkey", "left_semi").select("c_custkey")


@query("FLT24_role_gate", "with m as (select * from (values ('analysts', 1), ('curators', 2)) v(grp, rank)), r as (select usr, max(coalesce(rank, 0)) as rank from (select usr, unnest(grps) as grp from user_rows) t left join m using (grp) group by usr) select usr, case rank when 2 then 'curator' when 1 then 'analyst' else 'viewer' end as role, rank >= 1 as may_run from r")
def flt24(v):
    ranks = v.spark.createDataFrame([("analysts", 1), ("curators", 2)], "grp string, rank int")
    r = v.user_rows.select("usr", F.explode("grps").alias("grp")).join(F.broadcast(ranks), "grp", "left").groupBy("usr").agg(F.max(F.coalesce("rank", F.lit(0))).alias("rank"))  # two ranks
    return r.select("usr", F.when(F.col("rank") == 2, "curator").when(F.col("rank") == 1, "analyst").otherwise("viewer").alias("role"), (F.col("rank") >= 1).alias("may_run"))


@query("AGG1_label_counts", f"select count(*) as total, count(*) filter (range_label = 'native') as native, count(*) filter (range_label = 'introduced') as introduced, count(*) filter (range_label = 'unknown') as unknown from occ where taxon_key = {TAXON}")
def agg1(v):
    return v.occ.where(F.col("taxon_key") == TAXON).agg(F.count("*").alias("total"), *[F.count_if(F.col("range_label") == c).alias(c) for c in sc.RANGE_LABELS])


@query("AGG2_source_counts", f"select count(*) filter (source = 'GBIF') as gbif, count(*) filter (source = 'GBIF' and inat_crossref_id is not null) as gbif_from_inaturalist, count(*) filter (source = 'iNaturalist') as inaturalist_direct from occ where taxon_key = {TAXON}")
def agg2(v):
    gbif = F.col("source") == "GBIF"
    return v.occ.where(F.col("taxon_key") == TAXON).agg(F.count_if(gbif).alias("gbif"), F.count_if(gbif & F.col("inat_crossref_id").isNotNull()).alias("gbif_from_inaturalist"), F.count_if(F.col("source") == "iNaturalist").alias("inaturalist_direct"))


@query("AGG3_timeline", f"select cast(year(event_date) as int) as yr, range_label, count(*) as n from occ where taxon_key = {TAXON} and event_date is not null group by 1, 2")
def agg3(v):
    return v.occ.where((F.col("taxon_key") == TAXON) & F.col("event_date").isNotNull()).groupBy(F.year("event_date").alias("yr"), "range_label").agg(F.count("*").alias("n"))


@query("AGG4_timeline_pivot_fill", f"""with y as (select cast(year(event_date) as int) as yr, range_label as l from occ where taxon_key = {TAXON} and event_date is not null), g as (select unnest(generate_series(min(yr), max(yr))) as yr from y),
 n as (select g.yr, count(*) filter (l = 'native') as native, count(*) filter (l = 'introduced') as introduced, count(*) filter (l = 'unknown') as unknown, count(l) as tot from g left join y on y.yr = g.yr group by g.yr)
 select cast(yr as int) as yr, native, introduced, unknown, cast(sum(tot) over (order by yr) as bigint) as cumulative from n""")
def agg4(v):
    y = v.occ.where((F.col("taxon_key") == TAXON) & F.col("event_date").isNotNull()).groupBy(F.year("event_date").alias("yr")).pivot("range_label", sc.RANGE_LABELS).agg(F.count(F.lit(1)))
    years = y.agg(F.explode(F.sequence(F.min("yr"), F.max("yr"))).alias("yr"))
    d = years.join(y, "yr", "left").na.fill(0, sc.RANGE_LABELS)
    total = sum((F.col(c) for c in sc.RANGE_LABELS[1:]), F.col(sc.RANGE_LABELS[0]))
    # a row for each year: one ordered frame over all of them is small
    return d.withColumn("cumulative", F.sum(total).over(Window.orderBy("yr").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


@query("WIN2_running_total", "select cast(year(event_date) as int) as yr, taxon_key, cast(sum(count(*)) over (partition by taxon_key order by year(event_date)) as bigint) as running from occ where event_date is not null group by 1, 2, year(event_date)")
def win2(v):
    n = v.occ.where("event_date IS NOT NULL").groupBy("taxon_key", F.year("event_date").alias("yr")).agg(F.count("*").alias("n"))
    return n.select("yr", "taxon_key", F.sum("n").over(Window.partitionBy("taxon_key").orderBy("yr")).alias("running"))


@query("WIN8_page_with_total", "select source, record_id, (select count(*) from occ where range_label = 'unknown') as total from occ where range_label = 'unknown' order by ingested_ts desc, record_id limit 50 offset 100")
def win8(v):
    return store.page(v.occ.where("range_label = 'unknown'"), [F.desc("ingested_ts"), F.col("record_id")], 100, 50).select("source", "record_id", "total")


@query("WIN9_newest_first", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 20")
def win9(v):
    return v.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select("o_orderkey", "o_orderdate")


@query("AGG10_value_counts", "select i as issue, count(*) as n from (select unnest(string_split(issues_csv, ';')) as i from occ) t where i <> '' group by i order by n desc, i limit 15")
def agg10(v):
    n = v.occ.select(F.explode(sc.issue_set(F.col("issues_csv"))).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "issue").limit(15)


@query("AGG11_share_per_group", "select basis_of_record, round(count(*) * 1e0 / sum(count(*)) over (), 6) as share from occ group by 1")
def agg11(v):
    n = v.occ.groupBy("basis_of_record").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("basis_of_record", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("AGG41_reference_counts", "select dataset_id, count(*) filter (occurrence_status = 'present') as n_present, count(*) filter (occurrence_status = 'absent') as n_absent from ref_rec group by 1")
def agg41(v):
    return v.ref_rec.groupBy("dataset_id").agg(F.count_if(F.col("occurrence_status") == "present").alias("n_present"), F.count_if(F.col("occurrence_status") == "absent").alias("n_absent"))


@query("AGG42_alert_classes", "select count(*) filter (c = 'expansion') as expansion, count(*) filter (c = 'discovery') as discovery, count(*) filter (c = 'unknown') as unknown from (select case when coordinate_uncertainty_m is null then 'unknown' when coordinate_uncertainty_m > 2000 then 'expansion' else 'discovery' end as c from occ) t")
def agg42(v):
    c = F.when(F.col("coordinate_uncertainty_m").isNull(), "unknown").when(F.col("coordinate_uncertainty_m") > 2000, "expansion").otherwise("discovery")
    return v.occ.agg(*[F.count_if(c == k).alias(k) for k in ("expansion", "discovery", "unknown")])


@query("AGG43_batch_decisions", "select o_orderstatus as decision, count(*) as n, count(*) filter (o_totalprice > 300000) as failed from orders group by 1")
def agg43(v):
    return v.orders.groupBy(F.col("o_orderstatus").alias("decision")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 300000).alias("failed"))


@query("AGG44_five_year_trend", "with t as (select taxon_key, count(*) filter (year(event_date) between 2020 and 2024) as recent, count(*) filter (year(event_date) between 2015 and 2019) as prior from occ group by 1) select taxon_key, recent, prior, case when prior > 0 then round((recent - prior) * 100e0 / prior, 4) end as change_percent from t")
def agg44(v):
    y = F.year("event_date")
    t = v.occ.groupBy("taxon_key").agg(F.count_if(y.between(2020, 2024)).alias("recent"), F.count_if(y.between(2015, 2019)).alias("prior"))
    return t.withColumn("change_percent", F.when(F.col("prior") > 0, F.round((F.col("recent") - F.col("prior")) * 100.0 / F.col("prior"), 4)))


@query("AGG52_rollup", "select taxon_key, range_label, count(*) as n from occ group by rollup (taxon_key, range_label)")
def agg52(v):
    return v.occ.rollup("taxon_key", "range_label").agg(F.count("*").alias("n"))


@query("SET1_union_with_provenance", "select source, record_id from occ where range_label = 'native' union all select concat('upload:', dataset_id) as source, record_id from ref_rec where occurrence_status = 'present'")
def set1(v):
    uploads = v.ref_rec.where("occurrence_status = 'present'").select(F.concat(F.lit("upload:"), "dataset_id").alias("source"), "record_id")
    return v.occ.where("range_label = 'native'").select(*KEY).unionByName(uploads, allowMissingColumns=True)


@query("SET2_id_difference", "select record_id from occ where source = 'iNaturalist' except select inat_crossref_id from occ where inat_crossref_id is not null")
def set2(v):
    ids = v.occ.where("inat_crossref_id IS NOT NULL").select(F.col("inat_crossref_id").alias("record_id"))
    return v.occ.where("source = 'iNaturalist'").select("record_id").distinct().join(ids, "record_id", "left_anti")


@query("SET4_distinct_names", "select name from (select n_name as name, row_number() over (partition by lower(trim(n_name)) order by pos) as rn from (select n_name, n_nationkey as pos from nation union all select concat(' ', lower(n_name), ' '), n_nationkey + 100 from nation) t) u where rn = 1")
def set4(v):
    n = v.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("pos"))
    both = n.unionAll(n.select(F.concat(F.lit(" "), F.lower("name"), F.lit(" ")), F.col("pos") + 100))
    return store.first_per_key(both.withColumn("k", F.lower(F.trim("name"))), ["k"], [F.col("pos")]).select("name")


@query("STR1_delta_since_watermark", "select source, record_id from occ where cast(ingested_ts as date) >= date '2024-01-25'")
def str1(v):
    return v.occ.where(F.col("ingested_ts") >= F.lit("2024-01-25").cast("timestamp")).select(*KEY)


@query("STR2_source_watermarks", "select source, max(ingested_ts) filter (source <> 'iNaturalist' or ingested_ts < timestamp '2024-01-20 00:00:00') as watermark from occ group by source")
def str2(v):
    ok = (F.col("source") != "iNaturalist") | (F.col("ingested_ts") < F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return v.occ.groupBy("source").agg(F.max(F.when(ok, F.col("ingested_ts"))).alias("watermark"))


@query("STR3_dedupe_on_key", f"with d as ({DELTA}) select count(*) as attempted, count(distinct (source, record_id)) filter (not exists (select 1 from occ o where o.source = d.source and o.record_id = d.record_id)) as inserted from d")
def str3(v):
    d = _delta(v).select(*KEY)
    fresh = d.dropDuplicates(KEY).join(v.occ.select(*KEY), KEY, "left_anti")
    return d.agg(F.count("*").alias("attempted")).crossJoin(F.broadcast(fresh.agg(F.count("*").alias("inserted"))))


@query("STR8_full_resync", f"with d as ({DELTA}) select count(*) as n from (select source, record_id from occ union select source, record_id from d) t")
def str8(v):
    return store.append_ignore(v.occ.select(*KEY), _delta(v).select(*KEY), KEY).agg(F.count("*").alias("n"))


@query("STR7_redelivered_rows", f"with d as ({DELTA}) select count(*) as redelivered, count(*) filter (o.issues_csv is null) as filled from occ o where exists (select 1 from d where d.source = o.source and d.record_id = o.record_id)")
def str7(v):
    again = v.occ.join(_delta(v).select(*KEY), KEY, "left_semi")
    return again.agg(F.count("*").alias("redelivered"), F.count_if(F.col("issues_csv").isNull()).alias("filled"))


@query("STR9_stale_jobs", "select o_orderkey from orders where o_orderstatus = 'O' and o_orderdate < timestamp '1997-01-01 00:00:00' - interval 30 day")
def str9(v):
    return v.orders.where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1997-01-01 00:00:00").cast("timestamp") - F.expr("INTERVAL 30 DAYS"))).select("o_orderkey")


@query("STR13_tumbling_windows", "select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def str13(v):
    return v.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query("STR13_sliding_windows", "select w as window_start, count(*) as n from (select unnest([time_bucket(interval 6 hour, ts), time_bucket(interval 6 hour, ts) - interval 6 hour]) as w from events) t group by w")
def str13b(v):
    return v.events.groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


@query("STR13_sessions", """with g as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts) >= ts - interval 2 hour and lag(ts) over (partition by user_id order by ts) + interval 2 hour > ts then 0 else 1 end as fresh from events),
 s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as sid from g) select user_id, min(ts) as session_start, count(*) as n from s group by user_id, sid""")
def str13c(v):
    return v.events.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")
