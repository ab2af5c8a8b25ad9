"""Queries of the scalar families: text, dates, numbers, geometry, arrays, JSON, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from florascope.functions import geo
from florascope.functions import scalars as sc

from .catalog import query

_ISO_DAY = (
    "case event_id % 4 when 0 then '2021-05-17T08:30:00Z' when 1 then '2021-13-01' when 2 then '' "
    "else concat('20', cast(10 + event_id % 15 as varchar), '-02-28') end"
)
_MEANS = "case event_id % 6 when 0 then 'Native ' when 1 then 'introduced (assisted)' when 2 then 'naturalised' when 3 then 'vagrant' else null end"
_DEGREE = "case event_id % 4 when 0 then 'casual' when 1 then 'native' when 2 then null else 'unclear' end"


@query("SCA7_collapse_spaces", r"select doc_id, regexp_replace(trim(text), '\s+', ' ', 'g') as t from documents")
def sca7(v):
    return v.documents.select("doc_id", sc.collapse_spaces(F.col("text")).alias("t"))


@query("SCA8_column_key", "select distinct name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as k from scen")
def sca8(v):
    return v.scen.select("name", sc.column_key(F.col("name")).alias("k")).distinct()


@query(
    "SCA9_tile_label",
    """with t as (select distinct cast(floor(lat / 10e0) * 10 as bigint) as s, cast(floor(lon / 10e0) * 10 as bigint) as w from cells)
 select s, w, concat(case when s >= 0 then concat(s, '–', s + 10, '°N') when s <= -10 then concat(abs(s + 10), '–', abs(s), '°S') else concat(abs(s), '°S–', s + 10, '°N') end, ', ',
 case when w >= 0 then concat(w, '–', w + 10, '°E') when w <= -10 then concat(abs(w + 10), '–', abs(w), '°W') else concat(abs(w), '°W–', w + 10, '°E') end) as label from t""",
)
def sca9(v):
    ten = lambda c: (F.floor(F.col(c) / 10.0) * 10).cast("long")
    t = v.cells.select(ten("lat").alias("s"), ten("lon").alias("w")).distinct()
    return t.select("s", "w", sc.tile_label(F.col("s") + 10, F.col("w")).alias("label"))


@query(
    "SCA10_joined_detail",
    "select record_id, nullif(substr(trim(array_to_string(list_filter([locality, recorded_by, record_number], lambda x: x is not null and x <> ''), ' | ')), 1, 500), '') as d from occ",
)
def sca10(v):
    return v.occ.select("record_id", sc.joined_detail(F.array("locality", "recorded_by", "record_number")).alias("d"))


@query(
    "SCA12_range_label",
    f"""with e as (select event_id, trim(lower(coalesce({_MEANS}, ''))) as m, trim(lower(coalesce({_DEGREE}, ''))) as d from events)
 select event_id, case when starts_with(m, 'native') or d = 'native' then 'native' when starts_with(m, 'introduced') or m in ('invasive', 'naturalised', 'naturalized')
 or d in ('invasive', 'naturalised', 'naturalized', 'established', 'colonising', 'casual') then 'introduced' else 'unknown' end as label from e""",
)
def sca12(v):
    return v.events.select("event_id", sc.range_label(F.expr(_MEANS), F.expr(_DEGREE)).alias("label"))


@query(
    "DAT3_iso_day",
    f"select event_id, cast(try_strptime(substr({_ISO_DAY}, 1, 10), '%Y-%m-%d') as date) as day from events",
)
def dat3(v):
    return v.events.select("event_id", sc.iso_day(F.expr(_ISO_DAY.replace("varchar", "string"))).alias("day"))


@query(
    "DAT4_year_column",
    "select event_id, case when event_id % 7 > 0 then make_date(cast(1950 + event_id % 70 as int), 1, 1) end as day from events",
)
def dat4(v):
    k = F.col("event_id")
    return v.events.select("event_id", sc.year_start(F.when(k % 7 > 0, (1950 + k % 70).cast("double"))).alias("day"))


@query(
    "DAT5_days_apart",
    "select a.record_id, abs(date_diff('day', a.event_date, b.event_date)) <= 400 as near from occ a join occ b on b.record_id = a.record_id + 1",
)
def dat5(v):
    b = v.occ.select((F.col("record_id") - 1).alias("record_id"), F.col("event_date").alias("other"))
    return v.occ.join(b, "record_id").select("record_id", (F.abs(F.datediff("other", "event_date")) <= 400).alias("near"))


@query("DAT6_stale", "select event_id, ts < timestamp '2024-01-20 00:00:00' - interval 7 day as stale from events")
def dat6(v):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return v.events.select("event_id", sc.stale(F.col("ts").cast("timestamp_ntz"), 7, now).alias("stale"))


_WHOLE = "case event_id % 5 when 0 then ' 12 ' when 1 then '' when 2 then '12.5' when 3 then 'x' else concat('-', cast(event_id as {t})) end"


@query(
    "NUM2_integer_or_null",
    f"select event_id, case when regexp_matches(trim(s), '^[+-]?[0-9]+$') then cast(trim(s) as bigint) end as n from (select event_id, {_WHOLE.format(t='varchar')} as s from events) t",
)
def num2(v):
    return v.events.select("event_id", sc.integer(F.expr(_WHOLE.format(t="string"))).alias("n"))


@query("NUM3_finite_or_null", "select event_id, case when event_id % 3 = 0 then value end as x from events")
def num3(v):
    k = F.col("event_id") % 3
    return v.events.select("event_id", sc.finite(F.when(k == 0, F.col("value")).when(k == 1, float("inf")).otherwise(float("nan"))).alias("x"))


@query(
    "GEO3_web_mercator",
    """select record_id, round(longitude * (20037508.342789244e0 / 180e0), 3) as x,
 round(ln(tan((90e0 + latitude) * (pi() / 360e0))) * (20037508.342789244e0 / pi()), 3) as y from occ where abs(latitude) < 85""",
)
def geo3(v):
    x, y = geo.mercator_x(F.col("longitude")), geo.mercator_y(F.col("latitude"))
    return v.occ.where("abs(latitude) < 85").select("record_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(
    "GEO5_clip_and_wrap",
    """select record_id, greatest(least(latitude * 2e0, 90e0), -90e0) as lat,
 round(fmod(fmod(longitude * 3e0 + 180e0, 360e0) + 360e0, 360e0) - 180e0, 6) as lon from occ""",
)
def geo5(v):
    lat, lon = geo.clip(F.col("latitude") * 2.0, -90.0, 90.0), geo.wrap_lon(F.col("longitude") * 3.0)
    return v.occ.select("record_id", lat.alias("lat"), F.round(lon, 6).alias("lon"))


_ZOOM_BOX = "longitude - {w} as west, latitude - {w} / 2e0 as south, longitude + {w} as east, latitude + {w} / 2e0 as north"


@query(
    "GEO6_zoom",
    f"""with b as (select record_id, {_ZOOM_BOX.format(w="(1e0 + record_id % 60)")} from occ),
 c as (select record_id, greatest(west, -180e0) as west, greatest(south, -90e0) as south, least(east, 180e0) as east, least(north, 90e0) as north from b),
 z as (select unnest(range(6)) as z), s as (select c.*, z, 180e0 / pow(2e0, z) as span from c cross join z)
 select record_id, cast(max(z) as int) as z from s where z = 0 or
 (least(pow(2e0, z + 1), ceil((east + 180e0) / span)) - greatest(0e0, floor((west + 180e0) / span))) *
 (least(pow(2e0, z), ceil((90e0 - south) / span)) - greatest(0e0, floor((90e0 - north) / span))) <= 64 group by 1""",
)
def geo6(v):
    """Pixels of at most 1/60 degree in tiles of 512 pixels would need zoom 5; 64 tiles at most."""
    w = F.lit(1.0) + F.col("record_id") % 60
    lon, lat = F.col("longitude"), F.col("latitude")
    z = geo.zoom(lon - w, lat - w / 2.0, lon + w, lat + w / 2.0, pixel=1 / 60, tile_px=512, most=64, deepest=6)
    return v.occ.select("record_id", z.alias("z"))


_TESTS = "[case when event_date is null then 'no_date' end, case when coordinate_uncertainty_m > 2000e0 then 'imprecise' end, case when issues_csv <> '' then 'issue' end]"


@query("ARR2_flag_list", f"select record_id, array_to_string(list_filter({_TESTS}, lambda x: x is not null), ';') as flags from occ")
def arr2(v):
    tests = {
        "no_date": F.col("event_date").isNull(),
        "imprecise": F.col("coordinate_uncertainty_m") > 2000.0,
        "issue": F.col("issues_csv") != "",
    }
    return v.occ.select("record_id", F.array_join(sc.flag_list(tests), ";").alias("flags"))


@query(
    "ARR4_least_and_where",
    "select row, col, list_min(s) as least, cast(list_position(s, list_min(s)) as int) as at from (select row, col, [30e0 - bio1, bio4 / 100e0, bio12 / 200e0] as s from cells) t",
)
def arr4(v):
    s = F.array(30.0 - F.col("bio1"), F.col("bio4") / 100.0, F.col("bio12") / 200.0)
    d = v.cells.select("row", "col", s.alias("s"))
    return d.select("row", "col", F.array_min("s").alias("least"), F.array_position("s", F.array_min("s")).cast("int").alias("at"))


@query(
    "ARR5_importance_order",
    "select taxon_key, string_agg(basis_of_record, '>' order by n desc, basis_of_record) as ranked from (select taxon_key, basis_of_record, count(*) as n from occ group by 1, 2) t group by 1",
)
def arr5(v):
    n = v.occ.groupBy("taxon_key", "basis_of_record").agg(F.count("*").alias("n"))
    m = n.groupBy("taxon_key").agg(F.map_from_entries(F.collect_list(F.struct("basis_of_record", "n"))).alias("m"))
    return m.select("taxon_key", F.array_join(sc.by_importance(F.col("m")), ">").alias("ranked"))


@query(
    "ARR6_explode_issues",
    "select record_id, code from (select record_id, unnest(string_split(issues_csv, ';')) as code from occ where issues_csv is not null) t where code <> ''",
)
def arr6(v):
    return v.occ.select("record_id", F.explode(sc.issue_set(F.col("issues_csv"))).alias("code"))


@query(
    "ARR7_kinds_contained",
    "select taxon_key, source, record_id, list_contains(list(distinct kind), 'exclude') as excluded from ann group by 1, 2, 3",
)
def arr7(v):
    k = v.ann.groupBy("taxon_key", "source", "record_id").agg(F.collect_set("kind").alias("kinds"))
    return k.select("taxon_key", "source", "record_id", F.array_contains("kinds", "exclude").alias("excluded"))


@query(
    "JSN2_nested_path",
    "select event_id, cast(json_extract_string(json_object('metrics', json_object('auc', value)), '$.metrics.auc') as double) as auc from events",
)
def jsn2(v):
    j = F.to_json(F.struct(F.struct(F.col("value").alias("auc")).alias("metrics")))
    return v.events.select("event_id", F.get_json_object(j, "$.metrics.auc").cast("double").alias("auc"))


@query(
    "JSN4_iso_dates",
    """select event_id, concat('{"day":"', strftime(t, '%Y-%m-%d'), '","at":"', strftime(t, '%Y-%m-%dT%H:%M:%S'), case when event_id % 2 = 0 then strftime(t, '.%f') else '' end, '"}') as j
 from (select event_id, case when event_id % 2 = 0 then date_trunc('second', ts) + interval 25 microsecond else date_trunc('second', ts) end as t from events) e""",
)
def jsn4(v):
    whole = F.date_trunc("second", F.col("ts").cast("timestamp"))
    t = F.when(F.col("event_id") % 2 == 0, whole + F.expr("interval 25 microsecond")).otherwise(whole)
    j = F.to_json(F.struct(F.to_date("t").alias("day"), sc.iso_timestamp(F.col("t")).alias("at")))
    return v.events.select("event_id", t.alias("t")).select("event_id", j.alias("j"))


@query(
    "HSH2_verify",
    "select doc_id, coalesce(text is not null and doc_id % 5 > 0, false) as ok from documents",
)
def hsh2(v):
    recorded = F.sha2(F.concat("text", F.when(F.col("doc_id") % 5 > 0, "").otherwise("changed")), 256)
    return v.documents.select("doc_id", sc.verified(F.col("text"), recorded).alias("ok"))
