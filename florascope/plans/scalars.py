"""Queries of scalar functions, readers and tiles."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from florascope.functions import scalars as sc
from florascope.functions.geo import HAV_SQL, hav_km
from florascope.operators.session import ensure_checkpoint_dir
from florascope.sources import readers, tiles

from .catalog import query

_ISSUES = "list_sort(list_distinct(list_filter(list_transform(string_split(issues_csv, ';'), lambda x: upper(trim(x))), lambda x: x <> '')))"


@query("SCA1_issue_sets", f"select record_id, case when issues_csv is not null then array_to_string({_ISSUES}, '|') end as issues, case when issues_csv is not null then len({_ISSUES}) end as n from occ")
def sca1(v):
    s = sc.issue_set(F.col("issues_csv"))
    return v.occ.select("record_id", F.when(s.isNotNull(), F.array_join(s, "|")).alias("issues"), F.when(s.isNotNull(), F.size(s).cast("long")).alias("n"))


@query("SCA2_norm_key", "select record_id, regexp_replace(lower(coalesce(recorded_by, '')), '[^0-9a-z]', '', 'g') as collector from occ")
def sca2(v):
    return v.occ.select("record_id", sc.norm_key(F.col("recorded_by")).alias("collector"))


@query("SCA3_detail_text", "select doc_id, case when length(trim(substr(trim(text), 1, 500))) > 0 then substr(trim(text), 1, 500) end as detail from documents")
def sca3(v):
    return v.documents.select("doc_id", sc.detail_text(F.col("text")).alias("detail"))


@query("SCA4_scenario_names", "select name, regexp_extract(name, '_([^_]*_[^_]*)$', 1) as grp from (select distinct name from scen) t")
def sca4(v):
    return v.scen.select("name").distinct().select("name", sc.scenario_group(F.col("name")).alias("grp"))


@query("SCA5_xml_escape", "select n_nationkey, replace(replace(replace(replace(concat('<', n_name, ' & \"co\">'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as title from nation")
def sca5(v):
    return v.nation.select("n_nationkey", sc.xml_escape(F.concat(F.lit("<"), "n_name", F.lit(' & "co">'))).alias("title"))


@query("SCA6_alert_sentence", "select taxon_key, concat(cast(count(*) as varchar), ' new record', case when count(*) = 1 then '' else 's' end, ' of taxon ', cast(taxon_key as varchar), ' outside the known range') as sentence from occ group by 1")
def sca6(v):
    n = v.occ.groupBy("taxon_key").agg(F.count("*").alias("n"))
    return n.select("taxon_key", F.concat(F.col("n").cast("string"), F.lit(" new record"), F.when(F.col("n") == 1, "").otherwise("s"), F.lit(" of taxon "), F.col("taxon_key").cast("string"), F.lit(" outside the known range")).alias("sentence"))


_DATES = "select event_id as id, case event_id % 6 when 0 then concat(cast(2000 + event_id % 20 as varchar), '-05-1', cast(event_id % 9 as varchar), '/2021-01-01') when 1 then concat(cast(1990 + event_id % 30 as varchar), '-0', cast(1 + event_id % 9 as varchar)) when 2 then cast(1950 + event_id % 70 as varchar) when 3 then '' when 4 then 'spring 1999' else null end as d from events"


@query("DAT1_partial_dates", f"select id, coalesce(cast(try_strptime(case when regexp_matches(substr(split_part(trim(d), '/', 1), 1, 10), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then substr(split_part(trim(d), '/', 1), 1, 10) end, '%Y-%m-%d') as date), cast(try_strptime(case when regexp_matches(substr(split_part(trim(d), '/', 1), 1, 7), '^[0-9]{{4}}-[0-9]{{2}}$') then substr(split_part(trim(d), '/', 1), 1, 7) end, '%Y-%m') as date), cast(try_strptime(case when regexp_matches(substr(split_part(trim(d), '/', 1), 1, 4), '^[0-9]{{4}}$') then substr(split_part(trim(d), '/', 1), 1, 4) end, '%Y') as date)) as start from ({_DATES}) t")
def dat1(v):
    k = F.col("event_id")
    s = lambda c: c.cast("string")
    d = (
        F.when(k % 6 == 0, F.concat(s(2000 + k % 20), F.lit("-05-1"), s(k % 9), F.lit("/2021-01-01"))).when(k % 6 == 1, F.concat(s(1990 + k % 30), F.lit("-0"), s(1 + k % 9)))
        .when(k % 6 == 2, s(1950 + k % 70)).when(k % 6 == 3, "").when(k % 6 == 4, "spring 1999")
    )
    return v.events.select(k.alias("id"), sc.partial_date(d).alias("start"))


@query("DAT2_years_and_days", "select record_id, cast(year(event_date) as int) as yr, date_diff('day', event_date, date '2024-06-01') as age from occ")
def dat2(v):
    return v.occ.select("record_id", F.year("event_date").alias("yr"), F.datediff(F.lit("2024-06-01").cast("date"), "event_date").cast("long").alias("age"))


@query("NUM1_numbers_or_null", "select event_id, try_cast(nullif(trim(case event_id % 4 when 0 then ' 12.5 ' when 1 then '' when 2 then 'x' else cast(event_id as varchar) end), '') as double) as n from events")
def num1(v):
    k = F.col("event_id")
    return v.events.select("event_id", sc.number(F.when(k % 4 == 0, " 12.5 ").when(k % 4 == 1, "").when(k % 4 == 2, "x").otherwise(k.cast("string"))).alias("n"))


@query("NUM4_decimals", "select record_id, cast((case " + " ".join(f"when round(longitude, {d}) = longitude then {d}" for d in range(9)) + " else 9 end) as int) as d from occ")
def num4(v):
    return v.occ.select("record_id", sc.decimals(F.col("longitude")).alias("d"))


@query("GEO1_haversine", f"select a.record_id, round({HAV_SQL.format(a='a', b='b')}, 6) as km from occ a join occ b on b.record_id = a.record_id + 1")
def geo1(v):
    b = v.occ.select((F.col("record_id") - 1).alias("record_id"), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    return v.occ.join(b, "record_id").select("record_id", F.round(hav_km(F.col("longitude"), F.col("latitude"), F.col("x"), F.col("y")), 6).alias("km"))


@query("GEO4_unit_sphere", "select record_id, round(cos(radians(latitude)) * cos(radians(longitude)), 9) as x, round(cos(radians(latitude)) * sin(radians(longitude)), 9) as y, round(sin(radians(latitude)), 9) as z from occ")
def geo4(v):
    lon, lat = F.radians("longitude"), F.radians("latitude")
    return v.occ.select("record_id", F.round(F.cos(lat) * F.cos(lon), 9).alias("x"), F.round(F.cos(lat) * F.sin(lon), 9).alias("y"), F.round(F.sin(lat), 9).alias("z"))


@query("ARR1_error_groups", "select record_id, len(list_intersect(string_split(issues_csv, ';'), ['ZERO_COORDINATE', 'RECORDED_DATE_INVALID'])) > 0 as hit from occ where issues_csv is not null")
def arr1(v):
    return v.occ.where("issues_csv IS NOT NULL").select("record_id", F.arrays_overlap(F.split("issues_csv", ";"), F.array(F.lit("ZERO_COORDINATE"), F.lit("RECORDED_DATE_INVALID"))).alias("hit"))


@query("ARR3_nested_default", "select event_id, coalesce(cast(json_extract_string(props, '$.k') as bigint), -1) as k, coalesce(json_extract_string(props, '$.missing.deep'), 'none') as deep from events")
def arr3(v):
    return v.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.missing.deep"), F.lit("none")).alias("deep"))


@query("JSN1_details", "select event_id, cast(json_extract_string(props, '$.k') as bigint) + 1 as next from events")
def jsn1(v):
    return v.events.select("event_id", (F.from_json("props", "k long")["k"] + 1).alias("next"))


@query("JSN3_finite_json", "select row, col, concat('{\"v\":', case when bio1 > 20 then 'null' else cast(cast(floor(bio1) as bigint) as varchar) end, '}') as j from cells")
def jsn3(v):
    x = sc.finite(F.when(F.col("bio1") > 20, F.lit(float("nan"))).otherwise(F.floor("bio1").cast("double"))).cast("long")
    return v.cells.select("row", "col", F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"}).alias("j"))


@query("HSH1_sha256", "select doc_id, sha256(coalesce(text, '')) as digest from documents")
def hsh1(v):
    return v.documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("VIS1_colour_and_radius", "select country_code, round(least(18e0, 2.5e0 + 1.1e0 * sqrt(count(*))), 6) as radius, round(count(*) filter (range_label = 'introduced') * 1e0 / count(*), 6) as share from occ group by 1")
def vis1(v):
    n = v.occ.groupBy("country_code").agg(F.count("*").alias("n"), F.count_if(F.col("range_label") == "introduced").alias("i"))
    return n.select("country_code", F.round(F.least(F.lit(18.0), 2.5 + 1.1 * F.sqrt("n")), 6).alias("radius"), F.round(F.col("i") / F.col("n"), 6).alias("share"))


@query("SRC9_tile_cover", "select id, z, x, y from (select id, z, 180e0 / pow(2e0, z) as span, unnest(generate_series(cast(floor((west + 180e0) / (180e0 / pow(2e0, z))) as int), cast(ceil((east + 180e0) / (180e0 / pow(2e0, z))) as int) - 1)) as x, north, south from box_rows where west >= -180e0 and east <= 180e0 and west < east and south < north) t, lateral (select unnest(generate_series(cast(floor((90e0 - north) / span) as int), cast(ceil((90e0 - south) / span) as int) - 1)) as y) l")
def src9(v):
    inside = "west >= -180 AND east <= 180 AND west < east AND south < north"
    return tiles.tile_cover(v.box_rows.where(inside)).select("id", "z", "x", "y")


@query("SRC5_quadrants", """with f as materialized (select cast(floor((longitude + 180e0) / (360e0 / 32768e0)) as bigint) as fx, cast(floor((latitude + 90e0) / (180e0 / 32768e0)) as bigint) as fy, count(*) as m from occ group by all),
 c as materialized (select level, fx >> (15 - (level + 1) // 2) as bx, fy >> (15 - level // 2) as b_y, cast(sum(m) as bigint) as n from f cross join (select unnest(range(31)) as level) l group by all),
 p as materialized (select level + 1 as level, bx as px, b_y as py from c where n > 500)
 select round(bx * (360e0 / (1 << ((level + 1) // 2))) - 180e0, 6) as west, round(b_y * (180e0 / (1 << (level // 2))) - 90e0, 6) as south, round((bx + 1) * (360e0 / (1 << ((level + 1) // 2))) - 180e0, 6) as east, round((b_y + 1) * (180e0 / (1 << (level // 2))) - 90e0, 6) as north, n
 from c where (n <= 500 or level = 30) and (level = 0 or exists (select 1 from p where p.level = c.level and p.px = c.bx >> (c.level % 2) and p.py = c.b_y >> (1 - c.level % 2)))""")
def src5(v):
    return readers.quadrants(v.occ, 500).select(*[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")], "n")


def _scratch(v, name: str) -> str:
    ensure_checkpoint_dir(v.spark)
    import uuid

    return f"{v.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@query("SRC3_zipped_table", "select cast(n_nationkey as bigint) as n_nationkey, cast(n_regionkey as bigint) as n_regionkey, n_name from nation")
def src3(v):
    """A zipped tab-separated table, written here and read back by the reader."""
    rows = v.nation.select("n_nationkey", "n_regionkey", "n_name").collect()  # 25 rows
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("0001.csv", "n_nationkey\tn_regionkey\tn_name\n" + "".join(f"{r[0]}\t{r[1]}\t{r[2] or ''}\n" for r in rows))
    path = _scratch(v, "zip")
    local = path.removeprefix("file:")
    import os

    os.makedirs(local, exist_ok=True)
    with open(f"{local}/records.zip", "wb") as f:
        f.write(buffer.getvalue())
    d = readers.zipped_table(v.spark, path)
    return d.select(F.col("fields")["n_nationkey"].cast("long").alias("n_nationkey"), F.col("fields")["n_regionkey"].cast("long").alias("n_regionkey"), F.col("fields")["n_name"].alias("n_name"))


@query("SRC10_upload_reader", "select longitude, latitude, case when record_id % 2 = 1 then 'present' else 'absent' end as status from occ")
def src10(v):
    """A semicolon-separated survey with decimal commas, written here and read back by the reader."""
    path = _scratch(v, "upload")
    comma = lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    v.occ.select(comma("longitude").alias("Decimal Longitude"), comma("latitude").alias("Decimal Latitude"), (F.col("record_id") % 2).cast("string").alias("presence")).write.csv(path, sep=";", header=True)
    up = readers.read_upload(v.spark, path)
    c = readers.detect_columns(up)
    return up.select(readers.decimal(F.col(f"`{c['longitude']}`")).alias("longitude"), readers.decimal(F.col(f"`{c['latitude']}`")).alias("latitude"), readers.upload_status(F.col(f"`{c['status']}`")).alias("status"))


@query("SRC26_polygon_file", "select poly, status, 0 as ring, seq, x1, y1, x2, y2 from (values (0, 'confirmed'), (1, 'draft')) p(poly, status) cross join (values (0, -2e0, 30e0, 45e0, 30e0), (1, 45e0, 30e0, 45e0, 60e0), (2, 45e0, 60e0, -2e0, 60e0), (3, -2e0, 60e0, -2e0, 30e0)) e(seq, x1, y1, x2, y2)")
def src26(v):
    """A native range as GeoJSON, written here and read back as edges."""
    ring = [[-2.0, 30.0], [45.0, 30.0], [45.0, 60.0], [-2.0, 60.0], [-2.0, 30.0]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"status": "confirmed"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Feature", "properties": {"status": "draft"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring]]}}]}
    path = _scratch(v, "geojson")
    v.spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(path)
    return readers.geojson_edges(v.spark, path)


def tile_bytes(points: list[tuple[int, int, int]], layer: str = "occurrence", extent: int = 512) -> bytes:
    """A vector tile with one point feature for each ``(x, y, total)``."""

    def number(n: int) -> bytes:
        out = bytearray()
        while True:
            n, low = n >> 7, n & 127
            out.append(low | (128 if n else 0))
            if not n:
                return bytes(out)

    field = lambda no, body: number(no << 3 | 2) + number(len(body)) + body
    zig = lambda n: 2 * n if n >= 0 else -2 * n - 1
    body = field(1, layer.encode())
    for i, (x, y, _) in enumerate(points):
        body += field(2, field(2, number(0) + number(i)) + number(3 << 3) + number(1) + field(4, number(1 | 1 << 3) + number(zig(x)) + number(zig(y))))
    body += field(3, b"total") + b"".join(field(4, number(5 << 3) + number(t)) for _, _, t in points) + number(5 << 3) + number(extent)
    return field(3, body)


@query("SRC8_vector_tiles", "select cast(floor(px_col / 128e0) as int) as tx, cast(floor(px_row / 128e0) as int) as ty, px_col % 128 as x, px_row % 128 as y, cnt as total from eff")
def src8(v):
    """Effort pixels encoded as vector tiles, one tile to a group, and decoded by the table function."""
    import pandas as pd

    def encode(g: pd.DataFrame) -> pd.DataFrame:  # at most 128 x 128 pixels
        return pd.DataFrame({"tx": [g["tx"].iloc[0]], "ty": [g["ty"].iloc[0]], "data": [tile_bytes(list(zip(g["x"], g["y"], g["cnt"], strict=True)), extent=128)]})

    p = v.eff.select(F.floor(F.col("px_col") / 128.0).cast("int").alias("tx"), F.floor(F.col("px_row") / 128.0).cast("int").alias("ty"), (F.col("px_col") % 128).alias("x"), (F.col("px_row") % 128).alias("y"), "cnt")
    t = p.groupBy("tx", "ty").applyInPandas(encode, "tx int, ty int, data binary")
    return tiles.decode(t, "occurrence").select("tx", "ty", "x", "y", F.col("properties")["total"].cast("long").alias("total"))


@query("SRC4_paged_search", "select cast(n_nationkey as bigint) as n_nationkey from nation")
def src4(v):
    """Pages of a search as a batch data source (written here as files, read by offset)."""
    path = _scratch(v, "pages").removeprefix("file:")
    import os

    os.makedirs(path, exist_ok=True)
    ids = [r[0] for r in v.nation.select("n_nationkey").collect()]  # 25 rows
    for o in range(0, len(ids), 10):
        with open(f"{path}/{o}.json", "w") as f:
            json.dump({"results": [{"key": i} for i in ids[o : o + 10]]}, f)
    v.spark.dataSource.register(readers.PagedSource)
    d = v.spark.read.format("paged").option("url", f"file://{path}/{{offset}}.json").option("total", len(ids)).option("page", 10).load()
    return d.select(F.get_json_object("item", "$.key").cast("long").alias("n_nationkey"))
