"""Queries at the edges: gazetteer pages, grid files, registries, webhooks and change streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from florascope.operators.session import ensure_checkpoint_dir

from .catalog import query


def _folder(v, name: str) -> str:
    ensure_checkpoint_dir(v.spark)
    return f"{v.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@query("SRC14_institutions", "select name, types, longitude, latitude from gaz where kind = 'institution' and longitude is not null and latitude is not null and abs(longitude) <= 180 and abs(latitude) <= 90")
def src14(v):
    ok = F.col("longitude").between(-180.0, 180.0) & F.col("latitude").between(-90.0, 90.0)
    return v.gaz.where((F.col("kind") == "institution") & ok).select("name", "types", "longitude", "latitude")


@query("SRC16_row_bands", "select cast(floor(row / 16e0) as int) as band, count(*) as n, min(row) as first_row, max(row) as last_row from cells group by 1")
def src16(v):
    bands = v.cells.repartitionByRange(8, "row")
    return bands.groupBy(F.floor(F.col("row") / 16.0).cast("int").alias("band")).agg(F.count("*").alias("n"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


@query("SNK8_grid_by_band", "select cast(floor(row / 16e0) as int) as band, row, col, suitability from cells where row between 32 and 63")
def snk8(v):
    """A grid written by row band; a window reads only its bands."""
    path = _folder(v, "grid")
    v.cells.withColumn("band", F.floor(F.col("row") / 16.0).cast("int")).select("band", "row", "col", "suitability").repartition("band").write.partitionBy("band").parquet(path)
    return v.spark.read.parquet(path).where("band BETWEEN 2 AND 3").select(F.col("band").cast("int").alias("band"), "row", "col", "suitability")


@query("SNK12_model_log", "select cast(o_custkey as bigint) as taxon_key, count(*) as n_runs, max(o_totalprice) as best from orders group by 1")
def snk12(v):
    """Runs logged as JSON lines and read back."""
    path = _folder(v, "runs")
    v.orders.select(F.to_json(F.struct(F.col("o_custkey").alias("taxon_key"), F.struct(F.col("o_totalprice").alias("score")).alias("metrics"))).alias("value")).write.text(path)
    runs = v.spark.read.schema("taxon_key long, metrics struct<score: double>").json(path)
    return runs.groupBy("taxon_key").agg(F.count("*").alias("n_runs"), F.max("metrics.score").alias("best"))


#: Address ranges that are not public, as first and last address of IPv4, and prefixes of IPv6.
CLOSED_V4 = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "255.255.255.255"),
]
CLOSED_V6 = "^(::|f[cdef]|2001:db8:|2002:|64:ff9b:|100:)"
def _number(a: str) -> int:
    return sum(int(x) << (24 - 8 * i) for i, x in enumerate(a.split(".")))


_FLT19 = f"""with u as (select url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) as scheme, lower(regexp_extract(url, '^[a-zA-Z]+://(\\[[^\\]]*\\]|[^/:?#]*)', 1)) as host from hook_rows),
 p as (select *, case when regexp_matches(host, '^([0-9]+\\.){{3}}[0-9]+$') then list_transform(string_split(host, '.'), lambda x: cast(x as bigint)) end as q from u),
 n as (select *, q[1] * 16777216 + q[2] * 65536 + q[3] * 256 + q[4] as a from p)
select url, scheme = 'https' and case when host like '[%' then not regexp_matches(host[2:-2], '{CLOSED_V6}') when q is not null then list_max(q) <= 255 and not ({' or '.join(f'a between {_number(x)} and {_number(y)}' for x, y in CLOSED_V4)})
 else regexp_matches(host, '[a-z]') and not regexp_matches(host, '(^|\\.)localhost\\.?$') end as allowed from n"""


@query("FLT19_webhook_targets", _FLT19.replace("\\\\", "\\"))
def flt19(v):
    """Only https to a name or a public address: loopback, private, link-local, reserved and multicast ones are closed."""
    u = v.hook_rows
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://(\[[^\]]*\]|[^/:?#]*)", 1))
    u = u.select("url", F.lower(F.regexp_extract("url", r"^([a-zA-Z]+)://", 1)).alias("scheme"), host.alias("host"))
    u = u.withColumn("q", F.when(F.col("host").rlike(r"^([0-9]+\.){3}[0-9]+$"), F.transform(F.split("host", r"\."), lambda x: x.cast("long"))))
    a = F.col("q")[0] * 16777216 + F.col("q")[1] * 65536 + F.col("q")[2] * 256 + F.col("q")[3]
    closed = F.lit(False)
    for x, y in CLOSED_V4:
        closed = closed | a.between(_number(x), _number(y))
    open_host = (
        F.when(F.col("host").startswith("["), ~F.expr("substring(host, 2, length(host) - 2)").rlike(CLOSED_V6))
        .when(F.col("q").isNotNull(), (F.array_max("q") <= 255) & ~closed)
        .otherwise(F.col("host").rlike("[a-z]") & ~F.col("host").rlike(r"(^|\.)localhost\.?$"))
    )
    return u.select("url", ((F.col("scheme") == "https") & open_host).alias("allowed"))


@query("STR10_change_stream", "select o_custkey, o_orderkey, o_orderstatus from (select *, lag(concat(o_orderstatus, '|', o_orderpriority)) over (partition by o_custkey order by o_orderdate, o_orderkey) as prev from orders) t where prev is distinct from concat(o_orderstatus, '|', o_orderpriority)")
def str10(v):
    payload = F.concat_ws("|", "o_orderstatus", "o_orderpriority")
    prev = F.lag(payload).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return v.orders.withColumn("prev", prev).where(~F.col("prev").eqNullSafe(payload)).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("STR12_available_now_sweep", "select event_type, count(*) as n from events group by 1")
def str12(v):
    """Everything that is there, once: a stream with an available-now trigger into a table."""
    root = _folder(v, "sweep")
    v.events.select("event_id", "event_type").repartition(3).write.parquet(f"{root}/in")
    s = v.spark.readStream.schema("event_id long, event_type string").parquet(f"{root}/in")
    s.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("n"))
