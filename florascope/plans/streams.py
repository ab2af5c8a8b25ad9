"""Queries of incremental processing."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from florascope.operators.session import ensure_checkpoint_dir
from florascope.streaming import ingest, state

from .catalog import query


def fresh():
    """Whether a row belongs to the delta since the last watermark."""
    return F.col("ingested_ts") >= F.lit("2024-01-27 00:00:00").cast("timestamp")


_ENV = "bio1 < 5e0 or bio1 > 26e0"


@query("STR4_retrain_decision", f"with d as (select o.taxon_key, o.ingested_ts >= timestamp '2024-01-27 00:00:00' as fresh, coalesce({_ENV}, false) as outside from occ_cells o left join cells c on c.row = o.row and c.col = o.col), n as (select taxon_key, count(*) filter (not fresh) as previous, count(*) filter (fresh) as new, count(*) filter (fresh and outside) as outside from d group by 1) select taxon_key, previous, new, outside, case when previous = 0 then 'full' when taxon_key % 5 = 3 then 'awaiting_review' when new = 0 then 'cached' when new * 1e0 / previous > 0.05e0 or outside >= 10 then 'retrain' else 'minor_update' end as decision from n")
def str4(v):
    out = F.coalesce((F.col("bio1") < 5.0) | (F.col("bio1") > 26.0), F.lit(False))
    d = v.occ_cells.join(v.cells.select("row", "col", "bio1"), ["row", "col"], "left").select("taxon_key", fresh().alias("fresh"), out.alias("o"))
    n = d.groupBy("taxon_key").agg(F.count_if(~F.col("fresh")).alias("previous"), F.count_if("fresh").alias("new"), F.count_if(F.col("fresh") & F.col("o")).alias("outside"))
    return n.withColumn("decision", ingest.decision(F.col("previous"), F.col("new"), F.col("outside"), F.col("taxon_key") % 5 != 3))


@query("STR5_effort_aware_trigger", f"select o.taxon_key, count(*) as outside from occ_cells o join cells c on c.row = o.row and c.col = o.col join (select distinct cast(floor(px_row / 2e0) as int) as row, cast(floor(px_col / 2e0) as int) as col from eff where cnt >= 20) e on e.row = o.row and e.col = o.col where o.ingested_ts >= timestamp '2024-01-27 00:00:00' and ({_ENV}) group by 1")
def str5(v):
    surveyed = v.eff.where("cnt >= 20").select(F.floor(F.col("px_row") / 2.0).cast("int").alias("row"), F.floor(F.col("px_col") / 2.0).cast("int").alias("col"))
    d = v.occ_cells.where(fresh()).join(v.cells.select("row", "col", "bio1"), ["row", "col"]).where((F.col("bio1") < 5.0) | (F.col("bio1") > 26.0))
    return d.join(surveyed, ["row", "col"], "left_semi").groupBy("taxon_key").agg(F.count("*").alias("outside"))


_HAV = "2e0 * 6371.0088e0 * asin(sqrt(pow(sin(radians(g.latitude - o.latitude) / 2e0), 2e0) + cos(radians(o.latitude)) * cos(radians(g.latitude)) * pow(sin(radians(g.longitude - o.longitude) / 2e0), 2e0)))"


@query("STR6_early_detections", f"""with n as (select o.*, c.bio1 from occ_cells o left join cells c on c.row = o.row and c.col = o.col where o.ingested_ts >= timestamp '2024-01-27 00:00:00'), k as (select * from occ where ingested_ts < timestamp '2024-01-27 00:00:00')
 select record_id, 'outside_envelope' as kind from n where {_ENV} union all select record_id, 'outside_known_range' from n o where range_label <> 'native' and not exists (select 1 from k g where abs(g.latitude - o.latitude) < 1.5e0 and {_HAV} <= 100e0)""")
def str6(v):
    new = v.occ_cells.where(fresh()).join(v.cells.select("row", "col", "bio1"), ["row", "col"], "left")
    return ingest.early_detections(new, v.occ.where(~fresh()), F.col("range_label") == "native", F.coalesce((F.col("bio1") < 5.0) | (F.col("bio1") > 26.0), F.lit(False)))


@query("STR6_alerts", f"""with n as (select o.record_id, c.bio1 from occ_cells o join cells c on c.row = o.row and c.col = o.col where o.ingested_ts >= timestamp '2024-01-27 00:00:00'), d as (select record_id, case when bio1 < 5e0 then 'cold' else 'hot' end as kind from n where {_ENV}), r as (select *, row_number() over (partition by kind order by record_id) as rn from d)
 select kind, count(*) as n, string_agg(record_id, ',' order by record_id) filter (rn <= 20) as records from r group by kind""")
def str6b(v):
    d = v.occ_cells.where(fresh()).join(v.cells.select("row", "col", "bio1"), ["row", "col"]).where((F.col("bio1") < 5.0) | (F.col("bio1") > 26.0))
    a = ingest.alerts(d.select("record_id", F.when(F.col("bio1") < 5.0, "cold").otherwise("hot").alias("kind")), 20)
    return a.select("kind", "n", F.array_join("records", ",").alias("records"))


def _root(v, name: str) -> str:
    ensure_checkpoint_dir(v.spark)
    return f"{v.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def _files(rows, most: int = 1_000_000) -> int:
    """By how much a delivery's files are multiplied, so that none holds many more than ``most`` rows; a batch takes that many times more of them."""
    return max(1, -(-rows.count() // most))


def _write_files(rows, files: int, key: str, path: str) -> None:
    """Appends exactly ``files`` files: a row of nulls in each, which a stream leaves out as it has no time, so that no file is empty and none of the next delivery gets into the batch."""
    part = F.pmod(F.xxhash64(key), F.lit(files)).cast("int")
    empty = rows.sparkSession.range(files).select(F.col("id").cast("int").alias("_file"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    rows.withColumn("_file", part).unionByName(empty).repartitionById(files, "_file").drop("_file").write.mode("append").parquet(path)


@query("STR_replayed_ingest", "select source, count(*) as inserted, count(*) * 2 as attempted from occ group by source")
def str_replay(v):
    """The store as a stream of files that are delivered twice: only the first delivery is new."""
    root = _root(v, "stream")
    rows = v.occ.select("source", "record_id", "longitude", "latitude", "ingested_ts")
    times = _files(rows, 2_000_000)
    for _ in range(2):
        rows.repartition(2 * times, "record_id").write.mode("append").parquet(f"{root}/in")
    ingest.ingest(ingest.stream_occurrences(v.spark, f"{root}/in", rows.schema, times), f"{root}/store", f"{root}/state", f"{root}/offsets")
    return ingest.watermarks(v.spark, f"{root}/state").select("source", F.col("inserted"), F.col("attempted"))


_DELIVERED = "select 0 as nth, source, record_id, ingested_ts from occ union all select 1, source, record_id, ingested_ts + interval 40 day from occ where record_id % 3 = 0 union all select 1, source, record_id + 100000000, ingested_ts + interval 41 day from occ where record_id % 5 = 0"


@query("STR7_restarted_stream", f"with d as ({_DELIVERED}), s as (select source, count(*) as attempted, count(distinct record_id) as inserted, max(ingested_ts) as watermark from d group by source) select s.source, attempted, inserted, watermark, sum(extract(epoch from f.first_ts)) as first_seconds from s join (select source, record_id, cast(min(ingested_ts) as timestamp(0)) as first_ts from d group by 1, 2) f on f.source = s.source group by all")
def str7b(v):
    """Two deliveries, the second after a restart: re-delivered rows change nothing, new ones are added, and old rows are not read again."""
    root = _root(v, "restart")
    first = v.occ.select("source", "record_id", "ingested_ts")
    moved = lambda d, days: d.withColumn("ingested_ts", (F.col("ingested_ts") + F.expr(f"INTERVAL {days} DAYS")).cast(first.schema["ingested_ts"].dataType))
    again = moved(first.where("record_id % 3 = 0"), 40).unionAll(moved(first.where("record_id % 5 = 0").withColumn("record_id", F.col("record_id") + 100000000), 41))
    times = _files(first, 3_000_000)
    for rows in (first, again):
        rows.repartition(3 * times, "record_id").write.mode("append").parquet(f"{root}/in")
        ingest.ingest(ingest.stream_occurrences(v.spark, f"{root}/in", first.schema, 2 * times), f"{root}/store", f"{root}/state", f"{root}/offsets")
    kept = v.spark.read.parquet(f"{root}/store").groupBy("source").agg(F.sum(F.unix_timestamp(F.round(F.col("ingested_ts").cast("timestamp").cast("double")).cast("timestamp"))).cast("double").alias("first_seconds"))
    return ingest.watermarks(v.spark, f"{root}/state").join(kept, "source").select("source", "attempted", "inserted", "watermark", "first_seconds")


_SILENCE = """with o as (select o_custkey, cast(o_orderdate as timestamp) as ts, o_orderkey, concat_ws('|', o_orderstatus, o_orderpriority) as payload from orders),
 l as (select *, lag(payload) over w as prev, lead(ts) over w as nxt, max(ts) over () as last from o window w as (partition by o_custkey order by ts, o_orderkey))"""


@query("STR10_streamed_changes", f"""{_SILENCE} select o_custkey, 'change' as kind, ts as at, o_orderkey as id, payload from l where prev is distinct from payload
 union all select o_custkey, 'keepalive', t, null, payload from (select *, unnest(generate_series(ts + interval 100 day, least(coalesce(nxt, last), ts + interval 400 day), interval 100 day)) as t from l) k where t < least(coalesce(nxt, last), ts + interval 400 day)
 union all select o_custkey, 'failed', ts + interval 400 day, null, payload from l where ts + interval 400 day < coalesce(nxt, last)""")
def str10b(v):
    """``orders`` replayed in time order: changes of a customer's payload, keepalives each 100 days of silence and a failure after 400."""
    root = _root(v, "changes")
    rows = v.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_orderpriority").where("o_orderdate IS NOT NULL").withColumn("part", F.year("o_orderdate"))
    years = {r["part"]: r["count"] for r in rows.groupBy("part").count().orderBy("part").collect()}
    files = max(1, -(-max(years.values(), default=0) // 1_000_000))
    for year in years:  # a file set for each year, delivered in order
        _write_files(rows.where(F.col("part") == year).drop("part"), files, "o_orderkey", f"{root}/in")
    stream = v.spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    # each partition of the state has a store and a Python worker in every batch: a few for each core, however many the session shuffles to
    with state.rocksdb(v.spark, 3 * v.spark.sparkContext.defaultParallelism):
        found = state.changes(stream, "o_custkey", "o_orderdate", "o_orderkey", F.concat_ws("|", "o_orderstatus", "o_orderpriority"), timedelta(days=100), timedelta(days=400), buckets=max(64, sum(years.values()) // 20_000))
        found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(f"{root}/out").select(F.col("key").cast("long").alias("o_custkey"), "kind", "at", "id", "payload")


#: Days of events that make a batch, and those by which every 50th event is late. A batch's rows are held against the
#: watermark by which the batch before it closed windows, and that one knows the times of all earlier batches but that.
_DAYS, _LATE = 5, 10
_BATCHED = f"""with e as (select *, cast(floor((epoch(ts) - epoch(timestamp '2024-01-01 00:00:00')) / 86400e0 / {_DAYS}e0) as int) + case when event_id % 50 = 7 then {_LATE // _DAYS} else 0 end as batch from events),
 b as (select batch, max(ts) as most from e group by batch),
 m as (select batch, coalesce(max(most) over (order by batch rows between unbounded preceding and 2 preceding), timestamp '1970-01-01 00:00:00') - interval 1 day as mark from b),
 d as (select e.*, mark from e join m using (batch))"""


def _streamed_events(v, name: str):
    """The events in files of five days each, shuffled within; every 50th comes ten days late, and a last row far ahead closes what is open."""
    root = _root(v, name)
    day = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 86400.0 / _DAYS).cast("int")
    rows = v.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    rows = rows.withColumn("part", day + F.when(F.col("event_id") % 50 == 7, _LATE // _DAYS).otherwise(0))
    for part in [r["part"] for r in rows.select("part").distinct().orderBy("part").collect()]:  # a row for each batch
        rows.where(F.col("part") == part).drop("part").orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(f"{root}/in")
    close = v.spark.sql("SELECT -1L AS event_id, timestamp'2100-01-01 00:00:00' AS ts, -1L AS user_id, 'end' AS event_type, 0D AS value")
    close.coalesce(1).write.mode("append").parquet(f"{root}/in")
    return root, v.spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def _collected(v, root: str, stream):
    with state.rocksdb(v.spark):
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("STR13_streamed_windows", f"{_BATCHED} select time_bucket(interval 6 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from d where time_bucket(interval 6 hour, ts) + interval 6 hour > mark group by 1, 2")
def str13d(v):
    """Six-hour windows of a watermarked stream: rows behind it are late and not in them."""
    root, stream = _streamed_events(v, "windows")
    w = state.windows(stream, "ts", "1 day", "6 hours", ["event_type"], {"n": F.count("*"), "total": F.sum("value")})
    return _collected(v, root, w).where("event_type <> 'end'").select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("STR13_late_rows", f"{_BATCHED} select event_type, count(*) as delivered, count(*) filter (time_bucket(interval 6 hour, ts) + interval 6 hour <= mark) as late from d group by 1")
def str13e(v):
    """Delivered rows less those in closed windows: the late ones of each type."""
    root, stream = _streamed_events(v, "late")
    w = state.windows(stream, "ts", "1 day", "6 hours", ["event_type"], {"n": F.count("*")})
    counted = _collected(v, root, w).groupBy("event_type").agg(F.sum("n").alias("in_windows"))
    delivered = v.spark.read.parquet(f"{root}/in").where("event_type <> 'end'").groupBy("event_type").agg(F.count("*").alias("delivered"))
    return delivered.join(counted, "event_type", "left").select("event_type", "delivered", (F.col("delivered") - F.coalesce("in_windows", F.lit(0))).alias("late"))


@query("STR13_streamed_sessions", f"""{_BATCHED}, k as (select * from d where ts + interval 2 hour > mark), g as (select user_id, ts, case when lag(ts) over w + interval 2 hour > ts then 0 else 1 end as fresh from k window w as (partition by user_id order by ts)),
 s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as sid from g) select user_id, min(ts) as session_start, count(*) as n from s group by user_id, sid""")
def str13f(v):
    """Sessions of a user with gaps under two hours, closed by the watermark; rows let in after that are joined to theirs."""
    root, stream = _streamed_events(v, "sessions")
    w = state.sessions(stream, "ts", "1 day", "2 hours", ["user_id"], {"n": F.count("*")})
    whole = state.joined_sessions(_collected(v, root, w).where("user_id >= 0"), ["user_id"], {"n": F.sum("n")})
    return whole.select("user_id", "session_start", "n")
