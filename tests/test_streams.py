"""Keyed state: replays, restarts and crashes give the rows of one plain pass."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from florascope.plans import streams
from florascope.streaming import ingest, state

SCHEMA = "source string, record_id long, value string, ingested_ts timestamp"


@pytest.fixture
def root():
    return "file://" + tempfile.mkdtemp(prefix="spark-stream-")


def day(n, hour=0):
    return datetime(2024, 1, 1) + timedelta(days=n, hours=hour)


def deliver(spark, root, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")


def read(spark, root):
    ingest.ingest(ingest.stream_occurrences(spark, f"{root}/in", spark.createDataFrame([], SCHEMA).schema, 1), f"{root}/store", f"{root}/state", f"{root}/offsets")
    return sorted((r["source"], r["record_id"], r["value"]) for r in spark.read.parquet(f"{root}/store").collect())


def test_replays_and_restarts_change_nothing(spark, root):
    first = [("a", 1, "x", day(1)), ("a", 1, "earlier", day(0)), ("b", 1, "y", day(2)), ("b", None, "null id", day(2)), (None, 5, "null source", None)]
    deliver(spark, root, first)
    # of rows with one key in a batch the earliest stays
    want = [("a", 1, "earlier"), ("b", 1, "y"), ("b", None, "null id"), (None, 5, "null source")]
    key = lambda rows: sorted(rows, key=str)
    ingest.ingest(ingest.stream_occurrences(spark, f"{root}/in", spark.createDataFrame([], SCHEMA).schema, 1), f"{root}/store", f"{root}/state", f"{root}/offsets")
    got = lambda: key((r["source"], r["record_id"], r["value"]) for r in spark.read.parquet(f"{root}/store").collect())
    assert got() == key(want)
    # delivered again, after a restart and with an earlier time: known keys stay as they are
    deliver(spark, root, [("a", 1, "again", day(-5)), ("c", 9, "new", day(3)), *first])
    deliver(spark, root, [("c", 9, "newer", day(4)), ("a", 2, "z", day(4))])
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.stream_occurrences(spark, f"{root}/in", spark.createDataFrame([], SCHEMA).schema, 1), f"{root}/store", f"{root}/state", f"{root}/offsets")
        assert got() == key([*want, ("c", 9, "new"), ("a", 2, "z")])
    marks = {r["source"]: (r["attempted"], r["inserted"], r["watermark"]) for r in ingest.watermarks(spark, f"{root}/state").collect()}
    assert marks["a"] == (6, 2, day(4)) and marks["c"] == (2, 1, day(4)) and marks["b"][:2] == (4, 2) and marks[None] == (2, 1, None)


def test_a_batch_that_failed_runs_again(spark, root, monkeypatch):
    """A crash between a batch's rows and its offsets: the batch runs again on the state before it, and replaces its output."""
    deliver(spark, root, [("a", k, "x", day(1)) for k in range(5)])
    read(spark, root)
    deliver(spark, root, [("a", k, "y", day(2)) for k in range(3, 8)])
    schema = spark.createDataFrame([], SCHEMA).schema
    seen = state.first_deliveries(ingest.stream_occurrences(spark, f"{root}/in", schema, 1), ingest.KEY, "ingested_ts")

    def crash(batch, number):
        batch.where("_fresh").drop("_delivered", "_fresh", "_latest").write.mode("overwrite").parquet(f"{root}/store/batch={number}")
        raise OSError("lost")

    with state.rocksdb(spark):
        q = seen.writeStream.outputMode("update").foreachBatch(crash).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="lost"):
            q.awaitTermination()
    assert read(spark, root) == [("a", k, "x" if k < 5 else "y") for k in range(8)]
    assert ingest.watermarks(spark, f"{root}/state").first()["attempted"] == 10


def plain_changes(rows, keepalive, timeout, mark):
    """What a key's rows in event time give, up to the watermark ``mark``."""
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == key)
        last = None
        for k, (t, i, p) in enumerate(own):
            if p != last:
                out.append((key, "change", t, i, p))
            last = p
            until = own[k + 1][0] if k + 1 < len(own) else mark
            s = t + keepalive
            while s < min(until, t + timeout):
                out.append((key, "keepalive", s, None, p))
                s += keepalive
            if t + timeout < until:
                out.append((key, "failed", t + timeout, None, p))
    return sorted(out, key=str)


@pytest.mark.parametrize("cuts", [1, 4])
def test_changes_do_not_depend_on_batches_or_restarts(spark, root, cuts):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(6)}", day(rng.randrange(60), rng.randrange(24)), i, rng.choice("pq")) for i in range(60)] + [("quiet", day(0), 999, "p")]
    rows.sort(key=lambda r: (r[1], r[2]))
    schema = spark.createDataFrame([], "key string, ts timestamp, id long, payload string").schema
    size = -(-len(rows) // cuts)
    bounds = [0]
    while bounds[-1] < len(rows):  # rows of one time stay in one delivery
        end = min(len(rows), bounds[-1] + size)
        while end < len(rows) and rows[end][1] == rows[end - 1][1]:
            end += 1
        bounds.append(end)
    for a, b in zip(bounds, bounds[1:], strict=False):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        with state.rocksdb(spark):  # a restart after each delivery
            found = state.changes(stream, "key", "ts", "id", F.col("payload"), timedelta(days=3), timedelta(days=10), late="1 minute")
            found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(f"{root}/out").select("key", "kind", "at", "id", "payload").collect()), key=str)
    assert got == plain_changes(rows, timedelta(days=3), timedelta(days=10), rows[-1][1] - timedelta(minutes=1))
    assert {r[1] for r in got} == {"change", "keepalive", "failed"}


def test_changes_keep_the_state_of_many_keys_together(spark, root):
    """A Python call, a state value and a timer belong to a bucket of keys, not to each key; late rows, null ids and large ids stay what they are."""
    big = 2**60 + 1
    rows = [(f"k{i}", day(i % 5), big + i, "p") for i in range(400)] + [("k0", day(0), None, "q")]
    more = [("k0", day(0, 1), 5, "q"), ("k1", day(0, 23), 6, "late"), ("k2", day(30), 7, "q"), (None, day(30), 8, None)]
    schema = spark.createDataFrame([], "key string, ts timestamp, id long, payload string").schema
    for part in (rows, more):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    with state.rocksdb(spark, 2):
        found = state.changes(stream, "key", "ts", "id", F.col("payload"), timedelta(days=20), timedelta(days=50), late="10 days", buckets=8)
        q = found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress) <= 8 * 4  # with a state for each key: 401 and their timers
    got = {tuple(r) for r in spark.read.parquet(f"{root}/out").select("key", "kind", "at", "id", "payload").collect()}
    # the watermark ends at day 20: it has not passed it
    want = {(f"k{i}", "change", day(i % 5), big + i, "p") for i in range(400)} | {("k0", "change", day(0), None, "q"), ("k1", "late", day(0, 23), 6, "late"), ("k2", "keepalive", day(22), None, "p"), ("k2", "change", day(30), 7, "q"), ("", "change", day(30), 8, "")}
    assert got == want


def test_delivered_files_are_as_many_as_asked(spark, root):
    """Three rows in five files: a batch of five files is one delivery."""
    rows = spark.range(3).selectExpr("id", "timestamp'2024-01-01' ts")
    for _ in range(2):
        streams._write_files(rows, 5, "id", f"{root}/in")
    got = spark.read.parquet(f"{root}/in")
    assert got.select(F.input_file_name()).distinct().count() == 10 and got.where("ts IS NOT NULL").count() == 6


def test_first_deliveries_call_no_python_for_a_key(spark, root):
    """Known keys are the engine's own state; a batch is reduced to a row for each key by the engine, too."""
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = spark.range(6000).selectExpr("concat('s', id % 2) source", "id % 3000 record_id", "cast(id as string) value", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) ingested_ts")
    rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = state.first_deliveries(ingest.stream_occurrences(spark, f"{root}/in", schema, 1), ingest.KEY, "ingested_ts")
    assert "TransformWithState" not in stream._jdf.queryExecution().analyzed().toString()
    ingest.ingest(ingest.stream_occurrences(spark, f"{root}/in", schema, 1), f"{root}/store", f"{root}/state", f"{root}/offsets")
    assert sorted(int(r["value"]) for r in spark.read.parquet(f"{root}/store").collect()) == list(range(3000))
    assert {r["source"]: (r["attempted"], r["inserted"]) for r in ingest.watermarks(spark, f"{root}/state").collect()} == {"s0": (3000, 1500), "s1": (3000, 1500)}


def test_a_row_let_in_after_its_session_closed_joins_it(spark, root):
    """The third batch closes a session that ends at 12:00; the fourth brings a row of 11:30, whose own session would end after the watermark."""
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    for rows in ([(1, at(10))], [(2, at(13))], [(2, at(13, 30))], [(1, at(11, 30))], [(3, at(23))]):
        spark.createDataFrame(rows, "u long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema("u long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    w = state.sessions(stream, "ts", "1 hour", "2 hours", ["u"], {"n": F.count("*")})
    with state.rocksdb(spark):
        w.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    pieces = spark.read.schema(w.schema).parquet(f"{root}/out")
    assert pieces.where("u = 1").count() == 2
    whole = state.joined_sessions(pieces, ["u"], {"n": F.sum("n")}).select("u", "session_start", "session_end", "n")
    assert sorted(tuple(r) for r in whole.collect()) == [(1, at(10), at(13, 30), 2), (2, at(13), at(15, 30), 2)]
