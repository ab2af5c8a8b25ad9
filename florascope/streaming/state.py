"""Keyed state for streams: first deliveries, changes with timers, and windows with a watermark.

State lives in RocksDB on the executors and is snapshotted with the stream's
checkpoint, so a restart goes on where the last finished batch ended. What a
batch reads is its own rows and the state of their keys, never the store.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, in at most ``partitions`` of them if they are new; the session's settings are put back."""
    set_ = {_PROVIDER: _ROCKS}
    if partitions is not None:
        set_[_PARTITIONS] = str(min(partitions, int(spark.conf.get(_PARTITIONS))))
    before = {k: spark.conf.get(k) for k in set_}
    try:
        for k, value in set_.items():
            spark.conf.set(k, value)
        yield
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


def first_deliveries(stream: DataFrame, key: list[str], time: str) -> DataFrame:
    """Each row with ``_delivered`` 1 and its ``_latest`` time, and for each key that no earlier batch had one more row, ``_fresh`` and with ``_delivered`` 0.

    Null keys are keys like others. Which keys were there is a keyed state that
    holds nothing but the keys. ``per_key`` of a batch makes one row for each key.
    """
    seen = stream.dropDuplicates(key)  # the engine's own state
    mark = lambda d, n, fresh, latest: d.select(*stream.columns, F.lit(n).cast("long").alias("_delivered"), F.lit(fresh).alias("_fresh"), latest.cast(stream.schema[time].dataType).alias("_latest"))
    return mark(stream, 1, False, F.col(time)).unionAll(mark(seen, 0, True, F.lit(None)))


def per_key(batch: DataFrame, key: list[str], time: str) -> DataFrame:
    """A batch of ``first_deliveries`` with a row for each key: its first by ``time``, how many there were, whether the key is new, and the latest time.

    Of equally early rows the one with the smallest digest is the first; rows
    without a time come last.
    """
    columns = [c for c in batch.columns if c not in ("_delivered", "_fresh", "_latest")]
    rest = [c for c in columns if c not in key]
    # the row that says a key is new is a copy of one that was delivered
    first = F.min(F.struct(F.col(time).isNull().alias("late"), F.col(time).alias("at"), F.xxhash64(*sorted(columns)).alias("digest"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]))
    found = batch.groupBy(*key).agg(first.alias("_row"), F.sum("_delivered").alias("_delivered"), F.max("_fresh").alias("_fresh"), F.max("_latest").alias("_latest"))
    at = {c: f"_row.c{i}" for i, c in enumerate(rest)}
    return found.select(*[F.col(at.get(c, c)).alias(c) for c in columns], "_delivered", "_fresh", "_latest")


class Changes(StatefulProcessor):
    """A row when a key's payload changes, a keepalive while nothing comes, a failure when it stays silent.

    Rows of a key are taken in event time; one before the latest is late: it is
    reported as such and changes nothing. Keepalives fall every ``keepalive``
    milliseconds after a key's latest row and stop at ``timeout``, where it
    fails; a later row takes it up again. What fell due before a row is emitted
    ahead of it, whether or not the watermark has reached it yet, so the output
    does not depend on how rows are cut into batches.

    A group is a bucket of keys: its state is one Arrow table with a row for each
    key, its timer the earliest of theirs, and all its keys are advanced at once.
    A row of the output tells what fell due between two rows of a key (see ``changes``).
    """

    STATE = ["key", "ms", "payload", "emitted", "failed"]

    def __init__(self, keepalive: int, timeout: int) -> None:
        self.keepalive, self.timeout = keepalive, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getValueState("keys", "latest binary")

    def _known(self) -> pd.DataFrame:
        if not self.keys.exists():
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in zip(self.STATE, ("object", "int64", "object", "int64", "bool"), strict=True)})
        with pa.ipc.open_stream(self.keys.get()[0]) as table:
            return table.read_pandas()

    def _remember(self, known: pd.DataFrame) -> None:
        """Stores the latest rows of the keys and sets the timer for what is due first."""
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(known, preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.keys.update((sink.getvalue().to_pybytes(),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        alive = known[~known["failed"]]
        if len(alive):
            self.handle.registerTimer(int(np.minimum(self._next(alive["ms"], alive["emitted"]), alive["ms"] + self.timeout).min()))

    def _next(self, at: pd.Series, emitted: pd.Series) -> pd.Series:
        """The first keepalive after ``emitted`` for keys silent since ``at``, were there no timeout."""
        return at + ((emitted - at) // self.keepalive + 1) * self.keepalive

    def _advance(self, known: pd.DataFrame, rows: pd.DataFrame, mark: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The keys after ``rows`` and up to the watermark ``mark``, and what is to be emitted."""
        behind = rows["ms"] < rows["key"].map(known.set_index("key")["ms"])  # false for new keys
        late, rows = rows[behind], rows[~behind]
        parts = [known.assign(id=0, no_id=False, fresh=False), rows.assign(emitted=rows["ms"], failed=False, fresh=True)]
        d = pd.concat([p for p in parts if len(p)], ignore_index=True)
        # keys in any order, of a key the known row first; a sort of numbers
        code, payload = pd.factorize(d["key"])[0], pd.factorize(d["payload"], sort=True)[0]
        order = np.lexsort((payload, d["id"], d["no_id"], d["ms"], d["fresh"], code))
        d, code, payload = d.take(order).reset_index(drop=True), code[order], payload[order]
        same = np.append(False, code[1:] == code[:-1])  # key as in the row before
        last = np.append(~same[1:], True)
        changed = d["fresh"] & ~(same & np.append(False, payload[1:] == payload[:-1]))
        until, end = np.where(last, mark, np.append(d["ms"].to_numpy()[1:], mark)), d["ms"] + self.timeout
        first = self._next(d["ms"], d["emitted"])
        alive = ~d["failed"]
        n = (-((first - np.minimum(until, end)) // self.keepalive)).clip(lower=0) * alive
        fails = alive & (end < until)
        latest = d.assign(emitted=np.where(fails, end, np.where(n > 0, first + (n - 1) * self.keepalive, d["emitted"])), failed=d["failed"] | fails)
        out = d.assign(kind=np.where(changed, "change", None), first=first, n=n, fails=fails)[changed | (n > 0) | fails]
        late = late.assign(kind="late", first=0, n=0, fails=False)
        return latest.loc[last, self.STATE], pd.concat([f[OUT] for f in (late, out) if len(f)] or [out[OUT]])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        # one bucket's rows of one batch
        batch = pd.concat([r[["key", "ms", "id", "no_id", "payload"]] for r in rows], ignore_index=True)
        known, out = self._advance(self._known(), batch, timerValues.getCurrentWatermarkInMs())
        self._remember(known)
        if len(out):
            yield out

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        none = pd.DataFrame({"key": [], "ms": np.zeros(0, "int64"), "id": np.zeros(0, "int64"), "no_id": np.zeros(0, "bool"), "payload": []})
        known, out = self._advance(self._known(), none, timerValues.getCurrentWatermarkInMs())
        self._remember(known)
        if len(out):
            yield out

    def close(self) -> None:
        pass


#: What ``Changes`` emits: a row of a key if ``kind`` tells what it is, then ``n`` keepalives from ``first`` on and whether the key fails.
_OUT = "key string, kind string, ms long, id long, no_id boolean, payload string, first long, n long, fails boolean"
OUT = [c.split()[0] for c in _OUT.split(", ")]


def changes(stream: DataFrame, key: str, ts: str, id_col: str, payload: Column, keepalive: timedelta, timeout: timedelta, late: str = "1 hour", buckets: int = 64) -> DataFrame:
    """``key, kind, at, id, payload``: changes, keepalives, failures and late rows of a stream (see ``Changes``). Null keys and payloads are empty texts; rows without a time are left out.

    Keys share their state in ``buckets``, each held by a task as a whole: some
    thousands of keys make a good one. A restart must keep their number.
    """
    when = F.col(ts).cast("timestamp")
    rows = stream.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), when.alias("ts"), F.unix_millis(when).alias("ms"), F.col(id_col).cast("long").alias("id"), F.coalesce(payload, F.lit("")).alias("payload"))
    rows = rows.withColumns({"bucket": F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"), "no_id": F.col("id").isNull(), "id": F.coalesce("id", F.lit(0))})
    step, end = (int(d / timedelta(milliseconds=1)) for d in (keepalive, timeout))
    found = rows.where("ts IS NOT NULL").withWatermark("ts", late).groupBy("bucket").transformWithStateInPandas(Changes(step, end), _OUT, "Append", "EventTime")
    # the rows of the key's silence are made here, not in Python
    row = lambda kind, ms, id_: F.struct(kind.alias("kind"), F.timestamp_millis(ms).alias("at"), id_.cast("long").alias("id"))
    own = F.when(F.col("kind").isNotNull(), row(F.col("kind"), F.col("ms"), F.when(~F.col("no_id"), F.col("id"))))
    failed = F.when(F.col("fails"), row(F.lit("failed"), F.col("ms") + end, F.lit(None)))
    nth = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n")), lambda i: i < F.col("n"))
    keeps = F.transform(nth, lambda i: row(F.lit("keepalive"), F.col("first") + i * step, F.lit(None)))
    return found.select("key", F.explode(F.concat(F.array_compact(F.array(own, failed)), keeps)).alias("r"), "payload").select("key", "r.kind", "r.at", "r.id", "payload")


def windows(stream: DataFrame, ts: str, late: str, length: str, by: list[str], totals: dict[str, Column]) -> DataFrame:
    """Closed windows of a stream (append mode): rows behind the watermark by more than their window are late and not counted."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), *by).agg(*[c.alias(n) for n, c in totals.items()])
    return w.select(F.col("w.start").alias("window_start"), *by, *totals)


def sessions(stream: DataFrame, ts: str, late: str, gap: str, by: list[str], totals: dict[str, Column]) -> DataFrame:
    """Closed sessions of a stream: rows of one key less than ``gap`` apart.

    A row that the watermark still lets in can belong to a session that it has
    already closed, and makes one of its own then; ``joined_sessions`` puts such
    pieces together.
    """
    w = stream.withWatermark(ts, late).groupBy(*by, F.session_window(ts, gap).alias("w")).agg(*[c.alias(n) for n, c in totals.items()])
    return w.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *totals)


def joined_sessions(pieces: DataFrame, by: list[str], totals: dict[str, Column]) -> DataFrame:
    """What a stream of ``sessions`` has written, with pieces of a key that overlap as one session; ``totals`` are aggregates of the pieces' totals."""
    before = Window.partitionBy(*by).orderBy("session_start", "session_end")
    reach = F.max("session_end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    numbered = pieces.withColumn("_new", F.when(reach > F.col("session_start"), 0).otherwise(1)).withColumn("_nth", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*by, "_nth").agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), *[c.alias(n) for n, c in totals.items()])
    return out.drop("_nth")
