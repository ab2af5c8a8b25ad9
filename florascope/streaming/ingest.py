"""Incremental processing: watermarked delta scans, de-duplicated micro-batches, retrain decisions and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from florascope.operators.spatial import nearest_km

from .state import first_deliveries, per_key, rocksdb

KEY = ["source", "record_id"]
MAX_ALERT_RECORDS = 500


def stream_occurrences(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a few files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, store: str, state: str, checkpoint: str):
    """Append only rows with new keys; one writer. Returns the query after it has read what is there.

    Which keys are known is the stream's own keyed state (see ``state``): a batch
    reads its own rows, never those stored before. Each batch writes its rows and
    its state row under its number, so that a batch that runs again after a
    failure replaces its own output; the keyed state of its first run is not
    committed then. The first row of a key is the earliest of its first batch.
    """
    spark = stream.sparkSession
    seen = first_deliveries(stream, KEY, "ingested_ts")

    def write(batch: DataFrame, number: int) -> None:
        batch = per_key(batch, KEY, "ingested_ts").persist()
        batch.where("_fresh").drop("_delivered", "_fresh", "_latest").write.mode("overwrite").parquet(f"{store}/batch={number}")
        per = batch.groupBy("source").agg(F.sum("_delivered").alias("attempted"), F.count_if("_fresh").alias("inserted"), F.max("_latest").alias("watermark"))
        per.select("source", "attempted", "watermark", "inserted").write.mode("overwrite").parquet(f"{state}/batch={number}")
        batch.unpersist()

    with rocksdb(spark):
        q = seen.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return q


def watermarks(spark: SparkSession, state: str) -> DataFrame:
    """The latest successful time of each source."""
    return spark.read.parquet(state).groupBy("source").agg(F.max("watermark").alias("watermark"), F.sum("inserted").alias("inserted"), F.sum("attempted").alias("attempted"))


def delta_since(occ: DataFrame, ts: str, since: Column | None) -> DataFrame:
    """Rows from the watermark's day on (the whole table without one)."""
    return occ if since is None else occ.where(F.col(ts) >= F.date_trunc("day", since))


def decision(previous: Column, new: Column, outside: Column, reviewed: Column, ratio: float = 0.05, most_outside: int = 10) -> Column:
    """What a delta leads to: a first full run, waiting for review, cached results, a minor update or a retrain."""
    return (
        F.when(previous == 0, "full").when(~reviewed, "awaiting_review").when(new == 0, "cached")
        .when((new / previous > ratio) | (outside >= most_outside), "retrain").otherwise("minor_update")
    )


def early_detections(new: DataFrame, known: DataFrame, native: Column, outside_envelope: Column, km: float = 100.0) -> DataFrame:
    """``record_id, kind``: records outside the envelope, and non-native ones far from all known records."""
    envelope = new.where(outside_envelope).select("record_id", F.lit("outside_envelope").alias("kind"))
    far = nearest_km(new.where(~native), known, ["record_id"]).where(F.col("km").isNull() | (F.col("km") > km)).select("record_id", F.lit("outside_known_range").alias("kind"))
    return envelope.unionAll(far)


def alerts(detections: DataFrame, most: int = MAX_ALERT_RECORDS) -> DataFrame:
    """``kind, n, records``: the number of detections of a kind and its first ``most`` record ids."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("kind").orderBy("record_id"))
    # the list is capped by definition of an alert, and limited in each task before the shuffle; the count is not
    listed = detections.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("kind").agg(F.array_sort(F.collect_list("record_id")).alias("records"))
    return detections.groupBy("kind").agg(F.count("*").alias("n")).join(listed, "kind")
