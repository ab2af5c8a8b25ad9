"""Helpers shared by the training-data operators.

Intermediate tables are cut with Parquet files in the folder named by
``spark.checkpoint.dir``; that folder is shared by the driver and all
executors, so a lost executor never loses an intermediate result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows stay within this bound.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a local one only if none is set and everything runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        opt = spark.sparkContext._jsc.sc().getCheckpointDir()
        if opt.isDefined():
            root = opt.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later plan reads."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def broadcast_if_small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a counted size; beyond it Spark shuffles and AQE splits skew."""
    return F.broadcast(df) if rows <= bound else df


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, or with underscores behind it until no column in ``taken`` has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """64-bit digest of a text, to tell rows apart that share a (null) id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
