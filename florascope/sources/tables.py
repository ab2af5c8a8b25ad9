"""Stored tables that change by commits: Parquet partitions under a versioned manifest.

A commit writes new files for the partitions that it touches and then one small
manifest, which names the folder of every partition of every table. The manifest
is created under the next version's name and only if no one has created that:
before, the commit is invisible; after, it is whole, over all tables. Older
versions keep their files, so each can be read. Partitions that a commit does
not touch are not rewritten.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from florascope.operators.store import first_per_key

#: Column that names a row's partition in the files; never returned.
PART = "_part"


class Conflict(RuntimeError):
    """Another writer has committed the version that this commit was made for."""


class Tables:
    """Tables in one folder, on any file system that Spark reads; one commit changes several at once."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        folder = self._path(f"{self.root}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``{table: {schema, key, by, buckets, parts: {partition: folder}}}`` of a version."""
        version = self.version() if version is None else version
        if version == 0:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        """Make a version visible, whole or not at all: a finished file is renamed to a name that must be free."""
        target, draft = (self._path(f"{self.root}/manifests/{n}") for n in (f"{version:012d}.json", f"{uuid.uuid4().hex}.draft"))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # the rename of a file context, unlike that of some file systems, never replaces
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        option = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.java.lang.Enum.valueOf(option, "NONE")
        try:
            context.rename(draft, target, none)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or self._fs.exists(target):
                raise Conflict(f"version {version} exists") from e
            raise

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the latest by default)."""
        return self._rows(self.manifest(version)[table]).drop(PART, "_commit")

    def _rows(self, entry: dict, parts: list[str] | None = None) -> DataFrame:
        folders = sorted({f for p, f in entry["parts"].items() if parts is None or p in parts})
        schema = StructType.fromJson(entry["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn(PART, F.lit(""))
        # a folder holds what one commit wrote of one partition
        return self.spark.read.schema(StructType([*schema.fields]).add("_commit", "string").add(PART, "string")).option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/{f}" for f in folders])

    @staticmethod
    def _part(entry: dict) -> Column:
        bucket = F.pmod(F.xxhash64(*entry["key"]), F.lit(entry["buckets"])).cast("string")
        return F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in entry["by"]], bucket)

    def _write(self, entry: dict, rows: DataFrame) -> dict[str, str]:
        """Files of a commit, by partition: the commit's own folder, so an attempt that fails is never read."""
        commit = uuid.uuid4().hex
        # rows of a partition come together first, so that a task does not open a file for each
        rows.withColumn(PART, self._part(entry)).repartition(PART).write.partitionBy(PART).parquet(f"{self.root}/data/_commit={commit}")
        written = self._fs.listStatus(self._path(f"{self.root}/data/_commit={commit}"))
        names = [f.getPath().getName() for f in written if f.isDirectory()]
        return {n.split("=", 1)[1]: f"_commit={commit}/{n}" for n in names}

    def commit(self, change: Callable[[dict], dict]) -> int:
        """Publish ``change(manifest)`` as the next version and return its number."""
        version = self.version()
        self._publish(version + 1, change(self.manifest(version)))
        return version + 1

    def create(self, table: str, rows: DataFrame, key: list[str], by: list[str] = (), buckets: int = 8) -> int:
        """A new table; its partitions are the values of ``by`` and hash buckets of ``key``."""

        def change(m: dict) -> dict:
            if table in m:
                raise ValueError(f"{table} exists")
            entry = {"schema": json.loads(rows.schema.json()), "key": list(key), "by": list(by), "buckets": buckets, "parts": {}}
            return m | {table: entry | {"parts": self._write(entry, rows)}}

        return self.commit(change)

    def rewrite(self, table: str, changed: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Replace the partitions that rows of ``changed`` fall into by ``merge(old rows there, changed)``; others stay as they are.

        ``merge`` may only change rows within the partitions it is given.
        """

        def apply(m: dict) -> dict:
            entry = m[table]
            # partition names only: a number of them fixed by the table's layout
            touched = [r[0] for r in changed.select(self._part(entry)).distinct().collect()]
            old = self._rows(entry, touched).drop(PART, "_commit")
            kept = {p: f for p, f in entry["parts"].items() if p not in touched}
            return m | {table: entry | {"parts": kept | (self._write(entry, merge(old, changed).select(*old.columns)) if touched else {})}}

        return self.commit(apply)

    def append_fill_once(self, table: str, new: DataFrame, fill: list[str]) -> int:
        """New keys are added (of rows with one key the first by digest); of known ones only ``fill`` columns that are null take a value."""
        key = self.manifest()[table]["key"]

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            fresh = first_per_key(new.select(*old.columns), key, [F.xxhash64(*sorted(old.columns))]).select(*key, *[F.col(c).alias(f"_{c}") for c in old.columns if c not in key], F.lit(1).alias("_new"))
            j = old.withColumn("_old", F.lit(1)).join(fresh, key, "full_outer")
            return j.select(*[c if c in key else (F.coalesce(c, f"_{c}") if c in fill else F.when(F.col("_old").isNull(), F.col(f"_{c}")).otherwise(F.col(c))).alias(c) for c in old.columns])

        return self.rewrite(table, new, merge)

    def upsert(self, table: str, new: DataFrame, order: str) -> int:
        """The last write of a key by ``order``; on equal ones the new row wins."""
        key = self.manifest()[table]["key"]

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
            return first_per_key(both, key, [F.desc_nulls_last(order), F.desc("_new"), F.xxhash64(*sorted(old.columns))]).drop("_new")

        return self.rewrite(table, new, merge)

    def fill(self, table: str, values: DataFrame, columns: list[str], guard: str) -> int:
        """``columns`` from ``values`` on known keys whose ``guard`` is null."""
        key = self.manifest()[table]["key"]

        def merge(old: DataFrame, values: DataFrame) -> DataFrame:
            given = first_per_key(values, key, [F.xxhash64(*sorted(columns))]).select(*key, F.lit(True).alias("_given"), *[F.col(c).alias(f"_{c}") for c in columns])
            open_ = F.col(guard).isNull() & F.coalesce("_given", F.lit(False))
            return old.join(given, key, "left").select(*[F.when(open_, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in old.columns])

        return self.rewrite(table, values, merge)

    def delete(self, column: str, value: object) -> int:
        """Rows with ``column = value`` go from every table that has the column, in one commit; tables partitioned by it lose whole folders, unread."""

        def change(m: dict) -> dict:
            out = {}
            for table, entry in m.items():
                parts = entry["parts"]
                if column in entry["by"]:
                    at, width = entry["by"].index(column), len(entry["by"])
                    out[table] = entry | {"parts": {p: f for p, f in parts.items() if p.rsplit("-", 1)[0].split("-", width - 1)[at] != str(value)}}
                elif column in [f["name"] for f in entry["schema"]["fields"]]:
                    hit = F.coalesce(F.col(column) == F.lit(value), F.lit(False))
                    touched = [r[0] for r in self._rows(entry).where(hit).select(PART).distinct().collect()]
                    kept = {p: f for p, f in parts.items() if p not in touched}
                    left = self._rows(entry, touched).drop(PART, "_commit").where(~hit)
                    out[table] = entry | {"parts": kept | (self._write(entry, left) if touched else {})}
                else:
                    out[table] = entry
            return out

        return self.commit(change)
