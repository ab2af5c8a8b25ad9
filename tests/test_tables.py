"""Commits to stored tables: every version readable, failures invisible, untouched files the same."""

import tempfile

import pytest
from pyspark.sql import functions as F

from florascope.sources.tables import Conflict, Tables


@pytest.fixture
def tables(spark):
    return Tables(spark, "file://" + tempfile.mkdtemp(prefix="spark-tables-"))


def rows(spark, given):
    return spark.createDataFrame(given, "taxon int, id long, a string, b double, ts int")


def content(df):
    return sorted(map(tuple, df.select("taxon", "id", "a", "b", "ts").collect()), key=str)


FIRST = [(1, 10, "x", None, 1), (1, 11, None, 2.0, 1), (2, 20, None, None, 1), (2, 21, "z", 4.0, 1)]


def test_each_version_is_read_back(spark, tables):
    assert tables.version() == 0
    assert tables.create("occ", rows(spark, FIRST), ["taxon", "id"], buckets=4) == 1
    # new keys come once, known ones only fill what is null
    assert tables.append_fill_once("occ", rows(spark, [(1, 10, "new", 5.0, 9), (1, 12, "n", 1.0, 2), (1, 12, "n", 1.0, 2)]), ["b"]) == 2
    assert tables.upsert("occ", rows(spark, [(2, 20, "late", 1.0, 2), (2, 21, "early", 9.0, 0), (3, 30, "q", None, 5)]), "ts") == 3
    assert tables.fill("occ", spark.createDataFrame([(1, 11, "f", 1.0), (1, 10, "g", 7.0), (9, 9, "h", 1.0)], "taxon int, id long, a string, b double"), ["a", "b"], "a") == 4
    second = [(1, 10, "x", 5.0, 1), (1, 11, None, 2.0, 1), (1, 12, "n", 1.0, 2), (2, 20, None, None, 1), (2, 21, "z", 4.0, 1)]
    third = [*second[:3], (2, 20, "late", 1.0, 2), (2, 21, "z", 4.0, 1), (3, 30, "q", None, 5)]
    fourth = [third[0], (1, 11, "f", 1.0, 1), *third[2:]]
    for version, want in ((1, FIRST), (2, second), (3, third), (4, fourth), (None, fourth)):
        assert content(tables.read("occ", version)) == sorted(want, key=str)


def test_untouched_partitions_keep_their_files(spark, tables):
    tables.create("occ", spark.range(200).select(F.lit(1).alias("taxon"), "id", F.lit("a").alias("a"), F.lit(1.0).alias("b"), F.lit(1).alias("ts")), ["taxon", "id"], buckets=16)
    before = tables.manifest()["occ"]["parts"]
    tables.upsert("occ", rows(spark, [(1, 7, "changed", 2.0, 5)]), "ts")
    after = tables.manifest()["occ"]["parts"]
    assert len(before) == 16 and sum(before[p] != after[p] for p in before) == 1
    assert tables.read("occ").count() == 200 and tables.read("occ").where("a = 'changed'").count() == 1


def test_a_failed_attempt_is_invisible(spark, tables, monkeypatch):
    tables.create("occ", rows(spark, FIRST), ["taxon", "id"], buckets=2)
    boom = F.raise_error(F.lit("lost"))
    with pytest.raises(Exception, match="lost"):
        tables.rewrite("occ", rows(spark, [(1, 10, "y", 1.0, 3)]), lambda old, new: old.withColumn("a", boom.cast("string")))
    assert tables.version() == 1 and content(tables.read("occ")) == sorted(FIRST, key=str)
    # the files are written and the manifest is not: a crash between the two
    monkeypatch.setattr(Tables, "_publish", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        tables.upsert("occ", rows(spark, [(1, 10, "y", 1.0, 3)]), "ts")
    monkeypatch.undo()
    assert tables.version() == 1 and content(tables.read("occ")) == sorted(FIRST, key=str)


def test_two_writers_of_one_version(spark, tables):
    tables.create("occ", rows(spark, FIRST), ["taxon", "id"])

    def meanwhile(old, new):
        tables.upsert("occ", rows(spark, [(5, 50, "other", 1.0, 1)]), "ts")
        return old.unionByName(new)

    with pytest.raises(Conflict):
        tables.rewrite("occ", rows(spark, [(6, 60, "mine", 1.0, 1)]), meanwhile)
    assert tables.version() == 2 and {r["a"] for r in tables.read("occ").where("taxon > 4").collect()} == {"other"}


def test_delete_cascades_in_one_commit(spark, tables):
    given = rows(spark, [*FIRST, (None, 1, "n", None, 1)])
    tables.create("occ", given, ["id"], by=["taxon"], buckets=2)
    tables.create("notes", given, ["id"], buckets=3)
    tables.create("species", spark.createDataFrame([("s", 1)], "name string, rank int"), ["name"])
    assert tables.delete("taxon", 1) == 4
    want = sorted([r for r in [*FIRST, (None, 1, "n", None, 1)] if r[0] != 1], key=str)
    assert content(tables.read("occ")) == want == content(tables.read("notes")) and tables.read("species").count() == 1
    assert tables.read("occ", 3).count() == 5 == tables.read("notes", 3).count()
    # an emptied table stays readable and takes rows again
    tables.delete("taxon", 2)
    assert tables.read("occ").where("taxon = 2").count() == 0
    tables.append_fill_once("occ", rows(spark, [(2, 22, "w", 1.0, 1)]), [])
    assert tables.read("occ").where("taxon = 2").count() == 1
