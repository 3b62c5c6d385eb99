"""Stores and their versions, small tables beside a catalog, serials, and the incremental run."""

import json

import pytest
from pyspark.sql import functions as F

from stocktake.operators import alternates, snapshots, titles
from stocktake.sources import catalogs, inventories, stores, versions
from stocktake.streaming import incremental
from stocktake.streaming.incremental import follow


def test_reports_by_system(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = spark.createDataFrame([(1, "a", "correct"), (2, "b", "missing")], "system_id long, set_name string, status string")
    stores.save_report(rows, path)
    stores.save_report(spark.createDataFrame([(1, "a", "missing")], rows.schema), path)
    assert [r["status"] for r in stores.load_report(spark, path, 1).collect()] == ["missing"] and stores.load_report(spark, path, 2).count() == 1
    after = spark.createDataFrame([(1, "a", "correct"), (3, "c", "correct")], rows.schema)
    changes = snapshots.diff(rows, after, ["system_id", "set_name"])
    assert {r["system_id"]: r["action"] for r in changes.collect()} == {1: "same", 2: "delete", 3: "insert"}


def test_catalog_store_knows_its_source(spark, tmp_path):
    sets, source = spark.createDataFrame([("a",)], "set_name string"), {"size": 10, "mtime": 5, "mode": "split"}
    path = str(tmp_path / "catalog")
    assert stores.load_catalog(spark, path, ["sets"], source) is None
    stores.save_catalog({"sets": sets}, path, source)
    assert stores.load_catalog(spark, path, ["sets"], source)["sets"].count() == 1
    assert stores.load_catalog(spark, path, ["sets"], source | {"size": 11}) is None


def test_title_tables_and_export(spark, tmp_path):
    (tmp_path / "names.json").write_text(json.dumps({"0100000000010000": "Some Game™"}))
    (tmp_path / "versions.txt").write_text("id|rights|version\n0100000000010800|0|131072\nbad line\n")
    files = spark.createDataFrame([("x [0100000000010000][v0].nsp",), ("x [0100000000010800][v65536].nsp",), ("none.nsp",)], "file_name string")
    sets = titles.title_sets(files, catalogs.title_names(spark, str(tmp_path / "names.json")))
    assert [(r["set_name"], r["members"].count("|")) for r in sets.collect()] == [("Some Game", 1)]
    assert [r["newest"] for r in titles.missing_updates(files, catalogs.title_versions(spark, str(tmp_path / "versions.txt"))).collect()] == [131072]
    stores.title_catalog(sets, str(tmp_path / "xml"))
    again = catalogs.read_sets(spark, str(tmp_path / "xml"), "datafile")
    assert [r["set_name"] for r in again.collect()] == ["Some Game"] and catalogs.catalog_items(again).count() == 2


def test_fix_catalog_escapes(spark, tmp_path):
    items = spark.createDataFrame([("A & B", 0, 0, "x<1>", 3, "ff"), ("A & B", 0, 1, "y", 4, "ee")], "set_name string, set_ord long, item_ord long, item_name string, size long, md5 string")
    audit = spark.createDataFrame([("A & B", "x<1>", "missing"), ("A & B", "y", "correct")], "set_name string, item_name string, status string")
    catalogs.fix_catalog(audit, items, str(tmp_path / "fix"))
    back = catalogs.catalog_items(catalogs.read_sets(spark, str(tmp_path / "fix"), "datafile"))
    assert [(r["set_name"], r["item_name"], r["size"], r["md5"]) for r in back.collect()] == [("A & B", "x<1>", 3, "ff")]


def test_note_overrides(spark, tmp_path):
    rows = [{"family": "A", "platform": "p"}, {"family": " "}, {"family": "B", "platform": "q"}, {"family": "C", "reason": "x" * 20}]
    (tmp_path / "n.json").write_text(json.dumps(rows))
    good, issues = catalogs.note_overrides(spark, str(tmp_path / "n.json"), ["p"], longest=10)
    assert [r["family"] for r in good.collect()] == ["A"] and sorted(r["issue"] for r in issues.collect()) == ["no family", "text too long", "unknown platform"]


def test_serials_need_one_plain_set(spark):
    left = spark.createDataFrame([("/p", "e", "S1", 10), ("/q", "e", "S2", 10)], "path string, entry_name string, serial string, image_size long")
    sets = spark.createDataFrame([("A (Beta)", "S1", 10), ("A", "S1", 10), ("B", "S2", 1), ("C", "S2", 2)], "set_name string, serial string, image_size long")
    assert [(r["path"], r["set_name"]) for r in alternates.match_serials(left, sets).collect()] == [("/p", "A")]


def test_incremental_run_hashes_new_rows_once(spark, tmp_path):
    schema = "path string, entry_path string, size long, mtime timestamp, content string"
    row = lambda p, c: spark.sql(f"SELECT '{p}' AS path, CAST(NULL AS STRING) AS entry_path, CAST(1 AS BIGINT) AS size, TIMESTAMP '2024-01-01' AS mtime, '{c}' AS content")
    arrive, snapshot = str(tmp_path / "in"), str(tmp_path / "snapshot")
    finger = lambda df: inventories.fingerprints(df, hashes=("md5",)).drop("content")
    incremental.save_snapshot(finger(row("/a", "x")), snapshot, 16)
    for batch in (row("/a", "x"), row("/b", "y")):
        batch.write.mode("append").parquet(arrive)
    for _ in range(2):
        follow(spark, arrive, schema, snapshot, str(tmp_path / "checkpoint"), ("md5",), finger, 16).awaitTermination(60)
    got = incremental.load_snapshot(spark, snapshot)
    assert sorted(r["path"] for r in got.collect()) == ["/a", "/b"] and got.where(F.col("md5").isNull()).count() == 0


REPORT = "system_id long, set_name string, status string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_save_that_fails_leaves_the_report_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "report")
    old = [("a", "correct", 1), ("b", "missing", 2), ("c", "correct", None)]
    before = spark.createDataFrame([(s, n, t) for n, t, s in old], REPORT)
    stores.save_report(before, path)
    after = spark.createDataFrame([(1, "a", "missing"), (3, "d", "correct")], REPORT)
    changes = snapshots.diff(before, after, ["system_id", "set_name"])
    fails = after.withColumn("status", F.when(F.col("system_id") == 3, F.raise_error(F.lit("disk full"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="disk full"):
        stores.save_report(fails, path)
    assert rows_of(versions.load(spark, path, "system_id")) == sorted(old, key=str)
    monkeypatch.setattr(versions, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        snapshots.save_diff(changes, path, "system_id")
    assert rows_of(versions.load(spark, path, "system_id")) == sorted(old, key=str)
    monkeypatch.undo()
    snapshots.save_diff(changes, path, "system_id")
    assert rows_of(versions.load(spark, path, "system_id")) == sorted([("a", "missing", 1), ("d", "correct", 3)], key=str)
    assert rows_of(versions.load(spark, path, "system_id", version=1)) == sorted(old, key=str)
    stores.remove_system(spark, path, 1)
    assert rows_of(versions.load(spark, path, "system_id")) == [("d", "correct", 3)] and stores.load_report(spark, path, 1).count() == 0


def test_many_systems_make_few_folders(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = spark.range(0, 4000, 1, 8).select((F.col("id") % 1000).alias("system_id"), F.col("id").cast("string").alias("set_name"), F.lit("correct").alias("status"))
    rows = rows.unionByName(rows.limit(1).withColumns({"system_id": F.lit(None).cast("long"), "set_name": F.lit("none")}))
    stores.save_report(rows, path)
    assert len(list((tmp_path / "report").glob("data/run=*/*/*.parquet"))) <= 8 * versions.BUCKETS and len(list((tmp_path / "report").glob("data/run=*/*"))) <= versions.BUCKETS + 3
    one = stores.load_report(spark, path, 7)
    assert sorted(r["set_name"] for r in one.collect()) == ["1007", "2007", "3007", "7"]
    assert versions.load(spark, path, "system_id").count() == 4001
    assert "__bucket" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_runs_of_a_folder_for_each_partition_are_read(spark, tmp_path):
    path = str(tmp_path / "report")
    stores.save_report(spark.createDataFrame([(1, "a", "correct"), (2, "b", "correct")], REPORT), path)
    run = next((tmp_path / "report" / "data").glob("run=*"))
    spark.createDataFrame([(1, "a", "correct"), (2, "b", "correct")], REPORT).write.mode("overwrite").partitionBy("system_id").parquet(str(run))
    assert [r["set_name"] for r in stores.load_report(spark, path, 1).collect()] == ["a"]
    assert versions.load(spark, path, "system_id").count() == 2


def test_two_writers_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "report")
    stores.save_report(spark.createDataFrame([(1, "a", "correct")], REPORT), path)
    real, other = versions.publish, []

    def late(spark_, source, target):
        if not other:
            other.append(1)
            stores.save_report(spark.createDataFrame([(2, "b", "correct")], REPORT), path)
        return real(spark_, source, target)

    monkeypatch.setattr(versions, "publish", late)
    stores.save_report(spark.createDataFrame([(3, "c", "correct")], REPORT), path)
    assert [r[0] for r in rows_of(versions.load(spark, path, "system_id"))] == ["a", "b", "c"] and versions.last_version(spark, path) == 3
    versions.vacuum(spark, path, keep=1, older_than_s=-10)
    assert [r[0] for r in rows_of(versions.load(spark, path, "system_id"))] == ["a", "b", "c"] and versions.names_in(spark, f"{path}/manifest").count("000000000003") == 1
    assert versions.load(spark, str(tmp_path / "none"), "system_id") is None


def test_a_batch_reads_its_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    rows = spark.range(400).select(F.concat(F.lit("/p"), "id").alias("path"), F.lit(None).cast("string").alias("entry_path"), F.col("id").alias("size"), F.lit("2024-01-01").cast("timestamp").alias("mtime"), F.md5(F.col("id").cast("string")).alias("md5"))
    incremental.save_snapshot(rows, path, 32)
    batch = rows.where("size IN (3, 5)")
    wanted = {r[0] for r in incremental.with_bucket(batch, 32).select("bucket").collect()}
    got = incremental.load_snapshot(spark, path, batch, 32)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in got.inputFiles() if "bucket=" in f} >= wanted
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "IN (" in plan.split("PartitionFilters")[1][:200]
    assert {r[0] for r in incremental.with_bucket(got, 32).select("bucket").distinct().collect()} == wanted
    newer = rows.where("size < 100").withColumn("mtime", F.lit("2025-01-01").cast("timestamp")).withColumn("md5", F.lit("new"))
    incremental.save_snapshot(newer, path, 32)
    assert incremental.load_snapshot(spark, path).where("md5 = 'new'").count() == 100 and incremental.load_snapshot(spark, path).count() == 400
    assert versions.load(spark, path, "bucket").count() == 500
    assert len(incremental.compact(spark, path, 2)) > 0
    assert versions.load(spark, path, "bucket").count() == 400 and incremental.load_snapshot(spark, path).where("md5 = 'new'").count() == 100
    assert incremental.compact(spark, path, 2) == []
