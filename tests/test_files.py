"""Readers and sinks."""

import hashlib
import json

from pyspark.sql import functions as F

from reachspark.sources import readers, sinks
from reachspark.streaming import batches


def test_timetable_file(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("﻿stop_id , stop_name\n001, A \n002,\n", encoding="utf-8")
    got = readers.timetable_file(spark, str(tmp_path / "stops.txt"), ["stop_id", "stop_name"], ["parent"]).collect()
    assert [tuple(r) for r in got] == [("001", "A", None), ("002", None, None)]


def test_records_of_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"records": [{"code": "12.0", "n": 3}]}))
    (tmp_path / "b.json").write_text(json.dumps({"features": [{"attributes": {"code": "7.0", "n": None}}]}))
    assert readers.records(spark, str(tmp_path / "a.json")).first().code == "12"
    assert readers.records(spark, str(tmp_path / "b.json")).first().code == "7"


def test_checked_and_directory(spark, tmp_path):
    (tmp_path / "c.csv").write_text("# by hand\nkey,checked_by,checked_on\n1,me,2024-01-01\n2,,2024-01-01\n3,me,\n")
    assert [r.key for r in readers.checked(spark, str(tmp_path / "c.csv")).collect()] == ["1"]
    (tmp_path / "d.csv").write_text("Māori,Name\n 5 , \n", encoding="utf-8")
    r = readers.directory(spark, str(tmp_path / "d.csv")).first()
    assert r.Maori == "5" and r.Name is None


def test_finished_runs_only(spark, tmp_path):
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "run_tag string, v int")
    sinks.by_partition(runs, str(tmp_path / "pairs"), "run_tag")
    runs.filter("run_tag = 'a'").select("run_tag").write.parquet(str(tmp_path / "manifest"))
    read = lambda tag: readers.finished(spark, str(tmp_path / "pairs"), str(tmp_path / "manifest"), tag)
    assert [r.v for r in read("a").collect()] == [1] and read("b") is None


def test_types_overrides_and_entrances(spark):
    rows = spark.createDataFrame([(1, "kindy", "x", 1.0, 2.0), (2, "other", "y", 3.0, 4.0)], "k int, kind string, name string, lon double, lat double")
    assert [r.service for r in readers.by_type(rows, {"ece": ["kindy"], "all": ["kindy", "creche"]}, "kind").collect()] == ["ece", "all"]
    table = spark.createDataFrame([(2, "name", "fixed")], "k int, field string, value string")
    assert {r.k: r.name for r in readers.overrides(rows, table, "k", ["name"]).collect()} == {1: "x", 2: "fixed"}
    doors = spark.createDataFrame([(1, 2, 9.0, 9.0), (1, 1, 8.0, 8.0)], "k int, pos int, lon double, lat double")
    assert sorted((r.k, r.pos, r.lon) for r in readers.entrances(rows, doors, "k").collect()) == [(1, 1, 8.0), (1, 2, 9.0), (2, 0, 3.0)]
    assert rows.filter(readers.within_box(F.col("lon"), F.col("lat"), (0, 0, 2, 3))).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.23456, [1, 2]), (1, float("nan"), [])], "k int, v double, l array<int>")
    sinks.csv(df, str(tmp_path / "csv"))
    assert {r.l for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()} == {"1|2", None}
    assert [r.c for r in df.select(sinks.clean(F.col("v"), 2).alias("c")).collect()] == [1.23, None]
    assert sinks.columnar(df, "k", ["k", "l"]).first().k == [1, 2]
    assert sinks.note_for("t_gp_walk", {"t_": "time", "t_gp": "doctor"}) == "doctor" and sinks.note_for("x", {}) is None
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a").write_bytes(b"abc")
    assert sinks.digest_of_files(spark, str(tmp_path / "f")).first().sha256 == hashlib.sha256(b"abc").hexdigest()


def test_batches_resume(spark, tmp_path):
    cells = batches.assign(spark.range(250).withColumnRenamed("id", "cell"), "cell", 100)
    path = str(tmp_path / "b")
    batches.write(cells, path)
    batches.write(cells.filter("batch = 1 and cell < 150"), path)
    assert spark.read.parquet(path).count() == 200
    manifest = spark.createDataFrame([(0, "s1"), (1, "s0")], "batch long, scope string")
    assert sorted(r.batch for r in batches.stale(cells.select("batch").distinct(), manifest, "s1").collect()) == [1, 2]


def test_many_batches_have_few_files_and_are_replaced_one_by_one(spark, tmp_path):
    path, done = f"file://{tmp_path}/v", lambda scope, *bs: spark.createDataFrame([(b, scope) for b in bs], "batch long, scope string")
    cells = batches.assign(spark.range(3000).withColumnRenamed("id", "cell"), "cell", 10).withColumn("run", F.lit(0))
    batches.add(cells, done("s0", *range(300)), path)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "v").rglob("*.parquet")}
    assert len([f for f in files if "rows" in f.parts]) <= cells.rdd.getNumPartitions()
    # of two batches that are worked off again one has fewer rows, the other none
    batches.add(cells.filter("batch = 1 and cell < 14").withColumn("run", F.lit(1)), done("s1", 1, 2), path)
    cells.withColumn("run", F.lit(2)).write.parquet(f"{path}/rows/version=2")  # stopped before its manifest
    read = lambda: sorted(tuple(r) for r in batches.current(spark, path, "cell long, batch long, run int").collect())
    kept = [(c, c // 10, 0) for c in range(3000) if c // 10 not in (1, 2)]
    assert read() == sorted([*kept, *[(c, 1, 1) for c in range(10, 14)]])
    assert {f: f.stat().st_mtime_ns for f in files} == files
    assert sorted(r.batch for r in batches.stale(cells.select("batch").distinct(), batches.manifest(spark, path), "s0").collect()) == [1, 2]
    batches.add(cells.filter("batch = 2"), done("s0", 2), path)  # takes the stopped one's place
    assert read() == sorted([*kept, *[(c, 1, 1) for c in range(10, 14)], *[(c, 2, 0) for c in range(20, 30)]])


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        sinks.by_partition(spark.range(200_000).selectExpr("id", "uuid() as u", "'walk' as tag"), f"{tmp_path}/p", "tag")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    back = spark.read.parquet(f"{tmp_path}/p")
    assert back.count() == 200_000 and len(back.inputFiles()) > 1
