"""Files of several splits, each read by its own header."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from portrisk.sources import files

from .conftest import rows


@pytest.fixture()
def landed(tmp_path):
    """Files with differing column orders; one is large, some are broken or odd."""
    rng, want = random.Random(1), []
    orders = [["datetime", "precip", "windspeed", "humidity"], ["humidity", "name", "windspeed", "datetime", "precip"],
              ["PRECIP", "conditions", "datetime", "windspeed", "humidity"]]
    for n, (loc, size) in enumerate([("HOT one", 20000), ("B", 50), ("C", 1), ("D", 0)]):
        folder = tmp_path / f"loc_id={loc.replace(' ', '%20')}"
        folder.mkdir()
        order = orders[n % 3]
        lines = [",".join(order)]
        for k in range(size):
            r = {"datetime": f"2026-01-01 {k % 24:02d}:00:00", "precip": str(rng.randrange(900) / 10), "windspeed": str(k % 80),
                 "humidity": "" if k % 9 == 0 else "50.5", "name": f'"a, ""b"" {k}"', "conditions": "z"}
            lines.append(",".join(r[c.lower()] for c in order))
            want.append((loc, r["datetime"], float(r["precip"]), float(r["windspeed"]), None if k % 9 == 0 else 50.5))
        end = "\r\n" if n == 1 else "\n"
        (folder / "part.csv").write_bytes((("﻿" if n == 0 else "") + ("\n" if n == 1 else "") + end.join(lines) + end).encode())
    for loc, text in (("broken", "datetime,precip\n2026-01-01,1\n"), ("blank", "\n \n")):
        (tmp_path / f"loc_id={loc}").mkdir()
        (tmp_path / f"loc_id={loc}" / "x.csv").write_text(text)
    return str(tmp_path), sorted(want, key=str)


def test_one_file_is_read_by_several_tasks(spark, landed):
    path, want = landed
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "64KB"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = files.weather_lines(spark.read, path).filter("loc_id = 'HOT one'")
            if size == "64KB":
                assert lines.select("start").distinct().count() > 5 and lines.rdd.getNumPartitions() > 5
            got = files.read_weather_csv(spark, path)
            assert sorted([(r.loc_id, r.datetime, r.precip, r.windspeed, r.humidity) for r in got.collect()], key=str) == want
            bad = files.weather_rejects(files.weather_files(spark.read, path))
            assert rows(bad, "loc_id", "reason") == [
                ("blank", "missing columns: datetime, precip, windspeed, humidity"), ("broken", "missing columns: windspeed, humidity")]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_lines_with_too_few_fields_are_kept_apart(spark, tmp_path):
    (tmp_path / "loc_id=A").mkdir()
    (tmp_path / "loc_id=A" / "a.csv").write_text("datetime,precip,windspeed,humidity\nx,1,2,3\nx,1\nx,1,2,3,4\ndatetime,precip,windspeed,humidity\n")
    got = files.read_weather_csv(spark, str(tmp_path), quarantine=True)
    assert rows(got, "precip", files.CORRUPT) == [(1.0, "x,1"), (1.0, "x,1,2,3,4"), (1.0, None)]


def test_stream_replays_an_epoch_without_duplicates(spark, landed, scratch, monkeypatch):
    from portrisk.operators.ingest import normalize_weather
    from portrisk.streaming import streams
    path, want = landed
    out, ckpt = scratch("o"), scratch("c")
    append = streams._append_epoch

    def crash(rows_, at, epoch):
        append(rows_, at, epoch)
        raise RuntimeError("driver lost")  # before the checkpoint has the epoch
    monkeypatch.setattr(streams, "_append_epoch", crash)
    with pytest.raises(Exception, match="driver lost"):
        streams.weather_stream(spark, path, out, ckpt, max_files=2).awaitTermination()
    monkeypatch.setattr(streams, "_append_epoch", append)
    streams.weather_stream(spark, path, out, ckpt, max_files=2).awaitTermination()
    got = spark.read.parquet(out)
    batch = normalize_weather(files.read_weather_csv(spark, path))
    assert got.count() == len(want) and got.exceptAll(batch.select(*got.columns)).count() == 0


def test_folders_of_a_landing_are_listed_in_few_tasks(spark, scratch):
    path = scratch("many-locations")
    rows = spark.range(150).selectExpr("cast(id as string) loc_id", "'2024-01-01 00:00:00' datetime", "1.0 precip",
                                       "2.0 windspeed", "3.0 humidity")
    files.write_weather_csv(rows, path)
    sc = spark.sparkContext
    sc.setJobGroup("landing-listed", "listing")
    try:
        assert files.read_weather_csv(spark, path).count() == 150
        tracker = sc.statusTracker()
        info = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("landing-listed") for s in tracker.getJobInfo(j).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    listed = [i.numTasks for i in info if i is not None and i.name.startswith("text at")]
    assert listed and max(listed) <= 64


def test_files_of_many_locations_name_them_in_a_column(spark, tmp_path):
    (tmp_path / "loc_id=7").mkdir()
    (tmp_path / "loc_id=7" / "a.csv").write_text("loc_id,datetime,precip,windspeed,humidity\n9,x,1,2,3\n")  # its folder decides
    (tmp_path / "b.csv").write_text('datetime,LOC_ID,precip,windspeed,humidity\ny,"a, ""b""",1,2,3\nz,,1,2,3\n')
    (tmp_path / "c.csv").write_text("datetime,precip,windspeed,humidity\nw,1,2,3\n")  # names no location
    got = files.read_weather_csv(spark, str(tmp_path), quarantine=True)
    assert rows(got, "datetime", "loc_id", files.CORRUPT) == [("w", "", None), ("x", "7", None), ("y", 'a, "b"', None), ("z", None, None)]


def test_the_cycles_weather_files_follow_readings_and_not_locations(spark, scratch, monkeypatch):
    from portrisk.plans import catalog
    from tests.conftest import SF_SMALL
    made = {}
    monkeypatch.setattr(catalog, "scratch_path", lambda s, name: made.setdefault(name, scratch(name)))
    got = catalog.q_run_cycle(spark, SF_SMALL).filter("table_name = 'fato_clima'")
    readings = catalog.SI.table(spark, SF_SMALL, "events")
    assert got.count() == readings.count() > 0
    assert rows(got.select("key").distinct()) == rows(readings.selectExpr("cast(user_id as string)").distinct())
    landed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(made["landing-cycle"] + "/weather")
    few, files_ = catalog._land_parts(spark), landed.count()
    assert files_ <= few < readings.select("user_id").distinct().count()
    path = scratch("bounded")
    files.write_weather_exports(readings.selectExpr("'a' loc_id", "'x' datetime").coalesce(1), path, readings.count() // 2 + 1)
    assert spark.read.format("binaryFile").load(path).count() == 2


def test_the_streams_weather_files_follow_readings_and_not_locations(spark, scratch, monkeypatch):
    from portrisk.plans import catalog
    from tests.conftest import SF_SMALL
    batch = catalog.q_weather_csv_roundtrip(spark, SF_SMALL)
    want, made = rows(batch), {}
    monkeypatch.setattr(catalog, "scratch_path", lambda s, name: made.setdefault(name, scratch(name)))
    monkeypatch.setattr(catalog, "FILE_ROWS", 40)
    monkeypatch.setattr(catalog, "STREAM_FILES", 5)
    got = catalog.q_stream_weather(spark, SF_SMALL)
    assert rows(got.select(*batch.columns)) == want and want
    landed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(made["landing-weather"])
    paths = [r.path for r in landed.select("path").collect()]
    assert not any("loc_id=" in p for p in paths)  # a folder a location
    lines = spark.read.text(made["landing-weather"], recursiveFileLookup=True).groupBy(F.input_file_name()).count()
    assert lines.agg(F.max("count")).first()[0] <= 41  # with its header
    batches = spark.read.format("binaryFile").load(made["ckpt-weather"] + "/commits").filter("not path like '%.crc'")
    assert -(-len(paths) // 5) <= batches.count() <= len(paths) // 5 + 3  # three landings of five files a micro-batch
