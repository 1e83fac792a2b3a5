"""Coverage from names of folders, one clock in all session zones, loads into a database."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import labels as lb
from tidemark.operators.features import build_gold
from tidemark.operators.star import time_dim
from tidemark.plans import jobs
from tidemark.sources import bronze as br
from tidemark.sources import files as fl
from tidemark.sources import jdbc
from tidemark.sources import tables as tb

ZONES = ["UTC", "Asia/Kolkata", "America/New_York"]


@pytest.fixture(params=ZONES)
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_coverage_opens_no_file(spark, tmp_path):
    rows = spark.range(60).select(F.when(F.col("id") % 2 == 0, "archive").otherwise("fore cast+%").alias("dataset"), F.date_add(F.lit("2024-02-20").cast("date"), (F.col("id") % 15).cast("int")).alias("date"), "id")
    tb.write_layer(rows, f"{tmp_path}/gold")
    expected = {(r["dataset"], r["date"]) for r in rows.select("dataset", "date").distinct().collect()}
    tb.register_external(spark, "gold_keys", f"{tmp_path}/gold")
    (tmp_path / "gold" / "stray.parquet").write_bytes(b"no")
    (tmp_path / "gold" / "dataset=archive" / "date=never").mkdir()
    (tmp_path / "gold" / "dataset=archive" / "date=never" / "x.parquet").write_bytes(b"no")
    for f in (tmp_path / "gold").rglob("*.parquet"):
        f.write_bytes(b"none of this can be read")
    system = spark._jvm.org.apache.hadoop.fs.FileSystem
    system.clearStatistics()
    assert {tuple(r) for r in fl.list_coverage(spark, f"{tmp_path}/gold").collect()} == expected
    counted = {r["layer"]: (r["files"], r["bytes"]) for r in fl.files_per_layer(spark, {"gold": f"{tmp_path}/gold", "none": f"{tmp_path}/none"}).collect()}
    assert counted["none"] == (0, 0) and counted["gold"][0] == len(list((tmp_path / "gold").rglob("*.parquet")))
    assert sum(s.getBytesRead() for s in system.getAllStatistics() if s.getScheme() == "file") == 0
    assert {r["date"] for r in fl.catalog_coverage(spark, "gold_keys").collect()} == {d for _, d in expected}
    assert fl.list_coverage(spark, f"{tmp_path}/none").count() == 0
    assert tb.load_or_scan(spark, f"{tmp_path}/manifest", f"{tmp_path}/gold").count() == len(expected)
    spark.sql("DROP TABLE gold_keys")


def test_one_clock_in_every_zone(spark, zone):
    """Instants and times without a zone, at the edges of days and of daylight saving."""
    times = [dt.datetime(2024, 1, 6, 23, 30), dt.datetime(2024, 3, 10, 2, 30, 0, 123456), dt.datetime(2024, 11, 3, 5, 30), dt.datetime(2024, 11, 3, 6, 30), dt.datetime(1969, 12, 31, 23, 59, 59)]
    micros = [(t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for t in times]
    rows = spark.createDataFrame([(m, str(t)) for m, t in zip(micros, times)], "m long, s string").select(F.timestamp_micros("m").alias("at"), F.col("s").cast("timestamp_ntz").alias("wall"), "m")
    for c in ("at", "wall"):
        got = rows.select(cal.utc_time(c).cast("string"), cal.utc_date(c), F.unix_micros(cal.instant(c)), F.unix_seconds(cal.utc_hour(c)), cal.utc_minute_text(c), F.unix_seconds(cal.parse_utc_minute(cal.utc_minute_text(c))), lb.run_stamp(c), lb.version_id(c)).collect()
        assert [tuple(r) for r in got] == [(str(t), t.date(), m, m // 10**6 // 3600 * 3600, t.strftime("%Y-%m-%dT%H:%M"), m // 10**6 // 60 * 60, t.strftime("%Y%m%dT%H%M%SZ"), t.strftime("%Y-%m-%dT%H-%M-%SZ")) for t, m in zip(times, micros)]
        dim = time_dim(rows, c).collect()
        assert {(r["date"], r["hour"], r["day_of_week"], r["is_weekend"]) for r in dim} == {(t.date(), t.hour, t.isoweekday() % 7 + 1, t.isoweekday() > 5) for t in times}


def test_lake_in_every_zone(spark, tmp_path, zone):
    """Layers, dimensions and fact are those of UTC: landed texts name UTC times."""
    base = dt.datetime(2024, 3, 9, 12)
    hours = [base + dt.timedelta(hours=h) for h in range(40)]
    schema = "region string, dataset string, marz string, run_ts string, latitude double, longitude double, elevation double, hourly struct<time: array<string>, temperature_2m: array<double>>"
    docs = spark.createDataFrame([("am", "archive", "m", "1", 40.0, 44.0, 9.0, ([h.strftime("%Y-%m-%dT%H:%M") for h in hours], [float(i) for i in range(40)]))], schema)
    br.land_bronze(docs, f"{tmp_path}/bronze", ["region", "dataset", "marz", "run_ts"])
    jobs.bronze_to_silver(spark, f"{tmp_path}/bronze", f"{tmp_path}/silver", ["temperature_2m"])
    silver = tb.read_layer(spark, f"{tmp_path}/silver")
    assert sorted(tuple(r) for r in silver.select(F.unix_seconds("observed_at"), F.col("date").cast("string"), "temperature_2m").collect()) == [(int((h - dt.datetime(1970, 1, 1)).total_seconds()), str(h.date()), float(i)) for i, h in enumerate(hours)]
    gold = build_gold(silver, ["region", "dataset", "lat", "lon"], "observed_at", "temperature_2m")
    assert [r[0] for r in gold.orderBy("observed_at").select("hour").collect()] == [h.hour for h in hours]
    jobs.load_star(spark, f"{tmp_path}/silver", f"{tmp_path}/star", ["temperature_2m"])
    times = jobs.current_table(spark, f"{tmp_path}/star", "dim_time")
    assert sorted((r["time_id"], str(r["date"]), r["hour"]) for r in times.collect()) == [(i + 1, str(h.date()), h.hour) for i, h in enumerate(hours)]
    assert jobs.current_table(spark, f"{tmp_path}/star", "fact").count() == 40


@pytest.fixture
def database(spark):
    """An embedded database, if its driver is on Spark's class path."""
    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    except Exception:
        pytest.skip("no driver of an embedded database")
    return {"url": f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_star_in_a_database(spark, tmp_path, database):
    measures = ["temperature_2m"]

    def silver(places, hours):
        rows = [("am", "archive", f"m{p}", 40.0 + p, 44.0, 100.0, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(h)) for p in places for h in range(hours)]
        df = spark.createDataFrame(rows, "region string, dataset string, marz string, lat double, lon double, elevation double, observed_at timestamp, temperature_2m double")
        df.withColumn("date", F.to_date("observed_at")).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("dataset", "date").parquet(f"{tmp_path}/silver")

    read = lambda name: {tuple(r) for r in jdbc.read_table(spark, database, name).collect()}
    assert not jobs.load_star_to_database(spark, f"{tmp_path}/silver", database, measures)
    silver([1, 2], 10)
    for _ in range(2):
        assert jobs.load_star_to_database(spark, f"{tmp_path}/silver", database, measures, partitions=3)
    first = {n: read(n) for n in ("dim_location", "dim_time", "fact")}
    assert len(first["dim_location"]) == 2 and len(first["dim_time"]) == 10 and len(first["fact"]) == 20
    silver([0, 1, 2], 12)
    jobs.load_star_to_database(spark, f"{tmp_path}/silver", database, measures)
    second = {n: read(n) for n in first}
    assert first["dim_location"] < second["dim_location"] and first["dim_time"] < second["dim_time"] and len(second["fact"]) == 36
    assert not any(jdbc.has_table(spark, database, f"{n}_stage") for n in first)


def test_database_loads_are_whole_or_not_there(spark, database):
    rows = spark.createDataFrame([(1, "a"), (2, "")], "k long, v string")  # Spark gives this database no NULL strings
    jdbc.execute(spark, database, 'CREATE TABLE t ("k" BIGINT, "v" VARCHAR(5))')
    for _ in range(2):
        jdbc.append_absent(rows, database, "t", ["k"])
    assert sorted(r["k"] for r in jdbc.read_table(spark, database, "t", "k", 2).collect()) == [1, 2]
    jdbc.replace_rows(rows.unionByName(rows), database, "t")  # equal rows stay two
    assert jdbc.read_table(spark, database, "t").count() == 4
    with pytest.raises(Exception):
        jdbc.replace_rows(spark.createDataFrame([(3, "too long for it")], "k long, v string"), database, "t")
    assert jdbc.read_table(spark, database, "t").count() == 4 and not jdbc.has_table(spark, database, "t_stage")
    with pytest.raises(Exception):
        jdbc.execute(spark, database, "DELETE FROM t", "INSERT INTO missing VALUES (1)")
    assert jdbc.read_table(spark, database, "t").count() == 4
    ranges = jdbc.read_table(spark, database, "t", "k", 2)
    assert ranges.rdd.getNumPartitions() == 2
