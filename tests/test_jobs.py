"""The composed jobs on a small lake: landing to scored forecasts, run twice."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import upsert as up
from tidemark.plans import jobs
from tidemark.sources import bronze as br
from tidemark.sources import tables as tb
from tidemark.sources.warehouse import Warehouse

M = ["temperature_2m", "rain"]


def land(spark, root):
    day = [f"2024-01-{d:02d}T{h:02d}:00" for d in (1, 2) for h in range(24)]
    rows = []
    for marz, lat in (("north", 41.0), (None, 40.0)):
        for run, shift in (("20240101", 0.0), ("20240102", 1.0)):
            hourly = (day, [float(i) + shift for i in range(48)], None if marz else [0.5] * 48)
            rows.append(("am", "archive", marz, run, lat, 44.0, 1000.0, hourly))
    rows.append(("am", "archive", "broken", "20240101", None, 44.0, 1.0, (day, [1.0] * 48, [1.0] * 48)))
    schema = "region string, dataset string, marz string, run_ts string, latitude double, longitude double, elevation double, hourly struct<time: array<string>, temperature_2m: array<double>, rain: array<double>>"
    br.land_bronze(spark.createDataFrame(rows, schema), f"{root}/bronze", ["region", "dataset", "marz", "run_ts"])


def test_lake_and_star(spark, tmp_path):
    root = str(tmp_path)
    land(spark, root)
    quarantine = jobs.bronze_to_silver(spark, f"{root}/bronze", f"{root}/silver", M)
    assert quarantine.count() == 1
    silver = tb.read_layer(spark, f"{root}/silver")
    assert silver.count() == 96 and up.duplicate_keys(silver, ["region", "dataset", "marz", "lat", "lon", "observed_at"]).count() == 0
    assert silver.agg(F.min("temperature_2m")).first()[0] == 1.0  # the newer run wins
    assert silver.where("marz = 'north' and rain is null").count() == 48  # a missing array pads with NULL
    assert tb.read_layer(spark, f"{root}/silver", start="2024-01-02").count() == 48
    assert tb.load_or_scan(spark, f"{root}/manifest", f"{root}/silver").count() == 2

    jobs.silver_to_gold(spark, f"{root}/silver", f"{root}/gold")
    assert tb.read_layer(spark, f"{root}/gold").count() == 96
    assert tb.files_per_layer(spark, {"silver": f"{root}/silver", "gold": f"{root}/gold"}).count() == 2

    for _ in range(2):
        jobs.load_star(spark, f"{root}/silver", f"{root}/star", M)
        fact = jobs.current_table(spark, f"{root}/star", "fact")
        assert fact.count() == 96 and jobs.current_table(spark, f"{root}/star", "dim_location").count() == 2

    gold = tb.read_layer(spark, f"{root}/gold").drop("region").withColumnRenamed("marz", "region")
    for _ in range(2):
        report = jobs.run_walk_forward(spark, gold, f"{root}/star", "v1", ["temperature_2m"], "temperature_2m", 6, 2, 4).first()
    assert report["rows"] == 2 * 11 * 2 and report["cells"] == 2 and report["skipped"] == 0
    groups = jobs.current_table(spark, f"{root}/star", "scored_groups")
    assert groups.count() == 2 * 11 and {r["mse"] for r in groups.select("mse").collect()} == {2.5}
    assert jobs.backfill(spark, f"{root}/star", "temperature_2m") == 0


def test_tables(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS tide")
    tb.create_tables(spark, "tide", ["predictions", "scored_groups"])
    assert tb.add_column_if_absent(spark, "tide.scored_groups", "note", "STRING") and not tb.add_column_if_absent(spark, "tide.scored_groups", "note", "STRING")
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0), ("b", dt.date(2024, 1, 2), 2.0)], "dataset string, date date, v double")
    path = f"{tmp_path}/t"
    for _ in range(2):
        tb.append_absent(spark, rows, path, ["dataset", "date"], ["dataset", "date"])
    tb.register_external(spark, "tide.lake", path)
    assert spark.table("tide.lake").count() == 2
    tb.write_layer(rows.where("dataset = 'a'").withColumn("v", F.lit(9.0)), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [2.0, 9.0]
    spark.sql("DROP TABLE tide.lake")
    tb.clear_table(spark, "tide.scored_groups")
    tb.write_metrics_csv(spark.createDataFrame([(1, 0.12345)], "h_ahead int, mae_c double"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first()["mae_c"] == "0.1235"
    tb.record_run(spark, {"version": "v1", "metric": 0.5}, f"{tmp_path}/runs")
    assert spark.read.json(f"{tmp_path}/runs").first()["version"] == "v1"


def test_plan_and_manifest(spark):
    present = spark.sql("SELECT explode(sequence(date'2023-01-01', date'2023-12-31')) AS date")
    plan = jobs.ingest_plan(spark, spark.range(3), present, "2023-06-01", "2024-01-10")
    assert plan.count() == 3 and {str(r["chunk_start"]) for r in plan.collect()} == {"2024-01-01"}
    manifest = present.select(F.lit("archive").alias("dataset"), "date")
    good = spark.createDataFrame([(True, 5)], "ok boolean, rows long")
    wanted = spark.sql("SELECT date'2024-01-01' AS date")
    assert jobs.merge_if_clean(manifest, good, wanted, "archive").count() == 366
    assert jobs.merge_if_clean(manifest, good.withColumn("ok", F.lit(False)), wanted, "archive").count() == 365


def test_nothing_landed(spark, tmp_path):
    assert jobs.bronze_to_silver(spark, f"{tmp_path}/none", f"{tmp_path}/silver").count() == 0
    jobs.silver_to_gold(spark, f"{tmp_path}/silver", f"{tmp_path}/gold")
    assert not (tmp_path / "silver").exists() and not (tmp_path / "gold").exists()


def test_measures_and_full_refresh(spark, tmp_path):
    assert br.MEASURES == ["temperature_2m", "relative_humidity_2m", "dew_point_2m", "precipitation", "pressure_msl", "cloud_cover", "wind_speed_10m", "wind_direction_10m", "wind_gusts_10m", "shortwave_radiation"]
    assert all(f"{m} DOUBLE" in tb.STAR["fact"][0] for m in br.MEASURES)
    house = Warehouse(spark, str(tmp_path))
    for n in (5, 2):
        rows = spark.range(n).select(F.col("id").alias("location_id"), F.lit(1).cast("long").alias("time_id"), F.lit(f"d{n}").alias("dataset"), *[F.lit(None).cast("double").alias(m) for m in br.MEASURES])
        house.refresh("fact", rows)
    assert house.table("fact").count() == 2 and not list((tmp_path / "fact").glob("dataset=d5"))
    (tmp_path / "places.json").write_text('[{"region": "am", "lat": 40.1, "lon": 44.5, "population": 5, "capital": "Y"}, {"region": "b", "lat": 1, "lon": 2}]')
    places = br.read_locations(spark, f"{tmp_path}/places.json").orderBy("region").collect()
    assert [(p["region"], p["lat"], p["population"], p["capital"]) for p in places] == [("am", 40.1, 5, "Y"), ("b", 1.0, None, None)]


def test_layers_stand_without_the_star(spark, monkeypatch):
    """Queries on the layers don't wait for the star, the ledger and the models."""
    from tidemark.plans import queries as q

    monkeypatch.setattr(q, "LAKES", {})
    monkeypatch.setattr(jobs, "load_star", lambda *a: 1 / 0)
    monkeypatch.setattr(jobs, "run_walk_forward", lambda *a, **b: 1 / 0)
    assert q.QUERIES["s16_coverage_by_keys"](spark, "/root/testdata/sf0.001").count() == q.Views(spark, "/root/testdata/sf0.001").wide().select("date").distinct().count()
