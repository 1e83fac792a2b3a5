"""Loads of the star: killed between any two steps and run again, stages that go, bytes that a backfill writes."""

from __future__ import annotations

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.plans import jobs
from tidemark.sources import warehouse as wh
from tidemark.sources.warehouse import Warehouse

M = ["temperature_2m"]
START = dt.datetime(2024, 1, 1)
KEYS = {"dim_location": ["region", "lat", "lon", "location_id"], "dim_time": ["observed_at", "time_id"], "fact": ["dataset", "location_id", "time_id", *M], "predictions": ["model_version", "location_id", "prediction_made_at", "target_time", "predicted_value", "actual_value"], "scored_groups": ["model_version", "location_id", "prediction_made_at", "n_hours", "mse"]}


class Killed(BaseException):
    """No handler of the library runs anything after it: every later step raises it again."""


@pytest.fixture
def dying(monkeypatch):
    """Makes loads die at the k-th step; returns the steps seen."""

    def arm(at):
        seen = []

        def step(self, what):
            if len(seen) >= at:
                raise Killed
            seen.append(what)

        monkeypatch.setattr(Warehouse, "step", step)
        return seen

    yield arm
    monkeypatch.undo()


def silver(spark, path, places, hours, datasets=("archive",)):
    rows = [("am", d, f"m{p}", 40.0 + p, 44.0, 100.0, START + dt.timedelta(hours=h), float(10 * p + h)) for p in places for h in hours for d in datasets]
    schema = "region string, dataset string, marz string, lat double, lon double, elevation double, observed_at timestamp, temperature_2m double"
    df = spark.createDataFrame(rows, schema).withColumn("date", F.to_date("observed_at"))
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("dataset", "date").parquet(path)


def content(spark, root):
    house = Warehouse(spark, root, M)
    return {n: sorted(map(tuple, house.table(n).select(*c).collect()), key=str) for n, c in KEYS.items()}


def forget(spark, root):
    """What the end of a session does to a catalog in memory."""
    Warehouse(spark, root, M, recover=False).close()


def predictions(spark, n=3):
    rows = [("m0", 40.0, 44.0, "walkforward:v", START + dt.timedelta(hours=24 * d), START + dt.timedelta(hours=24 * d + 1), 1.0, 6) for d in range(n)]
    return spark.createDataFrame(rows, "region string, lat double, lon double, model_version string, prediction_made_at timestamp, target_time timestamp, predicted_value double, seq_in int")


@pytest.fixture(autouse=True)
def small_jobs(spark, request):
    """Jobs of a few rows: one task each; and where there are hundreds, no code compiled for them."""
    quick = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false"}
    if "between_any_two_steps" in request.node.name:
        quick |= {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k) for k in quick}
    for k, v in quick.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def load_star(spark, tmp, root):
    jobs.load_star(spark, f"{tmp}/silver", root, M)


def fill_ledger(spark, tmp, root):
    """Add predictions, fill in, score."""
    house = Warehouse(spark, root, M)
    places = house.table("dim_location").select("location_id", *jobs.PLACE)
    jobs.append_predictions(house, predictions(spark).join(places, jobs.PLACE))
    jobs.backfill(spark, root, M[0])
    jobs.refresh_scores(spark, root)


def whole_load(spark, tmp, root):
    load_star(spark, tmp, root)
    fill_ledger(spark, tmp, root)


@pytest.mark.parametrize("load,expected_steps", [(load_star, 10), (fill_ledger, 11)])
def test_killed_between_any_two_steps(spark, tmp_path, dying, load, expected_steps):
    """Wherever it dies, a rerun gives what an undisturbed run gives; ids that were given before are kept."""
    root = str(tmp_path / "star")
    silver(spark, f"{tmp_path}/silver", [1, 2], range(30), ("archive", "old"))
    load_star(spark, tmp_path, root)
    before = content(spark, root)
    silver(spark, f"{tmp_path}/silver", [0, 1, 2], range(60))
    if load is fill_ledger:
        load_star(spark, tmp_path, root)
    shutil.copytree(root, tmp_path / "clean")
    steps = dying(10**6)
    load(spark, tmp_path, str(tmp_path / "clean"))
    expected, steps = content(spark, str(tmp_path / "clean")), list(steps)
    assert set(before["dim_location"]) < set(expected["dim_location"]) and expected["fact"] != before["fact"]
    assert len(steps) >= expected_steps and len(expected["predictions"]) == (3 if load is fill_ledger else 0)
    for at in range(len(steps)):
        copy = str(tmp_path / f"killed{at}")
        shutil.copytree(root, copy)
        dying(at)
        with pytest.raises(Killed):
            load(spark, tmp_path, copy)
        dying(10**6)
        forget(spark, copy)
        if at % 3 == 0:  # a reader in between sees no stage and starts no repair
            assert Warehouse(spark, copy, M, recover=False).table("dim_location").count() >= 2
        load(spark, tmp_path, copy)
        assert content(spark, copy) == expected, (at, steps[at])
        assert not any((tmp_path / f"killed{at}" / "_stage").glob("*"))
        forget(spark, copy)
        shutil.rmtree(copy)


def test_killed_within_an_overwrite(spark, tmp_path):
    """A partition that an overwrite had deleted is there again when the star is opened."""
    root = str(tmp_path / "star")
    silver(spark, f"{tmp_path}/silver", [0, 1], range(60))
    whole_load(spark, tmp_path, root)
    before = content(spark, root)
    house = Warehouse(spark, root, M)
    house._stage(house.table("predictions"), "predictions_redo")
    shutil.rmtree(next((tmp_path / "star" / "predictions").glob("model_version=*/target_date=2024-01-02")))
    forget(spark, root)
    assert Warehouse(spark, root, M, recover=False).table("predictions").count() < len(before["predictions"])
    assert content(spark, root) == before


def test_stage_goes_after_an_error(spark, tmp_path):
    root = str(tmp_path / "star")
    silver(spark, f"{tmp_path}/silver", [0], range(5))
    jobs.load_star(spark, f"{tmp_path}/silver", root, M)
    house = Warehouse(spark, root, M)
    bad = house.table("fact").withColumn(M[0], F.raise_error(F.lit("broken")).cast("double"))
    for attempt in (lambda: house.refresh("fact", bad), lambda: house.replace("fact", bad), lambda: wh.load_new_keys(house, "dim_time", house.table("dim_time").drop("date"), ["date", "observed_at"], "time_id")):
        with pytest.raises(Exception):
            attempt()
        assert {t.name for t in spark.catalog.listTables(house.database)} == set(house.tables)
        assert not any((tmp_path / "star" / "_stage").glob("*"))
    assert house.table("fact").count() == 5


def test_ids_are_kept_and_first_rows_win(spark, tmp_path):
    root = str(tmp_path / "star")
    silver(spark, f"{tmp_path}/silver", [3, 5], range(4))
    jobs.load_star(spark, f"{tmp_path}/silver", root, M)
    first = content(spark, root)["dim_location"]
    silver(spark, f"{tmp_path}/silver", [0, 3, 5, 7], range(4))
    jobs.load_star(spark, f"{tmp_path}/silver", root, M)
    second = content(spark, root)["dim_location"]
    assert set(first) < set(second) and sorted(r[-1] for r in second) == [1, 2, 3, 4]


def test_nothing_to_load_leaves_the_fact(spark, tmp_path):
    root = str(tmp_path / "star")
    silver(spark, f"{tmp_path}/silver", [0, 1], range(5))
    assert jobs.load_star(spark, f"{tmp_path}/silver", root, M)
    silver(spark, f"{tmp_path}/empty", [], range(5))
    for nothing in (f"{tmp_path}/empty", f"{tmp_path}/none"):
        assert not jobs.load_star(spark, nothing, root, M)
        assert Warehouse(spark, root, M).table("fact").count() == 10


def test_backfill_writes_the_partitions_that_are_due(spark, tmp_path):
    root = str(tmp_path / "star")
    silver(spark, f"{tmp_path}/silver", [0], range(50))
    jobs.load_star(spark, f"{tmp_path}/silver", root, M)
    house = Warehouse(spark, root, M)
    places = house.table("dim_location").select("location_id", *jobs.PLACE)
    jobs.append_predictions(house, predictions(spark, 10).join(places, jobs.PLACE))
    files = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in (tmp_path / "star" / "predictions").rglob("*.parquet")}
    before = files()
    assert len(before) == 10
    assert jobs.backfill(spark, root, M[0]) == 3  # hours 1, 25 and 49 are there
    after = files()
    assert {p.parent.name for p in after.keys() - before.keys()} == {"target_date=2024-01-01", "target_date=2024-01-02", "target_date=2024-01-03"}
    assert {p: t for p, t in before.items() if p in after} == {p: t for p, t in after.items() if p in before} and len(after) == 10
    jobs.append_predictions(house, predictions(spark, 10).join(places, jobs.PLACE))
    assert jobs.backfill(spark, root, M[0]) == 0 and files() == after
    assert house.table("predictions").where("actual_value is not null").count() == 3


def test_hot_partition_and_null_version(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path), M)
    rows = spark.range(500).select((F.col("id") % 7).alias("location_id"), F.lit(START).alias("prediction_made_at"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("target_time"), F.lit(1.0).alias("predicted_value"), F.lit(6).alias("seq_in"), F.when(F.col("id") > 3, "walkforward:a:b/c d").alias("model_version"))
    for _ in range(2):
        jobs.append_predictions(house, rows)
    assert house.table("predictions").where("model_version is not null").count() == 496


def test_partitions_of_odd_values_go(spark, tmp_path):
    """A refresh drops partitions whatever their value is, files and all."""
    house = Warehouse(spark, str(tmp_path), M)
    rows = lambda *names: spark.createDataFrame([(1, i, 1.0, n) for i, n in enumerate(names)], "location_id long, time_id long, temperature_2m double, dataset string")
    house.refresh("fact", rows(None, "it's", "a\\b", "x=y/z: 100%", "archive"))
    assert house.table("fact").count() == 5
    house.refresh("fact", rows("archive"))
    assert [r["dataset"] for r in house.table("fact").collect()] == ["archive"]
    assert [p.name for p in (tmp_path / "fact").glob("dataset=*")] == ["dataset=archive"]
