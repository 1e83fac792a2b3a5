"""Operators on small series, with the numbers worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels as lb
from tidemark.functions.calendar import add_calendar, season
from tidemark.operators import coverage as cov
from tidemark.operators import evaluate as ev
from tidemark.operators import features as ft
from tidemark.operators import forecast as fc
from tidemark.operators import reports as rp
from tidemark.operators import samples as sm
from tidemark.operators import star as st
from tidemark.operators import upsert as up

START = dt.datetime(2024, 1, 1)


def hourly(spark, n, lat=40.0, start=START):
    rows = [("a", lat, 44.0, start + dt.timedelta(hours=i), float(i), float(i * 100)) for i in range(n)]
    return spark.createDataFrame(rows, "region string, lat double, lon double, observed_at timestamp, v double, f double")


LOC = ["region", "lat", "lon"]


@pytest.mark.parametrize("n,seq_in,seq_out,stride,expected", [(30, 10, 3, 1, 18), (5, 10, 3, 1, 0), (50, 10, 3, 2, 19), (50, 10, 3, 5, 8)])
def test_sample_counts(spark, n, seq_in, seq_out, stride, expected):
    assert sm.sliding_samples(hourly(spark, n), LOC, "observed_at", ["f"], "v", seq_in, seq_out, stride).count() == expected


def test_sample_alignment_and_two_locations(spark):
    first = sm.sliding_samples(hourly(spark, 20), LOC, "observed_at", ["v"], "v", 5, 2).orderBy("anchor_ts").first()
    assert [r["v"] for r in first["inputs"]] == [0, 1, 2, 3, 4] and first["targets"] == [5, 6]
    both = hourly(spark, 20).unionByName(hourly(spark, 20, 41.0))
    assert sm.sliding_samples(both, LOC, "observed_at", ["v"], "v", 4, 2).count() == 30


def test_missing_lags_are_dropped_first(spark):
    rows = ft.add_lags(hourly(spark, 20), LOC, "observed_at", "v", (3,))
    assert sm.sliding_samples(sm.complete_rows(rows, ["v_lag_3h"]), LOC, "observed_at", ["v"], "v", 4, 2).count() == 12


def test_contiguous_samples_skip_gaps(spark):
    rows = hourly(spark, 20).where("v <> 10")
    assert sm.sliding_samples(rows, LOC, "observed_at", ["v"], "v", 4, 2, require_contiguous=True).count() == 5 + 4


@pytest.mark.parametrize("stride,expected", [(1, [3, 4, 5, 6, 7, 8, 9]), (0, [3, 4, 5, 6, 7, 8, 9]), (2, [3, 5, 7, 9]), (3, [3, 6, 9]), (6, [3, 9])])
def test_anchors(spark, stride, expected):
    assert sorted(r["v"] for r in sm.anchors(hourly(spark, 10), LOC, "observed_at", 4, stride).collect()) == expected


def test_anchor_edges(spark):
    assert sm.anchors(hourly(spark, 3), LOC, "observed_at", 4).count() == 0
    assert [r["v"] for r in sm.anchors(hourly(spark, 4), LOC, "observed_at", 4).collect()] == [3]


@pytest.mark.parametrize("n,days,expected", [(24, 0, 24), (240, 2, 192), (72, 7, 0)])
def test_cutoff(spark, n, days, expected):
    assert sm.trim_to_cutoff(hourly(spark, n), "observed_at", days).count() == expected


def test_cutoff_of_nothing(spark):
    assert sm.trim_to_cutoff(hourly(spark, 2).limit(0), "observed_at", 3).count() == 0


@pytest.mark.parametrize("n,f,train", [(100, 0.2, 80), (10, 0.0, 10)])
def test_chrono_split(spark, n, f, train):
    out = sm.chrono_split(hourly(spark, n), "observed_at", ["lat"], f)
    assert out.where("split = 'train'").count() == train and out.count() == n
    assert out.where("split = 'train'").agg(F.max("v")).first()[0] == train - 1


def test_split_cuts_inside_a_tied_anchor(spark):
    rows = spark.createDataFrame([(START, i) for i in range(10)], "t timestamp, i int")
    got = sm.chrono_split(rows, "t", ["i"], 0.3)
    assert sorted(r["i"] for r in got.where("split = 'val'").collect()) == [7, 8, 9]


def test_horizons(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12), [1.0, 2.0, 3.0])], "t timestamp, p array<double>")
    assert [r["target_time"].hour for r in sm.explode_horizons(rows, "t", "p").orderBy("h_ahead").collect()] == [13, 14, 15]


def test_scaler(spark):
    stats = {r["column"]: r for r in sm.fit_scaler(hourly(spark, 3).withColumn("c", F.lit(2.0)), ["v", "c"]).collect()}
    assert stats["v"]["mean"] == 1 and abs(stats["v"]["std"] - (2 / 3) ** 0.5) < 1e-12 and stats["c"]["std"] == 1


def test_rolling_is_a_time_range(spark):
    rows = hourly(spark, 2).unionByName(hourly(spark, 1, start=START + dt.timedelta(hours=24)))
    got = ft.add_rolling(rows, LOC, "observed_at", "v").orderBy("observed_at").collect()
    assert [r["v_roll24_mean"] for r in got] == [0, 0.5, 0.5] and got[0]["v_roll24_std"] is None


def test_gold_windows_share_one_exchange_and_sort(spark):
    plan = ft.build_gold(hourly(spark, 5), LOC, "observed_at", "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_calendar(spark):
    got = add_calendar(spark.createDataFrame([(dt.datetime(2026, 5, 24, 12),), (None,)], "t timestamp"), "t", "dim").orderBy(F.desc("t")).collect()
    assert (got[0]["season"], got[0]["is_weekend"], got[0]["day_of_week"]) == ("spring", True, 1) and got[1]["season"] is None
    assert spark.range(1).select(season(F.lit(None).cast("int"))).first()[0] is None


def test_dims_and_keys(spark):
    at = dt.datetime(2026, 5, 24, 12)
    rows = [("a", 40.0, 44.0, e, at + dt.timedelta(hours=h), "archive", v) for e, h, v in ((1000.0, 0, 18.5), (1000.0, 1, 19.0))] + [("b", 41.0, 45.0, 1500.0, at + dt.timedelta(hours=h), "archive", 12.0 + h / 2) for h in (0, 1)]
    silver = spark.createDataFrame(rows, "region string, lat double, lon double, elevation double, observed_at timestamp, dataset string, v double")
    dim = st.location_dim(silver, LOC, ["elevation"], "observed_at")
    times = st.time_dim(silver, "observed_at")
    assert dim.count() == 2 and times.count() == 2 and {r["season"] for r in times.collect()} == {"spring"}
    none = spark.createDataFrame([], "location_id long, region string, lat double, lon double, elevation double")
    first = up.assign_keys(dim, none, LOC, "location_id")
    more = dim.unionByName(spark.createDataFrame([("aa", 1.0, 1.0, 5.0)], "region string, lat double, lon double, elevation double"))
    again = {r["region"]: r["location_id"] for r in up.assign_keys(more, first, LOC, "location_id").collect()}
    assert again == {"a": 1, "b": 2, "aa": 3}
    assert up.insert_absent(first, first, LOC).count() == 2 and up.upsert(first, first, LOC).count() == 2
    assert up.duplicate_keys(first, LOC).count() == 0 and up.orphans(more, first, LOC).count() == 1


def test_dates_and_chunks(spark):
    assert cov.date_range(spark, "2024-01-03", "2024-01-01").count() == 0 and cov.date_range(spark, "2024-01-01", "2024-01-03").count() == 3
    window = spark.sql("SELECT date'2023-06-01' AS s, date'2025-03-15' AS e")
    chunks = cov.year_chunks(window, "s", "e").select("chunk_start", "chunk_end")
    assert chunks.count() == 3
    missing = spark.sql("SELECT date'2024-07-01' AS date")
    assert [str(r["chunk_start"]) for r in cov.chunks_with_gaps(chunks, missing).collect()] == ["2024-01-01"]
    places = spark.range(4)
    assert cov.work_list(places, chunks, missing).count() == 4 and cov.work_list(places, chunks, missing, force=True).count() == 12
    assert cov.work_list(places, chunks, missing.limit(0)).count() == 0


def test_parsing(spark):
    rows = spark.createDataFrame([("2024-01-01:2024-02-01", "x/date=2024-05-01/p"), ("nonsense", "x/date=2024-15-01/p"), (None, "_SUCCESS")], "w string, p string")
    got = rows.select(lb.parse_window("w").alias("w"), lb.partition_date("p").alias("d")).collect()
    assert [r["w"]["ok"] for r in got] == [True, False, False] and [str(r["d"]) for r in got] == ["2024-05-01", "None", "None"]


def test_asof_takes_the_row_at_the_same_time(spark):
    left = spark.createDataFrame([(1, START + dt.timedelta(hours=h)) for h in (0, 2)], "k int, t timestamp")
    right = spark.createDataFrame([(1, START + dt.timedelta(hours=h), float(h)) for h in (1, 2)], "k int, r timestamp, x double")
    assert [r["x"] for r in rp.asof_backward(left, right, ["k"], "t", "r", ["x"]).orderBy("t").collect()] == [None, 2.0]


def test_metrics_and_scores(spark):
    rows = spark.createDataFrame([(1, "walkforward:x", START, 1.0, 0.0), (1, "walkforward:x", START, 2.0, 4.0), (2, "walkforward:x", START, 1.0, None)], "location_id int, model_version string, prediction_made_at timestamp, predicted_value double, actual_value double")
    groups = ev.score_groups(rows).collect()
    assert len(groups) == 1 and groups[0]["mse"] == 2.5 and groups[0]["n_hours"] == 2
    m = ev.error_metrics(rows.where("actual_value is not null"), "predicted_value", "actual_value").first()
    assert m["mae"] == 1.5 and abs(m["mape"] - (1000 + 0.5) / 2 * 100) < 1e-9


def test_compatibility_guard():
    assert ev.check_compatible({"feature_columns": ["a"], "hyperparams": {"n": 1}}, ["a"], {"n": 1}) == (1, float("inf"))
    assert ev.check_compatible({"feature_columns": ["a"], "epoch": 4, "best_val_mse": 0.5}, ["a"], {}) == (5, 0.5)
    for bad in ({"feature_columns": ["b"]}, {"feature_columns": ["a"], "hyperparams": {"n": 2}}):
        with pytest.raises(ValueError):
            ev.check_compatible(bad, ["a"], {"n": 1})


def test_best_geocode(spark):
    rows = spark.createDataFrame([("x", 1, None, 1.00004), ("x", 2, 5, 2.0), ("x", 3, 5, 3.0)], "query string, position int, population long, latitude double").withColumn("longitude", F.lit(0.0))
    assert rp.best_geocode(rows, F.lit(True)).first()["position"] == 2


def test_upsert_has_one_row_per_key(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, version int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, version int")
    got = up.upsert(old, new, ["k"], "version").collect()
    assert sorted(map(tuple, got)) == [(1, "a", 0), (2, "d", 2), (3, "e", 1)]
    with pytest.raises(ValueError):
        up.upsert(old, new, ["k"])
    assert sorted(map(tuple, up.absent(old, new, ["k"]).collect())) == [(3, "e", 1)]
    child = spark.createDataFrame([(1,), (9,), (None,)], "k int")
    assert [r["k"] for r in up.orphans(child, old, ["k"]).collect()] == [9]


def test_global_ranks(spark):
    import random

    values = [random.Random(1).randrange(50) for _ in range(500)]
    df = spark.createDataFrame([(v if v else None, i) for i, v in enumerate(values)], "x int, i int")
    got = {r["i"]: r["rank"] for r in sm.global_ranks(df, ["x", "i"], "rank", 20).collect()}
    order = sorted(range(500), key=lambda i: (values[i], i))
    assert all(got[i] == rank for rank, i in enumerate(order))
    assert sm.global_ranks(df.limit(0), ["x", "i"], "rank").count() == 0
    assert {r["batch_id"] for r in sm.batch_ids(df, ["x", "i"], 100).collect()} == {0, 1, 2, 3, 4}


def test_windows_are_fitted_on_scaled_values(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    day, series = dt.datetime(2024, 1, 1), rng.normal(10, 3, 120)
    rows = [("a", day + dt.timedelta(hours=i), float(v), float(i % 7)) for i, v in enumerate(series)]
    df = spark.createDataFrame(rows, "p string, t timestamp, v double, w double")
    samples = sm.sliding_samples(df, ["p"], "t", ["v", "w"], "v", 4, 2)
    model = fc.fit_windows(samples, ["v", "w"], 4, 2, ["p"])
    flat = [([x for i in r["inputs"] for x in (i["v"], i["w"])], r["targets"]) for r in samples.orderBy("anchor_ts").collect()]
    x, y = np.array([f[0] for f in flat]), np.array([f[1] for f in flat])
    cut = int(len(x) * 0.8)
    mean, std = x[:cut].reshape(-1, 2).mean(0), x[:cut].reshape(-1, 2).std(0)
    assert abs(model.mean[0] - mean[0]) < 1e-9 and abs(model.std[1] - std[1]) < 1e-9
    z = np.hstack([(x.reshape(len(x), 4, 2) - mean).reshape(len(x), 8) / np.tile(std, 4), np.ones((len(x), 1))])
    fitted = np.linalg.lstsq(z[:cut], y[:cut], rcond=None)[0]
    assert abs(model.val_mse - ((z[cut:] @ fitted - y[cut:]) ** 2).mean()) < 1e-3 and model.weights().shape == (9, 2)
    with pytest.raises(ValueError):
        fc.fit_windows(samples.limit(0), ["v", "w"], 4, 2, ["p"])


def test_calendar_is_utc_in_any_zone(spark):
    df = spark.sql("SELECT timestamp'2024-01-06 23:30:00Z' AS t")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            row = add_calendar(df, "t").first()
            assert (row["hour"], row["day_of_week"], row["is_weekend"]) == (23, 7, 1), z
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
