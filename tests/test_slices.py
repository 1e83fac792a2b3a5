"""Windows in slices against the plain ones: gaps, ties, short slices, many and few series."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as ft
from tidemark.operators import reports as rp
from tidemark.operators import samples as sm
from tidemark.operators import slices as sl
from tidemark.plans import jobs
from tidemark.sources import tables as tb

START = dt.datetime(2024, 1, 1)


def rows_of(df):
    columns = sorted(df.columns)
    return sorted((tuple(None if r[c] is None else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(3)
    hours = {"long": sorted(rng.sample(range(600), 300)), "short": [5, 6, 700], "one": [0], None: list(range(40))}
    rows = [(k, START + dt.timedelta(hours=h), float(rng.randrange(100)) if rng.random() > 0.1 else None) for k, hs in hours.items() for h in hs]
    return spark.createDataFrame(rows, "place string, observed_at timestamp, v double").cache()


@pytest.mark.parametrize("size", [7, 30, 100, 10_000])
def test_gold_in_slices(series, size):
    plain = ft.build_gold(series, ["place"], "observed_at", "v")
    assert rows_of(sl.build_gold_in_slices(series, ["place"], "observed_at", "v", size)) == rows_of(plain)


@pytest.mark.parametrize("size", [5, 64, 10_000])
def test_asof_in_slices(spark, size):
    """The newest right row may lie many slices back, or nowhere; keys may be null; a right row at the same time counts."""
    rng = random.Random(size)
    left = spark.createDataFrame([(rng.choice(["hot"] * 8 + ["b", None]), i, rng.randrange(400)) for i in range(400)], "k string, id int, t int")
    right = spark.createDataFrame([("hot", 50, 1.0), ("hot", 300, 2.0), ("b", 0, 3.0), (None, 200, None), ("c", 1, 4.0)], "k string, rt int, x double")
    plain = rp.asof_backward(left, right, ["k"], "t", "rt", ["x"])
    assert rows_of(sl.asof_backward_in_slices(left, right, ["k"], "t", "rt", ["x"], size)) == rows_of(plain)
    assert sl.asof_backward_in_slices(left, right.limit(0), ["k"], "t", "rt", ["x"], size).where("x is null").count() == 400


def test_slices_are_bounded(spark):
    """One series of all rows: every slice holds its share, and of others no more than the windows reach."""
    df = spark.range(5000).select(F.lit("x").alias("place"), F.timestamp_seconds(F.col("id") * 3600).alias("observed_at"), F.col("id").cast("double").alias("v"))
    timed = df.withColumn("_sec", F.unix_seconds("observed_at"))
    rows = sl.with_halo(sl.in_slices(timed, ["place"], ["_sec"], 500), ["place"], "_sec", 24, 23 * 3600)
    sizes = {r["_slice"]: (r["own"], r["n"]) for r in rows.groupBy("_slice").agg(F.count_if("_own").alias("own"), F.count("*").alias("n")).collect()}
    assert sizes == {i: (500, 500 + (24 if i else 0)) for i in range(10)}
    assert sl.build_gold_in_slices(df.limit(0), ["place"], "observed_at", "v").count() == 0 and sl.longest_series(df, ["place"]) == 5000 and sl.longest_series(df.limit(0), ["place"]) == 0


def test_job_cuts_long_series(spark, series, tmp_path):
    silver = series.where("place is not null").withColumns({"dataset": F.lit("archive"), "date": F.to_date("observed_at")})
    tb.write_layer(silver, f"{tmp_path}/silver")
    for name, size in (("plain", 1000), ("cut", 50)):
        jobs.silver_to_gold(spark, f"{tmp_path}/silver", f"{tmp_path}/{name}", "v", ["place", "dataset"], size)
    assert rows_of(tb.read_layer(spark, f"{tmp_path}/cut")) == rows_of(tb.read_layer(spark, f"{tmp_path}/plain"))


def test_ranges_do_not_follow_slices(spark, monkeypatch):
    """Of each range the driver gets a sample, so small slices must not make many ranges."""
    made, plain = [], sm.ranges_in_order
    monkeypatch.setattr(sm, "ranges_in_order", lambda *a: made.append(out := plain(*a)) or out)
    df = spark.range(5000).select(F.lit("x").alias("place"), F.col("id").alias("t"))
    sliced = sl.in_slices(df, ["place"], ["t"], 10)
    assert sliced.where("_pos <> t or _slice <> t div 10").count() == 0 and sliced.count() == 5000
    assert made[0][1].count() <= 2
