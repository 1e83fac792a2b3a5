"""The window model against least squares by numpy, its store, and resumed fits."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast as fc
from tidemark.operators import samples as sm
from tidemark.operators.evaluate import score
from tidemark.sources import models as ms

LOC, FEATS = ["region"], ["v", "f"]
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(5)
    rows = [(r, START + dt.timedelta(hours=h), float(x), float(y)) for r in ("a", "b") for h, (x, y) in enumerate(rng.normal(size=(90, 2)).cumsum(axis=0))]
    df = spark.createDataFrame(rows, "region string, observed_at timestamp, v double, f double")
    return sm.sliding_samples(df, LOC, "observed_at", FEATS, "v", 4, 3, 2).cache()


def arrays(rows):
    rows = sorted(rows, key=lambda r: (r["anchor_ts"], r["region"]))
    return np.array([[[i[f] for f in FEATS] for i in r["inputs"]] for r in rows]), np.array([r["targets"] for r in rows])


def by_numpy(x, y, cut, mean, std, reg=1e-6):
    u = np.hstack([np.ones((len(x), 1)), ((x - mean) / std).reshape(len(x), -1)])
    k = u.shape[1]
    w = np.linalg.solve(u[:cut].T @ u[:cut] / cut + reg * np.diag([0.0] + [1.0] * (k - 1)), u[:cut].T @ y[:cut] / cut)
    return u @ w, np.mean((u[cut:] @ w - y[cut:]) ** 2)


def test_fit_and_predict_by_numpy(windows):
    x, y = arrays(windows.collect())
    cut = int(len(x) * 0.8)
    mean, std = x[:cut].reshape(-1, 2).mean(axis=0), x[:cut].reshape(-1, 2).std(axis=0)
    preds, error = by_numpy(x, y, cut, mean, std)
    for parts in (1, 7):
        model = fc.fit_windows(windows.repartition(parts), FEATS, 4, 3, LOC)
        assert np.allclose(model.mean, mean) and np.allclose(model.std, std) and model.train[0, 0] == cut
        assert np.isclose(model.val_mse, error)
    rows = sorted(score(windows, model, FEATS).collect(), key=lambda r: (r["anchor_ts"], r["region"]))
    assert np.allclose([r["preds"] for r in rows], preds) and rows[0].asDict().keys() == {*windows.columns, "preds"}


def test_missing_values_and_empty_sides(spark, windows):
    model = fc.fit_windows(windows, FEATS, 4, 3, LOC)
    hole = F.transform("inputs", lambda i: F.struct(i["v"].alias("v"), F.when(i["v"] > 1e9, 0.0).alias("f")))
    assert {tuple(r["preds"]) for r in fc.predict(windows.limit(3).withColumn("inputs", hole), model).collect()} == {(None, None, None)}
    some = windows.unionByName(windows.limit(5).withColumns({"inputs": hole, "region": F.lit("z")}))
    assert fc.fit_windows(some, FEATS, 4, 3, LOC).train[0, 0] + fc.fit_windows(some, FEATS, 4, 3, LOC).val[0, 0] == windows.count()
    assert fc.predict(windows.where("false"), model).count() == 0
    for few in (windows.limit(1), windows.where("false")):
        with pytest.raises(ValueError):
            fc.fit_windows(few, FEATS, 4, 3, LOC)
    with pytest.raises(ValueError):
        score(windows, model, ["v"])
    with pytest.raises(ValueError):
        score(windows, None, FEATS)


def test_constant_feature(spark):
    rows = [("a", START + dt.timedelta(hours=h), float(h % 5), 1.0) for h in range(60)]
    df = spark.createDataFrame(rows, "region string, observed_at timestamp, v double, f double")
    model = fc.fit_windows(sm.sliding_samples(df, LOC, "observed_at", FEATS, "v", 5, 1), FEATS, 5, 1, LOC)
    assert model.std[1] == 1.0 and model.val_mse < 1e-6


def test_store_resume_and_drift(spark, windows, tmp_path):
    root = str(tmp_path)
    early, late = windows.where("anchor_ts < timestamp'2024-01-03'"), windows.where("anchor_ts >= timestamp'2024-01-03'")
    with pytest.raises(FileNotFoundError):
        ms.load_model(spark, root)
    first = fc.fit_windows(early, FEATS, 4, 3, LOC)
    ms.save_model(spark, first, root, "v1", {"stride": 2}, data_start=dt.date(2024, 1, 1), data_end=dt.date(2024, 1, 3), n_rows=48)
    with pytest.raises(ValueError):
        ms.save_model(spark, first, root, "v1")
    again, meta = ms.load_model(spark, root)
    assert np.array_equal(again.weights(), first.weights()) and meta["version"] == "v1" and meta["n_rows"] == 48
    for feats, params in ((["f", "v"], {"stride": 2}), (FEATS, {"stride": 3})):
        with pytest.raises(ValueError):
            ms.resumable(spark, root, feats, params)
    second = fc.fit_windows(late, FEATS, 4, 3, LOC, resume=ms.resumable(spark, root, FEATS, {"stride": 2}))
    assert second.epoch == 2 and np.array_equal(second.mean, first.mean)
    x, y = arrays(early.collect())
    x2, y2 = arrays(late.collect())
    c1, c2 = int(len(x) * 0.8), int(len(x2) * 0.8)
    train = lambda a, b: np.concatenate([a[:c1], b[:c2], a[c1:], b[c2:]])
    preds, error = by_numpy(train(x, x2), train(y, y2), c1 + c2, first.mean, first.std)
    assert np.isclose(second.val_mse, error)  # as if both had been fitted at once with the first scaler
    ms.save_model(spark, second, root, "v2", {"stride": 2}, resumed_from="v1")
    worse = fc.WindowModel(FEATS, 4, 3, first.mean, first.std, first.train, first.val * 100)
    worse.val[0, 0] = first.val[0, 0]
    ms.save_model(spark, worse, root, "v3")
    best = min((first.val_mse, "v1"), (second.val_mse, "v2"))[1]
    assert ms.load_model(spark, root)[1]["version"] == best and ms.load_model(spark, root, by="latest")[1]["version"] == "v3"
    assert ms.load_model(spark, root, "v2")[1]["resumed_from"] == "v1" and ms.list_models(spark, root).count() == 3
    with pytest.raises(ValueError):
        fc.fit_windows(late, ["v"], 4, 3, LOC, resume=first)
    (tmp_path / "version=v3" / "meta" / "_SUCCESS").unlink()  # a write that was cut off
    for f in (tmp_path / "version=v3" / "meta").glob("*"):
        f.unlink()
    assert ms.load_model(spark, root, by="latest")[1]["version"] == "v2"
