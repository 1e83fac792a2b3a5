"""Predictions ledger: actuals, scores and error metrics; model fitting per horizon."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.forecast import WindowModel, predict


def actual_values(fact: DataFrame, dim_time: DataFrame, v: str) -> DataFrame:
    """(location_id, target_time, observed) of archive rows that have the measure."""
    rows = fact.where((F.col("dataset") == "archive") & F.col(v).isNotNull()).join(dim_time.select("time_id", "observed_at"), "time_id")
    return rows.select("location_id", F.col("observed_at").alias("target_time"), F.col(v).alias("observed"))


def backfill_actuals(preds: DataFrame, fact: DataFrame, dim_time: DataFrame, v: str, version: str | None = None, now: Column | None = None) -> DataFrame:
    """Unfilled predictions get the observed value of their target time; adds ``filled_now``."""
    due = F.col("actual_value").isNull()
    if version is not None:
        due = due & (F.col("model_version") == version)
    joined = preds.join(actual_values(fact, dim_time, v), ["location_id", "target_time"], "left")
    hit = due & F.col("observed").isNotNull()
    out = joined.withColumn("filled_now", hit).withColumn("actual_value", F.when(hit, F.col("observed")).otherwise(F.col("actual_value")))
    return out.withColumn("actual_filled_at", F.when(hit, now if now is not None else F.current_timestamp()).otherwise(F.col("actual_filled_at"))).drop("observed")


def score_groups(preds: DataFrame, prefix: str = "walkforward:") -> DataFrame:
    """(location_id, model_version, prediction_made_at, n_hours, mse) of complete groups."""
    e = F.col("predicted_value") - F.col("actual_value")
    groups = preds.where(F.col("model_version").startswith(prefix)).groupBy("location_id", "model_version", "prediction_made_at")
    scored = groups.agg(F.count("*").alias("n_hours"), F.count("actual_value").alias("_known"), F.avg(e * e).alias("mse"))
    return scored.where("n_hours = _known").drop("_known")


def error_metrics(df: DataFrame, pred: str, true: str, by: list[str] | None = None, eps: float = 1e-3) -> DataFrame:
    """mae, rmse and mape (a true value below eps in size counts as eps), pooled or per group."""
    e, t = F.col(pred) - F.col(true), F.col(true)
    base = F.when(F.abs(t) < eps, F.lit(eps)).otherwise(t)
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.abs(e / base)) * 100).alias("mape"))


def walk_forward(samples: DataFrame, loc: list[str], version: Column, seq_in: int) -> DataFrame:
    """Long-form predictions of scored samples (anchor_ts, preds): one row per location, anchor and horizon."""
    from tidemark.operators.samples import explode_horizons

    long = explode_horizons(samples.select(*loc, "anchor_ts", "preds"), "anchor_ts", "preds")
    return long.select(*loc, version.alias("model_version"), F.col("anchor_ts").alias("prediction_made_at"), "target_time", "h_ahead", "predicted_value", F.lit(seq_in).alias("seq_in"))


def walk_forward_report(preds: DataFrame, skipped: DataFrame) -> DataFrame:
    """rows, anchors, cells and skipped cells of a walk-forward run."""
    n_skipped = skipped.count()
    return preds.agg(F.count("*").alias("rows"), F.countDistinct("location_id", "prediction_made_at").alias("anchors"), F.countDistinct("location_id").alias("cells")).withColumn("skipped", F.lit(n_skipped))


def fit_horizons(train: DataFrame, feats: list[str], seq_out: int, regressor: Callable | None = None) -> dict:
    """One Spark ML model per horizon, on the last input row's features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    flat = train.select(*[F.element_at("inputs", -1)[f].cast("double").alias(f) for f in feats], "targets")
    make = regressor or (lambda label: LinearRegression(featuresCol="_x", labelCol=label, predictionCol=f"{label}_pred", solver="normal"))
    assembler = VectorAssembler(inputCols=feats, outputCol="_x")
    return {h: Pipeline(stages=[assembler, make(f"h{h}")]).fit(flat.withColumn(f"h{h}", F.get("targets", F.lit(h - 1)))) for h in range(1, seq_out + 1)}


def holdout_report(samples: DataFrame, target: str, eps: float = 1e-3) -> DataFrame:
    """Errors of scored hold-out samples (inputs, targets, preds) beside those of persistence.

    One row per horizon, and one over all with h_ahead 0: n, mae, rmse, mape, persistence_mae, persistence_rmse.
    """
    last = F.element_at("inputs", -1)[target]
    long = samples.select(last.alias("_last"), F.posexplode(F.arrays_zip("preds", "targets")).alias("_k", "_z"))
    t, e, p = F.col("_z.targets"), F.col("_z.preds") - F.col("_z.targets"), F.col("_last") - F.col("_z.targets")
    base = F.when(F.abs(t) < eps, F.lit(eps)).otherwise(t)
    metrics = [F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.abs(e / base)) * 100).alias("mape"), F.avg(F.abs(p)).alias("persistence_mae"), F.sqrt(F.avg(p * p)).alias("persistence_rmse")]
    grouped = long.withColumn("h_ahead", F.col("_k") + 1).rollup("h_ahead").agg(*metrics)
    return grouped.withColumn("h_ahead", F.coalesce("h_ahead", F.lit(0)))


def score(samples: DataFrame, models: object, feats: list[str]) -> DataFrame:
    """Adds ``preds`` in horizon order, by a ``WindowModel`` or by one Spark ML model per horizon; refuses to run without."""
    if not models:
        raise ValueError("no fitted model")
    if isinstance(models, WindowModel):
        return predict(samples, models, feats)
    out = samples.select("*", *[F.element_at("inputs", -1)[f].cast("double").alias(f) for f in feats if f not in samples.columns])
    for model in models.values():
        out = model.transform(out).drop("_x")
    return out.select(*samples.columns, F.array(*[F.col(f"h{h}_pred") for h in sorted(models)]).alias("preds"))


def score_with(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """A user's scoring function over Arrow batches as pandas frames."""
    return df.mapInPandas(fn, schema)


def check_compatible(saved: dict, feats: list[str], params: dict) -> tuple[int, float]:
    """Refuse features or parameters other than the saved ones; returns (next epoch, best score)."""
    if list(saved.get("feature_columns", [])) != list(feats):
        raise ValueError("feature columns differ from the saved ones")
    for k, v in params.items():
        if saved.get("hyperparams", {}).get(k, v) != v:
            raise ValueError(f"parameter {k} differs from the saved one")
    return int(saved.get("epoch", 0)) + 1, float(saved.get("best_val_mse", float("inf")))


def best_run(runs: DataFrame, by: str = "metric") -> DataFrame:
    """The run with the least metric, or (``by='latest'``) the newest version."""
    pick = F.max_by(F.struct(*runs.columns), "version") if by == "latest" else F.min_by(F.struct(*runs.columns), F.struct(by, "version"))
    return runs.agg(pick.alias("r")).select("r.*")
