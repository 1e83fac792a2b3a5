"""Dashboard and status queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import utc_date


def latest_per_location(fact: DataFrame, dim_loc: DataFrame, dim_time: DataFrame, v: str) -> DataFrame:
    """Every location with its newest archive value, or NULL if there is none."""
    rows = fact.where((F.col("dataset") == "archive") & F.col(v).isNotNull()).join(dim_time.select("time_id", "observed_at"), "time_id")
    newest = rows.groupBy("location_id").agg(F.max(F.struct("observed_at", v)).alias("_m"))
    return dim_loc.join(newest, "location_id", "left").select(*dim_loc.columns, F.col("_m.observed_at").alias("observed_at"), F.col(f"_m.{v}").alias(v)).orderBy(*[c for c in ("region", "location_id") if c in dim_loc.columns])


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, cols: list[str]) -> DataFrame:
    """Each left row with the newest right row at or before it: one union, one exchange, no range join."""
    values = F.struct(F.col(right_ts).alias(right_ts), *cols)
    kept = F.struct(*left.columns)
    both = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), kept.alias("_l"), F.lit(None).cast(right.select(values.alias("v")).schema["v"].dataType).alias("_r"))
    both = both.unionByName(right.select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(kept.alias("v")).schema["v"].dataType).alias("_l"), values.alias("_r")))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return found.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in (right_ts, *cols)])


def series(fact: DataFrame, dim_time: DataFrame, v: str, location: int | None = None) -> DataFrame:
    """(observed_at, v) of one location, or the mean over all."""
    rows = fact.where((F.col("dataset") == "archive") & F.col(v).isNotNull())
    if location is not None:
        rows = rows.where(F.col("location_id") == location)
    return rows.join(dim_time.select("time_id", "observed_at"), "time_id").groupBy("observed_at").agg(F.avg(v).alias(v)).orderBy("observed_at")


def snapshots(preds: DataFrame, location: int | None = None, n: int = 50) -> DataFrame:
    """The n newest forecast runs with their hours; ``is_latest`` marks the newest."""
    rows = preds if location is None else preds.where(F.col("location_id") == location)
    runs = rows.groupBy("prediction_made_at").agg(F.countDistinct("target_time").alias("n_hours")).orderBy(F.desc("prediction_made_at")).limit(n)
    return runs.withColumn("is_latest", F.row_number().over(Window.orderBy(F.desc("prediction_made_at"))) == 1)  # over n rows


def snapshot_values(preds: DataFrame, runs: DataFrame | list, location: int | None = None) -> DataFrame:
    """Mean predicted and actual values of the forecast runs in ``runs``: a table with ``prediction_made_at``, or a list of times."""
    rows = preds.join(runs.select("prediction_made_at"), "prediction_made_at", "left_semi") if isinstance(runs, DataFrame) else preds.where(F.col("prediction_made_at").isin(runs))
    rows = rows if location is None else rows.where(F.col("location_id") == location)
    return rows.groupBy("target_time", "prediction_made_at").agg(F.avg("predicted_value").alias("predicted"), F.avg("actual_value").alias("actual")).orderBy("target_time", "prediction_made_at")


def best_groups(groups: DataFrame, preds: DataFrame, dim_loc: DataFrame, location: int | None = None, n: int = 200) -> DataFrame:
    """Per location and run the best version, the n best of them, with names and the window length."""
    rows = groups if location is None else groups.where(F.col("location_id") == location)
    best = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("location_id", "prediction_made_at").orderBy("mse", "model_version"))).where("_rn = 1").drop("_rn")
    length = preds.groupBy("location_id", "model_version", "prediction_made_at").agg(F.max("seq_in").alias("seq_in"))
    named = best.join(dim_loc.select("location_id", "region"), "location_id").join(length, ["location_id", "model_version", "prediction_made_at"], "left")
    return named.orderBy("mse", "location_id", "prediction_made_at").limit(n)


def anchor_actual(preds: DataFrame, fact: DataFrame, dim_time: DataFrame, v: str) -> DataFrame:
    """The archive value at each group's anchor."""
    groups = preds.select("location_id", "model_version", "prediction_made_at").distinct()
    rows = fact.where(F.col("dataset") == "archive").join(dim_time.select("time_id", "observed_at"), "time_id").select("location_id", F.col("observed_at").alias("prediction_made_at"), F.col(v).alias("anchor_value"))
    return groups.join(rows, ["location_id", "prediction_made_at"])


def fact_summary(fact: DataFrame, dim_time: DataFrame) -> DataFrame:
    return fact.join(dim_time.select("time_id", "observed_at"), "time_id").agg(F.count("*").alias("n_rows"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))


def prediction_summary(preds: DataFrame) -> DataFrame:
    return preds.agg(F.count("*").alias("n_rows"), F.countDistinct("prediction_made_at").alias("n_snapshots"), F.count_if(F.col("actual_value").isNotNull()).alias("n_filled"), F.max("prediction_made_at").alias("latest"))


def hottest(fact: DataFrame, dim_loc: DataFrame, v: str, by: list[str]) -> DataFrame:
    """Largest value per place, hottest first."""
    return fact.join(dim_loc, "location_id").groupBy(*by).agg(F.max(v).alias(f"max_{v}")).orderBy(F.desc(f"max_{v}"), *by)


def rows_per_partition(df: DataFrame, parts: list[str]) -> DataFrame:
    return df.groupBy(*parts).agg(F.count("*").alias("n_rows"))


def provenance(df: DataFrame, loc: list[str], ts: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(*loc).alias("n_locations"), F.min(utc_date(ts)).alias("first_date"), F.max(utc_date(ts)).alias("last_date"))


def bounds(df: DataFrame, v: str, lo: float = 0.0, hi: float = 30.0) -> DataFrame:
    """(lo, hi) of a value with defaults, and padded axis bounds."""
    span = df.agg(F.coalesce(F.min(v), F.lit(lo)).alias("lo"), F.coalesce(F.max(v), F.lit(hi)).alias("hi"))
    pad = F.greatest(F.lit(0.5), (F.col("hi") - F.col("lo")) * 0.08)
    return span.withColumns({"axis_lo": F.col("lo") - pad, "axis_hi": F.col("hi") + pad})


def visible_range(actuals: DataFrame, preds: DataFrame, pad_days: int = 1) -> DataFrame:
    """Actuals from ``pad_days`` before the first to the last predicted time."""
    r = preds.agg(F.min("target_time").alias("a"), F.max("target_time").alias("b")).first()
    if r["a"] is None:
        return actuals
    return actuals.where((F.col("observed_at") >= F.lit(r["a"]) - F.expr(f"interval {int(pad_days)} days")) & (F.col("observed_at") <= F.lit(r["b"])))


def with_metadata(df: DataFrame, meta: DataFrame, on: str = "region") -> DataFrame:
    return df.join(meta, on, "left")


def best_geocode(cands: DataFrame, here: Column, name: str = "query") -> DataFrame:
    """Per name the match of the largest population (none counts as 0), the earliest on ties; coordinates to 4 decimals."""
    w = Window.partitionBy(name).orderBy(F.desc(F.coalesce("population", F.lit(0))), "position")
    best = cands.where(here).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return best.withColumns({"latitude": F.round("latitude", 4), "longitude": F.round("longitude", 4), "population": F.coalesce("population", F.lit(0).cast("long"))})
