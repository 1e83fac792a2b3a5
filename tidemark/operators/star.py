"""Star schema: dimensions and fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import add_calendar, utc_date


def location_dim(df: DataFrame, loc: list[str], attrs: list[str], ts: str) -> DataFrame:
    """One row per location; its attributes are those of its newest row."""
    return df.groupBy(*loc).agg(*[F.max_by(a, F.struct(F.col(ts), F.col(a))).alias(a) for a in attrs])


def time_dim(df: DataFrame, ts: str) -> DataFrame:
    times = df.select(F.col(ts).alias("observed_at")).where("observed_at is not null").distinct()
    return add_calendar(times.withColumn("date", utc_date("observed_at")), "observed_at", "dim")


def build_fact(silver: DataFrame, dim_loc: DataFrame, dim_time: DataFrame, loc: list[str], measures: list[str]) -> DataFrame:
    """Surrogate keys, dataset and measures.  Sizes of the dimensions decide the joins at run time."""
    keyed = silver.join(dim_loc.select("location_id", *loc), loc).join(dim_time.select("time_id", "observed_at"), "observed_at")
    return keyed.select("location_id", "time_id", "dataset", *measures)
