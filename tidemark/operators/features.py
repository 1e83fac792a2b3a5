"""Silver clean-up and gold features."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import add_calendar, epoch_seconds


def dedupe_latest(df: DataFrame, keys: Iterable[str], order: Iterable[Column]) -> DataFrame:
    """The first row of each key by ``order`` (for instance newest run first, then a unique column)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def add_lags(df: DataFrame, loc: list[str], ts: str, v: str, lags: Iterable[int] = (1, 3, 24)) -> DataFrame:
    """``v`` of the n-th row before, per location in time order."""
    w = Window.partitionBy(*loc).orderBy("_sec")
    return df.withColumn("_sec", epoch_seconds(ts)).withColumns({f"{v}_lag_{n}h": F.lag(v, n).over(w) for n in lags}).drop("_sec")


def add_rolling(df: DataFrame, loc: list[str], ts: str, v: str, hours: int = 23) -> DataFrame:
    """Mean and sample deviation of ``v`` over [t - hours, t]; a time range, not a row count."""
    w = Window.partitionBy(*loc).orderBy("_sec").rangeBetween(-hours * 3600, 0)
    named = {f"{v}_roll{hours + 1}_mean": F.avg(v).over(w), f"{v}_roll{hours + 1}_std": F.stddev_samp(v).over(w)}
    return df.withColumn("_sec", epoch_seconds(ts)).withColumns(named).drop("_sec")


def build_gold(silver: DataFrame, loc: list[str], ts: str, v: str) -> DataFrame:
    """Calendar, lag and rolling features; all windows share one exchange and one sort order."""
    w = Window.partitionBy(*loc).orderBy("_sec")
    day = w.rangeBetween(-23 * 3600, 0)
    named = {f"{v}_lag_{n}h": F.lag(v, n).over(w) for n in (1, 3, 24)} | {f"{v}_roll24_mean": F.avg(v).over(day), f"{v}_roll24_std": F.stddev_samp(v).over(day)}
    return add_calendar(silver, ts).withColumn("_sec", epoch_seconds(ts)).withColumns(named).drop("_sec")
