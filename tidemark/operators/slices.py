"""Windows over long series: a series is cut into slices of bounded size, so that no series is one task.

All rows are put in order of series and time, and slices hold the same number of rows whatever the series are.  What a
window needs from before its slice comes along: rows within reach (a number of rows, or a span of time) as a halo, which is
computed with and then left out; the last value seen, which may lie any number of slices back, as a carry from slice to
slice.  A slice has one row in a broadcast table, so that table has a row per ``rows_per_slice`` input rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import add_calendar, epoch_seconds
from tidemark.operators.samples import global_ranks

ROWS_PER_SLICE = 1_000_000


def longest_series(df: DataFrame, loc: list[str]) -> int:
    """Rows of the largest series."""
    return df.groupBy(*loc).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"]


def in_slices(df: DataFrame, loc: list[str], order: list[str], rows_per_slice: int) -> DataFrame:
    """Adds ``_pos``, the place of a row in the order of series and time, and ``_slice``.

    The rows are ranked in ranges of their own size: of each range the driver gets a sample of rows, so a range per slice
    would send it a part of the input that grows as slices shrink.
    """
    ranked = global_ranks(df, [*loc, *order], "_pos")
    return ranked.withColumn("_slice", F.floor(F.col("_pos") / rows_per_slice).cast("long"))


def _same(loc: list[str]) -> Column:
    out = F.lit(True)
    for c in loc:
        out = out & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return out


def with_halo(sliced: DataFrame, loc: list[str], sec: str, rows: int, seconds: int) -> DataFrame:
    """The rows of each slice (``_own``), and those of its first series that lie up to ``rows`` rows or ``seconds`` before it."""
    begins = sliced.groupBy("_slice").agg(F.min("_pos").alias("_s_pos"), F.min_by(F.struct(*loc, F.col(sec).alias("_s_sec")), "_pos").alias("_b"))
    begins = begins.select(F.col("_slice").alias("_s_slice"), "_s_pos", "_b._s_sec", *[F.col(f"_b.{c}").alias(f"_s_{c}") for c in loc])
    near = (F.col("_s_pos") - F.col("_pos") <= rows) | (F.col("_s_sec") - F.col(sec) <= seconds)
    meets = _same(loc) & (F.col("_s_pos") > F.col("_pos")) & near
    halo = sliced.join(F.broadcast(begins), meets).withColumn("_slice", F.col("_s_slice")).select(*sliced.columns, F.lit(False).alias("_own"))
    return sliced.withColumn("_own", F.lit(True)).unionByName(halo)


def build_gold_in_slices(silver: DataFrame, loc: list[str], ts: str, v: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The rows of ``build_gold``, for series of any length."""
    timed = add_calendar(silver, ts).withColumn("_sec", epoch_seconds(ts))
    rows = with_halo(in_slices(timed, loc, ["_sec"], rows_per_slice), loc, "_sec", 24, 23 * 3600)
    w = Window.partitionBy("_slice", *loc)
    in_order, day = w.orderBy("_pos"), w.orderBy("_sec").rangeBetween(-23 * 3600, 0)
    named = {f"{v}_lag_{n}h": F.lag(v, n).over(in_order) for n in (1, 3, 24)} | {f"{v}_roll24_mean": F.avg(v).over(day), f"{v}_roll24_std": F.stddev_samp(v).over(day)}
    return rows.withColumns(named).where("_own").drop("_own", "_slice", "_pos", "_sec")


def asof_backward_in_slices(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, cols: list[str], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The rows of ``asof_backward``, for keys of any size: the newest right row is carried from slice to slice."""
    values, kept = F.struct(F.col(right_ts).alias(right_ts), *cols), F.struct(*left.columns)
    no_right = F.lit(None).cast(right.select(values.alias("v")).schema["v"].dataType)
    no_left = F.lit(None).cast(left.select(kept.alias("v")).schema["v"].dataType)
    both = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), kept.alias("_l"), no_right.alias("_r"))
    both = both.unionByName(right.select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), no_left.alias("_l"), values.alias("_r")))
    sliced = in_slices(both, keys, ["_t", "_side"], rows_per_slice)
    within = Window.partitionBy("_slice", *keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = sliced.withColumn("_found", F.last("_r", ignorenulls=True).over(within)).where("_side = 1")
    # one row per slice and key; a key that lies in one slice has nothing to carry
    newest = F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_pos")))
    ends = sliced.groupBy("_slice", *keys).agg(newest.alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).where("_carry is not null")
    carried = carried.select(F.col("_slice").alias("_s_slice"), "_carry", *[F.col(k).alias(f"_s_{k}") for k in keys])
    found = seen.join(F.broadcast(carried), (F.col("_slice") == F.col("_s_slice")) & _same(keys), "left")  # at most one row per slice
    result = F.coalesce("_found", "_carry")
    return found.withColumn("_r", result).select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in (right_ts, *cols)])
