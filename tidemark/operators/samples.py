"""Window samples for forecasting: anchors, inputs, targets, splits, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import instant
from tidemark.sources.tables import written


def complete_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without NULL or NaN in ``cols``."""
    return df.na.drop(subset=cols)


def trim_to_cutoff(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows up to ``days`` before the newest; all, if ``days`` is not positive."""
    if days <= 0:
        return df
    newest = df.agg(F.max(ts).alias("m")).first()["m"]  # one value
    return df.where(F.lit(False)) if newest is None else df.where(F.col(ts) <= F.lit(newest) - F.expr(f"interval {int(days)} days"))


def anchors(df: DataFrame, loc: list[str], ts: str, seq_in: int, stride: int = 1, align: str = "start") -> DataFrame:
    """Rows that end an input window: every ``stride``-th from the series' head (or its end)."""
    w = Window.partitionBy(*loc).orderBy(ts)
    rows = df.withColumn("_rn", F.row_number().over(w))
    phase = F.col("_rn") - seq_in
    if align == "end":
        rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*loc)))
        phase = F.col("_n") - F.col("_rn")
    return rows.where((F.col("_rn") >= seq_in) & (phase % max(1, stride) == 0)).drop("_rn", "_n")


def anchors_between(df: DataFrame, ts: str, lo: str | Column | None = None, hi: str | Column | None = None) -> DataFrame:
    for bound, test in ((lo, "__ge__"), (hi, "__le__")):
        if bound is not None:
            value = bound if isinstance(bound, Column) else instant(F.lit(bound).cast("timestamp_ntz"))
            df = df.where(getattr(F.col(ts), test)(value))
    return df


def sliding_samples(df: DataFrame, loc: list[str], ts: str, feats: list[str], target: str, seq_in: int, seq_out: int, stride: int = 1, require_contiguous: bool = False) -> DataFrame:
    """(loc, anchor_ts, inputs, targets): ``seq_in`` rows up to the anchor, ``seq_out`` target values after it.

    A series too short gives none.  ``seq_out=0`` gives inputs alone.  Windows that bridge a gap of the
    hourly series are kept unless ``require_contiguous``.
    """
    w = Window.partitionBy(*loc).orderBy(ts)
    rows = df.withColumn("_rn", F.row_number().over(w)).withColumn("_inputs", F.collect_list(F.struct(*feats)).over(w.rowsBetween(1 - seq_in, 0)))
    test = (F.size("_inputs") == seq_in) & ((F.col("_rn") - seq_in) % max(1, stride) == 0)
    if seq_out:
        rows = rows.withColumn("_targets", F.collect_list(F.struct(target)).over(w.rowsBetween(1, seq_out)))
        test = test & (F.size("_targets") == seq_out)
    if require_contiguous:
        rows = rows.withColumn("_from", F.first(ts).over(w.rowsBetween(1 - seq_in, 0))).withColumn("_to", F.last(ts).over(w.rowsBetween(0, seq_out)))
        test = test & ((F.col("_to").cast("long") - F.col("_from").cast("long")) == 3600 * (seq_in + seq_out - 1))
    out = rows.where(test)
    targets = F.transform("_targets", lambda t: t[target]).alias("targets") if seq_out else F.array().cast("array<double>").alias("targets")
    return out.select(*loc, F.col(ts).alias("anchor_ts"), F.col("_inputs").alias("inputs"), targets)


def ranges_in_order(df: DataFrame, order: list[str | Column], rows_per_range: int = 1_000_000) -> tuple[DataFrame, DataFrame, int]:
    """(rows with ``_at``, offsets of the ranges, number of rows): all rows in order, cut in ranges of about equal size.

    The input is computed once and written with a number per row, so that rows which tie in all of ``order`` still lie
    in different ranges; the ranges are cut at values sampled from that table.  ``_at`` holds the range and the
    place in it; with its range's ``_before`` added that is the row's place among all.  No task sorts more than a
    range, and the driver sees nothing but the number of rows.
    """
    numbered = written(df.withColumn("_id", F.monotonically_increasing_id()), "ranked-input")
    total = numbered.count()
    keys = [*order, "_id"]
    ranges = max(1, -(-total // rows_per_range), min(32, total // 2000))
    sorted_ranges = numbered.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    placed = written(sorted_ranges.withColumn("_at", F.monotonically_increasing_id()).drop("_id"), "ranked")
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")  # over one row per range
    return placed, sizes.select("_range", before.alias("_before")), total


def _with_places(placed: DataFrame, offsets: DataFrame, rank: str) -> DataFrame:
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    ranked = placed.join(F.broadcast(offsets), F.shiftright("_at", 33) == F.col("_range"))  # a row per million ranked
    return ranked.withColumn(rank, at).drop("_at", "_range", "_before")


def row_at(placed: DataFrame, offsets: DataFrame, rank: int) -> Row:
    """The row of this rank; only its range is read for it."""
    of = offsets.where(F.col("_before") <= rank).agg(F.max(F.struct("_before", "_range")).alias("r")).first()["r"]
    return placed.where(F.col("_at") == (of["_range"] << 33) + rank - of["_before"]).first()


def global_ranks(df: DataFrame, order: list[str | Column], rank: str, rows_per_range: int = 1_000_000) -> DataFrame:
    """Adds ``rank``, from 0, in the order of all rows; ties get different ranks.  Columns of any kind that has an order."""
    placed, offsets, _ = ranges_in_order(df, order, rows_per_range)
    return _with_places(placed, offsets, rank)


def chrono_split(df: DataFrame, anchor: str, tie_cols: list[str], val_fraction: float, rows_per_range: int = 1_000_000) -> DataFrame:
    """Adds ``split``: the first int(n (1 - f)) rows by anchor (ties by ``tie_cols``) are train, the rest val."""
    placed, offsets, total = ranges_in_order(df, [anchor, *tie_cols], rows_per_range)
    train = F.col("_rank") < int(total * (1.0 - val_fraction))
    return _with_places(placed, offsets, "_rank").withColumn("split", F.when(train, "train").otherwise("val")).drop("_rank")


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, mean, std): population deviation, 1 where it is zero."""
    stats = df.agg(*[F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias("std")).alias(c) for c in cols])
    return stats.select(F.explode(F.array(*cols)).alias("s")).select("s.*")


def fit_window_scaler(samples: DataFrame, cols: list[str]) -> DataFrame:
    """The same over window inputs, so a row weighs as often as windows hold it."""
    return fit_scaler(samples.select(F.explode("inputs").alias("i")).select(*[F.col(f"i.{c}").alias(c) for c in cols]), cols)


def apply_scaler(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    known = {r["column"]: r for r in stats.collect()}  # one row per feature column
    return df.withColumns({c: (F.col(c) - F.lit(known[c]["mean"])) / F.lit(known[c]["std"]) for c in cols})


def batch_ids(df: DataFrame, order: list[str], size: int, within: list[str] | None = None, rows_per_range: int = 1_000_000) -> DataFrame:
    """Fixed-size batches in order; ``within`` numbers them per group, whose first rank is taken off, however large it is."""
    ranked = global_ranks(df, [*(within or []), *order], "_rank", rows_per_range)
    if within:
        same = {c: f"_k{i}" for i, c in enumerate(within)}
        starts = ranked.groupBy(*within).agg(F.min("_rank").alias("_first")).withColumnsRenamed(same)
        meets = F.lit(True)
        for c, k in same.items():
            meets = meets & F.col(c).eqNullSafe(F.col(k))
        ranked = ranked.join(starts, meets).withColumn("_rank", F.col("_rank") - F.col("_first")).drop("_first", *same.values())
    return ranked.withColumn("batch_id", F.floor(F.col("_rank") / size).cast("long")).drop("_rank")


def evenly_spaced(df: DataFrame, order: list[str], n: int, rows_per_range: int = 1_000_000) -> DataFrame:
    """n rows at evenly spaced ranks, both ends included."""
    placed, offsets, total = ranges_in_order(df, order, rows_per_range)
    picks = sorted({int(i * (total - 1) / (n - 1)) for i in range(n)} if n > 1 else {0})
    return _with_places(placed, offsets, "_rank").where(F.col("_rank").isin(picks)).drop("_rank")


def persistence(samples: DataFrame, target: str, seq_out: int | None = None) -> DataFrame:
    """Adds ``preds``: the last input value of the target, for every horizon."""
    last = F.element_at("inputs", -1)[target]
    return samples.withColumn("preds", F.array_repeat(last, F.lit(seq_out) if seq_out is not None else F.size("targets")))


def explode_horizons(df: DataFrame, anchor: str, preds: str) -> DataFrame:
    """One row per horizon: h_ahead = 1.., target_time = anchor + h hours, predicted_value."""
    keep = [c for c in df.columns if c != preds]
    long = df.select(*keep, F.posexplode(preds).alias("_k", "predicted_value"))
    h = F.col("_k") + 1
    return long.withColumn("h_ahead", h).withColumn("target_time", F.timestamp_add("HOUR", h, F.col(anchor))).drop("_k")
