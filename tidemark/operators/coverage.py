"""Which dates are covered, and what work is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def date_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """All dates from start to end, both included; none if they are inverted."""
    bounds = spark.range(1).select(F.lit(start).cast("date").alias("s"), F.lit(end).cast("date").alias("e")).where("s <= e")
    return bounds.select(F.explode(F.sequence("s", "e")).alias("date"))


def year_chunks(df: DataFrame, start: str, end: str) -> DataFrame:
    """Each row's range cut at calendar years: chunk_start, chunk_end."""
    years = df.where(F.col(start) <= F.col(end)).withColumn("_y", F.explode(F.sequence(F.year(start), F.year(end))))
    return years.withColumn("chunk_start", F.greatest(F.col(start), F.make_date("_y", F.lit(1), F.lit(1)))).withColumn("chunk_end", F.least(F.col(end), F.make_date("_y", F.lit(12), F.lit(31)))).drop("_y")


def missing_dates(requested: DataFrame, present: DataFrame) -> DataFrame:
    return requested.select("date").join(present.select("date").distinct(), "date", "left_anti")


def chunks_with_gaps(chunks: DataFrame, missing: DataFrame) -> DataFrame:
    """Chunks that hold a missing date; each chunk's dates meet the missing ones by equality."""
    ids = [c for c in chunks.columns]
    dates = chunks.withColumn("date", F.explode(F.sequence("chunk_start", "chunk_end")))
    return dates.join(missing.select("date").distinct(), "date", "left_semi").select(*ids).distinct()


def work_list(locations: DataFrame, chunks: DataFrame, missing: DataFrame, force: bool = False) -> DataFrame:
    """Every location with every chunk that is due: those with gaps, or all with ``force``.

    The chunks (one per calendar year asked for) are gathered into one array, so locations are
    expanded in place.
    """
    due = chunks if force else chunks_with_gaps(chunks, missing)
    years = due.agg(F.array_sort(F.collect_set(F.struct("chunk_start", "chunk_end"))).alias("c")).first()["c"]
    if not years:
        return locations.limit(0).select("*", F.lit(None).cast("date").alias("chunk_start"), F.lit(None).cast("date").alias("chunk_end"))
    listed = F.array(*[F.struct(F.lit(y["chunk_start"]).alias("chunk_start"), F.lit(y["chunk_end"]).alias("chunk_end")) for y in years])
    return locations.withColumn("_c", F.explode(listed)).select(*locations.columns, "_c.chunk_start", "_c.chunk_end")


def merge_coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def coverage_report(requested: DataFrame, present: DataFrame, added: DataFrame) -> DataFrame:
    """One row: dates present, newly added, requested and missing."""
    n = F.count("*").alias
    have, want = present.select("date").distinct(), requested.select("date").distinct()
    parts = [
        have.agg(n("n")).withColumn("k", F.lit("present")),
        added.select("date").distinct().join(have, "date", "left_anti").agg(n("n")).withColumn("k", F.lit("added")),
        want.agg(n("n")).withColumn("k", F.lit("requested")),
        missing_dates(want, have).agg(n("n")).withColumn("k", F.lit("missing")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.groupBy().pivot("k", ["present", "added", "requested", "missing"]).agg(F.sum("n"))


def run_stats(log: DataFrame) -> DataFrame:
    """requested, succeeded, failed, rows and skipped of an ingest log (ok, rows, skipped); a skipped chunk is not requested."""
    did = ~F.coalesce(F.col("skipped"), F.lit(False)) if "skipped" in log.columns else F.lit(True)
    rows = F.coalesce(F.sum(F.when(did & F.col("ok"), F.col("rows"))), F.lit(0)).cast("long")
    return log.agg(F.count_if(did).alias("requested"), F.count_if(did & F.col("ok")).alias("succeeded"), F.count_if(did & ~F.col("ok")).alias("failed"), rows.alias("rows"), F.count_if(~did).alias("skipped"))
