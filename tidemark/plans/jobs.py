"""Composed jobs: lake layers, star load, walk-forward, backfill, score refresh, ingest plan.

Every job that reads a layer begins with the same test: where there is no layer, or no row in it, nothing is changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import utc_date
from tidemark.functions.labels import walkforward_version
from tidemark.operators import coverage as cov
from tidemark.operators import evaluate as ev
from tidemark.operators import samples as sm
from tidemark.operators.features import build_gold, dedupe_latest
from tidemark.operators.slices import ROWS_PER_SLICE, build_gold_in_slices, longest_series
from tidemark.operators.star import build_fact, location_dim, time_dim
from tidemark.operators.upsert import absent, one_per_key, upsert
from tidemark.sources import jdbc
from tidemark.sources.bronze import MEASURES, bronze_schema, flatten_hourly, read_bronze, split_valid
from tidemark.sources.tables import STAR, filled_layer, scan_coverage, write_layer
from tidemark.sources.warehouse import Warehouse, load_new_keys

PLACE = ["region", "lat", "lon"]
LEDGER_KEYS = ["location_id", "model_version", "prediction_made_at", "target_time"]


def bronze_to_silver(spark: SparkSession, src: str, dst: str, measures: list[str] = MEASURES) -> DataFrame:
    """Flatten landed documents; the newest run (then the last file) wins per key.  Returns the quarantine.

    Where nothing has landed nothing is written, and the quarantine is empty.
    """
    try:
        bronze = read_bronze(spark, src, measures)
    except FileNotFoundError:
        return spark.createDataFrame([], bronze_schema(measures))
    bronze = bronze.withColumn("_file", F.col("_metadata.file_path"))
    if "run_ts" not in bronze.columns:
        bronze = bronze.withColumn("run_ts", F.lit(None).cast("string"))
    valid, quarantine = split_valid(bronze)
    kept = valid.withColumnsRenamed({"latitude": "lat", "longitude": "lon"}).withColumn("run_ts", F.col("run_ts").cast("string"))
    rows = flatten_hourly(kept, measures, keep=["region", "dataset", "marz", "lat", "lon", "elevation", "run_ts", "_file"]).where("observed_at is not null")
    silver = dedupe_latest(rows, ["region", "dataset", "marz", "lat", "lon", "observed_at"], [F.desc_nulls_last("run_ts"), F.desc("_file")])
    write_layer(silver.drop("run_ts", "_file").withColumn("date", utc_date("observed_at")), dst)
    return quarantine


def silver_to_gold(spark: SparkSession, src: str, dst: str, target: str = "temperature_2m", loc: list[str] | None = None, rows_per_slice: int = ROWS_PER_SLICE) -> None:
    """Gold features of a silver layer; series longer than ``rows_per_slice`` are worked on in slices, with the same result."""
    silver, loc = filled_layer(spark, src), loc or ["region", "dataset", "lat", "lon"]
    if silver is None:
        return
    if longest_series(silver, loc) > rows_per_slice:
        gold = build_gold_in_slices(silver, loc, "observed_at", target, rows_per_slice)
    else:
        gold = build_gold(silver, loc, "observed_at", target)
    write_layer(gold, dst)


def current_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return Warehouse(spark, root, recover=False).table(name)


def load_star(spark: SparkSession, silver: str, root: str, measures: list[str] = MEASURES, house: Warehouse | None = None) -> bool:
    """Insert new keys of the dimensions (ids are kept), then replace the fact; running it again changes nothing.

    Returns whether there was anything to load.
    """
    house = house or Warehouse(spark, root, measures)
    rows = filled_layer(spark, silver)
    if rows is None:
        return False
    rows = rows.drop("region").withColumnRenamed("marz", "region")
    places = load_new_keys(house, "dim_location", location_dim(rows, PLACE, ["elevation"], "observed_at"), PLACE, "location_id")
    times = load_new_keys(house, "dim_time", time_dim(rows, "observed_at"), ["date", "observed_at"], "time_id")
    house.refresh("fact", build_fact(rows, places, times, PLACE, measures))
    return True


def create_star_in_database(spark: SparkSession, options: dict, measures: list[str] = MEASURES) -> None:
    """The star's dimensions and fact in a database that numbers keys itself, where they are missing."""
    kinds = {"STRING": "VARCHAR(200)", "DOUBLE": "DOUBLE PRECISION", "BIGINT": "BIGINT", "TIMESTAMP": "TIMESTAMP", "DATE": "DATE", "SMALLINT": "SMALLINT", "BOOLEAN": "BOOLEAN"}
    tables = {n: STAR[n][0].split(", ") for n in ("dim_location", "dim_time")}
    tables["fact"] = ["location_id BIGINT", "time_id BIGINT", "dataset STRING", *(f"{m} DOUBLE" for m in measures)]
    for name, columns in tables.items():
        if not jdbc.has_table(spark, options, name):
            typed = [f"{jdbc.quoted(spark, options, [c])[0]} {kinds[k]}" for c, k in (x.split() for x in columns)]
            if name != "fact":
                typed[0] += " GENERATED ALWAYS AS IDENTITY PRIMARY KEY"
            jdbc.execute(spark, options, f"CREATE TABLE {name} ({', '.join(typed)})")


def load_star_to_database(spark: SparkSession, silver: str, options: dict, measures: list[str] = MEASURES, partitions: int = 8) -> bool:
    """The same load into a database: it gives the ids, which are read back by ranges."""
    rows = filled_layer(spark, silver)
    if rows is None:
        return False
    create_star_in_database(spark, options, measures)
    rows = rows.drop("region").withColumnRenamed("marz", "region")
    jdbc.append_absent(location_dim(rows, PLACE, ["elevation"], "observed_at"), options, "dim_location", PLACE)
    jdbc.append_absent(time_dim(rows, "observed_at"), options, "dim_time", ["observed_at"])
    places, times = (jdbc.read_table(spark, options, f"dim_{n}", f"{n}_id", partitions) for n in ("location", "time"))
    jdbc.replace_rows(build_fact(rows, places, times, PLACE, measures), options, "fact")
    return True


def run_walk_forward(spark: SparkSession, gold: DataFrame, root: str, version: str, feats: list[str], target: str, seq_in: int, seq_out: int, stride: int = 1, lookback_days: int | None = None, models: object | None = None) -> DataFrame:
    """Predict at every anchor, append what is new, fill in actuals, score the complete groups.

    ``models``: a ``WindowModel``, or Spark ML models by horizon; persistence where none is given.
    """
    house, label = Warehouse(spark, root), f"walkforward:{version}"
    rows = sm.complete_rows(gold, feats)
    samples = sm.sliding_samples(rows, PLACE, "observed_at", feats, target, seq_in, 0, stride)
    if lookback_days is not None:
        newest = gold.agg(F.max("observed_at")).first()[0]
        samples = sm.anchors_between(samples, "anchor_ts", F.lit(newest) - F.expr(f"interval {int(lookback_days)} days"), F.lit(newest))
    scored = ev.score(samples, models, feats) if models else sm.persistence(samples, target, seq_out)
    preds = ev.walk_forward(scored, PLACE, walkforward_version(F.lit(version)), seq_in)
    places = house.table("dim_location")
    skipped = preds.select(*PLACE).distinct().join(places, PLACE, "left_anti")
    append_predictions(house, preds.join(places.select("location_id", *PLACE), PLACE))
    backfill(spark, root, target, label)
    refresh_scores(spark, root, label)
    return ev.walk_forward_report(house.table("predictions").where(F.col("model_version") == label), skipped)


def append_predictions(house: Warehouse, preds: DataFrame) -> None:
    """Add the predictions whose key the ledger lacks.  Of the ledger only the versions and target dates at hand are read; nothing is rewritten."""
    blank = {"actual_value": F.lit(None).cast("double"), "actual_filled_at": F.lit(None).cast("timestamp"), "target_date": utc_date("target_time")}
    new = preds.withColumns(blank).select(*house.table("predictions").columns)
    with house.staged(new, "predictions") as staged:
        touched = staged.select("model_version", "target_date").distinct()
        have = house.table("predictions").join(F.broadcast(touched), ["model_version", "target_date"], "left_semi")  # one row per partition
        house.append("predictions", absent(have, staged, LEDGER_KEYS))


def backfill(spark: SparkSession, root: str, v: str, version: str | None = None) -> int:
    """Fill in actual values; returns how many were filled.

    The values that are due form a delta; only the partitions (version and target date) that it touches are written.
    """
    house = Warehouse(spark, root)
    ledger = house.table("predictions")
    if version is not None:
        ledger = ledger.where(F.col("model_version") == version)
    due = ledger.where("actual_value is null").select(*LEDGER_KEYS, "target_date")
    actual = one_per_key(ev.actual_values(house.table("fact"), house.table("dim_time"), v), ["location_id", "target_time"])
    found = due.join(actual, ["location_id", "target_time"]).withColumn("filled_at", F.current_timestamp())
    with house.staged(found, "actuals") as delta:
        n = delta.count()
        if n:
            touched = delta.select("model_version", "target_date").distinct()
            rows = house.table("predictions").join(F.broadcast(touched), ["model_version", "target_date"], "left_semi")  # one row per partition
            merged = rows.join(delta.drop("target_date"), LEDGER_KEYS, "left")
            filled = {"actual_value": F.coalesce("actual_value", "observed"), "actual_filled_at": F.coalesce("actual_filled_at", "filled_at")}
            house.replace("predictions", merged.withColumns(filled))
    return n


def refresh_scores(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """Score the complete groups, of all versions or one; versions without any keep their partition as it is."""
    house = Warehouse(spark, root)
    ledger, old = house.table("predictions"), house.table("scored_groups")
    if version is not None:
        ledger, old = (t.where(F.col("model_version") == version) for t in (ledger, old))
    scored = ev.score_groups(ledger).withColumn("computed_at", F.current_timestamp()).select(*old.columns)
    with house.staged(scored, "scores") as new:
        house.replace("scored_groups", upsert(old, new, ["location_id", "model_version", "prediction_made_at"]))
    return house.table("scored_groups")


def ingest_plan(spark: SparkSession, locations: DataFrame, present: DataFrame, start: str, end: str, force: bool = False) -> DataFrame:
    """The chunks to fetch, per location, for the dates from start to end that are not covered."""
    wanted = cov.date_range(spark, start, end)
    window = spark.range(1).select(F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))
    chunks = cov.year_chunks(window, "start", "end").select("chunk_start", "chunk_end")
    return cov.work_list(locations, chunks, cov.missing_dates(wanted, present), force)


def merge_if_clean(manifest: DataFrame, log: DataFrame, wanted: DataFrame, dataset: str) -> DataFrame:
    """The manifest with the ingested dates, unless a chunk failed."""
    if not log.where("not ok").isEmpty():
        return manifest
    return cov.merge_coverage(manifest.select("dataset", "date"), wanted.select(F.lit(dataset).alias("dataset"), "date"))


__all__ = ["append_predictions", "backfill", "bronze_to_silver", "current_table", "ingest_plan", "load_star", "load_star_to_database", "merge_if_clean", "refresh_scores", "run_walk_forward", "scan_coverage", "silver_to_gold"]
