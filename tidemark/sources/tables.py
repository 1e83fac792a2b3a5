"""Lake layers and tables as Parquet, with the table statements of a star schema."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.bronze import MEASURES
from tidemark.sources.files import any_match, files_per_layer, folder_exists, list_coverage

#: Columns, keys and parents of the star's tables.
STAR = {
    "dim_location": ("location_id BIGINT, region STRING, lat DOUBLE, lon DOUBLE, elevation DOUBLE", []),
    "dim_time": ("time_id BIGINT, observed_at TIMESTAMP, date DATE, hour SMALLINT, day_of_week SMALLINT, month SMALLINT, year SMALLINT, season STRING, is_weekend BOOLEAN", []),
    "fact": ("location_id BIGINT, time_id BIGINT, " + ", ".join(f"{m} DOUBLE" for m in MEASURES) + ", dataset STRING", ["dataset"]),
    "predictions": ("location_id BIGINT, prediction_made_at TIMESTAMP, target_time TIMESTAMP, predicted_value DOUBLE, actual_value DOUBLE, actual_filled_at TIMESTAMP, seq_in INT, model_version STRING, target_date DATE", ["model_version", "target_date"]),
    "scored_groups": ("location_id BIGINT, prediction_made_at TIMESTAMP, n_hours BIGINT, mse DOUBLE, computed_at TIMESTAMP, model_version STRING", ["model_version"]),
}


def star_tables(measures: Iterable[str] = MEASURES) -> dict[str, tuple[str, list[str]]]:
    """``STAR``, its fact with these measures."""
    columns = ", ".join(["location_id BIGINT", "time_id BIGINT", *(f"{m} DOUBLE" for m in measures), "dataset STRING"])
    return {**STAR, "fact": (columns, ["dataset"])}


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share; a temporary one where that is unset on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-lake-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new shared folder and read back: computed once, whatever reads it and whichever executor is lost."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_layer(df: DataFrame, path: str, mode: str = "dynamic", parts: Iterable[str] = ("dataset", "date")) -> None:
    """``dynamic`` replaces just the partitions that ``df`` has, ``static`` the whole layer."""
    df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*parts).parquet(path)


def read_layer(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, dataset: str | None = None) -> DataFrame:
    """A layer, pruned to the partitions between ``start`` and ``end`` (inclusive) and of ``dataset``."""
    df = spark.read.parquet(path)
    if dataset is not None:
        df = df.where(F.col("dataset") == dataset)
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def filled_layer(spark: SparkSession, path: str) -> DataFrame | None:
    """A layer that has rows; None where there is no folder, no file or no row, and so nothing to do for a job."""
    if not any_match(spark, f"{path}/[!_.]*"):
        return None
    df = read_layer(spark, path)
    return None if df.isEmpty() else df


def register_external(spark: SparkSession, name: str, path: str) -> None:
    """A catalog table over a layer's files, with its partitions registered."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING PARQUET LOCATION '{path}'")
    if any(c.isPartition for c in spark.catalog.listColumns(name)):
        spark.sql(f"MSCK REPAIR TABLE {name}")


def create_tables(spark: SparkSession, database: str = "default", names: Iterable[str] | None = None) -> None:
    for name in names or STAR:
        columns, parts = STAR[name]
        by = f" PARTITIONED BY ({', '.join(parts)})" if parts else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING PARQUET{by}")


def add_column_if_absent(spark: SparkSession, table: str, column: str, kind: str) -> bool:
    if column in spark.table(table).columns:
        return False
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({column} {kind})")
    return True


def clear_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"TRUNCATE TABLE {table}")


def append_absent(spark: SparkSession, new: DataFrame, path: str, keys: list[str], parts: Iterable[str] = ()) -> None:
    """Append the rows whose key is not there yet; running it again changes nothing."""
    from tidemark.operators.upsert import absent

    have = spark.read.schema(new.schema).parquet(path) if folder_exists(spark, path) else new.limit(0)
    absent(have, new, keys).write.mode("append").partitionBy(*parts).parquet(path)


def scan_coverage(df: DataFrame, dataset: str = "dataset", date: str = "date") -> DataFrame:
    """Distinct (dataset, date); on a layer these are partition columns, so no data column is read."""
    return df.select(F.col(dataset).alias("dataset"), F.col(date).cast("date").alias("date")).where("date is not null").distinct()


def load_or_scan(spark: SparkSession, manifest: str, layer: str) -> DataFrame:
    """The saved coverage manifest, or a listing of the layer's folders that is then saved."""
    if not folder_exists(spark, f"{manifest}/_SUCCESS"):
        list_coverage(spark, layer).withColumn("scanned_at", F.current_timestamp()).write.mode("overwrite").parquet(manifest)
    return spark.read.parquet(manifest)


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """Per-horizon metrics with four decimals."""
    rounded = df.select("h_ahead", *[F.format_string("%.4f", F.col(c)).alias(c) for c in df.columns if c != "h_ahead"])
    rounded.orderBy("h_ahead").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def record_run(spark: SparkSession, meta: dict, path: str) -> None:
    """One row of run provenance, as JSON."""
    import json

    spark.createDataFrame([(json.dumps(meta, default=str, sort_keys=True),)], "meta string").select(F.lit(meta["version"]).alias("version"), F.lit(float(meta["metric"])).alias("metric"), "meta").write.mode("append").json(path)
