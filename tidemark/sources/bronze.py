"""Nested hourly documents: schema, landing, scan, validation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import parse_utc_minute, utc_minute_text
from tidemark.sources.files import any_match

#: The ten hourly measures of a document (fixed values).
MEASURES = [
    "temperature_2m",
    "relative_humidity_2m",
    "dew_point_2m",
    "precipitation",
    "pressure_msl",
    "cloud_cover",
    "wind_speed_10m",
    "wind_direction_10m",
    "wind_gusts_10m",
    "shortwave_radiation",
]
LOCATIONS = T.StructType([T.StructField("region", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("elevation", T.DoubleType()), T.StructField("population", T.LongType()), T.StructField("capital", T.StringType()), T.StructField("admin1", T.StringType())])


def bronze_schema(measures: Iterable[str] = MEASURES) -> T.StructType:
    hourly = [T.StructField("time", T.ArrayType(T.StringType()))] + [T.StructField(m, T.ArrayType(T.DoubleType())) for m in measures]
    return T.StructType(
        [T.StructField(c, T.DoubleType()) for c in ("latitude", "longitude", "elevation")]
        + [T.StructField("timezone", T.StringType()), T.StructField("utc_offset_seconds", T.LongType())]
        + [T.StructField("hourly_units", T.MapType(T.StringType(), T.StringType())), T.StructField("hourly", T.StructType(hourly))]
    )


def land_bronze(df: DataFrame, path: str, by: Iterable[str] = ("region", "dataset", "marz", "range")) -> None:
    """Write documents as JSON under path partitions; an unnamed place is ``unknown``.

    The requested range (or the run) is a partition of its own, so a narrower request never
    overwrites a wider one.
    """
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in by})
    filled.write.mode("append").partitionBy(*by).json(path)


def read_bronze(spark: SparkSession, path: str, measures: Iterable[str] = MEASURES, datasets: Iterable[str] = ("archive", "forecast"), region: str = "*") -> DataFrame:
    """All documents with their path columns; one read per dataset, whose path layouts differ."""
    schema = bronze_schema(measures).add("_corrupt", T.StringType())
    reader = spark.read.schema(schema).option("basePath", path).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    out = None
    for dataset in datasets:
        files = f"{path}/region={region}/dataset={dataset}/marz=*"
        if any_match(spark, files):
            part = reader.json(files)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no landed dataset of {list(datasets)} under {path}")
    return out


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(LOCATIONS).json(path)


def split_valid(df: DataFrame, required: Iterable[str] = ("latitude", "longitude", "hourly.time"), corrupt: str = "_corrupt") -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): required fields present and the record readable; adds n_rows."""
    good = F.lit(True)
    for c in required:
        good = good & F.col(c).isNotNull()
    if corrupt in df.columns:
        good = good & F.col(corrupt).isNull()
    judged = df.withColumn("n_rows", F.when(F.col("hourly.time").isNull(), 0).otherwise(F.size("hourly.time")))
    return judged.where(good), judged.where(~good)


def flatten_hourly(df: DataFrame, arrays: Iterable[str], time: str = "time", struct: str = "hourly", keep: Iterable[str] = ()) -> DataFrame:
    """One row per element of the parallel arrays; a missing array pads with NULL."""
    zipped = F.arrays_zip(F.col(f"{struct}.{time}").alias(time), *[F.coalesce(F.col(f"{struct}.{a}"), F.array().cast("array<double>")).alias(a) for a in arrays])
    return df.select(*keep, F.explode(zipped).alias("_z")).select(*keep, parse_utc_minute(f"_z.{time}").alias("observed_at"), *[F.col(f"_z.{a}").alias(a) for a in arrays])


def pack_hourly(df: DataFrame, by: Iterable[str], ts: str, measures: Iterable[str]) -> DataFrame:
    """The inverse of ``flatten_hourly``: parallel arrays in time order per group."""
    rows = F.array_sort(F.collect_list(F.struct(utc_minute_text(ts).alias("time"), *measures)))
    grouped = df.groupBy(*by).agg(rows.alias("_r"))
    return grouped.select(*by, F.struct(*[F.col(f"_r.{c}").alias(c) for c in ("time", *measures)]).alias("hourly"))
