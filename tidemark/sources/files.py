"""Folders of any file system that Spark reaches: tests, deletion, and listings that open no file."""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.labels import partition_date


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def folder_exists(spark: SparkSession, path: str) -> bool:
    place, fs = _place(spark, path)
    return fs.exists(place)


def any_match(spark: SparkSession, pattern: str) -> bool:
    """Whether a path of this glob pattern exists."""
    place, fs = _place(spark, pattern)
    return len(fs.globStatus(place) or ()) > 0


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, or a file, if it is there."""
    place, fs = _place(spark, path)
    fs.delete(place, True)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every data file under ``path``; Spark lists the folders in parallel, and no file is opened.  None, if there is no folder."""
    if not folder_exists(spark, path):
        return spark.createDataFrame([], "path string, length long")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def list_coverage(spark: SparkSession, layer: str) -> DataFrame:
    """Distinct (dataset, date) of a layer, from the names of its folders alone; files outside a date are no coverage."""
    name = F.nullif(F.regexp_extract("path", "(?:^|/)dataset=([^/]+)/", 1), F.lit(""))
    found = list_files(spark, layer).select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("dataset"), partition_date("path").alias("date"))
    return found.where("date is not null").distinct()


def files_per_layer(spark: SparkSession, layers: dict[str, str]) -> DataFrame:
    """(layer, files, bytes) of every layer; one without files counts 0."""
    names = pa.table({"layer": pa.array(list(layers), pa.string())})
    out = None
    for name, path in layers.items():
        one = list_files(spark, path).select(F.lit(name).alias("layer"), "length")
        out = one if out is None else out.unionByName(one)
    counted = out.groupBy("layer").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return spark.createDataFrame(names).join(counted, "layer", "left").na.fill(0, ["files", "bytes"])


def catalog_coverage(spark: SparkSession, table: str) -> DataFrame:
    """The same from the partitions that a table has in the catalog: no folder is listed either."""
    keys = spark.sql(f"SHOW PARTITIONS {table}").select(F.concat(F.col("partition"), F.lit("/")).alias("path"))
    name = F.regexp_extract("path", "(?:^|/)dataset=([^/]+)/", 1)
    return keys.select(name.alias("dataset"), partition_date("path").alias("date")).where("date is not null").distinct()
