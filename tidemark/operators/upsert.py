"""Keys and idempotent writes without MERGE, and integrity checks as queries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that share a key the smallest."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]) if rest else df.distinct()
    return one.select(*df.columns)


def absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``; of rows that share a key the smallest."""
    return one_per_key(new, keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return existing.unionByName(absent(existing, new, keys))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """``new`` replaces rows of the same key; other keys stay.

    Of rows of ``new`` that share a key the one with the largest ``version`` counts; without a version column they
    are refused, so a key is never there twice.
    """
    if version is not None:
        rest = [c for c in new.columns if c not in keys]
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, *rest)).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) if c in rest else c for c in new.columns])
    elif not duplicate_keys(new, keys).isEmpty():
        raise ValueError(f"rows that share a key {keys}: name the column that decides")
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def number_new(new: DataFrame, existing: DataFrame, natural: list[str], key: str) -> DataFrame:
    """The natural keys of ``new`` that ``existing`` lacks, numbered on from its largest id, in key order.

    They are ranked inside ranges of the first key column, and the ranges' offsets are added, so no single task
    sorts all keys.
    """
    fresh = absent(existing, new, natural)
    first = natural[0]
    sizes = fresh.groupBy(first).agg(F.count("*").alias("_n"))  # one row per value of the leading key
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    largest = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]  # one number
    ranked = fresh.withColumn("_rn", F.row_number().over(Window.partitionBy(first).orderBy(*natural[1:] or [first])))
    return ranked.join(before, first, "left").withColumn(key, (F.lit(largest) + F.coalesce("_before", F.lit(0)) + F.col("_rn")).cast("long")).drop("_before", "_rn").select(*existing.columns)


def assign_keys(new: DataFrame, existing: DataFrame, natural: list[str], key: str) -> DataFrame:
    """Existing rows with their ids, and new natural keys numbered by ``number_new``."""
    return existing.unionByName(number_new(new, existing, natural, key))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has no parent; a key with a NULL refers to nothing."""
    return child.na.drop(subset=keys).join(parent.select(*keys), keys, "left_anti")


def null_violations(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """(column, n) of every column that must not be NULL and is."""
    cols = list(cols)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in cols])).alias("x")).select("x.*").where("n > 0")
