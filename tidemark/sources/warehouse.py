"""Catalog tables of a star over one root folder, and the protocol by which jobs load them.

A load stages its rows first (a table of its own, so the job that computes them is over), then changes the target from the
stage, then drops the stage, also where a step in between raised an error.  Two changes are used:

* ``append``: rows whose key is absent are added.  Killed halfway, some of them are there; a rerun adds the others.
* ``replace``: partitions are overwritten, each by rename when the job commits.  Killed halfway, some partitions are
  old, new or gone; the stage is complete, stays, and the next time the star is opened the same overwrite is done again.

So a load may be killed between any two steps, or within one, and run again: ids that were given are kept, and
no row is lost or doubled.  One load at a time.  A reader that began before a partition was overwritten may have to begin again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.bronze import MEASURES
from tidemark.sources.files import drop_folder, folder_exists
from tidemark.sources.tables import star_tables


def sql_text(value: object) -> str:
    """A value of a partition as a literal."""
    if value is None:
        return "NULL"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


class Warehouse:
    """The tables of ``STAR`` under ``root``, in a database whose name follows from the root; the fact with ``measures``."""

    def __init__(self, spark: SparkSession, root: str, measures: list[str] = MEASURES, recover: bool = True):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), star_tables(measures)
        self.database = "star_" + hashlib.sha256(self.root.encode()).hexdigest()[:16]
        self._register()
        if recover:
            self._recover()

    def _register(self) -> None:
        """Tables that the catalog lacks, with the partitions that are there."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
        for name, (columns, parts) in self.tables.items():
            if not self.spark.catalog.tableExists(f"{self.database}.{name}"):
                by = f"OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY ({', '.join(parts)})" if parts else ""
                self.spark.sql(f"CREATE TABLE {self.database}.{name} ({columns}) USING PARQUET {by} LOCATION '{self.root}/{name}'")
                if parts and folder_exists(self.spark, f"{self.root}/{name}"):
                    self.spark.sql(f"MSCK REPAIR TABLE {self.database}.{name}")

    def _recover(self) -> None:
        """End what a killed load has begun: a complete overwrite is done again, other stages go."""
        if not folder_exists(self.spark, f"{self.root}/_stage"):
            return
        for name in self.tables:
            redo = f"{name}_redo"  # replayed, then dropped; a stage of input rows is computed anew
            if folder_exists(self.spark, f"{self._place(redo)}/_SUCCESS"):
                self._overwrite(name, self.spark.read.schema(self.table(name).schema).parquet(self._place(redo)))
            self._drop(redo)
            self._drop(f"{name}_stage")
        drop_folder(self.spark, f"{self.root}/_stage")

    def step(self, what: str) -> None:
        """Called before each step that changes something."""

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")

    def _place(self, stage: str) -> str:
        return f"{self.root}/_stage/{stage}"

    def _stage(self, rows: DataFrame, stage: str) -> DataFrame:
        self.step(f"stage {stage}")
        rows.write.mode("overwrite").option("path", self._place(stage)).saveAsTable(f"{self.database}.{stage}")
        return self.table(stage)

    def _drop(self, stage: str) -> None:
        if folder_exists(self.spark, self._place(stage)) or self.spark.catalog.tableExists(f"{self.database}.{stage}"):
            self.step(f"drop {stage}")
            self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{stage}")
            drop_folder(self.spark, self._place(stage))

    @contextmanager
    def staged(self, rows: DataFrame, name: str) -> Iterator[DataFrame]:
        """``rows`` as a written table of the catalog, dropped afterwards even if that failed."""
        try:
            yield self._stage(rows, f"{name}_stage")
        finally:
            self._drop(f"{name}_stage")

    def append(self, name: str, rows: DataFrame) -> None:
        self.step(f"append {name}")
        self._by_partition(name, rows).write.insertInto(f"{self.database}.{name}")

    def _by_partition(self, name: str, rows: DataFrame) -> DataFrame:
        """The table's columns; rows of a partition together, in few files, but a large one dealt over several tasks."""
        rows, parts = rows.select(*self.table(name).columns), self.tables[name][1]
        return rows.hint("rebalance", *parts) if parts else rows

    def _overwrite(self, name: str, rows: DataFrame) -> None:
        self.step(f"overwrite {name}")
        self._by_partition(name, rows).write.insertInto(f"{self.database}.{name}", overwrite=True)

    def replace(self, name: str, rows: DataFrame, whole: bool = False) -> None:
        """The partitions that ``rows`` has become what ``rows`` holds of them; others stay, or go if ``whole``.  ``rows`` may read the table itself."""
        redo, parts = f"{name}_redo", self.tables[name][1]
        try:
            staged = self._stage(rows.select(*self.table(name).columns), redo)
        except Exception:
            self._drop(redo)
            raise
        if whole:
            keep = {tuple(r) for r in staged.select(*parts).distinct().collect()}  # values of the partition columns
            for old in self.table(name).select(*parts).distinct().collect():
                if tuple(old) not in keep:
                    self._drop_partition(name, old.asDict())
        self._overwrite(name, staged)  # where this fails the stage stays, for the next time
        self._drop(redo)

    def refresh(self, name: str, rows: DataFrame) -> None:
        """The whole table becomes ``rows``."""
        self.replace(name, rows, whole=True)

    def _drop_partition(self, name: str, values: dict) -> None:
        self.step(f"drop partition of {name}")
        spec = ", ".join(f"{k} = {sql_text(v)}" for k, v in values.items())
        self.spark.sql(f"ALTER TABLE {self.database}.{name} DROP IF EXISTS PARTITION ({spec})")
        named = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        drop_folder(self.spark, "/".join([self.root, name, *(named(k, None if v is None else str(v)) for k, v in values.items())]))

    def close(self) -> None:
        """Forget the tables in the catalog; their files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{name}")
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")


def load_new_keys(house: Warehouse, name: str, rows: DataFrame, natural: list[str], key: str) -> DataFrame:
    """Insert the natural keys that the dimension lacks, numbered on from its largest id; a key that is there keeps its row.

    Returns the dimension as it reads afterwards.
    """
    from tidemark.operators.upsert import number_new

    with house.staged(rows, name) as staged:
        house.append(name, number_new(staged, house.table(name), natural, key))
    return house.table(name)


__all__: Iterable[str] = ["Warehouse", "load_new_keys"]
