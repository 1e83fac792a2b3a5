"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the tables written since the innermost ``intermediate_tables`` began, if there is one.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a session on one machine gets a temporary folder; a cluster, whose executors would each
    write to a disk of their own, is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def intermediate_tables() -> Iterator[list[str]]:
    """Collects the paths that ``materialize`` writes meanwhile, for ``remove_tables`` when nothing reads them any more."""
    made: list[str] = []
    token = _written.set(made)
    try:
        yield made
    finally:
        _written.reset(token)


def record_tables(paths: list[str]) -> None:
    """Leave the removal of ``paths`` to the ``intermediate_tables`` around, if there is one."""
    if (made := _written.get()) is not None:
        made.extend(paths)


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks that were running, and later
    joins see the true size of the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    record_tables([path])
    return spark.read.schema(df.schema).parquet(path)


#: A broadcast table of narrow rows holds some 40 bytes a row, or 40 MB at this many.
MAX_BROADCAST_ROWS = 1_000_000


def broadcast_if_small(rows: DataFrame) -> DataFrame:
    """A written table of keys, marked for broadcast if it has few enough rows; beyond that the join is a shuffle."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows


def parted(rows: DataFrame, keys: DataFrame, same: Column) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` that meet a row of ``keys`` (a written table) and the others, told apart before a shuffle by a broadcast.

    Beyond ``MAX_BROADCAST_ROWS`` keys all rows come back in the first table, and the second is None: the join
    that follows then shuffles them all.
    """
    if keys.count() > MAX_BROADCAST_ROWS:
        return rows, None
    return rows.join(F.broadcast(keys), same, "left_semi"), rows.join(F.broadcast(keys), same, "left_anti")


def salted(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``_salt``, one of 64 numbers drawn from the columns ``by``: the shares of a hot key."""
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(64)).cast("int"))


def salts_seen() -> Column:
    """Aggregate of ``salted`` rows: the salts of a group, one bit each."""
    return F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_salts")


def join_groups(rows: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """``salted`` rows beside the row of their group, of which ``groups`` holds one per key, with ``salts_seen``.

    A join by the key alone would send all rows of a hot group to one task, and adaptive execution can't split
    it where one side is an aggregate by that key.  Here each group's row goes to the salts that it has, so a
    hot group is dealt over 64 tasks, and a rare key costs no more rows than it has itself.  Null keys meet.
    """
    seen = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda s: F.call_function("shiftright", F.col("_salts"), s).bitwiseAND(F.lit(1)) == 1)
    dealt = groups.withColumn("_s", F.explode(seen)).drop("_salts").withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.col("_salt") == F.col("_s")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(dealt, same).drop("_salt", "_s", *[f"_k_{k}" for k in keys])


def text_batches(batches: Iterator[pa.RecordBatch], column: int, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut (without copying) to at most ``rows`` rows and, beyond the first row, ``size`` bytes of a text column.

    Bounds what a Python task decodes at a time, whatever the session's batch settings are.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            n = max(1, min(rows, int(np.searchsorted(ends, before + size, "right")) - at))
            yield batch.slice(at, n)
            at += n
        if not batch.num_rows:
            yield batch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
