"""Star tables in a database: reads by key ranges, and loads that can be repeated.

Rows are staged in a table of their own (each task commits what it has written, so a task that ran twice leaves rows twice;
a row number tells those apart), and go to the target in one transaction on the driver's connection: a load is there as a
whole or not at all, and the stage is dropped either way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "stage_row"


def execute(spark: SparkSession, options: dict, *statements: str) -> None:
    """All statements in one transaction."""
    jvm = spark._jvm
    jvm.java.lang.Class.forName(options["driver"])
    properties = jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in options:
            properties.setProperty(k, options[k])
    connection = jvm.java.sql.DriverManager.getConnection(options["url"], properties)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for sql in statements:
            statement.execute(sql)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def has_table(spark: SparkSession, options: dict, table: str) -> bool:
    jvm = spark._jvm
    jvm.java.lang.Class.forName(options["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(options["url"])
    try:
        found = [connection.getMetaData().getTables(None, None, name, None) for name in (table, table.upper())]
        return any(rows.next() for rows in found)
    finally:
        connection.close()


def read_table(spark: SparkSession, options: dict, table: str, key: str | None = None, partitions: int = 8) -> DataFrame:
    """A table, read by ``partitions`` connections over ranges of a whole-number ``key`` where one is named."""
    whole = {**options, "dbtable": table}
    if key is not None:
        name = quoted(spark, options, [key])[0]
        bounds = spark.read.format("jdbc").options(**options, query=f"SELECT MIN({name}) AS lo, MAX({name}) AS hi FROM {table}").load().first()
        if bounds[0] is not None:
            whole |= {"partitionColumn": key, "lowerBound": int(bounds[0]), "upperBound": int(bounds[1]) + 1, "numPartitions": partitions}
    return spark.read.format("jdbc").options(**whole).load()


def quoted(spark: SparkSession, options: dict, columns: Iterable[str]) -> list[str]:
    dialect = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"])
    return [dialect.quoteIdentifier(c) for c in columns]


@contextmanager
def staged(rows: DataFrame, options: dict, table: str) -> Iterator[str]:
    """A query for ``rows`` in a table of its own, whose columns have the types that they have in ``table``; dropped afterwards."""
    spark, stage = rows.sparkSession, f"{table}_stage"
    names, number = ", ".join(quoted(spark, options, rows.columns)), quoted(spark, options, [ROW])[0]

    def drop() -> None:
        if has_table(spark, options, stage):
            execute(spark, options, f"DROP TABLE {stage}")

    drop()  # what a killed load has left
    try:
        execute(spark, options, f"CREATE TABLE {stage} AS SELECT {names} FROM {table} WITH NO DATA", f"ALTER TABLE {stage} ADD COLUMN {number} BIGINT")
        rows.withColumn(ROW, F.monotonically_increasing_id()).write.format("jdbc").options(**options, dbtable=stage).mode("append").save()
        yield f"(SELECT DISTINCT {names}, {number} FROM {stage})"
    finally:
        drop()


def append_absent(rows: DataFrame, options: dict, table: str, keys: list[str]) -> None:
    """Insert the rows whose key the table lacks; of rows that share a key the smallest."""
    from tidemark.operators.upsert import one_per_key

    spark = rows.sparkSession
    with staged(one_per_key(rows, keys), options, table) as stage:
        names = ", ".join(quoted(spark, options, rows.columns))
        same = " AND ".join(f"t.{k} = s.{k}" for k in quoted(spark, options, keys))
        execute(spark, options, f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage} s WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE {same})")


def replace_rows(rows: DataFrame, options: dict, table: str) -> None:
    """The table becomes ``rows``; readers see the old rows or the new ones."""
    spark = rows.sparkSession
    with staged(rows, options, table) as stage:
        names = ", ".join(quoted(spark, options, rows.columns))
        execute(spark, options, f"DELETE FROM {table}", f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage} s")
