"""A store of fitted window models: versions with their sums, scaler, features and provenance.

A version is a folder of two Parquet tables, ``sums`` and, written last, ``meta`` of one row: a version whose write was cut
off has no ``meta`` and is not seen.  Best and latest are answers over the ``meta`` rows, not pointers that could go stale.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.evaluate import best_run, check_compatible
from tidemark.operators.forecast import WindowModel
from tidemark.sources.files import any_match, folder_exists

META = "version string, metric double, epoch int, features array<string>, seq_in int, seq_out int, reg double, mean array<double>, std array<double>, hyperparams map<string,string>, resumed_from string, data_start date, data_end date, n_rows long, trained_at timestamp"


def save_model(spark: SparkSession, model: WindowModel, root: str, version: str, hyperparams: dict | None = None, resumed_from: str | None = None, data_start: object = None, data_end: object = None, n_rows: int | None = None) -> None:
    """A version is written once; its name is refused if it is there."""
    place = f"{root}/version={version}"
    if folder_exists(spark, f"{place}/meta/_SUCCESS"):
        raise ValueError(f"version {version} is there")
    rows = [(part, i, row) for part, matrix in (("train", model.train), ("val", model.val)) for i, row in enumerate(matrix)]
    parts, at, sums = zip(*rows)
    table = pa.table({"part": pa.array(parts), "i": pa.array(at, pa.int32()), "sums": pa.array(sums, pa.list_(pa.float64()))})
    spark.createDataFrame(table).write.mode("overwrite").parquet(f"{place}/sums")
    params = {k: str(v) for k, v in (hyperparams or {}).items()}
    meta = (version, model.val_mse, model.epoch, model.features, model.seq_in, model.seq_out, model.reg, model.mean.tolist(), model.std.tolist(), params, resumed_from, data_start, data_end, n_rows)
    row = spark.createDataFrame([meta], META.rsplit(", ", 1)[0]).withColumn("trained_at", F.current_timestamp())
    row.coalesce(1).write.mode("overwrite").parquet(f"{place}/meta")


def list_models(spark: SparkSession, root: str) -> DataFrame:
    """One row per finished version."""
    if not any_match(spark, f"{root}/version=*/meta/_SUCCESS"):
        return spark.createDataFrame([], META)
    return spark.read.schema(META).parquet(f"{root}/version=*/meta")


def load_model(spark: SparkSession, root: str, version: str | None = None, by: str = "metric") -> tuple[WindowModel, dict]:
    """(model, its meta row): a version by name, else the one with the least metric, or ``by='latest'``."""
    runs = list_models(spark, root)
    found = (runs.where(F.col("version") == version) if version is not None else best_run(runs, by)).first()
    if found is None or found["version"] is None:
        raise FileNotFoundError(f"no model {version or ''} under {root}")
    size = 1 + found["seq_in"] * len(found["features"]) + found["seq_out"]
    sums = {"train": np.zeros((size, size)), "val": np.zeros((size, size))}
    for row in spark.read.parquet(f"{root}/version={found['version']}/sums").collect():  # one row per value of a window
        sums[row["part"]][row["i"]] = row["sums"]
    model = WindowModel(list(found["features"]), found["seq_in"], found["seq_out"], np.array(found["mean"]), np.array(found["std"]), sums["train"], sums["val"], found["reg"], found["epoch"])
    return model, found.asDict()


def resumable(spark: SparkSession, root: str, feats: list[str], hyperparams: dict, version: str | None = None) -> WindowModel:
    """The saved model to go on from; refused where features or parameters have drifted."""
    model, meta = load_model(spark, root, version)
    check_compatible({"feature_columns": meta["features"], "hyperparams": meta["hyperparams"], "epoch": meta["epoch"], "best_val_mse": meta["metric"]}, feats, {k: str(v) for k, v in hyperparams.items()})
    return model
