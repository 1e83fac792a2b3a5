"""A linear forecast of all horizons at once from all scaled values of a window.

Fitting reads the windows once: each task sums the products of the scaled values, and of these with every horizon's target,
in one matrix for training and one for validation windows; the sums of the tasks are added row by row, and the driver
solves one system for all horizons.  The validation error follows from the sums too.  Sums add up, so a saved fit is resumed by
adding the sums of new windows.  Scoring is one matrix product per Arrow batch.

The driver holds the square of the number of values in a window: 166 MB for 240 hours of 19 features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.samples import fit_window_scaler, ranges_in_order, row_at


@dataclass
class WindowModel:
    """Scaler, sums and hence weights.  Values of a window run by hour, then by feature; sums by (1, values, targets)."""

    features: list[str]
    seq_in: int
    seq_out: int
    mean: np.ndarray
    std: np.ndarray
    train: np.ndarray
    val: np.ndarray
    reg: float = 1e-6
    epoch: int = 1
    extra: dict = field(default_factory=dict)

    @property
    def size(self) -> int:
        """1 and the values of a window."""
        return 1 + self.seq_in * len(self.features)

    def weights(self) -> np.ndarray:
        """One column per horizon; the first row is the intercept, which ``reg`` leaves alone."""
        n, k = self.train[0, 0], self.size
        penalty = self.reg * np.diag([0.0, *[1.0] * (k - 1)])
        return np.linalg.solve(self.train[:k, :k] / n + penalty, self.train[:k, k:] / n)

    def error(self, sums: np.ndarray) -> float:
        """Mean square error over the windows behind ``sums`` and all horizons."""
        k, w = self.size, self.weights()
        squares = np.trace(sums[k:, k:]) - 2 * np.sum(w * sums[:k, k:]) + np.sum(w * (sums[:k, :k] @ w))
        return float(squares / sums[0, 0] / self.seq_out)

    @property
    def val_mse(self) -> float:
        return self.error(self.val)


def window_values(inputs: pa.ListArray, features: list[str], mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """(window, value): the scaled values of each window; a missing one is NaN."""
    steps = inputs.flatten()
    columns = [steps.field(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features]
    scaled = (np.stack(columns, axis=1) - mean) / std if len(steps) else np.empty((0, len(features)))
    return scaled.reshape(len(inputs), -1) if len(inputs) else np.empty((0, 0))


def _sum_products(features: list[str], mean: np.ndarray, std: np.ndarray, seq_out: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bool, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = window_values(batch.column("inputs"), features, mean, std)
            y = batch.column("targets").flatten().to_numpy(zero_copy_only=False).reshape(-1, seq_out)
            rows = np.hstack([np.ones((len(x), 1)), x, y])
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            whole = np.isfinite(rows).all(axis=1)  # a window with a missing value is not fitted
            for part in (True, False):
                some = rows[whole & (train == part)]
                if len(some):
                    sums[part] = sums.get(part, 0) + some.T @ some
        for part, matrix in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(matrix)), pa.array(range(len(matrix)), pa.int32()), pa.array(list(matrix), pa.list_(pa.float64()))], ["train", "i", "sums"])

    return run


def _add(group: pa.Table) -> pa.Table:
    rows = group["sums"].combine_chunks()
    total = rows.flatten().to_numpy().reshape(len(rows), -1).sum(axis=0)
    return pa.table({"train": group["train"][:1], "i": group["i"][:1], "sums": pa.array([total], pa.list_(pa.float64()))})


def sum_products(samples: DataFrame, train: Column, features: list[str], mean: np.ndarray, std: np.ndarray, seq_out: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(training, validation) sums, each task's and then each row's added up; one pass over the samples."""
    schema = "train boolean, i int, sums array<double>"
    partial = samples.select("inputs", "targets", train.alias("train")).mapInArrow(_sum_products(features, mean, std, seq_out), schema)
    out = np.zeros((2, size + seq_out, size + seq_out))
    for row in partial.groupBy("train", "i").applyInArrow(_add, schema).collect():  # one row per value and horizon
        out[int(row["train"]), row["i"]] = row["sums"]
    return out[1], out[0]


def training_part(samples: DataFrame, tie_cols: list[str], val_fraction: float) -> Column | None:
    """A condition: the window is among the first int(n (1 - f)) by anchor and ties.  None, if either side were empty.

    Only the keys are ranked; the windows themselves are neither shuffled nor written for it.
    """
    order = ["anchor_ts", *tie_cols]
    placed, offsets, total = ranges_in_order(samples.select(*order), order)
    cut = int(total * (1.0 - val_fraction))
    if not 0 < cut < total:
        return None
    first = row_at(placed, offsets, cut)
    return F.struct(*order) < F.struct(*[F.lit(first[c]).alias(c) for c in order])


def fit_windows(samples: DataFrame, feats: list[str], seq_in: int, seq_out: int, tie_cols: list[str], val_fraction: float = 0.2, reg: float = 1e-6, resume: WindowModel | None = None) -> WindowModel:
    """Fit all horizons.  The split is chronological, the scaler is fitted on the training windows alone.

    ``resume`` keeps its scaler and gets the sums of these windows on top, as its next epoch; other features or
    window sizes are refused.  Without windows on either side nothing is fitted.
    """
    if resume is not None and (resume.features, resume.seq_in, resume.seq_out) != (list(feats), seq_in, seq_out):
        raise ValueError("the saved model has other features or windows")
    train = training_part(samples, tie_cols, val_fraction)
    if train is None:
        raise ValueError("no training or no validation windows")
    if resume is None:
        stats = {r["column"]: r for r in fit_window_scaler(samples.where(train), feats).collect()}  # one row per feature
        mean, std = (np.array([stats[f][c] for f in feats], dtype=float) for c in ("mean", "std"))
    else:
        mean, std = resume.mean, resume.std
    size = 1 + seq_in * len(feats)
    fitted, held = sum_products(samples, train, list(feats), mean, std, seq_out, size)
    if resume is not None:
        return WindowModel(list(feats), seq_in, seq_out, mean, std, resume.train + fitted, resume.val + held, resume.reg, resume.epoch + 1)
    return WindowModel(list(feats), seq_in, seq_out, mean, std, fitted, held, reg)


def predict(samples: DataFrame, model: WindowModel, feats: list[str] | None = None) -> DataFrame:
    """Adds ``preds``, one per horizon; a window with a missing value gets NULLs."""
    if feats is not None and list(feats) != model.features:
        raise ValueError("feature columns differ from the model's")
    weights, features, mean, std = model.weights(), model.features, model.mean, model.std

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = window_values(batch.column("inputs"), features, mean, std)
            preds = weights[0] + x @ weights[1:] if len(x) else np.empty((0, weights.shape[1]))
            values = pa.array(preds.ravel(), mask=~np.isfinite(preds.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(preds) + 1) * weights.shape[1], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "preds"])

    return samples.mapInArrow(run, T.StructType([*samples.schema.fields, T.StructField("preds", T.ArrayType(T.DoubleType()))]))
