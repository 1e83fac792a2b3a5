"""Naive Bayes support vectors: a quality classifier.

Features are indicators of n-grams in a hashed space: single words, and one to three neighbouring word
shapes (character classes with runs collapsed; a word that repeats the one before is marked).  Class
log-count ratios come from all labelled training rows; the indicators are scaled by them and a linear
hinge-loss model is fitted by dual coordinate descent on at most ``max_fit_rows`` rows, drawn by a hash of
their id.  A logistic curve fitted to margins of other labelled rows turns margins into
scores from 0 to 1.

Cases: a null or empty text has no features and gets the score of the bias; a text and a word of any length
count whole; null labels are left out; a null id has no label and is scored; an id
labelled more than once takes its largest label; repeated rows are scored (and counted) each; without labelled rows of
both classes every score is the share of label 1 (0.5 if there are none); an empty table gives an empty result.

Memory: the driver holds the class counts (16 bytes a feature number, 4 MB) and the feature lists of the drawn rows; a
list has at most ``space`` distinct numbers of 8 bytes (2 MB), 1.3 kB for a text of 350 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize, text_batches

SPACE = 1 << 18
#: Labels are broadcast up to this many rows of 12 bytes (about 64 MB as a hash table).
MAX_BROADCAST_LABELS = 2_000_000


def word_shape(word: str) -> str:
    """Character classes of the whole word; letters and digits count once per run, other characters at most twice."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if out[-2:] != [k, k] and not (k in "Aa9" and out[-1:] == [k]):
            out.append(k)
    return "".join(out)


class Features:
    """Sorted distinct feature numbers of texts; words are hashed once each."""

    def __init__(self, space: int = SPACE, cache_size: int = 500_000):
        self.space, self.cache_size = space, cache_size
        self.known: dict[bytes, tuple[int, int]] = {}

    def _new(self, word: bytes) -> tuple[int, int]:
        text = word.decode("utf-8", "replace")
        number = xxhash.xxh32_intdigest(text.lower().encode("utf-8", "replace")) % self.space
        shape = xxhash.xxh32_intdigest(word_shape(text).encode("utf-8", "replace"), 1)
        if len(self.known) > self.cache_size:
            self.known.clear()
        self.known[word] = (number, shape)
        return number, shape

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        if not words:
            return np.zeros(0, np.int32)
        known, new = self.known, self._new
        pairs = [known.get(w) or new(w) for w in words]
        single = np.fromiter((p[0] for p in pairs), np.int64, len(pairs))
        shapes = np.fromiter((p[1] for p in pairs), np.uint64, len(pairs))
        same = np.zeros(len(words), bool)
        same[1:] = single[1:] == single[:-1]
        shapes[same] = 1  # a word that repeats the one before
        grams = [single]
        mixed = shapes.copy()
        for n in range(1, 4):
            if n > 1:
                if len(shapes) < n:
                    break
                mixed = mixed[:-1] * np.uint64(0x9E3779B97F4A7C15) + shapes[n - 1 :]
            x = (mixed + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
            grams.append(((x >> np.uint64(40)) % np.uint64(self.space)).astype(np.int64))
        return np.unique(np.concatenate(grams)).astype(np.int32)


def _featurize(space: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(space)
        for batch in text_batches(batches, 2):
            found = [features.of(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "label", "features"])

    return run


def _class_counts(space: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, space), np.int64)
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            of = np.repeat(labels, np.diff(lists.offsets.to_numpy()))
            values = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
            for y in (0, 1):
                counts[y] += np.bincount(values[of == y], minlength=space)
        at = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[0][at]), pa.array(counts[1][at])], ["f", "n0", "n1"])

    return run


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss; a row's values are ``scale`` at its features."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[r] for r in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        largest = 0.0
        for i in order:
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                alpha[i] = new
                largest = max(largest, abs(step) * norms[i])
        if largest < 1e-3:
            break
    return w, bias


def fit_logistic(margins: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))), by Newton steps with a little ridge."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([(p - y) @ margins + 1e-2 * a, (p - y).sum() + 1e-2 * b])
        d = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[d @ margins**2 + 1e-2, d @ margins], [d @ margins, d.sum() + 1e-2]])
        move = np.linalg.solve(h, g)
        a, b = a - move[0], b - move[1]
        if abs(move).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def held_out(doc_id: str = "doc_id"):
    """The rows that no label may be learned from: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _score(weights, space: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(space)
        w, bias, a, b = weights.value
        for batch in text_batches(batches, 2):
            margins = np.array([w[features.of(t.as_py())].sum() + bias for t in batch.column(2)])
            scores = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", max_fit_rows: int = 6000, space: int = SPACE) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, a, b), learned from labelled rows that are not held out."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = materialize(known, "nbsvm-labels")
    small = known.count() <= MAX_BROADCAST_LABELS  # else texts are dealt to the labels by id
    rows = texts.join(F.broadcast(known) if small else known, F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text")
    rows = materialize(rows.mapInArrow(_featurize(space), "doc_id long, label int, features array<int>"), "nbsvm-rows")
    counts = np.ones((2, space))  # add-one smoothing
    merged = rows.select("label", "features").mapInArrow(_class_counts(space), "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    for r in merged.toLocalIterator():  # at most ``space`` rows
        counts[0, r["f"]] += r["n0"]
        counts[1, r["f"]] += r["n1"]
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    total = rows.count()
    # a little more than the share that is wanted, of which the smallest hashes are taken: the same rows in every run
    share = int(min(1.0, 1.2 * (max_fit_rows + 500) / max(total, 1)) * 2**32)
    drawn = rows.withColumn("_h", F.xxhash64("doc_id")).where(F.pmod("_h", F.lit(2**32)) < share)
    sample = drawn.orderBy("_h", "doc_id", "label", "features").limit(max_fit_rows).collect()  # the stated bound
    sample = sorted(sample, key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["features"]))
    y = np.array([r["label"] for r in sample])
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return np.zeros(space), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    lists = [np.array(r["features"], np.int64) for r in sample]
    cut = max(1, len(lists) * 4 // 5)
    w, bias = dual_coordinate_descent(lists[:cut], np.where(y[:cut] == 1, 1.0, -1.0), ratios)
    weights = w * ratios
    margins = np.array([weights[f].sum() + bias for f in lists[cut:]])
    a, b = fit_logistic(margins, y[cut:].astype(float))
    return weights, bias, a, b


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", max_fit_rows: int = 6000, threshold: float = 0.3, space: int = SPACE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; scoring is map-only over whole texts."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, doc_id, text, max_fit_rows, space))
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    scored = picked.mapInArrow(_score(model, space), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
