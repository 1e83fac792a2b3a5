"""Importance resampling towards a target's word distribution, by hashed n-gram counts.

Every run of 1 to ``max_n`` words is a feature and falls into one of ``buckets`` buckets by its CRC-32.  A
bucket's gain is the floored log ratio of its share in the target to its share in the source, with one added to every
count; a document's weight is the sum over its features.  A Gumbel draw from a SHA-256 of seed and id is
added, and the highest scores are drawn, which samples without replacement in proportion to exp(weight).

Tasks work on Arrow columns: texts are lowered and split by kernels, the lists flattened and dictionary-encoded, so
each distinct word of a batch is hashed once; longer n-grams are pairs of shifted indices, and each
distinct pair is hashed once.  Bucket gains are taken by index and summed per document.  Tasks send one
count per bucket; the driver holds ``buckets`` gains.  Texts are read twice, and never shuffled.

Cases: a null, empty or wordless text has no features and weight 0; a null id is hashed as an empty string and comes first
among ties; rows that repeat, or share an id, are scored and ranked each; only A-Z are lowered; other columns of
the input are not read, whatever their names; an empty table gives an empty one; an empty target counts as
no words.  Texts are worked on whole; a text takes some 60 bytes a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize, text_batches
from tidemark.operators.samples import global_ranks

#: What stands between words: ASCII other than letters and digits.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_indices(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, index of each word of all texts, number of words before each text and in all)."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BREAKS)
    encoded = pc.list_flatten(lists).dictionary_encode()
    words = encoded.dictionary.cast(pa.binary()).to_pylist()
    index = encoded.indices.to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)])
    if b"" in words:  # at the ends of a text that begins or ends with a break
        some = index != words.index(b"")
        ends = np.concatenate([[0], np.cumsum(some)])[ends]
        index = index[some]
    return words, index, ends


def feature_buckets(texts: pa.Array, max_n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, ..: (bucket of each n-gram of all texts, number of n-grams before each text and in all)."""
    words, index, ends = word_indices(texts)
    sizes, doc = np.diff(ends), np.repeat(np.arange(len(texts)), np.diff(ends))
    grams, gram, at = words, index, np.arange(len(index))
    for n in range(1, max_n + 1):
        if n > 1:
            some = at + n - 1 < len(index)
            some[some] = doc[at[some]] == doc[at[some] + n - 1]  # both ends in one text
            pairs = gram[some] * len(words) + index[at[some] + n - 1]
            at, (distinct, gram) = at[some], np.unique(pairs, return_inverse=True)
            grams = [grams[i] + b" " + words[j] for i, j in zip((distinct // len(words)).tolist(), (distinct % len(words)).tolist())] if len(words) else []
        hashed = np.fromiter((zlib.crc32(g) % buckets for g in grams), np.int64, len(grams))
        yield hashed[gram], np.concatenate([[0], np.cumsum(np.maximum(sizes - n + 1, 0))])


def _count(max_n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in text_batches(batches, 0):
            for found, _ in feature_buckets(batch.column(0), max_n, buckets):
                counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text: str = "text", max_n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Features per bucket; the driver sees one number for each."""
    found = texts.select(F.col(text).alias("text")).mapInArrow(_count(max_n, buckets), "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratios of smoothed shares."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weigh(max_n: int, gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1):
            weight, features, words = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), None
            for found, ends in feature_buckets(batch.column(1), max_n, len(gains)):
                sums = np.concatenate([[0], np.cumsum(gains.take(found))])
                weight += np.diff(sums[ends])
                features += np.diff(ends)
                words = np.diff(ends) if words is None else words
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def importance_weights(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", max_n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document, against the texts of ``target``."""
    gains = bucket_gains(bucket_counts(docs, text, max_n, buckets), bucket_counts(target, text, max_n, buckets))
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(_weigh(max_n, gains), "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", max_n: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, min_words: int = 20) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; ``rank`` from 1 where it is drawn, else null.

    Of the documents with ``min_words`` words ``percent`` percent are drawn, ties going to the smaller id.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    weighed = importance_weights(docs, target, doc_id, text, max_n, buckets)
    scored = materialize(weighed.withColumn("score", (F.col("weight") + gumbel).cast("long")), "resample-scores")
    enough = F.col("n_words") >= min_words
    drawn = scored.agg(F.count_if(enough)).first()[0] * percent // 100
    ranked = global_ranks(scored, [F.desc(enough), F.desc("score"), F.asc_nulls_first("doc_id")], "_place")
    return ranked.withColumn("rank", F.when(enough & (F.col("_place") < drawn), F.col("_place") + 1)).drop("_place")
