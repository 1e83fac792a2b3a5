"""Importance resampling: features, gains, draws by brute force, hard cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.resampling import bucket_counts, feature_buckets, importance_weights, resample

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, max_n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé İ-\n9", max_size=12)), max_size=5), st.integers(1, 4))
def test_features_by_brute_force(texts, max_n):
    found = list(feature_buckets(pa.array(texts, pa.string()), max_n, 97))
    for k, t in enumerate(texts):
        ours = [int(b) for hashed, ends in found for b in hashed[ends[k] : ends[k + 1]]]
        assert ours == [bucket(f, 97) for f in features(t, max_n)[1]]


def brute(docs, target, max_n, buckets, seed, percent, min_words):
    s, t = (Counter(bucket(f, buckets) for x in texts for f in features(x, max_n)[1]) for texts in ([x[1] for x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    rows = []
    for doc_id, text in docs:
        words, found = features(text, max_n)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f, buckets)) for f in found)
        rows.append([doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    some = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = Counter()
    drawn = [tuple(r) for r in some[: len(some) * percent // 100]]
    out = []
    for r in rows:
        at = [i for i, d in enumerate(drawn) if d == tuple(r)]
        out.append((*r, at[rank[tuple(r)]] + 1 if rank[tuple(r)] < len(at) else None))
        rank[tuple(r)] += 1
    return out


def check(spark, docs, target, **options):
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, rank int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    options = {"max_n": 1, "buckets": 10_000, "seed": 2024, "percent": 10, "min_words": 20} | options
    key = lambda r: [(x is None, x or 0) for x in r]
    assert sorted(map(tuple, resample(frame, wanted, **options).collect()), key=key) == sorted(brute(docs, target, **options), key=key)


def test_draws_by_brute_force(spark):
    docs = [(i, " ".join(f"W{(i * k) % 211}" for k in range(i % 60))) for i in range(400)]
    target = ["w1 w2 w3 w5, w8", "W13-w21", None, ""]
    check(spark, docs, target)
    check(spark, docs, target, max_n=3, buckets=50, percent=33, min_words=5)


def test_hard_cases(spark):
    docs = [(None, None), (None, "no id " * 20), (None, "no id " * 20), (1, ""), (1, "--- \n"), (2, "İstanbul É x\x7fy 9z"), (3, "word " * 200_000), (4, "x" * 1_000_000)]
    docs += [(7, "the same text again and again " * 5)] * 300
    for target in (["the same word"], [], [None]):
        check(spark, docs, target, percent=40)
    assert resample(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")).count() == 0


def test_hot_words_and_counts(spark):
    texts = spark.createDataFrame([("the " * 1000 + "rare",)] * 50, "text string")
    counts = bucket_counts(texts)
    assert counts.sum() == 50_050 and counts.max() == 50_000
    assert np.count_nonzero(counts) == 2


def test_target_words_weigh_more(spark):
    docs = spark.createDataFrame([(i, ("plasma field wave " if i % 4 == 0 else "lemon cake sugar ") * 10) for i in range(200)], "doc_id long, text string")
    target = spark.createDataFrame([("plasma wave field",)] * 50, "text string")
    rows = {r.doc_id: r.weight for r in importance_weights(docs, target).collect()}
    assert min(w for i, w in rows.items() if i % 4 == 0) > max(w for i, w in rows.items() if i % 4)
    drawn = [r.doc_id for r in resample(docs, target, percent=20).where("rank is not null").collect()]
    assert len(drawn) == 40 and all(i % 4 == 0 for i in drawn)
