"""Best-fit packing: dual-feasible functions and least sequences by brute force, exact round trips, hard cases."""

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.best_fit import best_fit, best_fit_decreasing, dual_feasible, least_sequences, lower_bound, pack_once
from tidemark.llm.shared import materialize

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("capacity", [1, 2, 3, 7, 12, 30, 61, 128])
def test_functions_are_dual_feasible(capacity):
    """The most value that fits one sequence, by knapsack, never passes 1."""
    values, denominators = dual_feasible(capacity)
    most = np.zeros((len(values), capacity + 1), np.int64)
    for room in range(1, capacity + 1):
        for n in range(1, room + 1):
            most[:, room] = np.maximum(most[:, room], most[:, room - n] + values[:, n])
    assert (most[:, capacity] <= denominators).all()


def fewest(lengths, capacity):
    """The least number of sequences, by search over all assignments."""
    lengths = sorted(lengths, reverse=True)

    @lru_cache(None)
    def fits(at, rooms):
        if at == len(lengths):
            return True
        return any(fits(at + 1, tuple(sorted(rooms[:i] + (r - lengths[at],) + rooms[i + 1 :]))) for i, r in enumerate(rooms) if r >= lengths[at] and r not in rooms[:i])

    return next(k for k in range(len(lengths) + 1) if fits(0, (capacity,) * k))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_bounds_and_bins_by_brute_force(lengths):
    least = fewest(tuple(lengths), 20)
    assert least_sequences(np.bincount(lengths or [0], minlength=21) * (1 if lengths else 0), 20) <= least
    bins, rooms = best_fit_decreasing(np.array(sorted(lengths, reverse=True), np.int64), 20)
    used = defaultdict(int)
    for b, n in zip(bins, sorted(lengths, reverse=True)):
        used[b] += n
    assert [20 - used[b] for b in range(len(rooms))] == rooms and all(r >= 0 for r in rooms)
    assert least <= len(rooms) <= max(least, 11 * least / 9 + 1)


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in lengths:
        fitting = [i for i, r in enumerate(rooms) if r >= n]
        at = min(fitting, key=lambda i: rooms[i]) if fitting else len(rooms)
        if not fitting:
            rooms.append(capacity)
        rooms[at] -= n
    return sorted(rooms)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1024), max_size=60))
def test_best_fit_by_brute_force(lengths):
    lengths.sort(reverse=True)
    assert sorted(best_fit_decreasing(np.array(lengths, np.int64), 1024)[1]) == plain_best_fit(lengths, 1024)


def check(docs, rows, end_id=2, capacity=1024):
    """Every token lies in one piece; sequences are gapless and hold at most ``capacity``."""
    library = Tokenizer.from_file(PATH)
    expected = []
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end_id]
        first = len(ids) % capacity or capacity
        for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
            start = max(0, stop - capacity)
            expected.append((doc_id is None, doc_id or 0, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_round_trip_and_bound(spark):
    docs = [(i, f"word{i % 7} " * (i * 37 % 1500)) for i in range(1200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    whole, dealt = (materialize(best_fit(frame, PATH, group_size=g), "test") for g in (16_384, 100))
    bound = lower_bound(whole)
    assert bound <= check(docs, whole.collect()) <= bound + 1
    assert bound <= check(docs, dealt.collect()) <= bound * 1.03  # partitions of 100 pieces, after the exchange


def test_exchange_saves_sequences(spark):
    """Partitions whose remnants are half empty need fewer sequences once they exchange documents."""
    rows = spark.createDataFrame([(i, i, 0, 0, 100 + i % 400, 0) for i in range(2000)], "item long, doc_id long, piece int, start long, length long, ids_crc32 long")
    once = pack_once(rows, 40, 0, 1024).where("offset = 0").count()
    total = sum(100 + i % 400 for i in range(2000))
    assert once > -(-total // 1024)
    docs = [(i, "a " * (49 + i % 200)) for i in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    first, last = (best_fit(frame, PATH, group_size=50, max_rounds=k).select("sequence_id").distinct().count() for k in (1, 12))
    assert last < first and last <= lower_bound(best_fit(frame, PATH)) * 1.03


def test_hard_cases(spark):
    docs = [(None, None), (None, None), (1, ""), (1, ""), (2, None), (3, "a<|endoftext|>b"), (4, "x" * 30_000), (5, " " * 3000), (6, "a " * 50_000), (None, "no id"), (7, "a" + " a" * 1022), (8, "a" + " a" * 1023), (9, "a" + " a" * 2046), (10, "é\U0001f600\n\tb")]
    docs += [(20, "same text in one of many rows")] * 500
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, length string, item int")
    check(docs, best_fit(frame, PATH).collect())
    check(docs, best_fit(frame, PATH, group_size=10, end_id=0).collect(), end_id=0)
    empty = best_fit(frame.where("false"), PATH)
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_only_full_sequences(spark):
    docs = [(i, "a" + " a" * 1022) for i in range(5)]
    rows = best_fit(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect()
    assert check(docs, rows) == 5 and {r.length for r in rows} == {1024}
