"""Best-fit packing into as few sequences as possible, certified by lower bounds.

Documents are tokenized where they lie (no text is shuffled); one that is longer than a sequence is cut into full
sequences and a first piece that holds the rest.  Pieces shorter than a sequence are dealt by hash to partitions of some
``group_size`` pieces.  Each partition is packed by best-fit decreasing, and dual-feasible functions bound
from below the number of sequences that any packing of the same pieces needs.  Where the two numbers are equal the
partition is certified: it keeps its sequences but for the emptiest.  Where they differ, there is a gap: the
pieces of all its sequences with room go on.  What goes on is dealt anew, so that partitions exchange
documents, and packed again, until a round saves no sequence.  As few pieces go on, there are fewer partitions
each time; the last one packs the remnants of all.  Rounds are written tables, so a lost executor
costs only its running tasks; the driver sees counts alone.

Cases: a null or empty text is its end token alone; a document of one, or of some, full sequences has no first rest;
rows that repeat, or share an id, are packed each; a null id is kept; other columns of the input are not read,
whatever their names; an empty table gives an empty one; texts are encoded whole, and nothing is dropped: every token
lies in exactly one piece.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.packing import encoder
from tidemark.llm.shared import materialize, text_batches

PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, certified boolean, moves boolean"


def _cut(tokenizer_path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        item = TaskContext.get().partitionId() << 40
        schema = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in ("item", "doc_id", "piece", "start", "length", "ids_crc32")])
        for batch in text_batches(batches, 1):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                ends = range(n % capacity or capacity, n + 1, capacity)  # only the first piece may be shorter
                for piece, stop in enumerate(ends):
                    start = max(0, stop - capacity)
                    rows.append((item, doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    item += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    return run


def cut_pieces(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The pieces of all documents; ``item`` tells pieces apart within one run, so write them before they are read twice."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(_cut(tokenizer_path, capacity, end_id), PIECES)


@lru_cache(maxsize=4)
def dual_feasible(capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(numerators by function and length, denominators): for lengths that fit one sequence together the values sum to 1 at most.

    Three families: long pieces count whole and short ones nothing (by threshold); lengths rounded down to k-ths;
    and pieces over a half counted by how many of a smaller length they keep out.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    rows, denominators = [], []
    for low in range(0, capacity // 2 + 1):
        rows.append(np.where(x > capacity - low, capacity, np.where(x < low, 0, x)))
        denominators.append(capacity)
    for k in range(1, min(capacity, 100) + 1):
        rows.append(np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity))
        denominators.append(k * capacity)
    for low in range(1, capacity // 2 + 1):
        rows.append(np.where(2 * x > capacity, capacity // low - (capacity - x) // low, np.where(x < low, 0, 1)))
        denominators.append(capacity // low)
    return np.array(rows), np.array(denominators, dtype=np.int64)


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """No packing of ``counts[n]`` pieces of each length n needs fewer sequences than this."""
    values, denominators = dual_feasible(capacity)
    return int(np.max(-(-(values @ counts.astype(np.int64)) // denominators)))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[list[int], list[int]]:
    """(bin of each piece, room left in each bin); ``lengths`` in falling order.  Bins wait by their room, whose set is one integer's bits."""
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms, bins, some = [], [], 0
    for n in lengths.tolist():
        fitting = some >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                some &= ~(1 << room)
        else:
            at, room = len(rooms), capacity
            rooms.append(capacity)
        rooms[at] = left = room - n
        bins.append(at)
        if left:
            by_room[left].append(at)
            some |= 1 << left
    return bins, rooms


def _pack_group(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        length, item = group["length"].to_numpy(), group["item"].to_numpy()
        order = np.lexsort((item, -length))
        group, length, item = group.take(order), length[order], item[order]
        bins, rooms = best_fit_decreasing(length, capacity)
        bins, rooms = np.array(bins), np.array(rooms)
        certified = len(rooms) <= least_sequences(np.bincount(length, minlength=capacity + 1), capacity)
        if certified:  # only the emptiest, if it has room, may still be filled with others' pieces
            moving = (np.arange(len(rooms)) == np.argmax(rooms)) & (rooms > 0)
        else:
            moving = rooms > 0
        firsts = np.full(len(rooms), -1, np.int64)
        first_rows = np.unique(bins, return_index=True)[1]
        firsts[bins[first_rows]] = item[first_rows]
        in_bins = np.argsort(bins, kind="stable")
        before = np.cumsum(length[in_bins]) - length[in_bins]
        starts = np.searchsorted(bins[in_bins], np.arange(len(rooms)))
        offset = np.empty(len(bins), np.int64)
        offset[in_bins] = before - before[starts][bins[in_bins]]
        for name, values in (("sequence_id", firsts[bins]), ("offset", offset), ("certified", np.full(len(bins), certified)), ("moves", moving[bins])):
            group = group.append_column(name, pa.array(values))
        return group

    return run


def pack_once(pieces: DataFrame, groups: int, seed: int, capacity: int) -> DataFrame:
    """Pieces dealt to ``groups`` partitions by hash and packed there: sequence_id, offset, certified, moves."""
    columns = [c.split()[0] for c in PIECES.split(", ")]
    dealt = pieces.select(*columns, F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(groups)).alias("_group"))
    pack = _pack_group(capacity)
    return dealt.groupBy("_group").applyInArrow(lambda group: pack(group.select(columns)), PACKED)


def best_fit(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, group_size: int = 16_384, max_rounds: int = 12) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces.

    ``group_size`` bounds what one task packs at a time.  ``max_rounds`` bounds the exchange; a packing is whole
    after every round.
    """
    pieces = materialize(cut_pieces(docs, tokenizer_path, doc_id, text, capacity, end_id), "best-fit-pieces")
    full = pieces.where(F.col("length") == capacity).select("*", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    settled, columns = [full], full.columns

    def packed(rows: DataFrame, n: int, seed: int) -> tuple[DataFrame, int, int, int]:
        out = materialize(pack_once(rows, -(-n // group_size), seed, capacity), "best-fit-round")
        seen = out.agg(F.count_if(F.col("offset") == 0), F.count_if("moves"), F.count_if((F.col("offset") == 0) & F.col("moves"))).first()
        return out, *seen

    rest = pieces.where(F.col("length") < capacity)
    n = rest.count()
    if not n:
        return full.drop("item")
    now, _, moving, moving_sequences = packed(rest, n, 0)
    for seed in range(1, max_rounds):
        if moving_sequences < 2:
            break
        again, sequences, more, more_sequences = packed(now.where("moves"), moving, seed)
        if sequences >= moving_sequences:
            break
        settled.append(now.where("not moves").select(columns))
        now, moving, moving_sequences = again, more, more_sequences
    for part in [*settled[1:], now.select(columns)]:
        full = full.unionByName(part)
    return full.drop("item")


def lower_bound(pieces: DataFrame, capacity: int = 1024) -> int:
    """No packing of all ``pieces`` needs fewer sequences; the driver sees one count per length."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return least_sequences(counts, capacity)
