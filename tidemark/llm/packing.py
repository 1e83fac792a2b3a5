"""Packing of tokenized documents into fixed windows by minimum bin slack.

Each task tokenizes its own documents and packs them, so no text or token is shuffled.  A document
longer than a window is cut into full windows; what remains of each document is an item.  For one
window after another the longest item is placed and a bitset subset-sum over the multiset of the other
lengths (one machine-long integer, bit i = "sum i can be reached") finds the fill closest to the
capacity; the counts are read back along the recorded bitsets.  What slack is left is filled with the
beginning of the next item.  Windows are filled while the task holds more than ``pool`` items.  The last,
partly filled window of a task is cut into sequences of power-of-two lengths, which need no padding.

Cases: a null text counts as empty (its one id is the document end); repeated rows are packed each, also where
they share an id; an added token of the file that stands in a text gets its own id; an empty table gives no
pieces; a text may be of any length and hold any run of one character; texts are never cut short.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END = b"\0\0\0\0"


def subset_counts(lengths: list[tuple[int, int]], capacity: int) -> dict[int, int]:
    """How many items of each length fill ``capacity`` best; ``lengths``: (length, count) pairs."""
    reach, limit = 1, (1 << (capacity + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # (length, times, what was reached before)
    for length, count in lengths:
        if length > capacity:
            continue
        count, times = min(count, capacity // length), 1
        while count:
            times = min(times, count)
            more = (reach | reach << length * times) & limit
            if more != reach:
                steps.append((length, times, reach))
                reach = more
            count -= times
            times *= 2
        if reach >> capacity:
            break
    total, picked = reach.bit_length() - 1, defaultdict(int)
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            picked[length] += times
            total -= length * times
    return picked


class Packer:
    """Items (doc, start, length, ids, doc_tokens) wait by length; ``fill`` yields windows of them."""

    def __init__(self, capacity: int, pool: int):
        self.capacity, self.pool = capacity, pool
        self.items: dict[int, list] = defaultdict(list)
        self.waiting = 0

    def add(self, item: tuple) -> None:
        self.items[item[2]].append(item)
        self.waiting += 1

    def _take(self, length: int):
        item = self.items[length].pop()
        if not self.items[length]:
            del self.items[length]
        self.waiting -= 1
        return item

    def fill(self, last: bool) -> Iterator[list]:
        """Full windows while more than the pool waits; all, if ``last``."""
        while self.waiting > (0 if last else self.pool):
            seed = max(self.items)
            window = [self._take(seed)]
            rest = sorted(((n, len(v)) for n, v in self.items.items()), reverse=True)
            for length, times in subset_counts(rest, self.capacity - seed).items():
                window += [self._take(length) for _ in range(times)]
            slack = self.capacity - sum(x[2] for x in window)
            if slack and self.items:  # every item that is left is longer than the slack
                doc, start, length, ids, doc_tokens = self._take(min(self.items))
                window.append((doc, start, slack, ids[: 4 * slack], doc_tokens))
                self.add((doc, start + slack, length - slack, ids[4 * slack :], doc_tokens))
            yield window


#: The pre-token pattern of every ByteLevel file that asks for one (a fixed value; the file only names it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids of whole texts by a tokenizers file, added tokens included, exactly as the library's default call gives them.

    A byte-level BPE file whose merges are in the order of the ids (both is checked on load) is read as ranks and
    applied by tiktoken, several times faster.  Any other file, and any text that tiktoken's pattern engine gives
    up on (a million blanks in a row), goes through the tokenizers library.  A test holds both against each other.
    """

    def __init__(self, path: str):
        self.path, self._library = path, None
        described = json.loads(Path(path).read_text("utf-8"))
        self.fast = self._ranked(described) if self._is_ranked(described) else None

    @staticmethod
    def _is_ranked(described: dict) -> bool:
        model, split = described["model"], described.get("pre_tokenizer") or {}
        ids = model.get("vocab", {})
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not described.get("normalizer")
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        # an added token that is cut out of the raw text as it stands
        added = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in described.get("added_tokens", ()))
        in_order = all(a + b in ids for a, b in merges) and all(x < y for x, y in pairwise(ids[a + b] for a, b in merges))
        smallest = min((ids[a + b] for a, b in merges), default=0)
        single = len(ids) - len(merges)
        return plain and added and in_order and single == smallest == 256 and not any(model.get(k) for k in options)

    @staticmethod
    def _ranked(described: dict):
        import tiktoken

        byte_of = _alphabet()
        added = {t["content"]: t["id"] for t in described.get("added_tokens", ())}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in described["model"]["vocab"].items() if piece not in added}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def by_library(self, text: str) -> bytes:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        if self.fast is None:
            return self.by_library(text)
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except ValueError:  # the pattern needs more stack than there is
            return self.by_library(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


def _pack(tokenizer_path: str, capacity: int, pool: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        packer = Packer(capacity, pool)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        rows: list[tuple] = []

        def put(window: list) -> None:
            nonlocal sequence
            offset, room = 0, 0
            left = sum(x[2] for x in window)
            for doc, start, length, ids, doc_tokens in window:
                used = 0
                while used < length:
                    if room == 0:
                        room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
                    n = min(length - used, room)
                    rows.append((doc, start + used, n, zlib.crc32(ids[4 * used : 4 * (used + n)]), doc_tokens, sequence, offset))
                    used, offset, room, left = used + n, offset + n, room - n, left - n
                    if room == 0:
                        sequence, offset = sequence + 1, 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in text_batches(batches, 1):
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for doc, text in zip(docs, texts):
                ids = encode(text) + END
                n = len(ids) // 4
                full = n - n % capacity
                for start in range(0, full, capacity):
                    put([(doc, start, capacity, ids[4 * start : 4 * (start + capacity)], n)])
                if full < n:
                    packer.add((doc, full, n - full, ids[4 * full :], n))
            for window in packer.fill(False):
                put(window)
            yield flush()
        for window in packer.fill(True):
            put(window)
        if rows:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, pool: int = 512) -> DataFrame:
    """Pieces of all documents; ``sequence_id`` is unique over the tasks."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(_pack(tokenizer_path, capacity, pool), SCHEMA)
