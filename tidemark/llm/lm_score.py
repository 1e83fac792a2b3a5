"""Stupid-backoff language-model scores of documents against their own corpus.

Bigram and unigram counts cover the whole corpus; a document's own counts are taken off before it is
scored, so that its copies of itself do not vouch for it:

    S(w | p) = c(p w) / c(p)            if c(p w) > 0
             = 0.4 (c(w) + 1) / (N + 1)  else; without the factor for the first word

    score = mean of log S over the words of the document

The count tables are relational: documents are dealt to chunks, each chunk sends its distinct n-grams
with their counts to the partitions of the count table by the n-gram's hash, the counts are summed there,
and the sums go back to the chunks that asked and are summed per document.  N-grams travel in sorted
arrays of differences, one row per chunk and partition, each once per chunk and not once per document, so
a frequent n-gram weighs no more than a rare one.

Cases: a null or wordless text has n_words 0 and score 0; repeated rows are counted and scored each; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BACKOFF = 0.4
SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])
LISTS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
LIST_COLUMNS = "bucket long, chunk long, grams binary, counts binary"
TOTALS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("totals", pa.binary())])
TOTAL_COLUMNS = "chunk long, bucket long, totals binary"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of ordered pairs of 64-bit hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """The n-grams of some documents: ``grams`` (sorted hashes), ``counts``, and where each occurs."""

    def __init__(self, texts: list[str | None]):
        number: dict[bytes, int] = {}
        words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        total = int(self.sizes.sum())
        ids = np.fromiter((number.setdefault(w, len(number)) for doc in words for w in doc), np.int64, total)
        del words
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        first = np.zeros(total, bool)
        first[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = True
        self.then = np.flatnonzero(~first)  # words that have a word before them
        pairs, pair_of = np.unique(ids[self.then - 1] << 32 | ids[self.then], return_inverse=True)
        pair_hashes = _mixed(hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF])
        # the hash 0 stands for the number of words
        grams = np.concatenate([np.zeros(1, np.uint64), hashes, pair_hashes])
        counts = np.concatenate([[total], np.bincount(ids, minlength=len(number)), np.bincount(pair_of, minlength=len(pairs))])
        order = np.argsort(grams, kind="stable")
        self.grams, self.counts = grams[order], counts[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.word_at = place[1 + ids]
        self.pair_at = place[1 + len(number) + pair_of]

    def scores(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log score of each document, given the corpus counts of ``grams``."""
        own = self._own(self.word_at, self.doc)
        corpus = totals[0] - self.sizes[self.doc]
        words = totals[self.word_at] - own
        value = np.log((words + 1) / (corpus + 1))
        pairs = totals[self.pair_at] - self._own(self.pair_at, self.doc[self.then])
        seen = pairs > 0
        backed = value[self.then] + math.log(BACKOFF)
        value[self.then] = np.where(seen, np.log(np.maximum(pairs, 1) / np.maximum(words[self.then - 1], 1)), backed)
        sums = np.bincount(self.doc, value, len(self.sizes))
        return self.sizes, np.where(self.sizes > 0, sums / np.maximum(self.sizes, 1), 0.0)

    def _own(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """How often the document itself has the n-gram at each place."""
        _, inverse, counts = np.unique(doc * len(self.grams) + at, return_inverse=True, return_counts=True)
        return counts[inverse]


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers by byte place, so that high bytes, mostly zero, compress in the shuffle."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _cuts(grams: np.ndarray, buckets: int) -> np.ndarray:
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]])


def _lists(buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        chunk = Chunk(docs.column("text").to_pylist())
        cuts, number = _cuts(chunk.grams, buckets), docs.column("chunk")[0].as_py()
        rows = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return pa.table([[i for i, _, _ in rows], [number] * len(rows), [_planes(np.diff(chunk.grams[a:b], prepend=np.uint64(0))) for _, a, b in rows], [_planes(chunk.counts[a:b]) for _, a, b in rows]], schema=LISTS)

    return run


#: N-grams that are sorted at a time where lists are merged.
MERGE = 1 << 18


def _merged(lists: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct n-grams of some lists (sorted), their sums, and where each list's n-grams stand among them.

    The lists are sorted, so they are merged range by range, and a range's places are written over its n-grams:
    beside the lists no more than a range is held several times.
    """
    grams = [np.cumsum(_numbers(x.as_py()), dtype=np.uint64) for x in lists.column("grams")]
    counts = [_numbers(x.as_py()) for x in lists.column("counts")]
    counts = [c.astype(np.uint32) if c.max() < 1 << 32 else c for c in counts]
    cuts = _range_cuts(grams)
    distinct, sums, known = [], [], 0
    for at, to in zip(cuts, cuts[1:]):
        some, place = np.unique(np.concatenate([g[a:b] for g, a, b in zip(grams, at, to)]), return_inverse=True)
        sums.append(np.bincount(place, np.concatenate([c[a:b] for c, a, b in zip(counts, at, to)]), len(some)).astype(np.int64))
        distinct.append(some)
        place += known
        known += len(some)
        for g, a, b, part in zip(grams, at, to, np.split(place, np.cumsum(to - at)[:-1])):
            g[a:b] = part.view(np.uint64)
    return np.concatenate(distinct), np.concatenate(sums), [g.view(np.int64) for g in grams]


def _range_cuts(grams: list[np.ndarray]) -> list[np.ndarray]:
    """Where each sorted list is cut, for ranges that hold about ``MERGE`` n-grams of all lists together."""
    ranges = -(-sum(map(len, grams)) // MERGE)
    longest = max(grams, key=len)  # hashes are even, so one list's quantiles are those of all
    edges = longest[np.arange(1, ranges) * len(longest) // ranges]
    inner = [np.searchsorted(g, edges) for g in grams]
    return [np.zeros(len(grams), np.int64), *np.array(inner, np.int64).reshape(len(grams), len(edges)).T, np.array([len(g) for g in grams], np.int64)]


def _totals(lists: pa.Table, whole: np.ndarray, places: list[np.ndarray]) -> pa.Table:
    return pa.table([lists.column("chunk"), lists.column("bucket"), [_planes(whole[at]) for at in places]], schema=TOTALS)


def _sums(lists: pa.Table) -> pa.Table:
    _, sums, places = _merged(lists)
    return _totals(lists, sums, places)


def _part_sums(lists: pa.Table) -> pa.Table:
    """One list for a part of a bucket's lists; the part stands where chunks do."""
    grams, sums, _ = _merged(lists)
    row = [[lists.column(c)[0].as_py()] for c in ("bucket", "part")]
    return pa.table([*row, [_planes(np.diff(grams, prepend=np.uint64(0)))], [_planes(sums)]], schema=LISTS)


def _hand_down(lists: pa.Table, totals: pa.Table) -> pa.Table:
    _, _, places = _merged(lists)
    return _totals(lists, _numbers(totals.column("totals")[0].as_py()), places)


def _scores(docs: pa.Table, totals: pa.Table) -> pa.Table:
    if not docs.num_rows:
        return SCORES.empty_table()
    chunk = Chunk(docs.column("text").to_pylist())
    parts = sorted(zip(totals.column("bucket").to_pylist(), totals.column("totals").to_pylist()))
    sizes, means = chunk.scores(np.concatenate([_numbers(p) for _, p in parts]).astype(np.int64))
    return pa.table([docs.column("doc_id"), sizes, means], schema=SCORES)


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = 4_000_000, bucket_chars: int = 24_000_000, fan_in: int = 4096) -> DataFrame:
    """(doc_id, n_words, log_score) of every document.

    ``chunk_chars`` and ``bucket_chars`` bound what a task holds: the numbers of chunks and of partitions
    of the count table follow the size of the corpus.  A frequent n-gram comes once per chunk: beyond ``fan_in``
    chunks their lists are summed in parts of so many first, the parts' sums are summed, and the totals are
    handed down through the parts, so no task meets an n-gram more than ``fan_in`` or chunks / ``fan_in`` times.
    """
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = picked.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    chunks, buckets = size // chunk_chars + 1, size // bucket_chars + 1
    dealt = picked.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition("chunk")
    lists = dealt.groupBy("chunk").applyInArrow(_lists(buckets), LIST_COLUMNS)
    if chunks <= fan_in:
        totals = lists.groupBy("bucket").applyInArrow(_sums, TOTAL_COLUMNS)
    else:
        parts = lists.withColumn("part", F.expr(f"chunk div {fan_in}")).groupBy("bucket", "part")
        sums = parts.applyInArrow(_part_sums, LIST_COLUMNS).groupBy("bucket").applyInArrow(_sums, TOTAL_COLUMNS)
        totals = parts.cogroup(sums.groupBy("bucket", "chunk")).applyInArrow(_hand_down, TOTAL_COLUMNS)
    return dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(_scores, "doc_id long, n_words long, log_score double")
