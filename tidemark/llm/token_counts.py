"""Token counts under a unigram model, by dynamic programming shared along a trie.

The distinct pre-tokens of a batch are inserted in a trie by sorting them, so that neighbours share
their longest prefix.  The unigram forward score of a prefix (its best segmentation into vocabulary
pieces) depends on the prefix alone, so it is computed once however many pre-tokens share it; at a
terminal the number of pieces on the best path is stored.  A document's count is the sum over its
pre-tokens.  Each task keeps the counts of pre-tokens it has met, up to ``cache_size``.

The pieces come from a public vocabulary file; its scores are ranks, so the unigram log probability of
a piece is Zipf's -log(rank + 2), rank from 0.  A character outside the vocabulary costs one token per
UTF-8 byte, at the score of the byte piece, as byte fallback does.  Ties go to fewer tokens.

Cases: a null or wordless text has no tokens; repeated rows are counted each; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_batches

MARK = "▁"  # the vocabulary's sign for a blank before a word


@lru_cache(maxsize=2)
def vocabulary(path: str) -> "Vocabulary":
    """One vocabulary, and one table of known counts, for all tasks of a worker process."""
    return Vocabulary(path)


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.cost = {model.id_to_piece(i): math.log(rank + 2) for rank, i in enumerate(plain)}
        self.longest = max(map(len, self.cost))
        self.byte_cost = math.log(len(plain) + 2)
        self.ends: dict[str, list[int]] = {}
        for piece in self.cost:
            self.ends.setdefault(piece[-1], []).append(len(piece))
        self.ends = {c: sorted(set(n)) for c, n in self.ends.items()}
        self.known: dict[bytes, int] = {}


class SharedForward:
    """Forward scores of the prefixes on the current path of the trie."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.path = ""
        self.best: list[tuple[float, int]] = [(0.0, 0)]  # (cost, tokens) of every prefix of the path

    def tokens(self, pretoken: str) -> int:
        """Tokens of the best segmentation; call with sorted pre-tokens to share most."""
        v, best, path = self.v, self.best, self.path
        shared, limit = 0, min(len(path), len(pretoken))
        while shared < limit and path[shared] == pretoken[shared]:
            shared += 1
        del best[shared + 1 :]
        for end in range(shared + 1, len(pretoken) + 1):
            c = pretoken[end - 1]
            found = None
            for n in v.ends.get(c, ()):
                if n > end:
                    break
                cost = v.cost.get(pretoken[end - n : end])
                if cost is not None:
                    before = best[end - n]
                    option = (before[0] + cost, before[1] + 1)
                    if found is None or option < found:
                        found = option
            if found is None:
                n, before = len(c.encode("utf-8", "surrogatepass")), best[end - 1]
                found = (before[0] + n * v.byte_cost, before[1] + n)
            best.append(found)
        self.path = pretoken
        return best[-1][1]


def _count(path: str, cache_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path)
        known = model.known
        for batch in text_batches(batches, 1):
            words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in batch.column(1).to_pylist()]
            if len(known) > cache_size:
                known.clear()
            forward = SharedForward(model)
            for w in sorted({w for doc in words for w in doc if w not in known}):
                known[w] = forward.tokens(MARK + w.decode("utf-8", "surrogatepass"))
            counts = [sum([known[w] for w in doc]) for doc in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in words], pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", cache_size: int = 400_000) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens); map-only, whole texts."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(_count(vocabulary_path, cache_size), "doc_id long, n_pretokens long, n_tokens long")


def count_one(text: str | None, vocabulary: Vocabulary) -> int:
    """The same count without any sharing, for tests."""
    return sum(n * SharedForward(vocabulary).tokens(MARK + w.decode("utf-8", "surrogatepass")) for w, n in Counter((text or "").encode().split()).items())
