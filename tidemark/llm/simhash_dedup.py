"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Every text gets a 64-bit SimHash of its word shingles.  For radius r, each bit i draws a vector
phi(i) of r + 1 bits; the table of a non-zero vector v keeps the bits with <phi(i), v> = 1 (mod 2).
Two fingerprints that differ in at most r bits leave some v orthogonal to all differing phi(i), so they
agree in that table: 2^(r+1) - 1 tables guarantee every pair, without exception.

Equal fingerprints are merged first.  Inside a bucket no list of pairs is made: a search from one
fingerprint to its unvisited neighbours yields one edge per fingerprint reached.  Buckets beyond
``block`` fingerprints are split by further bits, then as pairs of blocks, so that no task holds more than two
blocks of one bucket, and every pair still meets.  The edges are joined to groups by ``connected_components``.

Cases: a null or wordless text has fingerprint zero and links like any other; a text of fewer words than
a shingle is one shingle; repeated rows share a fingerprint; a null doc_id is never a group's smallest
unless all are null; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import join_groups, materialize, salted, salts_seen, text_batches


def simhash(text: str | None, width: int = 3) -> int:
    """Bit b is 1 if over half of the shingles' XXH64 (seed 42) have it; repeats count."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z only
    if not words:
        return 0
    n = max(len(words) - width + 1, 1)
    joined = b" ".join(words)
    ends, at = [], 0
    for w in words:
        at += len(w)
        ends.append(at)
        at += 1
    digest = xxhash.xxh64_intdigest
    last = min(width, len(words)) - 1
    starts = [0] + [e + 1 for e in ends[: n - 1]]
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[last:])], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1):
            values = np.array([simhash(t.as_py(), width) for t in batch.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long; map-only."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(_fingerprints(width), "doc_id long, fp long")


def covering_masks(radius: int, bits: int = 64, seed: int = 7) -> list[int]:
    """The 2^(radius+1) - 1 masks of a covering family, as unsigned integers.

    phi deals the non-zero vectors evenly over the bits, so that every table keeps about half of them.
    """
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i in range(bits) if (vectors[i] & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_edges(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links values within ``radius`` bits."""
    left, edges = values.view(np.uint64), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                front.extend(left[near])
                edges.extend((int(np.int64(x)), int(np.int64(y))) for y in left[near])
                left = left[~near]
    return edges


def _sorted_buckets(radius: int):
    """Rows arrive sorted by cell; each cell's edges leave when the cell ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[np.ndarray] = []
        current = None

        def out(edges: list) -> pa.RecordBatch:
            a, b = zip(*edges) if edges else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)], 1)
            values = batch.column(6).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            edges: list = []
            for a, b in zip([0, *cuts], [*cuts, len(values)]):
                key = tuple(keys[a])
                if key != current and held:
                    edges += bucket_edges(np.concatenate(held), radius)
                    held = []
                current = key
                held.append(values[a:b])
            yield out(edges)
        if held:
            yield out(bucket_edges(np.concatenate(held), radius))

    return run


def parts_outside(mask: int, parts: int, bits: int = 64) -> list[int]:
    """The bits that ``mask`` leaves out, dealt to ``parts`` masks."""
    free = [i for i in range(bits) if not mask >> i & 1]
    return [sum(1 << i for i in free[k::parts]) for k in range(parts)]


def near_edges(prints: DataFrame, radius: int = 3, block: int = 2048) -> DataFrame:
    """(a, b) pairs of fingerprints within ``radius`` that connect all such pairs of ``prints`` (column fp, distinct).

    A bucket of over ``block`` fingerprints is split by the bits that its table leaves out: dealt to radius + 1
    parts, one part at least agrees for every pair.  What is still over ``block`` then is dealt out as pairs of blocks.
    """
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    keyed = salted(prints.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp"), "fp")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), salts_seen()).where("n > 1")
    met = join_groups(keyed, sizes, "t", "key").select("t", "key", "fp", (F.col("n") > block).alias("large"))
    outside = F.array(*[F.array(*[F.lit(_signed(p)) for p in parts_outside(m, radius + 1)]) for m in masks])
    split = F.transform(F.get(outside, F.col("t")), lambda p, j: F.struct(j.alias("part"), F.col("fp").bitwiseAND(p).alias("key2")))
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("key2")))
    cell = ["t", "key", "part", "key2"]
    celled = met.select("t", "key", "fp", "large", F.explode(F.when(F.col("large"), split).otherwise(whole)).alias("x")).select("t", "key", "x.part", "x.key2", "fp", "large")
    hot = salted(celled.where("large").drop("large"), "fp")
    counts = hot.groupBy(*cell).agg(F.count("*").alias("n"), salts_seen()).where("n > 1")
    hot = join_groups(hot, counts, *cell).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    # a fingerprint of block k goes to the cells (i, k) with i <= k and (k, j) with k < j
    hot = hot.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    dealt = hot.select(*cell, "fp", F.explode(cells).alias("c")).select(*cell, "c.i", "c.j", "fp")
    cold = celled.where("not large").select(*cell, F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    keys = [*cell, "i", "j"]
    return cold.unionByName(dealt).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_sorted_buckets(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most ``radius`` bits."""
    prints = salted(materialize(fingerprints(docs, doc_id, text, width), "simhash-prints"), "doc_id")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), salts_seen()).withColumnRenamed("_salts", "_print_salts")
    classes = materialize(classes, "simhash-classes")
    edges = near_edges(classes.select("fp"), radius)
    groups = connected_components(edges)  # (node, root) over fingerprints that have a link
    rooted = classes.join(groups, classes["fp"] == groups["node"], "left").select("fp", "least", "_print_salts", F.coalesce("root", "fp").alias("root"))
    rooted = salted(rooted, "fp")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), salts_seen())
    named = join_groups(rooted, smallest, "root").select("fp", "component_id", F.col("_print_salts").alias("_salts"))
    return join_groups(prints, named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
