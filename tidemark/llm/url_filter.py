"""URL lists as Bloom filter cascades.

Level 0 of a cascade holds the listed keys.  Level 1 holds the keys of the corpus that level 0 accepts
by mistake, level 2 the listed keys that level 1 accepts by mistake, and so on until a level makes none.
The levels are built over the corpus's complete key universe, so for every key of the corpus the answer
is exact, and URLs are judged in map-only passes, without a join.

A url's keys are its host's suffixes (host and parent domains, as far as a rule's host has labels) with the path
prefixes of the lengths that the rules have; one cascade holds all rule keys, a second those that block, a third
listed hosts.  A list of hosts that would need more than ``max_bytes`` of filters is cut by the hosts' hash: each
part has a cascade of its own, and the urls of that part are judged with it.

Cases: a null url or one without ``://`` has empty host and path and no rule; a null page_id is kept; repeated rows
are judged each; null listed hosts and repeated ones count for nothing; empty tables give empty results; a host or
path may be of any length; other columns of ``pages``, whatever their names, are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize

#: What one cascade may take in every Python worker that uses it; some 37 million keys.
MAX_FILTER_BYTES = 32 << 20
#: Words of a filter that travel to the driver as one row (64 kB).
PAGE = 8192


def _places(key: str, level: int, bits: int, hashes: int) -> list[int]:
    x = xxhash.xxh64_intdigest(key, level)
    a, b = x & 0xFFFFFFFF, x >> 32 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Level:
    def __init__(self, number: int, bits: int, hashes: int, words: np.ndarray):
        self.number, self.bits, self.hashes, self.words = number, bits, hashes, words

    def accepts(self, key: str) -> bool:
        words = self.words
        return all(int(words[p >> 6]) >> (p & 63) & 1 for p in _places(key, self.number, self.bits, self.hashes))


class Cascade:
    """Exact membership for the keys of the universe it was built over."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if not level.accepts(key):
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def _shape(size: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) of a level."""
    hashes = max(1, round(-math.log2(rate)))
    return max(64, math.ceil(size * hashes / math.log(2))), hashes


def _filter_pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (page, w, x), all of a page in one task and in order, to one row of bytes per page."""
    page, words = None, np.zeros(PAGE, np.uint64)
    for frame in frames:
        for p, rows in frame.groupby("page", sort=False):
            if p != page and page is not None:
                yield pd.DataFrame({"page": [page], "words": [words.tobytes()]})
                words = np.zeros(PAGE, np.uint64)
            page = p
            words[rows["w"].to_numpy() % PAGE] = rows["x"].to_numpy().view(np.uint64)
    if page is not None:
        yield pd.DataFrame({"page": [page], "words": [words.tobytes()]})


def _build_level(keys: DataFrame, number: int, size: int, rate: float) -> Level:
    """A Bloom filter of the column ``key``: tasks set the bits, the shuffle merges them, tasks pack them to pages."""
    bits, hashes = _shape(size, rate)

    @F.pandas_udf("array<long>")
    def places(key: pd.Series) -> pd.Series:
        return pd.Series([_places(k, number, bits, hashes) for k in key])

    placed = keys.select(F.explode(places("key")).alias("p"))
    words = placed.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("x"))
    paged = words.withColumn("page", F.floor(F.col("w") / PAGE)).repartition("page").sortWithinPartitions("page").select("page", "w", "x")
    table = np.zeros((bits + 63) // 64, np.uint64)
    for row in paged.mapInPandas(_filter_pages, "page long, words binary").toLocalIterator():  # 64 kB each, max_bytes in all
        at = row["page"] * PAGE
        part = np.frombuffer(bytes(row["words"]), np.uint64)
        table[at : at + PAGE] = part[: len(table) - at]
    return Level(number, bits, hashes, table)


def _accepted(level: Level, spark: SparkSession):
    held = spark.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def accepted(key: pd.Series) -> pd.Series:
        return pd.Series([held.value.accepts(k) for k in key], dtype=bool)

    return accepted


def build_cascade(listed: DataFrame, universe: DataFrame, rate: float = 1 / 32) -> Cascade:
    """The cascade of ``listed`` keys over the keys of ``universe``; both have a column ``key``.

    It takes about -log2(rate) / ln 2 bits per listed key at level 0, and a small part of that beyond.
    """
    flags = listed.select("key", F.lit(1).alias("on")).unionByName(universe.select("key", F.lit(0).alias("on")))
    flags = materialize(flags.where("key is not null").groupBy("key").agg(F.max("on").alias("on")), "url-universe")
    encode, against, levels = flags.where("on = 1").select("key"), flags.where("on = 0").select("key"), []
    while size := encode.count():
        levels.append(_build_level(encode, len(levels), size, rate))
        encode, against = materialize(against.where(_accepted(levels[-1], flags.sparkSession)("key")), "url-level"), encode
    return Cascade(levels)


def small_cascade(listed: Iterable[str], universe: Iterable[str], rate: float = 1 / 32) -> Cascade:
    """The same for keys that a user wrote down, such as rules."""
    encode = set(listed)
    against, levels = set(universe) - encode, []
    while encode:
        bits, hashes = _shape(len(encode), rate)
        words = np.zeros((bits + 63) // 64, np.uint64)
        for p in (p for k in encode for p in _places(k, len(levels), bits, hashes)):
            words[p >> 6] |= np.uint64(1 << (p & 63))
        levels.append(Level(len(levels), bits, hashes, words))
        encode, against = {k for k in against if levels[-1].accepts(k)}, encode
    return Cascade(levels)


def split_url(url: str) -> tuple:
    """Columns (host, path) of a url column."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def rule_keys(lengths: Iterable[int], labels: int, host: str = "host", path: str = "path"):
    """Keys of a url that a rule may name, the longest first: hosts of up to ``labels`` labels, path prefixes of ``lengths``."""
    suffixes = F.array_distinct(F.array(*[F.substring_index(host, ".", -k) for k in range(1, labels + 1)]))

    def with_prefix(n: int):
        return F.when(F.length(path) >= n, F.transform(suffixes, lambda s: F.concat(s, F.substring(path, 1, n)))).otherwise(F.array().cast("array<string>"))

    keys = F.flatten(F.array(*map(with_prefix, sorted(set(lengths)))))
    return F.array_sort(F.array_distinct(keys), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], listed_hosts: DataFrame | None = None, page_id: str = "page_id", url: str = "url", max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    ``rules``: (action, host/path) with action allow or block; the longest that fits decides.  A url that no
    rule fits is blocked if its host is among ``listed_hosts`` (column host), else allowed.
    """
    spark: SparkSession = pages.sparkSession
    host, path = split_url(url)
    urls = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    lengths = {len(r.partition("/")[1] + r.partition("/")[2]) for _, r in rules}
    labels = max((r.partition("/")[0].count(".") + 1 for _, r in rules), default=1)
    keyed = urls.withColumn("keys", rule_keys(lengths, labels) if rules else F.array().cast("array<string>"))
    in_rules = build_cascade(spark.createDataFrame([(r,) for _, r in rules], "key string"), keyed.select(F.explode("keys").alias("key")))
    blocks = small_cascade([r for a, r in rules if a == "block"], [r for _, r in rules])

    def judged(some: DataFrame, in_hosts: Cascade) -> DataFrame:
        held = spark.sparkContext.broadcast((in_rules, blocks, in_hosts))

        @F.pandas_udf("rule string, verdict string")
        def verdict(keys: pd.Series, host: pd.Series) -> pd.DataFrame:
            in_rules, blocks, in_hosts = held.value
            rule = [next((k for k in ks if k in in_rules), None) for ks in keys]
            blocked = [r in blocks if r is not None else h in in_hosts for r, h in zip(rule, host)]
            return pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": ["block" if b else "allow" for b in blocked]})

        return some.withColumn("v", verdict("keys", "host")).select("page_id", "host", "path", "v.rule", "v.verdict")

    if listed_hosts is None:
        return judged(keyed, Cascade([]))
    listed = materialize(listed_hosts.select(F.col("host").alias("key")).where("key is not null").distinct(), "url-listed")
    parts = 1 + _shape(listed.count(), 1 / 32)[0] // 8 // max_bytes
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    hosts = urls.select(F.col("host").alias("key"))
    out = None
    for k in range(parts):
        cascade = build_cascade(listed.where(part("key") == k), hosts.where(part("key") == k))
        one = judged(keyed.where(part("host") == k), cascade)
        out = one if out is None else out.unionByName(one)
    return out


def farm_hosts(pages: DataFrame, url: str = "url", factor: float = 1.5) -> DataFrame:
    """Hosts (link farms, crawler traps) that serve at least ``factor`` times as many pages as a host does on average."""
    host, _ = split_url(url)
    counts = pages.select(host.alias("host")).where("host <> ''").groupBy("host").agg(F.count("*").alias("n"))
    mean = counts.agg((F.sum("n") / F.count("*")).alias("m")).first()["m"]  # one number
    return counts.where(F.col("n") >= F.lit(factor * (mean or 0.0))).select("host")
