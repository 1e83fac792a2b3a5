"""Benchmark decontamination by SimHash of item-sized windows; DataFrame functions only.

A window as long as a benchmark item can reach the similarity ``threshold`` only if at least that part of its
shingles occur in some item.  So one pass over the texts marks the positions of shingles that any item holds, and
windows of each item length are cut where they hold enough marks, whichever items these belong to (one window from
each mark on, and one from the head of the text to each mark, which covers passages that the text cuts off).  Each
window gets a 64-bit SimHash of its shingles.  Multi-index Hamming blocks find all items within ``RADIUS`` bits: a
fingerprint is cut in ``BLOCKS`` blocks, and of two fingerprints within the radius one block at least differs in
``FLIPS`` bits or fewer; items and windows are entered under the variants of their blocks in half of these bits each.

Blocks of 8 bits alone would select little, since 23 of 64 bits are many.  So the entries of an item are dealt by a
second key that loses nothing: of the n shingles of an item a window at the threshold lacks at most n - ceil(0.8 n),
so it holds one of any n - ceil(0.8 n) + 1 of them.  Every item is entered under that many of its rarest shingles;
windows without such a shingle are not cut at all, and the others ask under those that they hold.  Such keys are
as rare as items allow, so none is hot.

The pairs of text and item that are found are verified by the exact similarity of the weighted shingles (weight = how often a shingle occurs) of
every window that a shared shingle aligns with the item; the best one is reported.

At a similarity of exactly 0.8 two fingerprints differ in 9.7 bits on average (deviation 2.9), so 23 bits leave out
about one in a million such pairs and fewer above; a test measures the recall.

Words are runs of letters and digits, lower-cased.

Cases: a null or empty text has no words; a document shorter than the item is compared as a whole; an item of fewer
than five words has no shingle and matches nothing; rows that share a doc_id (or an item_id) are judged each and
reported under that id; repeated rows are one; null ids are ids; other columns, whatever their names, are not
touched; a text of any length is judged whole, at a cost linear in its length; an empty table on either side gives an
empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import MAX_BROADCAST_ROWS, broadcast_if_small, join_groups, materialize, salted, salts_seen

WORDS = r"[\p{L}\p{N}]+"
WIDTH = 5
RADIUS, BLOCKS = 23, 8
FLIPS = RADIUS // BLOCKS
#: (first bit, number of bits) of the blocks.
CUTS = [(64 * b // BLOCKS, 64 * (b + 1) // BLOCKS - 64 * b // BLOCKS) for b in range(BLOCKS)]
KEY = ["doc_id", "th"]


def words_of(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns ``keep`` and _w, the text's words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORDS), F.lit(0))
    # an explode of one element holds the projections apart: else the words would be extracted anew for every shingle
    return df.select(*keep, F.explode(F.array(words)).alias("_w"))


def hash_at(i: str) -> str:
    return f"xxhash64({', '.join(f'get(_w, {i} + {k})' for k in range(WIDTH))})"


def with_shingles(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns ``keep`` and sh: the hashes of the text's five-word shingles, in order."""
    hashes = f"transform(sequence(0, size(_w) - {WIDTH}), i -> {hash_at('i')})"
    return words_of(df, text, *keep).select(*keep, F.expr(f"if(size(_w) < {WIDTH}, cast(array() as array<bigint>), {hashes})").alias("sh"))


def shingle_rows(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns ``keep``, size (the text's number of shingles), pos and h: one row per shingle.

    Positions are exploded and hashed in generated code; functions on arrays would be interpreted.
    """
    words = words_of(df, text, *keep).withColumn("size", F.size("_w") - WIDTH + 1).where("size > 0")
    return words.select(*keep, "size", "_w", F.expr("explode(sequence(0, size - 1))").alias("pos")).select(*keep, "size", "pos", F.expr(hash_at("pos")).alias("h"))


def simhash(shingles: str) -> Column:
    """The 64-bit SimHash of an array column of hashes: a bit is 1 if it is in over half of them, repeats included.

    Bits are counted side by side in lanes of one long, wide enough for the array's size.
    """

    def counted(lane: int) -> str:
        ones = sum(1 << i for i in range(0, 64, lane))
        sums = f"transform(sequence(0, {lane - 1}), k -> struct(k, aggregate({shingles}, 0L, (a, x) -> a + (shiftrightunsigned(x, k) & {ones}L)) as a))"
        bits = f"aggregate(sequence(0, {64 // lane - 1}), 0L, (g, j) -> if(2 * (shiftrightunsigned(y.a, {lane} * j) & {(1 << lane) - 1}L) > size({shingles}), g | shiftleft(1L, y.k + {lane} * j), g))"
        return f"aggregate({sums}, 0L, (f, y) -> f | {bits})"

    # the uppermost lane may not reach the sign
    return F.expr(f"case when size({shingles}) < 128 then {counted(8)} when size({shingles}) < 32768 then {counted(16)} else {counted(32)} end")


def blocks_of(fp: str, flips: int = 0) -> Column:
    """Array of (block, key): the blocks of a fingerprint, in all variants of at most ``flips`` bits."""
    variants = []
    for b, (first, width) in enumerate(CUTS):
        masks = ", ".join(str(sum(1 << i for i in bits)) for n in range(flips + 1) for bits in combinations(range(width), n))
        own = f"cast(shiftrightunsigned({fp}, {first}) & {(1 << width) - 1}L as int)"
        variants.append(F.expr(f"transform(array({masks}), m -> struct({b} as block, {own} ^ m as key))"))
    return F.flatten(F.array(*variants))


def rare_shingles(grams: DataFrame, threshold: float) -> DataFrame:
    """(k, n, h): of each item as many of its rarest shingles (``grams``: k, n, q, h) that no similar window lacks all of them."""
    held = grams.groupBy("h").agg(F.count_distinct("k").alias("_held"))
    order = F.row_number().over(Window.partitionBy("k").orderBy("_held", "h", "q"))
    ranked = grams.join(held, "h").withColumn("_rank", order)
    return ranked.where(F.col("_rank") <= F.col("n") - needed(threshold) + 1).select("k", "n", "h").distinct()


def needed(threshold: float) -> Column:
    """How many of an item's n shingles a window at the threshold holds at least."""
    return F.ceil(F.col("n") * threshold - 1e-9).cast("int")


def met_items(prints: DataFrame, items: DataFrame) -> DataFrame:
    """(n, fp, _f, k): fingerprints of windows (n, fp, h: a rare shingle) and of items (k, n, fp, h) that meet in a block."""
    entries = items.select("n", "h", "k", F.col("fp").alias("_f"), F.explode(blocks_of("fp", (FLIPS + 1) // 2)).alias("x")).select("n", "h", "k", "_f", "x.block", "x.key")
    if entries.count() <= MAX_BROADCAST_ROWS:
        entries = F.broadcast(entries)
    asked = prints.select("n", "fp", "h", F.explode(blocks_of("fp", FLIPS // 2)).alias("x")).select("n", "fp", "h", "x.block", "x.key")
    return asked.join(entries, ["n", "h", "block", "key"]).select("n", "fp", "_f", "k").distinct()


def fingerprints(texts: DataFrame, hits: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, th, n, fp, hs): fingerprints of the windows that hold enough marks, and the rare shingles (of items of n) in them."""
    mark = F.struct("pos", F.when(F.array_contains("rare_in", F.col("n")), F.col("h")).alias("h"))
    marks = hits.select(*KEY, "size", "pos", "h", "rare_in", F.explode("ns").alias("n")).groupBy(*KEY, "size", "n").agg(F.array_sort(F.collect_set(mark)).alias("p"))
    marks = marks.withColumn("need", needed(threshold)).where(F.size("p") >= F.col("need"))
    rare = "transform(filter(slice(p, {first}, n), y -> y.h is not null and y.pos < {end}), y -> y.h)"
    since = F.expr(f"transform(p, (x, i) -> if(get(p, i + need - 1).pos < x.pos + n, struct(x.pos as s, least(n, size - x.pos) as m, {rare.format(first='i + 1', end='x.pos + n')} as hs), null))")
    until = F.expr(f"transform(filter(slice(p, need, greatest(size(p) - need + 1, 0)), x -> x.pos < n - 1), x -> struct(0 as s, x.pos + 1 as m, {rare.format(first='1', end='x.pos + 1')} as hs))")
    laid = marks.select(*KEY, "n", F.filter(F.concat(since, until), lambda w: w.isNotNull() & (F.size(w["hs"]) > 0)).alias("w")).where("size(w) > 0")
    laid = materialize(laid, "leak-windows")
    keys = laid.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    if laid.count() <= MAX_BROADCAST_ROWS:
        keys = F.broadcast(keys)
    some = texts.join(keys, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left_semi")
    cut = with_shingles(some.dropDuplicates(KEY), "_text", *KEY).withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    cut = laid.join(cut, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
    # cut inside the row, so that an exploded row holds its window alone
    cut = cut.select(*KEY, "n", F.explode(F.transform("w", lambda x: F.struct(F.slice("sh", x["s"] + 1, x["m"]).alias("win"), x["hs"].alias("hs")))).alias("x"))
    cut = cut.select(*KEY, "n", "x.win", "x.hs")
    return materialize(cut.select(*KEY, "n", simhash("win").alias("fp"), F.array_sort(F.array_distinct("hs")).alias("hs")).distinct(), "leak-prints")


def candidates(cut: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, th, k): texts with a window (``fingerprints``) within ``RADIUS`` bits of an item of its length."""
    met = met_items(cut.select("n", "fp", F.explode("hs").alias("h")).distinct(), items)
    near = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("_f"))) <= RADIUS).groupBy("n", "fp").agg(F.collect_set("k").alias("ks"))
    windows = salted(cut.select(*KEY, "n", "fp").distinct(), *KEY)
    near = near.join(windows.groupBy("n", "fp").agg(salts_seen()), ["n", "fp"])
    return join_groups(windows, near, "n", "fp").select(*KEY, F.explode("ks").alias("k")).distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, position, similarity): the best window of every document and item that match."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("_text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("_t")).where("_t is not null").distinct()
    items = items.withColumn("k", F.xxhash64("item_id", F.col("item_id").isNull(), "_t"))
    items = with_shingles(items, "_t", "k", "item_id").where("size(sh) > 0").withColumn("n", F.size("sh"))
    items = materialize(items.select("k", "item_id", "n", "sh", simhash("sh").alias("fp")), "leak-items")
    grams = items.select("k", "n", F.posexplode("sh").alias("q", "h"))
    rare = materialize(rare_shingles(grams, threshold), "leak-rare")
    rare_in = rare.groupBy("h").agg(F.collect_set("n").alias("rare_in"))
    named, lengths = items.select("k", "item_id"), grams.groupBy("h").agg(F.collect_set("n").alias("ns")).join(rare_in, "h", "left")
    counts = grams.groupBy("k", "h").agg(F.count("*").alias("wanted"))
    if grams.count() <= MAX_BROADCAST_ROWS:
        grams, named, lengths, counts = map(F.broadcast, (grams, named, lengths, counts))
    hits = shingle_rows(texts, "_text", *KEY).join(lengths, "h")
    hits = materialize(hits.select(*KEY, "size", "pos", "h", "ns", "rare_in"), "leak-hits").dropDuplicates([*KEY, "pos"])
    found = candidates(fingerprints(texts, hits, threshold), items.select("k", "n", "fp").join(rare, ["k", "n"])).withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    shared = hits.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).select(*KEY, "size", "pos", "h", "k").join(grams, ["k", "h"])
    shared = materialize(shared.select(*KEY, "size", "pos", "h", "k", "n", "q"), "leak-shared")
    starts = shared.select(*KEY, "k", "n", "size", (F.col("pos") - F.col("q")).alias("start")).distinct()
    span = F.sequence(F.greatest("start", F.lit(0)), F.least(F.col("start") + F.col("n"), "size") - 1)
    inside = starts.select(*KEY, "k", "n", "start", F.size(span).alias("m"), F.explode(span).alias("pos"))
    place = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "doc_id" else F.col(c) == F.col(f"_{c}") for c in (*KEY, "k", "pos")]
    held = shared.select(*[F.col(c).alias(f"_{c}") for c in (*KEY, "k", "pos")], "h").distinct()
    window = [*KEY, "k", "n", "start", "m"]
    both = inside.join(held, place[0] & place[1] & place[2] & place[3]).groupBy(*window, "h").agg(F.count("*").alias("had")).join(counts, ["k", "h"])
    both = both.groupBy(*window).agg(F.sum(F.least("had", "wanted")).alias("both"))
    checked = both.withColumn("similarity", F.col("both") / (F.col("m") + F.col("n") - F.col("both"))).where(F.col("similarity") >= threshold)
    best = checked.join(named, "k").groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.greatest("start", F.lit(0))).alias("back"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.back")).cast("long").alias("position"), F.round("b.similarity", 6).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    leaking = find_leaks(docs, benchmark, doc_id, text, threshold=threshold).select(F.col("doc_id").alias("_leak")).distinct()
    leaking = broadcast_if_small(materialize(leaking, "leaks"))
    return docs.join(leaking, F.col(doc_id).cast("long").eqNullSafe(F.col("_leak")), "left_anti")
