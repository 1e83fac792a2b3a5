"""Line deduplication by winnowing over line hashes; DataFrame functions only.

Every line with a word is hashed.  A stretch is the shortest run of lines that holds at least ``min_words``
words, either from a line on (forward) or up to a line (backward).  Of each stretch the line with the
smallest hash (the rightmost on ties) is selected as its fingerprint.  Equal stretches select the same line,
so a stretch whose fingerprint is selected at one position only is not repeated and is left out.

The remaining positions are joined by the content of their whole stretch: each content has one first position
of its own (documents are ordered by doc_id, then by a hash of the text), however common its lines are
elsewhere.  Every later position of the same content is a match.  A match is extended to the left by the
forward stretches that begin before it and to the right by the backward stretches that end after it: together
they cover exactly the lines of every run of ``min_words`` words or more that occurs earlier, and these lines
are deleted.  The first copy of any line always stays.  The work is linear in the lines, equal ones
included; stretches of one content are salted, never paired.

Cases: a null text stays null; an empty text stays empty; blank lines are never deleted and do not
interrupt a run; rows that repeat both doc_id and text are one document, so each gets the same result;
a null doc_id counts as one that comes first; a text may be one line or a million equal ones; other columns
pass through, whatever their names; an empty table gives an empty result.

``dedup_words``, which the pipeline uses, does the same for words wherever lines break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import intermediate_tables, join_groups, materialize, parted, remove_tables, salted, salts_seen

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
KEY = ["doc", "th"]
#: The words of a repeated passage for ``dedup_words``, and of the stretches that stand for one.
RUN, HALF = 50, 25


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, th, pos, c, e, nw, h, g): one row per line with a word, dealt by document.

    ``c`` counts the words before a line, ``e`` those up to its end; ``h`` and ``g`` are two hashes of the line.
    """
    lines = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.select(*KEY, "pos", F.regexp_count("line", F.lit(WORD)).alias("nw"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(9), "line").alias("g")).where("nw > 0")
    lines = lines.repartition(*KEY).dropDuplicates([*KEY, "pos"])
    upto = F.sum("nw").over(Window.partitionBy(*KEY).orderBy("pos"))
    return lines.withColumn("e", upto).withColumn("c", F.col("e") - F.col("nw"))


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc, th, s, z, at, h, g, x, y): lines s to z, the selected line at ``at`` with its hashes, and two hashes of the whole content."""
    least = F.min(F.struct("h", (-F.col("pos")).alias("back"), "g"))
    begun = Window.partitionBy(*KEY).orderBy("c").rangeBetween(0, min_words - 1)
    ended = Window.partitionBy(*KEY).orderBy("e").rangeBetween(1 - min_words, 0)

    def found(frame):
        content = [F.xxhash64(F.collect_list(c).over(frame)).alias(n) for c, n in (("h", "x"), ("g", "y"))]
        return F.struct(F.min("pos").over(frame).alias("s"), F.max("pos").over(frame).alias("z"), F.sum("nw").over(frame).alias("words"), least.over(frame).alias("f"), *content)

    both = lines.withColumn("a", found(begun)).withColumn("first_z", F.first("a.z").over(ended)).withColumn("b", found(ended))
    # a backward stretch that is also a forward one counts once
    backward = F.when(F.col("first_z") != F.col("b.z"), F.col("b"))
    out = both.select(*KEY, F.explode(F.array("a", backward)).alias("r")).where(F.col("r.words") >= min_words)
    return out.select(*KEY, "r.s", "r.z", (-F.col("r.f.back")).alias("at"), "r.f.h", "r.f.g", "r.x", "r.y")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(doc, th, s, z): the stretches of lines to delete, each with an earlier copy."""
    runs = salted(materialize(stretches(line_table(docs, doc_id, text), min_words), "dedup-stretches"), *KEY, "s", "z")
    at = F.struct(*KEY, "at")
    prints = runs.groupBy("h", "g").agg(F.min(at).alias("a"), F.max(at).alias("b"), salts_seen()).where("a <> b").drop("a", "b")
    shared = salted(materialize(join_groups(runs, prints, "h", "g").select(*KEY, "s", "z", "x", "y"), "dedup-shared"), *KEY, "s", "z")
    place = F.struct(*KEY, "s", "z")
    first = shared.groupBy("x", "y").agg(F.min(place).alias("a"), F.count("*").alias("n"), salts_seen()).where("n > 1").drop("n")
    return join_groups(shared, first, "x", "y").where(place != F.col("a")).select(*KEY, "s", "z")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with the repeated runs cut out of ``text``, and the columns n_lines, n_removed."""
    gone = repeated_lines(docs, doc_id, text, min_words).groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("s", "z"))).alias("r"))
    # one flag per line, up to the last deleted one: built in one pass, read by index; the ends rise with the begins
    before = F.expr("transform(r, (x, i) -> struct(x.s as s, x.z as z, if(i > 0, get(r, i - 1).z, -1) as p))")
    flags = F.expr("array_join(transform(q, x -> concat(repeat('1', greatest(x.s - x.p - 1, 0)), repeat('0', x.z - greatest(x.s - 1, x.p)))), '')")
    gone = gone.select(*KEY, F.explode(F.array(before)).alias("q")).select(F.col("doc").alias("_td_doc"), F.col("th").alias("_td_th"), F.split(flags, "").alias("_td_flags"))
    joined = docs.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("_td_doc")) & (F.xxhash64(text) == F.col("_td_th")), "left")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x, i: F.coalesce(F.get("_td_flags", i) == "1", F.lit(True)) | ~x.rlike(WORD))
    joined = joined.withColumn("_td_kept", F.when(F.col("_td_th").isNotNull(), kept)).withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)))
    out = joined.withColumn("n_removed", F.coalesce(F.col("n_lines") - F.size("_td_kept"), F.lit(0)))
    return out.withColumn(text, F.coalesce(F.array_join("_td_kept", "\n"), F.col(text))).drop("_td_doc", "_td_th", "_td_flags", "_td_kept")


def _windows(docs: DataFrame, doc_id: str, text: str, *keep: str) -> DataFrame:
    """(doc, th, *keep, n, h): the number of words, and the hashes of all stretches of ``HALF`` words, in order."""
    words = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("th"), *keep, F.explode(F.array(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)))).alias("_w"))
    # explodes of one element hold the projections apart: else each would be computed anew inside the next
    words = words.where(F.size("_w") >= RUN).withColumn("n", F.size("_w"))
    fives = F.expr(f"transform(sequence(0, n - 5), i -> xxhash64({', '.join(f'get(_w, i + {k})' for k in range(5))}))")
    words = words.select(*KEY, *keep, "n", F.explode(F.array(fives)).alias("_f"))
    halves = F.expr(f"transform(sequence(0, n - {HALF}), i -> xxhash64({', '.join(f'get(_f, i + {k})' for k in range(0, HALF, 5))}))")
    return words.select(*KEY, *keep, "n", F.explode(F.array(halves)).alias("h"))


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(th, least, starts): per text its smallest doc_id and, sorted, the windows of ``RUN`` words that occur earlier.

    Holds the texts that have such a window or occur under several ids.  Each window selects the smallest hash
    of its stretches of ``HALF`` words; equal windows select equal hashes, so only windows whose hash is
    selected twice are looked up.  They are grouped by the content of the whole window.
    """
    picked = _windows(docs, doc_id, text).select(*KEY, "n", "h", F.explode(F.array(F.expr(f"transform(sequence(1, n - {RUN - 1}), i -> array_min(slice(h, i, {RUN - HALF + 1})))"))).alias("m"))
    begins = F.expr("filter(sequence(0, size(m) - 1), i -> i = 0 or get(m, i) <> get(m, i - 1))")
    # a text that repeats a stretch may do so within one run of equal minima: it counts twice
    picked = picked.select(*KEY, "m", F.when(F.size(F.array_distinct("h")) < F.size("h"), 2).otherwise(1).alias("c"), F.explode(F.array(begins)).alias("b"))
    runs = picked.select(*KEY, "c", F.explode(F.expr("transform(b, (s, k) -> struct(s as s, coalesce(get(b, k + 1), size(m)) as e, get(m, s) as f))")).alias("r"))
    with intermediate_tables() as used:
        runs = materialize(runs.select(*KEY, "c", "r.s", "r.e", "r.f"), "dedup-runs")
    # equal texts are one: the one with the smallest id
    texts = runs.where("s = 0").groupBy("th").agg(F.min(F.struct("doc")).alias("a"), F.max(F.struct("doc")).alias("z"))
    texts = materialize(texts.select("th", F.col("a.doc").alias("least"), (F.col("a") != F.col("z")).alias("copied")), "dedup-texts")
    once = runs.groupBy("th", "s", "e", "f", "c").agg(F.min(F.struct("doc")).alias("a")).select(F.col("a.doc").alias("doc"), "th", "s", "e", "f", "c")
    with intermediate_tables() as last:
        once = materialize(once, "dedup-prints")
    remove_tables(docs.sparkSession, used)
    prints = salted(once, "th", "s")
    twice = prints.groupBy("f").agg(F.sum("c").alias("n"), salts_seen()).where("n > 1")
    marks = join_groups(prints, twice, "f").groupBy(*KEY).agg(F.collect_set(F.struct("s", "e")).alias("_runs"))
    marks = materialize(marks.select(F.col("doc").alias("_d"), F.col("th").alias("_t"), "_runs"), "dedup-marks")
    remove_tables(docs.sparkSession, last)
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_t"))
    holding, _ = parted(docs.select(doc_id, text), marks.select("_d", "_t"), same)
    # runs and flags take far more memory than their files: never to be broadcast for a small file
    marked = holding.join(marks.hint("merge"), same).select(F.col(doc_id), F.col(text), "_runs")
    at = F.expr(f"flatten(transform(_runs, r -> transform(sequence(r.s, r.e - 1), i -> struct(i as i, get(h, i) as x, get(h, i + {RUN - HALF}) as y))))")
    windows = _windows(marked, doc_id, text, "_runs").select(*KEY, F.explode(at).alias("w")).select(*KEY, "w.i", "w.x", "w.y")
    windows = salted(materialize(windows, "dedup-windows"), *KEY, "i")
    first = windows.groupBy("x", "y").agg(F.min(F.struct(*KEY, "i")).alias("a"), F.count("*").alias("n"), salts_seen()).where("n > 1")
    later = join_groups(windows, first, "x", "y").where((F.col("th") != F.col("a.th")) | (F.col("i") != F.col("a.i")))
    gone = later.groupBy("th").agg(F.array_sort(F.collect_set("i")).alias("starts")).withColumnRenamed("th", "_th")
    return texts.join(gone, F.col("th") == F.col("_th"), "left").where("copied or starts is not null").select("th", "least", "starts")


def dedup_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the words that lie in a window of ``RUN`` words that occurs earlier, wherever lines break.

    A later copy of a whole text becomes empty; a deleted word takes the blanks before it along.
    """
    with intermediate_tables() as used:
        gone = repeated_windows(docs, doc_id, text)
    # one flag per word, up to the last deleted one: built in one pass, read by index
    flags = F.expr(f"array_join(transform(starts, (x, k) -> concat(repeat('1', greatest(x - coalesce(get(starts, k - 1), -{RUN}) - {RUN}, 0)), repeat('0', least({RUN}, x - coalesce(get(starts, k - 1), -{RUN}))))), '')".replace("get(starts, k - 1)", "if(k > 0, get(starts, k - 1), null)"))
    gone = materialize(gone.select(F.col("th").alias("_td_th"), F.col("least").alias("_td_least"), F.split(flags, "").alias("_td_flags")), "dedup-flags")
    remove_tables(docs.sparkSession, used)
    same = F.xxhash64(text) == F.col("_td_th")
    touched, others = parted(docs, gone.select("_td_th"), same)
    joined = touched.join(gone.hint("merge"), same, "left")
    pieces = F.regexp_extract_all(F.col(text), F.lit(BLANK + "*" + WORD), F.lit(0))
    kept = F.array_join(F.filter(pieces, lambda x, i: F.coalesce(F.get("_td_flags", i) == "1", F.lit(True))), "")
    kept = F.concat(F.when(F.get("_td_flags", F.lit(0)) == "0", F.regexp_replace(kept, "^" + BLANK + "+", "")).otherwise(kept), F.regexp_extract(F.col(text), BLANK + r"*\z", 0))
    cut = F.when(F.col("_td_th").isNull(), F.col(text)).when(~F.col(doc_id).cast("long").eqNullSafe(F.col("_td_least")), F.lit("")).when(F.col("_td_flags").isNull(), F.col(text)).otherwise(kept)
    out = joined.withColumn(text, cut).drop("_td_th", "_td_least", "_td_flags")
    return out if others is None else out.union(others)
