"""Host-level quality rules.

Every document is measured once (words, symbols, repeated lines, repeated word windows).  Rule
failures are then aggregated per host, each host's failure rate is shrunk towards the corpus with
an empirical beta prior (method of moments over the hosts), and the host's verdict is joined back
to its documents: a rejected host loses all of them, and a strict host, one that stands out from the
prior, those that fail the symbol rule.  Repeated lines count towards a host's rate alone, as texts
with many of them are often fine once the lines are removed.

Cases: a null text has no words and fails the base rules; a null host is a host of its own; repeated
rows are measured and counted each; an empty table gives an empty result; columns of ``docs`` other
than the named ones are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import join_groups, materialize, salted, salts_seen, text_batches

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def measure_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() knows just the six ASCII blanks
    chars = len(text) - sum(text.count(c) for c in WHITE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    repeat = 0
    if len(words) > 2:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            number: dict = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in windows), np.int64, len(windows))
            twice = np.bincount(ids)[ids] > 1
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[k : k + len(twice)] |= twice
            repeat = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(lines), repeat


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches, 2):
        rows = [measure_text(t.as_py()) for t in batch.column(2)]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "host", *MEASURES])


def measure(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """One row of measures per document; map-only."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    return picked.mapInArrow(_measure, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def with_rules(measures: DataFrame, min_words: int = 50, max_repeat: int = 50, max_symbols: int = 10, max_dup_lines: int = 30) -> DataFrame:
    """``base_failed``, ``symbols_failed`` and ``rule_failed`` (any rule); the limits are percentages."""
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    symbols = F.col("n_symbols") * 100 > F.col("word_chars") * max_symbols
    lines = F.col("n_dup_lines") * 100 > F.col("n_lines") * max_dup_lines
    return measures.withColumns({"base_failed": base, "symbols_failed": symbols, "rule_failed": base | symbols | lines})


def host_verdicts(judged: DataFrame, max_rate: float = 0.6, strict_from: float = 0.5, min_strength: float = 1.0, max_strength: float = 1e6) -> DataFrame:
    """(host, n_docs, n_failed, fail_rate, host_rejected, host_strict) of ``salted`` rows: failure rates shrunk with a beta prior.

    The prior's mean m and strength k come from the mean and variance of the hosts' raw rates,
    k = m (1 - m) / v - 1, kept within [min_strength, max_strength]; the shrunk rate of a host is
    (failed + m k) / (n + k).  A host is rejected above ``max_rate``, and strict above m plus
    ``strict_from`` deviations of the prior, sqrt(m (1 - m) / (k + 1)).  Hosts are counted by partial aggregation, so a hot host is one row
    per task before the shuffle.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("rule_failed").cast("long")).alias("n_failed"), salts_seen())
    rate = F.col("n_failed") / F.col("n_docs")
    row = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()  # one row of two numbers
    m, v = (row["m"] or 0.0), (row["v"] or 0.0)
    k = min(max(m * (1 - m) / v - 1, min_strength), max_strength) if v > 0 else max_strength
    shrunk = (F.col("n_failed") + F.lit(m * k)) / (F.col("n_docs") + F.lit(k))
    limit = m + strict_from * math.sqrt(m * (1 - m) / (k + 1))
    return hosts.withColumn("fail_rate", shrunk).withColumns({"host_rejected": F.col("fail_rate") > max_rate, "host_strict": F.col("fail_rate") > limit})


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", max_rate: float = 0.6, strict_from: float = 0.5) -> DataFrame:
    """Measures, base verdict and final verdict (``kept``) of every document.

    The measures (no texts) are written once and used twice: to judge the hosts and to be joined
    with the verdicts.  Adaptive execution broadcasts the host table when it turns out small; else
    both sides are joined by host and salt, so that a hot host is dealt over many tasks.
    """
    judged = salted(materialize(with_rules(measure(docs, doc_id, host, text)), "quality-measures"), "doc_id", *MEASURES)
    out = join_groups(judged, host_verdicts(judged, max_rate, strict_from), "host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected") & ~(F.col("host_strict") & F.col("symbols_failed")))
