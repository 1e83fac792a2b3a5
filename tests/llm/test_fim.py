"""Fill-in-middle: brute-force units and parts, round trips, hard cases."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.fim import cut, fill_in_middle, restored

BLANK = " \t\n\x0b\x0c\r"
TEXTS = st.text(alphabet=BLANK + "aé\U0001f600<P>SM\x1c ", max_size=40)


def units(text):
    """Blanks with the word behind them, one code point after another."""
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in BLANK:
            end += 1
        while end < len(text) and text[end] not in BLANK:
            end += 1
        out.append(text[at:end])
        at = end
    return out


def brute(doc_id, text):
    parts = units(text or "")
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(parts) + 1) for x in h[:2])
    text = text or ""
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(parts), "plain", None, None, text
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if h[3] % 100 < 80:
        return len(parts), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(parts), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 2**32), st.integers(0, 2**32))
def test_cuts_by_brute_force(text, h1, h2):
    parts = units(text)
    n, ends = cut(text, h1, h2)
    assert n == len(parts)
    assert [text[:e] for e in ends] == ["".join(parts[:k]) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]


def check(spark, rows, schema="doc_id long, text string"):
    out = fill_in_middle(spark.createDataFrame(rows, schema)).withColumn("back", restored("output", "form")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    ours = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=key)
    theirs = sorted(((r[0], *brute(r[0], r[1])) for r in rows), key=key)
    assert ours == theirs
    assert sorted((r.doc_id is None, r.doc_id or 0, r.back) for r in out) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows)


def test_hard_cases(spark):
    texts = [None, "", " ", "\n\n  ", "one", "a <P> b", "a <M>", "<S", "x <", "< P>", "é \U0001f600\t b ", "a\x1cb c d"]
    check(spark, [(i, t) for i in range(40) for t in texts] + [(None, "no id here"), (None, "no id here"), (7, "twice"), (7, "twice"), (-3, "below zero")])


def test_long_texts(spark):
    check(spark, [(i, t) for i in range(6) for t in ("word " * 200_000, "x" * 1_000_000, " " * 1_000_000, "ab<S" * 250_000)])


def test_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "some text", "x", 2)], "doc_id long, text string, form string, output int")
    assert fill_in_middle(rows).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fill_in_middle(rows.where("false")).count() == 0
    other = rows.withColumnsRenamed({"doc_id": "id", "text": "body"})
    assert fill_in_middle(other, "id", "body").first()["doc_id"] == 1


def test_shares_of_forms(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"))
    shares = {r["form"]: r["count"] / 4000 for r in fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(shares["plain"] - 0.5) < 0.05 and abs(shares["spm"] - 0.4) < 0.05 and abs(shares["psm"] - 0.1) < 0.03
    assert {r["form"] for r in fill_in_middle(docs, rate=100, spm_share=0).select("form").distinct().collect()} == {"psm"}
