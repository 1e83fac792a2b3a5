"""Fill-in-middle transformation of whole documents by one match with repeated captures.

A text is a run of units: blanks with the word behind them, or blanks alone at its end.  One full match of
``(unit)*`` by the regex library keeps the end of every repetition of its group, so ``match.ends(1)`` gives the
number of units and, by index, both cuts; nothing is iterated.  The quantifiers are possessive, so the match keeps no
state for going back.  Which documents are transformed, how, and where they are cut follows from a SHA-256 of
the seed and the id alone: the result does not depend on partitions, order or attempts.  Map-only.

Cases: a null text counts as empty, an empty text stays plain; so does one that holds a marker, since its parts could not be
told apart again; a text of blanks is one unit; a null id is hashed as an empty string; rows that repeat, or share
an id, are each transformed, the latter with the same draws; other columns of the input are not read, whatever
their names; an empty table gives an empty one.  A text is worked on whole; its match takes some 60 bytes a unit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_batches

UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def cut(text: str, *draws: int) -> tuple[int, list[int]]:
    """The number of units, and for each draw the end (in code points) of the first ``draw % (n + 1)`` units, sorted."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    return n, sorted(ends[k - 1] if k else 0 for k in (d % (n + 1) for d in draws))


def transform(text: str, key: str, seed: int, rate: int, spm_share: int, marks: tuple[str, str, str]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n, (a, b) = cut(text, h1, h2)
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if h4 % 100 < spm_share:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def _transform(*options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in text_batches(batches, 1):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [transform(t or "", "" if k is None else str(k), *options) for k, t in zip(keys, texts)]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], ["doc_id", *names])

    return run


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_share: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): ``rate`` percent are transformed, of them ``spm_share`` percent as spm."""
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(_transform(seed, rate, spm_share, tuple(marks)), SCHEMA)


def restored(output: str | Column, form: str | Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from its output and form alone: no mark stands in a transformed text, so the marks cut it in four."""
    whole = F.col(output) if isinstance(output, str) else output
    kind = F.col(form) if isinstance(form, str) else form
    parts = F.split(whole, "|".join(map(re.escape, marks)), -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(kind == "plain", whole).when(kind == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
