"""Keys, labels and small text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.calendar import utc_time


def cell_id(lat: str, lon: str) -> Column:
    return F.format_string("lat=%.4f/lon=%.4f", F.col(lat), F.col(lon))


def run_stamp(ts: str) -> Column:
    digits = F.regexp_replace(F.substring(utc_time(ts).cast("string"), 1, 19), "[-:]", "")
    return F.concat(F.replace(digits, F.lit(" "), F.lit("T")), F.lit("Z"))


def version_id(ts: str) -> Column:
    text = F.substring(utc_time(ts).cast("string"), 1, 19)
    return F.concat(F.translate(text, " :", "T-"), F.lit("Z"))


def walkforward_version(version: Column) -> Column:
    return F.concat(F.lit("walkforward:"), version)


def snapshot_label(ts: str, hours: str) -> Column:
    t = utc_time(ts)
    return F.concat(F.date_format(F.to_date(t), "MMM dd"), F.lit(", "), F.substring(t.cast("string"), 12, 5), F.lit(" · "), F.col(hours).cast("string"), F.lit("h forecast"))


def encode_key(kind: str, *parts: str | Column) -> Column:
    """``kind|part|part``: a composite key as one string."""
    return F.concat_ws("|", F.lit(kind), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def decode_key(key: str, index: int) -> Column:
    """Part ``index`` of an encoded key; 0 is its kind."""
    return F.get(F.split(F.col(key), r"\|"), F.lit(index))


def signed_error(pred: str, actual: str) -> Column:
    """pred - actual as text with sign and two decimals, ``pending`` while there is no actual."""
    return F.when(F.col(actual).isNull(), "pending").otherwise(F.format_string("%+.2f", F.col(pred) - F.col(actual)))


def partition_date(path: str) -> Column:
    """The date of a ``date=YYYY-MM-DD`` path part; NULL if there is none or it is no date."""
    return F.expr(f"try_to_date(nullif(regexp_extract({path}, '(?:^|/)date=([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?:/|$)', 1), ''), 'yyyy-MM-dd')")


def parse_window(window: str) -> Column:
    """``START:END`` as struct(start, end, ok); malformed bounds give NULLs and ok = false."""
    part = lambda i: F.expr(f"try_to_date(get(split({window}, ':'), {i}), 'yyyy-MM-dd')")
    ok = (F.size(F.split(window, ":")) == 2) & part(0).isNotNull() & part(1).isNotNull()
    return F.struct(part(0).alias("start"), part(1).alias("end"), F.coalesce(ok, F.lit(False)).alias("ok"))


def default_window(day: str, start: str, end: str, back: int = 32, until: int = 2) -> Column:
    """struct(start, end); an empty bound is ``back`` or ``until`` days before ``day``."""
    pick = lambda c, n: F.coalesce(F.expr(f"try_to_date(nullif({c}, ''), 'yyyy-MM-dd')"), F.date_sub(F.col(day), n))
    return F.struct(pick(start, back).alias("start"), pick(end, until).alias("end"))
