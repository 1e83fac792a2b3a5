"""One clock: every date, hour and text of a time is taken in UTC, whatever the session's zone is.

Times come with a zone (``timestamp``, an instant) or without (``timestamp_ntz``, read as UTC).  The branch not taken is
folded away when the query is analyzed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(ts: str | Column) -> Column:
    return F.col(ts) if isinstance(ts, str) else ts


def _without_zone(t: Column) -> Column:
    return F.typeof(t) == "timestamp_ntz"


def utc_time(ts: str | Column) -> Column:
    """The wall time in UTC, as ``timestamp_ntz``."""
    t = _column(ts)
    since = F.timestamp_add("MICROSECOND", F.unix_micros(t.cast("timestamp")), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return F.when(_without_zone(t), t.cast("timestamp_ntz")).otherwise(since)


def instant(ts: str | Column) -> Column:
    """The same time as ``timestamp``."""
    t = _column(ts)
    parts = [F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), F.extract(F.lit("SECOND"), t)]
    return F.when(_without_zone(t), F.make_timestamp_ltz(*parts, F.lit("UTC"))).otherwise(t.cast("timestamp"))


def utc_date(ts: str | Column) -> Column:
    return F.to_date(utc_time(ts))


def utc_hour(ts: str | Column) -> Column:
    """The beginning of the hour in UTC, as ``timestamp``; zones that are half an hour off don't move it."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(instant(ts)) / 3600) * 3600)


def utc_minute_text(ts: str | Column) -> Column:
    """``YYYY-MM-DDTHH:MM``."""
    return F.replace(F.substring(utc_time(ts).cast("string"), 1, 16), F.lit(" "), F.lit("T"))


def parse_utc_minute(text: str | Column) -> Column:
    """The instant that ``YYYY-MM-DDTHH:MM`` names in UTC; NULL for any other text."""
    return F.try_to_timestamp(F.concat(_column(text), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mmX"))


def season(month: Column) -> Column:
    """Meteorological season of a month number; NULL stays NULL."""
    return F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").when(month.isNotNull(), "autumn")


def add_calendar(df: DataFrame, ts: str, types: str = "gold") -> DataFrame:
    """hour, day_of_week (1 = Sunday), month, season, is_weekend; as ints for ``gold``, short and boolean plus year for ``dim``."""
    t = utc_time(ts)
    weekend = F.dayofweek(t).isin(1, 7)
    number = "int" if types == "gold" else "short"
    fields = {"hour": F.hour(t).cast(number), "day_of_week": F.dayofweek(t).cast(number), "month": F.month(t).cast(number), "season": season(F.month(t))}
    if types == "gold":
        return df.withColumns({**fields, "is_weekend": weekend.cast("int")})
    return df.withColumns({**fields, "year": F.year(t).cast(number), "is_weekend": weekend})


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970 (UTC); takes timestamps with or without zone."""
    return instant(ts).cast("long")
