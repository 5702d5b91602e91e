"""Time functions that do not depend on the session's time zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400

# Fixed values, in days: how long a connection, a session and a seen post are kept.
CONNECTION_DAYS, SESSION_DAYS, SEEN_DAYS = 1, 30, 360


def epoch_seconds(ts_ntz: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, read as UTC."""
    return F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts_ntz)


def epoch_micros(ts_ntz: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts_ntz)


def ttl(epoch: Column, days: int) -> Column:
    """Expiry in epoch seconds."""
    return epoch + F.lit(days * SECONDS_PER_DAY)


def utc_year_month(epoch: Column) -> tuple[Column, Column]:
    """Year and month in UTC of epoch seconds."""
    day = F.date_add(F.lit(dt.date(1970, 1, 1)), F.floor(epoch / F.lit(SECONDS_PER_DAY)).cast("int"))
    return F.year(day), F.month(day)


def parse_epoch_seconds(value: Column) -> Column:
    """Epoch milliseconds, or an ISO time (``Z`` or no zone meaning UTC), as seconds; else null."""
    from_millis = F.try_divide(value.try_cast("long").cast("double"), F.lit(1000.0))
    iso = F.rlike(value, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|\+00:00)?$"))
    plain = F.regexp_replace(F.regexp_replace(value, r"(Z|\+00:00)$", ""), "T", " ")
    micros = epoch_micros(F.when(iso, plain).try_cast("timestamp_ntz"))
    return F.coalesce(from_millis, micros / F.lit(1_000_000.0))


def day_of(year: Column, month: Column, day: Column) -> Column:
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))
