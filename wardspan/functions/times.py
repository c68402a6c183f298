"""Times: parsing, business hours in their four readings, and days.

A parsed time is a TIMESTAMP_NTZ whose wall clock is UTC, so days and hours don't
depend on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Business hours of features, and of the off-hours flag (UTC); the last hour is out.
FEATURE_HOURS = (7, 18)
FLAG_HOURS = (7, 19)
# Forms of texts: year first with an optional time and zone, and month first as in endpoint logs.
ISO = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?)?)?\s?(Z|z|[+-]\d{2}(?::?\d{2})?)?$"
MONTH_FIRST = r"^(\d{2})/(\d{2})/(\d{4}) (\d{2}):(\d{2})(?::(\d{2}))?$"


def _made(text: Column, form: str, groups: int, make) -> Column:
    """make() of the array of a form's groups (absent ones empty); null if the text doesn't have the form. The array is made once a row."""
    held = F.array(F.split(F.regexp_replace(text, form, "|".join(f"${g}" for g in range(1, groups + 1))), r"\|"))
    return F.when(text.rlike(form), F.get(F.transform(held, make), F.lit(0)))


def _number(part: Column) -> Column:
    return F.coalesce(F.nullif(part, F.lit("")).try_cast("int"), F.lit(0))


def _iso(p: Column) -> Column:
    seconds = F.concat_ws(".", F.when(p[5] == "", "0").otherwise(p[5]), F.substring(F.concat(p[6], F.lit("0")), 1, 6)).try_cast("decimal(16,6)")
    zone = F.replace(F.substring(p[7], 2, 5), F.lit(":"), F.lit(""))
    minutes = _number(F.substring(zone, 1, 2)) * 60 + _number(F.substring(zone, 3, 2))
    ahead = F.when(p[7].startswith("+"), minutes).when(p[7].startswith("-"), -minutes).otherwise(0)
    return F.try_make_timestamp_ntz(*map(_number, (p[0], p[1], p[2], p[3], p[4])), seconds) - F.make_dt_interval(F.lit(0), F.lit(0), ahead)


def parse_iso(text: Column) -> Column:
    """The UTC time of an ISO text: date only, or with hours, minutes, seconds and fractions; Z, an offset, or UTC without one. Null for others."""
    return _made(F.trim(text), ISO, 8, _iso)


def parse_any(text: Column) -> Column:
    """ISO, or the month-first form of endpoint logs."""
    month_first = lambda p: F.try_make_timestamp_ntz(*map(_number, (p[2], p[0], p[1], p[3], p[4])), _number(p[5]).cast("decimal(16,6)"))
    return F.coalesce(parse_iso(text), _made(F.trim(text), MONTH_FIRST, 6, month_first))


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a time column; those of a TIMESTAMP_NTZ by its wall clock, which is UTC."""
    if dict(df.dtypes)[ts] == "timestamp":
        return F.unix_micros(ts)
    since = F.col(ts).cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    of = lambda unit: F.extract(F.lit(unit), since).cast("long")
    return (of("DAY") * 24 + of("HOUR")) * 3_600_000_000 + of("MINUTE") * 60_000_000 + (F.extract(F.lit("SECOND"), since) * 1_000_000).cast("long")


def utc_clock(instant: Column) -> Column:
    """The UTC wall clock of a TIMESTAMP, as TIMESTAMP_NTZ."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def local_hour(text: Column) -> Column:
    """The hour as written, in the text's own offset; null if it can't be parsed."""
    return _made(F.trim(text), ISO, 8, lambda p: F.when(_iso(p).isNotNull(), _number(p[3])))


def outside(hour: Column, hours: tuple[int, int]) -> Column:
    return (hour < hours[0]) | (hour >= hours[1])


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def after_hours_live(text: Column) -> Column:
    """Hour only, in the event's own offset; false if it can't be parsed."""
    return F.coalesce(outside(local_hour(text), FEATURE_HOURS), F.lit(False))


def after_hours_train(ts: Column) -> Column:
    """Hour or weekend."""
    return outside(F.hour(ts), FEATURE_HOURS) | is_weekend(ts)


def after_hours_script(ts: Column) -> Column:
    """Hour only, of a parsed time."""
    return outside(F.hour(ts), FEATURE_HOURS)


def off_hours(ts: Column) -> Column:
    """Weekend, or out of the flag's hours, of a UTC wall clock; false for null."""
    return F.coalesce(is_weekend(ts) | outside(F.hour(ts), FLAG_HOURS), F.lit(False))


def utc_day(text: Column) -> Column:
    """The UTC day of an ISO text, else its first ten characters if they look like a day, else null."""
    head = F.substring(text, 1, 10)
    plausible = F.when(head.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"), F.to_date(parse_iso(head)))
    return F.coalesce(F.to_date(parse_iso(text)), plausible)


def raw_day_key(text: Column) -> Column:
    """The first ten characters of a time text, whatever they are: the day key of tables that keep times as text."""
    return F.substring(F.coalesce(text, F.lit("")), 1, 10)


def add_time_columns(df, ts: str):
    """hour, weekday (Monday 0), is_weekend and after_hours of a timestamp column."""
    return df.withColumns({"hour": F.hour(ts), "weekday": F.weekday(ts), "is_weekend": is_weekend(F.col(ts)), "after_hours": after_hours_train(F.col(ts))})
