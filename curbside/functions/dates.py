"""Dates and times as they come in yearly exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_date(c: Column) -> Column:
    """YYYYMMDD, YYYY-MM-DD or YYYY/MM/DD; null for anything else."""
    return F.coalesce(*[F.try_to_date(F.trim(c), f) for f in ("yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd")])


def clock(c: Column) -> Column:
    """HHMM as HH:MM; other texts stay as they are."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}$"), F.concat(F.left(t, F.lit(2)), F.lit(":"), F.right(t, F.lit(2)))).otherwise(F.nullif(t, F.lit("")))


def minute_of_day(c: Column, default: int = 720) -> Column:
    """Minutes from HHMM with leading zeros dropped; 2400 is midnight, what is no time is noon."""
    t = F.when(F.trim(c) == "2400", F.lit("0000")).otherwise(F.lpad(F.trim(c), 4, "0"))
    hour, minute = F.left(t, F.lit(2)).try_cast("int"), F.right(t, F.lit(2)).try_cast("int")
    ok = t.rlike(r"^\d{4}$") & (hour < 24) & (minute < 60)
    return F.when(ok, hour * 60 + minute).otherwise(F.lit(default))


def hour_and_minute(c: Column) -> tuple[Column, Column]:
    """hour = n // 100 and minute = n % 100, clipped to a day."""
    return F.least(F.greatest(F.floor(c / 100), F.lit(0)), F.lit(23)).cast("int"), F.least(F.greatest(c % 100, F.lit(0)), F.lit(59)).cast("int")


def year_month(c: Column) -> tuple[Column, Column]:
    """Year and month of texts that begin with YYYYMM; null for others."""
    t = F.regexp_extract(F.trim(c), r"^(\d{6})", 1)
    month = F.substring(t, 5, 2).try_cast("int")
    ok = month.between(1, 12)
    return F.when(ok, F.left(t, F.lit(4)).try_cast("int")), F.when(ok, month)


def year_in_name(c: Column) -> Column:
    """First year from 1900 to 2099 in a name."""
    return F.regexp_extract(c, r"((?:19|20)\d{2})", 1).try_cast("int")


def year_list(spec: str) -> list[int]:
    """'2008-2010,2015' as a sorted list of years."""
    years: set[int] = set()
    for part in filter(None, map(str.strip, spec.split(","))):
        first, _, last = part.partition("-")
        low, high = int(first), int(last or first)
        years.update(range(min(low, high), max(low, high) + 1))
    return sorted(years)


def floor_minutes(c: Column, minutes: int = 10) -> Column:
    seconds = 60 * minutes
    return F.timestamp_seconds(F.floor(F.unix_timestamp(c.cast("timestamp")) / seconds) * seconds)


def part_of_day(hour: Column) -> Column:
    """Bins (0, 6], (6, 12], (12, 18], (18, 24] with 0 in the first."""
    return F.when(hour <= 6, "Night").when(hour <= 12, "Morning").when(hour <= 18, "Afternoon").otherwise("Evening")


def calendar(c: Column) -> dict[str, Column]:
    """Year, month, day, weekday (Monday is 0), ISO week, names and the weekend flag of a date."""
    return {
        "year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "weekday": F.weekday(c), "iso_week": F.weekofyear(c),
        "day_name": F.date_format(c, "EEEE"), "month_name": F.date_format(c, "MMMM"), "is_weekend": F.weekday(c) >= 5,
    }
