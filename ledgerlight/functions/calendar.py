"""Fiscal calendar: fixed offset of 330 minutes from UTC, years from April. Instants are UTC timestamps without zone."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OFFSET = timedelta(minutes=330)
MOST_BUCKETS = 5000
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def local(instant: Column) -> Column:
    """The instant as local wall clock."""
    return instant.cast("timestamp_ntz") + F.expr("INTERVAL '330' MINUTE")


def local_date(instant: Column) -> Column:
    return local(instant).cast("date")


def month_key(instant: Column) -> Column:
    day = local_date(instant)
    return F.format_string("%04d-%02d", F.year(day), F.month(day))


def quarter_key(instant: Column) -> Column:
    day = local_date(instant)
    m = F.month(day)
    year = F.year(day) - F.when(m >= 4, 0).otherwise(1)
    return F.format_string("FY%04d-Q%d", year, (F.floor((m + 8) % 12 / 3) + 1).cast("int"))


def bucket_key(instant: Column, granularity: str) -> Column:
    return {"month": month_key, "quarter": quarter_key}[granularity](instant)


def bucket_label(key: Column) -> Column:
    """`April 2026` for a month, `FY2026-27 Q1` for a quarter, anything else as it is."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    month = F.concat(F.element_at(names, F.substring(key, 6, 2).try_cast("int")), F.lit(" "), F.left(key, F.lit(4)))
    year = F.substring(key, 3, 4).try_cast("int")
    quarter = F.concat(F.left(key, F.lit(6)), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"), F.lit(" "), F.right(key, F.lit(2)))
    return F.when(F.rlike(key, F.lit(r"^\d{4}-(0[1-9]|1[0-2])$")), month).when(F.rlike(key, F.lit(r"^FY\d{4}-Q[1-4]$")), quarter).otherwise(key)


def day_start_of(day: Column) -> Column:
    """The UTC instant of a day's local midnight."""
    return day.cast("date").cast("timestamp_ntz") - F.expr("INTERVAL '330' MINUTE")


def bucket_start_of(key: Column) -> Column:
    """The UTC instant at which a month's or quarter's bucket begins; null for a key of neither shape."""
    month = F.to_date(F.concat(key, F.lit("-01")))
    quarter = F.make_date(F.substring(key, 3, 4).cast("int") + F.when(F.right(key, F.lit(1)) == "4", 1).otherwise(0), F.element_at(F.create_map(*[F.lit(x) for x in ("1", 4, "2", 7, "3", 10, "4", 1)]), F.right(key, F.lit(1))), F.lit(1))
    return day_start_of(F.when(F.rlike(key, F.lit(r"^\d{4}-(0[1-9]|1[0-2])$")), month).when(F.rlike(key, F.lit(r"^FY\d{4}-Q[1-4]$")), quarter))


def bucket_end_of(key: Column) -> Column:
    """The instant at which the next bucket begins."""
    local = (bucket_start_of(key) + F.expr("INTERVAL '330' MINUTE")).cast("date")
    return day_start_of(F.add_months(local, F.when(F.startswith(key, F.lit("FY")), 3).otherwise(1)))


def previous_key_of(key: Column) -> Column:
    """The key of the last millisecond before the bucket."""
    before = bucket_start_of(key) - F.expr("INTERVAL '0.001' SECOND")
    return F.when(F.startswith(key, F.lit("FY")), quarter_key(before)).otherwise(month_key(before))


def partial_of(key: Column, start: Column, end: Column) -> Column:
    """Whether the half-open range covers only a part of the bucket."""
    return (bucket_start_of(key) < start) | (bucket_end_of(key) > end)


def span_days_of(start: Column, end: Column) -> Column:
    """Days of a half-open range, a part of one as one."""
    return F.ceil((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400_000_000.0)


# the same on the driver, for ranges and spines


def day_start(day: date | str) -> datetime:
    """The UTC instant of a local midnight."""
    day = date.fromisoformat(day) if isinstance(day, str) else day
    return datetime(day.year, day.month, day.day) - OFFSET


def half_open(first: date | str, last: date | str) -> tuple[datetime, datetime]:
    """UTC bounds of the local days first to last: at least the one, before the other."""
    last = date.fromisoformat(last) if isinstance(last, str) else last
    bounds = day_start(first), day_start(last + timedelta(days=1))
    if bounds[0] >= bounds[1]:
        raise ValueError("the range is empty")
    return bounds


def span_days(start: datetime, end: datetime) -> int:
    """Days of a half-open range, a part of one as one."""
    return -((start - end) // timedelta(days=1))


def checked_range(bounds: tuple[datetime, datetime], granularity: str, most_buckets: int = 24, most_days: int = 1100) -> tuple[datetime, datetime]:
    """The range, if it isn't empty and within the ceilings of a request."""
    if bounds[0] >= bounds[1]:
        raise ValueError("the range is empty")
    if span_days(*bounds) > most_days or len(enumerate_buckets(*bounds, granularity)) > most_buckets:
        raise ValueError("the range is too long")
    return bounds


def is_real_date(text: Column) -> Column:
    """Whether a text is a day of the calendar, as YYYY-MM-DD."""
    return F.coalesce(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")) & text.try_cast("date").isNotNull(), F.lit(False))


def fiscal_year_to_date(now: datetime) -> tuple[datetime, datetime]:
    day = (now + OFFSET).date()
    return day_start(date(day.year if day.month >= 4 else day.year - 1, 4, 1)), now + timedelta(milliseconds=1)


def defaulted(first: date | str | None, last: date | str | None, now: datetime) -> tuple[datetime, datetime]:
    """UTC bounds of a request's local days; an edge that isn't given is that of the fiscal year to date, each on its own."""
    start, end = fiscal_year_to_date(now)
    bounds = day_start(first) if first else start, half_open(last, last)[1] if last else end
    if bounds[0] >= bounds[1]:
        raise ValueError("the range is empty")
    return bounds


def key_of(instant: datetime, granularity: str) -> str:
    day = (instant + OFFSET).date()
    if granularity == "month":
        return f"{day.year:04d}-{day.month:02d}"
    return f"FY{day.year if day.month >= 4 else day.year - 1:04d}-Q{(day.month + 8) % 12 // 3 + 1}"


def _first_day(key: str) -> tuple[date, int]:
    if m := re.fullmatch(r"(\d{4})-(\d\d)", key):
        return date(int(m[1]), int(m[2]), 1), 1
    if m := re.fullmatch(r"FY(\d{4})-Q([1-4])", key):
        month = 3 * int(m[2]) + 1
        return (date(int(m[1]), month, 1) if month <= 12 else date(int(m[1]) + 1, 1, 1)), 3
    raise ValueError(f"not a bucket: {key}")


def _months_on(day: date, n: int) -> date:
    at = day.year * 12 + day.month - 1 + n
    return date(at // 12, at % 12 + 1, 1)


def bucket_range(key: str) -> tuple[datetime, datetime]:
    first, months = _first_day(key)
    return day_start(first), day_start(_months_on(first, months))


def previous_key(key: str, granularity: str) -> str:
    return key_of(bucket_range(key)[0] - timedelta(milliseconds=1), granularity)


def enumerate_buckets(start: datetime, end: datetime, granularity: str) -> list[str]:
    """All buckets that the half-open range touches, in order."""
    out: list[str] = []
    at = start
    while at < end:
        if len(out) == MOST_BUCKETS:
            raise ValueError("too many buckets")
        out.append(key_of(at, granularity))
        at = bucket_range(out[-1])[1]
    return out


def spine(spark: SparkSession, start: datetime, end: datetime, granularity: str) -> DataFrame:
    """bucket, and whether the range covers only a part of it."""
    rows = [(k, bucket_range(k)[0] < start or bucket_range(k)[1] > end) for k in enumerate_buckets(start, end, granularity)]
    return spark.createDataFrame(rows, "bucket string, partial boolean")


def within(instant: Column, bounds: tuple[datetime, datetime]) -> Column:
    """A half-open range on the raw column, so that it reaches the scan."""
    return (instant >= F.lit(bounds[0]).cast("timestamp_ntz")) & (instant < F.lit(bounds[1]).cast("timestamp_ntz"))


def zero_filled(series: DataFrame, buckets: DataFrame, counts: list[str]) -> DataFrame:
    """One row for each bucket of the spine: absent counts are 0, absent ratios stay null."""
    return buckets.join(series, "bucket", "left").fillna(0, counts)
