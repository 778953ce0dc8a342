"""Days in a zone, open time, intervals and waits. "Now" is always an argument."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ColumnOrName = Column | str


def at(moment: datetime | str) -> Column:
    """A literal wall-clock time in UTC, without a zone."""
    return F.lit(str(moment)).cast("timestamp_ntz")


def local_day(ts: ColumnOrName, zone: str) -> Column:
    """The calendar day of a UTC wall-clock time in ``zone``; days of 23 and 25 hours are honoured."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts) if isinstance(ts, str) else ts))


def micros(ts: ColumnOrName) -> Column:
    """Microseconds since the epoch of a UTC wall-clock time."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def day_spine(spark: SparkSession, first: date | str, last: date | str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date"))).alias("day"))


def open_seconds(start: Column, end: Column, closed_from: int, closed_to: int, zone: str = "UTC") -> Column:
    """Seconds of [start, end) outside a window that is closed every day from one second of the day to another, in ``zone``.

    The window doesn't cross midnight. The bounds are turned to instants day by day, so a clock change inside
    a day counts as it passes.
    """
    local = lambda c: F.convert_timezone(F.lit("UTC"), F.lit(zone), c)
    utc = lambda c: micros(F.convert_timezone(F.lit(zone), F.lit("UTC"), c))
    a, b = micros(start), micros(end)
    days = F.sequence(F.to_date(local(start)), F.to_date(local(end)))

    def closed(day: Column) -> Column:
        midnight = day.cast("timestamp_ntz")
        low = utc(midnight + F.make_dt_interval(secs=F.lit(closed_from)))
        high = utc(midnight + F.make_dt_interval(secs=F.lit(closed_to)))
        return F.greatest(F.lit(0).cast("long"), F.least(b, high) - F.greatest(a, low))

    shut = F.aggregate(F.transform(days, closed), F.lit(0).cast("long"), lambda x, y: x + y)
    return F.when(b > a, ((b - a) - shut) / 1_000_000).otherwise(F.lit(0.0))


def backoff(attempts: Column, base_s: float, cap_s: float, first: int = 1) -> Column:
    """Seconds to wait after a number of attempts: ``base_s``, doubled for each beyond ``first``, at most ``cap_s``."""
    return F.least(F.lit(float(cap_s)), F.lit(float(base_s)) * F.pow(F.lit(2.0), F.greatest(attempts - first, F.lit(0))))


def steps_wait(attempts: Column, waits_s: list[int]) -> Column:
    """The wait of a fixed ladder by number of attempts (from 1); null when the ladder is at its end."""
    return F.try_element_at(F.array(*map(F.lit, waits_s)), attempts.cast("int"))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds from a Retry-After header: a number, or an HTTP date against ``now``; null if it is neither."""
    number = F.expr("null").cast("double") if header is None else header.try_cast("double")
    instant = F.try_to_timestamp(F.regexp_replace(header, r"^\w+, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.greatest(F.lit(0.0), F.coalesce(number, (F.unix_timestamp(instant) - F.unix_timestamp(now.cast("timestamp"))).cast("double")))


def window_seconds(last: Column, now: Column, margin_s: int = 7200, cap_s: int = 604_800, first_s: int = 86_400) -> Column:
    """How far back a walk looks: the time since the last one and a margin, within bounds; ``first_s`` if there was none."""
    since = F.greatest(F.lit(0).cast("long"), (micros(now) - micros(last)) / F.lit(1_000_000)).cast("long")
    return F.when(last.isNull(), F.lit(first_s).cast("long")).otherwise(F.least(since + margin_s, F.lit(cap_s).cast("long")))


def next_interval(base: Column, current: Column, stop: Column, empties: Column, low: int = 12, high: int = 48, empty_floor: int = 24, unfinished: tuple[str, ...] = ("rate_limited", "throttled_empty", "error", "stopped")) -> Column:
    """Hours to the next walk: halved at a full cap, kept after an unfinished walk, doubled towards the base otherwise."""
    moved = F.when(stop == "cap_hit", F.greatest(F.lit(low), F.floor(current / 2))).when(stop.isin(*unfinished), current).otherwise(F.least(base, current * 2))
    held = F.when(empties >= 3, F.greatest(moved, F.lit(empty_floor))).otherwise(moved)
    return F.least(F.lit(high), F.greatest(F.lit(low), held)).cast("long")


def clamp_cadence(interval: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), interval))


def pulled_in(due: Column, walked: Column, hours: Column, stop: Column, unfinished: tuple[str, ...] = ("rate_limited", "throttled_empty", "error", "stopped")) -> Column:
    """A slice's time after its interval has been clamped: not later than an interval after its walk, unless that walk wasn't finished."""
    reached = walked + F.make_dt_interval(hours=hours.cast("int"))
    return F.when(F.coalesce(stop.isin(*unfinished), F.lit(False)) | walked.isNull(), due).otherwise(F.least(due, reached))


def overdue(first_seen: Column, now: Column, hours: int) -> Column:
    """Whether the first of some rows waits for more than ``hours``; unknown counts as no."""
    return F.coalesce(micros(now) - micros(first_seen) > hours * 3_600_000_000, F.lit(False))


def delivery_due(now: Column, zone: str, from_hour: int) -> Column:
    """The local day to deliver for, or null before its hour."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), now)
    return F.when(F.hour(local.cast("timestamp")) >= from_hour, F.to_date(local))


def posted_window_days(last: Column, now: Column, first_days: int = 30) -> Column:
    """Days that a pull looks back: ``first_days`` at first, then the whole days since the last pull and two, two at least."""
    days = F.floor((micros(now) - micros(last)) / F.lit(86_400_000_000))
    return F.when(last.isNull(), F.lit(first_days).cast("long")).otherwise(F.greatest(days + 2, F.lit(2).cast("long")))


def started_before_today(started: Column, now: Column, zone: str) -> Column:
    return local_day(started, zone) < local_day(now, zone)
