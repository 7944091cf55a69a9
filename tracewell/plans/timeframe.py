"""Time ranges as half-open windows, presets and baselines; driver-side arithmetic only."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.expr import local_day


@dataclass(frozen=True)
class TimeRange:
    """``start`` inclusive, ``end`` exclusive; either may be open. ``tz`` decides which day a moment falls on."""

    start: datetime | None = None
    end: datetime | None = None
    tz: str = "UTC"

    def contains(self, ts: Column | str, strict: bool = False) -> Column:
        """Whether ``ts`` lies within. ``strict``: a range open on one side alone holds nothing."""
        ts = F.col(ts) if isinstance(ts, str) else ts
        if self.start is None and self.end is None:
            return F.lit(True)
        if strict and (self.start is None or self.end is None):
            return F.lit(False)
        out = F.lit(True)
        if self.start is not None:
            out &= ts >= F.lit(self.start)
        if self.end is not None:
            out &= ts < F.lit(self.end)
        return F.coalesce(out, F.lit(False))

    def previous(self) -> TimeRange | None:
        """The window of equal length just before."""
        if self.start is None or self.end is None:
            return None
        return TimeRange(self.start - (self.end - self.start), self.start, self.tz)

    def days(self) -> tuple[date, date] | None:
        """First and last day, if closed."""
        if self.start is None or self.end is None:
            return None
        return self.start.date(), (self.end - timedelta(microseconds=1)).date()

    def step(self) -> timedelta:
        """Buckets are days, or weeks beyond sixty days."""
        return timedelta(days=7) if self.end - self.start > timedelta(days=60) else timedelta(days=1)

    def buckets(self) -> int:
        return -(-(self.end - self.start) // self.step())

    def bucket_index(self, ts: Column | str) -> Column:
        ts = F.col(ts) if isinstance(ts, str) else ts
        micros = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit(self.start))
        index = F.floor(micros / F.lit(self.step() // timedelta(microseconds=1)))
        return F.least(F.greatest(index, F.lit(0)), F.lit(max(self.buckets() - 1, 0))).cast("int")


def last_days(n: int | None, today: date, tz: str = "UTC") -> TimeRange:
    """The preset of the last ``n`` days, today included; all time for None."""
    if n is None:
        return TimeRange(tz=tz)
    end = datetime.combine(today + timedelta(days=1), datetime.min.time())
    return TimeRange(end - timedelta(days=n), end, tz)


def day_bounds(df: DataFrame, ts: str, within: TimeRange) -> tuple[date, date] | None:
    """First and last day of a series: those of the range, else of the data (one row is read)."""
    if within.days():
        return within.days()
    low, high = df.agg(F.min(local_day(ts, within.tz)), F.max(local_day(ts, within.tz))).first()
    if low is None:
        return None
    return (within.start.date() if within.start else low), ((within.end - timedelta(microseconds=1)).date() if within.end else high)


def calendar(df: DataFrame, bounds: tuple[date, date] | None) -> DataFrame:
    """One row for each day."""
    spark = df.sparkSession
    if bounds is None or bounds[0] > bounds[1]:
        return spark.createDataFrame([], "day date")
    return spark.range(1).select(F.explode(F.sequence(F.lit(bounds[0]), F.lit(bounds[1]))).alias("day"))
