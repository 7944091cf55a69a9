"""Daily series, streaks, heatmap and the minute rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.expr import TOKENS, dimension, local, local_day, minute, session_messages, total_tokens, weekday_index
from tracewell.plans.timeframe import TimeRange, calendar, day_bounds

ROLLUP_KEYS = ("bucket_start", "provider", "version", "model", "project")
ROLLUP_COUNTS = ("session_count", "message_count", "user_message_count", "assistant_message_count")


def daily(sessions: DataFrame, within: TimeRange = TimeRange()) -> DataFrame:
    """Sessions, messages and tokens of each day, quiet days too."""
    kept = sessions.where(within.contains("ts"))
    day = kept.groupBy(local_day("ts", within.tz).alias("day")).agg(F.count("*").alias("sessions"), F.sum(session_messages()).alias("messages"), F.sum(total_tokens()).alias("tokens"))
    return _dense(calendar(sessions, day_bounds(kept, "ts", within)), day, ("sessions", "messages", "tokens"))


def daily_from_rollup(rollup: DataFrame, within: TimeRange = TimeRange()) -> DataFrame:
    """The same from the rollup, with ``active``: a day of tokens alone is not active."""
    kept = rollup.where(within.contains("bucket_start"))
    day = kept.groupBy(local_day("bucket_start", within.tz).alias("day")).agg(F.sum("session_count").alias("sessions"), F.sum("message_count").alias("messages"), F.sum(total_tokens()).alias("tokens"))
    dense = _dense(calendar(rollup, day_bounds(kept, "bucket_start", within)), day, ("sessions", "messages", "tokens"))
    return dense.withColumn("active", (F.col("sessions") > 0) | (F.col("messages") > 0))


def _dense(days: DataFrame, values: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return days.join(values, "day", "left").select("day", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names))


def streaks(series: DataFrame) -> DataFrame:
    """Active days, days, the longest run of active days and the run that reaches the last day. ``series``: day, sessions, messages of every day.

    The i-th beginning of a run belongs to the i-th end.
    """
    active = series.where("sessions > 0 or messages > 0").select("day")
    # a run begins where the day before is not active
    begins = active.alias("a").join(active.select(F.date_add("day", 1).alias("day")).alias("b"), "day", "left_anti").select(F.col("day").alias("begin"))
    ends = active.join(active.select(F.date_sub("day", 1).alias("day")), "day", "left_anti").select(F.col("day").alias("stop"))
    order = lambda c: F.row_number().over(Window.orderBy(c))  # noqa: E731  a calendar has few rows at any scale
    runs = begins.withColumn("i", order("begin")).join(ends.withColumn("i", order("stop")), "i").withColumn("n", F.datediff("stop", "begin") + 1)
    span = series.agg(F.count("*").alias("total_days"), F.max("day").alias("last_day"), F.count_if((F.col("sessions") > 0) | (F.col("messages") > 0)).alias("active_days"))
    best = runs.agg(F.max("n").alias("longest"), F.max_by("n", "stop").alias("latest"), F.max("stop").alias("latest_stop"))
    both = span.unionByName(best, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in (*span.columns, *best.columns)))  # one row of each
    return both.select(
        "active_days", "total_days", F.coalesce("longest", F.lit(0)).cast("long").alias("longest_streak"),
        F.when(F.col("latest_stop") == F.col("last_day"), F.col("latest")).otherwise(0).cast("long").alias("current_streak"),
    )


def heatmap(sessions: DataFrame, within: TimeRange = TimeRange()) -> DataFrame:
    """Sessions by weekday (Monday 0) and hour: all 168 cells."""
    at = local("ts", within.tz)
    seen = sessions.where(within.contains("ts")).groupBy(weekday_index(at).alias("weekday"), F.hour(at).alias("hour")).agg(F.count("*").alias("n"))
    cells = sessions.sparkSession.range(168).select(F.expr("cast(id div 24 as int)").alias("weekday"), F.expr("cast(id % 24 as int)").alias("hour"))
    return cells.join(seen, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def heatmap_rows(cells: DataFrame) -> DataFrame:
    """Six rows of four hours, with five levels against the fullest cell."""
    grouped = cells.groupBy("weekday", F.expr("cast(hour div 4 as int)").alias("interval")).agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy())  # 42 rows
    share = F.when(F.col("most") > 0, F.col("n") / F.col("most")).otherwise(0.0)
    level = F.when(F.col("n") == 0, 0).when(share >= 0.75, 4).when(share >= 0.5, 3).when(share >= 0.25, 2).otherwise(1)
    return grouped.withColumn("most", most).select("weekday", "interval", "n", level.alias("level"))


def minute_rollup(sessions: DataFrame, messages: DataFrame, *within: str) -> DataFrame:
    """Counts at the minute a session starts and tokens at the minute of their message (of the session if it has none).

    ``messages``: the five keys but the minute, ts, session_ts and the token columns. ``within``: further keys, such as the conversation.
    """
    keys = [F.col(k) for k in (*within, *ROLLUP_KEYS[1:])]
    zero = F.lit(0).cast("long")
    starts = sessions.where("ts is not null").select(
        minute("ts").alias("bucket_start"), *keys, F.lit(1).cast("long").alias("session_count"), session_messages().cast("long").alias("message_count"),
        F.col("user_message_count").cast("long"), F.col("assistant_message_count").cast("long"), *(zero.alias(c) for c in TOKENS),
    )
    spent = messages.where(total_tokens() > 0).select(minute(F.coalesce("ts", "session_ts")).alias("bucket_start"), *keys, *(zero.alias(c) for c in ROLLUP_COUNTS), *(F.col(c).cast("long") for c in TOKENS)).where("bucket_start is not null")
    return reaggregate(starts.unionByName(spent), *within)


def reaggregate(rows: DataFrame, *within: str) -> DataFrame:
    return rows.groupBy(*within, *ROLLUP_KEYS).agg(*(F.sum(c).alias(c) for c in (*ROLLUP_COUNTS, *TOKENS)))


def daily_by_split(rollup: DataFrame, name: str, within: TimeRange, allowed: list[str] | None = None) -> DataFrame:
    """A dense daily series of sessions and tokens for each key, with flags for days that have a value."""
    kept = rollup.where(within.contains("bucket_start", strict=True)).withColumn("key", dimension(name))
    if allowed:
        kept = kept.where(F.col("key").isin(*allowed))
    values = kept.groupBy("key", local_day("bucket_start", within.tz).alias("day")).agg(F.sum("session_count").alias("sessions"), F.sum(total_tokens()).alias("tokens"))
    bounds = day_bounds(kept, "bucket_start", within)
    if bounds is None:
        return values.select("key", "day", "sessions", "tokens", F.lit(False).alias("has_tokens")).limit(0)
    frame = values.select("key").distinct().select("key", F.explode(F.sequence(F.lit(bounds[0]), F.lit(bounds[1]))).alias("day"))
    return frame.join(values, ["key", "day"], "left").select(
        "key", "day", F.coalesce("sessions", F.lit(0)).cast("long").alias("sessions"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.col("tokens") > 0, F.lit(False)).alias("has_tokens"),
    )


def peak(series: DataFrame, value: str) -> DataFrame:
    """The day of the greatest value; the first of equals."""
    return series.orderBy(F.desc(value), "day").limit(1)


def peak_of_split(series: DataFrame, value: str) -> DataFrame:
    """The key and day of the greatest value of a split series; the first of equals, none where all are 0."""
    return series.where(F.col(value) > 0).orderBy(F.desc(value), "key", "day").limit(1).select("key", "day", value)


def live_rollup(events: DataFrame, late: str = "1 day", value: str = "value") -> DataFrame:
    """The rollup of an event stream: minutes with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(value)).alias("amount")).select(F.col("w.start").alias("bucket_start"), "event_type", "n", "amount")
