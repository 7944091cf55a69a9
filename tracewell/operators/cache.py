"""Prompt cache: rates, segments, daily series, durations, splits and cold first turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.expr import cache_write, dimension, label_or_unknown, local_day, prompt_tokens, reuse_ratio, safe_ratio, version_key
from tracewell.operators.sessions import DURATION_LABELS, duration_bucket, labelled_histogram
from tracewell.plans.timeframe import TimeRange, calendar, day_bounds

MIN_FIRST_TURNS = 3


def facts(sessions: DataFrame, within: TimeRange = TimeRange()) -> DataFrame:
    """Sessions in the range with their prompt, read and write tokens."""
    kept = sessions.where(within.contains("ts"))
    return kept.withColumns({"prompt": prompt_tokens(), "read": F.col("cache_read_tokens"), "write": cache_write()})


def totals(sessions: DataFrame, within: TimeRange = TimeRange()) -> DataFrame:
    prompt, read, write = (F.coalesce(F.sum(c), F.lit(0)) for c in ("prompt", "read", "write"))
    return facts(sessions, within).agg(
        prompt.alias("prompt"), read.alias("read"), write.alias("write"), safe_ratio(read, prompt).alias("hit_rate"), safe_ratio(write, prompt).alias("write_rate"),
        safe_ratio(prompt - read - write, prompt).alias("miss_rate"), reuse_ratio(read, write).alias("reuse_ratio"),
    )


def segments(sessions: DataFrame, within: TimeRange = TimeRange()) -> DataFrame:
    """Main and subagent sessions; both rows always."""
    both = sessions.sparkSession.createDataFrame([("main", False), ("subagent", True)], "segment string, is_subagent boolean")
    sums = facts(sessions, within).groupBy("is_subagent").agg(F.count("*").alias("sessions"), *(F.sum(c).alias(c) for c in ("prompt", "read", "write")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    full = both.join(sums, "is_subagent", "left").select("segment", *(zero(c).alias(c) for c in ("sessions", "prompt", "read", "write")))
    return full.withColumn("miss", F.col("prompt") - F.col("read") - F.col("write")).withColumn("hit_rate", safe_ratio(F.col("read"), F.col("prompt")))


def daily(sessions: DataFrame, within: TimeRange = TimeRange()) -> DataFrame:
    kept = facts(sessions, within)
    sums = kept.groupBy(local_day("ts", within.tz).alias("day")).agg(*(F.sum(c).alias(c) for c in ("prompt", "read", "write")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return calendar(sessions, day_bounds(kept, "ts", within)).join(sums, "day", "left").select(
        "day", safe_ratio(zero("read"), zero("prompt")).alias("hit_rate"), reuse_ratio(zero("read"), zero("write")).alias("reuse_ratio"), F.col("prompt").isNotNull().alias("has_activity")
    )


def by_duration(sessions: DataFrame, within: TimeRange = TimeRange()) -> DataFrame:
    """The mean of the sessions' hit rates, and the ratio of their sums for reuse."""
    sums = (F.avg(safe_ratio(F.col("read"), F.col("prompt"))).alias("hit"), F.sum("read").alias("read"), F.sum("write").alias("write"))
    out = labelled_histogram(facts(sessions, within), duration_bucket(), DURATION_LABELS, *sums)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("bucket", "label", zero("n").cast("long").alias("n"), F.coalesce("hit", F.lit(0.0)).alias("hit_rate"), reuse_ratio(zero("read"), zero("write")).alias("reuse_ratio"))


def _split(sessions: DataFrame, name: str, within: TimeRange, allowed: list[str] | None) -> DataFrame:
    """Strictly kept sessions with their key and what neither was read nor written (a session that exceeds its prompt misses nothing)."""
    kept = facts(sessions, within).where(within.contains("ts", strict=True)).withColumn("key", dimension(name))
    kept = kept.withColumn("miss", F.greatest(F.col("prompt") - F.col("read") - F.col("write"), F.lit(0)))
    return kept.where(F.col("key").isin(*allowed)) if allowed else kept


def by_split(sessions: DataFrame, name: str, within: TimeRange = TimeRange(), allowed: list[str] | None = None) -> DataFrame:
    """Segment rows of each key: read, write, missed and prompt tokens of main and subagent sessions, those above 0."""
    measures = ["prompt", "read", "write", "miss"]
    sums = _split(sessions, name, within, allowed).groupBy("key", F.when(F.col("is_subagent"), "subagent").otherwise("main").alias("segment")).agg(*(F.sum(c).alias(c) for c in measures))
    return sums.unpivot(["key", "segment"], measures, "measure", "value").where("value > 0")


def split_rates(segment_rows: DataFrame) -> DataFrame:
    """Hit and write rate of each key of ``by_split``, against all that was read, written or missed."""
    of = lambda *names: F.sum(F.when(F.col("measure").isin(*names), F.col("value")).otherwise(0))
    sums = segment_rows.groupBy("key").agg(of("read").alias("read"), of("write").alias("write"), of("read", "write", "miss").alias("all"))
    return sums.select("key", safe_ratio(F.col("read"), F.col("all")).alias("hit_rate"), safe_ratio(F.col("write"), F.col("all")).alias("write_rate"))


def split_durations(sessions: DataFrame, name: str, within: TimeRange = TimeRange(), allowed: list[str] | None = None) -> DataFrame:
    """Read and written tokens of each key by the duration of sessions, those above 0."""
    sums = _split(sessions, name, within, allowed).groupBy("key", duration_bucket().cast("int").alias("bucket")).agg(F.sum("read").alias("read"), F.sum("write").alias("write"))
    return sums.unpivot(["key", "bucket"], ["read", "write"], "measure", "value").where("value > 0")


def daily_by_split(sessions: DataFrame, name: str, within: TimeRange = TimeRange()) -> DataFrame:
    """Read and write shares of the day's prompt for each key; values of 0 are left out."""
    kept = facts(sessions, within).withColumn("key", dimension(name))
    sums = kept.groupBy(local_day("ts", within.tz).alias("day"), "key").agg(*(F.sum(c).alias(c) for c in ("prompt", "read", "write")))
    shares = sums.select("day", "key", safe_ratio(F.col("read"), F.col("prompt")).alias("read_share"), safe_ratio(F.col("write"), F.col("prompt")).alias("write_share"))
    return shares.where("read_share > 0 or write_share > 0")


def first_turn_cold(turns: DataFrame, within: TimeRange = TimeRange(), provider: str = "claude") -> DataFrame:
    """First turns by version that read nothing from the cache, for versions with enough of them."""
    first = turns.where(within.contains("ts", strict=True)).where((F.col("provider") == provider) & (F.col("position") == 1))
    grouped = first.groupBy(label_or_unknown("version").alias("version")).agg(F.count("*").alias("n"), F.count_if(F.col("cache_read_tokens") == 0).alias("zeros"), F.floor(F.percentile("cache_read_tokens", 0.5)).cast("long").alias("median_read"))
    return grouped.where(F.col("n") >= MIN_FIRST_TURNS).withColumn("zero_rate", F.col("zeros") / F.col("n"))


def cold_summary(by_version: DataFrame) -> DataFrame:
    """Of ``first_turn_cold``: the version that reads nothing most often (the first of equals), its rate, the rate of all and the number of versions."""
    worst = F.min_by("version", F.struct(-F.col("zero_rate"), version_key("version")))
    return by_version.agg(worst.alias("worst_version"), F.max("zero_rate").alias("worst_rate"), F.try_divide(F.sum("zeros"), F.sum("n")).alias("overall_rate"), F.count("*").alias("versions"))


def best_duration(buckets: DataFrame, measure: str = "hit_rate") -> DataFrame:
    """The bucket of the highest hit rate or reuse ratio among those with sessions; none where all are 0."""
    return buckets.where((F.col("n") > 0) & (F.col(measure) > 0)).orderBy(F.desc(measure), "bucket").limit(1).select("label", measure)
