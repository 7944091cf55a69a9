"""Totals, token groups, top sessions and the token trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.expr import TOKENS, dimension, label_or_unknown, provider_label, session_messages, total_tokens, trend_direction
from tracewell.plans.timeframe import TimeRange

FLAT_PERCENT = 5.0


def totals(sessions: DataFrame, within: TimeRange = TimeRange()) -> DataFrame:
    return sessions.where(within.contains("ts")).agg(
        F.count("*").alias("sessions"), F.coalesce(F.sum(session_messages()), F.lit(0)).alias("messages"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS), F.coalesce(F.sum(total_tokens()), F.lit(0)).alias("total_tokens"),
    )


def tokens_by(sessions: DataFrame, name: str, within: TimeRange = TimeRange()) -> DataFrame:
    """Tokens by model or project, largest first; sessions without tokens or name are left out."""
    kept = sessions.where(within.contains("ts")).where((total_tokens() > 0) & (F.trim(name) != ""))
    return kept.groupBy(F.col(name).alias("name")).agg(F.sum(total_tokens()).alias("tokens")).orderBy(F.desc("tokens"), "name")


def tokens_by_provider_version(sessions: DataFrame, within: TimeRange = TimeRange()) -> DataFrame:
    kept = sessions.where(within.contains("ts")).where((total_tokens() > 0) & ((F.trim("provider") != "") | (F.trim("version") != "")))
    keys = (provider_label("provider").alias("provider"), label_or_unknown("version").alias("version"))
    return kept.groupBy(*keys).agg(F.sum(total_tokens()).alias("tokens")).orderBy(F.desc("tokens"), "provider", "version")


def top_sessions(sessions: DataFrame, n: int = 5, within: TimeRange = TimeRange()) -> DataFrame:
    kept = sessions.where(within.contains("ts")).withColumn("tokens", total_tokens()).where("tokens > 0")
    return kept.select("project", "slug", "session_id", "ts", "tokens").orderBy(F.desc("tokens"), F.desc("ts"), "project", "slug").limit(n)


def token_trend(sessions: DataFrame, within: TimeRange) -> DataFrame:
    """Tokens of the window against the one before: none, flat, up or down with a rounded percentage."""
    before = within.previous()
    if before is None:
        return sessions.sparkSession.createDataFrame([("none", 0)], "direction string, percent_change int")
    now, old = within.contains("ts"), before.contains("ts")
    sums = sessions.where(now | old).agg(F.sum(F.when(now, total_tokens())).alias("now"), F.sum(F.when(old, total_tokens())).alias("old"))
    change = (F.coalesce("now", F.lit(0)) - F.col("old")) / F.col("old") * 100
    known = F.coalesce(F.col("old") > 0, F.lit(False))
    direction = F.when(known, trend_direction(F.when(known, change), FLAT_PERCENT)).otherwise("none")
    return sums.select(direction.alias("direction"), F.when(direction.isin("up", "down"), F.round(F.when(known, change))).otherwise(0).cast("int").alias("percent_change"))


def token_trend_from_rollup(rollup: DataFrame, within: TimeRange) -> DataFrame:
    """The trend by whole days of the minute rollup."""
    return token_trend(rollup.withColumn("ts", F.col("bucket_start")), within)


def leading_share(groups: DataFrame) -> DataFrame:
    """The first of ``tokens_by`` and its share of all."""
    return groups.agg(F.max("tokens").alias("tokens"), F.sum("tokens").alias("total"), F.min_by("name", F.struct(-F.col("tokens"), F.col("name"))).alias("name")).select("name", (F.col("tokens") / F.col("total")).alias("share"))


def by_split(sessions: DataFrame, name: str, within: TimeRange = TimeRange(), allowed: list[str] | None = None) -> DataFrame:
    """Tokens and sessions of each key of a dimension; an empty set of keys allows all."""
    kept = sessions.where(within.contains("ts", strict=True)).withColumn("key", dimension(name))
    if allowed:
        kept = kept.where(F.col("key").isin(*allowed))
    return kept.groupBy("key").agg(F.count("*").alias("sessions"), F.sum(total_tokens()).alias("tokens")).orderBy("key")
