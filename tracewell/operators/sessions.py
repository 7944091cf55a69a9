"""Session statistics, histograms, scalar statistics by mode, and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.expr import bucket, dimension, duration_us, is_abandoned, is_memory_path, map_total, prompt_tokens, safe_ratio, session_messages, total_tokens
from tracewell.plans.timeframe import TimeRange

# Labels and upper edges of the histograms.
DURATION_LABELS, DURATION_EDGES = ("<5m", "5-15m", "15-30m", "30-60m", "1-2h", "2h+"), [5, 15, 30, 60, 120]
MESSAGE_LABELS, MESSAGE_EDGES = ("1-5", "5-15", "15-30", "30-60", "60+"), [5, 15, 30, 60]
MODES = ("avg", "p50", "p95", "p99", "max", "total")
MINUTE_US = 60_000_000


def stats(sessions: DataFrame, within: TimeRange = TimeRange()) -> DataFrame:
    kept = sessions.where(within.contains("ts"))
    n, gone = F.count("*"), F.count_if(is_abandoned())
    return kept.agg(
        n.alias("sessions"), F.when(n > 0, F.floor(F.sum(duration_us()) / n)).otherwise(0).cast("long").alias("avg_duration_us"),
        safe_ratio(F.sum(session_messages()), n).alias("avg_messages"), safe_ratio(F.sum("assistant_message_count"), F.sum("user_message_count")).alias("assistant_per_user"),
        gone.alias("abandoned"), (safe_ratio(gone, n) * 100).alias("abandoned_rate"),
    )


def labelled_histogram(df: DataFrame, index: Column, labels: tuple[str, ...], *sums: Column) -> DataFrame:
    """Rows by bucket, the empty ones too."""
    names = df.sparkSession.createDataFrame(list(enumerate(labels)), "bucket int, label string")
    seen = df.groupBy(index.cast("int").alias("bucket")).agg(F.count("*").alias("n"), *sums)
    return names.join(seen, "bucket", "left")


def duration_histogram(sessions: DataFrame, within: TimeRange = TimeRange()) -> DataFrame:
    """Upper edges are exclusive."""
    out = labelled_histogram(sessions.where(within.contains("ts")), duration_bucket(), DURATION_LABELS)
    return out.select("bucket", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def duration_bucket() -> Column:
    return bucket(duration_us(), [e * MINUTE_US for e in DURATION_EDGES], inclusive=False)


def message_histogram(sessions: DataFrame, within: TimeRange = TimeRange()) -> DataFrame:
    """Upper edges are inclusive, and the first bucket takes sessions without messages."""
    out = labelled_histogram(sessions.where(within.contains("ts")), bucket(session_messages(), MESSAGE_EDGES, inclusive=True), MESSAGE_LABELS)
    return out.select("bucket", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def session_statistic(sessions: DataFrame, what: str, within: TimeRange = TimeRange()) -> DataFrame:
    """All modes of duration, messages or tool calls of sessions."""
    value = {"duration": duration_us(), "messages": session_messages(), "tool_calls": map_total("tool_counts")}[what]
    kept = sessions.where(within.contains("ts")).select(value.cast("long").alias("v"))
    return kept.agg(*(statistic_of("v", m, whole=what == "duration").alias(m) for m in MODES))


def statistic_of(name: str, mode: str, whole: bool = False, kind: str = "long") -> Column:
    """An aggregate of a column by mode; percentiles are nearest-rank (of type ``kind``), an average of whole numbers is cut off."""
    c = F.col(name)
    if mode == "avg":
        return F.floor(F.sum(c) / F.count(c)).cast("long") if whole else F.avg(c)
    if mode[0] == "p":
        return F.expr(f"percentile_disc({int(mode[1:]) / 100}) within group (order by `{name}`)").cast(kind)
    return {"max": F.max, "total": F.sum}[mode](c)


def build_turns(messages: DataFrame, *keys: str) -> DataFrame:
    """Turns of main-thread sessions: (keys, position, prompt_tokens, turn_tokens, cache_read_tokens, cache_creation_tokens, memory_writes).

    A turn begins at a user message with text, or at a divider that carries one; a divider without
    text ends the turn and what follows waits for the next beginning. Only turns with usage count;
    memory writes of one without are carried to the next that has.
    ``messages``: keys, ordinal, role, text, is_sidechain, is_agent_divider, tokens and memory_writes.
    """
    here = Window.partitionBy(*keys).orderBy("ordinal")
    main = messages.where("not is_sidechain")
    boundary = (F.col("role") == "user") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    cut = F.col("is_agent_divider") | boundary
    marked = main.withColumn("_segment", F.count_if(cut).over(here)).withColumn("_opens", F.when(cut, boundary))
    marked = marked.withColumn("_open", F.last("_opens", ignorenulls=True).over(here)).where(F.coalesce("_open", F.lit(False)) & ~cut)
    used = (F.col("role") == "assistant") & (total_tokens() > 0)
    first = lambda c: F.min_by(F.when(used, F.col(c)), F.when(used, F.col("ordinal")))
    turns = marked.groupBy(*keys, "_segment").agg(
        F.max(F.when(used, prompt_tokens())).alias("prompt_tokens"), F.sum(F.when(used, total_tokens())).alias("turn_tokens"),
        first("cache_read_tokens").alias("cache_read_tokens"), first("cache_creation_tokens").alias("cache_creation_tokens"), F.sum("memory_writes").alias("_writes"),
    )
    along = Window.partitionBy(*keys).orderBy("_segment")
    turns = turns.withColumn("_next", F.first(F.when(F.col("turn_tokens").isNotNull(), F.col("_segment")), ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing)))
    turns = turns.withColumn("memory_writes", F.sum("_writes").over(Window.partitionBy(*keys, "_next")))
    kept = turns.where("turn_tokens is not null")
    return kept.withColumn("position", F.row_number().over(along)).select(*keys, "position", "prompt_tokens", "turn_tokens", "cache_read_tokens", "cache_creation_tokens", "memory_writes")


def memory_writes(targets: Column, action: Column) -> Column:
    """How many targets of a mutation are memory files."""
    hits = F.size(F.filter(targets, lambda t: (t["type"] == "file_path") & is_memory_path(t["value"])))
    return F.when(action.isin("mutate", "rewrite"), hits).otherwise(0).cast("long")


def turns_by_position(turns: DataFrame, within: TimeRange = TimeRange()) -> DataFrame:
    kept = turns.where(within.contains("ts", strict=True))
    return kept.groupBy("position").agg(F.avg("prompt_tokens").alias("avg_prompt"), F.avg("turn_tokens").alias("avg_turn"), F.count("*").alias("n"))


def turns_by_position_mode(turns: DataFrame, mode: str, within: TimeRange = TimeRange(), split: str | None = None) -> DataFrame:
    """Prompt and turn tokens by position in a mode, for each provider or version if asked."""
    if split not in (None, "provider", "version"):
        raise ValueError("turns are split by provider or version only")
    kept = turns.where(within.contains("ts", strict=True))
    keys = ["position"]
    if split:
        kept, keys = kept.withColumn("key", dimension(split)), ["key", "position"]
    return kept.groupBy(*keys).agg(statistic_of("prompt_tokens", mode).cast("double").alias("prompt"), statistic_of("turn_tokens", mode).cast("double").alias("turn"), F.count("*").alias("n"))


def early_late(by_position: DataFrame) -> DataFrame:
    """Mean prompt of positions 1 to 5 and 20 to 999, and their ratio."""
    means = by_position.agg(F.avg(F.when(F.col("position").between(1, 5), F.col("avg_prompt"))).alias("early"), F.avg(F.when(F.col("position").between(20, 999), F.col("avg_prompt"))).alias("late"))
    return means.select(F.coalesce("early", F.lit(0.0)).alias("early"), F.coalesce("late", F.lit(0.0)).alias("late"), safe_ratio(F.coalesce("late", F.lit(0.0)), F.coalesce("early", F.lit(0.0))).alias("multiplier"))
