"""Tool calls: totals, rates, category shares, histogram, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.expr import bucket, category_calls, dimension, map_total, safe_ratio
from tracewell.operators.sessions import labelled_histogram
from tracewell.plans.timeframe import TimeRange

# Labels and upper edges of the histogram, floors of the rates.
CALL_LABELS, CALL_EDGES = ("0-20", "21-50", "51-100", "101-200", "201+"), [20, 50, 100, 200]
MIN_CALLS, MIN_ERRORS, MIN_REJECTS = 5, 3, 1


def totals(sessions: DataFrame, within: TimeRange = TimeRange(), strict: bool = False) -> DataFrame:
    kept = sessions.where(within.contains("ts", strict)).select(
        map_total("tool_counts").alias("calls"), map_total("tool_error_counts").alias("errors"), map_total("tool_reject_counts").alias("rejects"),
        *(category_calls(c).alias(c) for c in ("read", "write", "bash")),
    )
    calls = F.coalesce(F.sum("calls"), F.lit(0))
    every = F.coalesce(F.sum(F.col("read") + F.col("write") + F.col("bash")), F.lit(0))
    return kept.agg(
        calls.alias("total_calls"), safe_ratio(calls, F.count("*")).alias("avg_calls"),
        (safe_ratio(F.sum("errors"), calls) * 100).alias("error_rate"), (safe_ratio(F.sum("rejects"), calls) * 100).alias("reject_rate"),
        *((safe_ratio(F.sum(c), every) * 100).alias(f"{c}_share") for c in ("read", "write", "bash")),
    )


def calls_histogram(sessions: DataFrame, within: TimeRange = TimeRange()) -> DataFrame:
    out = labelled_histogram(sessions.where(within.contains("ts")), bucket(map_total("tool_counts"), CALL_EDGES, inclusive=True), CALL_LABELS)
    return out.select("bucket", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def merged_counts(df: DataFrame, *keys: Column) -> DataFrame:
    """Calls, errors and rejects of each tool name, and of each key if given."""
    one = lambda c, kind: df.select(*keys, F.explode(c).alias("name", "n")).withColumn("kind", F.lit(kind))
    rows = one("tool_counts", "calls").unionByName(one("tool_error_counts", "errors")).unionByName(one("tool_reject_counts", "rejects"))
    names = [c for c in rows.columns if c not in ("n", "kind")]
    return rows.groupBy(*names).agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("calls", "errors", "rejects")))


def top_tools(sessions: DataFrame, within: TimeRange = TimeRange()) -> DataFrame:
    return merged_counts(sessions.where(within.contains("ts"))).where("calls > 0").select("name", "calls").orderBy(F.desc("calls"), "name")


def rates(sessions: DataFrame, kind: str, within: TimeRange = TimeRange()) -> DataFrame:
    """Error or reject rates of tools with enough calls and cases."""
    least = {"errors": MIN_ERRORS, "rejects": MIN_REJECTS}[kind]
    counts = merged_counts(sessions.where(within.contains("ts"))).where((F.col("calls") >= MIN_CALLS) & (F.col(kind) >= least))
    return counts.select("name", F.col(kind).alias("n"), "calls", (F.col(kind) / F.col("calls") * 100).alias("rate")).orderBy(F.desc("rate"), F.desc("n"), "name")


def by_split(sessions: DataFrame, name: str, within: TimeRange = TimeRange(), allowed: list[str] | None = None) -> DataFrame:
    """Calls, errors and rejects of each tool and key of a dimension."""
    kept = sessions.where(within.contains("ts", strict=True)).withColumn("_key", dimension(name))
    if allowed:
        kept = kept.where(F.col("_key").isin(*allowed))
    return merged_counts(kept, F.col("_key").alias("key"))
