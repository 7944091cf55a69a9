"""Numbers, spans of time and verdicts as short texts; series fitted to a number of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def duration_text(us: Column) -> Column:
    """45s, 12m, 3h 5m, 2d 4h."""
    s = F.floor(us / SECOND)
    days, hours, minutes = F.floor(s / 86400), F.floor(s / 3600), F.floor(s / 60)
    return (
        F.when(us <= 0, "0s").when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm", minutes))
        .when(s < 86400, F.format_string("%dh %dm", hours, minutes % 60)).otherwise(F.format_string("%dd %dh", days, hours % 24))
    )


def relative_text(ts: Column, now: Column) -> Column:
    """How long ago: just now, 5m ago, 3h ago, 2d ago, and the date beyond a week; nothing for no moment."""
    s = F.unix_seconds(now) - F.unix_seconds(ts)
    return (
        F.when(ts.isNull(), "").when(s < 60, "just now").when(s < 3600, F.format_string("%dm ago", F.floor(s / 60))).when(s < 86400, F.format_string("%dh ago", F.floor(s / 3600)))
        .when(s < 7 * 86400, F.format_string("%dd ago", F.floor(s / 86400))).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def percent_text(ratio: Column) -> Column:
    return F.format_string("%.1f%%", ratio * 100)


def ratio_text(ratio: Column) -> Column:
    """Two digits, or a sign for what has no bound."""
    return F.when(ratio == float("inf"), "∞").otherwise(F.format_string("%.2fx", ratio))


def delta_text(value: Column, baseline: Column) -> Column:
    """The change against the baseline in percent, signed; nothing without one."""
    return F.when(baseline == 0, "").otherwise(F.format_string("%+.0f%%", (value - baseline) / F.abs(baseline) * 100))


def verdict(trend: Column) -> Column:
    return F.when(trend == "up", "improving").when(trend == "down", "regressing").when(trend == "flat", "steady").otherwise("not enough data")


def tool_summary(counts: Column, n: int = 3) -> Column:
    """The most called tools as ``name:count``, by count and then name."""
    entries = F.transform(F.map_entries(counts), lambda e: F.struct((-e.value).alias("less"), e.key.alias("name")))
    return F.array_join(F.transform(F.slice(F.sort_array(entries), 1, n), lambda e: F.concat(e["name"], F.lit(":"), (-e["less"]).cast("string"))), " ")


def sparkline(series: DataFrame, order: str, value: str, width: int) -> DataFrame:
    """A series of few rows as one line of ``width`` bars: bar i shows value i * n / width on eight levels from least to greatest."""
    values = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))), lambda x: x.v)
    held = series.agg(values.alias("_v")).withColumns({"_n": F.size("_v"), "_low": F.array_min("_v"), "_span": F.array_max("_v") - F.array_min("_v")})

    def bar(i: Column) -> Column:
        at = F.element_at("_v", (F.floor(i * F.col("_n") / width) + 1).cast("int"))
        level = F.when(F.col("_span") > 0, F.floor((at - F.col("_low")) / F.col("_span") * 7)).otherwise(0)
        return F.substring(F.lit("▁▂▃▄▅▆▇█"), (level + 1).cast("int"), F.lit(1))

    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), bar), "")
    return held.select(F.when(F.col("_n") > 0, line).otherwise("·" * width).alias("line"))


def in_columns(series: DataFrame, order: str, value: str, width: int) -> DataFrame:
    """A series in at most ``width`` columns: the i-th of n values goes to column i * width / n, and columns are means.

    ``series`` has a row for each place of a calendar or a chart, so its rows are few.
    """
    numbered = series.select((F.row_number().over(Window.orderBy(order)) - 1).alias("_i"), F.count("*").over(Window.partitionBy()).alias("_n"), F.col(order).alias("first"), F.col(value).alias("_v"))
    column = F.when(F.col("_n") <= width, F.col("_i")).otherwise(F.floor(F.col("_i") * width / F.col("_n")))
    return numbered.groupBy(column.cast("int").alias("column")).agg(F.min("first").alias("first"), F.avg("_v").alias("value"))


def finite(value: Column, most: Column) -> Column:
    """Infinite ratios drawn at the greatest finite one."""
    return F.when(value == float("inf"), most).otherwise(value)
