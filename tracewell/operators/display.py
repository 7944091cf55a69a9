"""What a list of conversations shows: names, titles, descriptions, plans, filter text, places of query words, raw logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.expr import display_slug, total_tokens, truncated
from tracewell.functions.text import duration_text, tool_summary

UNTITLED = "untitled"


def display_name(name: Column, slug: Column, first_message: Column) -> Column:
    """The given name, else the slug, else the beginning of the first message."""
    given = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    return F.coalesce(given(name), F.nullif(given(slug), F.lit(UNTITLED)), given(truncated(first_message, 40)), F.lit(UNTITLED))


def title(project: Column, name: Column, date: Column, relative: Column, is_subagent: Column, branch: Column, parts: Column) -> Column:
    """``[sub] project / name  date (relative)  branch  (n parts)``, what is empty left out."""
    some = lambda c, text: F.when(F.coalesce(c, F.lit("")) != "", text).otherwise("")
    return F.concat(
        F.when(is_subagent, "[sub] ").otherwise(""), project, F.lit(" / "), name, F.lit("  "), date, some(relative, F.concat(F.lit(" ("), relative, F.lit(")"))),
        some(branch, F.concat(F.lit("  "), branch)), F.when(parts > 1, F.format_string("  (%d parts)", parts)).otherwise(""),
    )


def description(duration_us: Column, tool_counts: Column, trailing: Column) -> Column:
    """Version, model, messages, tokens, duration and tools of a row of the catalogue, two spaces between, what is empty left out; ``trailing`` on a line of its own."""
    total, main = F.col("total_message_count"), F.col("main_message_count")
    messages = F.concat(F.format_string("%d msgs", total), F.when((main > 0) & (main != total), F.format_string(" (%d main)", main)).otherwise(""))
    tokens = F.when(total_tokens() > 0, F.concat(F.floor(total_tokens() / 1000).cast("string"), F.lit("k tokens")))
    parts = F.array(F.col("version"), F.col("model"), messages, tokens, F.when(duration_us > 0, duration_text(duration_us)), tool_summary(tool_counts))
    line = F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "  ")
    return F.concat(line, F.when(F.coalesce(trailing, F.lit("")) != "", F.concat(F.lit("\n"), trailing)).otherwise(""))


def plan_text(path: Column, content: Column) -> Column:
    return F.concat(F.lit("Plan: "), F.element_at(F.split(path, "/"), -1), F.lit("\n\n"), content)


def filter_text() -> Column:
    """What a session is filtered by: project, slug, first message and branch."""
    return F.concat_ws(" ", "project", display_slug(F.col("slug"), F.col("first_message")), "first_message", "git_branch")


def in_browser_order(conversations: DataFrame) -> DataFrame:
    """The latest begun first."""
    return conversations.orderBy(F.desc_nulls_last("first_ts"), "cache_key")


def match_indices(text: Column, query: Column) -> Column:
    """Places of all characters of ``text`` (from 0) that belong to a word of the query, in any case, rising and once each; hits of a word do not overlap."""
    words = F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of_word(word: Column) -> Column:
        between = F.split(F.lower(text), F.concat(F.lit(r"\Q"), word, F.lit(r"\E")), -1)
        hits = F.slice(F.sequence(F.lit(0), F.size(between)), 1, F.size(between) - 1)
        start = lambda i: F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda n, gap: n + F.char_length(gap)) + i * F.char_length(word)
        return F.flatten(F.transform(hits, lambda i: F.sequence(start(i), start(i) + F.char_length(word) - 1)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(words, of_word))))


def raw_text(sessions: DataFrame, key: str = "cache_key") -> DataFrame:
    """(key, text): the source files of each conversation one after the other, each ended by a line feed. For chosen conversations, as each becomes one value."""
    spark = sessions.sparkSession
    paths = [r.file_path for r in sessions.select("file_path").distinct().collect()]  # the files of what was chosen to be shown
    if not paths:
        return sessions.select(key, F.lit("").alias("text")).limit(0)
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    ended = F.when((F.col("value") == "") | F.endswith("value", F.lit("\n")), F.col("value")).otherwise(F.concat("value", F.lit("\n")))
    same = lambda df: df.withColumn("_path", F.regexp_replace("file_path", "^file:/+", "/"))
    own = same(sessions.select(key, "file_path", "ordinal")).join(same(files).select("_path", F.expr("value").alias("_value")).withColumnRenamed("_value", "value").withColumn("value", ended), "_path")
    return own.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "file_path", "value"))), lambda x: x["value"]), "").alias("text"))
