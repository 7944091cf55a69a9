"""Conversations: grouping, roots of subagents, insertion of their transcripts, roll-ups, plans, replacement by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.expr import TOKENS, session_messages, version_key


def cache_key(provider: Column, provider_id: Column) -> Column:
    return F.when(F.trim(provider) == "", provider_id).otherwise(F.concat_ws(":", provider, provider_id))


def group_key(directory: Column, slug: Column, path: Column, is_subagent: Column) -> Column:
    """Main sessions of a project with one slug belong together; all others stand alone by path."""
    return F.when(is_subagent | (F.trim(slug) == ""), F.concat(F.lit("path:"), path)).otherwise(F.concat(F.lit("group:"), directory, F.lit(":"), slug))


def flatten(conversations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions with the provider and project of their conversation where their own are blank."""
    parent = conversations.select("cache_key", F.col("provider").alias("_provider"), F.col("project").alias("_project"))
    fill = lambda own, other: F.when(F.trim(own) == "", F.col(other)).otherwise(F.col(own))
    return sessions.join(parent, "cache_key").withColumns({"provider": fill("provider", "_provider"), "project": fill("project", "_project")}).drop("_provider", "_project")


def rolled_up(sessions: DataFrame) -> DataFrame:
    """One row for each conversation: usage, messages, first and last moments, model and version of the first and latest main session."""
    main = ~F.col("is_subagent")
    latest = lambda c: F.max_by(c, F.when(main & (F.trim(c) != ""), F.col("ordinal")))
    first = lambda c: F.min_by(c, F.when(F.trim(c) != "", F.col("ordinal")))
    return sessions.groupBy("cache_key").agg(
        F.min("provider").alias("provider"), F.min("project").alias("project"), F.min("ts").alias("first_ts"), F.max(F.greatest("ts", "last_ts")).alias("last_ts"),
        *(F.sum(c).alias(c) for c in TOKENS), F.sum("message_count").alias("total_message_count"), F.sum(session_messages()).alias("main_message_count"),
        F.coalesce(first("model"), F.lit("")).alias("model"), F.coalesce(latest("version"), first("version"), F.lit("")).alias("version"), F.coalesce(latest("git_branch"), first("git_branch"), F.lit("")).alias("git_branch"),
        F.count_if(main).alias("part_count"), F.max_by(F.struct("session_id", "cwd"), F.when(main, F.col("ordinal"))).alias("resume"),
    )


def roots(threads: DataFrame) -> DataFrame:
    """(thread, root) for a table of (thread, parent), by pointer jumping: each round doubles the distance to the root that is known.

    A thread whose chain ends at a missing parent or has a cycle is a root of its own. As long as a
    chain has an end, each round finds that of some thread; what a round leaves as it was are cycles.
    """
    own = threads.select("thread", F.col("parent").alias("_p")).join(threads.select(F.col("thread").alias("_p"), F.lit(True).alias("_there")), "_p", "left")
    link = own.select("thread", F.when(F.col("_there"), F.col("_p")).alias("next"), (F.col("_p").isNotNull() & F.col("_there").isNull()).alias("lost"))
    known = link.select("thread", F.coalesce("next", "thread").alias("to"), F.col("next").isNull().alias("ended"), "lost")
    open_before, still_open = None, known.where("not ended").count()
    while still_open and still_open != open_before:
        ahead = known.select(F.col("thread").alias("to"), F.col("to").alias("_far"), F.col("ended").alias("_done"), F.col("lost").alias("_lost"))
        known = known.join(ahead, "to").select("thread", F.col("_far").alias("to"), F.col("_done").alias("ended"), F.col("_lost").alias("lost")).checkpoint()
        open_before, still_open = still_open, known.where("not ended").count()
    return known.select("thread", F.when(F.col("ended") & ~F.col("lost"), F.col("to")).otherwise(F.col("thread")).alias("root"))


def insert_children(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Messages of children among those of their parent: after the last that is not later than the child begins.

    ``parents``: conversation, ordinal, ts; ``children``: conversation, child, anchor (when it begins), ordinal. A child
    without a moment comes last. Returns conversation, place, child (null for the parent's own), ordinal.
    """
    starts = children.select("conversation", "child", "anchor").distinct()
    # one pass in time order instead of a range join: the greatest ordinal so far at each anchor
    points = parents.where("ts is not null").select("conversation", F.col("ts").alias("at"), F.lit(0).alias("kind"), "ordinal", F.lit(None).cast("string").alias("child"))
    points = points.unionByName(starts.where("anchor is not null").select("conversation", F.col("anchor").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("ordinal"), F.col("child").cast("string")))
    order = Window.partitionBy("conversation").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = points.withColumn("after", F.max("ordinal").over(order)).where("kind = 1").select("conversation", "child", F.coalesce("after", F.lit(-1)).alias("after"))
    end = parents.groupBy("conversation").agg(F.max("ordinal").alias("_end"))
    at = starts.withColumn("child", F.col("child").cast("string")).join(found, ["conversation", "child"], "left").join(end, "conversation", "left")
    at = at.select("conversation", "child", "anchor", F.coalesce("after", "_end", F.lit(-1)).alias("after"))
    rows = parents.select("conversation", F.col("ordinal").alias("after"), F.lit(0).alias("part"), F.lit(None).cast("timestamp").alias("anchor"), F.lit(None).cast("string").alias("child"), "ordinal")
    kids = children.select("conversation", F.col("child").cast("string").alias("child"), "ordinal").join(at, ["conversation", "child"])
    rows = rows.unionByName(kids.select("conversation", "after", F.lit(1).alias("part"), "anchor", "child", "ordinal"))
    here = Window.partitionBy("conversation").orderBy("after", "part", F.asc_nulls_last("anchor"), "child", "ordinal")
    return rows.select("conversation", F.row_number().over(here).alias("place"), "child", "ordinal")


def last_plans(plans: DataFrame, *keys: str) -> DataFrame:
    """The last plan of each path."""
    w = Window.partitionBy(*keys, "file_path").orderBy(F.desc("ordinal"))
    return plans.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_plans(plans: DataFrame, *keys: str) -> DataFrame:
    """The first plan of each path within its message."""
    w = Window.partitionBy(*keys, "file_path").orderBy("ordinal")
    return plans.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def by_lookup(sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sessions with a file path, session id or cache key that ``wanted`` (provider, kind, value) names; a row once."""
    keys = wanted.select("provider", "kind", "value").distinct()
    named = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("file_path", "session_id", "cache_key")))
    rows = sessions.withColumn("_named", F.explode(named)).withColumns({"kind": F.col("_named.kind"), "value": F.col("_named.value")}).drop("_named")
    return rows.join(keys, ["provider", "kind", "value"], "left_semi").drop("kind", "value").dropDuplicates(["provider", "file_path"])


def replaced(old: DataFrame, new: DataFrame, keys: DataFrame, key: str = "cache_key") -> DataFrame:
    """Old rows but those of ``keys``, and the new rows."""
    return old.join(keys.select(key).distinct(), key, "left_anti").unionByName(new)


def unmatched(rows: DataFrame, used: DataFrame, *keys: str) -> DataFrame:
    return rows.join(used.select(*keys).distinct(), list(keys), "left_anti")


def paired(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """The i-th row of a key with the i-th of the other side, by row number."""
    w = Window.partitionBy(key).orderBy(order)
    other = right.withColumn("_i", F.row_number().over(w))
    renamed = other.select(key, "_i", *(F.col(c).alias(f"other_{c}") for c in right.columns if c != key))
    return left.withColumn("_i", F.row_number().over(w)).join(renamed, [key, "_i"], "left").drop("_i")


def in_version_order(df: DataFrame, version: str = "version") -> DataFrame:
    """Rows with their place in version order."""
    places = df.select(version).distinct().withColumn("place", F.row_number().over(Window.orderBy(version_key(version), version)))
    return df.join(places, version)


def without_adjacent_repeats(messages: DataFrame, *keys: str, order: str = "ordinal") -> DataFrame:
    """Messages that differ from the one before in role or text."""
    w = Window.partitionBy(*keys).orderBy(order)
    now, before = F.struct("role", "text"), F.lag(F.struct("role", "text")).over(w)
    return messages.withColumn("_same", F.coalesce(now == before, F.lit(False))).where("not _same").drop("_same")
