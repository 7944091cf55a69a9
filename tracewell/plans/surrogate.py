"""Session facts with the engine's columns, made from the tables of events and conversations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.timeframe import TimeRange

#: Event type -> tool name, action, token column.
KINDS = {
    "click": ("Read", "read", "input_tokens"), "view": ("Grep", "search", "cache_creation_tokens"), "signup": ("Bash", "execute", "cache_read_tokens"),
    "purchase": ("Edit", "mutate", "output_tokens"), "error": ("Write", "test", "reasoning_output_tokens"),
}
MONTH = TimeRange(datetime(2024, 1, 1), datetime(2024, 1, 31))
HALF = TimeRange(datetime(2024, 1, 16), datetime(2024, 1, 31))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keys_of(user: str = "user_id") -> dict[str, Column]:
    u = F.col(user)
    return {
        "provider": F.when(u % 2 == 1, "codex").otherwise("claude"), "version": F.concat_ws(".", (u % 4).cast("string"), (u % 3).cast("string")),
        "model": F.concat(F.lit("m"), (u % 5).cast("string")), "project": F.concat(F.lit("p"), (u % 7).cast("string")),
    }


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number in their props and whole values."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.floor("value").cast("long").alias("amount"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))
    return e.withColumns({"tool": F.expr(_by_kind(0)), "action": F.expr(f"if(event_type = 'purchase' and k % 4 = 0, 'rewrite', {_by_kind(1)})")})


def _by_kind(i: int) -> str:
    return "case event_type " + " ".join(f"when '{kind}' then '{names[i]}'" for kind, names in KINDS.items()) + " end"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each user and day; counts by event type stand for tools, actions and tokens."""
    tools = [k[0] for k in KINDS.values()]
    actions = [*(k[1] for k in KINDS.values()), "rewrite"]
    tests = {"calls": "true", "errors": "k % 5 = 0", "rejects": "k % 7 = 0 and k % 5 <> 0"}
    sums = [f"coalesce(sum(amount) filter (where event_type = '{kind}'), 0L) as {column}" for kind, (_, _, column) in KINDS.items()]
    for name, test in tests.items():
        sums += [f"count_if({test} and {what} = '{x}') as _{what[0]}_{name}_{x}" for what, names in (("tool", tools), ("action", actions)) for x in names]
    marks = {
        "_abort": "event_type = 'error' and k % 11 = 0", "_start": "event_type = 'click'", "_done": "event_type = 'view'", "_retry": "event_type = 'error' and k % 6 = 0", "_api": "event_type = 'error' and k % 13 = 0",
        "_compact": "k = 42", "_blocks": "event_type = 'signup'", "_redacted": "event_type = 'signup' and k % 2 = 0", "user_message_count": "event_type in ('click', 'view')",
    }
    sums += [f"count_if({test}) as {name}" for name, test in marks.items()]
    grouped = numbered_events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day"))
    out = grouped.agg(*map(F.expr, ["min(ts) as ts", "max(ts) as last_ts", "count(*) as message_count", "max(k) as _thinking", *sums]))

    def counts(prefix: str, names: list[str]) -> str:
        entries = ", ".join(f"struct('{x}' as key, {prefix}_{x} as value)" for x in names)
        return f"map_from_entries(filter(array({entries}), x -> x.value > 0))"

    none = "cast(map() as map<string,bigint>)"
    keys = {"provider": "if(user_id % 2 = 1, 'codex', 'claude')", "version": "concat_ws('.', cast(user_id % 4 as string), cast(user_id % 3 as string))", "model": "concat('m', cast(user_id % 5 as string))", "project": "concat('p', cast(user_id % 7 as string))"}
    performance = {
        "abort_count": "_abort", "task_started_count": "_start", "task_complete_count": "_done", "retry_attempt_count": "_retry", "api_error_counts": f"if(_api > 0, map('500', _api), {none})", "compaction_count": "_compact", "micro_compaction_count": "0L",
        "context_compacted_count": "0L", "reasoning_block_count": "_blocks", "reasoning_redaction_count": "_redacted", "max_thinking_tokens": "if(user_id % 3 = 0, _thinking, 0L)",
    }
    return out.selectExpr(
        f"concat_ws(':', {keys['provider']}, cast(user_id as string)) as cache_key", "concat_ws('-', cast(user_id as string), date_format(day, 'yyyyMMdd')) as session_id", "user_id", "day", *(f"{v} as {k}" for k, v in keys.items()),
        "concat('s', cast(user_id as string)) as slug", "ts", "last_ts", "message_count", "message_count as main_message_count", "user_message_count", "message_count - user_message_count as assistant_message_count",
        "input_tokens", "if(user_id % 3 = 0, cache_creation_tokens, 0L) as cache_creation_tokens", "cache_read_tokens", "output_tokens", "reasoning_output_tokens",
        f"{counts('_t_calls', tools)} as tool_counts", f"{counts('_t_errors', tools)} as tool_error_counts", f"{counts('_t_rejects', tools)} as tool_reject_counts",
        *(f"if(user_id % 3 <> 2, {counts(f'_a_{c}', actions)}, {none}) as {name}" for c, name in (("calls", "action_counts"), ("errors", "action_error_counts"), ("rejects", "action_reject_counts"))),
        "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in performance.items()) + ") as performance", "user_id % 10 = 0 as is_subagent",
    )


def spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-bearing messages of those sessions: one for each event."""
    e = numbered_events(spark, sf_dir)
    zero = F.lit(0).cast("long")
    amount = {column: F.when((F.col("event_type") == kind) & (F.lit(True) if column != "cache_creation_tokens" else F.col("user_id") % 3 == 0), F.col("amount")).otherwise(zero).alias(column) for kind, (_, _, column) in KINDS.items()}
    return e.select(*(v.alias(k) for k, v in keys_of().items()), "ts", F.col("ts").alias("session_ts"), *amount.values())


def turn_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the conversations; the length of a text stands for its tokens."""
    c = table(spark, sf_dir, "conversations")
    zero, size = F.lit(0).cast("long"), F.char_length("text").cast("long")
    said = F.col("role") == "assistant"
    return c.select(
        "conv_id", F.col("turn").alias("ordinal"), "role", "text", F.lit(False).alias("is_sidechain"), F.lit(False).alias("is_agent_divider"),
        F.when(said, size).otherwise(zero).alias("input_tokens"), zero.alias("cache_creation_tokens"), F.when(said, size % 7).otherwise(zero).alias("cache_read_tokens"),
        F.when(said, F.lit(10).cast("long")).otherwise(zero).alias("output_tokens"), zero.alias("reasoning_output_tokens"), F.when(F.contains("text", F.lit("que")), 1).otherwise(0).cast("long").alias("memory_writes"),
    )


def action_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of a user's events as calls: the number in the props names the target file."""
    e = numbered_events(spark, sf_dir)
    target = F.concat(F.lit("f"), (F.col("k") % 6).cast("string"))
    return e.select(
        "user_id", F.struct("ts", "event_id").alias("at"), F.lit("call").alias("kind"), *(F.lit(None).cast("string").alias(c) for c in ("role", "text", "thinking")), F.lit(False).alias("has_hidden_thinking"),
        F.lit(0).cast("long").alias("tokens"), "action", F.array(target).alias("targets"), target.alias("pattern_target"), F.lit(False).alias("is_error"), F.lit(0).alias("hunks"),
    )


def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, calls and results of the sessions: clicks are user messages, views are assistant messages, each event is a call and its result."""
    e = numbered_events(spark, sf_dir).withColumns({"day": F.to_date("ts"), "target": F.concat(F.lit("f"), (F.col("k") % 6).cast("string"))})
    none, zero = F.lit(None), F.lit(0)
    view = F.col("event_type") == "view"

    def rows(phase: int, kind: str, source: DataFrame) -> DataFrame:
        said = kind == "message"
        return source.select(
            "user_id", "day", F.struct("ts", "event_id", F.lit(phase).alias("phase")).alias("at"), F.lit(kind).alias("kind"), (F.when(view, "assistant").otherwise("user") if said else none.cast("string")).alias("role"),
            F.lit("text" if said else None).cast("string").alias("text"), (F.when(view, F.expr("repeat('x', cast(k % 40 as int))")) if said else none.cast("string")).alias("thinking"), (view & (F.col("k") % 3 == 0) if said else F.lit(False)).alias("has_hidden_thinking"),
            zero.cast("long").alias("tokens"), (none.cast("string") if said else F.col("action")).alias("action"), (none.cast("array<string>") if said else F.array("target")).alias("targets"), (none.cast("string") if said else F.col("target")).alias("pattern_target"),
            (F.col("k") % 5 == 0 if kind == "result" else F.lit(False)).alias("is_error"), (F.when(F.col("event_type") == "purchase", F.col("k") % 3).otherwise(0) if kind == "result" else zero).cast("int").alias("hunks"),
        )

    return rows(0, "message", e.where("event_type in ('click', 'view')")).unionByName(rows(1, "call", e)).unionByName(rows(2, "result", e))


#: The same facts for the SQL that checks them.
S_SQL = """
e as (select event_id, ts, user_id, event_type, cast(floor(value) as bigint) as amount, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events),
ea as (select *, case event_type when 'click' then 'Read' when 'view' then 'Grep' when 'signup' then 'Bash' when 'purchase' then 'Edit' else 'Write' end as tool,
  case event_type when 'click' then 'read' when 'view' then 'search' when 'signup' then 'execute' when 'purchase' then case when k % 4 = 0 then 'rewrite' else 'mutate' end else 'test' end as action,
  k % 5 = 0 as err, k % 7 = 0 and k % 5 <> 0 as rej from e),
s0 as (select user_id, cast(ts as date) as day, case when user_id % 2 = 1 then 'codex' else 'claude' end as provider, (user_id % 4) || '.' || (user_id % 3) as version, 'm' || (user_id % 5) as model, 'p' || (user_id % 7) as project,
  's' || user_id as slug, user_id || '-' || strftime(cast(ts as date), '%Y%m%d') as session_id, min(ts) as ts, max(ts) as last_ts, count(*) as messages, count(*) filter (event_type in ('click', 'view')) as users,
  date_diff('microsecond', min(ts), max(ts)) as us, user_id % 10 = 0 as sub,
  cast(coalesce(sum(amount) filter (event_type = 'click'), 0) as bigint) as inp, cast(case when user_id % 3 = 0 then coalesce(sum(amount) filter (event_type = 'view'), 0) else 0 end as bigint) as cre,
  cast(coalesce(sum(amount) filter (event_type = 'signup'), 0) as bigint) as rd, cast(coalesce(sum(amount) filter (event_type = 'purchase'), 0) as bigint) as outp, cast(coalesce(sum(amount) filter (event_type = 'error'), 0) as bigint) as rea,
  count(*) as calls, count(*) filter (err) as errs, count(*) filter (rej) as rejs, user_id % 3 <> 2 as acts,
  count(*) filter (action = 'read') as a_read, count(*) filter (action = 'search') as a_search, count(*) filter (action = 'execute') as a_execute, count(*) filter (action = 'mutate') as a_mutate, count(*) filter (action = 'rewrite') as a_rewrite, count(*) filter (action = 'test') as a_test,
  count(*) filter (action = 'test' and err) as e_test, count(*) filter (action = 'test' and rej) as r_test,
  count(*) filter (event_type = 'error' and k % 11 = 0) as abort, count(*) filter (event_type = 'click') as started, count(*) filter (event_type = 'view') as done, count(*) filter (event_type = 'error' and k % 6 = 0) as retry,
  count(*) filter (event_type = 'error' and k % 13 = 0) as api, count(*) filter (k = 42) as compact, count(*) filter (event_type = 'signup') as blocks, count(*) filter (event_type = 'signup' and k % 2 = 0) as redacted, max(k) as thinking
  from ea group by user_id, cast(ts as date)),
S as (select *, inp + cre + rd as prompt, inp + cre + rd + outp + rea as tokens, case when cre > 0 then cre when provider = 'codex' and rd > 0 then inp else 0 end as wr, case when provider = 'codex' then 'Codex' else 'Claude' end as label from s0)
"""
T_SQL = """
c as (select conv_id, turn, role, text, role = 'user' and trim(text) <> '' as b, count(*) filter (role = 'user' and trim(text) <> '') over (partition by conv_id order by turn) as seg from conversations),
tt as (select conv_id, seg, max(case when role = 'assistant' then length(text) + length(text) % 7 end) as prompt, sum(case when role = 'assistant' then length(text) + length(text) % 7 + 10 end) as total,
  min_by(case when role = 'assistant' then length(text) % 7 end, case when role = 'assistant' then turn end) as first_read, sum(case when contains(text, 'que') then 1 else 0 end) as writes from c where seg > 0 and not b group by conv_id, seg),
tn as (select *, min(case when total is not null then seg end) over (partition by conv_id order by seg rows between current row and unbounded following) as nxt from tt),
tw as (select *, sum(writes) over (partition by conv_id, nxt) as memory from tn),
T as (select conv_id, cast(row_number() over (partition by conv_id order by seg) as integer) as position, prompt, total, first_read, memory from tw where total is not null)
"""
