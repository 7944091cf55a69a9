"""Boundary cases of the operators on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.functions import expr
from tracewell.operators import activity, cache, catalogue, filters, overview, performance, search, sequence, tools
from tracewell.operators import sessions as session_ops
from tracewell.plans.queries import QUERIES
from tracewell.plans.timeframe import TimeRange, last_days
from tracewell.sources.store import changes
from tracewell.streaming.refresh import stream_rollup

T0 = datetime(2024, 3, 4, 12)
SESSION = (
    "session_id string, provider string, version string, model string, project string, slug string, ts timestamp, last_ts timestamp, message_count long, main_message_count long, user_message_count long, assistant_message_count long,"
    "input_tokens long, cache_creation_tokens long, cache_read_tokens long, output_tokens long, reasoning_output_tokens long, tool_counts map<string,bigint>, tool_error_counts map<string,bigint>, tool_reject_counts map<string,bigint>,"
    "action_counts map<string,bigint>, action_error_counts map<string,bigint>, action_reject_counts map<string,bigint>, is_subagent boolean"
)


def facts(spark, *rows):
    base = dict(session_id="s", provider="claude", version="1.0", model="m", project="p", slug="g", ts=T0, last_ts=T0, message_count=5, main_message_count=5, user_message_count=2, assistant_message_count=3,
                input_tokens=0, cache_creation_tokens=0, cache_read_tokens=0, output_tokens=0, reasoning_output_tokens=0, tool_counts={}, tool_error_counts={}, tool_reject_counts={}, action_counts={}, action_error_counts={}, action_reject_counts={}, is_subagent=False)
    names = [c.strip().split(" ")[0] for c in SESSION.replace("<string,", "<string;").split(",")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], SESSION)


def test_ranges_open_on_one_side(spark):
    df = facts(spark, {}, {"ts": T0 + timedelta(days=1)})
    late = TimeRange(start=T0 + timedelta(hours=1))
    assert df.where(late.contains("ts")).count() == 1 and df.where(late.contains("ts", strict=True)).count() == 0
    assert last_days(7, T0.date()).days() == (datetime(2024, 2, 27).date(), T0.date())
    assert TimeRange(T0, T0 + timedelta(days=2)).previous() == TimeRange(T0 - timedelta(days=2), T0)


def test_empty_inputs(spark):
    none = facts(spark, {}).limit(0)
    assert overview.totals(none).first().sessions == 0 and overview.tokens_by(none, "model").count() == 0
    assert activity.daily(none).count() == 0 and activity.heatmap(none).agg(F.sum("n")).first()[0] == 0
    assert session_ops.stats(none).first().avg_messages == 0 and session_ops.duration_histogram(none).count() == 6
    assert cache.totals(none).first().reuse_ratio == 0 and cache.segments(none).count() == 2 and tools.totals(none).first().avg_calls == 0
    assert performance.scorecard(none.withColumn("performance", F.expr("cast(null as struct<abort_count:bigint,task_started_count:bigint,task_complete_count:bigint,retry_attempt_count:bigint,api_error_counts:map<string,bigint>,reasoning_redaction_count:bigint,reasoning_block_count:bigint,max_thinking_tokens:bigint,compaction_count:bigint,micro_compaction_count:bigint,context_compacted_count:bigint>)")), None, TimeRange()).count() == 0


def test_histogram_edges(spark):
    minutes = [0, 4.99, 5, 15, 30, 60, 120]
    df = facts(spark, *({"last_ts": T0 + timedelta(minutes=m), "main_message_count": c} for m, c in zip(minutes, [0, 5, 6, 15, 30, 60, 61])))
    assert [r.n for r in session_ops.duration_histogram(df).orderBy("bucket").collect()] == [2, 1, 1, 1, 1, 1]
    assert [r.n for r in session_ops.message_histogram(df).orderBy("bucket").collect()] == [2, 2, 1, 1, 1]


def test_abandoned_and_trend(spark):
    df = facts(spark, {"main_message_count": 3, "last_ts": T0 + timedelta(minutes=1)}, {"main_message_count": 2, "last_ts": T0 + timedelta(minutes=9)}, {"input_tokens": 100, "ts": T0 - timedelta(days=1)})
    assert df.where(expr.is_abandoned()).count() == 1
    day = TimeRange(T0, T0 + timedelta(days=1))
    assert tuple(overview.token_trend(df, day).first()) == ("down", -100)
    assert tuple(overview.token_trend(df, TimeRange()).first()) == ("none", 0)
    assert tuple(overview.token_trend(df.where("input_tokens = 0"), day).first()) == ("none", 0)


def test_cache_write_and_infinite_reuse(spark):
    df = facts(spark, {"provider": "codex", "input_tokens": 7, "cache_read_tokens": 9}, {"provider": "claude", "input_tokens": 7, "cache_read_tokens": 9}, {"cache_creation_tokens": 4})
    assert sorted(r.write for r in cache.facts(df).collect()) == [0, 4, 7]
    assert cache.totals(df.where("provider = 'claude' and cache_read_tokens > 0")).first().reuse_ratio == float("inf")


def test_streaks(spark):
    at = lambda d: {"ts": T0 + timedelta(days=d)}
    df = facts(spark, at(0), at(1), at(2), at(4), at(6), at(7))
    window = lambda n: TimeRange(T0.replace(hour=0), T0.replace(hour=0) + timedelta(days=n))
    assert tuple(activity.streaks(activity.daily(df, window(8))).first()) == (6, 8, 3, 2)
    assert tuple(activity.streaks(activity.daily(df, window(9))).first()) == (6, 9, 3, 0)
    assert activity.heatmap(df).where("weekday = 0 and hour = 12").first().n == 2


def test_versions_and_text(spark):
    df = spark.createDataFrame([("v1.10",), ("1.2",), ("1.2.0",), ("beta",), ("unknown",)], "version string")
    assert [r.version for r in df.orderBy(expr.version_key("version"), "version").collect()] == ["1.2", "1.2.0", "v1.10", "beta", "unknown"]
    one = spark.createDataFrame([("a\r\nbé" + "x" * 50, "/a/./b/c", "C:\\d\\e")], "t string, p string, w string")
    got = one.select(expr.truncated("t", 4).alias("t"), expr.path_tail("p", 2).alias("p"), expr.path_tail("w", 1).alias("w")).first()
    assert tuple(got) == ("a b...", "b/c", "e")
    line = "abc " * 100
    chunks = spark.createDataFrame([(line.strip(),)], "t string").select(F.posexplode(expr.chunks_of(F.col("t")))).collect()
    assert len(chunks) == 4 and all(len(c.col) <= 160 for c in chunks)


MESSAGE = "s string, ordinal long, role string, text string, is_sidechain boolean, is_agent_divider boolean, input_tokens long, cache_creation_tokens long, cache_read_tokens long, output_tokens long, reasoning_output_tokens long, memory_writes long"


def test_turns(spark):
    m = lambda i, role, text="", used=0, side=False, cut=False, mem=0, read=0: ("s", i, role, text, side, cut, used, 0, read, 0, 0, mem)
    rows = [
        m(0, "assistant", "early", 9), m(1, "user", "go"), m(2, "assistant", "", 10, read=3), m(3, "assistant", "", 5), m(4, "user", "  "), m(5, "user", "no usage"), m(6, "assistant", mem=1), m(7, "user", "next"), m(8, "assistant", "", 4, mem=1),
        m(9, "assistant", "", 100, side=True), m(10, "system", "", cut=True), m(11, "assistant", "", 50), m(12, "user", "resumed", cut=True), m(13, "assistant", "", 6),
    ]
    turns = session_ops.build_turns(spark.createDataFrame(rows, MESSAGE), "s").orderBy("position").collect()
    assert [(t.prompt_tokens, t.turn_tokens, t.cache_read_tokens, t.memory_writes) for t in turns] == [(13, 18, 3, 0), (4, 4, 0, 2), (6, 6, 0, 0)]


def test_sequence(spark):
    schema = "s string, at int, kind string, role string, text string, thinking string, has_hidden_thinking boolean, tokens long, action string, targets array<string>, pattern_target string, is_error boolean, hunks int"
    call = lambda i, a, t: ("s", i, "call", None, None, None, False, None, a, [t], t, False, 0)
    said = lambda i, role, text: ("s", i, "message", role, text, "think" if role == "assistant" else "", False, 10, None, None, None, False, 0)
    done = lambda i, a, bad: ("s", i, "result", None, None, None, False, None, a, [], None, bad, 2)
    rows = [said(0, "user", "x"), said(1, "assistant", ""), call(2, "read", "f"), call(3, "read", "f"), call(4, "mutate", "f"), said(5, "user", "wrong"), call(6, "rewrite", "g"), done(7, "test", True), done(8, "test", False), said(9, "user", "thanks")]
    r = sequence.collect(spark.createDataFrame(rows, schema), "s").first()
    assert (r.mutated, r.verification_passed, r.first_pass_resolved) == (True, True, False)
    assert (r.action_count, r.loop_count, r.mutation_count, r.rewrite_count) == (4, 1, 2, 1)
    assert (r.targeted_mutations, r.blind_mutations, r.distinct_targets, r.patch_hunks) == (2, 1, 2, 4)
    assert (r.correction_followups, r.actions_before, r.tokens_before, r.user_turns_before) == (1, 2, 20, 1)
    assert (r.assistant_turns, r.visible_chars) == (1, 5)


def test_roots_and_cycles(spark, tmp_path):
    from tracewell.sources.store import ensure_checkpoints

    ensure_checkpoints(spark)
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("x", "y"), ("y", "x")], "thread string, parent string")
    assert {tuple(r) for r in catalogue.roots(df).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("x", "x"), ("y", "y")}


def test_insertion_filters_and_plans(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    parents = spark.createDataFrame([("c", 0, at(0)), ("c", 1, at(10)), ("c", 2, at(20))], "conversation string, ordinal long, ts timestamp")
    kids = spark.createDataFrame([("c", "k", at(10), 0), ("c", "k", at(10), 1), ("c", "z", None, 0), ("c", "e", at(-5), 0)], "conversation string, child string, anchor timestamp, ordinal long")
    assert [(r.child, r.ordinal) for r in catalogue.insert_children(parents, kids).orderBy("place").collect()] == [("e", 0), (None, 0), (None, 1), ("k", 0), ("k", 1), (None, 2), ("z", 0)]
    plans = spark.createDataFrame([("a", "p", 1), ("a", "p", 2), ("a", "q", 3)], "k string, file_path string, ordinal int")
    assert {r.ordinal for r in catalogue.last_plans(plans, "k").collect()} == {2, 3} and {r.ordinal for r in catalogue.first_plans(plans, "k").collect()} == {1, 3}
    conv = spark.createDataFrame([("k1", "codex", "p", "m", "", 1, 2), ("k2", "claude", "q", "m", "", 0, 1)], "cache_key string, provider string, project string, model string, git_branch string, plan_count int, part_count int")
    sess = spark.createDataFrame([("k1", "1"), ("k1", "2"), ("k2", " ")], "cache_key string, version string")
    pick = lambda **d: {r.cache_key for r in filters.Filter(d).apply(conv, sess).collect()}
    assert pick(version=filters.Dimension(("2",))) == {"k1"} and pick(version=filters.Dimension(("unknown",))) == {"k2"}
    assert pick(project=filters.Dimension(pattern="(")) == {"k1", "k2"} and pick(has_plans=filters.Dimension(flag=False)) == {"k2"}


@pytest.mark.parametrize(("query", "hits"), [("resume", {0}), ("foo/ba", {1}), ("foo ba", {1, 2}), ("bar foo", {1, 2}), ("nothing", set()), ("RÉS", {0})])
def test_search_terms(spark, query, hits):
    texts = spark.createDataFrame([(0, 0, "Résumé text"), (1, 0, "a foo_bar b"), (2, 0, "bar then foo")], "k int, position int, text string")
    post = search.postings(search.chunks(texts, "k"), "k")
    assert {r.k for r in search.matching_chunks(post, query, "k").collect()} == hits


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [(T0 + timedelta(seconds=20 * i), "click" if i % 3 else "view", float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.repartition(3).write.parquet(path)
    batch = df.groupBy(F.date_trunc("minute", "ts").alias("bucket_start"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("amount"))
    assert {tuple(r) for r in stream_rollup(spark, path, str(tmp_path / "rolled")).collect()} == {tuple(r) for r in batch.collect()}


def test_search_reads_every_language(spark, tmp_path):
    rows = [(1, "threr ing", "en"), (2, "Thrér über", "fr"), (3, "thrër ingé", None), (4, None, "de"), (5, "x\nTHRÈR", "es")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in QUERIES["search_prefix_and"](spark, str(tmp_path)).collect()) == [1, 3]
    assert sorted(map(tuple, QUERIES["search_ranked"](spark, str(tmp_path)).collect())) == [(1, 0, 3), (2, 0, 2), (3, 0, 1), (5, 1, 4)]


def test_places_over_many_blocks(spark):
    rows = [(i % 3, i * 7 - 100) for i in range(200)]
    got = {(r.first_ordinal, r.last_ts): r.place for r in search.places(spark.createDataFrame(rows, "first_ordinal long, last_ts long"), 16).collect()}
    assert got == {row: i + 1 for i, row in enumerate(sorted(rows, key=lambda x: (x[0], -x[1])))}


def test_occurrences_by_line_of_every_turn(spark, tmp_path):
    spark.createDataFrame([(1, 0, "que Que\nno\nquique"), (1, 1, "que"), (2, 0, None), (2, 1, "\n\naqueque")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["transcript_occurrences"](spark, str(tmp_path)).select("conv_id", "turn", "line", "n").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 2), (1, 0, 2, 1), (1, 1, 0, 1), (2, 1, 2, 2)]


def test_gaps_of_days_and_files(spark):
    days = facts(spark, *({"ts": T0 + timedelta(days=d)} for d in (0, 1, 2, 4, 5)))
    month = TimeRange(datetime(2024, 3, 4), datetime(2024, 3, 10))
    got = activity.streaks(activity.daily(days, month)).first().asDict()
    assert (got["active_days"], got["total_days"], got["longest_streak"], got["current_streak"]) == (5, 6, 3, 2)
    kind = "path string, length long, modified timestamp"
    now = spark.createDataFrame([("a", 1, T0), ("b", 2, T0), ("c", 1, T0)], kind)
    before = spark.createDataFrame([("b", 1, T0), ("c", 1, T0), ("d", 1, T0)], kind)
    assert {r.path: r.state for r in changes(now, before).collect()} == {"a": "new", "b": "changed", "c": "same", "d": "gone"}


def test_scores_are_weighted(spark):
    rows = [("Efficiency", "tokens_per_user_turn", 60, "down"), ("Efficiency", "reasoning_token_share", 90, "up"), ("Efficiency", "time_to_first_mutation", 100, "up"), ("Efficiency", "visible_thinking_depth", 0, "up"), ("Outcome", "patch_churn", None, "none")]
    card = spark.createDataFrame(rows, "lane string, metric string, score int, trend string")
    assert [(r.score, r.metrics, r.trend) for r in performance.combined(card).collect()] == [(60, 3, "down")]
    assert performance.combined(card.where("metric = 'time_to_first_mutation'"), "lane").collect() == []


def test_roots_of_deep_and_broken_chains(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    chain = [(i, i - 1 if i else None) for i in range(200)]
    broken = [(1000, 999), (1001, 1000), (1002, 1001), (2000, 2001), (2001, 2000), (2002, 2000)]
    got = dict(map(tuple, catalogue.roots(spark.createDataFrame(chain + broken, "thread long, parent long")).collect()))
    assert got == {i: 0 for i, _ in chain} | {i: i for i, _ in broken}
