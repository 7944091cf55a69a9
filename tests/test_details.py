"""Display texts, lookups, shell targets, error codes, plans and versions, with values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions.expr import version_key
from tracewell.operators import catalogue, display, filters, performance
from tracewell.plans.timeframe import TimeRange
from tracewell.sources import actions, provider_a, provider_b


@pytest.mark.parametrize(
    "command, kind, targets",
    [
        ('rg "foo" internal/a.go', "search", [("pattern", "foo"), ("file_path", "internal/a.go")]),
        ("find src lib -name '*.go' -type f -path x/y", "search", [("pattern", "*.go"), ("pattern", "x/y"), ("file_path", "src"), ("file_path", "lib")]),
        ("sed -n 1,20p x.go 'docs/a b' ./x.go x.go", "read", [("file_path", "x.go"), ("file_path", "docs/a"), ("file_path", "./x.go")]),
        ("bash -lc 'cat README.md KEY=/tmp/x'", "read", [("file_path", "README.md")]),
        ("go test ./...", "test", [("command", "go test ./...")]),
    ],
)
def test_shell_targets_of_the_second_provider(spark, command, kind, targets):
    got = spark.range(1).select(actions.classify(F.lit("exec_command"), F.lit(json.dumps({"cmd": command})), by_path=True).alias("a")).first().a
    assert (got.type, [(t.type, t.value) for t in got.targets]) == (kind, targets)


def test_names(spark):
    row = spark.range(1).select(
        F.array(*(actions.tool_name(F.lit(n)) for n in ("read", "BASH", "notebookedit", "mcp__X"))).alias("names"),
    ).first()
    assert row.names == ["Read", "Bash", "NotebookEdit", "mcp__X"]


def test_error_codes(spark):
    raws = [None, "", "overloaded", '{"type":"rate_limit"}', '{"error":"bad"}', '{"status":529}', '{"error":{"x":1}}', "12", "[1]"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raws], "e string").select(provider_a.error_code(F.col("e"))).collect()]
    assert got == ["", "", "overloaded", "rate_limit", "bad", "status_529", "api_error", "api_error", "api_error"]


def test_display(spark):
    row = spark.createDataFrame([("2.1", "m", 5, 3, 12_000, 0, 0, 500, 0)], "version string, model string, total_message_count long, main_message_count long, input_tokens long, cache_creation_tokens long, cache_read_tokens long, output_tokens long, reasoning_output_tokens long")
    got = row.select(
        display.description(F.lit(0), F.create_map(F.lit("Read"), F.lit(2)), F.lit("tail")).alias("d"),
        display.title(F.lit("app"), F.lit("fix"), F.lit("2024-01-02"), F.lit("2d ago"), F.lit(True), F.lit("main"), F.lit(2)).alias("t"),
        display.title(F.lit("app"), F.lit("fix"), F.lit("2024-01-02"), F.lit(""), F.lit(False), F.lit(""), F.lit(1)).alias("plain"),
        F.array(display.display_name(F.lit(""), F.lit("untitled"), F.lit("hello")), display.display_name(F.lit("n"), F.lit("s"), F.lit("")), display.display_name(F.lit(None), F.lit(""), F.lit(""))).alias("names"),
        display.plan_text(F.lit("/a/b/p.md"), F.lit("do")).alias("p"), display.match_indices(F.lit("Aab xa.b a.ba"), F.lit("AB a.b")).alias("i"), display.match_indices(F.lit("abc"), F.lit("zz, ")).alias("none"),
    ).first()
    assert got.d == "2.1  m  5 msgs (3 main)  12k tokens  Read:2\ntail"
    assert (got.t, got.plain) == ("[sub] app / fix  2024-01-02 (2d ago)  main  (2 parts)", "app / fix  2024-01-02")
    assert got.names == ["hello", "n", "untitled"] and got.p == "Plan: p.md\n\ndo"
    assert got.i == [0, 1, 2, 5, 7, 9, 11, 12] and got.none == []


def test_lookups_and_raw_text(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("one")
    (tmp_path / "b.jsonl").write_text("two\n")
    rows = [("claude", f"file:{tmp_path}/a.jsonl", "s1", "k1", 0), ("claude", f"file:{tmp_path}/b.jsonl", "s2", "k1", 1), ("codex", "x", "s1", "k2", 0)]
    sessions = spark.createDataFrame(rows, "provider string, file_path string, session_id string, cache_key string, ordinal int")
    wanted = spark.createDataFrame([("claude", "session_id", "s1"), ("claude", "cache_key", "k1"), ("codex", "file_path", "none")], "provider string, kind string, value string")
    assert sorted(r.session_id for r in catalogue.by_lookup(sessions, wanted).collect()) == ["s1", "s2"]
    files = sessions.where("provider = 'claude'").withColumn("file_path", F.regexp_replace("file_path", "^file:/+", "file:///"))
    assert [tuple(r) for r in display.raw_text(files).collect()] == [("k1", "one\ntwo\n")]


def test_versions_of_any_length(spark):
    names = ["1.2.3.4.5.6.7.8.9.10", "1.2.3.4.5.6.7.8.9.9", "1.2", "v1.2.0.0", "1.10", "x", "0"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "v string").orderBy(version_key("v"), "v").collect()]
    assert got == ["0", "1.2", "v1.2.0.0", "1.2.3.4.5.6.7.8.9.9", "1.2.3.4.5.6.7.8.9.10", "1.10", "x"]


def test_blank_parents_are_filled(spark):
    conversations = spark.createDataFrame([("k", "claude", "work/app"), ("l", "codex", "other")], "cache_key string, provider string, project string")
    sessions = spark.createDataFrame([("k", " ", "", 1), ("k", "codex", "own", 2), ("m", "", "", 3)], "cache_key string, provider string, project string, n int")
    assert sorted(catalogue.flatten(conversations, sessions).select("n", "provider", "project").collect()) == [(1, "claude", "work/app"), (2, "codex", "own")]
    keys = spark.createDataFrame([("d", "s", "p", False), ("d", " ", "p", False), ("d", "s", "p", True)], "d string, s string, p string, sub boolean")
    assert [r[0] for r in keys.select(catalogue.group_key(F.col("d"), F.col("s"), F.col("p"), F.col("sub"))).collect()] == ["group:d:s", "path:p", "path:p"]
    assert [r[0] for r in keys.limit(1).select(catalogue.cache_key(F.lit(" "), F.lit("x"))).collect()] == ["x"]


def test_patterns_of_the_jvm(spark):
    assert filters.is_pattern("a+b") and filters.is_pattern(r"\p{L}++") and not filters.is_pattern("(")
    assert not filters.is_pattern("(?P<n>a)")  # Python's alone


def test_performance_maps_and_plans(spark, tmp_path):
    at = lambda s: f"2024-05-01T10:00:{s:02}Z"
    a = [
        {"type": "user", "sessionId": "s", "timestamp": at(0), "message": {"role": "user", "content": "hi"}},
        {"type": "assistant", "timestamp": at(1), "message": {"role": "assistant", "model": "m", "stop_reason": "end_turn", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "1", "name": "read", "input": {"file_path": "/x"}}], "usage": {"service_tier": "standard", "speed": "fast", "server_tool_use": {"web_search_requests": 2, "none": 0}}}},
        {"type": "system", "timestamp": at(2), "subtype": "api_error", "error": {"type": "overloaded"}, "durationMs": 30, "retryInMs": 1.5},
        {"type": "system", "timestamp": at(3), "subtype": "api_error", "error": {"status": 500}},
    ]
    item = lambda s, kind, **payload: {"timestamp": at(s), "type": kind, "payload": payload}
    b = [
        item(0, "session_meta", id="t1", cwd="/w/old"), item(1, "turn_context", cwd="/w/new", model="g", effort="high"), item(2, "turn_context", cwd="", effort="low"), item(3, "turn_context", effort="high"),
        item(4, "event_msg", type="user_message", message="go"), item(5, "response_item", type="reasoning", summary="thinking aloud", encrypted_content="x"),
        item(6, "response_item", type="message", role="assistant", phase="final", content=[{"type": "output_text", "text": "done"}]),
        item(7, "event_msg", type="item_completed", item={"type": "Plan", "id": "roadmap", "text": " step "}), item(8, "event_msg", type="task_complete", last_agent_message="bye"),
        item(9, "event_msg", type="token_count", info={"model_context_window": 9000, "last_token_usage": None}, rate_limits={"p": 1}),
    ]
    for name, rows in (("a", a), ("b", b)):
        (tmp_path / name / "p").mkdir(parents=True)
        (tmp_path / name / "p/f.jsonl").write_text("\n".join(map(json.dumps, rows)))
    record = provider_a.records(spark, str(tmp_path / "a"))
    first = provider_a.grouped(provider_a.sessions(record, provider_a.messages(record).persist())).persist()
    p = first.first().performance
    assert p.api_error_counts == {"overloaded": 1, "status_500": 1} and p.stop_reason_counts == {"end_turn": 1}
    assert p.service_tier_counts == {"standard": 1} and p.speed_counts == {"fast": 1} and p.server_tool_use_counts == {"web_search_requests": 2} and (p.duration_ms, p.max_retry_delay_ms) == (30, 1.5)
    assert first.first().tool_counts == {"Read": 1}
    record = provider_b.records(spark, str(tmp_path / "b"))
    row = provider_b.sessions(record).first()
    assert row.cwd == "/w/new" and row.performance.effort_counts == {"high": 2, "low": 1} and row.performance.phase_counts == {"final": 1} and row.plan_count == 1
    assert (row.performance.context_window, row.performance.rate_limit_count, row.performance.reasoning_redaction_count) == (9000, 1, 0)
    said = {r.text: r for r in provider_b.messages(record).collect()}
    assert said["done"].thinking == "thinking aloud" and [tuple(x) for x in said["done"].plans] == [("roadmap.md", "step")] and said["bye"].role == "assistant"
    top = performance.top_diagnostics(first, TimeRange()).collect()
    assert top == [] or {(r.diagnostic, r.name) for r in top} == {("stop_reason", "end_turn"), ("server_tool_use", "web_search_requests")}
    assert [tuple(r) for r in performance.top_counts(first, "stop_reason_counts", TimeRange()).collect()] == [("end_turn", 1)]
