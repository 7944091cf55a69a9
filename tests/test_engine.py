"""Logs to store to answers, and sums that must agree between paths."""

from pyspark.sql import functions as F

from tests.test_sources import rollouts, tree  # noqa: F401  fixtures
from tracewell.operators import activity, cache, overview, tools
from tracewell.operators.filters import Dimension, Filter
from tracewell.plans.engine import Engine
from tracewell.plans.surrogate import MONTH, sessions, spent
from tracewell.sources.store import Store

DIR = "/root/testdata/sf0.001"


def test_from_logs_to_answers(spark, tree, rollouts, tmp_path):  # noqa: F811
    engine = Engine(spark, Store(spark, str(tmp_path / "store")), str(tree), str(rollouts))
    rows = engine.build()
    assert rows["sessions"] == 5 and rows["conversations"] == 3 and rows["turns"] == 1
    turn = engine.table("turns").where("provider = 'claude'").first()
    assert (turn.prompt_tokens, turn.turn_tokens, turn.cache_read_tokens) == (170, 190, 40)
    behaviour = {r.file_path.split("/")[-1]: r for r in engine.table("sequences").collect()}
    assert behaviour["one.jsonl"].action_count == 2 and not behaviour["one.jsonl"].mutated and behaviour["one.jsonl"].visible_chars == 2
    everything = engine.snapshot()
    assert everything["overview"].first().sessions == 5 and {r.name for r in everything["top_tools"].collect()} == {"Read", "Bash", "Grep", "exec_command", "apply_patch"}
    assert all(df.count() >= 0 for df in everything.values())
    assert engine.conversations(Filter({"provider": Dimension(("codex",))})).count() == 1
    found = engine.search("fix").collect()
    assert len(found) == 1 and found[0].preview == "fix it" and engine.search("").count() == 3
    text = "\n".join(r.block for r in engine.transcript(found[0].cache_key).collect())
    assert "## User\n\nfix it" in text and "- **Read** /a.py" in text and "> hm" in text
    assert {r.value for r in engine.drift().collect()} == {"novel", "mystery"} and engine.malformed().count() == 1


def test_rollup_equals_sessions_and_splits_add_up(spark):
    s = sessions(spark, DIR).persist()
    rollup = activity.minute_rollup(s, spent(spark, DIR)).persist()
    assert activity.reaggregate(rollup.unionByName(rollup)).agg(F.sum("session_count")).first()[0] == 2 * s.count()
    totals = overview.totals(s).first()
    whole = rollup.agg(F.sum("session_count"), F.sum("message_count"), F.sum("input_tokens"), F.sum("cache_read_tokens")).first()
    assert tuple(whole) == (totals.sessions, totals.messages, totals.input_tokens, totals.cache_read_tokens)
    assert overview.by_split(s, "version", MONTH).agg(F.sum("tokens")).first()[0] == totals.total_tokens
    assert tools.by_split(s, "project", MONTH).agg(F.sum("calls")).first()[0] == tools.totals(s).first().total_calls
    parts = {r.measure: r["sum(value)"] for r in cache.by_split(s, "model", MONTH).groupBy("measure").sum("value").collect()}
    whole = cache.totals(s).first()
    assert (parts["prompt"], parts["read"], parts["write"]) == (whole.prompt, whole.read, whole.write)


def test_local_days(spark):
    s = sessions(spark, DIR)
    from dataclasses import replace

    tokyo = activity.daily(s, replace(MONTH, tz="Asia/Tokyo"))
    assert tokyo.agg(F.sum("sessions")).first()[0] <= s.count() and tokyo.count() == 30
