"""The engine: logs of both providers to a store, and the store's tables to answers."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.expr import TOKENS
from tracewell.operators import activity, cache, catalogue, overview, performance, search, sequence, tools
from tracewell.operators import sessions as session_ops
from tracewell.operators.filters import Filter, choices
from tracewell.plans import splice
from tracewell.plans.affected import HEAD, affected
from tracewell.plans.timeframe import TimeRange
from tracewell.plans.transcript import blocks
from tracewell.sources import provider_a, provider_b
from tracewell.sources.jsonl import GLOB, lines, malformed
from tracewell.sources.store import Conflict, Draft, Store, bounded, changes, ensure_checkpoints, manifest

#: Tables whose rows belong to one conversation each.
SESSION_TABLES = ("sessions", "conversations", "messages", "transcripts", "turns", "sequences", "rollup", "chunks", "postings")
log = logging.getLogger(__name__)


def together(*tasks: Callable[[], Any]) -> list[Any]:
    """Results of tasks that do not need each other: planning takes most of their time, and so it overlaps."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(t)) for t in tasks]]


@dataclass
class Engine:
    """Answers over the tables of a store. ``a`` and ``b``: roots of the two providers' logs, either may be missing."""

    spark: SparkSession
    store: Store
    a: str | None = None
    b: str | None = None
    glob: str = GLOB

    def __post_init__(self) -> None:
        self.store.layouts.setdefault("postings", search.by_term)  # segments of the index stay sorted when they are merged

    def build(self) -> dict[str, int]:
        """Read all logs and write every table anew, in one commit; returns their rows."""
        ensure_checkpoints(self.spark)
        files = self._files().checkpoint()  # as they are before they are read
        draft = self.store.draft()
        rows = self._fill(draft, self._parsed())
        draft.write("files", files, key="path")
        self._checked(rows, draft)
        draft.commit(whole=True)
        return rows

    def refresh(self, fallback: bool = True) -> bool:
        """Bring all tables up to the logs; returns whether anything was done.

        Only conversations that changed files touch are made anew, from their own files. Their rows of all tables, the
        rollup and the index included, are added as segments and their earlier ones give way, in one commit: a refresh that stops leaves the store
        as it was. Without current tables, or where this fails (``fallback``), all is built.
        """
        ensure_checkpoints(self.spark)
        if any(self.store.current(name) is None for name in (*SESSION_TABLES, "files")):
            self.build()
            return True
        try:
            done = self._refresh()
        except Conflict:
            raise
        except Exception:
            if not fallback:
                raise
            log.exception("the refresh failed; all tables are built")
            self.build()
            return True
        if done:
            try:
                self.store.merge()
            except Conflict:  # another writer went on from this commit; the next refresh merges
                log.info("segments were not merged: another writer has committed")
            self.store.vacuum()
        return done

    def _refresh(self) -> bool:
        draft = self.store.draft()
        files = self._files().checkpoint()
        state = changes(files, self.store.read("files")).where("state <> 'same'").checkpoint()
        moved = state.count()
        if not moved:
            return False
        fresh = bounded(state.where("state <> 'gone'").select("path"), moved)
        parsed, records, heads = {}, {}, []

        def claude() -> None:  # whether one of its files is a session depends on what its messages hold
            parsed.update(self._parsed(fresh, ("claude",)))
            heads.append(parsed["claude"][0].select(*HEAD))

        def codex() -> None:  # the metas tell; calls and messages are made once, when the conversations are known
            records["codex"] = provider_b.records(self.spark, self.b, fresh, self.glob).checkpoint()
            heads.append(provider_b.heads(records["codex"]).select(*HEAD).checkpoint())

        first = {"claude": claude, "codex": codex}
        together(*(first[name] for name, _ in self._roots()))
        heads = reduce(DataFrame.unionByName, heads)
        bad = reduce(DataFrame.unionByName, [malformed(lines(self.spark, root, fresh, self.glob)) for _, root in self._roots()])
        keys, paths = affected(self.store.read("sessions"), heads, state, bad.checkpoint())
        paths = paths.checkpoint()
        others = paths.join(fresh, "path", "left_anti").checkpoint()  # untouched files of touched conversations
        wanted = bounded(paths.select(F.col("path").alias("file_path")), paths.count())
        others = bounded(others, others.count())

        def lone() -> None:
            if self.a and not others.isEmpty():
                more = self._parsed(others, ("claude",))["claude"]
                parsed["claude"] = tuple(x.unionByName(y) for x, y in zip(parsed["claude"], more))
            if self.a:
                parsed["claude"] = tuple(x.join(wanted, "file_path", "left_semi") for x in parsed["claude"])

        def threads() -> None:
            if self.b:
                kept = records["codex"].join(wanted, "file_path", "left_semi")
                parsed["codex"] = self._threads(kept.unionByName(provider_b.records(self.spark, self.b, others, self.glob)).checkpoint())

        together(lone, threads)
        self._checked(self._fill(draft, parsed), draft)
        draft.gone("cache_key", keys)
        draft.write("files", files.join(fresh, "path", "left_semi"), key="path")
        draft.gone("path", state.select("path"))
        draft.commit()
        return True

    def _checked(self, rows: dict[str, int], draft: Draft) -> None:
        """Numbers that must agree, from counts taken while the tables were written; a commit is stopped where they do not."""
        found = draft.read("conversations").agg(F.coalesce(F.sum("session_count"), F.lit(0)), F.coalesce(F.sum("message_count"), F.lit(0))).first()
        want = (rows["sessions"], rows["messages"])
        if tuple(found) != want:
            raise RuntimeError(f"conversations have {tuple(found)} sessions and messages, the tables {want}")

    def _roots(self) -> list[tuple[str, str]]:
        return [(name, root) for name, root in (("claude", self.a), ("codex", self.b)) if root]

    def _files(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [manifest(self.spark, root, self.glob) for _, root in self._roots()])

    def _threads(self, record: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Sessions and messages of the second provider's records, which are checkpointed."""
        call = provider_b.calls(record).checkpoint()  # sessions count them, messages hold them
        return provider_b.sessions(record, call).checkpoint(), provider_b.messages(record, call)  # the search for roots reads sessions many times

    def _parsed(self, only: DataFrame | None = None, of: tuple[str, ...] = ("claude", "codex")) -> dict[str, tuple[DataFrame, DataFrame]]:
        """Sessions, not yet grouped, and messages of each provider in ``of``, of the paths in ``only``.

        What several tables are made of is checkpointed: it is parsed once, survives its executors, and plans stay short.
        """
        def claude() -> tuple[DataFrame, DataFrame]:
            record = provider_a.records(self.spark, self.a, only, self.glob).checkpoint()
            said = provider_a.messages(record).checkpoint()
            none = F.lit(None).cast("string")
            return provider_a.sessions(record, said).withColumns({"parent": none, "agent_label": none}).checkpoint(), said

        def codex() -> tuple[DataFrame, DataFrame]:
            return self._threads(provider_b.records(self.spark, self.b, only, self.glob).checkpoint())

        read = {name: {"claude": claude, "codex": codex}[name] for name, _ in self._roots() if name in of}
        return dict(zip(read, together(*read.values())))

    def _fill(self, store: Draft, parsed: dict[str, tuple[DataFrame, DataFrame]]) -> dict[str, int]:
        """Write the tables of parsed logs to ``store``; each is read back for the next."""
        made = [{"claude": provider_a, "codex": provider_b}[name].grouped(session) for name, (session, _) in parsed.items()]
        fields = sorted({f for df in made for f in df.schema["performance"].dataType.names})
        even = [df.withColumn("performance", F.struct(*(F.col(f"performance.{f}").alias(f) for f in fields))) for df in made]
        found, message = reduce(DataFrame.unionByName, even), reduce(DataFrame.unionByName, [m for _, m in parsed.values()])
        rows = {"sessions": store.write("sessions", found)}
        sessions = store.read("sessions")
        owner = bounded(sessions.select("file_path", "cache_key", F.col("ordinal").alias("session_ordinal"), "provider", "version", "model", "project", "is_subagent", F.col("ts").alias("session_ts")), rows["sessions"])
        rows["messages"] = store.write("messages", message.drop("is_subagent").join(owner, "file_path"))
        messages = store.read("messages")

        def conversations() -> None:
            plans = sessions.groupBy("cache_key").agg(F.sum("plan_count").alias("plan_count"), F.count("*").alias("session_count"))
            said = messages.groupBy("cache_key").agg(F.count("*").alias("message_count"))
            listed = catalogue.rolled_up(sessions).join(plans, "cache_key").join(said, "cache_key", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))
            rows["conversations"] = store.write("conversations", listed)

        def turns() -> None:
            writes = F.aggregate("tool_calls", F.lit(0).cast("long"), lambda n, c: n + session_ops.memory_writes(c["action"]["targets"], c["action"]["type"]))
            built = session_ops.build_turns(messages.where("not is_subagent").withColumn("memory_writes", writes), "file_path")
            rows["turns"] = store.write("turns", built.join(owner.withColumnRenamed("session_ts", "ts"), "file_path"))

        def sequences() -> None:
            tokens = messages.withColumn("tokens", sum(F.col(c) for c in TOKENS))
            behaviour = sequence.collect(sequence.events_of(tokens, "file_path"), "file_path")
            rows["sequences"] = store.write("sequences", behaviour.join(owner.withColumnRenamed("session_ts", "ts"), "file_path"))

        def rollup() -> None:
            rows["rollup"] = store.write("rollup", self._rollup(store))

        def index() -> None:
            rows["transcripts"] = store.write("transcripts", splice.spliced(messages, sessions))
            texts = search.message_texts(store.read("transcripts").withColumn("ordinal", F.col("place")), "cache_key")
            rows["chunks"] = store.write("chunks", search.chunks(texts, "cache_key"))
            rows["postings"] = store.write("postings", search.by_term(search.postings(store.read("chunks"), "cache_key")))

        together(index, conversations, turns, sequences, rollup)
        return rows

    def _rollup(self, store: Draft) -> DataFrame:
        """Minutes of each conversation: what a refresh takes away and adds is a matter of keys, and sums are taken when it is read."""
        spent = store.read("messages").select("cache_key", "provider", "version", "model", "project", "ts", "session_ts", *TOKENS)
        return activity.minute_rollup(store.read("sessions"), spent, "cache_key")

    def drift(self) -> DataFrame:
        """Unknown kinds and fields in the logs."""
        found = [provider.drift(lines(self.spark, root, glob=self.glob).where("is_object")) for provider, root in ((provider_a, self.a), (provider_b, self.b)) if root]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def malformed(self) -> DataFrame:
        found = [malformed(lines(self.spark, root, glob=self.glob)).select(F.lit(name).alias("provider"), F.col("file_path").alias("value")) for name, root in (("claude", self.a), ("codex", self.b)) if root]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def owners(self, *columns: str) -> DataFrame:
        """Some columns of the sessions, for what is joined to them."""
        return bounded(self.table("sessions").select(*columns), self.store.current("sessions")[1])

    def conversations(self, chosen: Filter = Filter()) -> DataFrame:
        """The catalogue, latest first."""
        return chosen.apply(self.table("conversations"), self.table("sessions")).orderBy(F.desc("last_ts"), "cache_key")

    def choices(self) -> DataFrame:
        return choices(self.table("conversations"), self.table("sessions"))

    def transcript(self, cache_key: str, **options: bool) -> DataFrame:
        mine = self.table("transcripts").where(F.col("cache_key") == cache_key).withColumn("ordinal", F.col("place"))
        return blocks(mine, **options).orderBy("ordinal")

    def search(self, query: str, chosen: Filter = Filter()) -> DataFrame:
        """Conversations that hold the query, with previews; all of them for an empty one."""
        catalogue_rows = chosen.apply(self.table("conversations"), self.table("sessions"))
        if not search.query_terms(query):
            return catalogue_rows.select("cache_key", "last_ts").orderBy(F.desc("last_ts"), "cache_key")
        hits = search.matching_chunks(self.table("postings"), query, "cache_key")
        return search.ranked(hits, self.table("chunks"), catalogue_rows, query, "cache_key")

    def snapshot(self, within: TimeRange = TimeRange(), chosen: Filter = Filter()) -> dict[str, DataFrame]:
        """All statistics of a range, one DataFrame for each."""
        record = self.store.head()  # all statistics are of one commit
        table = lambda name: self.store.read(name, record)
        keep = chosen.apply(table("conversations"), table("sessions")).select("cache_key")
        sessions = table("sessions").join(keep, "cache_key", "left_semi")
        minutes = table("rollup").join(keep, "cache_key", "left_semi") if any(d.active for d in chosen.dimensions.values()) else table("rollup")
        days = activity.daily_from_rollup(minutes, within)
        out = {
            "overview": overview.totals(sessions, within), "tokens_by_model": overview.tokens_by(sessions, "model", within), "tokens_by_project": overview.tokens_by(sessions, "project", within),
            "tokens_by_version": overview.tokens_by_provider_version(sessions, within), "top_sessions": overview.top_sessions(sessions, within=within), "trend": overview.token_trend_from_rollup(minutes, within),
            "daily": days, "streaks": activity.streaks(days), "heatmap": activity.heatmap(sessions, within), "sessions": session_ops.stats(sessions, within), "durations": session_ops.duration_histogram(sessions, within),
            "messages": session_ops.message_histogram(sessions, within), "tools": tools.totals(sessions, within), "top_tools": tools.top_tools(sessions, within), "tool_errors": tools.rates(sessions, "errors", within),
            "tool_rejects": tools.rates(sessions, "rejects", within), "cache": cache.totals(sessions, within), "cache_segments": cache.segments(sessions, within), "cache_daily": cache.daily(sessions, within), "cache_durations": cache.by_duration(sessions, within),
            "scope": performance.scope(sessions, within),
        }
        sequences = None
        if "turns" in record["tables"]:
            turns = table("turns").join(keep, "cache_key", "left_semi")
            out |= {"turns": session_ops.turns_by_position(turns, within), "first_turns": cache.first_turn_cold(turns, within)}
            sequences = None if chosen.drops_sequences else table("sequences").join(keep, "cache_key", "left_semi")
        out["scorecard"] = performance.scorecard(sessions, sequences, within, diagnostics=True)
        return out
