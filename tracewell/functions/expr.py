"""Column expressions: ratios, labels, token totals, text and time helpers.

All are built-in functions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"

# Shown names of providers, phrases that tell a rejected tool use, tool categories.
PROVIDER_LABELS = {"claude": "Claude", "codex": "Codex"}
REJECTION_PHRASES = ("the user doesn't want to proceed with this tool use", "the user does not want to proceed with this tool use", "tool use was rejected", "user rejected tool use")
TOOL_CATEGORIES = {"read": ("Read", "Grep", "Glob", "ToolSearch"), "write": ("Edit", "Write", "NotebookEdit", "apply_patch"), "bash": ("Bash", "exec_command", "shell_command", "write_stdin")}
ACTION_CATEGORIES = {"read": ("read", "search"), "write": ("mutate", "rewrite"), "bash": ("execute", "test", "build")}

TOKENS = ("input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens", "reasoning_output_tokens")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, and 0 where den is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def reuse_ratio(read: Column, write: Column) -> Column:
    """read / write; infinite where something was read and nothing written."""
    return F.when(write > 0, read.cast("double") / write.cast("double")).when(read > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def label_or_unknown(c: Column | str) -> Column:
    trimmed = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(trimmed == "", F.lit(UNKNOWN)).otherwise(trimmed)


def provider_label(c: Column | str) -> Column:
    out = label_or_unknown(c)
    for name, label in PROVIDER_LABELS.items():
        out = F.when(col(c) == name, F.lit(label)).otherwise(out)
    return out


def prompt_tokens() -> Column:
    return F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")


def total_tokens() -> Column:
    return prompt_tokens() + F.col("output_tokens") + F.col("reasoning_output_tokens")


def cache_write() -> Column:
    """What was written to the cache: the creation tokens, or the input of older sessions of the second provider that read from it."""
    return F.when(F.col("cache_creation_tokens") > 0, F.col("cache_creation_tokens")).when((F.col("provider") == "codex") & (F.col("cache_read_tokens") > 0), F.col("input_tokens")).otherwise(F.lit(0).cast("long"))


def session_messages() -> Column:
    """Messages of a session: all of a subagent's, else those of the main thread."""
    return F.when(F.col("is_subagent") & (F.col("message_count") > 0), F.col("message_count")).otherwise(F.col("main_message_count"))


def duration_us(start: Column | str = "ts", end: Column | str = "last_ts") -> Column:
    return F.coalesce(F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp")), F.lit(0).cast("long"))


def weekday_index(c: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(col(c))


def local(c: Column | str, tz: str) -> Column:
    return col(c) if tz == "UTC" else F.from_utc_timestamp(col(c), tz)


def local_day(c: Column | str, tz: str = "UTC") -> Column:
    return F.to_date(local(c, tz))


def minute(c: Column | str) -> Column:
    return F.date_trunc("minute", col(c))


def map_total(c: Column | str) -> Column:
    return F.aggregate(F.map_values(F.coalesce(col(c), F.create_map().cast("map<string,bigint>"))), F.lit(0).cast("long"), lambda a, x: a + x)


def count_of(c: Column | str, *names: str) -> Column:
    """Sum of the counts of ``names`` in a map."""
    return sum((F.coalesce(F.try_element_at(col(c), F.lit(n)), F.lit(0)).cast("long") for n in names), F.lit(0).cast("long"))


def bucket(value: Column, edges: list[int], inclusive: bool) -> Column:
    """Index of the first edge that ``value`` stays below (or does not exceed); beyond the last, their number."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(value <= edges[i] if inclusive else value < edges[i], F.lit(i)).otherwise(out)
    return out


def trend_direction(delta: Column, flat: float) -> Column:
    return F.when(F.abs(delta) < flat, "flat").when(delta > 0, "up").otherwise("down")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def version_key(c: Column | str) -> Column:
    """Sort key of dotted versions of any length: numbers by value with missing ones 0, others after them by text."""
    bare = F.regexp_replace(F.trim(col(c)), "^v", "")
    numbers = F.transform(F.split(bare, r"\."), lambda p: p.try_cast("long"))
    parsed = (bare != "") & ~F.exists(numbers, lambda n: n.isNull())
    last = F.array_position(F.reverse(F.transform(numbers, lambda n: n != 0)), True)  # zeros at the end say nothing
    kept = F.slice(numbers, 1, F.when(last > 0, F.size(numbers) - last + 1).otherwise(0).cast("int"))
    return F.struct((~parsed).alias("unparsed"), F.when(parsed, kept).alias("numbers"), F.when(~parsed, col(c)).alias("label"))


def truncated(c: Column | str, n: int, one_line: bool = True) -> Column:
    """At most ``n`` bytes and an ellipsis; a character cut in two is left out."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), "\r", "")
    text = F.trim(F.regexp_replace(text, "\n", " ")) if one_line else text
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(text) > n, F.concat(F.regexp_replace(cut, "�+$", ""), F.lit("..." if one_line else "\n..."))).otherwise(text)


def path_tail(c: Column | str, n: int) -> Column:
    """The last ``n`` components of a path, whichever way its slashes lean."""
    parts = F.filter(F.split(F.translate(col(c), "\\", "/"), "/"), lambda p: ~p.isin("", "."))
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "/")


def slug_of(c: Column | str) -> Column:
    return F.substring(F.trim(col(c)), 1, 12)


def display_slug(slug: Column, first_message: Column) -> Column:
    return F.coalesce(F.nullif(slug, F.lit("")), F.nullif(truncated(first_message, 40), F.lit("")), F.lit("untitled"))


def short_count(c: Column) -> Column:
    """1,234; 123.4k; 1.2M."""
    return F.when(c >= 1_000_000, F.format_string("%.1fM", c / 1e6)).when(c >= 100_000, F.format_string("%.1fk", c / 1e3)).otherwise(F.format_number(c, 0))


def is_rejection(c: Column | str) -> Column:
    text = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return sum((F.contains(text, F.lit(p)).cast("int") for p in REJECTION_PHRASES), F.lit(0)) > 0


def is_tool_error(name: Column, status: Column, output: Column) -> Column:
    return F.coalesce(F.lower(status).isin("failed", "error"), F.lit(False)) | ((name == "apply_patch") & F.startswith(F.lower(F.trim(F.coalesce(output, F.lit("")))), F.lit("error")))


def is_memory_path(c: Column) -> Column:
    return F.rlike(c, F.lit(r"(?i)(/memory/[^/]+\.md|/MEMORY\.md)$"))


def is_abandoned() -> Column:
    return (session_messages() < 3) | (duration_us() < 60_000_000)


def is_mutated() -> Column:
    return count_of("action_counts", "mutate", "rewrite") > 0


def is_verified() -> Column:
    done = count_of("action_counts", "test", "build")
    return (done > 0) & (done > count_of("action_error_counts", "test", "build") + count_of("action_reject_counts", "test", "build"))


def category_calls(category: str) -> Column:
    """Calls of a category: by actions where the session has any, else by tool names."""
    return F.when(F.size(F.coalesce("action_counts", F.create_map().cast("map<string,bigint>"))) > 0, count_of("action_counts", *ACTION_CATEGORIES[category])).otherwise(count_of("tool_counts", *TOOL_CATEGORIES[category]))


def dimension(name: str) -> Column:
    """The key of a split: provider label, or the version, model or project, unknown where blank."""
    return provider_label("provider") if name == "provider" else label_or_unknown(name)


def lines_of(c: Column | str) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(col(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def chunks_of(line: Column, size: int = 160, step: int = 112) -> Column:
    """Pieces of ``size`` characters that begin every ``step``, until the end is reached."""
    last = F.greatest(F.ceil((F.char_length(line) - size) / F.lit(float(step))), F.lit(0)).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: F.trim(F.substring(line, i * step + 1, F.lit(size)))), lambda x: x != "")
