"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text.  A
blob is scanned once for each version of the rules: pairs of blob and rule version
that the ledger has are skipped, all others are scanned and entered, and the
findings of all blobs are joined back to every path that ever held them.

Matches of a pattern are leftmost and do not overlap; those shorter than the rule's
least length are dropped after matching.  Offsets count code points, ends are
exclusive.

Defined results: a null text is an empty one and has no finding; equal texts share
one scan and each path gets its rows; repeated rows repeat in the result; columns
besides the path and the text are ignored; an empty table gives no rows and an
empty ledger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, written


@dataclass(frozen=True)
class Rule:
    """``least`` characters are asked of ``group`` (0: the whole match)."""

    kind: str
    pattern: str
    group: int
    least: int


# The patterns and lengths of the contract.
RULES = (
    Rule("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)


def rule_version(rules: tuple[Rule, ...]) -> str:
    """A name that changes with the rules, so that findings of other rules are never taken for theirs."""
    return hashlib.sha256(repr(tuple((r.kind, r.pattern, r.group, r.least) for r in rules)).encode()).hexdigest()[:16]


#: Matches that are walked from one known offset.
BLOCK = 256
#: A blob of more rows than this share of all (and than 64) is dealt out with its findings.
HOT_SHARE = 10_000

LEDGER = "blob string, rule_version string, findings array<struct<start:int,rank:int,kind:string,stop:int>>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Findings of one rule: the pieces between matches and the matches give the offsets."""
    if rule.group == 0:  # runs of one class, so shorter runs need not be met at all
        pattern = rule.pattern.replace("[0-9a-f]+", f"[0-9a-f]{{{rule.least},}}").replace("AKIA[A-Z0-9]+", f"AKIA[A-Z0-9]{{{rule.least - 4},}}")
    else:
        pattern = rule.pattern
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("n")))
    steps = F.zip_with(steps, part, lambda s, p: F.struct(s["gap"].alias("gap"), s["n"].alias("n"), (F.char_length(p) >= rule.least).alias("holds")))
    none = F.lit([]).cast("array<struct<start:int,rank:int,kind:string,stop:int>>")

    def walked(block: Column, start: Column) -> Column:
        found = lambda acc, s: F.struct((acc["at"] + s["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (acc["at"] + s["gap"] + s["n"]).alias("stop"))
        return F.aggregate(
            block,
            F.struct(start.alias("at"), none.alias("found")),
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + s["n"]).alias("at"),
                F.when(s["holds"], F.concat(acc["found"], F.array(found(acc, s)))).otherwise(acc["found"]).alias("found"),
            ),
            lambda acc: acc["found"],
        )

    # Appending copies an array, so that matches are walked in blocks, each from the sum of those before it.
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda k: F.slice(s, k * BLOCK + 1, F.lit(BLOCK)))
    length = lambda block: F.aggregate(block, F.lit(0), lambda acc, s: acc + s["gap"] + s["n"])
    starts = lambda blocks: F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<int>").alias("starts")),
        lambda acc, block: F.struct((acc["at"] + length(block)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
        lambda acc: acc["starts"],
    )
    found = _with(steps, lambda s: _with(cut(s), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), walked))))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def findings(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All findings of ``text``, by start, then rule."""
    return F.array_sort(F.concat(*(_spans(text, r, i) for i, r in enumerate(rules))))


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger kept under ``path``; an empty one where none was begun."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, ledger_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan the blobs of ``versions`` (every version of every path is a row) that the ledger lacks under these rules.

    Returns a row for each version (path, blob, findings) and the ledger, which stays under
    ``ledger_path`` for later calls (a new folder in the shared one by default). What is new is
    appended in one commit; two writers at once may enter a blob twice, which does no harm.
    """
    spark, version = versions.sparkSession, rule_version(rules)
    ledger_path = ledger_path or fresh_path(spark, "ledger")
    body = F.coalesce(F.col(text), F.lit(""))
    paths = written(versions.select(F.col(path), hex_of(body).alias("blob")), "paths")
    blobs = versions.select(hex_of(body).alias("blob"), body.alias("_body"))
    known = open_ledger(spark, ledger_path).where(F.col("rule_version") == version)
    if not known.isEmpty():
        blobs = blobs.join(known.select("blob"), "blob", "left_anti")
    blobs = blobs.groupBy("blob").agg(F.first("_body").alias("_body"))
    entered = blobs.select("blob", F.lit(version).alias("rule_version"), findings(F.col("_body"), rules).alias("findings"))
    entered.write.mode("append").parquet(ledger_path)
    ledger = spark.read.schema(LEDGER).parquet(ledger_path)
    hits = ledger.where((F.col("rule_version") == version) & (F.size("findings") > 0)).groupBy("blob").agg(F.first("findings").alias("findings"))
    none = F.lit([]).cast(hits.schema["findings"].dataType)
    return _join_back(paths, hits).select(path, "blob", F.coalesce("findings", none).alias("findings")), ledger


def _join_back(paths: DataFrame, hits: DataFrame) -> DataFrame:
    """``paths`` with the findings of their blobs, if any. Rows of a blob that many have are dealt out, and each part meets a copy of the findings.

    Names of such blobs are at most ``HOT_SHARE``, so they are broadcast; findings, of any size, are not.
    """
    share = max(64, paths.count() // HOT_SHARE)
    hot = paths.groupBy("blob").count().where(F.col("count") > share).select("blob", F.ceil(F.col("count") / share).cast("int").alias("_parts"))
    dealt = paths.join(F.broadcast(hot), "blob", "left").withColumn("_part", F.coalesce(F.pmod(F.monotonically_increasing_id(), "_parts"), F.lit(0)).cast("int")).drop("_parts")
    copies = hits.join(F.broadcast(hot), "blob", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies.hint("merge"), ["blob", "_part"], "left")


def hex_of(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def spans_text(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """The digest columns for each row of ``docs``. Without ``ledger_path`` every blob is new and is scanned."""
    found, _ = scan(docs, ledger_path=ledger_path)
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in RULES), F.sha2(spans_text(F.col("findings")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("findings")).alias("spans"))
