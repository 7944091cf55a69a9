"""Helpers shared by the corpus operators: shared folders, written tables, id prefixes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the contracts: space, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the checkpoint folder set in the context.

    On one machine (master ``local``) where neither is set, a temporary folder is made once for each
    application and set as the checkpoint folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    given = spark.sparkContext.getCheckpointDir()
    if base or given:
        return (base or given).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tracewell-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{_own[app]}")
    return f"file://{_own[app]}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that outlive executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that very long texts or blobs cannot fill a worker; one bound for all operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def bounded_broadcast(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """Hint a broadcast only when the counted rows stay within ``most``; else leave the join to a shuffle."""
    return F.broadcast(df) if rows <= most else df


def join_totals(rows: DataFrame, totals: DataFrame, key: str | list[str], n_rows: int, most: int = 10_000) -> DataFrame:
    """``rows`` with the one row of ``totals`` of their key, which has how many rows that is (column ``n_of_key``).

    Keys of more than ``n_rows / most`` rows are at most ``most``, so they are broadcast and their rows
    stay where they are; all others are shuffled, and none of them can fill a task.
    """
    share = max(64, n_rows // most)
    hot = F.broadcast(totals.where(F.col("n_of_key") > share))
    rest = rows.join(hot.select(key), key, "left_anti").join(totals.where(F.col("n_of_key") <= share).hint("merge"), key)
    return rows.join(hot, key).unionByName(rest).drop("n_of_key")


def running_start(counts: DataFrame, key: str, amount: str, out: str, block: int = 4096) -> DataFrame:
    """Exclusive running sum of ``amount`` in order of the long ``key`` (0, 1, 2, ...), in two levels.

    Keys are summed by blocks first, so the one unpartitioned window sees only a row for each block.
    """
    blocked = counts.withColumn("_block", F.expr(f"{key} div {block}"))
    per_block = blocked.groupBy("_block").agg(F.sum(amount).alias("_sum"))
    before = per_block.select("_block", F.expr("coalesce(sum(_sum) over (order by _block rows between unbounded preceding and 1 preceding), 0)").alias("_before"))
    return (
        blocked.join(before, "_block")
        .withColumn(out, F.expr(f"_before + coalesce(sum({amount}) over (partition by _block order by {key} rows between unbounded preceding and 1 preceding), 0)").cast("long"))
        .drop("_block", "_before")
    )

