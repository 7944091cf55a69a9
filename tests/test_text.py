from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracewell.functions import text


def test_texts(spark):
    now = datetime(2024, 3, 10, 12)
    rows = [(0, now, 0.5, 1.0, "up"), (45, now - timedelta(minutes=5), 1.0, 2.0, "down"), (720, now - timedelta(hours=3), float("inf"), 1.0, "flat"), (11100, now - timedelta(days=2), 0.25, 0.0, "none"), (187200, now - timedelta(days=30), 3.0, 2.0, "up"), (1, None, 1.0, 1.0, "up")]
    df = spark.createDataFrame([(s * 1_000_000, t, r, b, d) for s, t, r, b, d in rows], "us long, ts timestamp, r double, b double, d string").withColumn("now", F.lit(now))
    got = df.select(text.duration_text(F.col("us")), text.relative_text(F.col("ts"), F.col("now")), text.ratio_text(F.col("r")), text.verdict(F.col("d"))).collect()
    assert [r[0] for r in got] == ["0s", "45s", "12m", "3h 5m", "2d 4h", "1s"]
    assert [r[1] for r in got] == ["just now", "5m ago", "3h ago", "2d ago", "2024-02-09", ""]
    assert [r[2] for r in got][:3] == ["0.50x", "1.00x", "∞"] and [r[3] for r in got][:4] == ["improving", "regressing", "steady", "not enough data"]
    assert [r[0] for r in df.where("r < 9").select(text.delta_text(F.col("r"), F.col("b"))).collect()] == ["-50%", "-50%", "", "+50%", "+0%"]
    assert [r[0] for r in df.select(text.percent_text(F.lit(0.1234))).limit(1).collect()] == ["12.3%"]
    columns = text.in_columns(spark.range(10).select(F.col("id").alias("i"), (F.col("id") * 2).alias("v")), "i", "v", 4).orderBy("column").collect()
    assert [(c.column, c.first, c.value) for c in columns] == [(0, 0, 2.0), (1, 3, 7.0), (2, 5, 12.0), (3, 8, 17.0)]
