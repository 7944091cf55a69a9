"""Segments of an anchor that is too large to be gathered: ranges of windows, not a row for every window."""

from tracewell.llm.suffix_dedup import windows_apart


def test_neighbouring_windows_of_one_holder_are_one_range(spark):
    whole = bytes(i * 7 % 251 for i in range(200))
    part = whole[20:150] + b"\xfe" * 100
    rows = spark.createDataFrame([(1, 10, bytearray(whole), 1), (1, 11, bytearray(part), 2), (1, 12, bytearray(part + whole[:60]), 3)], "anchor long, key long, body binary, holder long")
    found = sorted(tuple(r) for r in windows_apart(rows, 50).select("key", "holder", "a", "z").collect())
    # windows of the first text, then its own to its end; the third has the first's again at its end
    assert found == [(10, 1, 0, 151), (11, 1, 0, 81), (11, 2, 81, 181), (12, 1, 0, 81), (12, 1, 230, 241), (12, 2, 81, 181), (12, 3, 181, 230)]
