"""Streams whose state falls: several files, read one after the other."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import streams as S

DAY = dt.timedelta(days=1)
FIRST = dt.datetime(2024, 1, 1)


def stream_of(spark, tmp_path, batches, schema):
    """A file for each batch, in the order of their names."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in/b=*")
    return files.select(*(f.split(" ")[0] for f in schema.split(", ")))


def test_quotes_go_stale_and_leave_no_state(spark, tmp_path):
    schema = "ts timestamp, symbol string, value double"
    at = lambda d, s, v: (FIRST + d * DAY, s, v)
    batches = [[at(0, "A", 1.0), at(1, "A", 2.0), at(0, "B", 5.0)], [at(40, "A", 3.0), at(40, "A", 4.0)], [at(90, "C", 9.0)]]
    events, close = S.closable(stream_of(spark, tmp_path, batches, schema), "ts")
    sizes = []
    out = S.drained(S.stream_latest_quote(events, "symbol", "ts", "value", stale="5 days", late="2 days"), "quotes", close, sizes)
    got = sorted((r.symbol, (r.quoted_at - FIRST).days, r.quote) for r in out.collect())
    assert got == [("A", 1, 2.0), ("A", 40, 4.0), ("B", 0, 5.0), ("C", 90, 9.0)]
    assert sizes[0] == 1 and sizes[1] <= 1, "only C is live after the first run, and the mark after the second"


def test_merge_reads_no_earlier_batch_and_forgets_days(spark, tmp_path):
    schema = "ts timestamp, user long"
    batches = [[(FIRST + d * DAY, u) for u in range(20)] for d in range(0, 100, 10)]
    batches.append([(FIRST + 90 * DAY, u) for u in range(25)])  # repeats, and five that are new
    batches.append([(FIRST, 7)])  # late
    sizes = []
    out = S.drained(S.stream_merge(stream_of(spark, tmp_path, batches, schema), ["user"], "ts", late="15 days"), "merge", sizes=sizes)
    assert out.count() == 205 and sizes[0] <= 60, "keys of days before the watermark are gone"


def test_windows_are_written_when_they_are_over(spark, tmp_path):
    schema = "ts timestamp, user long, source string"
    batches = [[(FIRST + d * DAY, u % 5, "s") for u in range(10)] for d in range(30)]
    for build, rows in ((lambda e: S.stream_daily_counts(e, "source", "ts", F.col("user") > 2, late="3 days"), 30), (lambda e: S.stream_distinct_buyers(e, "source", "user", "ts", days=2, late="3 days"), 31), (lambda e: S.stream_activity_sessions(e, "user", "ts", late="3 days"), 150)):
        folder, sizes = tmp_path / str(rows), []
        events, close = S.closable(stream_of(spark, folder, batches, schema), "ts")
        out = build(events)
        assert S.drained(out, "windows", close, sizes).count() == rows
        assert sizes[0] < rows / 3 and sizes[1] <= 2, "state falls as windows end"
