"""Structured Streaming forms of the window, merge and session operators; each works on a stream and on a table alike."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.consensus import resolve_tickers


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by ``spark.checkpoint.dir``, which the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*events*").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def closable(events: DataFrame, at: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream together with one of marks, and a function that writes a mark of ten years later than all rows: from then on every window is over.

    A mark has nulls in all other columns. It comes by a folder of its own, so that the stream's sources need not be written to.
    """
    spark, folder = events.sparkSession, shared_path(events.sparkSession, "marks")
    spark.createDataFrame([], events.schema).write.parquet(folder)

    def close() -> None:
        mark = spark.range(1).select(*((F.timestamp_seconds(F.lit(4102444800)) if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema))
        mark.coalesce(1).write.mode("append").parquet(folder)

    return events.union(spark.readStream.schema(events.schema).parquet(folder)), close


def drained(stream: DataFrame, name: str, close: Callable[[], None] | None = None, sizes: list[int] | None = None) -> DataFrame:
    """Run a stream over what there is and give back the rows it wrote. With ``close`` it is started again after the mark, from its checkpoint, and writes
    what was still open. ``sizes`` gets the state rows after each run.

    Rows are only appended, by the file sink and its log, so a batch that runs again replaces nothing and repeats nothing.
    """
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")

    def run() -> None:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        if sizes is not None:
            told = [p for p in query.recentProgress if p["stateOperators"]]
            sizes.append(sum(o["numRowsTotal"] for o in told[-1]["stateOperators"]) if told else 0)

    run()
    if close is not None:
        close()
        run()
    return spark.read.schema(stream.schema).parquet(out)


def stream_dedupe_filings(events: DataFrame, identity: Sequence[str], at: str, late: str = "60 days") -> DataFrame:
    """ST1: the first row of each identity; a repeat within the watermark is dropped."""
    if not events.isStreaming:
        return events.dropDuplicates(list(identity))
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(identity))


def stream_distinct_buyers(events: DataFrame, symbol: str, buyer: str, at: str, days: int = 28, slide: int = 1, late: str = "60 days") -> DataFrame:
    """ST2: distinct buyers per symbol in each sliding window of disclosure days."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    per = timed.groupBy(F.window(at, f"{days} days", f"{slide} day").alias("w"), F.col(symbol).alias("symbol")).agg(F.size(F.collect_set(buyer)).alias("buyers"))
    return per.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "symbol", "buyers")


def stream_daily_counts(events: DataFrame, source: str, at: str, hit, late: str = "60 days") -> DataFrame:
    """ST3: rows per day and source, and those that meet a condition."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    per = timed.groupBy(F.window(at, "1 day").alias("w"), F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("hits"))
    return per.select(F.col("w.start").cast("date").alias("day"), "source", "rows", "hits")


def stream_latest_quote(events: DataFrame, symbol: str, at: str, value: str, stale: str = "5 days", late: str = "60 days") -> DataFrame:
    """ST4: each symbol's newest quote (of several at once the largest), told when it has gone stale: a later one came after more than ``stale``, or none.

    A symbol's state is its newest quote. A timer on event time takes it away once the watermark is past it; so a symbol
    that is not quoted any more leaves nothing behind. Quotes older than the held one change nothing.
    """
    most = pd.Timedelta(stale)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told = []
        at_, quote = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            told.append((key[0], at_, quote))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["at", "quote"])
            for now, q in zip([t.to_pydatetime() for t in rows["at"]], rows["quote"], strict=True):
                if at_ is not None and now - at_ > most:
                    told.append((key[0], at_, quote))
                if at_ is None or (now, q) > (at_, quote):
                    at_, quote = now, float(q)
            state.update((at_, quote))
            due = int(pd.Timestamp(at_, tz="UTC").timestamp() * 1000 + most.total_seconds() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if told:
            yield pd.DataFrame({"symbol": [t[0] for t in told], "quoted_at": pd.to_datetime([t[1] for t in told]), "quote": [t[2] for t in told]})

    timed = events.where(F.col(symbol).isNotNull() | (F.col(at) >= F.timestamp_seconds(F.lit(4102444800)))).withWatermark(at, late)
    rows = timed.select(F.col(symbol).alias("symbol"), F.col(at).cast("timestamp_ntz").alias("at"), F.col(value).cast("double").alias("quote"), F.col(at))
    told = rows.groupBy("symbol").applyInPandasWithState(step, "symbol string, quoted_at timestamp_ntz, quote double", "at timestamp_ntz, quote double", "append", GroupStateTimeout.EventTimeTimeout)
    return told.where("symbol IS NOT NULL")


def stream_enrich(events: DataFrame, raw: str, at: str) -> DataFrame:
    """ST5: the resolver's symbol, status and family of a raw symbol on the day of each row (J17): its rules are a few dozen rows, broadcast to the stream."""
    return resolve_tickers(events, raw, F.col(at).cast("date"))


def stream_merge(events: DataFrame, key: Sequence[str], at: str, late: str = "60 days") -> DataFrame:
    """ST6: append-only merge: the first row of each key and day; a repeat is not taken again.

    The day is part of the identity, so the keys of a day leave the state once the watermark is past it, and a row of a day
    before the watermark is late and not taken. No batch reads what earlier ones wrote.
    """
    day = events.withColumn("day", F.date_trunc("day", at))
    return (day.withWatermark("day", late) if events.isStreaming else day).dropDuplicates([*key, "day"])


def stream_activity_sessions(events: DataFrame, actor: str, at: str, gap: str = "6 hours", late: str = "60 days") -> DataFrame:
    """ST7: bursts of an actor's rows with no longer pause than ``gap``."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    per = timed.groupBy(F.session_window(at, gap).alias("w"), F.col(actor).alias("actor")).agg(F.count(F.lit(1)).alias("rows"))
    return per.select("actor", F.col("w.start").cast("timestamp_ntz").alias("began"), F.col("w.end").cast("timestamp_ntz").alias("ended"), "rows")
