"""Operations that run alike on a stream and on a table, and the replay of a folder as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.shared import fresh_path
from tessera.streaming import upserts


def timed(events: DataFrame, late: str | None) -> DataFrame:
    """Events with a ts that watermarks accept. late: the watermark of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if late else rows


def counts(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) of events (ts, event_type, value)."""
    per = timed(events, late).groupBy(F.window("ts", width, slide or width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return per.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, session_start, session_end, n) of events (ts, user_id): runs with gaps below `gap`; the end is that much after the last event."""
    per = timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return per.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


def latest_by_key(events: DataFrame, late: str) -> DataFrame:
    """Events without repeats of an event_id within the watermark."""
    return timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def followed(first: DataFrame, second: DataFrame, within: str, late: str | None = None) -> DataFrame:
    """(user_id, first_id, second_id): pairs of events (event_id, user_id, ts) of a user, the second at most `within` after the first."""
    a = timed(first, late).select("user_id", F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = timed(second, late).select(F.col("user_id").alias("user"), F.col("event_id").alias("second_id"), F.col("ts").alias("second_ts"))
    soon = F.col("second_ts").between(F.col("first_ts"), F.col("first_ts") + F.expr(f"interval {within}"))
    return a.join(b, (F.col("user_id") == F.col("user")) & soon).select("user_id", "first_id", "second_id")


def totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) of a stream of events (user_id, value): the state of each user after each batch that has some."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    rows = events.select("user_id", "value").groupBy("user_id")
    return rows.applyInPandasWithState(run, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, path: str, schema, transform, output: str = "complete", files_per_trigger: int = 1, glob: str = "*", keys: list[str] | None = None) -> DataFrame:
    """What transform makes of the Parquet files of a folder (those whose names fit glob), read as a stream to their end.

    In append mode the result is written as Parquet to the shared folder. In
    complete and update mode, which files don't take, batches are upserted there:
    the last batch is the result, or with update mode the last row of each of `keys`.
    """
    stream = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(path))
    to, progress = fresh_path(spark, "stream"), fresh_path(spark, "progress")
    if output == "append":
        query = stream.writeStream.outputMode(output).trigger(availableNow=True).option("checkpointLocation", progress).format("parquet").start(to)
    else:
        query = upserts.upsert(stream, to, [] if output == "complete" else keys or stream.columns, progress, output)
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(to) if output == "append" else upserts.latest(spark, to, stream.schema, keys or stream.columns, whole=output == "complete")
