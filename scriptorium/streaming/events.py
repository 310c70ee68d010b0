"""Streaming forms of the metrics and conversation operators: event time, watermarks, bounded state.

Each has a batch counterpart with the same rows; tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive, with ``ts`` as a timestamp that can carry a watermark."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly counters of each event type; an hour is final once the watermark has passed it."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    agg = rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    return agg.select(F.col("window.start").alias("hour"), "event_type", "n", "total", "low", "high")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    agg = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return agg.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Repeats of the keys within the watermark are dropped; the state ends with it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def recent_repeats(turns: DataFrame, last: int = 8, idle: str | None = None) -> DataFrame:
    """Marks texts whose hash is among the ``last`` ones of the same conversation (columns conv_id, turn, text).

    With ``idle`` (like "1 hour") the state of a conversation that has been still for so long is dropped.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ring = list(state.get[0]) if state.exists else []
        for frame in frames:
            frame, marks = frame.sort_values("turn"), []
            for h in frame["h"]:
                marks.append(h in ring)
                ring = ([*ring, h])[-last:]
            yield pd.DataFrame({"conv_id": key[0], "turn": frame["turn"], "repeated": marks})
        state.update((ring,))
        if idle:
            state.setTimeoutDuration(idle)

    rows = turns.select("conv_id", "turn", F.xxhash64("text").alias("h"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return rows.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, repeated boolean", "ring array<long>", "append", timeout)


def upsert(stream: DataFrame, folder: str, key: list[str], order: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Keeps the latest row of each key, in buckets by the key's hash; a micro-batch rewrites only the buckets it touches.

    A bucket's versions are folders named by the batch that wrote them; a replayed batch reads what stood before it and
    writes the same version again, so the table does not depend on how often a batch was tried.  ``latest`` reads it.
    """
    from pyspark.sql import window as W

    def write(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        dealt = batch.withColumn("_bucket", F.pmod(F.hash(*key), F.lit(buckets)))
        for bucket in sorted(r[0] for r in dealt.select("_bucket").distinct().collect()):  # at most ``buckets``
            rows = dealt.where(F.col("_bucket") == bucket).drop("_bucket")
            before = _versions(spark, f"{folder}/b{bucket}", version)
            if before:
                rows = spark.read.schema(batch.schema).parquet(f"{folder}/b{bucket}/v{before[-1]}").unionByName(rows)
            latest = rows.withColumn("_r", F.row_number().over(W.Window.partitionBy(*key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
            latest.write.mode("overwrite").parquet(f"{folder}/b{bucket}/v{version}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, folder: str, below: int | None = None) -> list[int]:
    """Versions of a bucket that were written to the end, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    done = [s.getPath().getName() for s in store.listStatus(path) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{s.getPath()}/_SUCCESS"))]
    return sorted(n for n in (int(name[1:]) for name in done if name.startswith("v")) if below is None or n < below)


def latest(spark: SparkSession, folder: str, schema, buckets: int = 16) -> DataFrame:
    """The table that ``upsert`` keeps."""
    newest = [f"{folder}/b{b}/v{found[-1]}" for b in range(buckets) if (found := _versions(spark, f"{folder}/b{b}"))]
    return spark.read.schema(schema).parquet(*newest) if newest else spark.createDataFrame([], schema)
