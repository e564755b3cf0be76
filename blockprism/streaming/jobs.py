"""Continuous jobs: the write log as a stream."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from blockprism.operators import dedup
from blockprism.operators.writelog import KEY


def log_stream(spark: SparkSession, path: str, schema, max_bytes: str | None = None, max_files: int | None = None) -> DataFrame:
    """New files of a folder; a trigger takes at most ``max_bytes`` or ``max_files``."""
    reader = spark.readStream.schema(schema)
    for name, value in (("maxBytesPerTrigger", max_bytes), ("maxFilesPerTrigger", max_files)):
        if value:
            reader = reader.option(name, value)
    return reader.parquet(path)


def current_map(writes: DataFrame) -> DataFrame:
    """Continuously the current write of each block: changes ``(vol_id, lba, seq)``, for update mode.

    The state is a block's highest seq; a lower one that comes late changes nothing.
    """
    return writes.select(*KEY, "seq").groupBy(*KEY).agg(F.max("seq").alias("seq"))


def first_copies(blocks: DataFrame, ts: str | None = None, horizon: str = "1 hour") -> DataFrame:
    """Continuously the first block of each content.

    Without a time all hashes are kept as state; with one those of ``horizon`` are,
    and a copy that comes later counts as new.
    """
    if ts is None:
        return blocks.dropDuplicates(["hash"])
    return blocks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["hash"])


def fresh(writes: DataFrame, volumes: DataFrame) -> DataFrame:
    """Writes of their volume's current generation; ``volumes`` is read anew for each batch."""
    now = volumes.select("vol_id", F.col("created_at").alias("_now"))
    return writes.join(F.broadcast(now) if volumes.isStreaming is False and volumes.count() <= 100_000 else now, "vol_id").filter("vol_created_at = _now").drop("_now")


def reports(events: DataFrame, ts: str = "ts", every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Counts and bytes per kind in tumbling windows."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, every), "kind").agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).select("window.start", "window.end", "kind", "n", "bytes")


def heartbeat_sessions(beats: DataFrame, ts: str = "ts", gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """A node's spans without a longer silence than ``gap``."""
    timed = beats.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap), "node_id").agg(F.count("*").alias("beats")).select("node_id", "session_window.start", "session_window.end", "beats")


def maintain(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the map as a table of versions: each batch adds one folder, written once however often it is tried."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def maintained(spark: SparkSession, path: str) -> DataFrame:
    """The map that ``maintain`` keeps, now."""
    return spark.read.parquet(path).groupBy(*KEY).agg(F.max("seq").alias("seq"))


def rescan(spark: SparkSession, read: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], fill: float, limit: int = 256) -> DataFrame:
    """One cycle of the rescan of blocks that were written without a lookup; ``read`` gives map, index and hashes as of now."""
    blockmap, index, hashes = read()
    return dedup.rescan_plan(blockmap, index, hashes, limit, fill)
