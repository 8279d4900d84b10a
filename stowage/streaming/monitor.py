"""Monitor of running jobs: the latest status of each (client, pid), with eviction of silent ones.

An upsert by key is a streaming aggregation whose state is one row for each key. ``evicting`` adds a processing-time limit by key, for monitors that must
forget jobs that stop reporting.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stowage.sources.shared import shared_dir


def status(events: DataFrame) -> DataFrame:
    """Status rows (client, pid, phase, ts, event_id) of an event table or stream."""
    return events.select(F.col("user_id").alias("client"), (F.col("event_id") % 4).alias("pid"), F.col("event_type").alias("phase"), "ts", "event_id")


def latest(rows: DataFrame) -> DataFrame:
    """The latest status of each key; batch and streaming alike."""
    newest = F.max(F.struct("ts", "event_id", "phase")).alias("s")
    return rows.groupBy("client", "pid").agg(newest).select("client", "pid", "s.phase", "s.ts")


def run_once(spark: SparkSession, path: str, checkpoint: str | None = None, max_files: int = 64) -> DataFrame:
    """Stream the files under a path through ``latest`` until they are used up, and return the table of results.

    Each micro-batch writes the keys it changed; the table keeps the newest row of each key.
    """
    out = checkpoint or f"{shared_dir(spark)}/monitor-{uuid.uuid4().hex}"
    stream = source(spark, path, max_files)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")

    query = latest(status(stream)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.parquet(f"{out}/changes")
    return changes.groupBy("client", "pid").agg(F.max_by(F.struct("phase", "ts"), "batch").alias("s")).select("client", "pid", "s.phase", "s.ts")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def evicting(rows: DataFrame, seconds: int) -> DataFrame:
    """A stream of (client, pid, phase, ts, gone): changed keys, and keys that were silent for so many seconds with gone = true."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            phase, ts = state.get
            state.remove()
            yield pd.DataFrame({"client": [key[0]], "pid": [key[1]], "phase": [phase], "ts": [ts], "gone": [True]})
            return
        best = state.get if state.exists else None
        for pdf in frames:
            row = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            if best is None or row["ts"] >= best[1]:
                best = (row["phase"], row["ts"].to_pydatetime())
        state.update(best)
        state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({"client": [key[0]], "pid": [key[1]], "phase": [best[0]], "ts": [best[1]], "gone": [False]})

    return rows.groupBy("client", "pid").applyInPandasWithState(step, "client long, pid long, phase string, ts timestamp, gone boolean", "phase string, ts timestamp", "update", GroupStateTimeout.ProcessingTimeTimeout)


def merge_snapshots(known: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Known rows after a full snapshot: those not in it go, the others take its values."""
    return snapshot.join(known.select(*keys, F.lit(True).alias("_known")), keys, "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")


def source(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """A stream of the Parquet files under a path, or of one file."""
    schema = spark.read.parquet(path).schema
    folder, name = (path, "*.parquet") if _is_folder(spark, path) else path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", name).parquet(folder)


def _target(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def append_log(stream: DataFrame, path: str | None = None, delay: str = "1 hour", time_col: str = "ts") -> DataFrame:
    """Append a stream of changes to a log while its source is scanned, until the input is used up, and return the log.

    Rows that repeat within ``delay`` are one; the watermark bounds the state that this takes, and
    rows that come later than that are left out.
    """
    spark = stream.sparkSession
    out = path or _target(spark, "log")
    once = stream.withColumn("_at", F.col(time_col).cast("timestamp")).withWatermark("_at", delay).dropDuplicatesWithinWatermark(stream.columns).drop("_at")
    once.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def with_dimension(stream: DataFrame, load: Callable[[], DataFrame], keys: list[str], path: str | None = None) -> DataFrame:
    """Join each micro-batch with a dimension that is loaded anew for it, so that a changed configuration counts from the next batch on."""
    spark = stream.sparkSession
    out = path or _target(spark, "joined")

    def write(batch: DataFrame, number: int) -> None:
        batch.join(load(), keys, "left").write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")


def recheck(spark: SparkSession, check: Callable[[], DataFrame], each: Callable[[DataFrame], None], seconds: int):
    """Run a check again every so many seconds while the returned query is active: a timer that asks whether a running job should stop."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, number: each(check())).trigger(processingTime=f"{seconds} seconds").start()
