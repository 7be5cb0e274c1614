"""Structured Streaming: windows over event time, and state that runs along a key's blocks. Sources are files; results are tables in the
shared folder, written batch by batch, so nothing gathers on the driver."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir. Only a session in one process may do without that setting, and gets a folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="streams-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Runs over what is there now; complete results replace the table, updates are added to it."""
    spark = stream.sparkSession
    path = scratch(spark, "stream")
    schema = stream.schema

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/table")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/table")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): stretches of a user's events with no gap as long as `gap`, of events no later than `late` behind the newest.
    In append mode a session is written once, when the watermark has passed its end, and its state goes; complete mode keeps all."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n) with events no later than `late` behind the newest."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "1 day") -> DataFrame:
    """(start, event_type, n) for windows that overlap, a new one every `step`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def self_checked(stream: DataFrame, key: str, payload: str) -> DataFrame:
    """Runs the stream over what is there now; each batch is written, read back and compared by checksum beside the writing: (key, status)."""
    spark = stream.sparkSession
    path = scratch(spark, "selfcheck")

    def write(batch: DataFrame, number: int) -> None:
        own = f"{path}/table/batch={number}"
        batch.select(key, payload, F.crc32(payload).alias("expected")).write.mode("overwrite").parquet(own)  # a batch that runs again replaces itself
        back = spark.read.parquet(own)
        status = F.when(F.crc32(payload).eqNullSafe(F.col("expected")), "ok").otherwise("damaged")
        back.select(key, status.alias("status")).write.mode("overwrite").parquet(f"{path}/checked/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/checked").select(key, "status")


def _blocks(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    turns, size = state.get if state.exists else (0, 0)
    for p in parts:
        turns += len(p)
        size += int(p["text"].fillna("").map(lambda x: len(x.encode())).sum())
    state.update((turns, size))
    yield pd.DataFrame({"conv_id": [key[0]], "turns": [turns], "bytes": [size]})


def running_blocks(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, bytes) after each batch: one typed state a conversation, kept over batches."""
    return conversations.groupBy("conv_id").applyInPandasWithState(_blocks, "conv_id long, turns long, bytes long", "turns long, bytes long", "update", GroupStateTimeout.NoTimeout)
