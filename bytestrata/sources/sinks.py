"""Sinks that write only what has been verified, and never outside their target."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.functions import formatting as fmt
from bytestrata.operators import codecs


class VerificationError(RuntimeError):
    """What was written does not read back as what was meant."""


def guarded(entries: DataFrame) -> DataFrame:
    """entries whose paths stay under the target; a write of any other is refused, not redirected."""
    return entries.filter(~fmt.escapes_target(F.col("path")))


def verification(entries: DataFrame) -> DataFrame:
    """path, expected and found checksum, status ('ok', 'damaged', 'unchecked') of entries with payloads; writes nothing."""
    found = F.crc32("payload")
    status = F.when(F.col("checksum").isNull(), "unchecked").when(F.col("checksum") == found, "ok").otherwise("damaged")
    return entries.select("path", F.col("checksum").alias("expected"), found.alias("found"), status.alias("status"))


def extractable(entries: DataFrame, safe: bool = False) -> DataFrame:
    """What an extraction writes: everything that decoded, or in safe mode only what verified; always within the target."""
    rows = guarded(entries)
    return rows.filter(F.col("checksum").isNull() | (F.col("checksum") == F.crc32("payload"))) if safe else rows


def simulate(entries: DataFrame) -> DataFrame:
    """Number of entries and bytes that a write would store; nothing is written."""
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def simulate_coded(payloads: DataFrame, codec: codecs.Pair) -> DataFrame:
    """entries, bytes, coded_bytes and how many blocks would be stored as they are, of a write with this codec; nothing is written."""
    blocks = codecs.coded(payloads, codec)
    return blocks.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("raw_length"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.octet_length("block")), F.lit(0)).cast("long").alias("coded_bytes"), F.count_if("stored").alias("stored"))


def write_blocks(payloads: DataFrame, codec: codecs.Pair, target: str) -> DataFrame:
    """The blocks table (doc_id, raw_length, stored, block) under target, verified before it takes the place of an older one."""
    replace_verified(codecs.coded(payloads, codec), target)
    return payloads.sparkSession.read.parquet(target)


def planned(entries: DataFrame, present: DataFrame, policy: str = "ask") -> DataFrame:
    """entries with an action: 'write' where the path is free, else by policy: yes replaces, no skips, ask (which nobody answers here) skips."""
    if policy not in ("yes", "no", "ask"):
        raise ValueError(f"no policy {policy!r}")
    there = present.select("path").distinct().withColumn("_there", F.lit(True))
    taken = "replace" if policy == "yes" else "skip"
    joined = entries.join(there, "path", "left")
    return joined.withColumn("action", F.when(F.col("_there").isNull(), "write").otherwise(taken)).drop("_there")


def extract_files(entries: DataFrame, target: str, policy: str = "ask", safe: bool = False) -> DataFrame:
    """Write each entry's payload (path, payload, checksum) as a file under target, a folder that the executors share: (path, status), a
    row each: written, replaced, skipped, refused (it would leave the target) or damaged (safe mode: what does not verify stays out)."""
    if policy not in ("yes", "no", "ask"):
        raise ValueError(f"no policy {policy!r}")
    checked = F.when(fmt.escapes_target(F.col("path")), "refused")
    if safe:
        checked = checked.when(F.col("checksum").isNotNull() & (F.col("checksum") != F.crc32("payload")), "damaged")
    rows = entries.select("path", "payload", checked.alias("refusal"))

    def run(batches):
        for b in batches:
            status = []
            for path, payload, refusal in zip(*(b.column(c).to_pylist() for c in ("path", "payload", "refusal")), strict=True):
                if refusal is None:
                    file = os.path.join(target, path)
                    there = os.path.exists(file)
                    if there and policy != "yes":
                        refusal = "skipped"
                    else:
                        os.makedirs(os.path.dirname(file), exist_ok=True)
                        staging = f"{file}.{uuid.uuid4().hex[:8]}"
                        with open(staging, "wb") as f:
                            f.write(payload or b"")
                        os.replace(staging, file)  # whole or not at all, also if a task runs twice
                        refusal = "replaced" if there else "written"
                status.append(refusal)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(status, pa.string())], ["path", "status"])

    return rows.mapInArrow(run, "path string, status string")


def replace_verified(entries: DataFrame, target: str) -> None:
    """Write beside the target, read back and compare, and only then put it in the target's place; a failure leaves the target as it was."""
    spark: SparkSession = entries.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    staging, old = f"{target}.new-{uuid.uuid4().hex[:8]}", f"{target}.old-{uuid.uuid4().hex[:8]}"
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    entries.write.parquet(staging)
    try:
        digest = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*entries.columns).cast("decimal(20,0)")).alias("h")]
        if spark.read.parquet(staging).agg(*digest).first() != entries.agg(*digest).first():
            raise VerificationError(f"{staging} does not hold what was written")
        had = fs.exists(path(target))
        if had:
            fs.rename(path(target), path(old))
        if not fs.rename(path(staging), path(target)):
            if had:
                fs.rename(path(old), path(target))
            raise VerificationError(f"{target} cannot be put in place")
        if had:
            fs.delete(path(old), True)
    finally:
        fs.delete(path(staging), True)
