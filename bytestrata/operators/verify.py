"""Integrity operators: runs of pieces, two-sided comparison, merges over streams."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytestrata.functions.checksums import crc64_combine


def merge_runs(slices: DataFrame) -> DataFrame:
    """(name, run_no, off, len, pieces): contiguous pieces of a name joined, gaps kept apart; pieces of unknown offset come last. A run
    goes on only from the piece before. Both windows read one sort, so of pieces with equal offset and length the first goes on, the rest open runs."""
    w = Window.partitionBy("name").orderBy(F.col("off").asc_nulls_last(), F.col("len").asc_nulls_last())
    marked = slices.withColumn("new", F.when(F.col("off") == F.lag(F.col("off") + F.col("len")).over(w), 0).otherwise(1))
    numbered = marked.withColumn("run_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("name", "run_no").agg(F.min("off").alias("off"), F.sum("len").alias("len"), F.count(F.lit(1)).alias("pieces"))


def open_runs(pieces: Iterable[tuple[int, int, int]]) -> list[list[int]]:
    """Runs [off, len, crc] of (off, len, crc) in order of offset: a piece extends a run that ends where it starts, else it opens one; so
    pieces that overlap stay in runs of their own."""
    runs: list[list[int]] = []
    for off, length, crc in sorted(pieces):
        for run in runs:
            if run[0] + run[1] == off:
                run[2] = crc64_combine(run[2], crc, length)
                run[1] += length
                break
        else:
            runs.append([off, length, crc])
    return runs


def merge_runs_crc(slices: DataFrame) -> DataFrame:
    """(name, run_no, off, len, crc) with CRC-64 combined over a run's pieces; a group is one name's pieces, so only their numbers meet."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        found = open_runs(zip(rows["off"], rows["len"], (int(x) & ((1 << 64) - 1) for x in rows["crc"]), strict=True))
        signed = [(r[2] ^ (1 << 63)) - (1 << 63) for r in found]
        return pd.DataFrame({"name": rows["name"].iloc[0], "run_no": range(1, len(found) + 1), "off": [r[0] for r in found], "len": [r[1] for r in found], "crc": signed})

    kind = slices.schema["name"].dataType.simpleString()
    return slices.groupBy("name").applyInPandas(f, f"name {kind}, run_no long, off long, len long, crc long")


def compare_sides(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and status of the rows that differ: missing on one side ('unread', 'unwritten') or unlike in a value ('differs'); nulls are equal."""
    a = left.select(*keys, F.struct(*values).alias("a"))
    b = right.select(*keys, F.struct(*values).alias("b"))
    both = a.join(b, keys, "full_outer")
    status = F.when(F.col("b").isNull(), "unread").when(F.col("a").isNull(), "unwritten").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return both.select(*keys, status.alias("status")).filter("status IS NOT NULL")


def merge_streams(pieces: DataFrame) -> DataFrame:
    """(name, size, checksum, streams): sizes add up over streams, and a file in several has no checksum of its own."""
    merged = pieces.groupBy("name").agg(F.sum("size").alias("size"), F.max("checksum").alias("checksum"), F.countDistinct("stream").alias("streams"))
    return merged.withColumn("checksum", F.when(F.col("streams") == 1, F.col("checksum")))


def within(rows: DataFrame, id_column: str, key: str, at: str, width: int) -> DataFrame:
    """(id, other) for each earlier row of the same key at most `width` back. Rows meet by key and bin of that width, their own and the
    one before, so a key with many rows is spread over its bins."""
    bin_ = F.floor(F.col(at) / width)
    left = rows.select(F.col(id_column), F.col(key).alias("_key"), F.col(at).alias("_at"), F.explode(F.array(bin_, bin_ - 1)).alias("_bin"))
    right = rows.select(F.col(id_column).alias("other"), F.col(key).alias("_key"), F.col(at).alias("_before"), bin_.alias("_bin"))
    met = left.join(right, ["_key", "_bin"])
    return met.filter((F.col("_before") < F.col("_at")) & (F.col("_before") >= F.col("_at") - width)).select(id_column, "other")
