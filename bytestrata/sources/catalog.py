"""Catalog relations: entries from files, from tables, and their filters and orders."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.functions import formatting as fmt

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class ScanOptions:
    """Which files become entries and which metadata they keep."""

    recurse: bool = False
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    strip_paths: bool = False
    no_time: bool = False
    no_checksum: bool = False


def scan_files(spark: SparkSession, root: str, options: ScanOptions | None = None) -> DataFrame:
    """entries(path, size, mtime, checksum, payload) of the files under root; empty folders are no entries, unreadable files are passed over."""
    o = options or ScanOptions()
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(o.recurse).lower()).option("ignoreCorruptFiles", "true")
    files = reader.load(root if o.recurse else os.path.join(root, "*"))
    prefix = "^.*?" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in "/" + root.strip("/") + "/")
    files = files.withColumn("path", F.regexp_replace("path", prefix, ""))
    if o.include:
        files = files.filter(fmt.matches(F.col("path"), o.include))
    if o.exclude:
        files = files.filter(~fmt.matches(F.col("path"), o.exclude))
    path = fmt.base_name(F.col("path")) if o.strip_paths else fmt.stored_name(F.col("path"))
    mtime = F.lit(None).cast("timestamp") if o.no_time else F.col("modificationTime")
    return files.select(path.alias("path"), F.col("length").alias("size"), mtime.alias("mtime"), (F.lit(None).cast("long") if o.no_checksum else F.crc32("content")).alias("checksum"), F.col("content").alias("payload"))


def document_entries(docs: DataFrame) -> DataFrame:
    """Documents as entries: (doc_id, path, size, payload)."""
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.encode("text", "UTF-8").alias("payload"))


def listing(entries: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, sort: str = "extension") -> DataFrame:
    """path, name, ext, size and its column text, filtered by globs on the path and ordered: extension (then size, name), name, size or none."""
    path = F.col("path")
    rows = entries
    if include:
        rows = rows.filter(fmt.matches(path, include))
    if exclude:
        rows = rows.filter(~fmt.matches(path, exclude))
    rows = rows.select("path", fmt.short_name(path).alias("name"), fmt.extension(path).alias("ext"), "size", fmt.size_column(F.col("size")).alias("size_text"))
    orders = {"extension": ["ext", "size", "path"], "name": ["path"], "size": ["size", "path"], "none": []}[sort]
    return rows.orderBy(*orders) if orders else rows


#: Columns that a catalog may have besides path and size, and that a listing shows if they are there and not hidden.
METADATA = ("mtime", "mode", "uid", "gid", "checksum")


def listing_columns(entries: DataFrame, hidden: Sequence[str] = (), strip_paths: bool = False) -> DataFrame:
    """path, size and what the entries have of METADATA, as text where it has a form of its own, in the path's order."""
    shown = {
        "mtime": F.date_format("mtime", "yyyy-MM-dd HH:mm:ss") if "mtime" in entries.columns else None,
        "mode": fmt.octal_mode(F.col("mode")) if "mode" in entries.columns else None,
        "checksum": F.lower(F.lpad(F.hex("checksum"), 8, "0")) if "checksum" in entries.columns else None,
    }
    path = fmt.base_name(F.col("path")) if strip_paths else F.col("path")
    columns = [shown.get(c, F.col(c)).alias(c) for c in METADATA if c in entries.columns and c not in hidden]
    return entries.select(path.alias("path"), "size", *columns).orderBy("path")


def merge_duplicates(entries: DataFrame) -> DataFrame:
    """The same path more than once is one entry with the sizes' sum."""
    return entries.groupBy("path").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("inputs"))


def without(entries: DataFrame, excluded: DataFrame, on: str = "path") -> DataFrame:
    return entries.join(excluded.select(on), on, "left_anti")


def host_info(spark: SparkSession) -> DataFrame:
    """What the session knows of where it runs, one row."""
    sc = spark.sparkContext
    return spark.createDataFrame([(spark.version, sc.master, sc.defaultParallelism)], "version string, master string, parallelism int")
