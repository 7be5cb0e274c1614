"""What the training-data operators share: table access, bounded Arrow batches, durable cuts and word hashes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.session import ship, spread

#: Spark removes the shuffle files of a query when it ends, if this is set.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes of one Arrow batch sent to a Python worker: long texts must not make a batch of gigabytes.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20
#: Words whose hashes a Python worker remembers.
WORD_MEMO = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores even where they are one small file."""
    return spread(table(spark, sf_dir, "documents"))


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to what a worker holds; lower settings of the user stay."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a session in one process may do without one, and gets a folder of its own."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and a lost executor loses nothing. The shuffle files that
    led to it go when it is written, the table itself with discard() or, at the latest, when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    was = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, was)
    _folder(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_cut_path"] = path
    return out


def _folder(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing reads any more."""
    for df in tables:
        path = df.__dict__.pop("_cut_path", None)
        if path:
            _folder(df.sparkSession, path).delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(path), True)


def one_of_each(docs: DataFrame, kept: DataFrame, digest: Column) -> DataFrame:
    """The rows of docs that kept (doc_id, digest, rows; a small written table) names, one of those that are equal in id and text."""
    names = ["_id", "_digest", "_rows"]
    while set(names) & set(docs.columns):
        names = [x + "_" for x in names]
    of, its, many = names
    marked = docs.withColumn(its, digest)
    own = kept.select(F.col("doc_id").alias(of), F.col("digest").alias(its + "k"), F.col("rows").alias(many))

    def chosen(part: DataFrame) -> DataFrame:
        return marked.join(part, marked["doc_id"].eqNullSafe(part[of]) & (marked[its] == part[its + "k"]), "left_semi")

    alone = chosen(own.filter(F.col(many) == 1)).select(docs.columns)
    tied = own.filter(F.col(many) > 1)
    if tied.isEmpty():
        return alone
    # combined within tasks first, so repeated rows never gather in one
    row = F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row")
    return alone.unionByName(chosen(tied).groupBy("doc_id", its).agg(row).select("row.*"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def rows_udf(columns: list[str], out: pa.Schema, f: Callable[..., dict[str, list]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from f(*columns as lists) -> dict of output columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = f(*(batch.column(c).to_pylist() for c in columns))
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) for x in out], schema=out)

    return run


_held: list = [None, None]


def held(owner: Any, make: Callable[[], Any]) -> Any:
    """What an operator remembers in this process. Only one operator's memory is kept: workers live on from stage to stage, and what
    one has gathered would come on top of the next one's."""
    if _held[0] != owner:
        _held[:] = [owner, None]
        gc.unfreeze()  # what its owner had frozen
        gc.collect()
        if os.name == "posix" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
        _held[1] = make()
    return _held[1]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return held("word hashes", WordHashes).of(words)


class WordHashes(dict):
    """A memo of 64-bit word hashes (any bytes); emptied when full, so its size is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Mixed polynomial hashes modulo 2**64 of all windows of `width` word hashes; `base` is odd."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Horner by doubling: the hash of 2**k words from two of 2**(k-1), so log2(width) vector steps
    total, have, part, size, power = None, 0, mixed(words + np.uint64(base)), 1, base & (2**64 - 1)
    rest = width
    while rest:
        if rest & 1:
            piece = part[have : have + n]
            total = piece.copy() if total is None else total * np.uint64(power) + piece
            have += size
        rest >>= 1
        if rest:
            part = part[:-size] * np.uint64(power) + part[size:]
            size, power = size * 2, power * power & (2**64 - 1)
    return mixed(total)
