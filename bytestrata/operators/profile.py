"""Profiles of whole relations: byte histograms, order-1 entropy in fixed point, n-gram rarity, noise."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_BITS, LOG_ENTRIES = 12, 1 << 14


def log_table() -> np.ndarray:
    """Entry v is log2(v) in units of 1/4096 bit, to the nearest; entry 0 is 0."""
    return np.round(np.log2(np.maximum(np.arange(LOG_ENTRIES + 1), 1)) * (1 << LOG_BITS)).astype(np.int64)


def entropy_cost(counts: np.ndarray, table: np.ndarray) -> int:
    """Sum over contexts (rows) of total * log(total) less count * log(count), in units of 1/4096 bit; counts above the table are halved into it."""

    def log(v: np.ndarray) -> np.ndarray:
        k = np.maximum(0, np.frexp(v.astype(float))[1] - (LOG_ENTRIES.bit_length() - 1))
        return table[v >> k] + (k << LOG_BITS)

    total = counts.sum(1)
    return int((total * log(total)).sum() - (counts * log(counts)).sum())


def order1_counts(data: bytes) -> np.ndarray:
    """(256, 256) counts of bytes after their context, the low byte of 32 * second last + last."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    before = np.concatenate([[0], b[:-1]]) if len(b) else b
    second = np.concatenate([[0, 0], b[:-2]])[: len(b)]
    return np.bincount(((32 * second + before) & 255) * 256 + b, minlength=65536).reshape(256, 256)


def order1_entropy(docs: DataFrame) -> DataFrame:
    """(doc_id, cost): fixed-point order-1 entropy of each text's bytes."""
    table = log_table()

    def run(batches):
        for b in batches:
            cost = [entropy_cost(order1_counts((t or "").encode()), table) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cost, pa.int64())], ["doc_id", "cost"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, cost long")


def byte_histogram(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(byte, n) over all rows; each batch sends at most 256 rows on."""

    def run(batches):
        for b in batches:
            n = np.zeros(256, np.int64)
            for x in b.column(0).to_pylist():
                if x:
                    n += np.bincount(np.frombuffer(x, np.uint8), minlength=256)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["byte", "n"])

    return payloads.select(column).mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def ngram_rarity(docs: DataFrame, n: int = 4) -> DataFrame:
    """(grams, once, most): distinct n-grams of characters in all texts, how many occur once, and the count of the most frequent. A batch
    sends each of its n-grams once, with its count."""

    def run(batches):
        for b in batches:
            held = Counter()
            for t in b.column("text").to_pylist():
                held.update(map("".join, zip(*(t[k:] for k in range(n)), strict=False)))
            yield pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), pa.array([*held.values()], pa.int64())], ["gram", "n"])

    grams = docs.filter(F.length("text") >= n).select("text").mapInArrow(run, "gram string, n long")
    counts = grams.groupBy("gram").agg(F.sum("n").alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("grams"), F.count_if(F.col("n") == 1).alias("once"), F.max("n").alias("most"))


def noise_score(data: bytes) -> int:
    """Distinct hashes of 15 bits of neighbouring bytes in eight windows of 512, scaled to 256; high for noise. Under 4096 bytes: 0, under 8: the length."""
    if len(data) < 8:
        return len(data)
    if len(data) < 4096:
        return 0
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    step = len(b) >> 3
    windows = np.concatenate([b[k * step : k * step + 512] for k in range(8)])
    before = np.concatenate([[0], windows[:-1]])
    hashes = ((before << 8) ^ windows) & 0x7FFF
    return len(np.unique(hashes)) * 256 >> 12


def noise(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([noise_score((t or "").encode()) for t in b.column("text").to_pylist()], pa.int64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score long")
