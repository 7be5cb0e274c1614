"""Removal of passages that an earlier document holds already, found through difference-cover anchors.

A passage is a window of WINDOW words. Hashing all of them would move a row for each word, so only windows of ANCHOR words at
positions whose remainder modulo PERIOD is in COVER are hashed: for any two places there is a shift below PERIOD that puts both on
the cover, so two equal passages share an aligned anchor wherever they stand. Then:

1. anchors are written once; those that more than one text holds are found (grouped before they are shuffled), and lead back to their places;
2. around those places alone, the whole windows that contain such an anchor are hashed with 128 bits: a match extends as long as
   neighbouring windows match too;
3. a window that starts in a document with a smaller doc_id covers its words, which are removed.

Documents with the same words are one text in 1 to 3, with the smallest of their doc_ids: the others are covered as a whole. What is
joined on an anchor or a window joins a written table, so that a join can split a passage which very many texts hold.

Defined cases: null texts have no words; texts with fewer words than a window lose nothing; texts may be of any length; a text is known by
its words, not by its doc_id, so one doc_id may stand over several texts; rows of the same doc_id do not cover each other, and each gets
a row; a null doc_id counts as larger than any other; an empty table gives an empty result; other columns stay unread.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.llm.common import bounded_batches, cut, discard, documents, rows_udf, window_hashes, word_hashes

WINDOW = 50
#: A perfect difference set: every remainder modulo PERIOD is a difference of two of its members in one way.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: Odd multipliers of the polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LAST = (1 << 63) - 1
#: Rows of an Arrow batch that goes back to Spark.
OUT_ROWS = 100_000

_on_cover = np.isin(np.arange(PERIOD), COVER)


def words_of(text: str | None) -> list[bytes]:
    """Words between the characters U+0020 and U+0009 to U+000D."""
    return (text or "").encode().split()


def _flush(parts: dict[str, list[np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts[x.name]), x.type) for x in schema], schema=schema)
    for v in parts.values():
        v.clear()
    return batch


def _exploded(columns: list[str], schema: pa.Schema, f):
    """A mapInArrow function; f(*values of a row) -> arrays of equal length, one for each output column, or None."""

    def run(batches):
        parts, n = {x.name: [] for x in schema}, 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if (found := f(*row)) is not None and len(found[0]):
                    for v, x in zip(parts.values(), found, strict=True):
                        v.append(x)
                    n += len(found[0])
                    if n >= OUT_ROWS:
                        yield _flush(parts, schema)
                        n = 0
        if n:
            yield _flush(parts, schema)

    return run


def word_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, words_sha256): the digest is of the words joined by one space."""

    def f(doc_id: list, text: list) -> dict:
        words = [*map(words_of, text)]
        return {"doc_id": doc_id, "n_words": [*map(len, words)], "words_sha256": [hashlib.sha256(b" ".join(w)).digest() for w in words]}

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("words_sha256", pa.binary())])
    return docs.select("doc_id", "text").mapInArrow(rows_udf(["doc_id", "text"], schema, f), "doc_id long, n_words long, words_sha256 binary")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(row, words_sha256, first_id, words): texts that have a window, each once, as compressed words. Copies are combined within tasks, then
    by their whole words; row is a number of the text's own, fixed once the table is written."""

    def f(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            ids, digests, packed = [], [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(t)
                if len(words) >= WINDOW:
                    joined = b" ".join(words)
                    ids.append(i)
                    digests.append(hashlib.sha256(joined).digest())
                    packed.append(pack(joined))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["doc_id", "words_sha256", "words"])

    every = docs.select("doc_id", "text").mapInArrow(f, "doc_id long, words_sha256 binary, words binary")
    return every.groupBy("words_sha256", "words").agg(F.min("doc_id").alias("first_id")).select(F.monotonically_increasing_id().alias("row"), "words_sha256", "first_id", "words")


def _split(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split(b" ")


def anchors(texts: DataFrame) -> DataFrame:
    """(anchor, row, pos): hashes of ANCHOR words at cover positions."""

    def f(row, packed):
        words = _split(packed)
        pos = np.flatnonzero(_on_cover[np.arange(len(words) - ANCHOR + 1) % PERIOD])
        h = window_hashes(word_hashes(words), ANCHOR, BASES[0])[pos]
        return h.view(np.int64), np.full(len(pos), row), pos

    schema = pa.schema([("anchor", pa.int64()), ("row", pa.int64()), ("pos", pa.int32())])
    return texts.select("row", "words").mapInArrow(_exploded(["row", "words"], schema, f), "anchor long, row long, pos int")


def candidate_windows(candidates: DataFrame) -> DataFrame:
    """(h1, h2, row, first_id, start) of every window that contains a shared anchor."""

    def f(row, first_id, packed, pos):
        words = _split(packed)
        hashes, n = word_hashes(words), len(words) - WINDOW + 1
        edge = np.zeros(n + 1, np.int64)
        at = np.array(pos)
        np.add.at(edge, np.maximum(at - (WINDOW - ANCHOR), 0), 1)
        np.add.at(edge, np.minimum(at, n - 1) + 1, -1)
        start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        h1, h2 = (window_hashes(hashes, WINDOW, b)[start].view(np.int64) for b in BASES)
        return h1, h2, np.full(len(start), row), np.full(len(start), first_id), start

    long = pa.int64()
    schema = pa.schema([("h1", long), ("h2", long), ("row", long), ("first_id", long), ("start", pa.int32())])
    return candidates.mapInArrow(_exploded(["row", "first_id", "words", "pos"], schema, f), "h1 long, h2 long, row long, first_id long, start int")


def _spans(covered: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def kept_words(candidates: DataFrame) -> DataFrame:
    """(words_sha256, n_removed, kept_sha256, removed) of (words_sha256, words, starts of covered windows)."""
    names = ("words_sha256", "n_removed", "kept_sha256", "removed")

    def f(digest: list, packed: list, starts: list) -> dict:
        out = {k: [] for k in names}
        for d, p, s in zip(digest, packed, starts, strict=True):
            words = _split(p)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, np.array(s), 1)
            np.add.at(edge, np.array(s) + WINDOW, -1)
            covered = np.cumsum(edge[:-1]) > 0
            kept = b" ".join(w for w, gone in zip(words, covered.tolist(), strict=True) if not gone)
            for k, v in zip(names, (d, int(covered.sum()), hashlib.sha256(kept).hexdigest(), _spans(covered)), strict=True):
                out[k].append(v)
        return out

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema(zip(names, (pa.binary(), pa.int64(), pa.string(), spans), strict=True))
    ddl = "words_sha256 binary, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    return candidates.mapInArrow(rows_udf(["words_sha256", "words", "starts"], schema, f), ddl)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (spans of word numbers, end exclusive) of every row of docs."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text")
    base = word_digests(docs)
    texts = cut(distinct_texts(docs))

    every = cut(anchors(texts))
    shared = cut(every.groupBy("anchor").agg(F.min("row").alias("a"), F.max("row").alias("b")).filter("a != b").select("anchor"))
    places = cut(every.join(shared, "anchor").groupBy("row").agg(F.collect_list("pos").alias("pos")))
    discard(every, shared)
    candidates = cut(texts.join(places, "row"))
    discard(places)

    # windows whose first holder comes before some other
    windows = cut(candidate_windows(candidates.select("row", "first_id", "words", "pos")))
    earliest = windows.groupBy("h1", "h2").agg(F.min("first_id").alias("earliest"), F.max("first_id").alias("latest"))
    earliest = cut(earliest.filter("earliest != latest").drop("latest"))
    starts = cut(windows.join(earliest, ["h1", "h2"]).filter("first_id > earliest").groupBy("row").agg(F.collect_list("start").alias("starts")))
    discard(windows, earliest)
    changed = kept_words(candidates.join(starts, "row").select("words_sha256", "words", "starts"))
    # what is said of a text, for the texts of which anything is said: rows join it by their digests
    said = cut(texts.select("words_sha256", "first_id").join(changed, "words_sha256", "left"))
    discard(texts, candidates, starts)

    copy = F.col("doc_id") != F.col("first_id")  # null where the text has no window
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    return base.join(said, "words_sha256", "left").select(
        F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("words_sha256")))).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("removed", F.array().cast("array<struct<start:long,end:long>>"))).alias("removed"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return remove_repeats(documents(spark, sf_dir)).drop("removed")
