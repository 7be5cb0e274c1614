"""Stupid-backoff language-model scores, computed relationally.

A document's words (lower case, without ASCII punctuation) are scored by n-grams of up to `order` words (ORDER in the query) that all other documents hold:
S(w | context) is count(context w) / count(context) if that n-gram occurs elsewhere, else BACKOFF times the score with one word less of
context; a word that occurs nowhere else counts UNSEEN times. A document's own counts are taken off first, so no text vouches for itself.

1. Documents are gathered into numbered blocks of about BLOCK bytes, written once.
2. A block explodes its n-grams into (hash, count), each once, sorted; runs of neighbouring hashes, one for each hash partition of an
   order's count table, make up a row: what a block sends is at most a number for each n-gram it holds, however common that is elsewhere.
3. Each partition of the count table sums its n-grams over the blocks (a group is bounded, since the number of partitions grows with the
   number of n-grams) and is joined back to the blocks' runs, as counts in their order.
4. Orders above 2 come in turns of their own, for n-grams whose first and last n - 1 words both occur in other documents: no
   other n-gram can occur there itself, so nothing is lost, and most of the long tail is never sent.
5. Blocks join their counts to their documents' n-grams, and the logarithms are summed for each document.

Defined cases: null counts as the empty text; a text without words has n_words 0, log_score 0 and a null mean; texts may be of any
length; rows that repeat, and blocks of equal rows, are documents of their own and vouch for each other; one doc_id may stand over
several texts; an empty table gives an empty result; other columns stay unread.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.llm.common import bounded_batches, cut, discard, table, window_hashes, word_hashes
from bytestrata.llm.near_dup import normal_words

ORDER, BACKOFF, UNSEEN = 3, 0.4, 0.5
#: Bytes of words in a block; words of the corpus for a partition of a count table; tasks of a shuffle at most (further partitions share them).
BLOCK, PART, TASKS = 4 << 20, 1 << 20, 1 << 14
BASE = 0xA0761D6478BD642F
_BLOCKS = "n_words long, doc_ids array<long>, lengths array<long>, words binary"
_SENT = "order int, part long, block long, hashes binary, counts binary"
_TOTALS = "array<struct<order:int,part:long,totals:binary>>"


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte of all, compressed: the high bytes take next to nothing."""
    d = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_counts(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def blocks_of(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Documents packed into rows of about `size` bytes of words."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("n_words", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary())])

    def run(batches):
        ids, lengths, joined, held = [], [], [], 0

        def row():
            body = b" ".join(w for w in joined if w)
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(([sum(lengths)], [ids], [lengths], [zstandard.ZstdCompressor(level=1).compress(body)]), schema, strict=True)], schema=schema)

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = normal_words(t)
                ids.append(i)
                lengths.append(len(words))
                joined.append(b" ".join(words))
                held += len(joined[-1])
                if held >= size:
                    yield row()
                    ids, lengths, joined, held = [], [], [], 0
        if ids:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(run, _BLOCKS)


class Block:
    """The words of a block, its documents, and what is known of its n-grams."""

    def __init__(self, lengths: list[int], packed: bytes):
        self.hashes = word_hashes(zstandard.ZstdDecompressor().decompress(packed).split())
        self.lengths = np.array(lengths, np.int64)
        self.doc = np.repeat(np.arange(len(lengths)), self.lengths)
        self.place = np.arange(len(self.hashes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def ngrams(self, n: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Last words and hashes of the n-grams whose n - 1 first and last words occur elsewhere (`before`: how often; None: unknown)."""
        fits = self.place >= n - 1
        if before is not None:
            fits &= before > 0
            fits[1:] &= before[:-1] > 0
        at = np.flatnonzero(fits)
        if not len(at):
            return at, np.zeros(0, np.uint64)
        return at, window_hashes(self.hashes, n, BASE + 2 * n)[at - (n - 1)]

    def elsewhere(self, at: np.ndarray, hashes: np.ndarray, totals: list[bytes]) -> np.ndarray:
        """For each word, how often the n-gram that ends there occurs in other documents."""
        out = np.zeros(len(self.hashes), np.int64)
        if len(at):
            distinct, inverse = np.unique(hashes, return_inverse=True)
            count = np.concatenate([unpack_counts(x) for x in totals])
            assert len(count) == len(distinct), "counts of other n-grams"
            _, own, times = np.unique(inverse * len(self.lengths) + self.doc[at], return_inverse=True, return_counts=True)
            out[at] = count[inverse] - times[own]
        return out

    def known(self, totals: list[dict], order: int) -> list[np.ndarray]:
        """elsewhere() of the orders from 1 to `order`, from (order, part, totals) in this sequence."""
        out: list[np.ndarray] = []
        for n in range(1, order + 1):
            at, hashes = self.ngrams(n, out[-1] if n > 2 else None)
            out.append(self.elsewhere(at, hashes, [x["totals"] for x in totals if x["order"] == n]))
        return out


def exploded(blocks: DataFrame, parts: int, orders: range) -> DataFrame:
    """The blocks' n-grams of these orders with their counts, a row for each partition that they meet."""
    shift = np.uint64(64 - (parts - 1).bit_length()) if parts > 1 else None

    def run(batches):
        for b in batches:
            for block, lengths, words, totals in zip(*(b.column(c).to_pylist() for c in ("block", "lengths", "words", "totals")), strict=True):
                own = Block(lengths, words)
                before = own.known(totals, orders[0] - 1)[-1] if orders[0] > 2 else None
                for n in orders:
                    hashes, counts = np.unique(own.ngrams(n, before)[1], return_counts=True)
                    if not len(hashes):
                        continue
                    part = (hashes >> shift).astype(np.int64) if shift is not None else np.zeros(len(hashes), np.int64)
                    first = np.flatnonzero(np.diff(part, prepend=-1))
                    ends = np.append(first[1:], len(part))
                    runs = [(int(part[a]), pack_sorted(hashes[a:z]), pack_counts(counts[a:z])) for a, z in zip(first, ends, strict=True)]
                    k = len(runs)
                    columns = [pa.array([n] * k, pa.int32()), pa.array([r[0] for r in runs]), pa.array([block] * k, pa.int64()), pa.array([r[1] for r in runs], pa.binary()), pa.array([r[2] for r in runs], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["order", "part", "block", "hashes", "counts"])

    return blocks.select("block", "lengths", "words", "totals").mapInArrow(run, _SENT)


def _sum_part(rows: pa.Table) -> pa.Table:
    """Counts of one partition over all blocks, in the order of each block's run."""
    runs = [unpack_sorted(x) for x in rows.column("hashes").to_pylist()]
    _, inverse = np.unique(np.concatenate(runs), return_inverse=True)
    counts = np.concatenate([unpack_counts(x) for x in rows.column("counts").to_pylist()])
    total = np.bincount(inverse, counts).astype(np.int64)[inverse]
    ends = np.cumsum([len(r) for r in runs])[:-1]
    packed = [pack_counts(x) for x in np.split(total, ends)]
    return pa.table({"order": rows.column("order"), "part": rows.column("part"), "block": rows.column("block"), "totals": pa.array(packed, pa.binary())})


def document_scores(block: Block, totals: list[dict], corpus_words: int, order: int) -> np.ndarray:
    """Sum of ln S for each document of a block."""
    if not len(block.hashes):
        return np.zeros(len(block.lengths))
    elsewhere = block.known(totals, order)
    score = np.maximum(elsewhere[0], UNSEEN) / np.maximum(corpus_words - block.lengths[block.doc], 1)
    for k in range(1, order):
        context = np.concatenate([[0], elsewhere[k - 1][:-1]])
        score = np.where(elsewhere[k] > 0, elsewhere[k] / np.maximum(context, 1), np.where(block.place < k, 1, BACKOFF) * score)
    return np.bincount(block.doc, np.log(score), len(block.lengths))


def _with_totals(blocks: DataFrame, sent: DataFrame, tasks: int) -> DataFrame:
    """blocks with the counts of the n-grams that they sent, behind those they have."""
    sums = sent.repartition(tasks, "order", "part").groupBy("order", "part").applyInArrow(_sum_part, "order int, part long, block long, totals binary")
    found = cut(sums.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("order", "part", "totals"))).alias("more")))
    joined = blocks.join(found, "block", "left").withColumn("totals", F.concat("totals", F.coalesce("more", F.array().cast(_TOTALS)))).drop("more")
    joined = cut(joined)
    discard(found, blocks)
    return joined


def score(docs: DataFrame, block_size: int = BLOCK, part_size: int = PART, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score), a row for each row of docs."""
    numbered = blocks_of(docs, block_size).withColumn("block", F.monotonically_increasing_id()).withColumn("totals", F.array().cast(_TOTALS))
    blocks = cut(numbered)  # a block's number is fixed from here on
    corpus_words = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    parts = 1 << max(0, math.ceil(math.log2(max(1, corpus_words / part_size))))
    for orders in [range(1, min(order, 2) + 1), *(range(n, n + 1) for n in range(3, order + 1))]:
        blocks = _with_totals(blocks, exploded(blocks, parts, orders), min(TASKS, parts * len(orders)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])

    def run(batches):
        for b in batches:
            for ids, lengths, words, totals in zip(*(b.column(c).to_pylist() for c in ("doc_ids", "lengths", "words", "totals")), strict=True):
                found = document_scores(Block(lengths, words), totals, corpus_words, order)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(found)], schema=schema)

    scored = blocks.select("doc_ids", "lengths", "words", "totals").mapInArrow(run, "doc_id long, n_words long, log_score double")
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of every document."""
    return score(table(spark, sf_dir, "documents"), order=ORDER)
