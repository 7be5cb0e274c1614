"""Entropy segmentation: where a stream of bytes is cut so that order-1 models of both sides together are cheaper."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bytestrata.operators.profile import LOG_BITS, LOG_ENTRIES, log_table

#: Bytes pulled at a time; least bytes of a part; what a cut has to gain: a 32nd of the cost and 1 KB, in units of 1/4096 bit.
PULL, LEAST, GAIN_SHIFT, GAIN = 1 << 20, 512, 5, 1 << 25
_LOG = log_table()


def _mass(n: np.ndarray) -> np.ndarray:
    """n * log2(n); numbers above the table are halved into it."""
    k = np.maximum(0, np.frexp(n.astype(float))[1] - (LOG_ENTRIES.bit_length() - 1))
    return n * (_LOG[n >> k] + (k << LOG_BITS))


def _occurrence(x: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return out


def prefix_costs(context: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Cost of the first n bytes for each n: a byte adds a step to its context's total and takes one from its cell's."""
    steps = np.zeros(len(context), np.int64)
    for sign, x in ((1, context), (-1, cell)):
        k = _occurrence(x)
        steps += sign * (_mass(k + 1) - _mass(k))
    return np.concatenate([[0], np.cumsum(steps)])


def best_cut(data: bytes) -> int:
    """Length of the first part; all of it where no cut gains enough."""
    n = len(data)
    if n < 2 * LEAST:
        return n
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    before, second = np.concatenate([[0], b[:-1]]), np.concatenate([[0, 0], b[:-2]])
    context = (32 * second + before) & 255
    cell = context * 256 + b
    left, right = prefix_costs(context, cell), prefix_costs(context[::-1], cell[::-1])[::-1]
    total = (left + right)[LEAST : n - LEAST + 1]
    at = int(np.argmin(total))
    whole = int(left[-1])
    return LEAST + at if total[at] < whole - (whole >> GAIN_SHIFT) - GAIN else n


def segments(data: bytes, pull: int = PULL, forced: Callable[[bytes], int | None] | None = None) -> Iterator[bytes]:
    """Parts of data: a buffer of at most `pull` bytes is cut, and what the cut leaves goes back into the next buffer. `forced` may name the
    length of a part, as for a media span."""
    at = 0
    while at < len(data):
        buffer = data[at : at + pull]
        size = forced(buffer) if forced else None
        size = size if size and 0 < size <= len(buffer) else best_cut(buffer)
        yield buffer[:size]
        at += size


def segment_documents(docs: DataFrame, pull: int = PULL) -> DataFrame:
    """(doc_id, part, off, bytes): parts of each whole text."""

    def run(batches):
        for b in batches:
            rows = {"doc_id": [], "part": [], "off": [], "bytes": []}
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                off = 0
                for k, part in enumerate(segments((t or "").encode(), pull)):
                    for c, v in zip(rows, (i, k, off, part), strict=True):
                        rows[c].append(v)
                    off += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(rows["part"], pa.int64()), pa.array(rows["off"], pa.int64()), pa.array(rows["bytes"], pa.binary())], ["doc_id", "part", "off", "bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part long, off long, bytes binary")
