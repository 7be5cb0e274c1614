"""Checksums of byte columns: JVM functions where there are any, numpy over Arrow batches elsewhere."""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Reflected polynomials of CRC-64/XZ and CRC-16/ARC.
CRC64_POLYNOMIAL, CRC16_POLYNOMIAL = 0xC96C5795D7870F42, 0xA001
PIECE = 256
_ALL = (1 << 64) - 1


@functools.cache
def crc_table(polynomial: int) -> np.ndarray:
    x = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        x = np.where(x & np.uint64(1), (x >> np.uint64(1)) ^ np.uint64(polynomial), x >> np.uint64(1))
    return x


@functools.cache
def zeros_operator(n: int, polynomial: int = CRC64_POLYNOMIAL) -> np.ndarray:
    """Tables (8, 256) of the linear map that n zero bytes are to a CRC register."""
    if n == 0:
        return np.stack([np.arange(256, dtype=np.uint64) << np.uint64(8 * k) for k in range(8)])
    if n == 1:
        t = crc_table(polynomial)
        first = t.copy()
        return np.stack([first, *(np.arange(256, dtype=np.uint64) << np.uint64(8 * (k - 1)) for k in range(1, 8))])
    half, rest = zeros_operator(n // 2, polynomial), zeros_operator(n % 2, polynomial)
    return apply_operator(rest, apply_operator(half, half))


def apply_operator(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for k in range(8):
        out ^= tables[k][((x >> np.uint64(8 * k)) & np.uint64(255)).astype(np.intp)]
    return out


def crc64_combine(a: int, b: int, length: int) -> int:
    """The CRC of two pieces in a row from theirs and the second one's length."""
    shifted = np.array([a], np.uint64)
    power, bit = length, 0
    while power:
        if power & 1:
            shifted = apply_operator(zeros_operator(1 << bit), shifted)
        power >>= 1
        bit += 1
    return int(shifted[0]) ^ b


def _registers(payloads: list[bytes], polynomial: int) -> np.ndarray:
    """Of a register that starts at zero: all pieces of all payloads advance a byte at a time together and are combined in order."""
    count = np.array([max(1, -(-len(p) // PIECE)) for p in payloads], np.int64)
    first = np.cumsum(count) - count
    # pieces stand flush right, so only a payload's first piece has leading zeros, which a zero register ignores
    body = np.zeros((int(count.sum()), PIECE), np.uint8)
    for p, at, n in zip(payloads, first, count, strict=True):
        body[at : at + n].reshape(-1)[n * PIECE - len(p) :] = np.frombuffer(p, np.uint8)
    table, register = crc_table(polynomial), np.zeros(len(body), np.uint64)
    for k in range(PIECE):
        register = table[((register ^ body[:, k]) & np.uint64(255)).astype(np.intp)] ^ (register >> np.uint64(8))
    out, step = np.zeros(len(payloads), np.uint64), zeros_operator(PIECE, polynomial)
    for k in range(int(count.max()) if len(count) else 0):
        live = np.flatnonzero(count > k)
        out[live] = apply_operator(step, out[live]) ^ register[first[live] + k]
    return out


def crc64_many(payloads: Iterable[bytes]) -> np.ndarray:
    """CRC-64/XZ of each payload."""
    payloads = list(payloads)
    # the start value of all ones is a constant for each length
    ones = np.array([crc64_combine(_ALL, 0, len(p)) for p in payloads], np.uint64)
    return _registers(payloads, CRC64_POLYNOMIAL) ^ ones ^ np.uint64(_ALL)


@F.pandas_udf(T.LongType())
def crc64(payload: pd.Series) -> pd.Series:
    """CRC-64/XZ as a signed 64-bit pattern; null stays null."""
    found = crc64_many([x or b"" for x in payload]).view(np.int64)
    return pd.Series(found, dtype="Int64").where(payload.notna().to_numpy())


@F.pandas_udf(T.IntegerType())
def crc16(payload: pd.Series) -> pd.Series:
    """CRC-16/ARC, which starts at zero; null stays null."""
    out = _registers([x or b"" for x in payload], CRC16_POLYNOMIAL).astype(np.int64)
    return pd.Series(out, dtype="Int64").where(payload.notna().to_numpy())


@F.pandas_udf(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
def fletcher(payload: pd.Series) -> pd.DataFrame:
    """Sums of the bytes and of the bytes weighted by how many are left, both modulo 255."""
    out = np.zeros((len(payload), 2), np.int64)
    for k, x in enumerate(payload):
        v = np.frombuffer(x or b"", np.uint8).astype(np.int64)
        out[k] = v.sum() % 255, (v * (np.arange(len(v), 0, -1) % 255)).sum() % 255
    return pd.DataFrame(out, columns=["a", "b"])


def crc32(payload: Column) -> Column:
    return F.crc32(payload)
