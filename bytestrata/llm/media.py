"""ISO media containers in a column: written, walked and indexed without decoding what they hold.

`mux` stores bytes as samples of one track; `walk` and `probe` read a container's nested boxes and sample tables and give the
codec, the duration and the byte ranges of the key frames, as any reader of the format would: sizes from stsz, chunks from
stsc and stco or co64, times from stts, sync samples from stss. The payload bytes are located, never decoded.

Defined cases: null counts as the empty text, and an empty text is stored as one block of zero bytes; texts may be of any length
(64-bit box sizes and chunk offsets are used where 32 bits do not do); rows that repeat give equal values, since nothing but the
text enters a container; a container that is broken or empty gives a `status` and nulls instead of an exception; empty tables
give empty results; other columns, whatever their names, stay unread.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bytestrata.llm.common import bounded_batches, documents, rows_udf

#: Payload bytes of a sample, samples of a chunk, samples from one key frame to the next; media time units a second and a sample.
SAMPLE, CHUNK, KEY_EVERY, TIMESCALE, TICKS = 64, 256, 16, 8000, 64
CODEC = b"raw "
#: Boxes that hold boxes.
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
UNITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class MediaError(ValueError):
    """A container whose boxes or tables contradict each other."""


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)
    return struct.pack(">I4s", size, kind) + b"".join(parts)


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(text: bytes) -> bytes:
    """text and zero bytes up to a positive multiple of SAMPLE."""
    return text + bytes(-len(text) % SAMPLE or (0 if text else SAMPLE))


def mux(payload: bytes) -> bytes:
    """A file with one audio track of 8-bit samples, grouped SAMPLE bytes to a table entry; len(payload) is a multiple of SAMPLE."""
    n = len(payload) // SAMPLE
    chunks = -(-n // CHUNK)
    wide = len(payload) + 4 * n > 0xF0000000
    ticks = n * TICKS
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    runs = [(1, CHUNK)] * (n >= CHUNK) + [(chunks, n % CHUNK)] * bool(n % CHUNK)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")

    def moov(first: int) -> bytes:
        starts = (first + np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK * SAMPLE)).astype(">u8" if wide else ">u4")
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, TICKS)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, count, 1) for at, count in runs)),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), starts.tobytes()),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1)
        mdia = box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), UNITY, bytes(8), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, ticks), struct.pack(">IH", 0x10000, 0x100), bytes(10), UNITY, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    return b"".join((ftyp, moov(len(ftyp) + len(moov(0)) + head), box(b"mdat", payload)))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start and end of its body) of every box, parents before what they hold."""
    end = len(data) if end is None else end
    at = start
    while at < end:
        if at + 8 > end:
            raise MediaError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise MediaError("a box header is cut off")
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise MediaError(f"box {kind!r} does not fit into what holds it")
        yield (*path, kind), at + head, at + size
        if kind in PARENTS:
            yield from walk(data, at + head, at + size, (*path, kind))
        at += size


def _array(data: bytes, at: int, end: int, columns: int, kind: str) -> np.ndarray:
    """A table with a count before it."""
    if at + 8 > end:
        raise MediaError("a table is cut off")
    (n,) = struct.unpack_from(">I", data, at + 4)
    if at + 8 + n * columns * np.dtype(kind).itemsize > end:
        raise MediaError("a table is longer than its box")
    return np.frombuffer(data, kind, n * columns, at + 8).astype(np.int64).reshape(n, columns)


def probe(data: bytes) -> dict:
    """codec, timescale, duration (in it), offsets and sizes of all samples, and indices of the key frames, of the first track."""
    if not data:
        raise MediaError("an empty container")
    at: dict[bytes, tuple[int, int]] = {}
    for path, start, end in walk(data):
        at.setdefault(path[-1], (start, end))
    for kind in (b"mdhd", b"stsd", b"stts", b"stsc", b"stsz"):
        if kind not in at:
            raise MediaError(f"no box {kind!r}")
    start, end = at[b"mdhd"]
    form = ">QQIQ" if data[start] == 1 else ">IIII"
    if start + 4 + struct.calcsize(form) > end:
        raise MediaError("box b'mdhd' is cut off")
    _, _, timescale, duration = struct.unpack_from(form, data, start + 4)
    start, end = at[b"stsd"]
    codec = data[start + 12 : start + 16].decode("latin-1")
    start, end = at[b"stsz"]
    if start + 12 > end:
        raise MediaError("box b'stsz' is cut off")
    size, n = struct.unpack_from(">II", data, start + 4)
    sizes = np.full(n, size, np.int64) if size else _array(data, start + 4, end, 1, ">u4")[:, 0]
    if b"co64" in at:
        chunks = _array(data, *at[b"co64"], 1, ">u8")[:, 0]
    elif b"stco" in at:
        chunks = _array(data, *at[b"stco"], 1, ">u4")[:, 0]
    else:
        raise MediaError("no chunk offsets")
    runs = _array(data, *at[b"stsc"], 3, ">u4")
    counts = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1))) if len(runs) else np.zeros(0, np.int64)
    if counts.sum() != n or len(counts) != len(chunks):
        raise MediaError("the chunks do not hold the samples")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(counts) - counts
    offsets = np.repeat(chunks, counts) + before - np.repeat(before[first], counts) if n else before
    if n and int((offsets + sizes).max()) > len(data):
        raise MediaError("a sample lies beyond the end")
    times = _array(data, *at[b"stts"], 2, ">u4")
    if times[:, 0].sum() != n:
        raise MediaError("the times do not fit the samples")
    keys = _array(data, *at[b"stss"], 1, ">u4")[:, 0] - 1 if b"stss" in at else np.arange(n)
    return {"codec": codec, "timescale": timescale, "duration": duration, "offsets": offsets, "sizes": sizes, "keys": keys, "ticks": int((times[:, 0] * times[:, 1]).sum())}


def read_back(data: bytes, found: dict) -> bytes:
    """The samples' bytes in their order; neighbours are read together."""
    offsets, sizes = found["offsets"], found["sizes"]
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != (offsets + sizes)[:-1]) + 1
    starts = offsets[np.concatenate([[0], breaks])].tolist()
    ends = (offsets + sizes)[np.concatenate([breaks - 1, [len(offsets) - 1]])].tolist()
    return b"".join(data[a:b] for a, b in zip(starts, ends, strict=True))


def key_ranges(found: dict) -> list[dict[str, int]]:
    """Byte range of each key frame."""
    return [{"offset": a, "length": b} for a, b in zip(found["offsets"][found["keys"]].tolist(), found["sizes"][found["keys"]].tolist(), strict=True)]


_RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): every whole text as a container."""
    bounded_batches(docs.sparkSession)

    def f(doc_id: list, text: list) -> dict:
        raw = [(t or "").encode() for t in text]
        return {"doc_id": doc_id, "n_bytes": [*map(len, raw)], "media": [mux(padded(x)) for x in raw]}

    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return docs.select("doc_id", "text").mapInArrow(rows_udf(["doc_id", "text"], out, f), "doc_id long, n_bytes long, media binary")


def index(media: DataFrame, id_column: str = "doc_id", column: str = "media") -> DataFrame:
    """(doc_id, status, codec, duration_s, n_samples, key_frames array of byte ranges) of containers from any writer."""
    bounded_batches(media.sparkSession)

    def f(doc_id: list, data: list) -> dict:
        out = {k: [] for k in ("status", "codec", "duration_s", "n_samples", "key_frames")}
        for x in data:
            try:
                p = probe(x or b"")
                row = ("ok", p["codec"], p["duration"] / p["timescale"] if p["timescale"] else None, len(p["sizes"]), key_ranges(p))
            except (MediaError, struct.error, IndexError, ValueError) as e:
                row = (f"broken: {e}", None, None, None, None)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return {"doc_id": doc_id} | out

    schema = pa.schema([("doc_id", pa.int64()), ("status", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("key_frames", _RANGES)])
    ddl = "doc_id long, status string, codec string, duration_s double, n_samples long, key_frames array<struct<offset:long,length:long>>"
    return media.select(media[id_column].alias("doc_id"), media[column].alias("media")).mapInArrow(rows_udf(["doc_id", "media"], schema, f), ddl)


def digests(media: DataFrame) -> DataFrame:
    """The containers of store(), read back through their own tables: digests, and a feature of codec, duration and key frames."""
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "key_frames")

    def f(doc_id: list, n_bytes: list, data: list) -> dict:
        out = {k: [] for k in names}
        for x in data:
            p = probe(x)
            payload = read_back(x, p)
            keys = ",".join(f"{a}+{b}" for a, b in zip(p["offsets"][p["keys"]].tolist(), p["sizes"][p["keys"]].tolist(), strict=True))
            feature = f"codec={p['codec'].strip()};duration={p['duration']}/{p['timescale']};samples={len(p['sizes'])};keyframes={len(p['keys'])};ranges_crc32={zlib.crc32(keys.encode())}"
            for k, v in zip(names, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(x), hashlib.sha256(x).hexdigest(), feature, key_ranges(p)), strict=True):
                out[k].append(v)
        return {"doc_id": doc_id, "n_bytes": n_bytes} | out

    long, text = pa.int64(), pa.string()
    schema = pa.schema([("doc_id", long), ("n_bytes", long), *zip(names, (long, text, long, long, text, text, _RANGES), strict=True)])
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, key_frames array<struct<offset:long,length:long>>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(rows_udf(["doc_id", "n_bytes", "media"], schema, f), ddl)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, key_frames of every document."""
    return digests(store(documents(spark, sf_dir)))
