"""Lossless block codecs. A block is one row's bytes; blocks are independent, so they are coded in parallel, and bytes within one in order.

Each codec is a pair (encode, decode) over lists of blocks, so that those which can advance all blocks together do.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Pair = tuple[Callable[[list[bytes]], list[bytes]], Callable[[list[bytes]], list[bytes]]]


def put_varint(x: int) -> bytes:
    """LEB128."""
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def put_varints(x: np.ndarray) -> bytes:
    """put_varint of each number, one after the other."""
    width = np.maximum(1, -(-np.frexp(x.astype(float))[1] // 7)).astype(np.int64)
    first = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    for k in range(int(width.max()) if len(x) else 0):
        own = np.flatnonzero(width > k)
        out[first[own] + k] = (x[own] >> 7 * k & 127) | np.where(width[own] > k + 1, 128, 0)
    return out.tobytes()


def get_varints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127) << 7 * place, first) if len(last) else np.zeros(0, np.int64)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """Value, and where it ends."""
    x = shift = 0
    while True:
        b = data[at]
        at += 1
        x |= (b & 127) << shift
        shift += 7
        if b < 128:
            return x, at


def exp_golomb(values: np.ndarray) -> bytes:
    """Values from 0 on, most significant bit first: as many zeros as the value plus one has bits less one, then those bits."""
    v = values.astype(np.int64) + 1
    bits = np.frexp(v.astype(float))[1].astype(np.int64)
    total = 2 * bits - 1
    ends = np.cumsum(total)
    place = np.arange(int(ends[-1]) if len(v) else 0) - np.repeat(ends - total, total)
    shift = np.repeat(total, total) - 1 - place
    out = np.where(shift < np.repeat(bits, total), (np.repeat(v, total) >> np.minimum(shift, 62)) & 1, 0)
    return put_varint(len(v)) + np.packbits(out.astype(np.uint8)).tobytes()


def exp_golomb_decode(data: bytes) -> np.ndarray:
    n, at = get_varint(data, 0)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=at)).tolist()
    out, k = [], 0
    for _ in range(n):
        zeros = 0
        while not bits[k]:
            zeros += 1
            k += 1
        x = 0
        for b in bits[k : k + zeros + 1]:
            x = 2 * x + b
        k += zeros + 1
        out.append(x - 1)
    return np.array(out, np.int64)


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of an optimal prefix code, none above `most`: counts are halved (rounded up) until the code is shallow enough."""
    counts = counts.astype(np.int64)
    while True:
        heap = [(int(c), s, (s,)) for s, c in enumerate(counts) if c]
        lengths = np.zeros(len(counts), np.int64)
        if len(heap) == 1:
            lengths[heap[0][1]] = 1
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            lengths[list(a[2] + b[2])] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if lengths.max(initial=0) <= most:
            return lengths
        counts = np.where(counts > 0, (counts + 1) // 2, 0)


def huffman_cost(counts: np.ndarray) -> int:
    """Bits that a prefix code of these counts takes."""
    return int((code_lengths(counts, 64) * counts).sum())


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for length, symbol in sorted((int(n), s) for s, n in enumerate(lengths) if n):
        code <<= length - last
        codes[symbol], last = code, length
        code += 1
    return codes


def huffman_encode_block(data: bytes) -> bytes:
    """Length, code lengths of 4 bits each, then the codes."""
    head = put_varint(len(data))
    if not data:
        return head
    b = np.frombuffer(data, np.uint8)
    lengths = code_lengths(np.bincount(b, minlength=256))
    codes = canonical_codes(lengths)
    each = lengths[b]
    ends = np.cumsum(each)
    shift = np.repeat(ends, each) - 1 - np.arange(ends[-1])
    bits = (np.repeat(codes[b], each) >> shift) & 1
    packed = (lengths[::2] << 4 | lengths[1::2]).astype(np.uint8).tobytes()
    return head + packed + np.packbits(bits.astype(np.uint8)).tobytes()


def huffman_decode_block(data: bytes) -> bytes:
    n, at = get_varint(data, 0)
    if not n:
        return b""
    packed = np.frombuffer(data, np.uint8, 128, at).astype(np.int64)
    lengths = np.stack([packed >> 4, packed & 15], 1).ravel()
    codes, widest = canonical_codes(lengths), int(lengths.max())
    symbol, size = np.zeros(1 << widest, np.int64), np.zeros(1 << widest, np.int64)
    for s in np.flatnonzero(lengths):
        first = codes[s] << (widest - lengths[s])
        symbol[first : first + (1 << (widest - lengths[s]))] = s
        size[first : first + (1 << (widest - lengths[s]))] = lengths[s]
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=at + 128)).astype(np.int64)
    bits = np.concatenate([bits, np.zeros(widest, np.int64)])
    window = np.zeros(len(bits) - widest + 1, np.int64)
    for k in range(widest):
        window = window * 2 + bits[k : k + len(window)]
    step, out, at = size[window].tolist(), [], 0
    for _ in range(n):
        out.append(at)
        at += step[at]
    return symbol[window[out]].astype(np.uint8).tobytes()


def bwt(data: bytes) -> tuple[bytes, int]:
    """The byte before each sorted rotation, and the rank of the text itself; ranks by prefix doubling, ties of periodic texts by place."""
    n = len(data)
    if n == 0:
        return b"", 0
    b = np.frombuffer(data, np.uint8)
    rank, step = b.astype(np.int64), 1
    while True:
        key = rank * (n + 256) + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        step *= 2
        if step >= n or rank[order[-1]] == n - 1:
            break
    return b[order - 1].tobytes(), int(np.flatnonzero(order == 0)[0])


def inverse_bwt(last: bytes, primary: int) -> bytes:
    """Walks the permutation; in a periodic text the cycle of `primary` comes round as often as it has to."""
    if not last:
        return b""
    b = np.frombuffer(last, np.uint8)
    follow, at, out = np.argsort(b, kind="stable").tolist(), primary, []
    for _ in range(len(last)):
        at = follow[at]
        out.append(at)
    return b[out].tobytes()


def mtf(data: bytes) -> bytes:
    table, out = list(range(256)), bytearray()
    for c in data:
        k = table.index(c)
        out.append(k)
        if k:
            del table[k]
            table.insert(0, c)
    return bytes(out)


def inverse_mtf(ranks: bytes) -> bytes:
    table, out = list(range(256)), bytearray()
    for k in ranks:
        c = table[k]
        out.append(c)
        if k:
            del table[k]
            table.insert(0, c)
    return bytes(out)


def rle(data: bytes) -> bytes:
    """Runs of three and more: three bytes and how many follow (0 to 255)."""
    b = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    out = bytearray()
    for a, n in zip(starts.tolist(), np.diff(np.append(starts, len(b))).tolist(), strict=True):
        while n >= 3:
            more = min(n - 3, 255)
            out += data[a : a + 1] * 3 + bytes((more,))
            n -= 3 + more
        out += data[a : a + 1] * n
    return bytes(out)


def unrle(data: bytes) -> bytes:
    out, k, run, last = bytearray(), 0, 0, -1
    while k < len(data):
        c = data[k]
        k += 1
        out.append(c)
        run = run + 1 if c == last else 1
        last = c
        if run == 3:
            out += bytes((c,)) * data[k]
            k += 1
            run, last = 0, -1
    return bytes(out)


def lz_tokens(data: bytes, least: int = 4, most: int = 4096) -> tuple[list[tuple[int, int, int]], bytes]:
    """(literal run, selector, raw length) rows and the literals. Selectors 0 to 3 repeat one of the last four offsets, others hold the
    offset plus 3; raw lengths leave out the shortest match that the offset allows."""
    n = len(data)
    earlier = previous_places(data)
    places = np.flatnonzero(earlier >= 0)  # where a match can begin
    sizes = common_lengths(data, earlier[places], places).tolist()
    earlier, candidates, k = earlier.tolist(), places.tolist(), 0
    recent, tokens, literals, done = [1, 1, 1, 1], [], bytearray(), 0
    while k < len(candidates):
        at = candidates[k]
        found = earlier[at]
        size = sizes[k]
        if size == STEPS:  # it may go on
            step, bound = 256, min(n - at, most)
            while size < bound and step:
                if size + step <= bound and data[found + size : found + size + step] == data[at + size : at + size + step]:
                    size += step
                else:
                    step //= 2
        offset = at - found
        minimum = 2 if offset in recent else 4 + (offset > 0x4FF) + (offset > 0x63FF)
        if size < max(minimum, least):
            k += 1
            continue
        literals += data[done:at]
        if offset in recent:
            i = recent.index(offset)
            tokens.append((at - done, i, size - 2))
            del recent[i]
        else:
            tokens.append((at - done, offset + 3, size - minimum))
            recent.pop()
        recent.insert(0, offset)
        done = at + size
        k = bisect.bisect_left(candidates, done, k)
    return tokens, bytes(literals + data[done:])


#: Bytes of a match that are compared for all places at once.
STEPS = 64


def common_lengths(data: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes are equal from places a and from places b > a on, at most STEPS; the first four are."""
    x = np.frombuffer(data, np.uint8)
    out, live = np.full(len(a), 4, np.int64), np.arange(len(a))
    for k in range(4, STEPS):
        live = live[b[live] + k < len(x)]
        live = live[x[a[live] + k] == x[b[live] + k]]
        if not len(live):
            break
        out[live] = k + 1
    return out


def previous_places(data: bytes) -> np.ndarray:
    """For each place, the nearest earlier one where the same four bytes begin, or -1."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = np.full(len(b), -1, np.int64)
    if len(b) >= 5:
        keys = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = order[:-1][same]
    return out


def from_tokens(tokens: list[tuple[int, int, int]], literals: bytes, n: int) -> bytes:
    """Copies may overlap; an offset beyond what is there is refused; the unfilled tail is literal."""
    out, recent, at = bytearray(), [1, 1, 1, 1], 0
    for run, sel, raw in tokens:
        out += literals[at : at + run]
        at += run
        if sel >= 4:
            offset = sel - 3
            size = raw + 4 + (offset > 0x4FF) + (offset > 0x63FF)
            recent.pop()
        else:
            offset, size = recent[sel], raw + 2
            del recent[sel]
        recent.insert(0, offset)
        if not 1 <= offset <= len(out):
            raise ValueError(f"an offset of {offset} at {len(out)}")
        start = len(out) - offset
        if offset >= size:
            out += out[start : start + size]
        else:
            piece = bytes(out[start:])
            out += (piece * (size // offset + 1))[:size]
    out += literals[at : at + n - len(out)]
    return bytes(out)


def lz_encode_block(data: bytes) -> bytes:
    tokens, literals = lz_tokens(data)
    fields = put_varints(np.array(tokens, np.int64).ravel())
    parts = [huffman_encode_block(x) for x in (fields, literals)]
    return put_varint(len(data)) + put_varint(len(tokens)) + b"".join(put_varint(len(x)) + x for x in parts)


def lz_decode_block(data: bytes) -> bytes:
    n, at = get_varint(data, 0)
    count, at = get_varint(data, at)
    parts = []
    for _ in range(2):
        size, at = get_varint(data, at)
        parts.append(huffman_decode_block(data[at : at + size]))
        at += size
    return from_tokens([*map(tuple, get_varints(parts[0]).reshape(count, 3).tolist())], parts[1], n)


def bwt_encode_block(data: bytes) -> bytes:
    last, primary = bwt(data)
    return put_varint(primary) + huffman_encode_block(rle(mtf(last)))


def bwt_decode_block(data: bytes) -> bytes:
    primary, at = get_varint(data, 0)
    return inverse_bwt(inverse_mtf(unrle(huffman_decode_block(data[at:]))), primary)


#: Bytes of a lane of the range coder; bits of a probability; how fast it adapts.
LANE, PROBABILITY, ADAPT = 2048, 12, 4


def _lanes(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bytes of LANE-long pieces of all blocks, their lengths, and the number of pieces of each block."""
    pieces = [b[k : k + LANE] for b in blocks for k in range(0, len(b), LANE)]
    body = np.zeros((len(pieces), LANE), np.uint8)
    for k, p in enumerate(pieces):
        body[k, : len(p)] = np.frombuffer(p, np.uint8)
    return body, np.array([*map(len, pieces)], np.int64), [-(-len(b) // LANE) for b in blocks]


def range_encode(blocks: list[bytes]) -> list[bytes]:
    """Adaptive binary range coder over each byte's bits, in the context of the bits before them; all lanes take a step together."""
    body, lengths, counts = _lanes(blocks)
    n = len(body)
    model = np.full((n, 256), 1 << (PROBABILITY - 1), np.int64)
    low, high = np.zeros(n, np.int64), np.full(n, 0xFFFFFFFF, np.int64)
    out, filled, every = np.zeros((n, 2 * LANE + 16), np.uint8), np.zeros(n, np.int64), np.arange(n)
    for at in range(int(lengths.max(initial=0))):
        live = every[lengths > at]
        context = np.ones(len(live), np.int64)
        for shift in range(7, -1, -1):
            bit = (body[live, at].astype(np.int64) >> shift) & 1
            p = model[live, context]
            mid = low[live] + ((high[live] - low[live]) >> PROBABILITY) * p
            high[live] = np.where(bit == 1, mid, high[live])
            low[live] = np.where(bit == 1, low[live], mid + 1)
            model[live, context] = np.where(bit == 1, p + (((1 << PROBABILITY) - p) >> ADAPT), p - (p >> ADAPT))
            context = 2 * context + bit
            ready = live
            while len(ready := ready[((low[ready] ^ high[ready]) >> 24) == 0]):
                out[ready, filled[ready]] = low[ready] >> 24
                filled[ready] += 1
                low[ready] = (low[ready] << 8) & 0xFFFFFFFF
                high[ready] = ((high[ready] << 8) & 0xFFFFFFFF) | 255
    for k in range(4):
        out[every, filled + k] = (low >> (24 - 8 * k)) & 255
    result, at = [], 0
    for block, count in zip(blocks, counts, strict=True):
        parts = [out[at + k, : filled[at + k] + 4].tobytes() for k in range(count)]
        result.append(put_varint(len(block)) + b"".join(put_varint(len(p)) + p for p in parts))
        at += count
    return result


def range_decode(coded: list[bytes]) -> list[bytes]:
    sizes, lanes, lengths = [], [], []
    for c in coded:
        size, at = get_varint(c, 0)
        sizes.append(size)
        for start in range(0, size, LANE):
            k, at = get_varint(c, at)
            lanes.append(c[at : at + k])
            lengths.append(min(LANE, size - start))
            at += k
    n = len(lanes)
    lengths = np.array(lengths, np.int64)
    body = np.zeros((n, max(map(len, lanes), default=0) + 8), np.int64)
    for k, p in enumerate(lanes):
        body[k, : len(p)] = np.frombuffer(p, np.uint8)
    every, read = np.arange(n), np.full(n, 4, np.int64)
    code = (body[:, 0] << 24 | body[:, 1] << 16 | body[:, 2] << 8 | body[:, 3]) if n else np.zeros(0, np.int64)
    model = np.full((n, 256), 1 << (PROBABILITY - 1), np.int64)
    low, high, out = np.zeros(n, np.int64), np.full(n, 0xFFFFFFFF, np.int64), np.zeros((n, LANE), np.uint8)
    for at in range(int(lengths.max(initial=0))):
        live = every[lengths > at]
        context = np.ones(len(live), np.int64)
        for _ in range(8):
            p = model[live, context]
            mid = low[live] + ((high[live] - low[live]) >> PROBABILITY) * p
            bit = (code[live] <= mid).astype(np.int64)
            high[live] = np.where(bit == 1, mid, high[live])
            low[live] = np.where(bit == 1, low[live], mid + 1)
            model[live, context] = np.where(bit == 1, p + (((1 << PROBABILITY) - p) >> ADAPT), p - (p >> ADAPT))
            context = 2 * context + bit
            ready = live
            while len(ready := ready[((low[ready] ^ high[ready]) >> 24) == 0]):
                low[ready] = (low[ready] << 8) & 0xFFFFFFFF
                high[ready] = ((high[ready] << 8) & 0xFFFFFFFF) | 255
                code[ready] = ((code[ready] << 8) & 0xFFFFFFFF) | body[ready, read[ready]]
                read[ready] += 1
        out[live, at] = context & 255
    result, at = [], 0
    for size in sizes:
        count = -(-size // LANE)
        result.append(b"".join(out[at + k, : lengths[at + k]].tobytes() for k in range(count)))
        at += count
    return result


def each(f: Callable[[bytes], bytes]) -> Callable[[list[bytes]], list[bytes]]:
    return lambda blocks: [f(b) for b in blocks]


CODECS: dict[str, Pair] = {
    "stored": (each(bytes), each(bytes)),
    "huffman": (each(huffman_encode_block), each(huffman_decode_block)),
    "bwt": (each(bwt_encode_block), each(bwt_decode_block)),
    "lz_tokens": (each(lz_encode_block), each(lz_decode_block)),
    "range": (range_encode, range_decode),
    "rle": (each(rle), each(unrle)),
}


def coded(docs: DataFrame, codec: Pair, fallback: bool = True) -> DataFrame:
    """(doc_id, raw_length, stored, block): a block that coding does not make smaller is stored as it is."""
    encode = codec[0]

    def run(batches):
        for b in batches:
            raw = [(t or "").encode() if isinstance(t, str) or t is None else t for t in b.column(1).to_pylist()]
            blocks = encode(raw)
            stored = [fallback and len(c) >= len(r) for c, r in zip(blocks, raw, strict=True)]
            blocks = [r if s else c for c, r, s in zip(blocks, raw, stored, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([*map(len, raw)], pa.int64()), pa.array(stored), pa.array(blocks, pa.binary())], ["doc_id", "raw_length", "stored", "block"])

    return docs.mapInArrow(run, "doc_id long, raw_length long, stored boolean, block binary")


def decoded(blocks: DataFrame, codec: Pair) -> DataFrame:
    """(doc_id, raw_length, coded_length, payload)."""
    decode = codec[1]

    def run(batches):
        for b in batches:
            data, stored = b.column("block").to_pylist(), b.column("stored").to_pylist()
            found = iter(decode([x for x, s in zip(data, stored, strict=True) if not s]))
            payload = [x if s else next(found) for x, s in zip(data, stored, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("raw_length"), pa.array([*map(len, data)], pa.int64()), pa.array(payload, pa.binary())], ["doc_id", "raw_length", "coded_length", "payload"])

    return blocks.mapInArrow(run, "doc_id long, raw_length long, coded_length long, payload binary")


def round_trip(docs: DataFrame, codec: Pair) -> DataFrame:
    """(doc_id, raw_length, coded_length, sha256 of what was decoded): every block goes through the codec itself. Were those that it makes
    larger stored as they are, one block that gains would make a sum of lengths smaller, whatever the codec does to the others."""

    def run(batches):
        for b in batches:
            sha = [hashlib.sha256(x).hexdigest() for x in b.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "raw_length", "coded_length")] + [pa.array(sha)], ["doc_id", "raw_length", "coded_length", "sha256"])

    return decoded(coded(docs, codec, fallback=False), codec).mapInArrow(run, "doc_id long, raw_length long, coded_length long, sha256 string")
