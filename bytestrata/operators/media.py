"""Media in byte content: headers of audio and image files, guesses at headerless samples, and lossless prediction of sample series."""

from __future__ import annotations

import re
import struct

import numpy as np

from bytestrata.operators.codecs import exp_golomb, exp_golomb_decode, get_varint, put_varint


def wav_header(data: bytes) -> dict | None:
    """Channels, width in bytes, rate, and where the samples are, of a PCM file with 1 or 2 channels of 8, 16 or 24 bits."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if kind == b"fmt " and size >= 16 and at + 24 <= len(data):
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        if kind == b"data" and form:
            code, channels, rate, _, _, bits = form
            if code in (1, 0xFFFE) and channels in (1, 2) and bits in (8, 16, 24):
                return {"kind": "wav", "channels": channels, "width": bits // 8, "rate": rate, "start": at + 8, "size": min(size, len(data) - at - 8), "big": False}
            return None
        at += 8 + size + (size & 1)
    return None


def aiff_header(data: bytes) -> dict | None:
    if len(data) < 12 or data[:4] != b"FORM" or data[8:12] != b"AIFF":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "big")
        if kind == b"COMM" and size >= 18 and at + 26 <= len(data):
            channels, _, bits, exponent, mantissa = struct.unpack_from(">HIHHQ", data, at + 8)
            form = channels, bits, mantissa >> max(0, 63 - ((exponent & 0x7FFF) - 16383))
        if kind == b"SSND" and form:
            channels, bits, rate = form
            if channels in (1, 2) and bits in (8, 16, 24):
                return {"kind": "aiff", "channels": channels, "width": bits // 8, "rate": rate, "start": at + 16, "size": min(size - 8, len(data) - at - 16), "big": True}
            return None
        at += 8 + size + (size & 1)
    return None


def bmp_header(data: bytes) -> dict | None:
    """24-bit, or 8-bit with a palette of grays; at least 128 pixels wide and uncompressed."""
    if len(data) < 54 or data[:2] != b"BM":
        return None
    start, head, width, height, planes, bits, method = struct.unpack_from("<IIiiHHI", data, 10)
    height = abs(height)
    if head < 40 or planes != 1 or method or width < 128 or height < 1 or bits not in (8, 24):
        return None
    if bits == 8:
        palette = data[14 + head : 14 + head + 1024]
        if len(palette) < 1024 or any(palette[4 * k] != palette[4 * k + 1] or palette[4 * k] != palette[4 * k + 2] for k in range(256)):
            return None
    return {"kind": "bmp", "width": width, "height": height, "channels": bits // 8, "start": start}


def tga_header(data: bytes) -> dict | None:
    if len(data) < 18 or data[1] != 0 or data[2] not in (2, 3):
        return None
    width, height, bits = struct.unpack_from("<HHB", data, 12)
    if not width or not height or (data[2], bits) not in ((2, 24), (2, 32), (3, 8)) or any(data[3:8]):
        return None
    return {"kind": "tga", "width": width, "height": height, "channels": bits // 8, "start": 18 + data[0]}


_PNM = re.compile(rb"P([56])(?:\s+|\s*#[^\n]*\n\s*)(\d{1,6})(?:\s+|\s*#[^\n]*\n\s*)(\d{1,6})(?:\s+|\s*#[^\n]*\n\s*)(\d{1,5})\s")


def pnm_header(data: bytes) -> dict | None:
    """Binary gray and colour maps; comments may stand between the numbers."""
    m = _PNM.match(data)
    if not m or not 0 < int(m[4]) < 65536 or not int(m[2]) or not int(m[3]):
        return None
    return {"kind": "pgm" if m[1] == b"5" else "ppm", "width": int(m[2]), "height": int(m[3]), "channels": (1 if m[1] == b"5" else 3) * (1 if int(m[4]) < 256 else 2), "start": m.end()}


def tiff_header(data: bytes) -> dict | None:
    """Uncompressed, 8 bits a sample, one or three samples, either byte order."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order or len(data) < 8:
        return None
    (at,) = struct.unpack_from(order + "I", data, 4)
    if at + 2 > len(data):
        return None
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(n):
        if at + 14 + 12 * k > len(data):
            return None
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        tags[tag] = (struct.unpack_from(order + ("H" if kind == 3 else "I"), data, at + 10 + 12 * k)[0], count)
    width, height = (tags.get(t, (0, 0))[0] for t in (256, 257))
    samples = tags.get(277, (1, 1))[0]
    depth, many = tags.get(258, (1, 1))
    if many > 2 and depth + 2 <= len(data):
        (depth,) = struct.unpack_from(order + "H", data, depth)
    if not width or not height or tags.get(259, (1, 1))[0] != 1 or depth != 8 or samples not in (1, 3):
        return None
    return {"kind": "tiff", "width": width, "height": height, "channels": samples, "start": tags.get(273, (8, 1))[0]}


def image_header(data: bytes) -> dict | None:
    """The first of the formats that fits."""
    for f in (bmp_header, pnm_header, tga_header, tiff_header):
        if found := f(data):
            return found
    return None


def executable_header(data: bytes) -> bool:
    return data[:2] == b"MZ" or data[:4] == b"\x7fELF"


def sample_cost(v: np.ndarray) -> int:
    """Bits of all absolute values plus one."""
    return int(np.frexp(np.abs(v).astype(float) + 1)[1].sum())


def guess_samples(block: bytes) -> dict:
    """The cheapest reading of headerless bytes as signed or unsigned samples of 8 or 16 bits, mono or stereo, by the cost of differences."""
    best = None
    for kind in ("<i1", "<u1", "<i2", "<u2", ">i2", ">u2"):
        width = int(kind[2])
        for channels in (1, 2):
            n = len(block) // (width * channels) * channels
            if n < 2 * channels:
                continue
            v = np.frombuffer(block, kind, n).astype(np.int64).reshape(-1, channels)
            cost = sample_cost(np.diff(v, axis=0)) * 1000 // (n * width)
            if best is None or cost < best["cost"]:
                best = {"cost": cost, "format": kind, "channels": channels}
    return best or {"cost": 0, "format": "<u1", "channels": 1}


def implausible(v: np.ndarray, bits: int) -> bool:
    """Whether neighbours differ by more than a quarter of the range on average."""
    return len(v) > 1 and int(np.abs(np.diff(v.astype(np.int64))).sum()) > (len(v) - 1) << (bits - 2)


#: Order of the predictor, bits of its weights' fraction, and how far one sample moves them.
ORDER, FRACTION, STEP = 16, 12, 8


def _predict(history: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (history * weights).sum(1) >> FRACTION


def predict_series(series: list[np.ndarray]) -> list[np.ndarray]:
    """Residuals of a sign-sign LMS predictor in integers; all series advance a sample at a time together."""
    return _run(series, forward=True)


def restore_series(residuals: list[np.ndarray]) -> list[np.ndarray]:
    return _run(residuals, forward=False)


def _run(given: list[np.ndarray], forward: bool) -> list[np.ndarray]:
    n = np.array([*map(len, given)], np.int64)
    order = np.argsort(-n, kind="stable")
    ranked = n[order]
    body = np.zeros((len(given), int(n.max(initial=0))), np.int64)
    for row, k in enumerate(order):
        body[row, : n[k]] = given[k]
    out = np.zeros_like(body)
    history, weights = np.zeros((len(given), ORDER), np.int64), np.zeros((len(given), ORDER), np.int64)
    for t in range(body.shape[1]):
        live = int(np.searchsorted(-ranked, -t, "left"))
        h, w, x = history[:live], weights[:live], body[:live, t]
        p = _predict(h, w)
        residual = x - p if forward else x
        value = x if forward else x + p
        out[:live, t] = residual if forward else value
        w += STEP * np.sign(residual)[:, None] * np.sign(h)
        h[:, 1:] = h[:, :-1].copy()
        h[:, 0] = value
    back = np.empty(len(given), np.int64)
    back[order] = np.arange(len(given))
    return [out[back[k], : n[k]] for k in range(len(given))]


def encode_audio(samples: np.ndarray) -> bytes:
    """(samples, channels) as mid and side series, predicted, zigzagged and Exp-Golomb coded."""
    channels = [samples[:, 0]]
    if samples.shape[1] == 2:
        side = samples[:, 0] - samples[:, 1]
        channels = [samples[:, 1] + (side >> 1), side]
    parts = [exp_golomb((r << 1) ^ (r >> 63)) for r in predict_series(channels)]
    return put_varint(len(parts)) + b"".join(put_varint(len(p)) + p for p in parts)


def decode_audio(data: bytes) -> np.ndarray:
    n, at = get_varint(data, 0)
    parts = []
    for _ in range(n):
        size, at = get_varint(data, at)
        z = exp_golomb_decode(data[at : at + size])
        parts.append((z >> 1) ^ -(z & 1))
        at += size
    series = restore_series(parts)
    if n == 1:
        return series[0][:, None]
    right = series[0] - (series[1] >> 1)
    return np.stack([right + series[1], right], 1)


def gradient_encode(image: np.ndarray) -> np.ndarray:
    """Residuals (y, x, channel) modulo 256 to the rounded mean of the left and the upper neighbour."""
    v = image.astype(np.int64)
    left, above = np.zeros_like(v), np.zeros_like(v)
    left[:, 1:], above[1:] = v[:, :-1], v[:-1]
    return ((v - ((left + above + 1) >> 1)) & 255).astype(np.uint8)


def gradient_decode(residual: np.ndarray) -> np.ndarray:
    """Along the anti-diagonals, on which no value needs another."""
    h, w, _ = residual.shape
    out = np.zeros((h + 1, w + 1, residual.shape[2]), np.int64)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        out[y + 1, x + 1] = (residual[y, x] + ((out[y + 1, x] + out[y, x + 1] + 1) >> 1)) & 255
    return out[1:, 1:].astype(np.uint8)
