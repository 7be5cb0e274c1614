"""Reversible byte transforms whose state runs along the block. encode returns None where a transform declines; pairs undo each other."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from bytestrata.operators.codecs import get_varint, put_varint

#: Tags that have no closing tag of their own, so they are never expected.
VOID_TAGS = frozenset((b"br", b"hr", b"img", b"meta", b"link", b"input", b"area", b"base", b"col", b"wbr"))
DEPTH, TAG_LENGTH, LEAST_HTML = 128, 16, 16
_OPEN = re.compile(rb"<([A-Za-z][A-Za-z0-9]*)[^<>]*>|</")
_CLOSED = re.compile(rb"([A-Za-z][A-Za-z0-9]*)>")
_BACK = re.compile(rb"<([A-Za-z][A-Za-z0-9]*)[^<>]*>|<//|</")


def _push(stack: list[bytes], whole: bytes, name: bytes) -> None:
    if not whole.endswith(b"/>") and name.lower() not in VOID_TAGS and len(name) <= TAG_LENGTH:
        stack.append(name)
        del stack[:-DEPTH]


def html_elide(data: bytes) -> bytes | None:
    """A closing tag that names the innermost open one becomes '</' alone; every other '</' becomes '<//'."""
    if len(data) < LEAST_HTML:
        return None
    out, at, stack = [], 0, []
    while m := _OPEN.search(data, at):
        out.append(data[at : m.start()])
        at = m.end()
        if m[1]:
            out.append(m[0])
            _push(stack, m[0], m[1])
            continue
        close = _CLOSED.match(data, at)
        if close and stack and close[1] == stack[-1]:
            out.append(b"</")
            stack.pop()
            at = close.end()
            # what follows must not read as the mark of a tag that was kept
            if data[at : at + 1] == b"/":
                out.append(b"\\")
            elif data[at : at + 1] == b"\\":
                out.append(b"\\")
        else:
            out.append(b"<//")
    return b"".join((*out, data[at:]))


def html_restore(data: bytes) -> bytes:
    out, at, stack = [], 0, []
    while m := _BACK.search(data, at):
        out.append(data[at : m.start()])
        at = m.end()
        if m[1]:
            out.append(m[0])
            _push(stack, m[0], m[1])
        elif m[0] == b"<//":
            out.append(b"</")
        else:
            out += (b"</", stack.pop(), b">")
            if data[at : at + 1] == b"\\":
                at += 1
    return b"".join((*out, data[at:]))


def line_rle(data: bytes, most: int = 31) -> bytes:
    """Each line begins with a byte: how many bytes it shares with the line before it."""
    out, before = [], b""
    for line in data.split(b"\n"):
        n, bound = 0, min(len(line), len(before), most)
        while n < bound and line[n] == before[n]:
            n += 1
        out.append(bytes((n + 32 if n >= 10 else n,)) + line[n:])
        before = line
    return b"\n".join(out)


def line_unrle(data: bytes) -> bytes:
    out, before, at = [], b"", 0
    while True:
        n = data[at]
        end = data.find(b"\n", at + 1)
        before = before[: n - 32 if n >= 42 else n] + data[at + 1 : end if end >= 0 else len(data)]
        out.append(before)
        if end < 0:
            return b"\n".join(out)
        at = end + 1


def crlf_collapse(data: bytes) -> bytes:
    """CRLF becomes LF; carriage returns and line feeds that stand alone are listed: their numbers among all, as differences."""
    alone = re.compile(rb"\r\n|\r|\n")
    exceptions, last, k = bytearray(), -1, 0
    for k, m in enumerate(alone.finditer(data)):
        if m[0] != b"\r\n":
            exceptions += put_varint((k - last) * 2 + (m[0] == b"\r"))
            last = k
    return put_varint(len(exceptions)) + bytes(exceptions) + alone.sub(b"\n", data)


def crlf_expand(data: bytes) -> bytes:
    size, at = get_varint(data, 0)
    end, last, kind = at + size, -1, {}
    while at < end:
        x, at = get_varint(data, at)
        last += x >> 1
        kind[last] = b"\r" if x & 1 else b"\n"
    lines = data[end:].split(b"\n")
    out = [lines[0]]
    for k, line in enumerate(lines[1:]):
        out += (kind.get(k, b"\r\n"), line)
    return b"".join(out)


def number_split(data: bytes) -> bytes:
    """Digits as 0 and, before them, the numbers: a varint for each run of digits, its leading zeros kept by a one in front."""
    values, n = bytearray(), 0
    for m in re.finditer(rb"[0-9]{1,17}", data):
        values += put_varint(int(b"1" + m[0]))
        n += 1
    return put_varint(n) + put_varint(len(values)) + bytes(values) + re.sub(rb"[0-9]", b"0", data)


def number_join(data: bytes) -> bytes:
    _, at = get_varint(data, 0)
    size, at = get_varint(data, at)
    end = at + size

    def value(m: re.Match) -> bytes:
        nonlocal at
        x, at = get_varint(data, at)
        return str(x)[1:].encode()

    return re.sub(rb"0{1,17}", value, data[end:])


#: A comma or full stop before a word.
_BEFORE_WORD = rb"([.,])%s(?=[^ \x00-\x1f!-/:-@\[-`{-\x7f])"


def space_drop(data: bytes) -> bytes:
    """The space between a comma or a full stop and a word goes; where none stands there a mark does; marks of the text are doubled."""
    data = data.replace(b"\x01", b"\x01\x01")
    data = re.sub(_BEFORE_WORD % b"", lambda m: m[1] + b"\x01\x02", data)
    return re.sub(_BEFORE_WORD % b" ", lambda m: m[1], data)


def space_restore(data: bytes) -> bytes:
    data = re.sub(_BEFORE_WORD % b"", lambda m: m[1] + b" ", data)
    return re.sub(rb"\x01(\x01|\x02)", lambda m: b"\x01" if m[1] == b"\x01" else b"", data)


def x86_absolute(data: bytes, sign: int = 1) -> bytes:
    """Displacements of CALL and JMP (0xE8, 0xE9) to targets near by become positions, modulo 2**24; sign -1 undoes it."""
    out, at, end = bytearray(data), 0, len(data) - 5
    find = re.compile(b"[\xe8\xe9]")
    while (m := find.search(out, at)) and m.start() <= end:
        q = m.start() + 1
        if out[q + 3] in (0, 255):
            value = int.from_bytes(out[q : q + 3], "little") | (out[q + 3] & 1) << 24
            value = value + sign * q & 0x1FFFFFF
            out[q : q + 3] = (value & 0xFFFFFF).to_bytes(3, "little")
            out[q + 3] = 255 if value >> 24 else 0
        at = q + 4
    return bytes(out)


def exe_hits(data: bytes) -> int:
    """How often a CALL or JMP target is one of the four before it."""
    recent, hits, at, end = [0, 0, 0, 0], 0, 0, len(data) - 5
    find = re.compile(b"[\xe8\xe9]")
    while (m := find.search(data, at)) and m.start() <= end:
        q = m.start() + 1
        if data[q + 3] in (0, 255):
            target = q + int.from_bytes(data[q : q + 4], "little", signed=True)
            hits += recent.count(target)
            recent = [target, *recent[:3]]
        at = q + 4
    return hits


def word_rle(data: bytes, least: int = 6) -> bytes:
    """Runs of at least `least` equal 32-bit words: pairs of literal words and runs."""
    n = len(data) // 4
    w = np.frombuffer(data, "<u4", n)
    starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    out, done = bytearray(put_varint(n)), 0
    for a, size in zip(starts[sizes >= least].tolist(), sizes[sizes >= least].tolist(), strict=True):
        out += put_varint(a - done) + w[done : a + 1].tobytes() + put_varint(size)
        done = a + size
    return bytes(out + put_varint(n - done) + w[done:].tobytes() + data[4 * n :])


def word_unrle(data: bytes) -> bytes:
    n, at = get_varint(data, 0)
    out = bytearray()
    while True:
        k, at = get_varint(data, at)
        out += data[at : at + 4 * k]
        at += 4 * k
        if len(out) == 4 * n:
            return bytes(out) + data[at:]
        word = data[at : at + 4]
        size, at = get_varint(data, at + 4)
        out += word * size
        if len(out) == 4 * n:
            k, at = get_varint(data, at)
            return bytes(out) + data[at + 4 * k :]


#: Square numbers of a chess board as one byte each, from 128 on.
_SQUARES = {bytes((97 + k % 8, 49 + k // 8)): 128 + k for k in range(64)}


def chess_tokens(data: bytes) -> bytes | None:
    """Squares of a game's moves as bytes; declines for bytes above 127."""
    if any(c > 127 for c in data):
        return None
    return re.sub(rb"[a-h][1-8]", lambda m: bytes((_SQUARES[m[0]],)), data)


def chess_text(data: bytes) -> bytes:
    names = {v: k for k, v in _SQUARES.items()}
    return b"".join(names.get(c) or bytes((c,)) for c in data)


TRANSFORMS: dict[str, tuple[Callable[[bytes], bytes | None], Callable[[bytes], bytes]]] = {
    "html": (html_elide, html_restore),
    "line_rle": (line_rle, line_unrle),
    "crlf": (crlf_collapse, crlf_expand),
    "numbers": (number_split, number_join),
    "spaces": (space_drop, space_restore),
    "x86": (x86_absolute, lambda d: x86_absolute(d, -1)),
    "word_rle": (word_rle, word_unrle),
    "chess": (chess_tokens, chess_text),
}


def pipeline_encode(data: bytes, names: list[str]) -> tuple[int, bytes]:
    """Applies the transforms in order; one that declines or does not shrink the block is left out. Mask of those applied, and the bytes."""
    mask = 0
    for k, name in enumerate(names):
        found = TRANSFORMS[name][0](data)
        if found is not None and len(found) < len(data):
            mask, data = mask | 1 << k, found
    return mask, data


def pipeline_decode(mask: int, data: bytes, names: list[str]) -> bytes:
    for k, name in reversed([*enumerate(names)]):
        if mask >> k & 1:
            data = TRANSFORMS[name][1](data)
    return data
