"""BPE encoding and decoding with a public vocabulary, exact and in linear time.

Encoding a word walks the longest vocabulary entries that start at each position, which one Aho-Corasick pass has found. An
entry is taken only if it can stand beside the entry before it: a pair can, if no merge with a lower rank than those that
made the two would have joined across their border. Where no entry fits, the walk steps back to a shorter one and marks
the dead position, so no position is tried twice. Decoding gathers bytes from one blob through a table of offsets.

Texts are cut at white space first (no token of this vocabulary spans it), and a bounded memo keeps the ids of pieces that
were seen before.

Defined cases: null counts as the empty text; an empty text has no tokens and decodes to the empty string; texts may be of
any length; rows that repeat are encoded alike; an empty table gives an empty result; columns other than the two that are
named pass by unread, and the result has only the documented columns.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import re
from collections.abc import Callable

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from bytestrata.llm.common import bounded_batches, documents, held, rows_udf

VOCABULARY = "word_bpe_49k.json"
#: Pieces between white space, and words within them, of a generation that a worker remembers; longer ones are not kept.
MEMO, MEMO_LENGTH = 400_000, 64
#: Stands behind the last symbol of a word in place of the vocabulary's word-end suffix.
END = "\0"
#: Characters that str.split() takes for white space and the vocabulary's pattern does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Pieces whose lower case and normal form need no library: characters below U+0180 that are no combination and no special case.
LATIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u0148\u014a-\u017e]+")
#: The vocabulary's pre-tokenizer pattern, for such pieces in lower case.
LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f0-9\xb2\xb3\xb9\xbc-\xbe]+")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    kept = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class WordEncoder:
    """Exact BPE of one word at a time."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        def inner(token: str) -> str:
            return token[: -len(suffix)] + END if token.endswith(suffix) and token != suffix else token

        self.ids = {inner(t): i for t, i in vocab.items()}
        # ranks: symbols of the alphabet first, then the merges in their order
        made = {inner(a) + inner(b): r for r, (a, b) in enumerate(merges)}
        base = [t for t in self.ids if t not in made]
        self.rank = {t: r for r, t in enumerate(base)} | {t: len(base) + r for t, r in made.items()}
        self.token = [""] * (len(base) + len(merges))
        for t, r in self.rank.items():
            self.token[r] = t
        self.left, self.right = [*range(len(self.token))], [*range(len(self.token))]
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            a, b = inner(a), inner(b)
            k = self.rank[a + b]
            self.left[k], self.right[k] = self.rank[a], self.rank[b]
            self.pair[self.rank[a], self.rank[b]] = k
        self.id_bytes = [self.ids[t].to_bytes(4, "little") for t in self.token]
        self.length = [len(t) for t in self.token]
        self.widest = max(self.length)
        self.shorter = [-1] * len(self.token)
        for t, r in self.rank.items():
            self.shorter[r] = next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), -1)
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t, r)
        self.automaton.make_automaton()
        # the longest entry that begins each string of the automaton's trie, -1 where there is none
        self.begins = {"": -1}
        for t in sorted(self.rank):
            for n in range(1, len(t) + 1):
                if t[:n] not in self.begins:
                    self.begins[t[:n]] = self.rank.get(t[:n], self.begins[t[: n - 1]])
        self.compatible = functools.lru_cache(200_000)(self._compatible)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: undo the later merge of the two again and again, and look for one across the border."""
        limit = len(self.token) + 1
        while True:
            joined = self.pair.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b:
                limit, was = a, a
                a = self.right[a]
                if a == was:
                    limit, was = b + 1, b
                    b = self.left[b]
                    if b == was:
                        return True
            else:
                limit, was = b + 1, b
                b = self.left[b]
                if b == was:
                    limit, was = a, a
                    a = self.right[a]
                    if a == was:
                        return True

    def encode(self, word: str) -> bytes:
        """Ids of a word in the byte alphabet, not empty, without a suffix."""
        s, n = word + END, len(word) + 1
        # mostly the longest entries, one after the other, can stand side by side
        out: list[int] = []
        at, length = 0, self.length
        for end, r in self.automaton.iter_long(s):
            if end + 1 - length[r] != at:
                self.walk(s, n, out, at, self.longest(s, at))
                break
            if out and not self.compatible(out[-1], r):
                self.walk(s, n, out, at, self.shorter[r])
                break
            out.append(r)
            at = end + 1
        else:
            if at < n:
                self.walk(s, n, out, at, self.longest(s, at))
        return b"".join(map(self.id_bytes.__getitem__, out))

    def longest(self, s: str, at: int) -> int:
        """The longest entry that starts at a position, or -1: the automaton's trie says how far any entry goes on with these symbols."""
        s = s[at : at + self.widest]
        return self.begins[s[: self.automaton.longest_prefix(s)]]

    def walk(self, s: str, n: int, out: list[int], at: int, r: int) -> None:
        """Go on from the entries in out, which end at a position, with the entry r or shorter ones, and steps back; no position is left twice."""
        length, shorter, compatible, begins, reach, widest = self.length, self.shorter, self.compatible, self.begins, self.automaton.longest_prefix, self.widest
        dead = {n - 1}  # the end mark belongs to the last symbol
        while True:
            last = out[-1] if out else -1
            while r >= 0 and (at + length[r] in dead or last >= 0 and not compatible(last, r)):
                r = shorter[r]
            if r >= 0:
                out.append(r)
                at += length[r]
                if at == n:
                    return
                rest = s[at : at + widest]
                r = begins[rest[: reach(rest)]]
            else:
                dead.add(at)
                r = out.pop()
                at -= length[r]
                r = shorter[r]


class Memo(dict):
    """Ids of the pieces that were seen; others are made when they are asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        return self.make(piece)


class Codec:
    """encode(text) -> ids as little-endian unsigned 32-bit bytes; decode(ids) -> UTF-8 bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.library = Tokenizer.from_file(path)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.words = WordEncoder(model["vocab"], merges, model["end_of_word_suffix"])
        self.alphabet = byte_alphabet()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.as_bytes = str.maketrans({b: c for b, c in enumerate(self.alphabet)})
        # a memo of two generations: when one is full it becomes the old one, and what is still met moves over
        self.memo, self.old = Memo(self.piece), Memo(self.piece)
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        strings = [b""] * size
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            strings[i] = t.encode() + b" "
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.lengths = np.array([*map(len, strings)], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def split(self, text: str) -> bytes:
        """Any text, normalised and split by the library."""
        normal = self.library.normalizer.normalize_str(text)
        return b"".join(self.words.encode(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal))

    def word(self, word: str) -> bytes:
        """A word as the pre-tokenizer leaves it."""
        return self.words.encode(word if word.isascii() else word.encode().decode("latin-1").translate(self.as_bytes))

    def piece(self, piece: str) -> bytes:
        """A piece of text without white space, or a word of one: a word by itself is a piece of one word."""
        ids = self.old.get(piece)
        if ids is None:
            known = self.memo.get
            if piece.isalpha() and (piece.isascii() or LATIN.fullmatch(piece)):
                ids = self.word(piece) if piece.islower() else known(w := piece.lower()) or self.piece(w)
            elif piece[-1] in ".,;:!?" and (w := piece[:-1]).isalpha() and (w.isascii() or LATIN.fullmatch(w)):
                w, mark = w.lower(), piece[-1]
                ids = (known(w) or self.piece(w)) + (known(mark) or self.piece(mark))
            elif LATIN.fullmatch(piece):
                words = LATIN_WORDS.findall(piece.lower())
                if words == [piece]:
                    ids = self.word(piece)
                else:
                    ids = b"".join([known(w) or self.piece(w) for w in words])
            else:
                ids = self.split(piece)
        if len(piece) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO:
                self.old, self.memo = self.memo, Memo(self.piece)
            self.memo[piece] = ids
        return ids

    def plain(self, text: str) -> bytes:
        if any(c in text for c in SEPARATORS):
            return self.split(text)
        return b"".join(map(self.memo.__getitem__, text.split()))

    def encode(self, text: str) -> bytes:
        if "<|" in text and self.special_pattern.search(text):
            return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self.plain(x) for x in self.special_pattern.split(text))
        return self.plain(text)

    def decode(self, ids: bytes) -> bytes:
        """Token strings joined by one space: the vocabulary names no decoder."""
        x = np.frombuffer(ids, "<u4")
        if not len(x):
            return b""
        lengths = self.lengths[x]
        ends = np.cumsum(lengths)
        return self.blob[np.repeat(self.offsets[x] - (ends - lengths), lengths) + np.arange(ends[-1])].tobytes()[:-1]


def codec(path: str) -> Codec:
    """One codec a process. Its tables stay as they are, so the collector of cycles need not go through them again and again."""

    def make() -> Codec:
        made = Codec(path)
        gc.freeze()
        return made

    return held(("codec", path), make)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids binary): ids as little-endian unsigned 32-bit integers, of every whole text."""
    bounded_batches(docs.sparkSession)

    def f(doc_id: list, text: list) -> dict:
        c = codec(path)
        return {"doc_id": doc_id, "ids": [c.encode(t or "") for t in text]}

    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).mapInArrow(rows_udf(["doc_id", "text"], out, f), "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of what encode_documents returns."""
    bounded_batches(encoded.sparkSession)

    def f(doc_id: list, ids: list) -> dict:
        c = codec(path)
        return {"doc_id": doc_id, "text": [c.decode(x or b"").decode() for x in ids]}

    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    return encoded.select("doc_id", "ids").mapInArrow(rows_udf(["doc_id", "ids"], out, f), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every whole text, decode the ids again, and return counts and digests of both."""
    bounded_batches(docs.sparkSession)

    def f(doc_id: list, text: list) -> dict:
        c, out = codec(path), {x.name: [] for x in SCHEMA}
        for i, t in zip(doc_id, text, strict=True):
            ids = c.encode(t or "")
            for k, v in zip(out, (i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()), strict=True):
                out[k].append(v)
        return out

    return docs.select("doc_id", "text").mapInArrow(rows_udf(["doc_id", "text"], SCHEMA, f), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return round_trip(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
