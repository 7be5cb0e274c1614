"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import bisect
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from bytestrata.llm import bpe, exact_dedup, lm_score, media, near_dup, packing, pii, quality, substring_dedup, toxicity
from bytestrata.llm.common import table

PATH = public_tokenizers.path(bpe.VOCABULARY)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, label int, bucket string, rep long, __added string"
SF = "/root/testdata/sf0.001"


def words(n, seed=0):
    r = random.Random(seed)
    return [r.choice("abcdefgh") + r.choice("ijklmnop") + str(r.randrange(90)) for _ in range(n)]


def make(spark, texts, first=0):
    rows = [(first + k, t, "en", f"s{k % 3}", None if t is None else len(t), "x", 1, "b", 7, "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and white texts, ties, a repeated row, a long text, unusual characters, null ids and one id over several texts that share passages."""
    long = " ".join(words(30_000, 5))
    texts = [None, "", "", " \n\t", "same text here", "same text here", "Ünïcode ΣΑΣ 中文 😀 \x1c \x00 don't", "a@b.co, +1 (234) 555-6789, 10.0.0.1, 4111 1111 1111 1111", long, "!!! ... ", "one"]
    df = make(spark, texts)
    shared, rest = words(120, 8), [None] * 8
    more = [(None, "no id", *rest), (None, " ".join(shared), *rest), (None, " ".join(words(300, 9) + shared), *rest), (None, " ".join(shared), *rest)]
    more += [(20, " ".join(shared[:60]), *rest), (20, " ".join(words(200, 10) + shared[20:]), *rest), (21, " ".join([*shared, "end"]), *rest), (21, " ".join([*shared[:-1], "last"]), *rest)]
    return df.unionByName(df.filter("doc_id = 4")).unionByName(spark.createDataFrame(more, SCHEMA)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- BPE


def test_bpe_equals_the_library():
    c, t, r = bpe.codec(PATH), Tokenizer.from_file(PATH), random.Random(1)
    alphabet = "abcdefghijklmnopqrstuvwxyz'  \n\t0123456789.,!?-_<|>ABCÉéèßñüœΣσς²½ªŉİ中文한グ́\x1c\x00\xa0 😀"
    cases = ["", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> x", "<|endoftext|", "a" * 3000, "ab" * 2000, "é a", "don't I'LL we've"]
    cases += ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(3000)]
    cases += ["".join(r.choice("aeinth") for _ in range(r.randrange(40))) for _ in range(2000)]
    for s in cases:
        want = t.encode(s, add_special_tokens=False).ids
        ids = c.encode(s)
        assert np.frombuffer(ids, "<u4").tolist() == want, s
        assert c.decode(ids).decode() == t.decode(want, skip_special_tokens=False)


def test_bpe_memo_generations(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    c, t = bpe.Codec(PATH), Tokenizer.from_file(PATH)
    for s in ["the cat sat on the mat, the end", "The Cat! the cat; on a mat"] * 3:
        assert np.frombuffer(c.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids


def test_latin_words_need_no_pattern(monkeypatch):
    """Words with accents, in capitals or with one mark behind them, are taken whole; the ids are the library's."""
    c, t = bpe.Codec(PATH), Tokenizer.from_file(PATH)
    text = "équele queanque, Èoien. ÉLLEÇELLE! œuvre; straße? mañana: naïf"
    want = t.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "LATIN_WORDS", re.compile("(?!)"))  # finds nothing
    c.memo.update({m: np.array(t.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in ".,;:!?"})
    assert np.frombuffer(c.encode(text), "<u4").tolist() == want
    for s in ("aeiouvi", "elletrere", "x" * 50):
        for at in range(len(s)):
            starts = [s[at:n] for n in range(at + 1, len(s) + 1) if s[at:n] in c.words.rank]
            assert c.words.longest(s, at) == (c.words.rank[starts[-1]] if starts else -1)


def test_bpe_rows(odd, empty):
    out = rows(bpe.round_trip(odd, PATH))
    assert len(out) == odd.count() and {r["n_tokens"] for r in out if r["doc_id"] in (0, 1, 2, 3)} == {0}
    back = {r["doc_id"]: r["text"] for r in rows(bpe.decode_ids(bpe.encode_documents(odd, PATH), PATH))}
    assert back[4].replace("</w>", "").split() == ["same", "text", "here"]
    assert bpe.round_trip(empty, PATH).count() == 0


# --- packing


def test_plan_is_whole_and_tight():
    r = np.random.default_rng(0)
    for n in (0, 1, 7, 3000):
        lengths = np.clip(r.lognormal(6.3, 1.0, n).astype(int) + 1, 1, 4096)
        plan = packing.Plan(dict(Counter(lengths.tolist())))
        got = Counter()
        for own, times in plan.segments:
            assert sum(length * number for length, number in own) <= 4096
            for length, number in own:
                got[length] += number * times
        assert got == Counter(lengths.tolist())
        assert plan.sequences <= math.ceil(lengths.sum() / 4096 * 1.01) + 1
    with pytest.raises(ValueError):
        packing.Plan({5000: 1})


def uniform(n, low, high):
    return dict(Counter(np.random.default_rng(0).integers(low, high, n).tolist()))


def best_fit_decreasing(histogram, capacity=4096):
    """The plain rule, piece by piece."""
    rooms = []
    for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        at = bisect.bisect_left(rooms, length)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - length)
    return len(rooms)


CASES = {
    "ones": {1: 100_000}, "fives": {5: 100_000}, "halves": {2047: 1000, 2049: 1000}, "two": {33: 10_000, 37: 10_000},
    "short": uniform(30_000, 100, 3000), "middle": uniform(30_000, 1000, 3100), "full": {4096: 7}, "any": uniform(9000, 1, 4097),
}


@pytest.mark.parametrize("name", CASES)
def test_plan_is_as_tight_as_best_fit(name):
    plan = packing.Plan(CASES[name])
    assert plan.bound <= plan.sequences <= best_fit_decreasing(CASES[name])


def test_program_beats_best_fit():
    """Lengths that fill sequences only in certain threes and fours."""
    plan = packing.Plan({1366: 3000, 1365: 3000, 1364: 3000, 2000: 100_000, 1500: 70_000, 1100: 300_000})
    plain = packing.Filling(4096, {}, {1366: 3000, 1365: 3000, 1364: 3000, 2000: 100_000, 1500: 70_000, 1100: 300_000})
    assert plan.sequences <= 1.012 * plan.bound < 0.95 * plain.sequences


def test_slots_are_places():
    histogram = uniform(3000, 1, 2000) | {3: 5000}
    plan, places = packing.Plan(histogram), {}
    ranks = Counter()
    for length, first, times, base, offset in plan.slots().tolist():
        assert first == ranks[length]
        number = next(n for n in range(1, 4097) if first + n * times == histogram[length] or any(s[0] == length and s[1] == first + n * times for s in plan.slots().tolist()))
        ranks[length] += number * times
        for k in range(number * times):
            places.setdefault(base + k % times, []).append((offset + k // times * length, length))
    assert ranks == histogram
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_knapsack():
    r = np.random.default_rng(3)
    for _ in range(20):
        sizes = np.unique(r.integers(2, 30, 5))
        prices = r.random(len(sizes)) * sizes
        table = packing.Knapsack(sizes, prices, 60)
        want = np.zeros(61)
        for c in range(1, 61):
            want[c] = max([want[c - 1], *(want[c - s] + p for s, p in zip(sizes, prices) if s <= c)])
        assert np.allclose(table.value, want)
        got = table.configuration(int(sizes[0]), 60)
        assert sum(k * v for k, v in got.items()) <= 60
        assert abs(sum(prices[list(sizes).index(k)] * v for k, v in got.items()) - prices[0] - want[60 - sizes[0]]) < 1e-9


def test_lower_bound_holds():
    """A program of three lengths that is solved by hand: 100 of 500 fill 50 sequences of 1000, 90 of 300 fill 30."""
    uses, bound, _ = packing.configuration_lp(np.array([300, 500]), np.array([90, 100]), 1000, 120, np.zeros(2))
    assert bound <= 80 + 1e-9 and all(sum(a * b for a, b in c) <= 1000 for c in uses)


def check_packed(df, docs):
    t, seen = Tokenizer.from_file(PATH), Counter()
    out = rows(df)
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            seen[doc_id, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert seen == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    return out


def test_packing(odd, empty):
    out = check_packed(packing.pack(odd, PATH), odd)
    assert {r["doc_id"] for r in out} == {r.doc_id for r in odd.select("doc_id").collect()}
    assert sum(r["doc_id"] == 4 for r in out) == 2
    assert max(r["piece"] for r in out) > 5
    assert packing.pack(empty, PATH).count() == 0


def test_packing_ranks_are_salted(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 5)
    docs = make(spark, ["same words in all of them"] * 60)
    out = check_packed(packing.pack(docs, PATH), docs)
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == 60


# --- exact dedup


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.pmod(F.length(t), F.lit(3)).cast("string").cast("binary")])
def test_exact_groups(odd, digest):
    """With a digest that collides, whole texts still tell groups apart."""
    want = {}
    for r in odd.collect():
        want.setdefault(r.text or "", []).append(r.doc_id)
    expected = Counter()
    for group in want.values():
        keep = max((x for x in group if x is not None), default=None)
        expected.update((x, keep, len(group), x == keep) for x in group)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows(exact_dedup.exact_groups(odd, digest, 3))) == expected


def whole_rows(df):
    return Counter(map(tuple, df.collect()))


def test_exact_dedup_keeps_columns(spark, odd, empty):
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and not whole_rows(kept) - whole_rows(odd)
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.text or "", set()).add(r.doc_id)
    out = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert len(out) == len(texts) and {t: i for i, t in out} == {t: max((x for x in i if x is not None), default=None) for t, i in texts.items()}
    assert exact_dedup.deduplicate(empty).count() == 0
    tied = spark.createDataFrame([(i, t, *[None] * 8) for i, t in [(5, "x"), (9, "x"), (5, "y"), (4, "y"), (8, "z"), (8, "z"), (None, "z"), (None, "n"), (None, "n")]], SCHEMA)
    assert sorted((r.text, r.doc_id) for r in exact_dedup.deduplicate(tied).collect()) == [("n", None), ("x", 9), ("y", 5), ("z", 8)]


# --- media


def test_media_round_trip_and_index(odd, empty):
    stored = media.store(odd)
    texts = sorted((x.text or "" for x in odd.collect()), key=lambda t: t.encode())
    stored_rows = sorted(stored.collect(), key=lambda r: media.read_back(r.media, media.probe(r.media))[: r.n_bytes])
    for r, text in zip(stored_rows, texts, strict=True):
        found = media.probe(r.media)
        assert media.read_back(r.media, found) == media.padded(text.encode()) and r.n_bytes == len(text.encode())
        for k in media.key_ranges(found)[:3]:
            assert r.media[k["offset"] : k["offset"] + k["length"]] == media.padded(text.encode())[(k["offset"] - found["offsets"][0]) :][: k["length"]]
    assert {r["status"] for r in rows(media.index(stored))} == {"ok"}
    by_text = {}
    for r in rows(media.digests(stored)):
        assert r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > 0
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"]))
        assert r["key_frames"] and str(len(r["key_frames"])) in r["feature"]
    assert all(len(v) == 1 for v in by_text.values())
    assert media.digests(media.store(empty)).count() == 0


def test_media_broken(spark):
    good = media.mux(media.padded(b"x" * 5000))
    broken = [None, b"", b"1234", good[:200], good[:-300], good.replace(b"stsz", b"free"), b"\0\0\0\1moov" + b"\xff" * 8]
    df = spark.createDataFrame([(k, x) for k, x in enumerate([good, *broken])], "doc_id long, media binary")
    out = {r["doc_id"]: r for r in rows(media.index(df))}
    assert out[0]["status"] == "ok" and out[0]["codec"] == "raw " and len(out[0]["key_frames"]) == 5
    assert all(out[k]["status"].startswith("broken") and out[k]["codec"] is None for k in range(1, len(broken) + 1))


# --- PII


def plain_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    r, hits = random.Random(1), 0
    for _ in range(20000):
        s = "".join(r.choice(r.choice(["0123456789", "ab.@-", "+ ().-", "1.2", "é@a.b"])) for _ in range(r.randrange(60)))
        assert pii.base_spans(s) == plain_spans(s)
        hits += len(plain_spans(s))
    assert hits > 1000
    for s in ("1" * 100000, "a" * 100000 + "@", "a@" * 50000, "1." * 50000):
        pii.base_spans(s)


def test_pii_query_counts_kinds(spark, tmp_path):
    """Counts and digest of op6's rows by plain patterns: spans of one kind only, several of one, all kinds, none, null, shared and null ids."""
    mail, ip, card, phone = "a.b@c-d.org", "10.0.255.1", "4111 1111-1111 1111", "+1 (555) 010-2030"
    texts = [mail, ip, card, phone, f"{mail} {mail} {mail}", f"{phone}; {phone}; {ip}", f"{phone}, {card}, {ip}, {mail}", "none 1", "", None, f"{ip} {mail}", f"{card} {card}"]
    ids = [*range(10), 9, None]
    spark.createDataFrame([(i, t, *[None] * 8) for i, t in zip(ids, texts, strict=True)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, t in zip(ids, texts, strict=True):
        spans = sorted(plain_spans(t or ""))
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        expected.append((i, *(sum(k == x for k, _, _ in spans) for x in range(4)), hashlib.sha256(joined.encode()).hexdigest()))
    out = rows(pii.op6_pii(spark, str(tmp_path)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"))
    assert sorted(repr(tuple(r.values())) for r in out) == sorted(map(repr, expected))


def test_bootstrapped_contexts(spark, odd, empty):
    texts = [f"some text {k} call hotline at number +1 (5{k:02d}) 555-01{k:02d} today" for k in range(30)]
    docs = make(spark, [*texts, "w w call hotline at number 5550199777 today", "order number 5550199779 shipped", None, ""])
    out = {r["doc_id"]: r for r in rows(pii.find(docs))}
    assert [(s["kind"], s["start"], s["end"]) for s in out[30]["spans"]] == [(3, 27, 37)] and out[30]["base"] == []
    assert out[31]["spans"] == out[32]["spans"] == out[33]["spans"] == [] and out[1]["spans"] == out[1]["base"]
    masked = {r["doc_id"]: r for r in rows(pii.mask(docs))}
    assert masked[30]["text"] == "w w call hotline at number [PHONE] today" and masked[30]["n_chars"] == 40
    assert masked[32]["text"] is None and masked[31]["text"] == "order number 5550199779 shipped"
    clean = pii.mask(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert {r["text"] for r in rows(clean) if r["doc_id"] == 7} == {"[EMAIL], [PHONE], [IP], [CARD]"}
    assert pii.find(odd).count() == odd.count() and pii.find(empty).count() == 0 and pii.mask(empty).count() == 0


def test_added_spans_of_shared_ids(spark):
    """Null ids, and one id over several texts: each text gets its own spans."""
    seeds = [(k, f"some text {k} call hotline at number +1 (5{k:02d}) 555-01{k:02d} today") for k in range(30)]
    new = [(i, f"{'w ' * n}call hotline at number 55501997{n:02d} today") for n, i in enumerate([None, None, None, 77, 77], 2)]
    docs = spark.createDataFrame([(i, t, *[None] * 8) for i, t in [*seeds, *new, new[0]]], SCHEMA)
    out = [r for r in rows(pii.find(docs)) if r["base"] == []]
    assert sorted(s["start"] for r in out for s in r["spans"]) == sorted(2 * n + 23 for n in (2, 2, 3, 4, 5, 6))
    masked = Counter(r["text"] for r in rows(pii.mask(docs)))
    assert all(masked[f"{'w ' * n}call hotline at number [PHONE] today"] == 1 + (n == 2) for n in (2, 3, 4, 5, 6))


def test_unknown_instances_weigh_less(spark):
    """Forty new identifiers in a context of sixty seeds are found; an equal share of seeds of another kind stops it."""
    seeds = [f"w{k} v{k} call hotline at number +1 (5{k:02d}) 555-01{k:02d} today" for k in range(60)]
    new = [f"w{k} v{k} call hotline at number 55501{k:05d} today" for k in range(40)]
    other = [f"w{k} v{k} call hotline at number a{k}@b{k}.org today" for k in range(40)]
    found = rows(pii.find(make(spark, seeds + new)))
    assert all(len(r["spans"]) == 1 for r in found)
    mixed = {r["doc_id"]: r for r in rows(pii.find(make(spark, seeds + other + new)))}
    assert all(mixed[k]["spans"] == [] for k in range(100, 140))


# --- near duplicates


def brute_classes(texts, threshold=0.8):
    kmers = {i: near_dup.labelled(near_dup.normal_words(t)) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            same = near_dup.normal_words(texts[i]) == near_dup.normal_words(texts[j]) if len(kmers[i]) and len(kmers[j]) else (texts[i] or "") == (texts[j] or "")
            if same or (len(kmers[i]) and len(kmers[j]) and near_dup.similarity(kmers[i], kmers[j], threshold)):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def family(seed, copies, edits):
    r, base = random.Random(seed), words(120, seed)
    out = [" ".join(base)]
    for _ in range(copies):
        w = base[:]
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
        out.append(" ".join(w))
    return out


def test_near_classes(spark, monkeypatch):
    texts = sum((family(s, 14, 5) for s in range(6)), []) + [" ".join(words(120, 100 + s)) for s in range(10)] + [None, "", "a b", "A, b!", "..."]
    docs = make(spark, texts)
    want = brute_classes(dict(enumerate(texts)))
    got = {r["doc_id"]: r["class_id"] for r in rows(near_dup.near_duplicates(docs))}
    assert got == want
    settle = near_dup._settle
    monkeypatch.setattr(near_dup, "_settle", lambda *a: settle(*a, group=4))  # larger buckets are dealt anew
    assert {r["doc_id"]: r["class_id"] for r in rows(near_dup.near_duplicates(docs))} == want


def candidates_of(spark, monkeypatch, texts, buckets):
    """Pairs that go on to the alignment, for buckets {slot: texts} in parts of 4; each text is a class, and the least of a bucket its hub."""
    kmers = [near_dup.labelled(near_dup.normal_words(t)) for t in texts]
    slots = [[s if k in buckets.get(s, ()) else 1000 * s + k + 1000 for s in range(near_dup.SLOTS)] for k in range(len(texts))]
    members = spark.createDataFrame([(s, s, k, len(kmers[k]), slots[k]) for s, held in buckets.items() for k in held], "bucket long, slot int, rep long, n long, slots array<long>")
    hubs = spark.createDataFrame([(s, min(held)) for s, held in buckets.items()], "bucket long, hub long")
    labels = spark.createDataFrame([(k, k) for k in range(len(texts))], "rep long, label long")
    seen = set()

    def aligned(pairs, words):
        seen.update((x.a, x.b) for x in pairs.collect())
        return pairs.limit(0)

    monkeypatch.setattr(near_dup, "verified", aligned)
    packed = {bytes(r.words_key): bytes(r.words) for r in near_dup.packed_words(make(spark, texts)).collect()}
    packed = spark.createDataFrame([(k, packed[near_dup._key(near_dup.normal_words(t), t)]) for k, t in enumerate(texts)], "rep long, words binary")
    near_dup._settle(members, hubs, labels, packed, group=4)
    signs = [np.frombuffer(near_dup.signature(k), np.uint8) for k in kmers]
    near = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (signs[i] == signs[j]).sum() >= near_dup.ESTIMATE * near_dup.LEAST_KMERS}
    return seen, near


def test_large_buckets_are_compared_whole(spark, monkeypatch):
    texts = family(1, 59, 3)
    seen, near = candidates_of(spark, monkeypatch, texts, {3: range(60), 9: range(60)})
    assert len(near) > 200 and seen == near


def test_pairs_of_small_buckets_that_share_a_large_one(spark, monkeypatch):
    texts = family(1, 59, 3)
    signs = [np.frombuffer(near_dup.signature(near_dup.labelled(near_dup.normal_words(t))), np.uint8) for t in texts]
    free, pairs = set(range(1, 60)), []
    for i, j in ((i, j) for i in range(1, 60) for j in range(i + 1, 60)):
        if {i, j} <= free and len(pairs) < 12 and near_dup.ESTIMATE <= (signs[i] == signs[j]).mean() < 0.85:
            free -= {i, j}
            pairs.append((i, j))
    seen, _ = candidates_of(spark, monkeypatch, texts, {3: range(60)} | dict(enumerate(pairs, 4)))
    assert len(pairs) > 5 and seen == set(pairs)


def test_links_of_a_bucket_are_a_forest(spark, monkeypatch):
    """A bucket of texts that are nearly all similar, each a class of its own: the links are fewer than the texts, and the classes whole."""
    texts, real, counts = family(1, 59, 3), near_dup.verified, []

    def counted(pairs, words):
        links = real(pairs, words).toPandas()
        counts.append(len(links))
        return spark.createDataFrame(links, "a long, b long")

    kmers = [near_dup.labelled(near_dup.normal_words(t)) for t in texts]
    for group in (2048, 20):
        members = spark.createDataFrame([(3, 0, k, len(kmers[k]), [*range(near_dup.SLOTS)]) for k in range(60)], "bucket long, slot int, rep long, n long, slots array<long>")
        packed = {bytes(r.words_key): bytes(r.words) for r in near_dup.packed_words(make(spark, texts)).collect()}
        packed = spark.createDataFrame([(k, packed[near_dup._key(near_dup.normal_words(t), t)]) for k, t in enumerate(texts)], "rep long, words binary")
        monkeypatch.setattr(near_dup, "verified", counted)
        labels = near_dup._settle(members, spark.createDataFrame([(3, 0)], "bucket long, hub long"), spark.createDataFrame([(k, k) for k in range(60)], "rep long, label long"), packed, group=group)
        assert {r.rep: r.label for r in labels.collect()} == brute_classes(dict(enumerate(texts)))
    assert counts[0] < 60 and counts[1] < 6 * 40


def test_near_rows(odd, empty):
    out = rows(near_dup.near_duplicates(odd))
    assert len(out) == odd.count() and sum(r["class_id"] == 4 for r in out) == 3
    plain = odd.select("doc_id", "text").collect()
    classes = brute_classes({k: r.text for k, r in enumerate(plain)})
    groups = {}
    for k, c in classes.items():
        groups.setdefault(c, []).append(plain[k].doc_id)
    want = Counter()
    for ids in groups.values():
        name = min((x for x in ids if x is not None), default=None)
        want.update((x, name) for x in ids)
    assert Counter((r["doc_id"], r["class_id"]) for r in out) == want
    kept = near_dup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups) and 5 not in {r.doc_id for r in kept.collect()}
    left = {k: r.text for k, r in enumerate(kept.select("doc_id", "text").collect())}
    assert brute_classes(left) == {k: k for k in left}
    assert near_dup.near_duplicates(empty).count() == 0


def recall(spark, data):
    """Share of the similar pairs with a query (an id divisible by 50) that are in one class; pairs by brute force over all rows."""
    docs = spark.createDataFrame(data, "doc_id long, text string")
    classes = {r["doc_id"]: r["class_id"] for r in rows(near_dup.near_duplicates(docs))}
    kmers = {i: near_dup.labelled(near_dup.normal_words(t)) for i, t in data}
    pairs = [(i, j) for i in kmers if i % 50 == 0 for j in kmers if i != j and near_dup.similarity(kmers[i], kmers[j])]
    return sum(classes[i] == classes[j] for i, j in pairs), len(pairs)


def test_near_recall_of_documents(spark):
    found, pairs = recall(spark, [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()])
    assert found >= 0.9 * pairs and pairs


def test_near_recall_of_a_large_family(spark, monkeypatch):
    """Copies of one text that differ by about the threshold, in buckets far over the size of a part."""
    settle = near_dup._settle
    monkeypatch.setattr(near_dup, "_settle", lambda *a: settle(*a, group=128))
    r, base, data = random.Random(7), words(400, 11), []
    for k in range(1000):
        w = base[:]
        for _ in range(r.randrange(4, 17)):
            w[r.randrange(400)] = f"n{r.randrange(10**6)}"
        data.append((k, " ".join(w)))
    found, pairs = recall(spark, data)
    assert found >= 0.99 * pairs and pairs > 50


def test_order_counts():
    a, b = words(60, 1), words(60, 2)
    one, two = (near_dup.labelled([w.encode() for w in x]) for x in (a + b, b + a))
    assert near_dup.similarity(one, two) == 0 and near_dup.similarity(one, one) == 1
    repeated = near_dup.labelled([b"x"] * 50)
    assert len(set(repeated.tolist())) == 46


# --- substring dedup


def brute_substrings(rows_):
    """Of (doc_id, text) rows; a null id is larger than any other."""
    seen, split = {}, [(float("inf") if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows_]
    for i, w in split:
        for k in range(len(w) - 49):
            own = tuple(w[k : k + 50])
            seen[own] = min(i, seen.get(own, i))
    out = Counter()
    for (i, w), (doc_id, _) in zip(split, rows_, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out[doc_id, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()] += 1
    return out


def removed(docs):
    return Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in rows(substring_dedup.remove_repeats(docs)))


def test_substrings(spark, odd, empty):
    r, shared = random.Random(3), [words(n, 40 + n) for n in (49, 50, 51, 70, 200)]
    texts = []
    for k in range(40):
        w = words(r.randrange(120), k)
        for s in r.sample(shared, 2):
            at = r.randrange(len(w) + 1)
            w[at:at] = s
        texts.append(r.choice([" ", "\n", "  "]).join(w))
    texts += [texts[3], texts[3] + " ", None, "", "x " * 500, "x " * 300]
    docs = make(spark, texts)
    assert removed(docs) == brute_substrings([*enumerate(texts)])
    for x in rows(substring_dedup.remove_repeats(docs)):
        assert sum(s["end"] - s["start"] for s in x["removed"]) == x["n_removed"]
    assert removed(odd) == brute_substrings([(x.doc_id, x.text) for x in odd.collect()])
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substrings_of_shared_ids(spark):
    """Ids that are null or stand over several texts, each of other length, with passages in common; and the table united with itself."""
    r, shared = random.Random(4), words(300, 50)
    data = []
    for k in range(60):
        at = r.randrange(200)
        data.append((r.choice([None, None, 3, 4, k]), " ".join(words(r.randrange(200), k) + shared[at : at + r.randrange(100)])))
    docs = spark.createDataFrame([(i, t, *[None] * 8) for i, t in data], SCHEMA)
    assert removed(docs) == brute_substrings(data)
    assert removed(docs.unionByName(docs)) == brute_substrings(data + data)


def test_cover():
    d = substring_dedup.COVER
    assert sorted((a - b) % 31 for a in d for b in d if a != b) == list(range(1, 31))


# --- language model


def test_lm_scores(spark, odd, empty):
    texts = [" ".join(random.Random(k).choices(["a", "b", "c", "dd", "e"], k=k * 7)) for k in range(12)] + [None, "", "zzz"]
    split = {i: (t or "").split() for i, t in enumerate(texts)}
    one, two = Counter(w for x in split.values() for w in x), Counter(p for x in split.values() for p in zip(x, x[1:]))
    total = sum(one.values())
    got = {r["doc_id"]: r for r in rows(lm_score.score(make(spark, texts), 200, 8, order=2))}
    for i, w in split.items():
        o1, o2, s = Counter(w), Counter(zip(w, w[1:])), 0.0
        for k, x in enumerate(w):
            u = max(one[x] - o1[x], 0.5) / max(total - len(w), 1)
            if k:
                c = two[w[k - 1], x] - o2[w[k - 1], x]
                u = c / (one[w[k - 1]] - o1[w[k - 1]]) if c > 0 else 0.4 * u
            s += math.log(u)
        assert got[i]["n_words"] == len(w) and abs(got[i]["log_score"] - s) < 1e-6 * max(1, abs(s))
        assert (got[i]["mean_log_score"] is None) == (not w)
    assert lm_score.score(odd).count() == odd.count() and lm_score.score(empty).count() == 0


def test_lm_query_scores_trigrams(spark, tmp_path):
    texts = [" ".join(random.Random(k).choices(["a", "b", "c", "dd", "e"], k=k * 7)) for k in range(12)] + [None, "", "zzz"]
    make(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    split = {i: (t or "").split() for i, t in enumerate(texts)}
    grams = {i: [Counter(zip(*(w[j:] for j in range(n)))) for n in (1, 2, 3)] for i, w in split.items()}
    every, total = [sum((g[n] for g in grams.values()), Counter()) for n in range(3)], sum(map(len, split.values()))
    got = {r["doc_id"]: r["log_score"] for r in rows(lm_score.op4_lm_scoring(spark, str(tmp_path)))}
    for i, w in split.items():
        s = 0.0
        for k in range(len(w)):
            u = max(every[0][(w[k],)] - grams[i][0][(w[k],)], 0.5) / max(total - len(w), 1)
            for n in range(1, min(k, 2) + 1):
                g = tuple(w[k - n : k + 1])
                c = every[n][g] - grams[i][n][g]
                u = c / (every[n - 1][g[:-1]] - grams[i][n - 1][g[:-1]]) if c > 0 else 0.4 * u
            s += math.log(u)
        assert abs(got[i] - s) < 1e-6 * max(1, abs(s))


def brute_scores(texts, order):
    split = [(t or "").split() for t in texts]
    grams = [[Counter(zip(*(w[j:] for j in range(n + 1)))) for n in range(order)] for w in split]
    every, total = [sum((g[n] for g in grams), Counter()) for n in range(order)], sum(map(len, split))
    out = []
    for w, own in zip(split, grams, strict=True):
        s = 0.0
        for k in range(len(w)):
            u = max(every[0][(w[k],)] - own[0][(w[k],)], 0.5) / max(total - len(w), 1)
            for n in range(1, min(k, order - 1) + 1):
                g = tuple(w[k - n : k + 1])
                c = every[n][g] - own[n][g]
                u = c / (every[n - 1][g[:-1]] - own[n - 1][g[:-1]]) if c > 0 else 0.4 * u
            s += math.log(u)
        out.append(s)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_of_repeated_blocks(spark, order):
    """A table united with itself: equal blocks must not be taken for one."""
    texts = [" ".join(random.Random(k).choices(["a", "b", "c", "dd", "e", f"own{k}"], k=k * 5)) for k in range(40)]
    one = make(spark, texts).coalesce(1)
    got = rows(lm_score.score(one.unionByName(one), 1 << 20, 64, order))
    want = brute_scores(texts + texts, order)
    assert len(got) == 80 and all(abs(r["log_score"] - want[r["doc_id"]]) < 1e-6 * max(1, abs(want[r["doc_id"]])) for r in got)
    mixed = make(spark, texts).repartition(5)
    want = brute_scores(texts, order)
    assert all(abs(r["log_score"] - want[r["doc_id"]]) < 1e-6 * max(1, abs(want[r["doc_id"]])) for r in rows(lm_score.score(mixed, 150, 16, order)))


def test_packed_numbers():
    x = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm_score.unpack_sorted(lm_score.pack_sorted(x)) == x).all()
    assert (lm_score.unpack_counts(lm_score.pack_counts(x.astype(np.int64))) == x.astype(np.int64)).all()


# --- toxicity and quality


def test_gradients():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    features = toxicity.word_features(["alpha", "beta", "gamma!", "delta", "eps", ""])
    index, y = np.random.default_rng(0).integers(0, 6, (7, toxicity.WINDOW)), np.array([0, 1, 0, 1, 1, 0, 1.0])

    def loss():
        x = net.projected(net.inputs(*features).astype(np.float64))[index.T]
        states, _ = net.run(np.stack([x[:, :, 0], x[::-1, :, 1]]))
        logit, _ = net.pool(states, index.T != 5)
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    old, toxicity.DECAY = toxicity.DECAY, 0.0
    grads = net.gradients(features, index, 5, y)
    toxicity.DECAY = old
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        was, e = net.p[k][at], 1e-2
        net.p[k][at] = was + e
        up = loss()
        net.p[k][at] = was - e
        down = loss()
        net.p[k][at] = was
        assert abs((up - down) / 2 / e - g[at]) < 1e-2 * abs(g[at]) + 1e-6, k


def plain_score(net, text):
    """Window by window and step by step, from the definitions."""
    p, h_size = {k: v.astype(np.float64) for k, v in net.p.items()}, toxicity.HIDDEN

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def embedded(word):
        bucket, grams, _, _ = toxicity.word_features([word])
        chars = p["gram"][grams].sum(0) / max(len(grams), 1)
        return np.concatenate([p["word"][bucket[0]], chars])

    split, best = text.split(), -np.inf
    start = 0
    while True:
        own = split[start : start + toxicity.WINDOW]
        real = len(own)
        x = [embedded(w) for w in own] + [embedded("")] * (toxicity.WINDOW - real)
        states = []
        for direction in (0, 1):
            h, out = np.zeros(h_size), []
            for v in x if direction == 0 else x[::-1]:
                gates, back = v @ p["wx"][direction] + p["bx"][direction][0], h @ p["u"][direction]
                r, z = sigmoid(gates[:h_size] + back[:h_size]), sigmoid(gates[h_size : 2 * h_size] + back[h_size : 2 * h_size])
                n = np.tanh(gates[2 * h_size :] + r * (back[2 * h_size :] + p["bn"][direction][0]))
                h = (1 - z) * n + z * h
                out.append(h)
            states.append(out if direction == 0 else out[::-1])
        both = [np.concatenate(t) for t in zip(*states)]
        weight = np.array([np.exp(np.tanh(b @ p["wa"] + p["ba"]) @ p["va"]) if k < real else 0.0 for k, b in enumerate(both)])
        pooled = sum(w * b for w, b in zip(weight, both)) / max(weight.sum(), 1e-9)
        best = max(best, float(pooled @ p["wo"] + p["bo"][0]))
        start += toxicity.STRIDE
        if start >= len(split) - toxicity.WINDOW + toxicity.STRIDE:
            return float(sigmoid(best + net.shift))


@pytest.mark.parametrize("block", [1024, 3])
def test_scores_are_those_of_the_definition(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "NEW_WORDS", 5)
    net, r = toxicity.Network(3), random.Random(2)
    for k in ("word", "gram", "va", "wa"):
        net.p[k] = (net.p[k] * 8).astype(np.float32)
    net.shift = 0.3
    texts = ["", "one", " ".join(words(24, 1)), " ".join(words(25, 2)), " ".join(words(41, 3)), *(" ".join(words(r.randrange(200), k)) for k in range(8)), " ".join(words(1500, 4))]
    got = toxicity.Scorer(net)(texts)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=2e-4)


def test_calibration():
    shift = toxicity.calibration(np.array([-3.0, -2.0, 1.0, 2.0, 5.0]), np.array([0, 0, 0, 1, 1]))
    assert shift == -3.5 or shift == -1.5
    assert toxicity.calibration(np.array([-3.0, 4.0, 1.0, 2.0]), np.array([0, 0, 1, 1]), 0.1) == 1.0


def test_every_word_is_in_a_window():
    for n in (0, 1, 23, 24, 25, 40, 41, 1000):
        w = toxicity.windows_of(n)
        assert set(w[w < n].tolist()) == set(range(n)) and len(w) >= 1


def labelled(spark, n):
    r, texts, labels, common = random.Random(9), [], [], words(150, 77)
    for k in range(n):
        w = [r.choice(common) for _ in range(r.randrange(5, 120))]
        if k % 4 == 0:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["awful", "rotten", "Nasty!"])
        texts.append(" ".join(w))
        labels.append((k, int(k % 4 != 1), int(k % 4 == 0)))
    return make(spark, texts), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (10**9, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_learns(spark, odd, empty):
    docs, labels = labelled(spark, 700)
    model = toxicity.fit(docs, labels)
    out = [r for r in rows(toxicity.score(docs, model)) if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in out) >= 0.9 * len(out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows(toxicity.score(docs, model)))
    again = toxicity.score(docs.drop("lang", "source").withColumn("label", F.lit(0)), model)
    assert {(r["doc_id"], r["score"]) for r in rows(again)} == {(r["doc_id"], r["score"]) for r in rows(toxicity.score(docs, model))}
    assert toxicity.score(odd, model).filter("score BETWEEN 0 AND 1").count() == odd.count()
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == toxicity.score(docs, model).filter("predicted = 0").count()
    assert toxicity.score(empty, model).count() == 0 and toxicity.keep_clean(empty, model).count() == 0
    none = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert none == 0.0 and toxicity.score(odd, none).filter("predicted = 0").count() == odd.count()


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).filter("held_out").join(labels, "doc_id")
    n, good = out.agg(F.count(F.lit(1)), F.sum((F.col("predicted") == F.col("toxic")).cast("int"))).first()
    assert good >= 0.85 * n


def test_quality(spark, odd, empty):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    out = quality.score(docs, labels).withColumn("held", quality.held_out(F.col("doc_id"))).filter("held").join(labels, "doc_id")
    n, good = out.agg(F.count(F.lit(1)), F.sum((F.col("kept").cast("int") == F.col("quality")).cast("int"))).first()
    assert good >= 0.95 * n
    assert quality.score(odd, labels).filter("score BETWEEN 0 AND 1").count() == odd.count()
    assert quality.score(empty, labels).count() == 0
    assert quality.score(odd, labels.limit(0)).filter("evidence = 0.5").count() == odd.count()


def test_shrinking_is_the_formula(spark):
    found = spark.createDataFrame([(k, f"h{k % 3}", f"p{k % 2}", 0.1 + 0.8 * ((k * 7) % 10) / 10) for k in range(40)], "doc_id long, host string, path string, evidence double")
    out = {r["doc_id"]: r for r in rows(quality.posterior(found, 0.5))}
    data = [(r.doc_id, r.host, r.path, r.evidence) for r in found.collect()]
    mean = sum(x[3] for x in data) / len(data)
    hosts = {}
    for _, h, _, e in data:
        hosts.setdefault(h, []).append(e)
    within = sum(sum((e - np.mean(v)) ** 2 for e in v) for v in hosts.values()) / (len(data) - len(hosts))
    between = sum(len(v) * (np.mean(v) - mean) ** 2 for v in hosts.values())
    spread = (between - (len(hosts) - 1) * within) / (len(data) - sum(len(v) ** 2 for v in hosts.values()) / len(data))
    weight = min(1e4, max(within / spread, 1)) if spread > 0 else 1e4
    for i, h, _, e in data:
        assert abs(out[i]["host_mean"] - (sum(hosts[h]) - e + weight * mean) / (len(hosts[h]) - 1 + weight)) < 1e-9


def test_posterior_of_paths_is_the_formula(spark):
    r = random.Random(3)
    data = [(k, h := f"h{k % 4}", f"p{k % 3}", round(min(0.95, max(0.05, 0.2 + 0.2 * (k % 4) + 0.1 * (k % 3) + r.random() * 0.2)), 6)) for k in range(120)]
    out = {x["doc_id"]: x for x in rows(quality.posterior(spark.createDataFrame(data, "doc_id long, host string, path string, evidence double"), 0.4))}

    def weight(groups, means):
        """Method of moments, for {group: values} around means."""
        n = sum(map(len, groups.values()))
        noise = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values()) / (n - len(groups))
        between = sum(len(v) * (np.mean(v) - means[g]) ** 2 for g, v in groups.items())
        spread = (between - (len(groups) - 1) * noise) / (n - sum(len(v) ** 2 for v in groups.values()) / n)
        return min(quality.MOST_PRIOR, max(noise / spread, 1.0)) if spread > 0 else quality.MOST_PRIOR

    hosts, paths = {}, {}
    for _, h, p, e in data:
        hosts.setdefault(h, []).append(e)
        paths.setdefault((h, p), []).append(e)
    mean = sum(e for *_, e in data) / len(data)
    of_host = weight(hosts, dict.fromkeys(hosts, mean))
    shrunk = {h: (sum(v) + of_host * mean) / (len(v) + of_host) for h, v in hosts.items()}
    of_path = weight(paths, {g: shrunk[g[0]] for g in paths})
    for i, h, p, e in data:
        host_mean = (sum(hosts[h]) - e + of_host * mean) / (len(hosts[h]) - 1 + of_host)
        path_mean = (sum(paths[h, p]) - e + of_path * host_mean) / (len(paths[h, p]) - 1 + of_path)
        logit = math.log(e / (1 - e)) - math.log(0.4 / 0.6) + math.log(path_mean / (1 - path_mean))
        assert abs(out[i]["host_mean"] - host_mean) < 1e-9 and abs(out[i]["path_mean"] - path_mean) < 1e-9
        assert abs(out[i]["score"] - 1 / (1 + math.exp(-logit))) < 1e-9


def test_evidence_is_the_classifier(spark):
    docs, labels = labelled(spark, 300)
    model = quality.fit(docs, labels)
    (mean, scale, beta), prior = model
    assert 0 < prior < 1
    texts = dict(docs.select("doc_id", "text").collect())
    for r in rows(quality.evidence(docs, model)):
        t = float(((quality.features(texts[r["doc_id"]]) - mean) / scale) @ beta[:-1] + beta[-1])
        assert abs(r["evidence"] - min(1 - quality.LEAST, max(quality.LEAST, 1 / (1 + math.exp(-max(-40, min(40, t))))))) < 1e-9


def test_sites_of_urls(spark):
    urls = ["https://www.Example.org:8080/a/b?x=1", "http://user:pw@host.net", "ftp://h/x#y", "no url", None, "https://h.com?q=/a"]
    out = [(r["host"], r["path"]) for r in rows(quality.with_site(spark.createDataFrame([(u,) for u in urls], "url string")))]
    assert out == [("example.org", "/a"), ("host.net", "/"), ("h", "/x"), (None, None), (None, None), ("h.com", "/")]


# --- pipeline


def test_pipeline(spark, tmp_path):
    docs, kept = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        after.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept.append(docs.count())
        if name == "exact_dedup":
            assert kept[-1] == before.select("text").distinct().count()
        if name == "near_dedup":
            classes = brute_classes({r.doc_id: r.text for r in before.select("doc_id", "text").collect()})
            assert {r.doc_id for r in docs.select("doc_id").collect()} == set(classes.values())
        if name == "pii":
            assert not any(plain_spans(r.text) for r in docs.collect())
    assert kept == sorted(kept, reverse=True) and kept[2] == kept[3]
    check_packed(corpus_pipeline.STAGES[-1][1](spark, docs, SF), docs)


def test_pipeline_of_nothing(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_registry_names():
    from bytestrata.llm import registry

    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES) == list(range(1, 11))
    assert json.dumps(sorted(registry.SQL))
