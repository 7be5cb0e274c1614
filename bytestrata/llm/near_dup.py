"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is the sequence of its k-mers of KMER words (lower case, without ASCII punctuation), each labelled with its occurrence
number. A sketch slot takes the TAKEN smallest labelled k-mers under its hash and keeps them in text order, so two texts agree in a
slot only if they hold the same k-mers in the same order. Texts that agree in a slot are candidates; a candidate pair is
linked if an alignment of the labelled k-mers within a band matches at least THRESHOLD of their union (the band holds every
alignment that can).

A bucket of m texts is not made into m * m pairs. Each text is compared with the bucket's hub, the text that shares most slots with
others, which settles all but few buckets. In those that still hold more than one class, every text outside the hub's class is held
against all others by their signatures (LEAST_KMERS bytes), and only pairs that agree in AGREE slots and at least
ESTIMATE of the signature go on to the alignment. The task that finds them aligns them, nearest first, and leaves out pairs whose
classes have become one by then; so it returns fewer links than it has classes, however many pairs are near. A bucket of more than GROUP
texts (fewer where they are long: about PART_KMERS k-mers) is dealt into parts of about GROUP, and a task holds two of them, so that each
pair is met in a task. A pair at the threshold agrees in no slot with a chance of
(1 - 0.8 ** TAKEN) ** SLOTS = 1e-5, in fewer than AGREE with 2e-4, and falls under ESTIMATE with 7e-4. Classes are the connected
components of the links.

Defined cases: texts with equal words are one class from the start; null and empty texts are equal texts; texts without any word
are compared as they are; a text with fewer than KMER words is one k-mer; texts may be of any length; a node of the search is a
sequence of words, whatever ids its rows have, so one doc_id may stand over several texts; the class is named by its smallest doc_id
(null where it has null ids alone), and of its rows with that id the text of least digest is kept; rows equal in doc_id and text are one
document, flagged alike, and deduplicate() leaves one of them; an empty table gives an empty result; other columns stay unread.
"""

from __future__ import annotations

import hashlib
import string
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.llm.common import bounded_batches, cut, discard, mixed, one_of_each, rows_udf, table, window_hashes, word_hashes

KMER, THRESHOLD = 5, 0.8
SLOTS, TAKEN, AGREE = 16, 3, 2
#: Bytes of a signature, least share of them for a candidate, and texts of a part of a bucket.
LEAST_KMERS, ESTIMATE, GROUP = 256, 0.72, 2048
#: K-mers of a part of a bucket; k-mers that a task holds unpacked at a time.
PART_KMERS, UNPACKED = 1 << 22, 1 << 22
#: K-mers hashed at a time.
BLOCK = 1 << 15
BASE = 0xD6E8FEB86659FD93
SEEDS = mixed(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(BASE))
_SPACES = bytes.maketrans(string.punctuation.encode() + bytes(range(32)), b" " * (len(string.punctuation) + 32))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPACES).split()


def labelled(words: list[bytes]) -> np.ndarray:
    """Hashes of the text's k-mers with their occurrence numbers, in text order."""
    if not words:
        return np.zeros(0, np.uint64)
    kmers = window_hashes(word_hashes(words), min(KMER, len(words)), BASE)
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    if len(first) == len(kmers):
        return kmers
    occurrence = np.empty(len(kmers), np.uint64)
    occurrence[order] = np.arange(len(kmers)) - np.repeat(first, np.diff(np.append(first, len(kmers))))
    return np.where(occurrence > 0, mixed(kmers + occurrence * np.uint64(BASE)), kmers)


def _ranks(x: np.ndarray) -> np.ndarray:
    x = (x[None, :] ^ SEEDS[:, None]) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def sketch(kmers: np.ndarray) -> np.ndarray:
    """SLOTS hashes of ordered k-mers."""
    best = np.tile(np.arange(min(TAKEN, len(kmers))), (SLOTS, 1))
    if len(kmers) > TAKEN:
        parts = []
        for at in range(0, len(kmers), BLOCK):
            r = _ranks(kmers[at : at + BLOCK])
            parts.append(at + (np.argpartition(r, TAKEN - 1, axis=1)[:, :TAKEN] if r.shape[1] > TAKEN else np.tile(np.arange(r.shape[1]), (SLOTS, 1))))
        best = parts[0]
        if len(parts) > 1:
            best = np.concatenate(parts, axis=1)
            r = (kmers[best] ^ SEEDS[:, None]) * np.uint64(0xFF51AFD7ED558CCD)
            r ^= r >> np.uint64(32)
            best = np.take_along_axis(best, np.argpartition(r, TAKEN - 1, axis=1)[:, :TAKEN], axis=1)
    best = np.sort(best, axis=1)
    out = SEEDS.copy()
    for k in range(best.shape[1]):
        out = mixed(out * np.uint64(BASE) + kmers[best[:, k]])
    return out.view(np.int64)


_signature_seeds = mixed(np.arange(1, LEAST_KMERS + 1, dtype=np.uint64) * np.uint64(BASE ^ (BASE << 7) & (1 << 64) - 1))


def signature(kmers: np.ndarray) -> bytes:
    """A byte of the least of all k-mers under each of LEAST_KMERS hashes."""
    least = np.full(LEAST_KMERS, ~np.uint64(0))
    for at in range(0, len(kmers), 1024):
        x = (kmers[None, at : at + 1024] ^ _signature_seeds[:, None]) * np.uint64(0xFF51AFD7ED558CCD)
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(1))
    return (mixed(least) & np.uint64(255)).astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Share of the union of labelled k-mers that the best alignment within the band matches; 0 where it is below threshold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = threshold * (len(a) + len(b)) / (1 + threshold)  # matches of a pair at the threshold
    if min(len(a), len(b)) < least - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < least - 1e-9:
        return 0.0
    j = j[np.argsort(i)]
    i = np.sort(i)
    j = j[np.abs(i - j) <= len(a) + len(b) - 2 * least + 1]
    tails: list[int] = []
    for x in j.tolist():
        if not tails or x > tails[-1]:
            tails.append(x)
        else:
            tails[bisect_left(tails, x)] = x
    found = len(tails) / (len(a) + len(b) - len(tails))
    return found if found >= threshold - 1e-9 else 0.0


def text_digest() -> Column:
    """16 bytes that tell whole texts apart."""
    return F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, words_key, n, slots) of every document; n is its number of k-mers."""

    def f(doc_id: list, digest: list, text: list) -> dict:
        keys, ns, slots = [], [], []
        for t in text:
            words = normal_words(t)
            kmers = labelled(words)
            keys.append(_key(words, t))
            ns.append(len(kmers))
            slots.append(sketch(kmers) if len(kmers) else [])
        return {"doc_id": doc_id, "digest": digest, "words_key": keys, "n": ns, "slots": slots}

    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("words_key", pa.binary()), ("n", pa.int64()), ("slots", pa.list_(pa.int64()))])
    own = docs.select("doc_id", text_digest().alias("digest"), "text")
    return own.mapInArrow(rows_udf(["doc_id", "digest", "text"], schema, f), "doc_id long, digest binary, words_key binary, n long, slots array<long>")


def _key(words: list[bytes], text: str | None) -> bytes:
    return hashlib.sha256(b" ".join(words) if words else b" " + (text or "").encode()).digest()[:16]


def packed_words(docs: DataFrame) -> DataFrame:
    """(words_key, words): the words of a text, compressed."""

    def f(text: list) -> dict:
        pack = zstandard.ZstdCompressor(level=1).compress
        own = [normal_words(t) for t in text]
        return {"words_key": [_key(w, t) for w, t in zip(own, text, strict=True)], "words": [pack(b" ".join(w)) for w in own]}

    schema = pa.schema([("words_key", pa.binary()), ("words", pa.binary())])
    return docs.select("text").mapInArrow(rows_udf(["text"], schema, f), "words_key binary, words binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar; b is the hub. Of pairs that _compared has found, as many as make their classes one."""
    tasks = pairs.__dict__.get("_tasks")
    if tasks is not None:
        return tasks.applyInArrow(_links, "a long, b long")

    def f(a: list, b: list, of_a: list, of_b: list) -> dict:
        unpack, last, found = zstandard.ZstdDecompressor().decompress, (None, None), {"a": [], "b": []}
        for x, y, u, v in zip(a, b, of_a, of_b, strict=True):
            if last[0] != y:
                last = (y, labelled(unpack(v).split()))
            if similarity(labelled(unpack(u).split()), last[1]):
                found["a"].append(x)
                found["b"].append(y)
        return found

    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("words").alias("of_a")), "a").join(texts.select(F.col("rep").alias("b"), F.col("words").alias("of_b")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return both.select("a", "b", "of_a", "of_b").mapInArrow(rows_udf(["a", "b", "of_a", "of_b"], schema, f), "a long, b long")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (rep, label) after joining the labels that links (a, b) of labels connect: least labels spread, and paths are halved."""
    edges = cut(links.filter("a != b").distinct())
    if edges.isEmpty():
        return labels
    one_way = edges
    edges = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    discard(one_way)
    written = now = cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
    while True:
        near = edges.join(now.select(F.col("a").alias("b"), "to"), "b").groupBy("a").agg(F.min("to").alias("near"))
        step = now.join(near, "a").select("a", "to", F.least("to", "near").alias("via"))
        jump = now.select(F.col("a").alias("via"), F.col("to").alias("far"))
        after = cut(step.join(jump, "via").select("a", F.col("to").alias("was"), F.least("via", "far").alias("to")))
        discard(written)
        written, now = after, after.select("a", "to")
        if after.filter("was != to").isEmpty():
            break
    moved = now.select(F.col("a").alias("label"), "to")
    joined = cut(labels.join(moved, "label", "left").select("rep", F.coalesce("to", "label").alias("label")))
    discard(written, edges)
    return joined


def _main_labels(hubs: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, main): the class of each bucket's hub."""
    return hubs.join(labels.select(F.col("rep").alias("hub"), F.col("label").alias("main")), "hub").select("bucket", "main")


def _near(rows: pa.Table, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of pairs of one task, a text on the left and one on the right, that are near by their signatures, block by block and
    nearest first within one. Their labels differ when the block begins; `label` may change between blocks."""
    n = rows.column("n").to_numpy()
    on_left, on_right = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
    left, right = np.flatnonzero(on_left), np.flatnonzero(on_right)
    slot = int(rows.column("slot")[0].as_py())
    slots = np.array(rows.column("slots").to_pylist(), np.int64)
    signs = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint8).reshape(len(n), LEAST_KMERS)
    for at in range(0, len(left), 128):
        own = left[at : at + 128]
        agree = np.zeros((len(own), len(right)), np.uint8)
        fits = (label[own][:, None] != label[right]) & (np.minimum(n[own][:, None], n[right]) >= THRESHOLD * np.maximum(n[own][:, None], n[right]))
        fits &= (own[:, None] < right) | ~(on_right[own][:, None] & on_left[right])  # two texts of both sides meet once
        for k in range(SLOTS):
            same = slots[own, k][:, None] == slots[right, k]
            if k < slot:
                fits &= ~same  # the pair is met in the bucket of that slot, which is compared whole however large
            agree += same
        i, j = np.nonzero(fits & (agree >= AGREE))
        alike = np.concatenate([np.zeros(0, np.int64), *((signs[own[i[p : p + (1 << 15)]]] == signs[right[j[p : p + (1 << 15)]]]).sum(1) for p in range(0, len(i), 1 << 15))])
        order = np.argsort(-alike, kind="stable")[: int((alike >= ESTIMATE * LEAST_KMERS).sum())]
        yield own[i[order]], right[j[order]]


def _pair_table(pairs: Iterable[tuple[int, int]]) -> pa.Table:
    both = np.array(sorted({(min(x), max(x)) for x in pairs}), np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})


def _classes(rows: pa.Table) -> np.ndarray:
    return np.unique(rows.column("label").to_numpy(), return_inverse=True)[1]


def _candidates(rows: pa.Table) -> pa.Table:
    """All pairs of one task that are near by their signatures and of different classes."""
    rep = rows.column("rep").to_numpy()
    return _pair_table((int(a), int(b)) for x, y in _near(rows, _classes(rows)) for a, b in zip(rep[x], rep[y], strict=True))


def _links(rows: pa.Table) -> pa.Table:
    """Similar pairs of one task that make one class of all that its candidates connect, a tree of them."""
    rep, words, label = rows.column("rep").to_numpy(), rows.column("words"), _classes(rows)
    unpack, held_kmers, kept = zstandard.ZstdDecompressor().decompress, 0, {}
    root = [*range(int(label.max()) + 1)]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def kmers(k: int) -> np.ndarray:
        nonlocal held_kmers
        if k not in kept:
            own = labelled(unpack(words[k].as_py()).split())
            if held_kmers + len(own) > UNPACKED:
                kept.clear()
                held_kmers = 0
            kept[k] = own
            held_kmers += len(own)
        return kept[k]

    found = []
    for x, y in _near(rows, label):
        before = len(found)
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            a, b = find(label[i]), find(label[j])
            if a != b and similarity(kmers(i), kmers(j)):
                root[max(a, b)] = min(a, b)
                found.append((int(rep[i]), int(rep[j])))
        if len(found) > before:
            label[:] = np.array([find(k) for k in range(len(root))])[label]
    return _pair_table(found)


def _settle(members: DataFrame, hubs: DataFrame, labels: DataFrame, words: DataFrame, group: int = GROUP) -> DataFrame:
    """labels after the pairs in buckets that are not of one class have been compared."""
    main = _main_labels(hubs, labels)
    open_buckets = cut(members.select("bucket", "rep").join(labels, "rep").join(main, "bucket").filter("label != main").groupBy("bucket").agg(F.first("main").alias("main")))
    rest = cut(members.join(open_buckets, "bucket").join(labels, "rep").select("bucket", "slot", "rep", "n", "label", (F.col("label") != F.col("main")).alias("open")))
    if rest.isEmpty():
        return labels

    def signs(rep: list, packed: list) -> dict:
        unpack = zstandard.ZstdDecompressor().decompress
        return {"rep": rep, "sign": [signature(labelled(unpack(w).split())) for w in packed], "words": packed}

    schema = pa.schema([("rep", pa.int64()), ("sign", pa.binary()), ("words", pa.binary())])
    drawn = words.join(rest.select("rep").distinct(), "rep", "left_semi").select("rep", "words").mapInArrow(rows_udf(["rep", "words"], schema, signs), "rep long, sign binary, words binary")
    known = cut(members.groupBy("rep").agg(F.first("slots").alias("slots")).join(drawn, "rep"))
    links = cut(verified(_compared(rest, known, group), words))
    discard(rest, known, open_buckets)
    joined = _joined(labels, links)
    discard(links)
    return joined


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after links between texts."""
    named = links.join(labels.select(F.col("rep").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("rep").alias("b"), F.col("label").alias("y")), "b")
    return components(labels, named.select(F.col("x").alias("a"), F.col("y").alias("b")))


def _compared(rest: DataFrame, known: DataFrame, group: int) -> DataFrame:
    """Candidates (a, b) among all pairs with an open text in the buckets of `rest`; a task holds two parts of a bucket, low <= high. The
    pairs, which may grow with the square of a bucket, are made only for who asks for them; verified() asks the tasks for links."""
    sized = rest.groupBy("bucket").agg(F.count("*").alias("size"), F.count_if("open").alias("opens"), F.sum("n").alias("kmers"))
    each = F.least(F.lit(group), F.greatest(F.lit(1), F.floor(PART_KMERS * F.col("size") / F.greatest("kmers", F.lit(1)))))
    sized = cut(sized.withColumn("group", each))
    group = F.col("group")
    small = rest.join(sized.filter(F.col("size") <= group).select("bucket"), "bucket")
    small = small.select("bucket", F.lit(0).alias("low"), F.lit(0).alias("high"), "slot", "rep", "n", "label", F.col("open").alias("left"), F.lit(True).alias("right"))
    # open texts are dealt into the parts before `opened`, the others into those from there to `parts`
    opened = F.ceil(F.col("opens") / group).cast("int")
    parts = (opened + F.ceil((F.col("size") - F.col("opens")) / group)).cast("int")
    large = rest.join(sized.filter(F.col("size") > group).select("bucket", opened.alias("opened"), parts.alias("parts")), "bucket")
    own = F.when(F.col("open"), F.pmod(F.xxhash64("rep"), F.col("opened"))).otherwise(F.col("opened") + F.pmod(F.xxhash64("rep"), F.greatest(F.col("parts") - F.col("opened"), F.lit(1))))
    # an open text meets every part, another one the parts of open texts
    met = F.explode(F.sequence(F.lit(0), F.when(F.col("open"), F.col("parts")).otherwise(F.col("opened")) - 1))
    large = large.withColumn("own", own.cast("int")).withColumn("met", met)
    large = large.select("bucket", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), "slot", "rep", "n", "label", (F.col("own") <= F.col("met")).alias("left"), (F.col("own") >= F.col("met")).alias("right"))
    tasks = small.unionByName(large).join(known, "rep").select("bucket", "low", "high", "slot", "rep", "n", "label", "left", "right", "slots", "sign", "words").groupBy("bucket", "low", "high")
    pairs = tasks.applyInArrow(_candidates, "a long, b long")
    pairs.__dict__["_tasks"] = tasks
    return pairs


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept), a row for each row of docs."""
    return _classified(docs).select("doc_id", "class_id", "kept")


def _classified(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, class_id, kept); kept rows of a class are equal in doc_id and text."""
    bounded_batches(docs.sparkSession)
    drawn = cut(sketches(docs))
    # a class is named by the least of these: smallest doc_id, null ids last
    name = F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "digest")
    texts = cut(drawn.groupBy("words_key").agg(F.min(name).alias("name"), F.first("n").alias("n"), F.first("slots").alias("slots")).withColumn("rep", F.monotonically_increasing_id()))
    slots = texts.select("rep", F.posexplode("slots").alias("slot", "value")).select("rep", "slot", F.xxhash64("slot", "value").alias("bucket"))
    # a written table, so that the join can split a bucket that very many texts share
    sizes = cut(slots.groupBy("bucket").count().filter("count > 1"))
    central = slots.join(sizes, "bucket").groupBy("rep").agg(F.sum("count").alias("central"))
    known = cut(texts.select("rep", "n", "slots").join(central, "rep"))
    members = cut(slots.join(sizes.select("bucket"), "bucket").join(known, "rep").select("bucket", "slot", "rep", "n", "central", "slots"))
    discard(sizes)

    sought = texts.select("rep", "words_key").join(known.select("rep"), "rep", "left_semi")
    words = cut(packed_words(docs).dropDuplicates(["words_key"]).join(sought, "words_key").select("rep", "words"))
    order = F.max(F.struct("central", (-F.col("rep")).alias("minus"))).alias("best")
    hubs = cut(members.groupBy("bucket").agg(order).select("bucket", (-F.col("best.minus")).alias("hub")))
    lengths = known.select("rep", "n")
    alike = F.least("n", "hub_n") >= THRESHOLD * F.greatest("n", "hub_n")
    first = members.select("bucket", "rep", "n").join(hubs, "bucket").filter("rep != hub").select("rep", "n", "hub").distinct()
    first = first.join(lengths.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n")), "hub").filter(alike)
    links = verified(first.select(F.col("rep").alias("a"), F.col("hub").alias("b")), words)
    labels = components(lengths.select("rep", F.col("rep").alias("label")), links)
    labels = _settle(members, hubs, labels, words)
    discard(members, words, hubs)

    classes = cut(texts.select("words_key", "rep", "name").join(labels, "rep", "left").select("words_key", "name", F.coalesce("label", "rep").alias("label")))
    discard(texts, labels, known)
    names = cut(classes.groupBy("label").agg(F.min("name").alias("best")))
    named = cut(classes.select("words_key", "label").join(names, "label").select("words_key", "best"))
    found = drawn.select("doc_id", "digest", "words_key").join(named, "words_key")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    return found.select("doc_id", "digest", F.col("best.doc_id").alias("class_id"), kept.alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, exactly one of each class, with all their columns."""
    kept = cut(_classified(docs).filter("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows")))
    return one_of_each(docs, kept, text_digest())


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, kept of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
