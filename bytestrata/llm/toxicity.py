"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word enters as an embedding of itself and the mean embedding of its character n-grams (both hashed). Windows of WINDOW words, a new
one every STRIDE words so that neighbours overlap, run through a GRU in both directions; attention weighs its states, and a logistic
unit scores their sum. A text's score is that of its highest window, calibrated on the labelled texts. Every window of every whole
text is scored; nothing but the text is an input.

Labels are of documents, not windows, so training goes in rounds: first every window has its document's label, then
the highest windows of toxic documents stand against windows (the highest, and others) of the rest. Words and n-grams that few
documents hold add nothing, so that rare ones are not learned by heart; part of the sample is kept for the calibration alone, which
goes by the highest of all windows of its whole texts, as scoring does. The sample is bounded: at most POSITIVES and NEGATIVES
labelled documents, the first in the order of their ids' hashes; of a longer text SAMPLE_WINDOWS windows are learned from.

Defined cases: null counts as the empty text, which has one window of no words; texts may be of any length; rows that repeat score
alike; documents with contradicting labels count as toxic, labels other than 0 and 1 (null too) are passed over; without labels of both
kinds each score is the share of toxic ones (0 without any); an empty table gives an empty result; other columns stay unread.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.llm.common import bounded_batches, cut, discard, held, mixed, rows_udf, table

WINDOW, STRIDE = 24, 16
#: Buckets of word and n-gram hashes, sizes of both embeddings, of a GRU's state and of the attention.
WORDS, GRAMS, D_WORD, D_CHAR, HIDDEN, ATTENTION = 1 << 15, 1 << 15, 8, 8, 8, 8
POSITIVES, NEGATIVES, SAMPLE_WINDOWS = 800, 2400, 16
ROUNDS, BATCH, RATE, DECAY = 6, 256, 0.01, 2.0
#: Steps of a round at least: a small sample is gone through more than once.
LEAST_STEPS = 30
#: Share of the toxic documents, as a number of documents, that must hold a word or an n-gram for it to count at all, and its least value;
#: every CALIBRATED-th document is kept for calibration.
LEAST_WORD, LEAST_GRAM, CALIBRATED = (0.01, 3), (0.02, 4), 5
#: Distinct words whose inputs a worker remembers; windows scored at a time, and words embedded at a time.
WORD_MEMO, BLOCK, NEW_WORDS = 200_000, 1024, 1 << 14
FOLDS = 5
_STRIP = string.punctuation + string.whitespace


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, the buckets of all words' n-grams in a row, where a word's begin, and how many they are."""
    parts = [_features(words[at : at + NEW_WORDS]) for at in range(0, len(words), NEW_WORDS)]
    bucket, grams, count = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 3))
    return bucket, grams, np.cumsum(count) - count, count


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, the buckets of all words' n-grams of 3 to 5 characters in a row, where a word's begin, and how many they are.
    Bucket 0 stands for nothing."""
    marked = [f"<{w}>" if (w := x.strip(_STRIP).lower()) else "" for x in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([*map(len, marked)], np.int64)
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(codes))  # characters from here to the word's end
    word = np.repeat(np.arange(len(words)), size)
    h, parts, owners = np.zeros(len(codes), np.uint64), [], []
    for n in range(1, 6):
        h[: len(codes) - n + 1] = h[: len(codes) - n + 1] * _FACTOR + mixed(codes[n - 1 :] + np.uint64(n))
        if n >= 3:
            own = np.flatnonzero(left >= n)
            parts.append(mixed(h[own]) % np.uint64(GRAMS - 1) + np.uint64(1))
            owners.append(word[own])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    grams = np.concatenate(parts)[order].astype(np.int32)
    count = np.bincount(owner, minlength=len(words))
    total = np.zeros(len(words), np.uint64)
    place = (np.arange(len(codes)) - np.repeat(end - size, size)).astype(np.uint64)
    np.add.at(total, word, mixed(codes * _FACTOR + place))
    bucket = np.where(size > 0, (mixed(total) % np.uint64(WORDS - 1)).astype(np.int64) + 1, 0)
    return bucket, grams, np.cumsum(count) - count, count


def chosen_features(features: tuple, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bucket, grams, start, count = features
    count = count[rows]
    end = np.cumsum(count)
    at = np.repeat(start[rows] - (end - count), count) + np.arange(end[-1] if len(end) else 0)
    return bucket[rows], grams[at], end - count, count


def windows_of(n: int, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Word numbers of each window of n words (of those that start from begin, a multiple of STRIDE, to end); n stands for padding."""
    last = max(n - WINDOW + STRIDE, 1)
    starts = np.arange(begin, last if end is None else min(last, end), STRIDE)
    return np.minimum(starts[:, None] + np.arange(WINDOW), n)


class Network:
    """Parameters, forward and backward passes. Directions are stacked on the first axis."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        d, h, a = D_WORD + D_CHAR, HIDDEN, ATTENTION
        self.p = {
            "word": normal(WORDS, D_WORD, scale=0.05), "gram": normal(GRAMS, D_CHAR, scale=0.1),
            "wx": normal(2, d, 3 * h, scale=d**-0.5), "bx": np.zeros((2, 1, 3 * h), np.float32),
            "u": normal(2, h, 3 * h, scale=h**-0.5), "bn": np.zeros((2, 1, h), np.float32),
            "wa": normal(2 * h, a, scale=(2 * h) ** -0.5), "ba": np.zeros(a, np.float32), "va": normal(a, scale=a**-0.5),
            "wo": normal(2 * h, scale=(2 * h) ** -0.5), "bo": np.zeros(1, np.float32),
        }
        self.known = {"word": np.ones(WORDS, bool), "gram": np.ones(GRAMS, bool)}
        self.forget()
        self.shift = 0.0

    def forget(self) -> None:
        """Set to zero what is not known."""
        for k, known in self.known.items():
            known[0] = False
            self.p[k][~known] = 0

    def inputs(self, bucket: np.ndarray, grams: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Embedded words."""
        chars = np.zeros((len(bucket), D_CHAR), self.p["gram"].dtype)
        if len(grams):
            chars[count > 0] = np.add.reduceat(self.p["gram"][grams], start[count > 0], axis=0)
        chars /= np.maximum(count, 1)[:, None]
        return np.concatenate([self.p["word"][bucket], chars], axis=1).astype(np.float32)

    def projected(self, inputs: np.ndarray) -> np.ndarray:
        """What a word adds to the gates, (words, 2, 3 * HIDDEN)."""
        return np.ascontiguousarray(((inputs @ self.p["wx"]) + self.p["bx"]).transpose(1, 0, 2))

    def table(self, features: tuple) -> np.ndarray:
        """projected() of all words of features, a part at a time."""
        n = len(features[0])
        return np.concatenate([self.projected(self.inputs(*chosen_features(features, np.arange(at, min(at + NEW_WORDS, n))))) for at in range(0, n, NEW_WORDS)])

    def run(self, x: np.ndarray, keep: bool = False):
        """x: (2, T, B, 3H), the second direction reversed -> states (2, T, B, H), and what backward() needs."""
        h_size, (_, steps, b, _) = HIDDEN, x.shape
        h, states, saved = np.zeros((2, b, h_size), np.float32), np.empty((2, steps, b, h_size), np.float32), []
        for t in range(steps):
            a = h @ self.p["u"]
            rz = x[:, t, :, : 2 * h_size] + a[..., : 2 * h_size]
            rz *= 0.5
            np.tanh(rz, out=rz)
            rz += 1
            rz *= 0.5
            r, z = rz[..., :h_size], rz[..., h_size:]
            hn = a[..., 2 * h_size :] + self.p["bn"]
            n = np.tanh(x[:, t, :, 2 * h_size :] + r * hn)
            new = n + z * (h - n)
            if keep:
                saved.append((h, r, z, hn, n))
            h = states[:, t] = new
        return states, saved

    def pool(self, states: np.ndarray, real: np.ndarray):
        """Attention over real words; states (2, T, B, H), real (T, B)."""
        both = np.concatenate([states[0], states[1, ::-1]], axis=-1)
        e = np.tanh(both @ self.p["wa"] + self.p["ba"])
        s = np.where(real, e @ self.p["va"], np.float32(-1e9))
        w = np.exp(s - s.max(0)) * real
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = (w[..., None] * both).sum(0)
        return pooled @ self.p["wo"] + self.p["bo"], (both, e, w, pooled)

    def logits(self, table_: np.ndarray, index: np.ndarray, padding: int) -> np.ndarray:
        """Of windows of rows of projected words."""
        out = np.empty(len(index), np.float32)
        for at in range(0, len(index), BLOCK):
            own = index[at : at + BLOCK].T
            x = table_[own]  # (T, B, 2, 3H)
            states, _ = self.run(np.stack([x[:, :, 0], x[::-1, :, 1]]))
            out[at : at + BLOCK], _ = self.pool(states, own != padding)
        return out

    def gradients(self, features: tuple, index: np.ndarray, padding: int, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, for windows of rows of features."""
        p, h_size = self.p, HIDDEN
        rows, inverse = np.unique(index.T, return_inverse=True)
        own = chosen_features(features, rows)
        inp = self.inputs(*own)
        inverse = inverse.reshape(index.T.shape)
        x = self.projected(inp)[inverse]
        states, saved = self.run(np.stack([x[:, :, 0], x[::-1, :, 1]]), keep=True)
        logit, (both, e, w, pooled) = self.pool(states, index.T != padding)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        g["wo"], g["bo"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["wo"]
        dboth = w[..., None] * dp
        dw = (both * dp).sum(-1)
        ds = w * (dw - (w * dw).sum(0))
        g["va"] = (e * ds[..., None]).sum((0, 1))
        de = ds[..., None] * p["va"] * (1 - e * e)
        g["ba"] = de.sum((0, 1))
        g["wa"] = np.einsum("tbi,tbj->ij", both, de)
        dboth += de @ p["wa"].T
        dstates = np.stack([dboth[..., :h_size], dboth[::-1, :, h_size:]])
        dx = np.empty((2, *x.shape[:2], 3 * h_size), np.float32)
        dh = np.zeros_like(states[:, 0])
        for t in reversed(range(x.shape[0])):
            h, r, z, hn, n = saved[t]
            dh = dh + dstates[:, t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            dx[:, t] = np.concatenate([dr, dz, dn], -1)
            da = np.concatenate([dr, dz, dn * r], -1)
            g["u"] += h.transpose(0, 2, 1) @ da
            g["bn"] += (dn * r).sum(1, keepdims=True)
            dh = dh * z + da @ p["u"].transpose(0, 2, 1)
        flat = inverse.ravel()
        order = np.argsort(flat, kind="stable")
        both = np.stack([dx[0], dx[1, ::-1]]).reshape(2, len(flat), 3 * h_size)
        words = np.add.reduceat(both[:, order], np.searchsorted(flat[order], np.arange(len(rows))), axis=1)
        g["bx"] = words.sum(1, keepdims=True)
        g["wx"] = inp.T @ words
        dinp = (words @ p["wx"].transpose(0, 2, 1)).sum(0)
        bucket, grams, _, count = own
        each = dinp[:, D_WORD:] / np.maximum(count, 1)[:, None]
        used = self.known["gram"][grams]
        for k, at, what in (("word", bucket, dinp[:, :D_WORD]), ("gram", grams[used], np.repeat(each, count, axis=0)[used])):
            for c in range(what.shape[1]):
                g[k][:, c] = np.bincount(at, what[:, c], len(g[k]))
        for k, known in self.known.items():
            g[k][~known] = 0
        return g


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _known(net: Network, features: tuple, doc: np.ndarray, index: np.ndarray, padding: int, positive: int) -> None:
    """Forget buckets that too few documents of the sample hold."""
    pairs = np.unique(doc[:, None] * (padding + 1) + index)
    of, word = pairs // (padding + 1), pairs % (padding + 1)
    bucket = features[0]
    least_word, least_gram = (max(share * positive, least) for share, least in (LEAST_WORD, LEAST_GRAM))
    held = np.unique(of * WORDS + bucket[word]) % WORDS
    net.known["word"] &= np.bincount(held, minlength=WORDS) >= least_word
    count = np.zeros(GRAMS, np.int64)
    for k in range(0, len(pairs), 100_000):  # a document that meets a border counts twice there
        _, own, _, n = chosen_features(features, word[k : k + 100_000])
        count += np.bincount(np.unique(np.repeat(of[k : k + 100_000], n) * GRAMS + own) % GRAMS, minlength=GRAMS)
    net.known["gram"] &= count >= least_gram
    net.forget()


def train(documents: list[tuple[int, list[str]]], seed: int = 0) -> Network:
    """documents: (label, windows as words joined by one space); every CALIBRATED-th is not learned from. The result is not calibrated."""
    rng, net = np.random.default_rng(seed), Network(seed)
    vocabulary: dict[str, int] = {}
    doc, label, index = [], [], []
    for k, (y, windows) in enumerate(documents):
        for w in windows:
            doc.append(k)
            label.append(y)
            own = [vocabulary.setdefault(x, len(vocabulary)) for x in w.split()]
            index.append(np.array(own + [-1] * (WINDOW - len(own)), np.int32))
    padding = len(vocabulary)
    index = np.array(index).astype(np.int64).reshape(-1, WINDOW)
    index[index < 0] = padding
    doc, label = np.array(doc), np.array(label)
    features = word_features([*vocabulary, ""])
    _known(net, features, doc, index, padding, sum(y for y, _ in documents))
    held = doc % CALIBRATED == 0
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0

    def scores() -> np.ndarray:
        return net.logits(net.table(features), index, padding)

    for turn in range(ROUNDS):
        use = (label == 1) & ~held
        clean = np.flatnonzero((label == 0) & ~held)
        if turn:
            s = scores()
            highest = np.full(len(documents), -np.inf)
            np.maximum.at(highest, doc, s)
            use &= (s >= highest[doc]) | (s > np.quantile(s[clean], 0.995))
            hard = clean[np.argsort(-s[clean])[: len(clean) // 8]]
            clean = np.concatenate([hard, rng.choice(clean, min(len(clean), 4 * int(use.sum()) + 300), replace=False)])
        else:
            clean = rng.choice(clean, min(len(clean), 4 * int(use.sum()) + 300), replace=False)
        chosen = np.concatenate([np.flatnonzero(use), clean])
        passes = -(-LEAST_STEPS // max(1, -(-len(chosen) // BATCH)))
        chosen = np.concatenate([rng.permutation(chosen) for _ in range(passes)])
        rate = RATE * (1 if turn < ROUNDS - 2 else 0.3)
        for at in range(0, len(chosen), BATCH):
            own = chosen[at : at + BATCH]
            step += 1
            for k, g in net.gradients(features, index[own], padding, label[own].astype(np.float32)).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
                if k in net.known:  # embeddings that few windows ask for fade
                    net.p[k] *= 1 - rate * DECAY
    return net


def calibration(highest: np.ndarray, y: np.ndarray, clean_weight: float = 1.0) -> float:
    """The shift that puts the threshold at 0: with each kind at its weight in the labels, the fewest errors, in the widest gap."""
    order = np.argsort(highest, kind="stable")
    x, y = highest[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y == 1)]) + clean_weight * (np.sum(y == 0) - np.concatenate([[0], np.cumsum(y == 0)]))
    ends = np.concatenate([[x[0] - 2], x, [x[-1] + 2]])
    gap = np.where(errors <= errors.min() + 1e-9, np.diff(ends), -1)
    best = int(np.argmax(gap))
    return -float(ends[best] + ends[best + 1]) / 2


class Scorer:
    """Scores whole texts; remembers the inputs of words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self._empty()

    def _empty(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((WORD_MEMO + 1, 2, 3 * HIDDEN), np.float32)
        self.table[0] = self.net.projected(self.net.inputs(*word_features([""])))[0]

    def __call__(self, texts: list[str]) -> list[float]:
        """Row 0 of the table is padding."""
        split = [t.split() for t in texts]
        met = set().union(*split)
        new = [w for w in met if w not in self.row]
        if len(self.row) + len(new) > WORD_MEMO:
            self._empty()
            new = [*met]
        if new:
            at = len(self.row) + 1
            if at + len(new) > len(self.table):  # one batch of more words than the memo holds
                self.table = np.concatenate([self.table, np.zeros((at + len(new) - len(self.table), 2, 3 * HIDDEN), np.float32)])
            self.row.update(zip(new, range(at, at + len(new)), strict=True))
            for k in range(0, len(new), NEW_WORDS):
                part = new[k : k + NEW_WORDS]
                self.table[at + k : at + k + len(part)] = self.net.projected(self.net.inputs(*word_features(part)))
        highest = np.full(len(split), -np.inf)
        windows, owners, many = [], [], 0
        for k, s in enumerate(split):
            rows = np.zeros(len(s) + 1, np.int64)
            rows[: len(s)] = np.fromiter(map(self.row.__getitem__, s), np.int64, len(s))
            for at in range(0, max(len(s), 1), STRIDE * BLOCK):  # windows of a long text come in pieces
                windows.append(rows[windows_of(len(s), at, at + STRIDE * BLOCK)])
                owners.append(np.full(len(windows[-1]), k))
                many += len(windows[-1])
                if many >= BLOCK:
                    self._raise(highest, windows, owners)
                    windows, owners, many = [], [], 0
        if many:
            self._raise(highest, windows, owners)
        return _sigmoid(highest + self.net.shift).tolist()

    def _raise(self, highest: np.ndarray, windows: list[np.ndarray], owners: list[np.ndarray]) -> None:
        np.maximum.at(highest, np.concatenate(owners), self.net.logits(self.table, np.concatenate(windows), 0))


def _scorer(model: Network | float) -> Scorer | None:
    """Of one task; what other operators remember in this worker goes first."""
    held("toxicity", dict)
    return None if isinstance(model, float) else Scorer(model)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def training_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the documents that may be learned from."""
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    return known.join(docs.select("doc_id"), "doc_id", "left_semi")


def labelled_windows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, toxic, windows) of the bounded training sample."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.filter("toxic = 1").orderBy(*order).limit(POSITIVES).unionByName(known.filter("toxic = 0").orderBy(*order).limit(NEGATIVES))

    def f(doc_id: list, toxic: list, text: list) -> dict:
        out = {"doc_id": doc_id, "toxic": toxic, "windows": []}
        for i, t in zip(doc_id, text, strict=True):
            words = (t or "").split()
            windows = windows_of(len(words))
            if len(windows) > SAMPLE_WINDOWS:
                windows = windows[np.sort(np.random.default_rng(abs(i)).choice(len(windows), SAMPLE_WINDOWS, replace=False))]
            out["windows"].append([" ".join(words[k] for k in w if k < len(words)) for w in windows.tolist()])
        return out

    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("windows", pa.list_(pa.string()))])
    own = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")
    return own.mapInArrow(rows_udf(["doc_id", "toxic", "text"], schema, f), "doc_id long, toxic int, windows array<string>")


def fit(docs: DataFrame, labels: DataFrame) -> Network | float:
    """A network, or the score of every text where one kind of label is missing."""
    bounded_batches(docs.sparkSession)
    known = cut(training_labels(docs, labels))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = cut(labelled_windows(docs, known))
    rows = [(r["toxic"], r["windows"]) for r in sorted(sample.toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["toxic"], r["windows"]))]
    positive = sum(y for y, _ in rows)
    if not 0 < positive < len(rows):
        return positive / max(len(rows), 1)
    weight = counts.get(0, 0) / (len(rows) - positive) / (counts[1] / positive)
    net = train(rows)
    ids = sorted((r["doc_id"], r["toxic"]) for r in sample.select("doc_id", "toxic").collect())
    kept = ids[::CALIBRATED]
    if not 0 < sum(y for _, y in kept) < len(kept):
        kept = ids
    own = docs.sparkSession.createDataFrame(sorted(set(kept)), "doc_id long, toxic int")
    found = score(docs.join(F.broadcast(own), "doc_id", "left_semi"), net).join(own, "doc_id").select("score", "toxic").orderBy("score", "toxic").collect()
    x = np.clip(np.array([r["score"] for r in found]), 1e-15, 1 - 1e-15)
    net.shift = calibration(np.log(x / (1 - x)), np.array([r["toxic"] for r in found]), weight)
    discard(known, sample)
    return net


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # a few MB, whatever the input
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        scorer = _scorer(sent.value)
        yield from rows_udf(["doc_id", "text"], schema, lambda i, t: {"doc_id": i, "score": scorer([x or "" for x in t]) if scorer else [sent.value] * len(i)})(batches)

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Network | float) -> DataFrame:
    """The rows of docs whose text scores below 0.5, with all their columns."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = _scorer(sent.value)
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            yield b.filter(pa.array([s < 0.5 for s in (scorer(texts) if scorer and texts else [sent.value] * len(texts))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
