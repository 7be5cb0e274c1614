"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its host and path say.

A logistic classifier of text statistics, fitted here on a bounded sample of labelled rows (at most SAMPLE of each kind, the first in the
order of their ids' hashes, none of which is in the held-out fold), gives each document a probability and so a likelihood ratio. Hosts and
paths gather those of all their documents by grouped aggregation. A host's mean is shrunk towards the global mean, a path's towards its
host's, by pseudo-counts estimated from how much the means differ beyond what chance explains: a site with few
documents keeps the prior. A document's own probability is taken out of its site's sums, so it does not speak twice. The posterior
odds are the likelihood ratio times the odds of the site's shrunk mean. Tables with a URL get host and path by with_site(); documents has
none, so op10 takes `source` for the host and `lang` for the path.

Defined cases: null counts as the empty text; null hosts are one host, null paths of a host one path; texts may be of any length; rows that
repeat count as often as they occur; contradicting labels of a document count as low quality, labels other than 0 and 1 are passed
over; without labels of both kinds each text's evidence is 0.5; an empty table gives an empty result; other columns stay unread.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.llm.common import bounded_batches, cut, rows_udf, table

SAMPLE, FOLDS, RIDGE = 3000, 5, 1.0
#: Bounds of a document's probability; largest pseudo-count; threshold of the posterior.
LEAST, MOST_PRIOR, KEEP = 0.002, 1e4, 0.5
#: Byte classes whose shares are features: letters of either case, bytes of other scripts, digits, marks by kind, line ends.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", bytes(range(128, 256)), b"0123456789", b"|", b"!", b"$%&*#", b".", b",", b"\"'`", b":;?()[]{}<>=/\\@_+-^~", b"\n", b" \t\r\x0b\x0c")
_CLASS = np.full(256, len(CLASSES))
for _k, _c in enumerate(CLASSES):
    _CLASS[list(_c)] = _k
FEATURES = 2 * (len(CLASSES) + 3) + 3


def features(text: str) -> np.ndarray:
    raw = text.encode()
    counts = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), len(CLASSES) + 1)[: len(CLASSES)]
    words = text.split()
    n = max(len(words), 1)
    lines = text.split("\n")
    repeats = sum(map(operator.eq, words, words[1:])) / n
    shares = np.concatenate([counts / max(len(raw), 1), [repeats, 1 - len(set(words)) / n, 1 - len(set(lines)) / len(lines)]])
    return np.concatenate([shares, np.log1p(200 * shares), [np.log1p(len(words)), np.log1p(len(raw) / n), np.log1p(n / len(lines))]])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the features, coefficients with the intercept last; Newton's method on the ridge-penalised log loss."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    beta, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], RIDGE)
    ridge[-1] = 1e-3

    def loss(b: np.ndarray) -> float:
        t = z @ b
        return float((weight * (np.logaddexp(0, t) - y * t)).sum() + 0.5 * (ridge * b * b).sum())

    now = loss(beta)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        g = z.T @ (weight * (p - y)) + ridge * beta
        h = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(ridge)
        step, size = np.linalg.solve(h, g), 1.0
        while (new := loss(beta - size * step)) > now and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if now - new < 1e-9:
            break
        now = new
    return mean, scale, beta


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame) -> tuple | None:
    """The classifier and its training share of good documents; None without labels of both kinds."""
    bounded_batches(docs.sparkSession)
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).filter(~held_out(F.col("doc_id")))
    known = cut(known.join(docs.select("doc_id"), "doc_id", "left_semi"))
    total = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(total) < 2:
        return None
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.filter("quality = 1").orderBy(*order).limit(SAMPLE).unionByName(known.filter("quality = 0").orderBy(*order).limit(SAMPLE))
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.list_(pa.float64()))])
    f = rows_udf(["doc_id", "quality", "text"], schema, lambda i, y, t: {"doc_id": i, "quality": y, "x": [features(s or "") for s in t]})
    own = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text").mapInArrow(f, "doc_id long, quality int, x array<double>")
    rows = sorted((r["doc_id"], r["quality"], r["x"]) for r in own.toArrow().to_pylist())
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float)
    weight = np.where(y == 1, total[1] / max(y.sum(), 1), total[0] / max((1 - y).sum(), 1))
    return fit_logistic(x, y, weight / weight.mean()), total[1] / (total[0] + total[1])


def with_site(docs: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """docs with the host (lower case, without a leading www. and the port) and the first level of the path of their URLs, for tables that
    have one; null and malformed URLs give null."""
    of = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/?#:]+)", 1)
    level = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1)
    return docs.withColumn(host, F.lower(F.when(of != "", of))).withColumn(path, F.when(of != "", F.when(level != "", level).otherwise("/")))


def evidence(docs: DataFrame, model: tuple | None, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, host, path, evidence): the classifier's probability of every whole text."""
    bounded_batches(docs.sparkSession)
    long, text_ = pa.int64(), pa.string()
    schema = pa.schema([("doc_id", long), ("host", text_), ("path", text_), ("evidence", pa.float64())])

    def f(doc_id: list, host: list, path: list, text: list) -> dict:
        if model is None:
            p = np.full(len(text), 0.5)
        else:
            (mean, scale, beta), _ = model
            x = (np.array([features(t or "") for t in text]).reshape(-1, FEATURES) - mean) / scale
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -40, 40))), LEAST, 1 - LEAST)
        return {"doc_id": doc_id, "host": host, "path": path, "evidence": p}

    own = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), "text")
    return own.mapInArrow(rows_udf(["doc_id", "host", "path", "text"], schema, f), "doc_id long, host string, path string, evidence double")


def pseudo_count(groups: DataFrame, mean: str, total: float) -> float:
    """The beta prior's weight, from n, s (sum) and q (sum of squares) of groups around `mean`, by the method of moments."""
    m = F.col("s") / F.col("n")
    within = F.sum(F.col("q") - F.col("s") * m)
    row = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * (m - F.col(mean)) ** 2).alias("between"), within.alias("within"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not row["n"] or row["n"] <= row["k"] or row["k"] < 2:
        return MOST_PRIOR
    noise = row["within"] / (row["n"] - row["k"])
    spread = (row["between"] - (row["k"] - 1) * noise) / max(row["n"] - row["nn"] / row["n"], 1e-9)
    return float(min(MOST_PRIOR, max(noise / spread, 1.0))) if spread > 0 else MOST_PRIOR


def posterior(found: DataFrame, prior: float) -> DataFrame:
    """found (doc_id, host, path, evidence), read several times, with host_mean, path_mean and score."""
    sums = (F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") ** 2).alias("q"))
    paths = cut(found.groupBy("host", "path").agg(*sums))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")))
    row = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = row["s"] / row["n"] if row["n"] else prior
    of_host = pseudo_count(hosts.withColumn("m", F.lit(mean)), "m", mean)
    shrunk = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + of_host * mean) / (F.col("n") + of_host)).alias("host_mean"))
    joined = cut(paths.join(shrunk, "host"))
    of_path = pseudo_count(joined, "host_mean", mean)
    p = F.col("evidence")
    both = found.join(joined.select("host", "path", F.col("n").alias("path_n"), F.col("s").alias("path_s"), "host_n", "host_s"), ["host", "path"])
    both = both.withColumn("host_mean", (F.col("host_s") - p + of_host * mean) / (F.col("host_n") - 1 + of_host))
    both = both.withColumn("path_mean", (F.col("path_s") - p + of_path * F.col("host_mean")) / (F.col("path_n") - 1 + of_path))

    def odds(x):
        return F.log(x / (1 - x))

    bounded = F.least(F.greatest(F.col("path_mean"), F.lit(LEAST)), F.lit(1 - LEAST))
    score = 1 / (1 + F.exp(-(odds(p) - float(np.log(prior / (1 - prior))) + odds(bounded))))
    return both.select("doc_id", "host", "path", "evidence", "host_mean", "path_mean", score.alias("score"))


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path, evidence, host_mean, path_mean, score, kept, a row for each row of docs."""
    model = fit(docs, labels)
    found = cut(evidence(docs, model, host, path))
    return posterior(found, model[1] if model else 0.5).withColumn("kept", F.col("score") >= KEEP)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, evidence, host_mean, path_mean, score, kept of every document."""
    found = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "evidence", "host_mean", "path_mean", "score", "kept")
