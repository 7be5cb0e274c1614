"""Decisions about content: which transform a text calls for, and whether one pays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytestrata.functions import profile as p
from bytestrata.functions.checksums import fletcher
from bytestrata.operators.profile import order1_entropy
from bytestrata.operators.windows import common_prefix, ordered

#: A trial looks at an eighth of a text and no more than this; what it saves has to exceed a 1024th.
SAMPLE, MARGIN_SHIFT = 1 << 17, 10


def simple_score(n: Column, texty: Column) -> Column:
    """100 if over half of the characters are of text, else 0; under 16 characters nothing is."""
    return F.when((n >= 16) & (F.floor(n / (texty + 1)) < 2), 100).otherwise(0).cast("long")


def crlf_text(text: Column, n: Column, texty: Column) -> Column:
    """Whether it is text whose lines end in a carriage return and a line feed."""
    return (simple_score(n, texty) >= 88) & p.crlf_fits(n, p.count_of(text, "\n"), p.count_of(text, "\r"))


def line_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lines, fresh, shared, fits): lines that begin unlike the line before, characters shared with it (31 at most, none for lines
    that begin with a space), and whether leaving shared beginnings out pays: runs of four lines, three characters a line, short lines."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line"))
    before = F.lag("line").over(ordered(["doc_id"], ["k"]))
    own = lines.withColumn("before", before).withColumn("same", common_prefix(F.col("line"), F.col("before"), 31))
    indented = F.startswith("line", F.lit(" "))
    fresh = F.count_if(F.col("before").isNotNull() & ((F.col("same") == 0) | indented)) + 1
    found = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), fresh.alias("fresh"), F.sum(F.when(indented, 0).otherwise(F.col("same"))).cast("long").alias("shared"), F.sum(F.length("line") + 1).alias("chars"))
    c = F.col
    fits = (F.floor(c("lines") / c("fresh")) >= 4) & (F.floor((c("shared") + 1) / c("lines")) > 3) & (F.floor(c("chars") / c("lines")) < 40)
    return found.select("doc_id", "lines", "fresh", "shared", fits.alias("fits"))


def block_rle_score(data: bytes) -> int:
    """Whole words of four bytes score their equal neighbouring bytes; a word that repeats, that again and what the one before scored and one more, modulo 128."""
    words = np.frombuffer(data, np.uint8, len(data) // 4 * 4).reshape(-1, 4)
    if not len(words):
        return 0
    equal = (words[:, 1:] == words[:, :-1]).sum(1)
    new = np.concatenate([[True], (words[1:] != words[:-1]).any(1)])
    starts = np.flatnonzero(new)
    repeats = np.arange(len(words)) - starts[np.cumsum(new) - 1]
    return int(np.where(repeats == 0, equal, ((repeats + 1) * equal + repeats) & 127).sum())


def block_rle(payloads: DataFrame, threshold: int = 1) -> DataFrame:
    """(doc_id, bytes, score, fits): fits where the score is at least `threshold` a byte."""

    def run(batches):
        for b in batches:
            data = [x or b"" for x in b.column("payload").to_pylist()]
            score = [block_rle_score(x) for x in data]
            fits = [len(x) >= 40 and s >= threshold * len(x) for x, s in zip(data, score, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([*map(len, data)], pa.int64()), pa.array(score, pa.int64()), pa.array(fits, pa.bool_())], ["doc_id", "bytes", "score", "fits"])

    return payloads.select("doc_id", "payload").mapInArrow(run, "doc_id long, bytes long, score long, fits boolean")


def trial_gate(docs: DataFrame, transform: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, baseline, candidate, applied): order-1 costs of a sample as it is and transformed; applied if that saves more than the margin."""
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = sample.select("doc_id", F.substring(F.col("text"), F.lit(1), F.least(F.floor(F.length("text") / 8), F.lit(SAMPLE)).cast("int")).alias("text"))
    both = sample.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), transform(F.col("text")).alias("text")))).alias("v"))
    # side and id in one number, so that each cost is of one text
    cost = order1_entropy(both.select((F.col("doc_id") * 2 + F.col("v.side")).alias("doc_id"), F.col("v.text").alias("text")))
    costs = cost.groupBy(F.shiftright("doc_id", 1).alias("doc_id")).agg(F.sum(F.when(F.col("doc_id") % 2 == 0, F.col("cost"))).alias("baseline"), F.sum(F.when(F.col("doc_id") % 2 != 0, F.col("cost"))).alias("candidate"))
    return costs.withColumn("applied", F.col("baseline") > F.col("candidate") + F.shiftright("candidate", MARGIN_SHIFT))


def preceding_matches(docs: DataFrame, stride: int = 16, context: int = 4) -> DataFrame:
    """(doc_id, at, match): places at a stride, and the nearest earlier one of the same text behind the same `context` characters."""
    at = F.explode(F.sequence(F.lit(context + 1), F.length("text"), F.lit(stride)))
    places = docs.filter(F.length("text") > context).select("doc_id", "text", at.alias("at"))
    places = places.select("doc_id", F.col("at").cast("long").alias("at"), F.substring(F.col("text"), F.col("at") - context, F.lit(context)).alias("context"))
    return places.withColumn("match", F.lag("at").over(Window.partitionBy("doc_id", "context").orderBy("at")))


def check_byte(column: str) -> Column:
    """One byte for a stage's output: both of its sums together."""
    f = fletcher(column)
    return ((f["a"] + f["b"]) % 255).cast("long")
