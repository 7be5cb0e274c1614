"""Exact deduplication that no group of copies can slow down, in DataFrame operations only.

1. Within each task equal texts become one row, before anything moves (the partial step of a hash aggregation).
2. Those rows meet under (digest, salt): the salt comes from the row, so one text's rows spread over `salts` tasks.
3. The salt winners, at most `salts` rows for a text, meet under the digest.

Each stage groups by the digest and the whole text, so two texts are never taken for one because of their digest. Every row then
finds its group by digest; only digests that stand for more than one text (none, for SHA-256) are joined on whole texts.

Defined cases: null texts and empty texts are one group, texts are compared unchanged; of equal texts the row with the largest
doc_id stays, whatever other texts have that doc_id; rows equal in doc_id and text are one document: each counts in group_size, they are
flagged alike, and deduplicate() leaves one of them; a null doc_id loses to any other, and a group of null ids has keep_id null and its
rows flagged as kept; texts may be of any length; an empty table gives an empty result; other columns stay unread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.llm.common import cut, one_of_each, table

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def classes(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """(digest, text, keep_id, group_size), a row for each distinct text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(digest(text).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"), text.alias("text"), "doc_id")
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept), a row for each row of docs."""
    found = classes(docs, digest, salts)
    small = cut(found.select("digest", "keep_id", "group_size"))
    text = F.coalesce("text", F.lit(""))
    columns = ["doc_id", "digest", "keep_id", "group_size"]
    shared = small.groupBy("digest").count().filter("count > 1").select("digest")
    ids = docs.select("doc_id", digest(text).alias("digest"))
    if shared.isEmpty():
        groups = ids.join(small, "digest").select(columns)
    else:
        shared = cut(shared)
        alone = ids.join(small.join(shared, "digest", "left_anti"), "digest").select(columns)
        whole = docs.select("doc_id", text.alias("text"), digest(text).alias("digest")).join(shared, "digest", "left_semi")
        groups = alone.unionByName(whole.join(found.join(shared, "digest", "left_semi"), ["digest", "text"]).select(columns))
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, exactly one of each text, with all their columns."""
    kept = cut(exact_groups(docs).filter("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("rows")))
    return one_of_each(docs, kept, sha256(F.coalesce("text", F.lit(""))))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
