"""Corpus pipeline: from raw documents to packed token sequences, five stages, each on all that the one before kept.

toxicity      documents that the network scores at 0.5 or more go;
exact_dedup   of equal texts the row with the largest doc_id stays;
near_dedup    one document of each near-duplicate class stays, that with the smallest doc_id;
pii           personal data in the texts is replaced by its kind in brackets, and n_chars follows;
packing       the texts' token pieces and their places in sequences of at most 4096 tokens.

All stages but the last return the columns of documents. Each result is written and read again before the next stage. SQL cannot
express the stages (a trained network, sketches, tokens), so ORACLE_SQL is None; tests compare them with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bytestrata.llm import exact_dedup, near_dup, packing, pii, toxicity
from bytestrata.llm.bpe import VOCABULARY
from bytestrata.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
