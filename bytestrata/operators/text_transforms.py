"""Text transforms that Spark expressions can state, each with its inverse or what it takes to undo it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytestrata.operators.profile import byte_histogram


def collapse_crlf(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def expand_crlf(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\r\n"))


def uniform_crlf(text: Column) -> Column:
    """Whether every line feed follows a carriage return and every carriage return precedes one: then collapsing can be undone."""
    return ~F.replace(text, F.lit("\r\n"), F.lit("")).rlike("[\r\n]")


def flatten_lines(text: Column) -> tuple[Column, Column]:
    """The text with line feeds as spaces, and the positions (from 1) of those among all spaces of the result."""
    flat = F.translate(text, "\n", " ")
    gaps = F.regexp_extract_all(text, F.lit("([ \n])"), F.lit(1))
    return flat, F.filter(F.transform(gaps, lambda x, k: F.when(x == "\n", k + 1).otherwise(0)), lambda k: k > 0)


def mask_numbers(text: Column) -> tuple[Column, Column]:
    """Digits as 0, and the digit runs in order."""
    return F.regexp_replace(text, "[0-9]", "0"), F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1))


def unmask_numbers(masked: Column, values: Column) -> Column:
    """mask_numbers undone: runs of zeros take the values in their order."""
    parts = F.split(masked, "0+")
    n = F.size(values)
    return F.array_join(F.transform(parts, lambda x, k: F.concat(x, F.when(k < n, F.get(values, k)).otherwise(""))), "")


ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def letters_by_frequency(payloads: DataFrame, column: str = "payload") -> str:
    """The small letters from the most frequent to the least, ties by letter; 26 counts at most come to the driver."""
    found = {r["byte"]: r["n"] for r in byte_histogram(payloads, column).filter(F.col("byte").between(97, 122)).collect()}
    return "".join(sorted(ALPHABET, key=lambda c: (-found.get(ord(c), 0), c)))


def reorder(text: Column, order: str) -> Column:
    """Letters by their rank in `order`, the first as a; restore() undoes it."""
    return F.translate(text, order, ALPHABET)


def restore(text: Column, order: str) -> Column:
    return F.translate(text, ALPHABET, order)


def tag_statistics(pages: DataFrame) -> DataFrame:
    """(tag, opened, closed) over all pages."""
    tags = pages.select(F.explode(F.regexp_extract_all("html", F.lit("<(/?[A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("t"))
    name = F.lower(F.regexp_replace("t", "^/", ""))
    return tags.groupBy(name.alias("tag")).agg(F.count_if(~F.startswith("t", F.lit("/"))).alias("opened"), F.count_if(F.startswith("t", F.lit("/"))).alias("closed"))


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, word): maximal runs of letters."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-zÀ-ɏ]+)"), F.lit(1))).alias("word"))


def vocabulary(found: DataFrame, size: int) -> DataFrame:
    """(word, code): the `size` most frequent words in lower case, ties by word; the size is the dictionary's capacity."""
    counts = found.groupBy(F.lower("word").alias("word")).count().orderBy(F.desc("count"), "word").limit(size)
    return counts.select("word", (F.row_number().over(Window.orderBy(F.desc("count"), "word")) - 1).cast("long").alias("code"))


def dictionary_encode(docs: DataFrame, size: int = 500) -> DataFrame:
    """(doc_id, words, coded, bytes): words found in the dictionary take one byte for the first 128 codes and two for the others, words
    that are not in it their own length and one byte."""
    found = words(docs)
    coded = found.withColumn("low", F.lower("word")).join(F.broadcast(vocabulary(found, size).withColumnRenamed("word", "low")), "low", "left")
    cost = F.when(F.col("code") < 128, 1).when(F.col("code").isNotNull(), 2).otherwise(F.octet_length("word") + 1)
    return coded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.count("code").alias("coded"), F.sum(cost).cast("long").alias("bytes"))


def long_range_duplicates(docs: DataFrame, stride: int = 256) -> DataFrame:
    """(hash, places, docs, first_doc): pieces of `stride` characters at multiples of it that occur more than once."""
    at = F.explode(F.sequence(F.lit(1), F.length("text") - (stride - 1), F.lit(stride)))
    pieces = docs.filter(F.length("text") >= stride).select("doc_id", "text", at.alias("at")).select("doc_id", F.md5(F.substring(F.col("text"), F.col("at"), F.lit(stride))).alias("hash"))
    return pieces.groupBy("hash").agg(F.count(F.lit(1)).alias("places"), F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc")).filter("places > 1")
