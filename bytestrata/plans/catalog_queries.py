"""Catalog queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.functions import formatting as fmt
from bytestrata.operators import verify
from bytestrata.sources import sinks
from bytestrata.sources.catalog import document_entries, listing, merge_duplicates, table, without

INCLUDE, EXCLUDE = ["src1*/*", "src[2-4]/e?/*"], ["*7.txt", "*/de/*"]
PATH_SQL = "source || '/' || lang || '/' || doc_id || '.txt'"
SIZE_SQL = """CASE
  WHEN size > 9895604649984 THEN printf('%6d %-2s', (size + 549755813888) // 1099511627776, 'TB')
  WHEN size > 9663676416 THEN printf('%6d %-2s', (size + 536870912) // 1073741824, 'GB')
  WHEN size > 9 * 1048576 THEN printf('%6d %-2s', (size + 524288) // 1048576, 'MB')
  WHEN size > 9 * 1024 THEN printf('%6d %-2s', (size + 512) // 1024, 'KB')
  ELSE printf('%6d %-2s', size, 'B') END"""


def catalog_listing(spark: SparkSession, d: str) -> DataFrame:
    return listing(document_entries(table(spark, d, "documents")), INCLUDE, EXCLUDE)


def catalog_verbose(spark: SparkSession, d: str) -> DataFrame:
    entries = document_entries(table(spark, d, "documents"))
    return entries.select("path", fmt.grouped(F.col("size")).alias("exact_size"), fmt.base_name(F.col("path")).alias("base"))


def catalog_names(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.element_at(F.array(F.lit("C:/"), F.lit("./"), F.lit("../../"), F.lit("/"), F.lit("a/../../")), (F.col("page_id") % 5 + 1).cast("int")), F.col("url"))
    raw = table(spark, d, "pages").select("page_id", url.alias("raw"))
    return raw.select("page_id", fmt.stored_name(F.col("raw")).alias("stored"), fmt.archive_name(F.col("raw")).alias("archive"), fmt.escapes_target(F.col("raw")).alias("escapes"))


def exclude_antijoin(spark: SparkSession, d: str) -> DataFrame:
    entries = document_entries(table(spark, d, "documents"))
    excluded = document_entries(table(spark, d, "documents").join(table(spark, d, "labels").filter("quality = 0"), "doc_id", "left_semi"))
    return without(entries.filter("size IS NOT NULL"), excluded).select("path", "size")


def dup_input_merge(spark: SparkSession, d: str) -> DataFrame:
    entries = document_entries(table(spark, d, "documents")).select("path", "size")
    return merge_duplicates(entries.unionAll(entries.filter(fmt.matches(F.col("path"), ["*/en/*"]))))


def window_size_bytefloat(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(256).select(F.col("id").alias("p"), fmt.byte_float(F.col("id")).alias("bytes"))


def size_literals(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    unit = F.element_at(F.array(*map(F.lit, ("k", "m", "g", "", "x"))), (n % 5 + 1).cast("int"))
    text = F.concat((n % 97).cast("string"), F.when(n % 3 == 0, ".5").otherwise(""), unit)
    return table(spark, d, "orders").select("o_orderkey", text.alias("literal"), fmt.parse_size(text).alias("bytes"))


def display_formats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("event_id") * 7919).alias("ms"))
    return e.select("event_id", fmt.duration(F.col("ms")).alias("took"), fmt.progress(F.col("ms"), F.col("ms") * 3).alias("percent"), fmt.ipv4(F.col("ms") % 4294967296).alias("address"), fmt.octal_mode(F.col("event_id") % 512).alias("mode"), fmt.attribute_letters(F.col("event_id") % 16).alias("attributes"))


def catalog_rollup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.rollup("source", "lang").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.grouping_id().cast("long").alias("level"))


def catalog_topk(spark: SparkSession, d: str) -> DataFrame:
    """The feature is a limit: the 25 largest entries."""
    return document_entries(table(spark, d, "documents")).select("path", "size").orderBy(F.desc("size"), "path").limit(25)


def distinct_constructs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("tag")).select(F.lower("tag").alias("construct")).distinct()


def simulate_write(spark: SparkSession, d: str) -> DataFrame:
    return sinks.simulate(document_entries(table(spark, d, "documents")).select("size"))


def verify_then_filter(spark: SparkSession, d: str) -> DataFrame:
    """All entries are verified, damaged ones too; the filter decides only what is listed."""
    docs = table(spark, d, "documents")
    entries = document_entries(docs).withColumn("checksum", F.when(F.col("doc_id") % 11 == 0, F.crc32("payload") + 1).when(F.col("doc_id") % 7 != 0, F.crc32("payload")))
    report = sinks.verification(entries)
    wanted = F.col("path").rlike(fmt.glob_regex("*/en/*"))
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("checked"), F.count_if(wanted).alias("listed"))


def safe_extract(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    entries = document_entries(docs).withColumn("checksum", F.when(F.col("doc_id") % 11 == 0, F.crc32("payload") + 1).otherwise(F.crc32("payload")))
    entries = entries.withColumn("path", F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("../"), F.col("path"))).otherwise(F.col("path")))
    return sinks.extractable(entries, safe=True).select("path", "size")


def tree_compare(spark: SparkSession, d: str) -> DataFrame:
    """What was written against the tree it came from, by path."""
    entries = document_entries(table(spark, d, "documents")).select("doc_id", "path", "size", F.md5("payload").alias("hash"))
    read = entries.filter("doc_id % 17 != 0").withColumn("size", F.when(F.col("doc_id") % 19 == 0, F.col("size") - 1).otherwise(F.col("size")))
    return verify.compare_sides(entries, read, ["path"], ["size", "hash"])


def sweep_report(spark: SparkSession, d: str) -> DataFrame:
    """Results against a manifest: passes and failures for each group of each dimension."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    results = labels.select("doc_id", F.when(F.col("quality") == 1, "PASS").when(F.col("toxic") == 1, "SKIP").otherwise("FAIL").alias("status"))
    band = F.when(F.col("n_chars") < 1000, "small").when(F.col("n_chars") < 10000, "medium").otherwise("large")
    manifest = docs.select("doc_id", "lang", band.alias("band"))
    joined = results.join(manifest, "doc_id", "left")
    return joined.cube("lang", "band").agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "FAIL", "SKIP")))


QUERIES = {f.__name__: f for f in (catalog_listing, catalog_verbose, catalog_names, exclude_antijoin, dup_input_merge, window_size_bytefloat, size_literals, display_formats, catalog_rollup, catalog_topk, distinct_constructs, simulate_write, verify_then_filter, safe_extract, tree_compare, sweep_report)}

SQL = {
    "catalog_listing": f"""
WITH e AS (SELECT {PATH_SQL} AS path, octet_length(encode(text)) AS size FROM documents)
SELECT path, CASE WHEN length(path) > 40 THEN '...' || right(path, 37) ELSE path END AS name,
  lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext, size, {SIZE_SQL} AS size_text
FROM e WHERE (path GLOB 'src1*/*' OR path GLOB 'src[2-4]/e?/*') AND NOT (path GLOB '*7.txt' OR path GLOB '*/de/*')""",
    "catalog_verbose": f"""
SELECT {PATH_SQL} AS path, replace(format('{{:,}}', octet_length(encode(text))), ',', ' ') AS exact_size, doc_id || '.txt' AS base FROM documents""",
    "catalog_names": """
WITH r AS (SELECT page_id, ['C:/', './', '../../', '/', 'a/../../'][page_id % 5 + 1] || url AS raw FROM pages)
SELECT page_id, regexp_replace(raw, '^([A-Za-z]:)?(/|\\./|\\.\\./)*', '') AS stored,
  CASE WHEN raw LIKE '%.arc' OR raw LIKE '%.exe' THEN raw ELSE raw || '.arc' END AS archive, page_id % 5 <> 1 AS escapes FROM r""",
    "exclude_antijoin": f"""
SELECT {PATH_SQL} AS path, octet_length(encode(text)) AS size FROM documents d
WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0)""",
    "dup_input_merge": f"""
WITH e AS (SELECT {PATH_SQL} AS path, octet_length(encode(text)) AS size FROM documents)
SELECT path, sum(size)::BIGINT AS size, count(*) AS inputs FROM (SELECT * FROM e UNION ALL SELECT * FROM e WHERE path GLOB '*/en/*') GROUP BY path""",
    "window_size_bytefloat": """
SELECT p, (CASE WHEN ((p + 1) >> 4) > 0 THEN (((p + 1) & 15) + 16) << (((p + 1) >> 4) - 1) ELSE (p + 1) & 15 END)::BIGINT * 65536 AS bytes FROM range(256) t(p)""",
    "size_literals": """
WITH l AS (SELECT o_orderkey, o_orderkey % 97 AS n, o_orderkey % 3 = 0 AS half, ['k', 'm', 'g', '', 'x'][o_orderkey % 5 + 1] AS unit FROM orders)
SELECT o_orderkey, n || CASE WHEN half THEN '.5' ELSE '' END || unit AS literal,
  CASE unit WHEN 'k' THEN 1024 WHEN 'm' THEN 1048576 WHEN 'g' THEN 1073741824 WHEN '' THEN 1 END * (2 * n + half::INT) // 2 AS bytes FROM l""",
    "display_formats": """
WITH e AS (SELECT event_id, event_id * 7919 AS ms FROM events), f AS (SELECT *, ms % 4294967296 AS a, event_id % 512 AS m, event_id % 16 AS w FROM e)
SELECT event_id,
  CASE WHEN ms >= 3600000 THEN (ms // 3600000) || 'h ' ELSE '' END || CASE WHEN (ms // 60000) % 60 > 0 THEN ((ms // 60000) % 60) || 'm ' ELSE '' END
    || printf('%d.%02ds', (ms // 1000) % 60, (ms // 10) % 100) AS took,
  (((ms >> 10) | 1) * 100) // ((ms * 3 >> 10) | 1) AS percent,
  ((a >> 24) & 255) || '.' || ((a >> 16) & 255) || '.' || ((a >> 8) & 255) || '.' || (a & 255) AS address,
  '0' || (m // 64) || ((m // 8) % 8) || (m % 8) AS mode,
  CASE WHEN w & 8 <> 0 THEN 'A' ELSE '-' END || CASE WHEN w & 1 <> 0 THEN 'R' ELSE '-' END || CASE WHEN w & 2 <> 0 THEN 'H' ELSE '-' END || CASE WHEN w & 4 <> 0 THEN 'S' ELSE '-' END AS attributes
FROM f""",
    "catalog_rollup": """
SELECT source, lang, count(*) AS entries, sum(octet_length(encode(text)))::BIGINT AS bytes, grouping(source, lang)::BIGINT AS level FROM documents GROUP BY ROLLUP (source, lang)""",
    "catalog_topk": f"SELECT {PATH_SQL} AS path, octet_length(encode(text)) AS size FROM documents ORDER BY size DESC, path LIMIT 25",
    "distinct_constructs": "SELECT DISTINCT lower(unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1))) AS construct FROM pages",
    "simulate_write": "SELECT count(*) AS entries, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents",
    "verify_then_filter": """
SELECT CASE WHEN doc_id % 11 = 0 THEN 'damaged' WHEN doc_id % 7 <> 0 THEN 'ok' ELSE 'unchecked' END AS status, count(*) AS checked, count(*) FILTER (lang = 'en') AS listed FROM documents GROUP BY 1""",
    "safe_extract": f"SELECT {PATH_SQL} AS path, octet_length(encode(text)) AS size FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0",
    "tree_compare": f"""
SELECT {PATH_SQL} AS path, CASE WHEN doc_id % 17 = 0 THEN 'unread' ELSE 'differs' END AS status FROM documents WHERE doc_id % 17 = 0 OR doc_id % 19 = 0""",
    "sweep_report": """
WITH r AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'PASS' WHEN toxic = 1 THEN 'SKIP' ELSE 'FAIL' END AS status FROM labels),
m AS (SELECT doc_id, lang, CASE WHEN n_chars < 1000 THEN 'small' WHEN n_chars < 10000 THEN 'medium' ELSE 'large' END AS band FROM documents)
SELECT lang, band, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'SKIP') AS skip
FROM r LEFT JOIN m USING (doc_id) GROUP BY CUBE (lang, band)""",
}
