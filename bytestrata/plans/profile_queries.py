"""Integrity and profile queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.functions import checksums
from bytestrata.functions import profile as p
from bytestrata.operators import profile, verify
from bytestrata.operators.profile import log_table
from bytestrata.session import spread
from bytestrata.sources.catalog import table


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select("doc_id", F.encode("text", "UTF-8").alias("payload"))


def checksum_fletcher(spark: SparkSession, d: str) -> DataFrame:
    return _payloads(spark, d).select("doc_id", checksums.fletcher("payload").alias("f")).select("doc_id", F.col("f.a").alias("sum1"), F.col("f.b").alias("sum2"))


def checksum_crc32(spark: SparkSession, d: str) -> DataFrame:
    return _payloads(spark, d).select("doc_id", checksums.crc32(F.col("payload")).alias("crc32"))


def checksum_crc16(spark: SparkSession, d: str) -> DataFrame:
    return _payloads(spark, d).select("doc_id", checksums.crc16("payload").alias("crc16"))


def checksum_crc64(spark: SparkSession, d: str) -> DataFrame:
    return _payloads(spark, d).select("doc_id", checksums.crc64("payload").alias("crc64"))


def crc64_pieces_merge(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of 1000 bytes, each with its own CRC-64, merge to the whole text's: doc_id and whether they agree."""
    docs = _payloads(spark, d)
    at = F.explode(F.sequence(F.lit(0), F.octet_length("payload"), F.lit(1000)))
    pieces = docs.select(F.col("doc_id").alias("name"), at.alias("off"), "payload").select("name", F.col("off").cast("long").alias("off"), F.expr("substring(payload, off + 1, 1000)").alias("piece"))
    pieces = pieces.filter(F.octet_length("piece") > 0).select("name", "off", F.octet_length("piece").cast("long").alias("len"), checksums.crc64("piece").alias("crc"))
    merged = verify.merge_runs_crc(pieces)
    whole = docs.select(F.col("doc_id").alias("name"), checksums.crc64("payload").alias("whole"))
    return merged.join(whole, "name").select(F.col("name").alias("doc_id"), "len", (F.col("crc") == F.col("whole")).alias("equal"))


def _slices(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as pieces of a file: some are missing, so runs break."""
    return table(spark, d, "lineitem").filter("l_partkey % 5 != 0").select(F.col("l_orderkey").alias("name"), ((F.col("l_linenumber") - 1) * 100).cast("long").alias("off"), F.lit(100).cast("long").alias("len"), F.col("l_partkey").alias("crc"))


def slice_merge_runs(spark: SparkSession, d: str) -> DataFrame:
    return verify.merge_runs(_slices(spark, d))


def selfcheck_join(spark: SparkSession, d: str) -> DataFrame:
    """Written against read runs, with injected faults: lost, renamed, shortened and altered ones."""
    written = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").cast("long").alias("run_no"), (F.col("l_linenumber") * 100).cast("long").alias("off"), F.lit(100).cast("long").alias("len"), F.col("l_partkey").alias("crc"))
    key = F.col("name") * 8 + F.col("run_no")
    read = written.filter(key % 101 != 0).select(
        F.when(key % 103 == 0, -F.col("name")).otherwise(F.col("name")).alias("name"), "run_no", "off",
        F.when(key % 107 == 0, F.lit(50)).otherwise(F.col("len")).cast("long").alias("len"),
        F.when(key % 109 == 0, F.col("crc") + 1).otherwise(F.col("crc")).alias("crc"),
    )
    return verify.compare_sides(written, read, ["name", "run_no"], ["off", "len", "crc"])


def multi_stream_merge(spark: SparkSession, d: str) -> DataFrame:
    pieces = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), (F.col("l_suppkey") % 4).alias("stream"), F.col("l_quantity").cast("long").alias("size"), F.col("l_partkey").alias("checksum"))
    return verify.merge_streams(pieces)


def byte_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.byte_histogram(_payloads(spark, d))


def profile_text_flags(spark: SparkSession, d: str) -> DataFrame:
    """Over the first eighth of each text's characters, which is what the rule asks for; dictionary, line and game routes are left out."""
    docs = table(spark, d, "documents").select("doc_id", F.expr("substring(text, 1, cast(length(text) div 8 as int))").alias("t"))
    t = F.col("t")
    m = docs.select(
        "doc_id", F.length(t).cast("long").alias("n"), p.count_class(t, p.TEXTY).alias("texty"), p.count_class(t, p.WORDY).alias("wordy"), p.count_class(t, "[0-9]").alias("digits"),
        p.count_of(t, "\n").alias("lf"), p.count_of(t, "\r").alias("cr"), p.count_of(t, "<").alias("lt"), p.count_of(t, ">").alias("gt"), p.count_of(t, "/").alias("slash"), (F.length(t) - F.locate("\n", F.reverse(t)) + 1).cast("long").alias("upto"),
    )
    m = m.select("*", p.share(F.col("texty"), F.col("n")).alias("s9d"), p.share(F.col("wordy"), F.col("n")).alias("s19"), F.floor(F.when(F.col("lf") > 0, F.col("upto")).otherwise(0) / (F.col("lf") + 1)).cast("long").alias("mean_line"))
    c = F.col
    flags = {"text": p.is_text(c("s9d"), c("s19")), "crlf": p.crlf_fits(c("n"), c("lf"), c("cr")), "lf": p.insert_lf_fits(c("mean_line")), "number1": c("digits") > 19, "number2": F.shiftright(c("n"), 8) < c("lf") + c("cr"), "html": p.html_fits(c("gt"), c("lt"), c("slash")), "enough_digits": p.enough_digits(c("n"), c("digits"))}
    return m.select("doc_id", "s9d", "s19", "mean_line", p.mostly_digits(c("n"), c("digits")).alias("mostly_digits"), p.text_flags(flags).cast("long").alias("flags"))


def html_fits(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    counts = table(spark, d, "pages").select("page_id", p.count_of(h, ">").alias("gt"), p.count_of(h, "<").alias("lt"), p.count_of(h, "/").alias("slash"))
    return counts.select("*", p.html_fits(F.col("gt"), F.col("lt"), F.col("slash")).alias("fits"))


def digit_dot_fits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"), p.dotted_numbers(F.col("text")).alias("hits"))
    return docs.select("doc_id", "hits", (F.shiftright("n", 8) < F.col("hits")).alias("fits"))


def order1_entropy_fixed(spark: SparkSession, d: str) -> DataFrame:
    return profile.order1_entropy(spread(table(spark, d, "documents")))


def ngram_rarity(spark: SparkSession, d: str) -> DataFrame:
    return profile.ngram_rarity(spread(table(spark, d, "documents")))


def noise_score(spark: SparkSession, d: str) -> DataFrame:
    return profile.noise(spread(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (checksum_fletcher, checksum_crc32, checksum_crc16, checksum_crc64, crc64_pieces_merge, slice_merge_runs, selfcheck_join, multi_stream_merge, byte_histogram, profile_text_flags, html_fits, digit_dot_fits, order1_entropy_fixed, ngram_rarity, noise_score)}

_BYTES = "SELECT doc_id, b, i FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT)) AS b, generate_subscripts(regexp_extract_all(hex(encode(text)), '..'), 1) AS i FROM documents)"


def _entropy_sql() -> str:
    logs = ", ".join(map(str, log_table().tolist()))
    return f"""
WITH b AS ({_BYTES}), c AS (SELECT doc_id, b, (32 * coalesce(lag(b, 2) OVER w, 0) + coalesce(lag(b) OVER w, 0)) & 255 AS ctx FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
cell AS (SELECT doc_id, ctx, b, count(*) AS n FROM c GROUP BY ALL), total AS (SELECT doc_id, ctx, sum(n)::BIGINT AS n FROM cell GROUP BY ALL),
log AS (SELECT unnest([{logs}]) AS cost, unnest(range({len(log_table())})) AS v),
every AS (SELECT doc_id, n, 1 AS sign FROM total UNION ALL SELECT doc_id, n, -1 FROM cell),
halved AS (SELECT *, greatest(0, length(bin(n)) - 15) AS k FROM every),
s AS (SELECT doc_id, sum(sign * n * (cost + k * 4096))::BIGINT AS cost FROM halved JOIN log ON v = n >> k GROUP BY doc_id)
SELECT doc_id, coalesce(cost, 0) AS cost FROM documents LEFT JOIN s USING (doc_id)"""


_LIST = "SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents"


def crc_sql(polynomial: int, initial: int, final: int, kind: str) -> str:
    """CRC of b, a list of bytes, by a table made from the polynomial's rule."""
    rows = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (polynomial if k & 1 else 0)
        rows.append(k)
    entries = ", ".join(map(str, rows))
    return f"xor(list_reduce(list_transform(b, lambda x: x::{kind}), lambda acc, x: xor(acc >> 8, ([{entries}]::{kind}[])[((xor(acc, x) & 255) + 1)::BIGINT]), {initial}::{kind}), {final}::{kind})"


_ALL = (1 << 64) - 1

SQL = {
    "checksum_crc32": f"SELECT doc_id, {crc_sql(0xEDB88320, 0xFFFFFFFF, 0xFFFFFFFF, 'BIGINT')} AS crc32 FROM ({_LIST})",
    "checksum_crc16": f"SELECT doc_id, {crc_sql(checksums.CRC16_POLYNOMIAL, 0, 0, 'BIGINT')}::INT AS crc16 FROM ({_LIST})",
    "checksum_crc64": f"""
WITH c AS (SELECT doc_id, {crc_sql(checksums.CRC64_POLYNOMIAL, _ALL, _ALL, 'UBIGINT')}::HUGEINT AS c FROM ({_LIST}))
SELECT doc_id, (CASE WHEN c >= 9223372036854775808 THEN c - 18446744073709551616 ELSE c END)::BIGINT AS crc64 FROM c""",
    "noise_score": f"""
WITH d AS (SELECT doc_id, b, len(b) AS n FROM ({_LIST})),
w AS (SELECT doc_id, n, flatten(list_transform(range(8), lambda k: b[k * (n >> 3) + 1 : k * (n >> 3) + 512])) AS x FROM d),
h AS (SELECT doc_id, n, len(list_distinct(list_transform(x, lambda c, i: xor(CASE WHEN i > 1 THEN x[i - 1] ELSE 0 END << 8, c) & 32767))) AS h FROM w)
SELECT doc_id, CASE WHEN n < 8 THEN n WHEN n < 4096 THEN 0 ELSE h * 256 >> 12 END AS score FROM h""",
    "checksum_fletcher": f"""
WITH b AS ({_BYTES}), n AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents),
s AS (SELECT doc_id, (sum(b) % 255)::BIGINT AS sum1, (sum((n - i + 1) * b) % 255)::BIGINT AS sum2 FROM b JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(sum1, 0) AS sum1, coalesce(sum2, 0) AS sum2 FROM documents LEFT JOIN s USING (doc_id)""",
    "crc64_pieces_merge": "SELECT doc_id, octet_length(encode(text)) AS len, true AS equal FROM documents WHERE text <> ''",
    "slice_merge_runs": """
WITH s AS (SELECT l_orderkey AS name, (l_linenumber - 1) * 100 AS off, 100 AS len FROM lineitem WHERE l_partkey % 5 <> 0),
m AS (SELECT *, CASE WHEN off = lag(off + len) OVER w THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY name ORDER BY off, len)),
r AS (SELECT *, sum(new) OVER (PARTITION BY name ORDER BY off, len ROWS UNBOUNDED PRECEDING)::BIGINT AS run_no FROM m)
SELECT name, run_no, min(off)::BIGINT AS off, sum(len)::BIGINT AS len, count(*) AS pieces FROM r GROUP BY name, run_no""",
    "selfcheck_join": """
WITH w AS (SELECT l_orderkey AS name, l_linenumber::BIGINT AS run_no, l_linenumber * 100 AS off, 100 AS len, l_partkey AS crc, l_orderkey * 8 + l_linenumber AS k FROM lineitem),
r AS (SELECT CASE WHEN k % 103 = 0 THEN -name ELSE name END AS name, run_no, off, CASE WHEN k % 107 = 0 THEN 50 ELSE len END AS len, CASE WHEN k % 109 = 0 THEN crc + 1 ELSE crc END AS crc FROM w WHERE k % 101 <> 0)
SELECT coalesce(w.name, r.name) AS name, coalesce(w.run_no, r.run_no) AS run_no, CASE WHEN r.name IS NULL THEN 'unread' WHEN w.name IS NULL THEN 'unwritten' ELSE 'differs' END AS status
FROM w FULL OUTER JOIN r ON w.name = r.name AND w.run_no = r.run_no WHERE (w.off, w.len, w.crc) IS DISTINCT FROM (r.off, r.len, r.crc)""",
    "multi_stream_merge": """
SELECT l_orderkey AS name, sum(l_quantity::BIGINT)::BIGINT AS size, CASE WHEN count(DISTINCT l_suppkey % 4) = 1 THEN max(l_partkey) END AS checksum, count(DISTINCT l_suppkey % 4) AS streams FROM lineitem GROUP BY 1""",
    "byte_histogram": f"SELECT b AS byte, count(*) AS n FROM ({_BYTES}) GROUP BY b",
    "profile_text_flags": f"""
WITH d AS (SELECT doc_id, substring(text, 1, length(text) // 8) AS t FROM documents),
m AS (SELECT doc_id, length(t) AS n, length(t) - length(regexp_replace(t, '{p.TEXTY.replace("'", "''")}', '', 'g')) AS texty, length(t) - length(regexp_replace(t, '{p.WORDY}', '', 'g')) AS wordy,
  length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digits, length(t) - length(replace(t, chr(10), '')) AS lf, length(t) - length(replace(t, chr(13), '')) AS cr,
  length(t) - length(replace(t, '<', '')) AS lt, length(t) - length(replace(t, '>', '')) AS gt, length(t) - length(replace(t, '/', '')) AS slash, length(t) - instr(reverse(t), chr(10)) + 1 AS upto FROM d),
s AS (SELECT *, (texty + 1) * 100 // (n + 1) AS s9d, (wordy + 1) * 100 // (n + 1) AS s19, CASE WHEN lf > 0 THEN upto ELSE 0 END // (lf + 1) AS mean_line FROM m),
f AS (SELECT *, CASE WHEN (n >> 7) <= lf AND lf <= (n >> 3) AND cr - (cr >> 6) <= lf AND lf <= (cr >> 6) + cr THEN 1 ELSE 0 END + CASE WHEN mean_line BETWEEN 30 AND 80 THEN 2 ELSE 0 END AS first,
  CASE WHEN digits > 19 AND (n >> 8) < lf + cr THEN 16 ELSE 0 END + CASE WHEN gt // 3 <= slash AND lt - (lt >> 4) <= gt THEN 4 ELSE 0 END AS later FROM s)
SELECT doc_id, s9d, s19, mean_line, (n >> 1) + 1024 <= digits AS mostly_digits,
  (CASE WHEN s9d >= 88 OR (s9d > 79 AND s19 > 79) THEN first + CASE WHEN first > 0 OR (n >> 5) <= digits THEN later ELSE 0 END ELSE 0 END)::BIGINT AS flags FROM f""",
    "html_fits": """
WITH c AS (SELECT page_id, length(html) - length(replace(html, '>', '')) AS gt, length(html) - length(replace(html, '<', '')) AS lt, length(html) - length(replace(html, '/', '')) AS slash FROM pages)
SELECT *, gt // 3 <= slash AND lt - (lt >> 4) <= gt AS fits FROM c""",
    "digit_dot_fits": """
WITH h AS (SELECT doc_id, length(text) AS n, len(list_filter(regexp_extract_all(text, '([0-9]+)\\.', 1), lambda x: length(ltrim(x, '0')) BETWEEN 1 AND 3 AND try_cast(x AS HUGEINT) <= 255)) AS hits FROM documents)
SELECT doc_id, hits, (n >> 8) < hits AS fits FROM h""",
    "order1_entropy_fixed": _entropy_sql(),
    "ngram_rarity": """
WITH g AS (SELECT text, unnest(range(1, length(text) - 2)) AS i FROM documents WHERE length(text) >= 4), c AS (SELECT count(*) AS n FROM g GROUP BY substring(text, i, 4))
SELECT count(*) AS grams, count(*) FILTER (n = 1) AS once, max(n) AS most FROM c""",
}
