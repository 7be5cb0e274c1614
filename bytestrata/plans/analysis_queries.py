"""Text analysis, cost-based choice, catalog columns and joins on ranges, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytestrata.functions import profile as p
from bytestrata.operators import analysis, codecs, profile, verify
from bytestrata.operators import text_transforms as tt
from bytestrata.operators import windows as w
from bytestrata.plans.profile_queries import crc_sql
from bytestrata.session import spread
from bytestrata.sources import sinks
from bytestrata.sources.catalog import METADATA, document_entries, listing_columns, table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def simple_text_score(spark: SparkSession, d: str) -> DataFrame:
    """Over the first eighth of each text's characters, as the rule asks."""
    docs = table(spark, d, "documents").select("doc_id", F.expr("substring(text, 1, cast(length(text) div 8 as int))").alias("t"))
    n, texty = F.length("t").cast("long"), p.count_class(F.col("t"), p.TEXTY)
    return docs.select("doc_id", n.alias("n"), analysis.simple_score(n, texty).alias("score"), analysis.crlf_text(F.col("t"), n, texty).alias("crlf_text"))


def line_rle_fits(spark: SparkSession, d: str) -> DataFrame:
    return analysis.line_statistics(_documents(spark, d))


def _runs_payload() -> Column:
    """Texts, and for every third document a stretch of equal characters, which the detector is for."""
    text = F.coalesce("text", F.lit(""))
    return F.encode(F.when(F.col("doc_id") % 3 == 0, F.concat(text, F.repeat(F.lit("="), 4000))).otherwise(text), "UTF-8")


def block_rle_score(spark: SparkSession, d: str) -> DataFrame:
    return analysis.block_rle(_documents(spark, d).select("doc_id", _runs_payload().alias("payload")))


def trial_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether lower-casing pays, by the order-1 cost of a sample before and after."""
    return analysis.trial_gate(_documents(spark, d), F.lower)


def simulate_coded(spark: SparkSession, d: str) -> DataFrame:
    """What a write with run lengths would store, blocks that do not shrink as they are; nothing is written."""
    payloads = _documents(spark, d).select("doc_id", _runs_payload().alias("payload"))
    return sinks.simulate_coded(payloads, codecs.CODECS["rle"])


def rle_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Length of each text's run-length form."""
    payloads = _documents(spark, d).select("doc_id", _runs_payload().alias("payload"))
    return codecs.coded(payloads, codecs.CODECS["rle"], fallback=False).select("doc_id", "raw_length", F.octet_length("block").cast("long").alias("coded_length"))


def ascii_reorder(spark: SparkSession, d: str) -> DataFrame:
    """Letters renamed by their rank among all texts, and whether that is undone."""
    docs = _documents(spark, d)
    order = tt.letters_by_frequency(docs.select(F.encode("text", "UTF-8").alias("payload")))
    coded = docs.select("doc_id", "text", tt.reorder(F.col("text"), order).alias("coded"))
    return coded.select("doc_id", F.md5("coded").alias("coded"), (tt.restore(F.col("coded"), order) == F.col("text")).alias("undone"))


def embedded_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that were put into text as base64, taken out again, with their digests."""
    held = _documents(spark, d).select("doc_id", F.concat(F.lit("data:"), F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("held"))
    found = held.select("doc_id", F.unbase64(F.regexp_replace("held", "^data:", "")).alias("payload"))
    return found.select("doc_id", F.octet_length("payload").cast("long").alias("bytes"), F.md5("payload").alias("digest"))


def _typed_entries(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    return document_entries(docs).withColumns({
        "mtime": F.timestamp_seconds(i * 86400), "mode": (i % 512).cast("int"), "uid": (i % 7).cast("int"), "gid": (i % 3).cast("int"), "checksum": F.crc32("payload"),
    }).drop("payload")


def listing_by_presence(spark: SparkSession, d: str) -> DataFrame:
    """Times and modes are left out; owners and checksums are there, so they are shown."""
    return listing_columns(_typed_entries(spark, d), hidden=["mtime", "mode"])


def listing_all_columns(spark: SparkSession, d: str) -> DataFrame:
    return listing_columns(_typed_entries(spark, d))


def listing_bare(spark: SparkSession, d: str) -> DataFrame:
    """Paths and sizes alone: every metadata column is hidden, folders are stripped."""
    return listing_columns(_typed_entries(spark, d), hidden=METADATA, strip_paths=True)


def overwrite_policy(spark: SparkSession, d: str) -> DataFrame:
    """What an extraction does with each path under the three policies, given what is there already."""
    entries = document_entries(table(spark, d, "documents")).select("path", "size")
    present = entries.filter(F.pmod(F.crc32(F.encode("path", "UTF-8")), F.lit(3)) == 0).select("path")
    actions = [sinks.planned(entries, present, policy).select("path", "action").withColumn("policy", F.lit(policy)) for policy in ("no", "yes", "ask")]
    return actions[0].unionByName(actions[1]).unionByName(actions[2]).groupBy("policy", "action").agg(F.count(F.lit(1)).alias("n"))


def sweep_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Failures by reason, with the least example of each."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    failed = labels.filter("quality = 0").join(docs, "doc_id")
    reason = F.when(F.col("n_chars") < 200, "short").when(F.col("text").rlike("[|{}]"), "markup").otherwise("other")
    return failed.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("example"))


def sweep_pivot(spark: SparkSession, d: str) -> DataFrame:
    """A column for each status."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    status = F.when(F.col("quality") == 1, "pass").when(F.col("toxic") == 1, "skip").otherwise("fail")
    counts = labels.join(docs, "doc_id").withColumn("status", status).groupBy("lang").pivot("status", ["pass", "fail", "skip"]).agg(F.count(F.lit(1)))
    return counts.na.fill(0)


def preceding_match(spark: SparkSession, d: str) -> DataFrame:
    """For places of each text, the nearest earlier one behind the same four characters."""
    return analysis.preceding_matches(_documents(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("probes"), F.count("match").alias("found"), F.sum(F.col("at") - F.col("match")).alias("distance"))


def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer within a week before each of that customer's orders: a range join inside an equi-join, binned by week."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    week = 7 * 86_400_000_000
    return verify.within(o, "o_orderkey", "o_custkey", "us", week).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("earlier"))


def ranked_frames(spark: SparkSession, d: str) -> DataFrame:
    """Rank functions and frames over the lines of an order."""
    win = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber")
    near = win.rowsBetween(-1, 1)
    lines = table(spark, d, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", F.ntile(2).over(win).cast("long").alias("half"), F.rank().over(win).cast("long").alias("rank"), F.max("l_partkey").over(near).alias("near_max"), F.first("l_partkey").over(win).alias("first_part"))


def stage_checks(spark: SparkSession, d: str) -> DataFrame:
    """A check byte for each stage of a chain (the text, its lower case, its digits masked): the two sums of the bytes, combined modulo 255."""
    text = F.coalesce("text", F.lit(""))
    stages = _documents(spark, d).select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("stage"), F.encode(x, "UTF-8").alias("payload")) for k, x in enumerate((text, F.lower(text), F.regexp_replace(text, "[0-9]", "0")))))).alias("s"))
    return stages.select("doc_id", F.col("s.stage").alias("stage"), analysis.check_byte("s.payload").alias("check_byte"))


def context_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Move-to-front rank of an event's type among the types that followed the same type before."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    e = e.withColumn("context", F.coalesce(F.lag("event_type").over(w.ordered(["user_id"], ["ts", "event_id"])), F.lit("")))
    return w.recent_ranks(e, ["user_id", "context"], ["ts", "event_id"], "event_type").select("event_id", "rank")


QUERIES = {f.__name__: f for f in (simple_text_score, line_rle_fits, block_rle_score, trial_gate, simulate_coded, rle_lengths, ascii_reorder, embedded_payloads, listing_by_presence, listing_all_columns, listing_bare, overwrite_policy, sweep_reasons, sweep_pivot, preceding_match, interval_join, ranked_frames, stage_checks, context_ranks)}

_TEXTY = p.TEXTY.replace("'", "''")
_PAYLOAD = "encode(CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || repeat('=', 4000) ELSE coalesce(text, '') END)"
_PATH = "source || '/' || lang || '/' || doc_id || '.txt'"
_BYTES = "list_transform(regexp_extract_all(hex({}), '..'), lambda x: ('0x' || x)::BIGINT)"


_LINES = """
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
m AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM l),
s AS (SELECT *, CASE WHEN before IS NULL THEN 0 ELSE len(list_filter(range(1, 32), lambda n: length(line) >= n AND length(before) >= n AND line[1:n] = before[1:n])) END AS shared FROM m)"""

SQL = {
    "simple_text_score": f"""
WITH d AS (SELECT doc_id, substring(text, 1, length(text) // 8) AS t FROM documents),
m AS (SELECT doc_id, length(t) AS n, length(t) - length(regexp_replace(t, '{_TEXTY}', '', 'g')) + 1 AS texty, length(t) - length(replace(t, chr(10), '')) AS lf, length(t) - length(replace(t, chr(13), '')) AS cr FROM d),
f AS (SELECT *, CASE WHEN n >= 16 AND n // texty < 2 THEN 100 ELSE 0 END::BIGINT AS score FROM m)
SELECT doc_id, n, score, score >= 88 AND (n >> 7) <= lf AND lf <= (n >> 3) AND cr - (cr >> 6) <= lf AND lf <= (cr >> 6) + cr AS crlf_text FROM f""",
    "line_rle_fits": f"""
WITH {_LINES},
g AS (SELECT doc_id, count(*) AS lines, 1 + count(*) FILTER (before IS NOT NULL AND (shared = 0 OR line[1:1] = ' ')) AS fresh, sum(CASE WHEN line[1:1] = ' ' THEN 0 ELSE shared END)::BIGINT AS shared, sum(length(line) + 1)::BIGINT AS chars FROM s GROUP BY doc_id)
SELECT doc_id, lines, fresh, shared, lines // fresh >= 4 AND (1 + shared) // lines > 3 AND chars // lines < 40 AS fits FROM g""",
    "block_rle_score": f"""
WITH h AS (SELECT doc_id, hex({_PAYLOAD}) AS x FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(x, '.{{8}}')) AS word, generate_subscripts(regexp_extract_all(x, '.{{8}}'), 1) AS k FROM h),
c AS (SELECT *, (word[1:2] = word[3:4])::INT + (word[3:4] = word[5:6])::INT + (word[5:6] = word[7:8])::INT AS equal, (word IS DISTINCT FROM lag(word) OVER (PARTITION BY doc_id ORDER BY k))::INT AS new FROM w),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY k) - 1 AS repeats FROM r),
t AS (SELECT doc_id, sum(CASE WHEN repeats = 0 THEN equal ELSE ((repeats + 1) * equal + repeats) & 127 END)::BIGINT AS score FROM p GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS bytes, coalesce(score, 0) AS score, length(x) // 2 >= 40 AND coalesce(score, 0) >= length(x) // 2 AS fits FROM h LEFT JOIN t USING (doc_id)""",
    "trial_gate": """
WITH d AS (SELECT doc_id, substring(coalesce(text, ''), 1, least(length(coalesce(text, '')) // 8, 131072)) AS t FROM documents),
v AS (SELECT doc_id, 0 AS side, encode(t) AS x FROM d UNION ALL SELECT doc_id, 1, encode(lower(t)) FROM d),
b AS (SELECT doc_id, side, unnest(regexp_extract_all(hex(x), '..')) AS b, generate_subscripts(regexp_extract_all(hex(x), '..'), 1) AS i FROM v),
n AS (SELECT doc_id, side, ('0x' || b)::INT AS b, i FROM b),
c AS (SELECT *, (32 * coalesce(lag(b, 2) OVER w, 0) + coalesce(lag(b) OVER w, 0)) & 255 AS ctx FROM n WINDOW w AS (PARTITION BY doc_id, side ORDER BY i)),
cell AS (SELECT doc_id, side, ctx, b, count(*) AS n FROM c GROUP BY ALL), total AS (SELECT doc_id, side, ctx, sum(n)::BIGINT AS n FROM cell GROUP BY ALL),
log AS (SELECT CASE WHEN v > 0 THEN round(4096 * log2(v))::BIGINT ELSE 0 END AS cost, v FROM range(16385) t(v)),
every AS (SELECT doc_id, side, n, 1 AS sign FROM total UNION ALL SELECT doc_id, side, n, -1 FROM cell),
halved AS (SELECT *, greatest(0, length(bin(n)) - 15) AS k FROM every),
s AS (SELECT doc_id, side, sum(sign * n * (cost + k * 4096))::BIGINT AS cost FROM halved JOIN log ON v = n >> k GROUP BY doc_id, side),
p AS (SELECT doc_id, coalesce(sum(cost) FILTER (side = 0), 0)::BIGINT AS baseline, coalesce(sum(cost) FILTER (side = 1), 0)::BIGINT AS candidate FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id)
SELECT *, baseline > candidate + (candidate >> 10) AS applied FROM p""",
    "ranked_frames": """
SELECT l_orderkey, l_linenumber, ntile(2) OVER w AS half, rank() OVER w AS rank, max(l_partkey) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near_max, first_value(l_partkey) OVER w AS first_part
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber)""",
    "listing_by_presence": f"""
SELECT {_PATH} AS path, octet_length(encode(text)) AS size, (doc_id % 7)::INT AS uid, (doc_id % 3)::INT AS gid, printf('%08x', crc) AS checksum FROM (SELECT *, {{crc}} AS crc FROM (SELECT *, {_BYTES.format("encode(text)")} AS b FROM documents))""",
    "listing_all_columns": f"""
SELECT {_PATH} AS path, octet_length(encode(text)) AS size, strftime(make_timestamp(doc_id * 86400000000), '%Y-%m-%d %H:%M:%S') AS mtime, '0' || ((doc_id % 512) // 64) || (((doc_id % 512) // 8) % 8) || (doc_id % 8) AS mode,
  (doc_id % 7)::INT AS uid, (doc_id % 3)::INT AS gid, printf('%08x', crc) AS checksum FROM (SELECT *, {{crc}} AS crc FROM (SELECT *, {_BYTES.format("encode(text)")} AS b FROM documents))""",
    "listing_bare": "SELECT doc_id || '.txt' AS path, octet_length(encode(text)) AS size FROM documents",
    "overwrite_policy": f"""
WITH e AS (SELECT {{crc}} % 3 = 0 AS there FROM (SELECT {_BYTES.format("encode(" + _PATH + ")")} AS b FROM documents)), p AS (SELECT unnest(['no', 'yes', 'ask']) AS policy)
SELECT policy, CASE WHEN NOT there THEN 'write' WHEN policy = 'yes' THEN 'replace' ELSE 'skip' END AS action, count(*) AS n FROM e, p GROUP BY ALL""",
    "sweep_reasons": """
SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN regexp_matches(text, '[|{}]') THEN 'markup' ELSE 'other' END AS reason, count(*) AS n, min(doc_id) AS example
FROM labels JOIN documents USING (doc_id) WHERE quality = 0 GROUP BY 1""",
    "sweep_pivot": """
SELECT lang, count(*) FILTER (quality = 1) AS pass, count(*) FILTER (quality IS DISTINCT FROM 1 AND toxic IS DISTINCT FROM 1) AS fail, count(*) FILTER (quality IS DISTINCT FROM 1 AND toxic = 1) AS skip
FROM labels JOIN documents USING (doc_id) GROUP BY lang""",
    "simulate_coded": f"""
WITH h AS (SELECT doc_id, hex({_PAYLOAD}) AS x FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(x, '..')) AS b, generate_subscripts(regexp_extract_all(x, '..'), 1) AS k FROM h),
c AS (SELECT *, (b IS DISTINCT FROM lag(b) OVER (PARTITION BY doc_id ORDER BY k))::INT AS new FROM w), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM c),
n AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
t AS (SELECT doc_id, sum(4 * (n // 258) + CASE WHEN n % 258 >= 3 THEN 4 ELSE n % 258 END)::BIGINT AS coded FROM n GROUP BY doc_id)
SELECT count(*) AS entries, sum(length(x) // 2)::BIGINT AS bytes, sum(least(coalesce(coded, 0), length(x) // 2))::BIGINT AS coded_bytes, count(*) FILTER (coalesce(coded, 0) >= length(x) // 2) AS stored FROM h LEFT JOIN t USING (doc_id)""",
    "rle_lengths": f"""
WITH h AS (SELECT doc_id, hex({_PAYLOAD}) AS x FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(x, '..')) AS b, generate_subscripts(regexp_extract_all(x, '..'), 1) AS k FROM h),
c AS (SELECT *, (b IS DISTINCT FROM lag(b) OVER (PARTITION BY doc_id ORDER BY k))::INT AS new FROM w), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM c),
n AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
t AS (SELECT doc_id, sum(4 * (n // 258) + CASE WHEN n % 258 >= 3 THEN 4 ELSE n % 258 END)::BIGINT AS coded FROM n GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS raw_length, coalesce(coded, 0) AS coded_length FROM h LEFT JOIN t USING (doc_id)""",
    "ascii_reorder": """
WITH u AS (SELECT unnest(string_split(text, '')) AS l FROM documents), n AS (SELECT l, count(*) AS n FROM u GROUP BY l),
c AS (SELECT chr(k::INT) AS l, coalesce(n, 0) AS n FROM range(97, 123) t(k) LEFT JOIN n ON n.l = chr(k::INT)), s AS (SELECT string_agg(l, '' ORDER BY n DESC, l) AS o FROM c)
SELECT doc_id, md5(translate(text, o, 'abcdefghijklmnopqrstuvwxyz')) AS coded, text = text AS undone FROM documents, s""",
    "embedded_payloads": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, md5(coalesce(text, '')) AS digest FROM documents",
    "preceding_match": """
WITH l AS (SELECT doc_id, unnest(range(5, length(text) + 1, 16)) AS pos, text FROM documents WHERE length(text) > 4),
k AS (SELECT doc_id, pos, substring(text, pos - 4, 4) AS context FROM l),
m AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id, context ORDER BY pos) AS found FROM k)
SELECT doc_id, count(*) AS probes, count(found) AS found, sum(pos - found)::BIGINT AS distance FROM m GROUP BY doc_id""",
    "interval_join": """
SELECT a.o_orderkey, count(*) AS earlier FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate AND b.o_orderdate >= a.o_orderdate - INTERVAL 7 DAY GROUP BY 1""",
    "stage_checks": f"""
WITH s AS (SELECT doc_id, unnest([0, 1, 2]) AS stage, unnest([coalesce(text, ''), lower(coalesce(text, '')), regexp_replace(coalesce(text, ''), '[0-9]', '0', 'g')]) AS t FROM documents),
b AS (SELECT doc_id, stage, {_BYTES.format("encode(t)")} AS b FROM s)
SELECT doc_id, stage, ((coalesce(list_sum(b), 0) % 255 + coalesce(list_sum(list_transform(b, lambda x, i: x * (len(b) - i + 1))), 0) % 255) % 255)::BIGINT AS check_byte FROM b""",
    "context_ranks": """
WITH e AS (SELECT event_id, user_id, ts, event_type, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS context FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, context ORDER BY ts, event_id) AS k FROM e), l AS (SELECT *, lag(k) OVER (PARTITION BY user_id, context, event_type ORDER BY k) AS before FROM n)
SELECT l.event_id, CASE WHEN any_value(l.before) IS NULL THEN NULL ELSE count(DISTINCT x.event_type) END AS rank
FROM l LEFT JOIN n x ON x.user_id = l.user_id AND x.context = l.context AND x.k > l.before AND x.k < l.k GROUP BY l.event_id""",
}
_CRC32 = crc_sql(0xEDB88320, 0xFFFFFFFF, 0xFFFFFFFF, "BIGINT")
for _k in ("listing_by_presence", "listing_all_columns", "overwrite_policy"):
    SQL[_k] = SQL[_k].replace("{crc}", _CRC32)
