"""Queries on ordered rows and text transforms, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.functions.formatting import case_mode
from bytestrata.operators import text_transforms as tt
from bytestrata.operators import windows as w
from bytestrata.session import spread
from bytestrata.sources.catalog import table

USER = ["user_id"], ["ts", "event_id"]


def _events(spark: SparkSession, d: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", micros.alias("micros"), F.round(F.col("value") * 100).cast("long").alias("v"))


def delta_series(spark: SparkSession, d: str) -> DataFrame:
    win = w.ordered(*USER)
    return _events(spark, d).select("event_id", w.delta(F.col("v"), win).alias("delta"), w.delta(F.col("v"), win, 3).alias("delta3"))


def delta_restore(spark: SparkSession, d: str) -> DataFrame:
    win = w.ordered(*USER)
    e = _events(spark, d).withColumn("delta", w.delta(F.col("v"), win))
    return e.select("event_id", w.restored(F.col("delta"), win).alias("v"))


def zigzag_deltas(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("delta", w.delta(F.col("micros"), w.ordered(["user_id"], ["event_id"])))
    e = e.withColumn("zigzag", w.zigzag(F.col("delta")))
    return e.select("event_id", "zigzag", (w.unzigzag(F.col("zigzag")) == F.col("delta")).alias("undone"))


def equal_value_runs(spark: SparkSession, d: str) -> DataFrame:
    return w.equal_runs(_events(spark, d), *USER, "event_type")


def line_prefix_rle(spark: SparkSession, d: str) -> DataFrame:
    return w.line_prefixes(spread(table(spark, d, "documents"))).select("doc_id", "line_no", "shared", F.length("rest").cast("long").alias("rest_length"))


def last_n_targets(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", w.recent_hits(F.col("event_type"), w.ordered(*USER)).cast("long").alias("hits"))


def asof_match(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", w.earlier_match(F.col("event_id"), ["user_id", "event_type"], ["ts", "event_id"]).alias("match"))


def recent_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Move-to-front rank of each event's type, null for the first of its type."""
    return w.recent_ranks(_events(spark, d), *USER, "event_type").select("event_id", "rank")


def mid_side(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * 100).cast("long").alias("left"), F.round(F.col("l_discount") * 1000).cast("long").alias("right"))
    mid, side = w.mid_side(F.col("left"), F.col("right"))
    return line.select("l_orderkey", "l_linenumber", mid.alias("mid"), side.alias("side"))


def raster_gradient(spark: SparkSession, d: str) -> DataFrame:
    """Embedding vectors as rows of 16 samples."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    raster = e.select(F.col("vec_id").alias("image_id"), F.lit(0).alias("c"), F.floor(F.col("pos") / 16).cast("long").alias("y"), (F.col("pos") % 16).cast("long").alias("x"), F.floor(F.col("x").cast("double") * 128).cast("long").alias("v"))
    return w.gradient_residual(raster).drop("c")


def longrange_dups(spark: SparkSession, d: str) -> DataFrame:
    return tt.long_range_duplicates(spread(table(spark, d, "documents")))


def mask_numbers(spark: SparkSession, d: str) -> DataFrame:
    masked, values = tt.mask_numbers(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", "text", masked.alias("masked"), values.alias("values"))
    return docs.select("doc_id", F.md5("masked").alias("masked_md5"), F.size("values").cast("long").alias("numbers"), (tt.unmask_numbers(F.col("masked"), F.col("values")) == F.col("text")).alias("undone"))


def number_values(spark: SparkSession, d: str) -> DataFrame:
    _, values = tt.mask_numbers(F.col("text"))
    return table(spark, d, "documents").select(F.explode(values).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def crlf_normalise(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", tt.expand_crlf(F.col("text")).alias("crlf"))
    return docs.select("doc_id", F.length("crlf").cast("long").alias("crlf_length"), F.md5(tt.collapse_crlf(F.col("crlf"))).alias("md5"), tt.uniform_crlf(F.col("crlf")).alias("uniform"))


def insert_lf(spark: SparkSession, d: str) -> DataFrame:
    flat, at = tt.flatten_lines(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", flat.alias("flat"), at.alias("at"))
    return docs.select("doc_id", F.md5("flat").alias("flat_md5"), F.size("at").cast("long").alias("feeds"), F.coalesce(F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("places"))


def html_tag_stats(spark: SparkSession, d: str) -> DataFrame:
    return tt.tag_statistics(table(spark, d, "pages"))


def word_cases(spark: SparkSession, d: str) -> DataFrame:
    return tt.words(table(spark, d, "documents")).groupBy(case_mode(F.col("word")).cast("long").alias("mode")).agg(F.count(F.lit(1)).alias("words"))


def dict_encode_join(spark: SparkSession, d: str) -> DataFrame:
    return tt.dictionary_encode(spread(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (delta_series, delta_restore, zigzag_deltas, equal_value_runs, line_prefix_rle, last_n_targets, asof_match, recent_ranks, mid_side, raster_gradient, longrange_dups, mask_numbers, number_values, crlf_normalise, insert_lf, html_tag_stats, word_cases, dict_encode_join)}

_E = "e AS (SELECT event_id, user_id, ts, event_type, epoch_us(ts) AS micros, round(value * 100)::BIGINT AS v FROM events)"
_W = "w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_WORDS = "w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ɏ]+')) AS word FROM documents)"
SQL = {
    "delta_series": f"WITH {_E} SELECT event_id, v - coalesce(lag(v) OVER w, 0) AS delta, v - coalesce(lag(v, 3) OVER w, 0) AS delta3 FROM e WINDOW {_W}",
    "delta_restore": f"WITH {_E} SELECT event_id, v FROM e",
    "zigzag_deltas": f"""
WITH {_E}, x AS (SELECT event_id, micros - coalesce(lag(micros) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta FROM e)
SELECT event_id, CASE WHEN delta >= 0 THEN 2 * delta ELSE -2 * delta - 1 END AS zigzag, true AS undone FROM x""",
    "equal_value_runs": f"""
WITH {_E}, m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM e WINDOW {_W}),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run_no FROM m)
SELECT user_id, run_no, event_type, count(*) AS n FROM r GROUP BY ALL""",
    "line_prefix_rle": """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no FROM s),
p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS prior FROM l),
x AS (SELECT *, CASE WHEN prior IS NULL THEN 0 ELSE len(list_filter(range(1, 32), lambda k: length(line) >= k AND length(prior) >= k AND left(line, k) = left(prior, k))) END AS shared FROM p)
SELECT doc_id, line_no, shared, length(line) - shared AS rest_length FROM x""",
    "last_n_targets": f"""
WITH {_E} SELECT event_id, (coalesce((lag(event_type, 1) OVER w = event_type)::INT, 0) + coalesce((lag(event_type, 2) OVER w = event_type)::INT, 0)
  + coalesce((lag(event_type, 3) OVER w = event_type)::INT, 0) + coalesce((lag(event_type, 4) OVER w = event_type)::INT, 0))::BIGINT AS hits FROM e WINDOW {_W}""",
    "asof_match": f"WITH {_E} SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS match FROM e",
    "recent_ranks": f"""
WITH {_E}, n AS (SELECT event_id, user_id, event_type, row_number() OVER w AS pos FROM e WINDOW {_W}), l AS (SELECT *, lag(pos) OVER (PARTITION BY user_id, event_type ORDER BY pos) AS prior FROM n)
SELECT l.event_id, CASE WHEN any_value(prior) IS NOT NULL THEN count(DISTINCT n.event_type) END AS rank FROM l LEFT JOIN n ON n.user_id = l.user_id AND n.pos > l.prior AND n.pos < l.pos GROUP BY l.event_id""",
    "mid_side": """
WITH s AS (SELECT l_orderkey, l_linenumber, round(l_quantity * 100)::BIGINT AS l, round(l_discount * 1000)::BIGINT AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, r + ((l - r) >> 1) AS mid, l - r AS side FROM s""",
    "raster_gradient": """
WITH p AS (SELECT vec_id AS image_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS e FROM embeddings),
r AS (SELECT image_id, pos // 16 AS y, pos % 16 AS x, floor(e::DOUBLE * 128)::BIGINT AS v FROM p)
SELECT image_id, y, x, v - ((coalesce(lag(v) OVER (PARTITION BY image_id, y ORDER BY x), 0) + coalesce(lag(v) OVER (PARTITION BY image_id, x ORDER BY y), 0) + 1) >> 1) AS residual FROM r""",
    "longrange_dups": """
WITH p AS (SELECT doc_id, text, unnest(range(1, length(text) - 254, 256)) AS i FROM documents WHERE length(text) >= 256), h AS (SELECT doc_id, md5(substring(text, i, 256)) AS hash FROM p)
SELECT hash, count(*) AS places, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM h GROUP BY hash HAVING count(*) > 1""",
    "mask_numbers": """
SELECT doc_id, md5(regexp_replace(text, '[0-9]', '0', 'g')) AS masked_md5, len(regexp_extract_all(text, '[0-9]+')) AS numbers, true AS undone FROM documents""",
    "number_values": "WITH v AS (SELECT unnest(regexp_extract_all(text, '[0-9]+')) AS value FROM documents) SELECT value, count(*) AS n FROM v GROUP BY value",
    "crlf_normalise": "SELECT doc_id, length(text) + length(text) - length(replace(text, chr(10), '')) AS crlf_length, md5(text) AS md5, true AS uniform FROM documents",
    "insert_lf": """
WITH f AS (SELECT doc_id, text, list_filter(list_zip(regexp_extract_all(text, '[ \\n]'), range(1, 1 + len(regexp_extract_all(text, '[ \\n]')))), lambda z: z[1] = chr(10)) AS feeds_at FROM documents)
SELECT doc_id, md5(replace(text, chr(10), ' ')) AS flat_md5, len(feeds_at) AS feeds, coalesce(list_sum(list_transform(feeds_at, lambda z: z[2])), 0)::BIGINT AS places FROM f""",
    "html_tag_stats": """
WITH t AS (SELECT unnest(regexp_extract_all(html, '<(/?[A-Za-z][A-Za-z0-9]*)', 1)) AS t FROM pages)
SELECT lower(ltrim(t, '/')) AS tag, count(*) FILTER (t NOT LIKE '/%') AS opened, count(*) FILTER (t LIKE '/%') AS closed FROM t GROUP BY 1""",
    "word_cases": f"""
WITH {_WORDS} SELECT (CASE WHEN word = lower(word) THEN 0 WHEN word = upper(left(word, 1)) || lower(word)[2:] THEN 1 WHEN word = upper(word) THEN 2 ELSE 3 END)::BIGINT AS mode, count(*) AS words FROM w GROUP BY 1""",
    "dict_encode_join": f"""
WITH {_WORDS}, c AS (SELECT lower(word) AS low, count(*) AS n FROM w GROUP BY 1), v AS (SELECT low, row_number() OVER (ORDER BY n DESC, low) - 1 AS code FROM c QUALIFY code < 500)
SELECT doc_id, count(*) AS words, count(code) AS coded, sum(CASE WHEN code < 128 THEN 1 WHEN code IS NOT NULL THEN 2 ELSE octet_length(encode(word)) + 1 END)::BIGINT AS bytes
FROM w LEFT JOIN v ON lower(word) = low GROUP BY doc_id""",
}
