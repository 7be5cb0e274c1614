"""Round trips of codecs and transforms, segmentation and streams, and their SQL."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.operators import byte_transforms, codecs, segment
from bytestrata.operators.profile import entropy_cost, log_table, order1_counts
from bytestrata.session import spread
from bytestrata.sources.catalog import table
from bytestrata.streaming import events as streams


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def _round_trip(name: str):
    """Digests of what was decoded, and whether the codec made the long texts smaller, all together: a codec that does nothing fails that."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return _with_gain(codecs.round_trip(_documents(spark, d).select("doc_id", "text"), codecs.CODECS[name]))

    return query


def _with_gain(found: DataFrame) -> DataFrame:
    total = found.agg((F.sum("coded_length") < F.sum("raw_length")).alias("smaller"))
    return found.drop("coded_length").crossJoin(F.broadcast(total))  # one row


#: Rows that engage a transform: line ends, squares of a board, relative jumps.
_ENGAGING = {
    "crlf": lambda: F.encode(F.replace(F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\r\n")), F.lit(" of "), F.lit(" of\r\n")), "UTF-8"),
    "chess": lambda: F.encode(F.concat(F.coalesce("text", F.lit("")), F.md5(F.col("doc_id").cast("string"))), "UTF-8"),
    "x86": lambda: F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("90E8100000009090909090"))),
}


def _transform(name: str, source: str = "documents", key: str = "doc_id", column: str = "text"):
    """Digest and length of the restored bytes, length of the coded form, and whether it differs from the input."""
    forward, back = byte_transforms.TRANSFORMS[name]

    def run(batches):
        for b in batches:
            raw = [x or b"" for x in b.column(1).to_pylist()]
            coded = [forward(x) for x in raw]
            sha = [hashlib.sha256(x if c is None else back(c)).hexdigest() for x, c in zip(raw, coded, strict=True)]
            size = [len(x if c is None else c) for x, c in zip(raw, coded, strict=True)]
            changed = [c is not None and c != x for x, c in zip(raw, coded, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha), pa.array(size, pa.int64()), pa.array(changed, pa.bool_())], [key, "sha256", "coded_length", "changed"])

    def query(spark: SparkSession, d: str) -> DataFrame:
        payload = _ENGAGING[name]() if name in _ENGAGING else F.encode(F.col(column), "UTF-8")
        found = spread(table(spark, d, source)).select(key, payload.alias("payload")).mapInArrow(run, f"{key} long, sha256 string, coded_length long, changed boolean")
        return found.select(key, "sha256", *_CHECKED[name]) if name in _CHECKED else _any_changed(found, key)

    return query


#: What SQL can say of a transform's coded form, besides its restored bytes; of the others, that some row has changed.
_CHECKED = {"crlf": ["coded_length"], "chess": ["coded_length"], "numbers": ["coded_length"], "x86": ["coded_length", "changed"]}


def _any_changed(found: DataFrame, key: str) -> DataFrame:
    total = found.agg(F.bool_or("changed").alias("any_changed"))
    return found.select(key, "sha256").crossJoin(F.broadcast(total))  # one row


def stored_fallback(spark: SparkSession, d: str) -> DataFrame:
    return codecs.coded(_documents(spark, d).select("doc_id", "text"), codecs.CODECS["huffman"]).select("doc_id", "raw_length", "stored", F.octet_length("block").cast("long").alias("coded_length"))


def huffman_cost(spark: SparkSession, d: str) -> DataFrame:
    def run(batches):
        import numpy as np

        for b in batches:
            cost = [codecs.huffman_cost(np.bincount(np.frombuffer((t or "").encode(), np.uint8), minlength=256)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cost, pa.int64())], ["doc_id", "bits"])

    return _documents(spark, d).select("doc_id", "text").mapInArrow(run, "doc_id long, bits long")


def segment_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Parts put together again: bytes and digest of each text."""
    parts = segment.segment_documents(_documents(spark, d))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "bytes"))), lambda x: F.hex(x["bytes"])), "")
    joined = parts.groupBy("doc_id").agg(F.sum(F.octet_length("bytes")).cast("long").alias("bytes"), F.sha2(F.unhex(whole), 256).alias("sha256"))
    return joined


def segment_cuts(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold of the parts of each text: they follow each other, and each cut saves more than its margin by their own costs."""

    def run(batches):
        cost = lambda x: entropy_cost(order1_counts(x), log)
        for b in batches:
            rows = {"doc_id": [], "bytes": [], "contiguous": [], "each_cut_pays": []}
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                data, at, pays = t.encode(), 0, True
                for part in segment.segments(data):
                    buffer = data[at : at + segment.PULL]
                    at += len(part)
                    if len(part) < len(buffer):
                        whole = cost(buffer)
                        # a part's first two bytes are costed without what stands before them, hence a little slack
                        pays &= cost(part) + cost(buffer[len(part) :]) < whole - (whole >> segment.GAIN_SHIFT) - segment.GAIN + (64 << 12)
                for c, v in zip(rows, (i, at, at == len(data), pays), strict=True):
                    rows[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(rows["bytes"], pa.int64()), pa.array(rows["contiguous"], pa.bool_()), pa.array(rows["each_cut_pays"], pa.bool_())], [*rows])

    log = log_table()
    return _documents(spark, d).filter("text <> ''").select("doc_id", "text").mapInArrow(run, "doc_id long, bytes long, contiguous boolean, each_cut_pays boolean")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    found = streams.run_to_table(streams.sessions(streams.read_stream(spark, d, "events")), "complete")
    return found.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    found = streams.run_to_table(streams.tumbling(streams.read_stream(spark, d, "events")), "complete")
    return found.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n")


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    found = streams.run_to_table(streams.sliding(streams.read_stream(spark, d, "events")), "complete")
    return found.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n")


def stream_selfcheck(spark: SparkSession, d: str) -> DataFrame:
    stream = streams.read_stream(spark, d, "documents", 1).select("doc_id", F.encode("text", "UTF-8").alias("payload"))
    return streams.self_checked(stream, "doc_id", "payload").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stream_stateful_blocks(spark: SparkSession, d: str) -> DataFrame:
    updates = streams.run_to_table(streams.running_blocks(streams.read_stream(spark, d, "conversations", 1)), "update")
    return updates.groupBy("conv_id").agg(F.max("turns").alias("turns"), F.max("bytes").alias("bytes"))


QUERIES = {f"{k}_roundtrip": _round_trip(k) for k in codecs.CODECS} | {f"{k}_transform": _transform(k) for k in byte_transforms.TRANSFORMS if k != "html"}
QUERIES |= {"html_transform": _transform("html", "pages", "page_id", "html")}
QUERIES |= {f.__name__: f for f in (stored_fallback, huffman_cost, segment_blocks, segment_cuts, stream_sessions, stream_windows, stream_sliding, stream_selfcheck, stream_stateful_blocks)}

_SMALLER = {"stored": False, "rle": False}
_VARINT = "greatest(1, (length(bin({0})) + 6) // 7)"
SQL = {f"{k}_roundtrip": f"SELECT doc_id, octet_length(encode(text)) AS raw_length, sha256(text) AS sha256, {str(_SMALLER.get(k, True)).lower()} AS smaller FROM documents" for k in codecs.CODECS}
SQL |= {f"{k}_transform": "SELECT doc_id, sha256(text) AS sha256, true AS any_changed FROM documents" for k in byte_transforms.TRANSFORMS if k not in _CHECKED}
SQL |= {
    "crlf_transform": """
WITH t AS (SELECT doc_id, replace(replace(replace(text, chr(13), ''), chr(10), chr(13) || chr(10)), ' of ', ' of' || chr(13) || chr(10)) AS t FROM documents)
SELECT doc_id, sha256(t) AS sha256, 1 + octet_length(encode(replace(t, chr(13) || chr(10), chr(10)))) AS coded_length FROM t""",
    "chess_transform": """
WITH t AS (SELECT doc_id, coalesce(text, '') || md5(doc_id::VARCHAR) AS t FROM documents)
SELECT doc_id, sha256(t) AS sha256, octet_length(encode(t)) - CASE WHEN octet_length(encode(t)) = length(t) THEN len(regexp_extract_all(t, '[a-h][1-8]')) ELSE 0 END AS coded_length FROM t""",
    "numbers_transform": f"""
WITH v AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[0-9]{{{{1,17}}}}'), lambda x: ('1' || x)::BIGINT) AS v FROM documents),
s AS (SELECT *, coalesce(list_sum(list_transform(v, lambda x: {_VARINT.format("x")})), 0)::BIGINT AS size FROM v)
SELECT doc_id, sha256(text) AS sha256, {_VARINT.format("len(v)")} + {_VARINT.format("size")} + size + octet_length(encode(text)) AS coded_length FROM s""".replace("{{", "{").replace("}}", "}"),
    "x86_transform": """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) || unhex('90E8100000009090909090') AS t FROM documents)
SELECT doc_id, sha256(t) AS sha256, octet_length(t) AS coded_length, true AS changed FROM t""",
}
SQL |= {
    "html_transform": "SELECT page_id, sha256(html) AS sha256, true AS any_changed FROM pages",
    "huffman_cost": """
WITH RECURSIVE b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents),
c AS (SELECT doc_id, b, count(*) AS n FROM b GROUP BY ALL),
h AS (SELECT doc_id, list_sort(list(n)) AS l, CASE WHEN count(*) = 1 THEN sum(n) ELSE 0 END::BIGINT AS bits FROM c GROUP BY doc_id
  UNION ALL SELECT doc_id, list_sort(list_append(l[3:], l[1] + l[2])), bits + l[1] + l[2] FROM h WHERE len(l) > 1)
SELECT doc_id, coalesce(max(bits), 0) AS bits FROM documents LEFT JOIN h USING (doc_id) GROUP BY doc_id""",
    "segment_cuts": "SELECT doc_id, octet_length(encode(text)) AS bytes, true AS contiguous, true AS each_cut_pays FROM documents WHERE text <> ''",
    "segment_blocks": "SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM documents WHERE text <> ''",
    "stream_sessions": """
WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_windows": "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sliding": """
SELECT epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) - k * 900000000 AS start_us, event_type, count(*) AS n FROM events, range(4) t(k) GROUP BY ALL""",
    "stream_selfcheck": "SELECT 'ok' AS status, count(*) AS n FROM documents",
    "stream_stateful_blocks": "SELECT conv_id, count(*) AS turns, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes FROM conversations GROUP BY conv_id",
}
