import datetime
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytestrata.functions import checksums, formatting
from bytestrata.operators import analysis, byte_transforms, codecs, profile, segment, verify
from bytestrata.plans import codec_queries
from bytestrata.sources import sinks
from bytestrata.sources.catalog import ScanOptions, host_info, listing, listing_columns, scan_files
from bytestrata.streaming import events

ALL = (1 << 64) - 1


def slow_crc64(data):
    c = ALL
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (checksums.CRC64_POLYNOMIAL if c & 1 else 0)
    return c ^ ALL


def test_crc64_check_value_and_pieces():
    assert int(checksums.crc64_many([b"123456789"])[0]) == 0x995DC9BBDF1939FA
    random.seed(1)
    for n in (0, 1, 255, 256, 257, 3000):
        d = random.randbytes(n)
        assert int(checksums.crc64_many([b"x", d])[1]) == slow_crc64(d)
    a, b = random.randbytes(1000), random.randbytes(77)
    x, y, z = (int(v) for v in checksums.crc64_many([a, b, a + b]))
    assert checksums.crc64_combine(x, y, len(b)) == z


def test_overlapping_pieces_stay_apart():
    data = random.randbytes(300)
    crc = {(o, n): int(checksums.crc64_many([data[o : o + n]])[0]) for o, n in ((0, 100), (50, 100), (100, 100), (150, 150))}
    runs = verify.open_runs([(o, n, c) for (o, n), c in crc.items()])
    assert [r[:2] for r in runs] == [[0, 200], [50, 250]]
    assert runs[0][2] == int(checksums.crc64_many([data[:200]])[0])


def blocks():
    random.seed(3)
    fixed = [b"", b"a", b"ab", b"abab", b"aaaa" * 50, b"abc" * 300, bytes(range(256)) * 4, random.randbytes(5000), b"the quick brown fox " * 100]
    pieces = [b"<p>", b"</p>", b"</b>", b"<b>", b"/", b"\\", b"<br/>", b"<", b">", b"\r", b"\n", b"\r\n", b"0", b"12", b", ", b",", b".", b" ", b"\x01", b"\x02", b"\xe8", b"\xe9", b"\x00", b"\xff", b"abcd", b"\xc3\xa9", b"e4"]
    return fixed + [b"".join(random.choices(pieces, k=random.randrange(60))) for _ in range(1500)]


@pytest.mark.parametrize("name", sorted(codecs.CODECS))
def test_codec_round_trip(name):
    encode, decode = codecs.CODECS[name]
    b = blocks()[:200]
    assert decode(encode(b)) == b


@pytest.mark.parametrize("name", sorted(byte_transforms.TRANSFORMS))
def test_transform_round_trip(name):
    forward, back = byte_transforms.TRANSFORMS[name]
    for b in blocks():
        c = forward(b)
        assert c is None or back(c) == b


def test_pipeline_and_mask():
    names = ["crlf", "numbers", "spaces", "html"]
    data = b"<p>1, 2, 3 and 44.\r\n</p>\r\n" * 80
    mask, coded = byte_transforms.pipeline_encode(data, names)
    assert mask and len(coded) < len(data)
    assert byte_transforms.pipeline_decode(mask, coded, names) == data


def test_bwt_is_the_sort_of_rotations():
    for s in (b"mississippi", b"banana", b"abracadabra!"):
        order = sorted(range(len(s)), key=lambda i: s[i:] + s[:i])
        assert codecs.bwt(s) == (bytes(s[i - 1] for i in order), order.index(0))


def test_tokens_cover_the_block():
    data = b"abcabcabcabc the cat the cat the cat" * 20
    tokens, literals = codecs.lz_tokens(data)
    assert codecs.from_tokens(tokens, literals, len(data)) == data
    with pytest.raises(ValueError):
        codecs.from_tokens([(0, 500, 1)], b"", 10)


def test_exp_golomb():
    v = np.array([0, 1, 2, 3, 100, 65535, 7])
    assert (codecs.exp_golomb_decode(codecs.exp_golomb(v)) == v).all()


def test_fixed_log():
    t = profile.log_table()
    v = np.arange(1, len(t))
    assert abs(t[1:] - np.log2(v) * 4096).max() <= 1


def test_segments_cut_where_the_content_changes():
    random.seed(7)
    text = b"the quick brown fox jumps over the lazy dog. " * 400
    noise = bytes(random.sample(text, len(text)))
    parts = list(segment.segments(text + noise))
    assert b"".join(parts) == text + noise
    assert len(parts) >= 2 and abs(len(parts[0]) - len(text)) < 1024
    assert list(segment.segments(text)) == [text]
    assert next(iter(segment.segments(text, forced=lambda b: 100))) == text[:100]


def test_prefix_cost_is_the_cost_of_the_prefix():
    b = np.frombuffer(random.Random(4).randbytes(400), np.uint8).astype(np.int64) & 7
    before, second = np.concatenate([[0], b[:-1]]), np.concatenate([[0, 0], b[:-2]])
    context = (32 * second + before) & 255
    costs = segment.prefix_costs(context, context * 256 + b)
    for n in (0, 1, 57, 400):
        assert costs[n] == profile.entropy_cost(profile.order1_counts(b[:n].astype(np.uint8).tobytes()), profile.log_table())


def test_formats(spark):
    sizes = {0: "     0 B ", 9216: "  9216 B ", 9217: "     9 KB", 9437184: "  9216 KB", 9437185: "     9 MB"}
    df = spark.createDataFrame([(k,) for k in sizes], "n long").select("n", formatting.size_column(F.col("n")).alias("s"))
    assert {r.n: r.s for r in df.collect()} == sizes
    cases = {"1.5k": 1536, "2m": 2097152, "": 0, "x": None, ".5k": 512, "1.2.3": None, "k": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", formatting.parse_size(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == cases


def test_globs_and_escapes(spark):
    names = spark.createDataFrame([("a/b.txt",), ("../x",), ("a/../../x",), ("C:/x",), ("/x",), ("a/../x",), ("ab[c].t",)], "p string")
    out = {r.p: r.e for r in names.select("p", formatting.escapes_target(F.col("p")).alias("e")).collect()}
    assert out == {"a/b.txt": False, "../x": True, "a/../../x": True, "C:/x": True, "/x": True, "a/../x": False, "ab[c].t": False}
    assert [r.p for r in names.filter(formatting.matches(F.col("p"), ["a?b*", "ab[[]c].t"])).collect()] == ["a/b.txt", "ab[c].t"]


def test_scan_and_replace(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes(b"one")
    (tmp_path / "in/sub/b.bin").write_bytes(b"two")
    flat = scan_files(spark, str(tmp_path / "in"), ScanOptions(include=["*.txt"]))
    assert [r.path for r in flat.collect()] == ["a.txt"]
    deep = scan_files(spark, str(tmp_path / "in"), ScanOptions(recurse=True))
    assert sorted(r.path for r in deep.collect()) == ["a.txt", "sub/b.bin"]
    target = str(tmp_path / "out")
    for _ in range(2):
        sinks.replace_verified(deep.select("path", "size", "checksum", "payload"), target)
    assert spark.read.parquet(target).count() == 2
    damaged = deep.withColumn("checksum", F.when(F.col("path") == "a.txt", F.col("checksum") + 1).otherwise(F.col("checksum")))
    assert {r.path: r.status for r in sinks.verification(damaged).collect()} == {"a.txt": "damaged", "sub/b.bin": "ok"}
    assert [r.path for r in sinks.extractable(damaged, safe=True).collect()] == ["sub/b.bin"]


def test_partitioning_does_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = [sorted(map(tuple, profile.order1_entropy(docs.repartition(n)).collect())) for n in (1, 4, 16)]
    assert found[0] == found[1] == found[2]


def test_extraction_writes_within_its_target(spark, tmp_path):
    target = tmp_path / "out"
    (target / "a").mkdir(parents=True)
    (target / "a" / "there.txt").write_bytes(b"old")
    rows = [("a/new.txt", b"new", 1), ("a/there.txt", b"fresh", 1), ("../x.txt", b"no", 1), ("a/bad.txt", b"bad", 0), ("empty.txt", None, None)]
    entries = spark.createDataFrame(rows, "path string, payload binary, ok int")
    entries = entries.withColumn("checksum", F.when(F.col("ok") == 1, F.crc32("payload")).when(F.col("ok") == 0, F.lit(7))).drop("ok")
    status = {r.path: r.status for r in sinks.extract_files(entries, str(target), "ask", safe=True).collect()}
    assert status == {"a/new.txt": "written", "a/there.txt": "skipped", "../x.txt": "refused", "a/bad.txt": "damaged", "empty.txt": "written"}
    assert (target / "a" / "there.txt").read_bytes() == b"old" and (target / "empty.txt").read_bytes() == b"" and not (tmp_path / "x.txt").exists()
    again = {r.path: r.status for r in sinks.extract_files(entries, str(target), "yes").collect()}
    assert again["a/there.txt"] == "replaced" and again["a/bad.txt"] == "written" and (target / "a" / "there.txt").read_bytes() == b"fresh"
    with pytest.raises(ValueError):
        sinks.extract_files(entries, str(target), "perhaps")


def test_blocks_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, b"a" * 1000), (2, b"abc"), (3, b"")], "doc_id long, payload binary")
    blocks = sinks.write_blocks(docs, codecs.CODECS["rle"], str(tmp_path / "blocks"))
    assert {r.doc_id: (r.raw_length, r.stored) for r in blocks.collect()} == {1: (1000, False), 2: (3, True), 3: (0, True)}
    assert {r.doc_id: bytes(r.payload) for r in codecs.decoded(blocks, codecs.CODECS["rle"]).collect()} == {1: b"a" * 1000, 2: b"abc", 3: b""}


def test_round_trip_gain_is_the_codecs_own(spark, tmp_path):
    """One block that run lengths make smaller does not outweigh those that they make larger; every block comes back, null as empty."""
    texts = [*(f"aaa bbb {k} ccc ddd eee fff" for k in range(50)), "x" * 40, "", None]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, smaller in (("rle", False), ("stored", False), ("bwt", True)):
        docs = str(tmp_path) if name != "bwt" else "/root/testdata/sf0.001"
        out = codec_queries.QUERIES[f"{name}_roundtrip"](spark, docs).collect()
        assert {r.smaller for r in out} == {smaller}
        if name != "bwt":
            assert {r.doc_id: (r.raw_length, r.sha256) for r in out} == {k: (len(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in enumerate(texts)}


def test_listing_order(spark):
    rows = [("b/z.txt", 5), ("a/y.md", 9), ("a/x.txt", 5), ("c", 1)]
    entries = spark.createDataFrame(rows, "path string, size long")
    assert [r.path for r in listing(entries, sort="name").collect()] == ["a/x.txt", "a/y.md", "b/z.txt", "c"]
    assert [r.path for r in listing(entries, sort="size").collect()] == ["c", "a/x.txt", "b/z.txt", "a/y.md"]
    assert [r.path for r in listing(entries, sort="extension").collect()] == ["c", "a/y.md", "a/x.txt", "b/z.txt"]
    assert [r.path for r in listing_columns(entries).collect()] == ["a/x.txt", "a/y.md", "b/z.txt", "c"]


def test_exe_hits():
    def call(at, target):
        return b"\xe8" + (target - at - 1).to_bytes(4, "little", signed=True)

    targets = [1000, 2000, 1000, 3000, 4000, 5000, 1000, 5000, 2000]
    code = b"".join(call(5 * k, t) for k, t in enumerate(targets))
    assert byte_transforms.exe_hits(code + bytes(8)) == sum(t in targets[max(0, k - 4) : k] for k, t in enumerate(targets)) == 3
    assert byte_transforms.exe_hits(b"") == 0 and byte_transforms.exe_hits(b"\xe8\0") == 0


def test_host_info(spark):
    (row,) = host_info(spark).collect()
    assert row.version == spark.version and row.parallelism == spark.sparkContext.defaultParallelism


def test_block_rle_score_step_by_step():
    random.seed(5)
    for _ in range(300):
        data = b"".join(random.choice([b"aaaa", b"abab", b"abca", b"zzzz", b"0"]) * random.randrange(1, 200 if random.random() < 0.05 else 4) for _ in range(random.randrange(12)))
        score, before, bonus = 0, None, 0
        for k in range(0, len(data) - 3, 4):
            word = data[k : k + 4]
            own = sum(word[j] == word[j + 1] for j in range(3))
            bonus = (own + bonus + 1) % 128 if word == before else own
            score, before = score + bonus, word
        assert analysis.block_rle_score(data) == score


def test_sessions_are_written_once_when_over(spark, tmp_path):
    def batch(name, rows):
        spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    at = datetime.datetime(2024, 1, 1)
    batch("one", [(1, at), (1, at + datetime.timedelta(minutes=10)), (2, at)])
    batch("two", [(1, at + datetime.timedelta(days=3))])
    source = spark.readStream.schema("user_id long, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = events.run_to_table(events.sessions(source), "append")
    found = {(r.user_id, r.n) for r in out.collect()}
    assert (1, 2) in found and (2, 1) in found
    assert not any(r.start == at + datetime.timedelta(days=3) for r in out.collect())  # still open
