"""Media queries: the tables hold no media, so samples are made into files of known shape first."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytestrata.operators import media
from bytestrata.sources.catalog import table


def _wav(v: np.ndarray) -> bytes:
    body = v.astype("<i2").tobytes()
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", len(body))
    return b"RIFF" + struct.pack("<I", len(head) + len(body)) + head + body


def audio_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Each user's values as a file of 16-bit samples; header read, samples predicted, coded and decoded. A group is one user's series."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        data = _wav(rows.sort_values(["ts", "event_id"])["v"].to_numpy())
        head = media.wav_header(data)
        samples = np.frombuffer(data, "<i2", head["size"] // head["width"], head["start"]).astype(np.int64)[:, None]
        back = media.decode_audio(media.encode_audio(samples))
        return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "rate": [head["rate"]], "samples": [len(back)], "total": [int(back.sum())], "equal": [bool((back == samples).all())]})

    e = table(spark, d, "events").select("event_id", "user_id", "ts", (F.floor(F.col("value") * 10).cast("long") % 32768).alias("v"))
    return e.groupBy("user_id").applyInPandas(f, "user_id long, rate long, samples long, total long, equal boolean")


def _image(kind: int, pixels: np.ndarray) -> bytes:
    """16 pixels a row (128 in a bitmap of two rows), as a file of one of the kinds; the last is of none."""
    height = len(pixels) // 16
    if kind == 0:
        return b"P5 # gray\n16 %d\n255\n" % height + pixels.tobytes()
    if kind == 1:
        palette = b"".join(bytes((k, k, k, 0)) for k in range(256))
        head = struct.pack("<IHHIIiiHHIIiiII", 54 + 1024 + 256, 0, 0, 54 + 1024, 40, 128, 2, 1, 8, 0, 256, 2835, 2835, 256, 256)
        return b"BM" + head + palette + np.resize(pixels, 256).tobytes()
    if kind == 2:
        return struct.pack("<BBBHHBHHHHBB", 0, 0, 3, 0, 0, 0, 0, 0, 16, height, 8, 32) + pixels.tobytes()
    if kind == 3:
        tags = [(256, 4, 1, 16), (257, 4, 1, height), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, 8 + 2 + 9 * 12 + 4), (277, 3, 1, 1), (278, 4, 1, height), (279, 4, 1, len(pixels))]
        return b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4) + pixels.tobytes()
    return b"????" + pixels.tobytes()


def image_detect(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as an image of a kind that goes by its id; the chain of detectors names it, and its pixels come back through the gradient predictor."""

    def run(batches):
        for b in batches:
            rows = {k: [] for k in ("kind", "width", "height", "equal")}
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                pixels = (np.floor(np.array(v, np.float64) * 128).astype(np.int64) & 255).astype(np.uint8)
                data = _image(i % 5, pixels)
                found = (None, None, None, False)
                if head := media.image_header(data):
                    image = np.frombuffer(data, np.uint8, offset=head["start"]).reshape(head["height"], head["width"], 1)
                    equal = bool((media.gradient_decode(media.gradient_encode(image)) == image).all()) and image.tobytes() == np.resize(pixels, image.size).tobytes()
                    found = (head["kind"], head["width"], head["height"], equal)
                for k, x in zip(rows, found, strict=True):
                    rows[k].append(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(rows["kind"], pa.string()), pa.array(rows["width"], pa.int64()), pa.array(rows["height"], pa.int64()), pa.array(rows["equal"])], ["vec_id", *rows])

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, kind string, width long, height long, equal boolean")


QUERIES = {f.__name__: f for f in (audio_roundtrip, image_detect)}
SQL = {
    "audio_roundtrip": "SELECT user_id, 8000 AS rate, count(*) AS samples, sum(floor(value * 10)::BIGINT % 32768)::BIGINT AS total, true AS equal FROM events GROUP BY user_id",
    "image_detect": """
SELECT vec_id, ['pgm', 'bmp', 'tga', 'tiff', NULL][vec_id % 5 + 1] AS kind, CASE vec_id % 5 WHEN 4 THEN NULL WHEN 1 THEN 128 ELSE 16 END AS width,
  CASE vec_id % 5 WHEN 4 THEN NULL WHEN 1 THEN 2 ELSE len(embedding) // 16 END AS height, vec_id % 5 <> 4 AS equal FROM embeddings""",
}
