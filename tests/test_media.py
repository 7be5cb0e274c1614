import struct

import numpy as np

from bytestrata.operators import media


def test_series_come_back():
    r = np.random.default_rng(0)
    series = [np.cumsum(r.integers(-50, 50, n)) for n in (0, 1, 5, 400, 1000)]
    residuals = media.predict_series(series)
    assert all((a == b).all() for a, b in zip(media.restore_series(residuals), series, strict=True))
    stereo = np.stack([series[4], series[4] + r.integers(-5, 5, 1000)], 1)
    assert (media.decode_audio(media.encode_audio(stereo)) == stereo).all()
    assert media.sample_cost(residuals[4]) < media.sample_cost(series[4])


def test_images_come_back():
    r = np.random.default_rng(1)
    for shape in ((1, 1, 1), (7, 5, 3), (40, 60, 1)):
        image = r.integers(0, 256, shape).astype(np.uint8)
        assert (media.gradient_decode(media.gradient_encode(image)) == image).all()


def bmp(bits, width=320, palette=True):
    gray = b"".join(bytes((k, k, k, 0)) for k in range(256)) if bits == 8 and palette else bytes(range(256)) * 4 * (bits == 8)
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(gray)) + struct.pack("<IiiHHIIiiII", 40, width, 200, 1, bits, 0, 0, 0, 0, 0, 0) + gray + bytes(100)


def tiff(order, samples):
    e = order
    tags = [(256, 3, 1, 64), (257, 3, 1, 48), (258, 3, 1, 8), (259, 3, 1, 1), (273, 4, 1, 200), (277, 3, 1, samples)]
    body = struct.pack(e + "H", len(tags))
    for tag, kind, count, value in tags:
        body += struct.pack(e + "HHI", tag, kind, count) + (struct.pack(e + "HH", value, 0) if kind == 3 else struct.pack(e + "I", value))
    return (b"II*\0" if e == "<" else b"MM\0*") + struct.pack(e + "I", 8) + body


def test_image_headers():
    found = {
        "bmp": [bmp(24), bmp(8)],
        "pgm": [b"P5\n# made\n320 200\n255\n" + bytes(9)],
        "ppm": [b"P6 3 2 255\n" + bytes(18)],
        "tga": [bytes((0, 0, 2)) + bytes(9) + struct.pack("<HHBB", 320, 200, 24, 0) + bytes(30)],
        "tiff": [tiff("<", 1), tiff(">", 3)],
    }
    for kind, files in found.items():
        for f in files:
            assert media.image_header(f)["kind"] == kind
    for bad in (b"", b"BM", bmp(24, 100), bmp(8, palette=False), b"P5 x", b"hello world, this is a text", tiff("<", 2)):
        assert media.image_header(bad) is None


def test_audio_headers():
    wav = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 0, 4, 16) + b"data" + struct.pack("<I", 8) + bytes(8)
    assert media.wav_header(wav)["channels"] == 2 and media.wav_header(wav)["size"] == 8
    assert media.wav_header(wav.replace(struct.pack("<IHHI", 16, 1, 2, 44100), struct.pack("<IHHI", 16, 7, 2, 44100))) is None
    comm = b"COMM" + struct.pack(">IHIHHQ", 18, 1, 4, 8, 16383 + 12, 8000 << 51)
    aiff = b"FORM\0\0\0\0AIFF" + comm + b"SSND" + struct.pack(">III", 12, 0, 0) + bytes(4)
    assert media.aiff_header(aiff)["rate"] == 8000
    assert media.wav_header(aiff) is None and media.aiff_header(b"FORM") is None
    tone = (np.sin(np.arange(4000) / 20) * 9000).astype("<i2").tobytes()
    assert media.guess_samples(tone)["format"] in ("<i2", "<u2")
    assert media.implausible(np.random.default_rng(0).integers(-32768, 32767, 500), 16) and not media.implausible(np.arange(500), 16)
    assert media.executable_header(b"MZ\x90") and not media.executable_header(b"ELF")
