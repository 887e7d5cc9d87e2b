"""Headers of recordings: what is read does not grow with the file, and odd files give nulls."""

import struct
import wave

import numpy as np

from parlance.plans import stages
from parlance.sources import headers as H
from parlance.sources.scans import listing


def wav(path, n, rate=16_000, channels=2):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes(np.zeros(n * channels, dtype="<i2").tobytes())


def flac(rate, channels, bits, samples):
    packed = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | samples
    return b"fLaC" + bytes([0x80, 0, 0, 34]) + bytes(10) + packed.to_bytes(8, "big") + bytes(16)


def test_bytes_read_do_not_grow(spark, tmp_path):
    sizes = {"a": 10, "b": 1_000_000}
    for name, n in sizes.items():
        wav(tmp_path / f"{name}.wav", n)
    (tmp_path / "c.flac").write_bytes(flac(44_100, 2, 24, 88_200) + bytes(100))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in H.header_probe(listing(spark, str(tmp_path))).collect()}
    assert [(r.codec, r.rate, r.channels, r.bits, r.seconds) for r in (rows["a.wav"], rows["b.wav"], rows["c.flac"])] == [
        ("pcm", 16_000, 2, 16, 10 / 16_000), ("pcm", 16_000, 2, 16, 62.5), ("flac", 44_100, 2, 24, 2.0),
    ]
    assert rows["a.wav"].bytes_read == rows["b.wav"].bytes_read < 100


def test_odd_files(spark):
    form = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16)
    cases = {
        "open": b"RIFF\xff\xff\xff\xff" + form + b"data\xff\xff\xff\xff" + bytes(320),
        "cut": b"RIFF\0\0\0\0" + form + b"data" + struct.pack("<I", 16_000) + bytes(160),
        "no data": b"RIFF\0\0\0\0" + form,
        "data first": b"RIFF\0\0\0\0WAVEdata" + struct.pack("<I", 4) + bytes(4),
        "short": b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0\1",
        "flac cut": b"fLaC\0\0\0",
        "flac open": flac(8000, 1, 16, 0),
        "other": b"ID3 something",
        "empty": b"",
    }
    rows = [(k, len(v), v) for k, v in cases.items()] + [("null", 0, None)]
    df = spark.createDataFrame(rows, "path string, length long, content binary")
    found = {r.path: (r.codec, r.seconds) for r in H.content_headers(df).collect()}
    assert found == {"open": ("pcm", 0.02), "cut": ("pcm", 0.01), "flac open": ("flac", None), **{k: (None, None) for k in ("no data", "data first", "short", "flac cut", "other", "empty", "null")}}
    assert H.content_headers(df.limit(0)).collect() == []


def test_models_are_loaded_in_tasks_and_skip_nulls(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id long, piece string")
    out = {r.id: r.vector for r in stages.embedded(df, lambda: lambda ps: [[float(len(p))] for p in ps], "piece").collect()}
    assert out == {1: [2.0], 2: None, 3: [0.0]}
    images = spark.createDataFrame([(1, b"x"), (2, None)], "id long, image binary")
    texts = {r.id: r.text for r in stages.read_texts(images, lambda: lambda xs: ["  a \n\n b " for _ in xs], "image").collect()}
    assert texts == {1: "a\nb", 2: None}
    assert stages.embedded(df.limit(0), lambda: lambda ps: [], "piece").collect() == []
