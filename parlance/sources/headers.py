"""Rate, channels and length of recordings from their headers, however long they are."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

#: Chunks of a RIFF file that are looked at before its data.
MOST_CHUNKS = 64
HEADER = "path string, codec string, rate long, channels long, bits long, seconds double, bytes_read long"

#: Bytes of a file from a place on, fewer at its end.
ReadAt = Callable[[int, int], bytes]


def wav_header(read: ReadAt, length: int) -> tuple[str, int, int, int, float] | None:
    """codec, rate, channels, bits and seconds of a RIFF file; only the heads of its chunks are read."""
    rate = channels = bits = frame = 0
    at = 12
    for _ in range(MOST_CHUNKS):
        head = read(at, 8)
        if len(head) < 8:
            return None
        name, size = struct.unpack("<4sI", head)
        if name == b"fmt ":
            _, channels, rate, _, frame, bits = struct.unpack("<HHIIHH", read(at + 8, 16))
        elif name == b"data" and rate and frame:
            # a writer that could not go back leaves 0 or the most there is; then the file's end counts
            size = length - at - 8 if size in (0, 0xFFFFFFFF) else min(size, length - at - 8)
            return "pcm" if bits else "riff", rate, channels, bits, size // frame / rate
        at += 8 + size + size % 2
    return None


def flac_header(read: ReadAt, length: int) -> tuple[str, int, int, int, float] | None:
    """The same of a FLAC file, from the block that comes first; no samples in all (unknown) give null seconds."""
    info = read(18, 8)
    if len(info) < 8:
        return None
    packed = int.from_bytes(info, "big")
    rate, channels, bits, samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    return ("flac", rate, channels, bits, samples / rate if samples else None) if rate else None


def probed(read: ReadAt, length: int) -> tuple:
    """codec, rate, channels, bits, seconds, bytes read; nulls for what is no known recording or breaks off."""
    taken = 0

    def counted(at: int, size: int) -> bytes:
        nonlocal taken
        got = read(at, size)
        taken += len(got)
        return got

    magic = counted(0, 12)
    found = None
    try:
        if magic[:4] == b"RIFF" and magic[8:] == b"WAVE":
            found = wav_header(counted, length)
        elif magic[:4] == b"fLaC":
            found = flac_header(counted, length)
    except struct.error:
        pass
    return (*(found or (None,) * 5), taken)


def _rows(paths: list[str], found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [()] * 6
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *map(pa.array, columns, kinds)], names=[f.split()[0] for f in HEADER.split(", ")])


def header_probe(files: DataFrame) -> DataFrame:
    """``HEADER`` of ``files(path, length)``, as a listing gives them. Tasks open the files where they lie (local, S3, GCS or
    HDFS addresses) and read a few hundred bytes at most, whatever their length."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, found = batch.column(0).to_pylist(), []
            for path, length in zip(paths, batch.column(1).to_pylist()):
                system, place = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                with system.open_input_file(place) as f:
                    found.append(probed(lambda at, size, f=f, length=length: f.read_at(max(0, min(size, length - at)), at) if at < length else b"", length))
            yield _rows(paths, found)

    return files.select("path", "length").mapInArrow(probe, HEADER)


def content_headers(files: DataFrame) -> DataFrame:
    """``HEADER`` of ``files(path, length, content)``, where the content may be just the beginning of a file of that length."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, lengths, contents = (c.to_pylist() for c in batch.columns)
            yield _rows(paths, [probed(lambda at, size, raw=raw: (raw or b"")[at : at + size], n) for n, raw in zip(lengths, contents)])

    return files.select("path", "length", "content").mapInArrow(probe, HEADER)
