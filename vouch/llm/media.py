"""ISO media containers: write a payload as samples, walk the boxes, decode the sample tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vouch.llm.common import read, text_slices

#: Boxes that only hold other boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex")
#: A sample holds so many bytes; a chunk so many samples; one sample in so many is a sync sample.
SAMPLE_BYTES, CHUNK_SAMPLES, SYNC_EVERY = 64, 32, 16
#: 8-bit samples a second.
RATE = 8000


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return struct.pack(">I4s", size, kind) + b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)


def full_box(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def _table(values: np.ndarray, wide: bool = False) -> bytes:
    return struct.pack(">I", len(values)) + values.astype(">u8" if wide else ">u4").tobytes()


def padded(data: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of ``SAMPLE_BYTES``."""
    return data + bytes(-len(data) % SAMPLE_BYTES if data else SAMPLE_BYTES)


def write_media(payload: bytes) -> bytes:
    """A file of one sound track of unsigned 8-bit samples (``raw ``) that holds the payload.

    The payload's length is a positive multiple of ``SAMPLE_BYTES``. Nothing in the file depends
    on the time or the machine, so equal payloads give equal files.
    """
    n = len(payload) // SAMPLE_BYTES
    if not n or len(payload) % SAMPLE_BYTES:
        raise ValueError(f"the payload must be a positive multiple of {SAMPLE_BYTES} bytes")
    # a media time unit is one byte, so a sample lasts SAMPLE_BYTES units
    duration = len(payload)
    chunks = -(-n // CHUNK_SAMPLES)
    last = n - (chunks - 1) * CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES)] * (chunks > 1) + [(chunks, last)] * (chunks == 1
                                                                     or last != CHUNK_SAMPLES)
    sound = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8),
                struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom")
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (CHUNK_SAMPLES * SAMPLE_BYTES)
        wide = first + len(payload) >= 1 << 32
        tables = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), sound),
            full_box(b"stts", struct.pack(">III", 1, n, SAMPLE_BYTES)),
            full_box(b"stss", _table(np.arange(1, n + 1, SYNC_EVERY))),
            full_box(b"stsc", struct.pack(">I", len(runs)),
                     *(struct.pack(">III", at, samples, 1) for at, samples in runs)),
            full_box(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
            full_box(b"co64" if wide else b"stco", _table(offsets, wide)))
        long = duration >= 1 << 32
        version = struct.pack(">I", long << 24)
        times = struct.pack(">QQIQ" if long else ">IIII", 0, 0, RATE, duration)
        track = struct.pack(">QQIIQ" if long else ">IIIII", 0, 0, 1, 0, duration)
        return box(
            b"moov",
            box(b"mvhd", version, times, struct.pack(">IH", 1 << 16, 1 << 8), bytes(10), matrix,
                bytes(24), struct.pack(">I", 2)),
            box(b"trak",
                box(b"tkhd", struct.pack(">I", long << 24 | 7), track, bytes(8),
                    struct.pack(">HHHH", 0, 0, 1 << 8, 0), matrix, bytes(8)),
                box(b"mdia",
                    box(b"mdhd", version, times, struct.pack(">HH", 0x55C4, 0)),
                    full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0"),
                    box(b"minf", full_box(b"smhd", bytes(4)),
                        box(b"dinf", full_box(b"dref", struct.pack(">I", 1),
                                              full_box(b"url ", flags=1))),
                        tables))))

    large = 8 * (len(payload) + 8 >= 1 << 32)
    size = len(moov(0))
    first = len(head) + size + 8 + large
    if len(moov(first)) != size:  # the wider offset table moves the payload
        size = len(moov(first))
        first = len(head) + size + 8 + large
    return head + moov(first) + box(b"mdat", payload)


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple = (),
         ) -> Iterator[tuple[tuple, int, int]]:
    """All boxes as (path of kinds, body start, body end), outer boxes first.

    Sizes 0 (to the end) and 1 (64 bits) are read. A box that is cut off or claims more than its
    parent has ends the walk of that parent.
    """
    end = len(data) if end is None else end
    todo = [(start, end, path)]
    while todo:
        at, stop, under = todo.pop()
        if at + 8 > stop:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1 and body + 8 <= stop:
            size = struct.unpack_from(">Q", data, body)[0]
            body += 8
        elif size == 0:
            size = stop - at
        if size < body - at or at + size > stop:
            continue
        here = (*under, kind)
        yield here, body, at + size
        todo.append((at + size, stop, under))
        if kind in CONTAINERS:
            todo.append((body, at + size, here))


@dataclass(frozen=True)
class Track:
    """What the tables say of one track; sample sizes and offsets are arrays."""

    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    sync: np.ndarray

    def keyframes(self) -> np.ndarray:
        """Rows of (first byte, byte after) of the sync samples in the file."""
        start = self.offsets[self.sync]
        return np.stack([start, start + self.sizes[self.sync]], axis=1)


def _numbers(data: bytes, at: int, count: int, kind: str = ">u4") -> np.ndarray:
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def _placed(tables: dict[bytes, tuple[int, int]], data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """File offset and size of every sample, from stsz, stsc and stco or co64."""
    at = tables[b"stsz"][0]
    fixed, n = struct.unpack_from(">II", data, at + 4)
    sizes = np.full(n, fixed, np.int64) if fixed else _numbers(data, at + 12, n)
    wide = b"co64" in tables
    at = tables[b"co64" if wide else b"stco"][0]
    chunks = _numbers(data, at + 8, struct.unpack_from(">I", data, at + 4)[0],
                      ">u8" if wide else ">u4")
    at = tables[b"stsc"][0]
    runs = _numbers(data, at + 8, 3 * struct.unpack_from(">I", data, at + 4)[0]).reshape(-1, 3)
    of_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    chunk = np.repeat(np.arange(len(chunks)), of_chunk)[:n]
    ends = np.cumsum(sizes)
    firsts = np.concatenate([[0], np.cumsum(of_chunk)[:-1]]).astype(np.int64)
    starts = ends - sizes
    return chunks[chunk] + starts - starts[firsts[chunk]], sizes


def read_tracks(data: bytes) -> list[Track]:
    """The tracks of a file, from its boxes alone; payloads are not touched. A track without
    complete tables is left out."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, start, end in walk(data):
        if path[-1] == b"trak":
            found.append({})
        elif b"trak" in path and found:
            found[-1].setdefault(path[-1], (start, end))
    tracks = []
    for boxes in found:
        if not {b"mdhd", b"stsd", b"stsz", b"stsc"} <= boxes.keys() \
                or not boxes.keys() & {b"stco", b"co64"}:
            continue
        at = boxes[b"mdhd"][0]
        timescale, duration = struct.unpack_from(">IQ" if data[at] else ">II", data,
                                                 at + (20 if data[at] else 12))
        codec = data[boxes[b"stsd"][0] + 12:boxes[b"stsd"][0] + 16].decode("latin-1")
        offsets, sizes = _placed(boxes, data)
        if b"stss" in boxes:
            at = boxes[b"stss"][0]
            sync = _numbers(data, at + 8, struct.unpack_from(">I", data, at + 4)[0]) - 1
        else:
            sync = np.arange(len(sizes))
        tracks.append(Track(codec, timescale, duration, offsets, sizes, sync))
    return tracks


def read_payload(data: bytes, track: Track) -> bytes:
    """The samples of a track in order; neighbours in the file are read at once."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    breaks = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    firsts = np.concatenate([[0], breaks])
    lasts = np.concatenate([breaks, [len(ends)]]) - 1
    return b"".join(data[a:b] for a, b in zip(track.offsets[firsts].tolist(),
                                              ends[lasts].tolist(), strict=True))


def feature(track: Track) -> str:
    """Codec, duration, samples, and the byte ranges of the sync samples: their number, the first,
    the last and a checksum of all."""
    ranges = track.keyframes()
    span = [f"{a}-{b}" for a, b in (*ranges[:1].tolist(), *ranges[-1:].tolist())]
    return (f"codec={track.codec.strip()};duration={track.duration}/{track.timescale};"
            f"samples={len(track.sizes)};keyframes={len(ranges)};first={span[0]};last={span[-1]};"
            f"ranges={zlib.crc32(ranges.astype('>i8').tobytes()):08x}")


FEATURES = ("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
            "media_bytes long, media_sha256 string, codec string, timescale long, duration long, "
            "keyframes long, feature string")


def media_features(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
                   with_file: bool = False) -> DataFrame:
    """Columns ``keep`` (default: all but the text), then ``FEATURES``, and with ``with_file`` the
    stored file (``media binary``) and its key ranges (``ranges array<struct<start,stop>>``).

    One narrow pass, a text at a time; the payload's digests are taken from the bytes that the
    sample tables point to. Null and empty texts are stored as one sample of zeros. Output names
    take the place of input columns of the same name.
    """
    names = [c.split()[0] for c in FEATURES.split(", ")] + ["media", "ranges"] * with_file
    keep = [c for c in docs.columns if c != text and c not in names] if keep is None else keep
    df = docs.select(*[docs[c] for c in keep], docs[text].alias("_text"))
    extra = ", media binary, ranges array<struct<start: bigint, stop: bigint>>" * with_file
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:-1])
    schema = f"{fields}{', ' * bool(fields)}{FEATURES}{extra}"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(),
             pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(),
             pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]

    def one(text: str) -> tuple:
        raw = text.encode()
        file = write_media(padded(raw))
        track = read_tracks(file)[0]
        payload = read_payload(file, track)
        row = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(),
               zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(),
               track.codec.strip(), track.timescale, track.duration, len(track.sync),
               feature(track))
        if with_file:
            row += (file, [{"start": a, "stop": b} for a, b in track.keyframes().tolist()])
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "_text"):
                rows = [one(t) for t in texts.to_pylist()]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds,
                                                                strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns],
                                                 [*part.schema.names[:-1], *names])

    return df.mapInArrow(run, schema)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 3 for every document."""
    return media_features(read(spark, sf_dir, "documents"), keep=["doc_id"])
