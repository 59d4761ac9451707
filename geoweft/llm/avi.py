"""Motion-JPEG AVI: bytes stored losslessly as 8-bit samples, RIFF index parsing, shots and clips.

Frames are lossless JPEG (SOF3, predictor 1), 64 samples wide and at most 16 high. The Huffman table gives a
difference of category s a code of 16 - s bits, so that with its s extra bits every sample takes exactly 16
bits: a whole frame is written and read with array operations. A comment segment holds the number of rows in
use; unused rows of the last frame are 0. Frames are found through the index (idx1), never by scanning.

Shots: 32-bin histograms of neighbouring frames are compared; a boundary is where their L1 difference exceeds
both a floor and mean + k deviations of the differences before it in the same shot.

Defined cases: null text counts as empty; an empty text is 64 zero bytes, so one frame; equal bytes give equal
files; a file that is no such AVI raises ValueError, and so does a payload whose file would not fit RIFF's 32-bit sizes;
repeated rows give a file each, a null doc_id stays null, an empty table gives no rows, other columns are not read. A text
of any length is handled frame by frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import parts_of

WIDTH, HEIGHT, FPS, BINS = 64, 16, 25, 32
#: Codes of 16 - s bits for category s = 8, 7, ..., 0: symbols in order of length, counts by length.
LENGTHS = bytes([0] * 7 + [1] * 9)
SYMBOLS = bytes(range(8, -1, -1))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Difference + 255 -> 16-bit word, and word -> difference (or -1000)."""
    words, back, code = np.zeros(511, np.uint16), np.full(65536, -1000, np.int16), 0
    first = {}
    for s in SYMBOLS:
        first[s] = code
        code = (code + 1) << 1
    for d in range(-255, 256):
        s = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << s) - 1
        words[d + 255] = first[s] << s | extra
        back[words[d + 255]] = d
    return words, back


WORD, DIFFERENCE = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


TABLE = _segment(0xC4, b"\x00" + LENGTHS + SYMBOLS)
SCAN = _segment(0xDA, b"\x01\x01\x00" + b"\x01\x00\x00")


def jpegs(payload: bytes) -> list[bytes]:
    rows = len(payload) // WIDTH
    high = min(HEIGHT, rows)
    count = -(-rows // high)
    x = np.zeros((count, high, WIDTH), np.int16)
    x.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    coded = WORD[d + 255].astype(">u2")
    head = b"\xff\xd8" + TABLE + _segment(0xC3, struct.pack(">BHHB", 8, high, WIDTH, 1) + b"\x01\x11\x00")
    out = []
    for k in range(count):
        used = min(high, rows - k * high)
        out.append(head + _segment(0xFE, b"rows=%d" % used) + SCAN + coded[k].tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
    return out


def read_jpeg(data: bytes) -> np.ndarray:
    """The samples in use, rows x columns."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, high, wide, used, table = 2, 0, 0, None, b""
    while True:
        mark, kind, size = struct.unpack_from(">BBH", data, at)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark != 0xFF:
            raise ValueError("no JPEG segment")
        if kind == 0xC3:
            high, wide = struct.unpack_from(">HH", body, 1)
        elif kind == 0xC4:
            table = body
        elif kind == 0xFE and body.startswith(b"rows="):
            used = int(body[5:])
        elif kind == 0xDA:
            break
    if table != b"\x00" + LENGTHS + SYMBOLS or not high:
        raise ValueError("another kind of JPEG")
    words = np.frombuffer(data[at:-2].replace(b"\xff\x00", b"\xff"), ">u2")
    d = DIFFERENCE[words].reshape(high, wide).astype(np.int32)
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0])
    return np.cumsum(d, axis=1)[: high if used is None else used].astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def write_avi(payload: bytes) -> bytes:
    frames = jpegs(payload)
    high = min(HEIGHT, len(payload) // WIDTH)
    longest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, longest, WIDTH, high, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, FPS, 0, len(frames), longest, 0xFFFFFFFF, 0, 0, 0, WIDTH, high)
    picture = struct.pack("<IiiHH4sIiiII", 40, WIDTH, high, 1, 8, b"MJPG", WIDTH * high, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    movie, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movie.append(c)
        at += len(c)
    if at + 16 * len(frames) + len(header) > 0xFFFFFF00:
        raise ValueError("too long for one AVI")
    body = b"AVI " + header + _list(b"movi", b"".join(movie)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second, and the JPEG of each frame by the index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI")
    rate, movie, index, at = 0.0, 0, b"", 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            rate = 1e6 / struct.unpack_from("<I", data, at + 20)[0]
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movie = at + 8
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if not movie or not rate:
        raise ValueError("no frames")
    frames = []
    for kind, _, offset, size in struct.iter_unpack("<4sIII", index):
        if kind[2:] in (b"dc", b"db"):
            start = movie + offset + 8
            frames.append(data[start : start + size])
    return rate, frames


def shots(histograms: np.ndarray, floor: float = 0.35, k: float = 2.5) -> list[int]:
    """First frames of the shots."""
    starts, seen = [0], []
    for i, d in enumerate(np.abs(np.diff(histograms, axis=0)).sum(1), 1):
        if d > max(floor, (np.mean(seen) + k * np.std(seen)) if seen else 0):
            starts.append(i)
            seen = []
        else:
            seen.append(d)
    return starts


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "replace")
    return len(data), data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as an AVI file."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches):
            n, payloads = zip(*map(padded, b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(map(write_avi, payloads), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, n_bytes long, media binary")


CLIP = "clip: int, start_frame: int, frames: int, start_s: double, end_s: double, mean: double"


def read(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read back from media: digests of the payload and of the file, and its clips."""
    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<{CLIP}>>"

    def one(data: bytes) -> tuple:
        rate, frames = read_avi(data)
        pictures = [read_jpeg(f) for f in frames]
        payload = b"".join(p.tobytes() for p in pictures)
        h = np.stack([np.bincount(p.reshape(-1) >> 3, minlength=BINS) / max(1, p.size) for p in pictures])
        starts = shots(h)
        clips = [
            {"clip": c, "start_frame": a, "frames": b - a, "start_s": a / rate, "end_s": b / rate, "mean": round(float(np.mean(np.concatenate([p.reshape(-1) for p in pictures[a:b]]))), 3)}
            for c, (a, b) in enumerate(zip(starts, [*starts[1:], len(pictures)]))
        ]
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), clips

    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string()}
    kinds["clips"] = pa.list_(pa.struct({"clip": pa.int32(), "start_frame": pa.int32(), "frames": pa.int32(), "start_s": pa.float64(), "end_s": pa.float64(), "mean": pa.float64()}))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches):
            found = zip(*[one(m.as_py()) for m in b.column("media")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *[pa.array(c, t) for c, t in zip(found, kinds.values())]], ["doc_id", "n_bytes", *kinds])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(rows, schema)


def clips(media: DataFrame) -> DataFrame:
    """One row per timed clip: doc_id, clip, start_frame, frames, start_s, end_s, mean."""
    return read(media).select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")


def digests(docs: DataFrame) -> DataFrame:
    text = F.transform("clips", lambda c: F.format_string("%d+%d:%.3f", c["start_frame"], c["frames"], c["mean"]))
    return read(store(docs)).withColumn("feature", F.array_join(text, ";")).withColumn("n_clips", F.size("clips")).drop("clips")
