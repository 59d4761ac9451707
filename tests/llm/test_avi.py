import hashlib
import random
import struct
import zlib

import pytest

from geoweft.llm import avi

ODD = ["", None, "a", "x" * 64, "é" * 3000, "\x00ÿ" * 700, "abc " * 50_000]


def slow_samples(data):
    """Bit by bit, as any decoder of lossless JPEG does it."""
    at, codes = 2, {}
    while True:
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xC4:
            code, k = 0, 17
            for length in range(1, 17):
                for _ in range(body[length]):
                    codes[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif kind == 0xC3:
            high, wide = struct.unpack_from(">HH", body, 1)
        elif kind == 0xDA:
            break
    bits = "".join(f"{b:08b}" for b in data[at:-2].replace(b"\xff\x00", b"\xff"))
    p, out = 0, []
    for y in range(high):
        for x in range(wide):
            n = 1
            while (n, int(bits[p : p + n], 2)) not in codes:
                n += 1
            s = codes[n, int(bits[p : p + n], 2)]
            p += n
            e = int(bits[p : p + s], 2) if s else 0
            p += s
            d = e if not s or e >> (s - 1) else e - (1 << s) + 1
            before = 128 if x == y == 0 else out[-1] if x else out[-wide]
            out.append(before + d)
    return bytes(out)


def test_lossless_and_readable_by_a_plain_decoder():
    r = random.Random(1)
    for n in (64, 640, 4096):
        payload = bytes(r.choices([0, 1, 127, 128, 254, 255], k=n))
        _, frames = avi.read_avi(avi.write_avi(payload))
        assert b"".join(avi.read_jpeg(f).tobytes() for f in frames) == payload
        assert b"".join(map(slow_samples, frames))[:n] == payload
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFF....WAVE")


def test_query_columns(spark):
    docs = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(ODD)] + [(99, "a", b"")], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in avi.digests(docs).collect()}
    assert len(rows) == len(ODD) + 1
    for i, t in enumerate(ODD):
        n, payload = avi.padded(t)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(avi.write_avi(payload)).hexdigest()
    assert rows[99].feature == rows[2].feature and rows[0].media_sha256 == rows[1].media_sha256
    assert avi.digests(docs.limit(0)).collect() == []


def test_shots_and_clips(spark):
    docs = spark.createDataFrame([(1, "a" * 1024 * 5 + "Z9" * 512 * 4 + "a" * 1024 * 3)], "doc_id long, text string")
    found = [(c.start_frame, c.frames, c.start_s) for c in avi.clips(avi.store(docs)).orderBy("clip").collect()]
    assert found == [(0, 5, 0.0), (5, 4, 0.2), (9, 3, 0.36)]
