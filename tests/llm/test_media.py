"""Media columns against independent computation from the bytes, and BMP with channel masks."""

import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from limnos.llm import media

TEXTS = ["", None, "a", "x" * 63, "y" * 64, "z" * 65, "Füße " * 40, "\u0000\n" * 70, "long " * 5000, "a"]


def plain_area(px, height, width):
    """Mean over each target cell, cell by cell."""
    h, w = px.shape
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            y0, y1, x0, x1 = i * h / height, (i + 1) * h / height, j * w / width, (j + 1) * w / width
            wy = np.array([max(0, min(y + 1, y1) - max(y, y0)) for y in range(h)])
            wx = np.array([max(0, min(x + 1, x1) - max(x, x0)) for x in range(w)])
            out[i, j] = wy @ px @ wx / ((y1 - y0) * (x1 - x0))
    return out


def test_every_column_from_the_bytes(spark):
    rows = {r["doc_id"]: r for r in media.text_media(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        form = b"P5\n64 " + str(len(payload) // 64).encode() + b"\n255\n" + payload
        assert (bytes(r["media"]), r["media_bytes"], r["media_sha256"]) == (form, len(form), hashlib.sha256(form).hexdigest())
        px = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(float)
        if len(px) < 100:
            small = plain_area(px, 8, 9).round(6)
            bits = "".join("1" if small[y, x] < small[y, x + 1] else "0" for y in range(8) for x in range(8))
            assert r["feature"].split("-")[0] == f"{int(bits, 2):016x}"
            tile = np.load(io.BytesIO(bytes(r["tile"])))
            assert tile.shape == (16, 16) and np.abs(tile - plain_area(px, 16, 16)).max() <= 0.5 + 1e-6
        assert r["feature"].split("-")[1] == hashlib.sha256(bytes(r["tile"])).hexdigest()[:16]
    assert rows[2]["media_sha256"] == rows[9]["media_sha256"]


def bmp(bits, rows, masks=None):
    head = struct.pack("<IiiHHIIiiII", 40, 1, -1, 1, bits, 3 if masks else 0, len(rows), 0, 0, 0, 0)
    extra = struct.pack("<III", *masks) if masks else b""
    return struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54 + len(extra)) + head + extra + rows


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (bmp(32, struct.pack("<I", 0x0A141E), (0xFF0000, 0xFF00, 0xFF)), [10, 20, 30]),
        (bmp(32, struct.pack("<I", 0x1E140A), (0xFF, 0xFF00, 0xFF0000)), [10, 20, 30]),
        (bmp(16, struct.pack("<HH", 0x7FFF, 0)), [255, 255, 255]),
        (bmp(16, struct.pack("<HH", 0x001F, 0)), [0, 0, 255]),
        (bmp(16, struct.pack("<HH", 0x07E0, 0), (0xF800, 0x07E0, 0x001F)), [0, 255, 0]),
        (bmp(24, bytes([30, 20, 10, 0])), [10, 20, 30]),
    ],
)
def test_bmp_colours(data, want):
    assert media.decode(data).tolist() == [[want]]


def test_broken_media_have_an_error(spark):
    rows = [(1, None), (2, b""), (3, b"BM" + bytes(60)), (4, b"P5\n2 2\n255\nab"), (5, b"P2 2 1 255 1 2"), (6, bmp(2, bytes(4)))]
    got = {r["id"]: r for r in media.media_tiles(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()}
    assert [k for k, r in got.items() if r["error"] is None] == [5] and got[5]["width"] == 2
