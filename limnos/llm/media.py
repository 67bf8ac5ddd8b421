"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized by integral images, written as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The next `fields` decimal numbers of a Netpbm header after its magic, and the offset behind the single white space that ends it. '#' comments run to the line's end."""
    out, at = [], 2
    while len(out) < fields:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            at = (data.find(b"\n", at) + 1 or len(data)) if data[at] == 35 else at + 1
        start = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if start == at:
            raise ValueError("bad Netpbm header")
        out.append(int(data[start:at]))
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3), uint8, or uint16 where the maximum is over 255. Bitmaps give 0 for black, 255 for white."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("no Netpbm")
    bitmap = kind in (b"P1", b"P4")
    head, at = _header(data, 2 if bitmap else 3)
    w, h, most = (*head, 1)[:3]
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :w]) * np.uint8(255)
    if kind == b"P1":
        bits = np.frombuffer(bytes(c for c in data[at - 1 :] if c in b"01")[: w * h], np.uint8) - 48
        return ((1 - bits) * 255).astype(np.uint8).reshape(h, w)
    if kind in (b"P2", b"P3"):
        flat = np.array(data[at - 1 :].split()[: w * h * depth], dtype=np.int64).astype(np.uint8 if most < 256 else np.uint16)
    else:
        flat = np.frombuffer(data, np.uint8 if most < 256 else np.dtype(">u2"), w * h * depth, at)
        flat = flat if most < 256 else flat.astype(np.uint16)
    return flat.reshape((h, w, 3) if depth == 3 else (h, w))


def encode_pgm(pixels: np.ndarray) -> bytes:
    """8-bit grey as P5."""
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _channel(values: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask as 0 to 255; 0 for an empty mask."""
    if not mask:
        return np.zeros(values.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return (((values & np.uint32(mask)) >> np.uint32(low)).astype(np.uint64) * 255 // most).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits, with or without channel masks. Palettes that are all grey give (h, w), colours (h, w, 3) as RGB; transparency is left out."""
    if data[:2] != b"BM":
        raise ValueError("no BMP")
    start, size, w, h, _, bits, packed = *struct.unpack_from("<I", data, 10), *struct.unpack_from("<IiiHHI", data, 14)
    if packed not in (0, 3, 6) or bits not in (1, 4, 8, 16, 24, 32) or (packed and bits not in (16, 32)):
        raise ValueError("compressed BMP")
    tall, line = abs(h), (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, tall * line, start).reshape(tall, line)
    rows = rows[::-1] if h > 0 else rows
    if bits == 16 or packed:
        masks = struct.unpack_from("<III", data, 54) if packed else (0x7C00, 0x03E0, 0x001F)
        values = np.ascontiguousarray(rows[:, : w * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.uint32)
        return np.stack([_channel(values, m) for m in masks], axis=2)
    if bits in (24, 32):
        return rows[:, : w * bits // 8].reshape(tall, w, bits // 8)[:, :, 2::-1].copy()
    if bits == 8:
        index = rows[:, :w]
    else:
        index = np.unpackbits(rows, axis=1)
        index = index[:, :w] if bits == 1 else (index.reshape(tall, -1, 4) @ np.array([8, 4, 2, 1], np.uint8))[:, :w]
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    full = palette[index]
    return full[:, :, 0].copy() if (palette == palette[:, :1]).all() else full


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8-bit grey with a grey palette, bottom row first."""
    h, w = pixels.shape
    rows = np.zeros((h, (w + 3) // 4 * 4), np.uint8)
    rows[:, :w] = pixels[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    start = 54 + 1024
    return struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 256) + palette.tobytes() + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, by an integral image read at fractional corners. Exact for any size up or down; float64."""
    grey = pixels.astype(np.float64).mean(axis=2) if pixels.ndim == 3 else pixels.astype(np.float64)
    h, w = grey.shape
    whole = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(grey, axis=0), axis=1, out=whole[1:, 1:])

    def along(table: np.ndarray, n: int, cells: int) -> np.ndarray:
        at = np.arange(cells + 1) * (n / cells)
        low = np.minimum(at.astype(np.int64), n - 1)
        part = (at - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    corners = along(along(whole, h, height).T, w, width).T
    return (corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]) * (height * width / (h * w))


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: in the 8 x 9 reduction, is a cell darker than its right neighbour."""
    small = area_resize(pixels, 8, 9).round(6)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def npy_tile(pixels: np.ndarray, side: int) -> bytes:
    """The side x side reduction as an NPY file of uint8."""
    out = io.BytesIO()
    np.save(out, np.clip(area_resize(pixels, side, side).round(), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def media_tiles(df: DataFrame, id_col: str, media_col: str, side: int = 32) -> DataFrame:
    """One row per media row: id, height, width, tile (NPY bytes), dhash (16 hex digits), error.

    Null, broken or empty media: null in all but id and error. Repeated rows and ids stay; other columns of df are not read."""

    def step(b: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("id", "height", "width", "tile", "dhash", "error")}
        for key, data in zip(b["id"], b["media"]):
            try:
                if data is None:
                    raise ValueError("null")
                px = decode(data)
                if not px.size:
                    raise ValueError("no pixels")
                row = (key, px.shape[0], px.shape[1], npy_tile(px, side), f"{difference_hash(px):016x}", None)
            except (ValueError, struct.error, IndexError) as e:
                row = (key, None, None, None, None, str(e)[:80])
            for k, v in zip(out, row):
                out[k].append(v)
        return out

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")), step, f"id {kind}, height int, width int, tile binary, dhash string, error string").withColumnRenamed("id", id_col)


def text_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text (null: empty), zero bytes appended up to a positive multiple of 64; and the unpadded length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: str = "pgm", side: int = 16, tiles: bool = True) -> DataFrame:
    """Stores each whole text as an 8-bit grey image 64 samples wide, decodes the stored bytes and computes features from what was read back.

    Returns id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and with `tiles` media and tile.
    feature is the difference hash (16 hex digits), '-', and the sha256's first 16 digits of the side x side NPY tile.
    Null and empty texts: 64 zero bytes. Repeated rows and ids stay, as do null ids; other columns are not read."""
    write = {"pgm": encode_pgm, "bmp": encode_bmp}[form]
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + (["media", "tile"] if tiles else [])

    def step(b: dict) -> dict:
        out: dict[str, list] = {k: [] for k in names}
        for key, text in zip(b["id"], b["text"]):
            payload, n = text_payload(text)
            media = write(np.frombuffer(payload, np.uint8).reshape(-1, 64))
            px = decode(media)
            back, tile = px.tobytes(), npy_tile(px, side)
            feature = f"{difference_hash(px):016x}-{hashlib.sha256(tile).hexdigest()[:16]}"
            for k, v in zip(names, (key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, media, tile)):
                out[k].append(v)
        return out

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary, tile binary" * tiles
    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), step, schema).withColumnRenamed("id", id_col)
