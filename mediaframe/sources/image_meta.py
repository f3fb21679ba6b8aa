"""Size and embedded blocks of image files, read from their headers by the public file layouts."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from mediaframe.sources.exif import entries

SCHEMA = "path string, width int, height int, exif binary, icc_profile binary, iptc binary, photoshop binary, error string"
_FIELDS = ("width", "height", "exif", "icc_profile", "iptc", "photoshop")


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, payload) of the segments before the picture data."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # padding
            at += 1
            continue
        if marker == 0xDA:
            return
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def photoshop_resources(block: bytes) -> dict[int, bytes]:
    """Image resources of a Photoshop block by their number."""
    out, at = {}, 0
    while at + 12 <= len(block) and block[at : at + 4] == b"8BIM":
        number = int.from_bytes(block[at + 4 : at + 6], "big")
        name = 1 + block[at + 6]
        at += 6 + name + name % 2
        size = int.from_bytes(block[at : at + 4], "big")
        out[number] = block[at + 4 : at + 4 + size]
        at += 4 + size + size % 2
    return out


def _jpeg(data: bytes) -> dict:
    out, icc = {}, {}
    for marker, body in jpeg_segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            out["height"], out["width"] = struct.unpack(">HH", body[1:5])
        elif marker == 0xE1 and body.startswith(b"Exif\0\0"):
            out.setdefault("exif", body)
        elif marker == 0xE2 and body.startswith(b"ICC_PROFILE\0"):
            icc[body[12]] = body[14:]
        elif marker == 0xED and body.startswith(b"Photoshop 3.0\0"):
            out["photoshop"] = out.get("photoshop", b"") + body[14:]
    if icc:
        out["icc_profile"] = b"".join(icc[i] for i in sorted(icc))
    if "photoshop" in out:
        out["iptc"] = photoshop_resources(out["photoshop"]).get(0x0404)
    return out


def _png(data: bytes) -> dict:
    out, at = {}, 8
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            out["width"], out["height"] = struct.unpack(">II", body[:8])
        elif kind == b"eXIf":
            out["exif"] = b"Exif\0\0" + body
        elif kind == b"iCCP":
            out["icc_profile"] = zlib.decompress(body[body.index(b"\0") + 2 :])
        elif kind == b"IDAT" and "exif" in out:
            break
        at += 12 + size
    return out


def _webp(data: bytes) -> dict:
    out, at = {}, 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if kind == b"VP8X":
            out["width"], out["height"] = (1 + int.from_bytes(body[i : i + 3], "little") for i in (4, 7))
        elif kind == b"VP8 ":
            w, h = struct.unpack("<HH", body[6:10])
            out.setdefault("width", w & 0x3FFF), out.setdefault("height", h & 0x3FFF)
        elif kind == b"VP8L":
            bits = int.from_bytes(body[1:5], "little")
            out.setdefault("width", 1 + (bits & 0x3FFF)), out.setdefault("height", 1 + (bits >> 14 & 0x3FFF))
        elif kind == b"EXIF":
            out["exif"] = b"Exif\0\0" + body.removeprefix(b"Exif\0\0")
        elif kind == b"ICCP":
            out["icc_profile"] = body
        at += 8 + size + size % 2
    return out


def _tiff(data: bytes) -> dict:
    out = {}
    for ifd, tag, value in entries(data):
        if ifd == "0th" and tag in (256, 257):
            out[{256: "width", 257: "height"}[tag]] = int(value[0] if isinstance(value, (list, tuple)) else value)
        elif ifd == "0th" and tag in (34675, 33723, 34377):
            block = value if isinstance(value, bytes) else bytes(value) if isinstance(value, (list, tuple)) and all(isinstance(x, int) and x < 256 for x in value) else None
            out[{34675: "icc_profile", 33723: "iptc", 34377: "photoshop"}[tag]] = block
    out["exif"] = b"Exif\0\0" + data if out else None
    return out


def header(data: bytes) -> dict:
    """width, height, exif, icc_profile, iptc and photoshop of a file, as far as it has them; an unknown kind is an error."""
    if data[:2] == b"\xff\xd8":
        out = _jpeg(data)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        out = _png(data)
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        out = _webp(data)
    elif data[:6] in (b"GIF87a", b"GIF89a"):
        out = dict(zip(("width", "height"), struct.unpack("<HH", data[6:10])))
    elif data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        out = {"width": w, "height": abs(h)}
    elif data[:4] in (b"II*\0", b"MM\0*"):
        out = _tiff(data)
    else:
        raise ValueError("unknown kind of image")
    if "width" not in out or "height" not in out:
        raise ValueError("no size in the header")
    return out


def image_meta(files: DataFrame) -> DataFrame:
    """(path, width, height, exif, icc_profile, iptc, photoshop, error) of (path, content).

    Width and height are always there or the row has an error instead; the other blocks are null where a file has none.
    Null contents are an error, too, so that every file has one row.  HEIF, AVIF and vendor RAW files are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content):
                try:
                    got = header(bytes(content) if content is not None else b"")
                    rows.append((path, *[got.get(f) for f in _FIELDS], None))
                except Exception as e:  # one bad file must not stop the others
                    rows.append((path, *[None] * len(_FIELDS), f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["path", *_FIELDS, "error"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)
