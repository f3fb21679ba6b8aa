import json
import struct
import zlib

import pytest

from mediaframe.operators.hashing import image_values, quality_scores
from mediaframe.sources import readers, sinks
from mediaframe.sources.exif import TAGS, decode, entries, exif_rows, label_of
from mediaframe.streaming.rescan import hash_files, rescan


def png(path, shade=0):
    raw = b"".join(b"\0" + bytes((x * 7 + y * 3 + shade) % 256 for x in range(24) for _ in range(3)) for y in range(16))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", 24, 16, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def tiff():
    model = b"Canon EOS\0\0\0"
    ifd = struct.pack("<H", 2) + struct.pack("<HHII", 272, 2, 10, 50) + struct.pack("<HHIHH", 274, 3, 1, 6, 0) + struct.pack("<I", 0)
    head = b"II*\0" + struct.pack("<I", 8) + ifd
    return head + b"\0" * (50 - len(head)) + model


def test_scan_hash_and_scores(spark, tmp_path):
    png(tmp_path / "a.PNG")
    png(tmp_path / "b.png")
    (tmp_path / "c.txt").write_text("no image")
    files = readers.scan_files(spark, [str(tmp_path)], suffixes=(".png",))
    assert files.count() == 2
    images = readers.read_images(spark, [str(tmp_path)])
    for provider in ("image-hash", "phash"):
        got = image_values(images, provider).collect()
        assert len(got) == 2 and got[0].value == got[1].value and len(got[0].value) == 32 and got[0].error is None
    assert quality_scores(images, 1).count() == 1


def test_exif(spark, rows):
    assert [(i, t, decode(v)) for i, t, v in entries(tiff())] == [("0th", 272, "Canon EOS"), ("0th", 274, "6")]
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff()) + 8) + b"Exif\0\0" + tiff() + b"\xff\xda"
    files = spark.createDataFrame([("x", jpeg), ("y", b"bad"), ("z", None)], "path string, content binary")
    assert [r[2] for r in rows(exif_rows(files))] == ["0th Model", "0th Orientation"]


#: The EXIF labels that the reference lists.
LABELS = """0th: Artist, Bits per sample, Compression, Copyright, DateTime, ExifTag, GPSTag, Host computer, Image description, Image length, Image width,
Make, Model, Orientation, Photometric interpretation, Planar configuration, Processing software, Rating, RatingPercent, Resolution unit,
Samples per pixel, Software, Tile length, Tile width, YCbCr positioning; 1st: Compression, Image length, Image width, JPEGInterchangeFormat,
JPEGInterchangeFormatLength, Orientation, Resolution unit, YCbCr positioning; Exif: Body serial number, Color space, Contrast, Custom rendered,
DateTime digitized, DateTime original, Exposure mode, Exposure program, Flash, Focal length in 35mm film, Focal plane resolution unit,
Gain control, ISO speed ratings, Image unique ID, Interoperability tag, Lens make, Lense model, Light source, Metering mode, Offset time,
Offset time digitized, Offset time original, Pixel X dimension, Pixel Y dimension, Recommended exposure index, Saturation,
Scene capture type, Sensing method, Sensitivity type, Sharpness, Sub seconds time, Sub seconds time digitized, Sub seconds time original,
Subject area, Subject distance range, White balance; GPS: GPS DateStamp, GPS destination bearing reference, GPS geodetic datum,
GPS image direction reference, GPS latitude reference, GPS longitude reference, GPS satellites, GPS speed reference"""


def test_exif_labels_of_the_reference():
    made = {f"{ifd} {label_of(name)}" for ifd, names in TAGS.items() for name in names.values()}
    want = [f"{ifd} {x}" for part in LABELS.replace("\n", " ").split("; ") for ifd, xs in [part.split(": ")] for x in xs.split(", ")]
    assert len(want) == 77 and set(want) <= made


def directories(order):
    """0th with Exif and GPS, Exif with Interop, then 1st; every entry fits its four bytes, but for one rational."""
    short = lambda tag, v: struct.pack(order + "HHIHH", tag, 3, 1, v, 0)
    long = lambda tag, v: struct.pack(order + "HHII", tag, 4, 1, v)
    text = lambda tag, v: struct.pack(order + "HHI4s", tag, 2, len(v), v)
    ifd = lambda next_, *e: struct.pack(order + "H", len(e)) + b"".join(e) + struct.pack(order + "I", next_)
    first = ifd(200, long(34665, 60), long(34853, 130), short(60000, 7))
    exif = ifd(0, text(42036, b"abc"), text(37521, b"12\0"), struct.pack(order + "HHII", 33434, 5, 1, 240), struct.pack(order + "HHIHH", 37396, 3, 2, 5, 6), long(40965, 160))
    blocks = {8: first, 60: exif, 130: ifd(0, text(1, b"N\0")), 160: ifd(0, text(1, b"R98")), 200: ifd(0, short(259, 6)), 240: struct.pack(order + "II", 1, 50)}
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8).ljust(256, b"\0"))
    for at, b in blocks.items():
        out[at : at + len(b)] = b
    return bytes(out)


def test_exif_keeps_every_entry(spark, rows):
    chunk = lambda k, d: k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2)
    webp = b"WEBP" + chunk(b"VP8X", b"123") + chunk(b"EXIF", directories("<"))
    files = spark.createDataFrame([("a", directories("<")), ("b", directories(">")), ("c", chunk(b"RIFF", webp))], "path string, content binary")
    got = rows(exif_rows(files).select("path", "key_label", "value_label"))
    want = {
        "0th ExifTag": "60", "0th GPSTag": "130", "0th 60000": "7", "Exif Lense model": "abc", "Exif Sub seconds time original": "12",
        "Exif Exposure time": "1/50", "Exif Subject area": "5, 6", "Exif Interoperability tag": "160", "GPS GPS latitude reference": "N",
        "Interop Interoperability index": "R98", "1st Compression": "6",
    }
    assert got == sorted(((p, *x) for p in "abc" for x in want.items()), key=repr)


def test_rescan_adds_only_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.bin").write_bytes(bytes([i]))
        rescan(spark, str(tmp_path / "in"), str(tmp_path / "cache"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 3


def test_rescan_works_on_new_files_only(spark, tmp_path):
    worked = []

    def work(files):
        worked.append(sorted(r.path[-5:] for r in files.collect()))
        return hash_files(files)

    (tmp_path / "in").mkdir()
    for i, name in enumerate("ab"):
        (tmp_path / "in" / f"{name}.bin").write_bytes(bytes([i]))
        rescan(spark, str(tmp_path / "in"), str(tmp_path / "cache"), str(tmp_path / f"ck{i}"), work).awaitTermination()  # reads all again
    assert worked == [["a.bin"], ["b.bin"]] and spark.read.parquet(str(tmp_path / "cache")).count() == 2
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?s)."):
        rescan(spark, str(tmp_path / "in"), str(tmp_path / "broken"), str(tmp_path / "ck9")).awaitTermination()


def test_json_both_layouts(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "/a", None), (2, "/b", "m")], "group bigint, path string, maker string")
    sinks.write_table(df, str(tmp_path / "g.json"))
    assert rows(readers.read_table(spark, str(tmp_path / "g.json")).select("group", "path", "maker")) == [(1, "/a", None), (2, "/b", "m")]
    for i, indent in enumerate((None, 2)):
        (tmp_path / f"t{i}.json").write_text(json.dumps({"schema": {"fields": []}, "data": [{"x": 1, "y": "b"}, {"x": 2, "y": None}]}, indent=indent))
        assert rows(readers.read_table(spark, str(tmp_path / f"t{i}.json"))) == [(1, "b"), (2, None)]
    lines = spark.createDataFrame([([1, 2],)], "data array<int>")
    sinks.write_table(lines, str(tmp_path / "l.json"))
    assert rows(readers.read_table(spark, str(tmp_path / "l.json"))) == [([1, 2],)]


def test_csv_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "/a", ""), (2, "/b", "m")], "group bigint, path string, maker string")
    sinks.write_table(df, str(tmp_path / "g.csv"))
    assert rows(readers.read_groups_csv(spark, str(tmp_path / "g.csv"), df.schema)) == [(1, "/a", ""), (2, "/b", "m")]
