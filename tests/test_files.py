import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.functions import scalars, text
from mediaframe.operators import features, geo, groups, hashing, rename, simjoin, stats
from mediaframe.sources import image_meta, readers, sinks

IPTC = b"\x1c\x02\x05\x00\x03sea"


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(icc=b"", exif=b"", iptc=b""):
    out = b"\xff\xd8"
    if exif:
        out += segment(0xE1, b"Exif\0\0" + exif)
    half = len(icc) // 2
    for i, part in enumerate((icc[:half], icc[half:])):  # the second part first
        if icc:
            out = out[:2] + segment(0xE2, b"ICC_PROFILE\0" + bytes([i + 1, 2]) + part) + out[2:]
    if iptc:
        body = b"8BIM" + struct.pack(">H", 0x0404) + b"\0\0" + struct.pack(">I", len(iptc)) + iptc + b"\0" * (len(iptc) % 2)
        out += segment(0xED, b"Photoshop 3.0\0" + body)
    return out + segment(0xC0, b"\x08" + struct.pack(">HH", 33, 44) + b"\x03") + b"\xff\xda\0\0"


def tiff():
    entry = lambda tag, kind, n, v: struct.pack("<HHII", tag, kind, n, v)
    body = struct.pack("<H", 3) + entry(256, 3, 1, 7) + entry(257, 4, 1, 9) + entry(34675, 7, 6, 50) + struct.pack("<I", 0)
    return (b"II*\0" + struct.pack("<I", 8) + body).ljust(50, b"\0") + b"colour"


def test_headers_of_every_kind(spark):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"iCCP", b"x\0\0" + zlib.compress(b"prof")) + chunk(b"eXIf", b"MM")
    riff = lambda *c: b"RIFF" + struct.pack("<I", 4 + sum(8 + len(d) for _, d in c)) + b"WEBP" + b"".join(k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for k, d in c)
    files = {
        "jpeg": (jpeg(b"profile!", tiff(), IPTC), (44, 33, b"Exif\0\0" + tiff(), b"profile!", IPTC)), "bare": (jpeg(), (44, 33, None, None, None)),
        "png": (png, (5, 6, b"Exif\0\0MM", b"prof", None)), "gif": (b"GIF89a" + struct.pack("<HH", 3, 4), (3, 4, None, None, None)),
        "bmp": (b"BM".ljust(18, b"\0") + struct.pack("<ii", 8, -2), (8, 2, None, None, None)),
        "webp": (riff((b"VP8X", b"\0" * 4 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")), (b"EXIF", b"II*")), (100, 50, b"Exif\0\0II*", None, None)),
        "lossless": (riff((b"VP8L", b"\x2f" + (10 | 20 << 14).to_bytes(4, "little"))), (11, 21, None, None, None)),
        "tiff": (tiff(), (7, 9, b"Exif\0\0" + tiff(), b"colour", None)),
    }
    rows = [(k, v[0]) for k, v in files.items()] + [("text", b"hello"), ("none", None), ("cut", b"\xff\xd8\xff")]
    got = {r.path: r for r in image_meta.image_meta(spark.createDataFrame(rows, "path string, content binary")).collect()}
    for k, (_, want) in files.items():
        r = got[k]
        assert (r.width, r.height, *[None if x is None else bytes(x) for x in (r.exif, r.icc_profile, r.iptc)]) == want and r.error is None, k
    assert all(got[k].error and got[k].width is None for k in ("text", "none", "cut"))


def images(spark, n=40, side=16):
    """Grey pictures that are brighter at the top."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        x = (np.linspace(200, 20, side)[:, None] + rng.normal(size=(side, side)) * 12).clip(0, 255).astype(np.uint8)
        rows.append((f"p{i}", side, side, 1, x.tobytes()))
    return spark.createDataFrame(rows, "origin string, height int, width int, nChannels int, data binary")


def test_rotation_model(spark):
    _, right, entropy = features.rotation_model(images(spark), 8)
    assert right > 0.95 and 0 <= entropy < 0.3


def test_embeddings_and_features(spark):
    colour = np.zeros((4, 6, 3), np.uint8)
    colour[:, :, 2] = 255  # red, in BGR order
    df = spark.createDataFrame([("c", 4, 6, 3, colour.tobytes()), ("g", 2, 2, 1, b"\0\0\0\0")], "origin string, height int, width int, nChannels int, data binary")
    got = features.embeddings(df, lambda x: x.reshape(len(x), -1, 3).mean(1), side=8, batch=1).collect()
    assert [(r.origin, [round(v, 6) for v in r.vector]) for r in got] == [("c", [1.0, 0.0, 0.0])]

    def find(x):
        if x.shape[2] == 1:
            raise ValueError("grey")
        return [((0, 2, 2, 0), np.ones(2)), ((1, 3, 3, 1), np.zeros(2))]

    rows = features.features(df, find).collect()
    assert [(r.origin, r.no, r.error) for r in rows] == [("c", 0, None), ("c", 1, None), ("g", None, "ValueError: grey")]
    scores = features.model_scores(df, {"mean": lambda x: x.mean(), "bad": lambda x: 1 / 0}, ["mean", "bad", "absent"]).collect()
    assert [(r.mean, r.bad, r.absent) for r in scores] == [(85.0, None, None), (0.0, None, None)]


def test_edits(spark, tmp_path):
    df = images(spark, 2, 12)
    out = features.edited(df, lambda x: features.rotate(features.thumbnail(x, 6), 1), ["equalise", "autocontrast"])
    assert sinks.write_files(out.select(F.concat("origin", F.lit(".png")).alias("name"), "content"), str(tmp_path / "out")).count() == 2
    got = readers.read_images(spark, [str(tmp_path / "out")]).collect()
    assert [(r.height, r.width) for r in got] == [(6, 6)] * 2
    x = np.frombuffer(got[0].data, np.uint8).reshape(6, 6, -1)[:, :, 0]
    assert x.min() == 0 and x.max() == 255 and x[:, 0].mean() < x[:, -1].mean()  # the bright top is on the right
    assert features.grey(np.full((2, 2, 3), 9, np.uint8)).tolist() == [[[9], [9]], [[9], [9]]]
    with pytest.raises(Exception, match="no name of a file"):
        sinks.write_files(spark.createDataFrame([("a/b", b"x")], "name string, content binary"), str(tmp_path / "x")).collect()


def test_paths_that_are_asked_for(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("img10.jpg", "img9.jpg", "note.xyz", "sub/deep.png"):
        (tmp_path / name).write_bytes(b"x")
    names = lambda d: [r.path.rsplit("/", 1)[1] for r in d.collect()]
    assert readers.resolve_paths(spark, []) == (None, None)
    files, first = readers.resolve_paths(spark, [str(tmp_path / "img9.jpg")])
    assert names(files) == ["img9.jpg", "img10.jpg"] and first.endswith("img9.jpg")
    assert names(readers.resolve_paths(spark, [str(tmp_path / "note.xyz")])[0]) == ["note.xyz"]
    assert names(readers.resolve_paths(spark, [str(tmp_path)])[0]) == ["img9.jpg", "img10.jpg"]
    many = readers.resolve_paths(spark, [str(tmp_path / "sub"), str(tmp_path / "note.xyz"), str(tmp_path / "gone")])[0]
    assert sorted(names(many)) == ["deep.png", "note.xyz"]
    with pytest.raises(ValueError):
        readers.resolve_paths(spark, [str(tmp_path / "gone")])


def test_settings_and_memo(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"chunk-size": 5}))
    assert readers.config_defaults(str(tmp_path / "c.json"), {"chunk_size": 2000, "out": None}) == {"chunk_size": 5, "out": None}
    (tmp_path / "c.json").write_text(json.dumps({"other": 5}))
    with pytest.raises(ValueError):
        readers.config_defaults(str(tmp_path / "c.json"), {"chunk_size": 2000})
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    for rebuild, n in ((False, 1), (False, 1), (True, 2)):
        assert readers.memoised(spark, str(tmp_path / "memo"), "k", make, rebuild).count() == n
    m = readers.random_matrix(spark, 50, 3, 1, "byte")
    assert m.collect() == readers.random_matrix(spark, 50, 3, 1, "byte").collect() and {v for r in m.collect() for v in r.v} <= set(range(256))


def test_store_survives_an_end_between_the_steps(spark, tmp_path, rows):
    path = str(tmp_path / "store")
    sinks.write_store(spark.range(3), path)
    spark.range(5).write.parquet(path + ".new")
    assert sinks.read_store(spark, path).count() == 3
    import shutil

    shutil.rmtree(path)
    assert sinks.read_store(spark, path).count() == 5
    sinks.write_store(spark.range(7), path)
    assert sinks.read_store(spark, path).count() == 7


def test_print_table(spark, capsys):
    sinks.print_table(spark.createDataFrame([(1, None)], "a int, b string"))
    assert capsys.readouterr().out == "a\tb\n1\t\n"


def test_report_has_its_columns(spark, rows):
    g = spark.createDataFrame([(1, "/a"), (1, "/b")], "group int, path string")
    meta = spark.createDataFrame([("/a", 5), ("/a", 7), (None, 1)], "path string, filesize bigint")
    got = sinks.duplicate_report(g, meta)
    assert got.columns == ["group", "path", *sinks.REPORT] and {(r.path, r.filesize) for r in got.collect()} == {("/a", 7), ("/b", None)}


def test_links_and_lookups(spark, rows):
    f = spark.createDataFrame([(1, 7, "/a", 0), (1, 7, "/b", 1), (1, 8, "/c", 2), (None, 7, "/d", 3), (None, 7, "/e", 4)], "dev int, ino int, path string, pos int")
    got = {r.path: (r.first_path, r.n_links) for r in groups.hard_links(f, "dev", "ino", "path", "pos").collect()}
    assert got == {"/a": ("/a", 2), "/b": ("/a", 2), "/c": ("/c", 1), "/d": ("/d", 1), "/e": ("/e", 1)}
    with pytest.raises(Exception, match="rows that match in a group: 2"):
        groups.lookup_one(f.filter("dev = 1"), "dev", F.col("ino") == 7, "path").collect()
    assert rows(groups.lookup_one(f.filter("dev = 1"), "dev", F.col("ino") == 8, "path")) == [(1, "/c")]


def test_pending_outputs(spark, rows):
    f = spark.createDataFrame([("/x/a.jpg",), ("/x/b.jpg",), ("/x/b.pp.jpg",)], "path string")
    assert rows(rename.pending_outputs(f, "path")) == [("/x/a.jpg", "/x/a.pp.jpg")]


def test_exif_values(spark):
    df = spark.createDataFrame([("1/2, 3/4", "abc\0", "é", "1/0")], "t string, a string, u string, z string")
    r = df.select(
        scalars.exif_value(F.col("t"), "tuple-of-rational").alias("t"), scalars.exif_value(F.col("a"), "ascii").alias("a"),
        scalars.exif_value(F.col("u"), "ascii").alias("b"), scalars.exif_value(F.col("z"), "rational").alias("z"), text.hex_bytes(F.lit("0g")).alias("h"),
    ).first()
    assert [tuple(x) for x in r.t] == [(1, 2), (3, 4)] and r.a == "abc" and r.b is None and r.z is None and r.h is None
    with pytest.raises(ValueError):
        scalars.exif_value(F.col("t"), "date")


def test_geodesic(spark):
    """The published example of the inverse formula: Flinders Peak to Buninyong."""
    df = spark.createDataFrame([(-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777)], "a double, b double, c double, d double")
    assert abs(df.select(scalars.geodesic_km("a", "b", "c", "d")).first()[0] - 54.972271) < 1e-5


@pytest.mark.parametrize("size", [64 << 20, 200])
def test_nearest_place(spark, size):
    rng = np.random.default_rng(2)
    at = lambda n: [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-89, 89, n), rng.uniform(-180, 180, n)))]
    p, q = at(50) + [(99, None, 1.0)], at(20) + [(98, 1.0, None)]
    schema = "k bigint, lat double, lon double"
    got = {r.k: r.place for r in geo.nearest_place(spark.createDataFrame(p, schema), spark.createDataFrame(q, schema).withColumnRenamed("k", "place"), "k", "place", block_bytes=size).collect()}
    unit = lambda rows: geo._unit(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    assert got == dict(enumerate((unit(p[:50]) @ unit(q[:20]).T).argmax(1).tolist()))


def test_sets_and_unions(spark, rows):
    e = spark.createDataFrame([("k", "l", "1"), ("k", "l", "1"), ("k", "m", "2"), ("h", "l", "1")], "key string, label string, value string")
    assert [(r.key, [tuple(v) for v in r["values"]]) for r in readers.unhandled_keys(e, ["h"]).collect()] == [("k", [("l", "1"), ("m", "2")])]
    assert rows(stats.union_all([], e)) == [] and stats.union_all([e, e], e).count() == 8
    assert stats.other_columns(["a", "b"], ["b", "c"]) == ["a"]
    with pytest.raises(ValueError):
        simjoin.shared_array(spark, np.zeros(100), 10)
    assert simjoin.shared_array(spark, np.zeros(100)).value.shape == (100,)


def test_flat_index(spark, tmp_path, rows):
    index = simjoin.FlatIndex(spark, str(tmp_path / "flat"), "hamming")
    index.add(spark.createDataFrame([(1, [0]), (2, [7])], "id bigint, w array<bigint>"), "id", "w")
    index.add(spark.createDataFrame([(3, [1]), (4, None)], "id bigint, w array<bigint>"), "id", "w")
    assert rows(index.search(spark.createDataFrame([(9, [0])], "id bigint, w array<bigint>"), "id", "w", 2)) == [(9, 1, 1, 0), (9, 2, 3, 1)]
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame([(5, [0, 1])], "id bigint, w array<bigint>"), "id", "w")
    with pytest.raises(TypeError):
        index.add(spark.createDataFrame([(5, [0.5])], "id bigint, w array<double>"), "id", "w")
    with pytest.raises(ValueError):
        simjoin.FlatIndex(spark, "x", "cosine")
    assert index.table().count() == 3


def test_own_provider_and_bad_pictures(spark):
    hashing.register_provider("mean", lambda x: float(x.mean()), "double")
    df = images(spark, 2, 4).union(spark.createDataFrame([("bad", 4, 4, 1, b"short")], "origin string, height int, width int, nChannels int, data binary"))
    good, bad = hashing.quarantine(hashing.image_values(df, "mean"))
    assert good.count() == 2 and [(r.origin, r.value) for r in bad.collect()] == [("bad", None)]
    with pytest.raises(ValueError):
        stats.equals_text(df, "absent", "x")
