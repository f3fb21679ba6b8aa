from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest

from mediaframe.functions.shapes import clean, parse_moments
from mediaframe.functions.zones import zone_table
from mediaframe.operators.timestamps import normalise_timestamps
from mediaframe.operators.wide import cell_issues, widen
from mediaframe.plans import training

LABELS = [("Name", "text"), ("Size", "integer"), ("Taken", "moment")]
SCHEMA = "path string, key_label string, value_label string, issue string, entity int"


def long(spark, data):
    return spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA)


def test_wide_types_issues_and_dirt(spark, rows):
    data = [
        ("a", "size", "4,096 px"), ("a", " SI ZE ", "4096.0"), ("a", "Name", " x\0"), ("a", "Name", "x"), ("a", "Taken", "2019:02:03 04:05:06"),
        ("b", "Size", "12x3"), ("b", "Size", None), ("b", "Name", "p"), ("b", "Name", "P"), ("c", "Size", "7"), ("c", "Size", "8"),
        ("d", "Other", "1"), (None, "Size", "1"), ("e", "Size", "  "), ("f", "Size", "9" * 30), ("g", "Name", "é" * 5000),
    ]
    wide = widen(long(spark, data), LABELS)
    got = {r.path: r for r in wide.collect()}
    assert set(got) == {"a", "b", "c", "f", "g"}
    assert (got["a"].Size, got["a"].Name, got["a"].Taken) == (4096, "x", datetime(2019, 2, 3, 4, 5, 6))
    assert got["b"].Size is None and got["b"].Name is None and got["f"].Size is None
    want = [("b", "Name", "conflict"), ("b", "Size", "unreadable"), ("c", "Size", "conflict"), ("f", "Size", "unreadable")]
    assert rows(cell_issues(wide, LABELS)) == want


def test_wide_empty_and_partitions(spark, rows):
    assert rows(widen(long(spark, []).limit(0), LABELS)) == []
    data = [(f"p{i % 7}", "Size", str(i % 7)) for i in range(500)]
    a = rows(widen(long(spark, data).repartition(1), LABELS))
    assert a == rows(widen(long(spark, data).repartition(17), LABELS)) and len(a) == 7


def test_wide_integers_of_any_size(spark, rows):
    data = [
        ("a", "Size", "9223372036854775807"), ("b", "Size", "-9223372036854775808"), ("c", "Size", "9223372036854775808"), ("d", "Size", "9" * 30),
        ("e", "Size", "9" * 30), ("e", "Size", "x"), ("f", "Size", "9" * 30), ("f", "Size", "8" * 30), ("g", "Size", "-9223372036854775809"),
    ]
    wide = widen(long(spark, data), LABELS, oversize=True)
    got = {r.path: (r.Size, r.unreadable, r.conflict, r.oversize) for r in wide.collect()}
    assert got == {
        "a": (2**63 - 1, [], [], []), "b": (-(2**63), [], [], []), "c": (None, [], [], ["Size"]), "d": (None, [], [], ["Size"]),
        "e": (None, ["Size"], [], ["Size"]), "f": (None, [], ["Size"], []), "g": (None, [], [], ["Size"]),
    }
    assert rows(cell_issues(wide, LABELS)) == [("e", "Size", "unreadable"), ("f", "Size", "conflict")]


def test_registered_wide_table_has_every_label(spark):
    d = "/root/testdata/sf0.001"
    wide = training.p1_wide(spark, d)
    kinds = {r.key_label: r.value_type for r in spark.read.parquet(f"{d}/label_types.parquet").collect()}
    typed = {"integer": "bigint", "text": "string", "moment": "timestamp_ntz", "time part": "string"}
    assert dict(wide.dtypes) == {"path": "string", "unreadable": "array<string>", "conflict": "array<string>", "oversize": "array<string>"} | {x: typed[k] for x, k in kinds.items()}
    got = wide.collect()
    for name, kind in kinds.items():
        assert any(r[name] is not None for r in got), name
    named = {(r.path, x) for r in got for x in r.unreadable + r.conflict if kinds[x] in ("integer", "text")}
    assert named == {(r.path, r.key_label) for r in training.p1_found(spark, d).collect()}
    assert all(r[x] is None for r in got for x in r.conflict)


@pytest.mark.parametrize("text, want", [
    ("4 096", "4096"), ("[12]", "12"), ("(7,)", "7"), ("9'876'543", "9876543"), ("1-2", None), ("1.5", None), ("auto", None), ("ISO 400", "400"), ("007", "7"),
])
def test_whole_number(spark, text, want):
    from pyspark.sql import functions as F

    from mediaframe.functions.numbers import whole_number

    assert spark.createDataFrame([(text,)], "v string").select(whole_number(F.col("v"))).first()[0] == want


def times(spark, data, homes):
    m = []
    for path, device, values in data:
        labels = ["Exif DateTime original", "Exif Offset time original", "Exif Sub seconds time original", "GPS GPS DateStamp"]
        m += [(path, device, k, v) for k, v in zip(labels, values) if v != "-"]
    meta = spark.createDataFrame(m, "path string, device_id bigint, key_label string, value_label string")
    dev = spark.createDataFrame(homes, "device_id bigint, home_zone string")
    return {r.path: r.utc for r in normalise_timestamps(meta, dev).collect()}


def test_timestamps(spark):
    homes = [(1, "Europe/Berlin"), (2, None)]
    data = [
        ("a", 1, ("2019:07:01 12:00:00", "-", "-", "-")), ("b", 1, ("2019-07-01T12:00:00.1234567Z", "-", "9", "-")),
        ("c", 2, ("01.07.2019 12:00:00", "+0530", "25", "-")), ("d", 2, ("2019:07:01 12:00:00", "local", "-", "-")),
        ("e", 1, ("2019:10:27 02:30:00", "-", "-", "-")), ("f", 1, ("2019:03:31 02:30:00", "-", "-", "-")),
        ("g", 1, ("2019:02:30 02:30:00", "-", "-", "2019:07:01")), ("h", 1, ("no clock", "-", "-", "2019:07:01 10:00:00.5 UTC")),
        ("i", 2, ("1561975200", "-", "-", "-")), ("j", 2, ("1561975200123", "-", "5", "-")), ("k", 1, ("2019:07:01 12:00:00 PM", "UTC+2", "-", "-")),
        ("l", 2, ("Mon Jul 01 12:00:00 2019", "−03:00", "-", "-")), ("m", 1, ("2019/07/01 12:00", "+15:00", "-", "-")),
        ("n", 1, (None, "-", "-", "-")), ("o", 1, ("", "-", "-", "-")), ("p", 1, ("20190701T120000\0", "Z", "-", "-")),
    ]
    assert times(spark, data, homes) == {
        "a": "2019-07-01T10:00:00.000000Z", "b": "2019-07-01T12:00:00.123456Z", "c": "2019-07-01T06:30:00.250000Z", "d": "no zone",
        "e": "ambiguous", "f": "nonexistent", "g": "invalid", "h": "2019-07-01T10:00:00.500000Z", "i": "2019-07-01T10:00:00.000000Z",
        "j": "2019-07-01T10:00:00.123000Z", "k": "2019-07-01T10:00:00.000000Z", "l": "2019-07-01T15:00:00.000000Z",
        "m": "2019-07-01T10:00:00.000000Z", "o": "invalid", "p": "2019-07-01T12:00:00.000000Z",
    }
    assert times(spark, [], homes) == {}


@pytest.mark.parametrize("text, seconds", [
    ("2021:03:05 10:00:00 p.m.", 79200), ("2021:03:05 10:00:00 A.M.", 36000), ("Fri, Mar 5 10:00:00 P.M. GMT 2021", 79200),
    ("Fr., 5. März 2021 10:00", 36000), ("5 mars 2021 10:00:00", 36000), ("Freitag, Marz 5, 2021 10:00:00 p.m. UTC", 79200),
    ("Fri, Maz 5, 2021 10:00", None), ("Marble 5 2021 10:00", None), ("Sept. 5 2021", None), ("x.y.z.x.y.z.x.y 5 Mar 2021", None), ("2021:03:05 10:00:00 x.m.", None),
])
def test_moments_with_letters(text, seconds):
    got = parse_moments(clean(pd.Series([text, "unknown"])))
    day = int(datetime(2021, 3, 5, tzinfo=timezone.utc).timestamp())
    assert not got.valid[1] and (got.seconds[0] - day if got.valid[0] else None) == seconds


@pytest.mark.parametrize("name, month", [("juin", 6), ("juillet", 7), ("August", 8), ("août", 8), ("Dezember", 12), ("septiembre", 9), ("enero", 1), ("févr.", 2)])
def test_month_names(name, month):
    got = parse_moments(clean(pd.Series([f"5 {name} 2021 00:00"])))
    assert got.valid[0] and got.seconds[0] == datetime(2021, month, 5, tzinfo=timezone.utc).timestamp()


def test_zone_table_has_no_last_year():
    at = lambda y, m, d: int((datetime(y, m, d, 12, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000
    local = np.array([at(y, m, 1) for y in (1750, 1850, 2050, 2150, 2499, 2501, 2899, 2901, 9998) for m in (1, 7)])
    utc, count = zone_table("America/New_York").to_utc(local)
    east = [datetime(y, m, 1, 12, tzinfo=ZoneInfo("America/New_York")).utcoffset().total_seconds() for y in (1750, 1850, 2050, 2150, 2499, 2501, 2899, 2901, 9998) for m in (1, 7)]
    assert (count == 1).all() and ((local - utc) / 1e6).tolist() == east


def test_wide_one_entity_in_many_batches(spark):
    """An entity with a third of all rows, cut over batches, next to small ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        data = [("hot" if i % 3 == 0 else f"p{i % 40}", ("Size", "Name")[i % 2], str(i % 5) if i % 3 else str(i)) for i in range(900)]
        got = {r.path: r for r in widen(long(spark, data).repartition(3), LABELS).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 41
    for path, r in got.items():
        for name in ("Size", "Name"):
            cell = {v for p, k, v in data if p == path and k == name}
            assert (name in r.conflict) == (len(cell) > 1)
            assert r[name] == ((int(min(cell)) if name == "Size" else min(cell)) if len(cell) == 1 else None)


@pytest.mark.parametrize("zone", ["Europe/Berlin", "Australia/Lord_Howe", "Asia/Kathmandu", "America/New_York"])
def test_zone_table_agrees_with_zoneinfo(zone):
    rng = np.random.default_rng(0)
    utc = rng.integers(0, 1_800_000_000, 2000)
    info = ZoneInfo(zone)
    local = np.array([(u + datetime.fromtimestamp(int(u), timezone.utc).astimezone(info).utcoffset().total_seconds()) * 1e6 for u in utc]).astype(np.int64)
    found, count = zone_table(zone).to_utc(local)
    one = count == 1
    assert one.mean() > 0.99 and (found[one] == utc[one] * 1_000_000).all() and (count >= 1).all()
