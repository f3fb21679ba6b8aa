from datetime import datetime
from fractions import Fraction
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.functions import dates, paths, scalars, text, vectors
from mediaframe.operators import graph, groups, ordering, priority, simjoin, stats
from mediaframe.plans import library

SQUARE = [(0, [0.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0])]


@pytest.mark.parametrize("squared", [False, True])
@pytest.mark.parametrize("t, n", [(2.1, 6), (1.1, 4)])
def test_unit_square(spark, rows, squared, t, n):
    df = spark.createDataFrame(SQUARE, "id bigint, v array<double>")
    got = [r[:2] for r in rows(simjoin.l2_pairs(df, "id", "v", t, squared, block_rows=1))]
    assert got == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)][:6] if n == 6 else got == [(0, 1), (0, 2), (1, 3), (2, 3)]


@pytest.mark.parametrize("t, n", [(2, 6), (1, 4)])
def test_hamming_bits(spark, rows, t, n):
    df = spark.createDataFrame([(i, [w]) for i, w in enumerate((0, 2, 1, 3))], "id bigint, w array<bigint>")
    assert len(rows(simjoin.hamming_pairs(df, "id", "w", 8, t))) == n


def test_hamming_against_brute_force(spark, rows):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**62, (40, 2))
    words = [[int(a) ^ (1 << int(rng.integers(60))) if k else int(a), int(b)] for a, b in base for k in range(3)]
    got = {r[:2]: r[2] for r in rows(simjoin.hamming_pairs(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id bigint, w array<bigint>"), "id", "w", 128, 3))}
    first = {}
    for i, w in enumerate(words):
        first.setdefault(tuple(w), i)
    want = {}
    for a, i in first.items():
        for b, j in first.items():
            d = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b))
            if i < j and d <= 3:
                want[i, j] = d
    assert got == want


def test_thresholds_are_typed():
    for metric, t, error in (("hamming", 1.0, TypeError), ("l2", 1, TypeError), ("cosine", 1.0, ValueError)):
        with pytest.raises(error):
            simjoin.check_threshold(metric, t)


def test_l2_blocks_and_empty(spark, rows):
    rng = np.random.default_rng(0)
    x = rng.random((120, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, []), (998, None)], "id bigint, v array<double>")
    want = [(i, j) for i in range(120) for j in range(i + 1, 120) if ((x[i] - x[j]) ** 2).sum() <= 0.5]
    for size in (7, 50, 1000):
        assert {r[:2] for r in rows(simjoin.l2_pairs(df, "id", "v", 0.5, True, size))} == set(want)
    assert rows(simjoin.l2_pairs(df.limit(0), "id", "v", 0.5, True)) == []


def brute_pairs(x, t):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= t)) if i < j}


@pytest.mark.parametrize("spread, t", [(0.02, 0.3), (0.4, 0.3), (5.0, 20.0), (0.02, 0.0)])
@pytest.mark.parametrize("block_rows", [15, 60])
def test_l2_pairs_in_cells(spark, spread, t, block_rows):
    """Clustered and unclustered vectors, one cluster with a third of all rows, many pivots."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 4))
    x = centres[np.where(np.arange(240) % 3 == 0, 0, rng.integers(0, 12, 240))] + rng.normal(size=(240, 4)) * spread
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    got = [r[:2] for r in simjoin.l2_pairs(df, "id", "v", t, True, block_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(x, t)


def test_l2_classes_and_links(spark, rows):
    x = [[0.0, 0.0]] * 40 + [[0.0, 0.5]] * 3 + [[9.0, 9.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(99, None)], "id bigint, v array<double>")
    pairs, classes = simjoin.l2_pairs(df, "id", "v", 1.0), simjoin.vector_classes(df, "id", "v")
    assert rows(pairs) == [(0, 40, 0.5)] and dict((r[1], r[0]) for r in rows(classes))[42] == 40
    links = dict(rows(simjoin.link_counts(df, pairs, "id", classes)))
    assert links[0] == 39 + 3 and links[41] == 2 + 40 and links[43] == 0 and links[99] == 0


@pytest.mark.parametrize("block_rows", [5, 1000])
def test_label_match_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=(45, 3))
    labels = [f"l{i % 7}" if i % 9 else None for i in range(45)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(60, None)], "id bigint, v array<double>")
    store = spark.createDataFrame([(v.tolist(), name) for v, name in zip(y, labels)], "v array<double>, label string")
    want = {60: ([], [])}
    for i, v in enumerate(x):
        d = ((y - v) ** 2).sum(1)
        near = lambda lo, hi: sorted({n for n, e in zip(labels, d) if n and lo < e <= hi})
        want[i] = (near(-1, 0.5), near(0.5, 1.5))
    got = {r.id: (r.sure, r.suggested) for r in simjoin.label_match(df, store, "id", "v", "label", 0.5, 1.5, block_rows).collect()}
    assert got == want
    assert {r.sure == [] for r in simjoin.label_match(df, store.limit(0), "id", "v", "label", 0.5, 1.5).collect()} == {True}


def test_label_store_grows(spark, tmp_path):
    face = lambda *r: spark.createDataFrame(list(r), "id bigint, v array<double>, name string")
    store = simjoin.LabelStore(spark, str(tmp_path / "store"), "id", "v", "name")
    ask = lambda: [(r.id, r.sure) for r in store.match(face((9, [0.1, 0.0], None)), 0.5, 1.0).collect()]
    assert ask() == [(9, [])]
    for _ in range(2):  # the same batch twice
        store.confirm(face((1, [0.0, 0.0], "ann"), (2, [5.0, 5.0], "bob"), (3, [0.0, 0.1], None)))
    assert ask() == [(9, ["ann"])] and store.table().count() == 2


def test_nearest_hamming(spark):
    rng = np.random.default_rng(8)
    w = rng.integers(0, 6, (150, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)] + [(900, None)], "id bigint, w array<bigint>").repartition(5)
    d = np.bitwise_count(w[:, None, :] ^ w[None, :, :]).sum(2)
    for include, size in product((False, True), (64 << 20, 1000)):
        got = simjoin.nearest_hamming(df, df.filter("id % 10 = 0"), "id", "w", 4, include, size).collect()
        want = {(i, r + 1, int(j)) for i in range(0, 150, 10) for r, j in enumerate([j for j in np.lexsort((np.arange(150), d[i])) if include or j != i][:4])}
        assert {(r.query, r["rank"], r.neighbour) for r in got} == want


def test_approximate_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = np.repeat(centres, 10, 0) + rng.normal(size=(300, 16)) * 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    ask = df.filter("id % 50 = 0")
    exact = {(r.query, r.neighbour) for r in simjoin.nearest(df, ask, "id", "v", 5).collect()}
    near = {(r.query, r.neighbour) for r in simjoin.approximate_nearest(df, ask, "id", "v", 5, width=2.0).collect()}
    assert len(exact) == 30 and len(exact & near) / len(exact) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    exact = {(r.query, r.neighbour) for r in library.knn_top5(spark, d).collect()}
    got = library.knn_approximate(spark, d).collect()
    assert len(got) == len(exact) and len(exact & {(r.query, r.neighbour) for r in got}) / len(exact) >= 0.9


def test_indexed_nearest_is_whole(spark, rows):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(400, 8)), rng.normal(size=(3, 8)) * 0.01 + 50])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, []), (998, None)], "id bigint, v array<double>")
    ask = df.filter("id % 50 = 0 or id > 400")
    few = simjoin.indexed_nearest(df, ask, "id", "v", 5, recall=0.0)
    assert {(r.query, r["count"]) for r in few.groupBy("query").count().collect()} == {(i, 5) for i in [*range(0, 401, 50), 401, 402]}
    assert rows(simjoin.indexed_nearest(df, ask, "id", "v", 5, recall=1.0)) == rows(simjoin.nearest(df, ask, "id", "v", 5))
    assert rows(simjoin.indexed_nearest(df.limit(0), ask, "id", "v", 5)) == []


def test_components(spark, rows):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 5), (7, 7), (None, 1)], "a bigint, b bigint")
    assert rows(graph.connected_components(e)) == [(1, 1), (1, 2), (1, 3), (4, 4), (4, 5), (7, 7)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    assert {r[0] for r in rows(graph.connected_components(chain))} == {0}
    assert rows(graph.connected_components(e.limit(0))) == []


@pytest.mark.parametrize("most", [0, 30, 1000])
def test_neighbours_of_bounded_and_hot_groups(spark, most):
    rng = np.random.default_rng(0)
    data = [(None if i % 7 == 0 else i % 3 if i % 2 else 0, int(v), i) for i, v in enumerate(rng.integers(0, 40, 150))]
    df = spark.createDataFrame(data, "g int, v int, id int")
    got = ordering.with_neighbours(df, ["g"], "id", [F.col("v"), F.col("id")], "r", True, most).collect()
    assert len(got) == 150
    for g in {d[0] for d in data}:
        ids = [d[2] for d in sorted((d for d in data if d[0] == g), key=lambda d: d[1:])]
        for r in got:
            if r.g == g:
                i = ids.index(r.id)
                assert (r.r, r.next_id, r.prev_id) == (i, ids[i + 1] if i + 1 < len(ids) else None, ids[i - 1] if i else None)
                assert (r.first_id, r.last_id) == (ids[0], ids[-1])
    ranked = ordering.rank_within(df, ["g"], [F.col("v"), F.col("id")], "r", most)
    assert {(r.id, r.r) for r in ranked.collect()} == {(r.id, r.r) for r in got}


def test_ranks_span_partitions(spark):
    df = spark.createDataFrame([(i % 3 if i % 2 else None, i) for i in range(200)], "g int, v int")
    got = ordering.rank_within(df, ["g"], [F.col("v").desc()], "r").collect()
    for g in (None, 0, 1, 2):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.r)
        assert [r.r for r in mine] == list(range(len(mine))) and [r.v for r in mine] == sorted((r.v for r in mine), reverse=True)
    sums = ordering.running_sum(df.select("v"), "v", [F.col("v")], "b").collect()
    assert {r.v: r.b for r in sums} == {v: v * (v - 1) // 2 for v in range(200)}


def test_sort_groups_by_first_row(spark):
    for data, up, want in (
        ([(1, 2), (1, 1), (2, 4), (2, 3)], True, [1, 2]), ([(1, 2), (1, 1), (2, 4), (2, 3)], False, [2, 1]),
        ([(1, 1), (2, 1), (3, 2), (4, 1)], True, [1, 2, 4, 3]), ([(1, 1), (2, 1), (3, 2), (4, 1)], False, [3, 1, 2, 4]),
    ):
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "g bigint, v bigint, pos bigint")
        got = groups.sort_groups_by_first(df, "g", "v", "pos", up).collect()
        assert list(dict.fromkeys(r.g for r in sorted(got, key=lambda r: (r.group_rank, r.row_rank)))) == want


def test_sort_within(spark):
    data = [(1, 1, 1), (1, 1, 2), (1, 2, 3), (2, 2, 4)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "g bigint, c1 bigint, c2 bigint, pos bigint")
    for keys, want in (
        ([], data), ([("c1", False)], [(1, 2, 3), (1, 1, 1), (1, 1, 2), (2, 2, 4)]),
        ([("c1", True), ("c2", False)], [(1, 1, 2), (1, 1, 1), (1, 2, 3), (2, 2, 4)]),
    ):
        got = sorted(groups.sort_within_groups(df, "g", keys, "pos").collect(), key=lambda r: (r.group_rank, r.row_rank))
        assert [(r.g, r.c1, r.c2) for r in got] == want


def test_priority_errors(spark):
    df = spark.createDataFrame([(1, "a")], "g int, name string")
    for c in ({"column": "x", "function": "Length"}, {"column": "name", "function": "Value"}, {"column": "name", "function": "Match regex", "args": ["("]}):
        with pytest.raises(ValueError):
            priority.compile_commands(df, [c])
    assert "Length" in priority.available()["StringType"]


@pytest.mark.parametrize("date, sub, off, local, east, bad", [
    ("2014:08:09 16:05:31", None, None, datetime(2014, 8, 9, 16, 5, 31), None, False), ("2014-08-09 16:05:31\0", "0625", None, datetime(2014, 8, 9, 16, 5, 31, 62500), None, False),
    ("2014:08:09 16:05:31", "7\0", "-0330", datetime(2014, 8, 9, 16, 5, 31, 700000), -12600, False), (" ", None, None, None, None, False),
    ("2015:02:29 01:00:00", None, None, None, None, True), ("0000:00:00 00:00:00", None, None, None, None, True), ("noon", None, None, None, None, True),
])
def test_exif_datetime(spark, date, sub, off, local, east, bad):
    df = spark.createDataFrame([(date, sub, off)], "d string, s string, o string")
    got = df.select(dates.exif_datetime(F.col("d"), F.col("s"), F.col("o")).alias("x")).first().x
    assert (got.local, got.offset_seconds, got.error) == (local, east, bad)


def test_limit_fractions():
    rng = np.random.default_rng(0)
    q = rng.integers(1, 2**44, 400)
    p = (rng.random(400) * q).astype(np.int64)
    for most in (12, 5000, 10**9):
        x, y = scalars.closest_fractions(p // np.gcd(p, q), q // np.gcd(p, q), most)
        assert [Fraction(int(a), int(b)) for a, b in zip(x, y)] == [Fraction(int(a), int(b)).limit_denominator(most) for a, b in zip(p, q)]
    got = lambda n, d: tuple(int(v[0]) for v in scalars.limit_fractions(np.array([n]), np.array([d]), 2, 6))
    assert got(0, 7) == (0, 1) and got(7, 30_011) == (2, 8575) and got(30_011, 7) == (8575, 2) and got(-3, 6) == (-1, 2) and got(1, -10**12) == (-1, 10**12)


def test_nice_fraction(spark):
    df = spark.createDataFrame([(1, 3), (31_416, 10_000), (1, 0), (None, 2)], "n bigint, d bigint")
    assert [r[0] for r in df.select(scalars.nice_fraction("n", "d")).collect()] == ["1/3", "3927/1250", None, None]


@pytest.mark.parametrize("raw, want", [("/a//b/./c/../d/", "/a/b/d"), ("/..", "/"), ("a/../..", ".."), ("./x", "x"), ("", None), ("a/..", "."), ("/A/b", "/A/b"), (None, None)])
def test_shortest_path(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "p string").select(paths.shortest_path(F.col("p"))).first()[0] == want


def test_text_and_sql(spark, rows):
    df = spark.createDataFrame([("trip/sea.v1.heic", "Velmora 70"), ("hill", "x"), ("..", None)], "path string, m string")
    assert [r[0] for r in df.select(text.with_stem(F.col("path"), F.lit("lake"))).collect()] == ["trip/lake.heic", "lake", None]
    assert rows(stats.sqlite_sql(df, "select path from df where m like '%VELMORA%'")) == [("trip/sea.v1.heic",)]
    assert stats.sqlite_dialect("a like 'b like c'") == "a ILIKE 'b like c'"
    assert stats.drop_null_columns(spark.createDataFrame([(1, None)], "a int, b int")).columns == ["a"]
    with pytest.raises(Exception, match="more than one row"):
        stats.pivot_first(spark.createDataFrame([("p", "k", "1"), ("p", "k", "2")], "e string, k string, v string"), "e", "k", "v", ["k"]).collect()


def test_pivot_holds_every_line(spark):
    d = "/root/testdata/sf0.001"
    got = library.pivot_wide(spark, d)
    assert got.columns == ["l_orderkey", *"1234567"]
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q")).collect()
    cells = {(r.l_orderkey, int(c), r[c]) for r in got.collect() for c in got.columns[1:] if r[c] is not None}
    assert cells == {(r.l_orderkey, r.l_linenumber, r.q) for r in lines if r.q is not None}
    with pytest.raises(ValueError):
        stats.pivot_labels(spark.createDataFrame([("1",), ("2",), (None,)], "n string"), "n", 1)


def test_vectors_of_a_grid(spark):
    g = [float(x) for x in (1, 2, 3, 4, 9, 6, 7, 8, 5)]
    df = spark.createDataFrame([(g,)], "g array<double>")
    row = df.select(vectors.total_variation(F.col("g"), 3, 3, "l1"), vectors.laplacian_variance(F.col("g"), 3, 3)).first()
    a = np.array(g).reshape(3, 3)
    assert row[0] == np.abs(np.diff(a, axis=0)).sum() + np.abs(np.diff(a, axis=1)).sum() and row[1] == 0
