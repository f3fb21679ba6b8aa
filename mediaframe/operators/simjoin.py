"""Similarity joins and searches.

* Hamming: pigeonhole bands turn the range join into an equality join that finds exactly the pairs within the
  threshold.  Identical hashes are one class first, so copies never multiply.
* L2: rows live in the cell of their nearest pivot and visit only those cells that can hold a partner by the distance to
  the plane between two pivots, which loses no pair.  Cells are compared in blocks of bounded size by matrix products,
  pairs near the threshold exactly.  Identical vectors are one class first.
* Nearest neighbours: a stated query set, in blocks of bounded size, against all rows; every task keeps k per query.
* Approximate ones: the same scan, but a query meets only the rows of its nearest cells (``indexed_nearest``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.functions.vectors import hamming, l2_squared
from mediaframe.session import path_exists, stage

#: Rows of a block: two of them and their product fit a Python worker.
BLOCK_ROWS = 4000
#: Largest share of the distance by which the matrix form may be off; nearer pairs are computed exactly.
SLACK = 1e-3
#: Rows and queries that the cells of an index are fitted to and its recall is tried on.
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 512
#: Pivots of an L2 join; they are taken from a sample of ``SAMPLE_ROWS`` and travel to every task.
MAX_PIVOTS = 2048
#: Rows that are held against all pivots, or copied to their cells, at a time.
_SLICE = 1024
#: Bytes of a block of queries, which every task gets.
QUERY_BYTES = 64 << 20


def check_threshold(metric: str, threshold: float) -> None:
    """Hamming takes an int, L2 and L2 squared a float, anything else is an error."""
    if metric == "hamming":
        if not isinstance(threshold, int):
            raise TypeError("hamming takes an int")
    elif metric in ("l2", "l2-squared"):
        if not isinstance(threshold, float):
            raise TypeError(f"{metric} takes a float")
    else:
        raise ValueError(f"unknown metric {metric}")


def hamming_pairs(df: DataFrame, key: str, words: str, n_bits: int, threshold: int) -> DataFrame:
    """(a, b, dist) with a < b over distinct hashes: a and b are the smallest keys of their hashes, dist ≤ threshold.

    Null hashes match nothing.  Use ``hash_classes`` for the members of each hash."""
    check_threshold("hamming", threshold)
    reps = df.filter(F.col(words).isNotNull()).groupBy(words).agg(F.min(key).alias("k"))
    bands = threshold + 1
    if bands > n_bits:
        raise ValueError("the threshold reaches the number of bits")
    edges = [n_bits * i // bands for i in range(bands + 1)]

    def band(i: int):
        parts, lo = [], edges[i]
        while lo < edges[i + 1]:  # a band may cross words
            word, at = divmod(lo, 64)
            size = min(edges[i + 1] - lo, 64 - at)
            bits = F.shiftrightunsigned(F.col(words)[word], at)
            parts.append(bits if size == 64 else bits.bitwiseAND(F.lit((1 << size) - 1)))
            lo += size
        return F.struct(F.lit(i).alias("no"), F.array(*parts).alias("bits"))

    keyed = reps.select("k", words, F.explode(F.array(*[band(i) for i in range(bands)])).alias("band"))
    a = keyed.select(F.col("k").alias("a"), F.col(words).alias("wa"), "band")
    b = keyed.select(F.col("k").alias("b"), F.col(words).alias("wb"), "band")
    near = a.join(b, "band").filter("a < b").withColumn("dist", hamming(F.col("wa"), F.col("wb"))).filter(F.col("dist") <= threshold)
    return near.groupBy("a", "b").agg(F.min("dist").alias("dist"))


def hash_classes(df: DataFrame, key: str, words: str) -> DataFrame:
    """(class, key): every row with the smallest key of its hash."""
    reps = df.filter(F.col(words).isNotNull()).groupBy(words).agg(F.min(key).alias("class"))
    return df.join(reps, words).select("class", key)


def vector_classes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(class, key): every row with the smallest key of the rows with the same vector."""
    rows = df.filter(F.col(key).isNotNull() & (F.size(vector) > 0))
    return hash_classes(rows, key, vector)


def link_counts(df: DataFrame, pairs: DataFrame, key: str, classes: DataFrame | None = None) -> DataFrame:
    """(key, links): the number of rows that each row is linked to, 0 included.

    With ``classes`` (class, key) the pairs are those of class representatives: a row has links to the other members of
    its class and to all members of the linked classes.  Only counts of members are shuffled, not the members."""
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a"))
    if classes is None:
        links = ends.groupBy(F.col("x").alias(key)).agg(F.count("*").alias("links"))
        return df.select(key).join(links, key, "left").select(key, F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    sizes = classes.groupBy("class").agg(F.count("*").alias("n"))
    far = ends.join(sizes, F.col("y") == F.col("class")).groupBy("x").agg(F.sum("n").alias("far"))
    per_class = sizes.join(far, F.col("class") == F.col("x"), "left").select("class", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    links = classes.join(per_class, "class").select(key, "links")
    return df.select(key).join(links, key, "left").select(key, F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def _near_pairs(x: np.ndarray, y: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, squared distance) of rows within the limit: by product first, candidates exactly."""
    rough = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    i, j = np.nonzero(rough <= limit + SLACK * (1 + abs(limit)))
    d = ((x[i] - y[j]) ** 2).sum(1)
    keep = d <= limit
    return i[keep], j[keep], d[keep]


def _pivots(rows: DataFrame, n: int, block_rows: int, seed: int = 0) -> np.ndarray:
    """Vectors of some rows, at least one, about as many as there are blocks of rows.

    They come from a bounded sample; which ones they are only changes the work."""
    seen = rows.select("v").orderBy(F.xxhash64("v")).limit(min(SAMPLE_ROWS, 16 * MAX_PIVOTS)).toPandas()
    x = np.stack(seen.v.to_numpy()).astype(np.float64)
    want = int(min(len(x), MAX_PIVOTS, max(1, math.ceil(n / block_rows))))
    return _fit_cells(x, want, seed)


def _apart(pivots: np.ndarray) -> np.ndarray:
    """Distances between pivots, rounded up a little."""
    g = (pivots * pivots).sum(1)
    return np.sqrt(np.maximum(g[:, None] + g[None, :] - 2 * pivots @ pivots.T, 0) + 1e-9 * (1 + g.max()))


def _visits(x: np.ndarray, home: np.ndarray | None, pivots: np.ndarray, apart: np.ndarray, reach: float) -> np.ndarray:
    """Matrix of the cells in which a row within ``reach`` of each vector may live.

    A partner in cell i lies on the far side of the plane between the own pivot and that of i, so the distance to that
    plane bounds the distance to the partner; a little slack keeps rounding harmless."""
    d = _cells_of(x, pivots)
    home = d.argmin(1) if home is None else home
    own = d[np.arange(len(x)), home]
    slack = 1e-9 * (1 + np.abs(d).max(initial=0) + (x * x).sum(1).max(initial=0))
    return d - own[:, None] <= 2 * reach * apart[home] + slack


def _with_home(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(k, v, home), staged, so that a vector between two pivots has one home wherever it is looked at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b.v.to_numpy()).astype(np.float64)
                parts = [_cells_of(x[i : i + _SLICE], pivots).argmin(1) for i in range(0, len(x), _SLICE)]
                yield b.assign(home=np.concatenate(parts))

    kind = rows.schema["k"].dataType.simpleString()
    return stage(rows.mapInPandas(run, f"k {kind}, v array<double>, home bigint"), "cells")


def _cell_join(
    left: DataFrame, right: DataFrame | None, reach: float, limit: float, block_rows: int, schema: str, emit: Callable
) -> DataFrame:
    """What ``emit(left keys, right keys, squared distances)`` makes of all pairs of (k, v) rows within the limit.

    ``right`` None joins ``left`` with itself: each pair of different rows comes once, the smaller key on the left.
    Rows of ``right`` live in one cell each, rows of ``left`` visit cells; a cell with many rows is split into blocks
    of about ``block_rows``, and each pair of a block of residents and a block of visitors is one group."""
    alone = right is None
    residents = left if alone else right
    n = residents.count()
    if not n:
        return left.sparkSession.createDataFrame([], schema)
    pivots = _pivots(residents, n, block_rows)
    apart = _apart(pivots)
    residents = _with_home(residents, pivots)
    visitors = residents if alone else left

    def cells(b: pd.DataFrame, resident: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, cell), some rows at a time; a visitor of a self-join leaves out the cells after its own, where its
        partners visit it."""
        if resident:
            yield np.arange(len(b)), b.home.to_numpy()
            return
        for i in range(0, len(b), _SLICE):
            part = b.iloc[i : i + _SLICE]
            home = part.home.to_numpy() if alone else None
            may = _visits(np.stack(part.v.to_numpy()).astype(np.float64), home, pivots, apart, reach)
            if alone:
                may &= np.arange(len(pivots))[None, :] <= home[:, None]
            row, cell = np.nonzero(may)
            yield row + i, cell

    def blocks(rows: DataFrame, resident: bool) -> np.ndarray:
        """Number of blocks per cell; the counts of at most ``MAX_PIVOTS`` cells reach the driver."""

        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for _, cell in cells(b, resident) if len(b) else ():
                    at, n = np.unique(cell, return_counts=True)
                    yield pd.DataFrame({"c": at, "n": n})

        out = np.ones(len(pivots), np.int64)
        for r in rows.mapInPandas(counted, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect():
            out[r.c] = math.ceil(r.n / block_rows)
        return out

    n_residents, n_visitors = blocks(residents, True), blocks(visitors, False)

    def spread(resident: bool) -> Callable:
        mine, other = (n_residents, n_visitors) if resident else (n_visitors, n_residents)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                keys, vectors = b.k.to_numpy(), b.v.to_numpy()
                salt = pd.util.hash_array(keys)
                home = b.home.to_numpy() if alone and not resident else None
                for rows, cs in cells(b, resident):
                    for at in range(0, len(rows), _SLICE):
                        row, cell = rows[at : at + _SLICE], cs[at : at + _SLICE]
                        own = (salt[row] % mine[cell].astype(np.uint64)).astype(np.int64)
                        times = other[cell]
                        row, cell, own = np.repeat(row, times), np.repeat(cell, times), np.repeat(own, times)
                        mate = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                        x, y = (own, mate) if resident else (mate, own)
                        ours = home[row] == cell if home is not None else np.zeros(len(row), bool)
                        yield pd.DataFrame({"k": keys[row], "v": vectors[row], "cell": cell, "x": x, "y": y, "ours": ours})

        return run

    def placed(rows: DataFrame, resident: bool) -> DataFrame:
        kind = rows.schema["k"].dataType.simpleString()
        return rows.mapInPandas(spread(resident), f"k {kind}, v array<double>, cell bigint, x bigint, y bigint, ours boolean")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return emit(a.k.to_numpy()[:0], b.k.to_numpy()[:0], np.zeros(0))
        x, y = np.stack(a.v.to_numpy()).astype(np.float64), np.stack(b.v.to_numpy()).astype(np.float64)
        i, j, d = _near_pairs(x, y, limit)
        ka, kb = a.k.to_numpy()[i], b.k.to_numpy()[j]
        if alone:  # two residents of one cell meet twice, others once
            keep = ~a.ours.to_numpy()[i] | (ka < kb)
            ka, kb, d = np.minimum(ka, kb)[keep], np.maximum(ka, kb)[keep], d[keep]
        return emit(ka, kb, d)

    by = ("cell", "x", "y")
    return placed(visitors, False).groupBy(*by).cogroup(placed(residents, True).groupBy(*by)).applyInPandas(compare, schema)


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("k is not null and size(v) > 0")


def l2_pairs(df: DataFrame, key: str, vector: str, threshold: float, squared: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, dist) with a < b over distinct vectors: a and b are the smallest keys of theirs, dist within the threshold.

    The boundary is included.  Null and empty vectors match nothing; equal ones are one class, whose members
    ``vector_classes`` gives.  Rows meet in cells (see ``_cell_join``), so where the vectors have clusters wider apart
    than the threshold each row is compared with few others; without any, with all."""
    check_threshold("l2-squared" if squared else "l2", threshold)
    rows = _vectors(df, key, vector).groupBy("v").agg(F.min("k").alias("k")).select("k", "v")
    limit = threshold if squared else threshold * threshold
    slack_limit = limit if squared else np.nextafter(limit, np.inf) * (1 + 1e-12)
    kind = dict(df.dtypes)[key]
    emit = lambda a, b, d: pd.DataFrame({"a": a, "b": b, "d": d})
    if limit < 0:
        return rows.select(F.col("k").alias("a"), F.col("k").alias("b"), F.lit(0.0).alias("dist")).limit(0)
    found = _cell_join(rows, None, math.sqrt(slack_limit), slack_limit, block_rows, f"a {kind}, b {kind}, d double", emit)
    dist = F.col("d") if squared else F.sqrt("d")
    return found.select("a", "b", dist.alias("dist")).filter(F.col("dist") <= threshold)


def _query_blocks(ask: DataFrame, block_bytes: int) -> int:
    """Number of blocks in which the queries travel, so that none has more than about ``block_bytes``."""
    r = ask.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size")).first()
    return max(1, math.ceil((r.n or 0) * ((r["size"] or 0) + 1) * 8 / block_bytes))


def nearest_hamming(df: DataFrame, queries: DataFrame, key: str, words: str, k: int, include_self: bool = False, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query, rank, neighbour, dist): the k nearest rows by the number of different bits, ties by key, ranks from 1.

    Works like ``nearest``, on arrays of 64-bit words.  Null hashes neither ask nor answer."""
    ask = queries.select(F.col(key).alias("k"), F.col(words).alias("v")).filter("k is not null and size(v) > 0")
    rows = df.select(F.col(key).alias("k"), F.col(words).alias("v")).filter("k is not null and size(v) > 0")
    blocks, kind, out = _query_blocks(ask, block_bytes), dict(df.dtypes)[key], None
    for block in range(blocks):
        part = ask.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block).toPandas()
        if not len(part):
            continue
        held = df.sparkSession.sparkContext.broadcast((part.k.to_numpy(), np.stack(part.v.to_numpy()).astype(np.int64)))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            qk, q = held.value
            for b in batches:
                if not len(b):
                    continue
                x, keys = np.stack(b.v.to_numpy()).astype(np.int64), b.k.to_numpy()
                for at in range(0, len(qk), 64):
                    qs, ks = q[at : at + 64], qk[at : at + 64]
                    d = np.bitwise_count((qs[:, None, :] ^ x[None, :, :]).view(np.uint64)).sum(2, dtype=np.int32)
                    if not include_self:
                        d[ks[:, None] == keys[None, :]] = np.iinfo(np.int32).max
                    edge = np.partition(d, min(k, len(keys)) - 1, axis=1)[:, min(k, len(keys)) - 1]
                    i, j = np.nonzero((d <= edge[:, None]) & (d < np.iinfo(np.int32).max))
                    # of the rows at the edge those with the smallest keys will do
                    got = pd.DataFrame({"query": ks[i], "neighbour": keys[j], "dist": d[i, j]}).sort_values(["query", "dist", "neighbour"])
                    yield got.groupby("query", sort=False).head(k)

        got = rows.mapInPandas(scan, f"query {kind}, neighbour {kind}, dist int")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return ask.select(F.col("k").alias("query"), F.lit(0).alias("rank"), F.col("k").alias("neighbour"), F.lit(0).alias("dist")).limit(0)
    return out.selectExpr(
        "query", "row_number() over (partition by query order by dist, neighbour) as rank", "neighbour", "dist"
    ).filter(F.col("rank") <= k)


def nearest(
    df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, include_self: bool = False, block_bytes: int = QUERY_BYTES
) -> DataFrame:
    """(query, rank, neighbour, dist): the k nearest rows by squared L2 distance, ties by key, ranks from 1.

    Each query block is a broadcast of bounded size, scanned against all rows where they lie; every batch keeps k per
    query before anything is shuffled.  Null and empty vectors neither ask nor answer."""
    spark = df.sparkSession
    ask = queries.select(F.col(key).alias("k"), F.col(vector).alias("v")).filter("k is not null and size(v) > 0")
    blocks = _query_blocks(ask, block_bytes)
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v")).filter("k is not null and size(v) > 0")
    out = None
    for block in range(blocks):
        part = ask.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block).toPandas()
        if not len(part):
            continue
        held = spark.sparkContext.broadcast((part.k.to_numpy(), np.stack(part.v.to_numpy()).astype(np.float64)))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            qk, q = held.value
            for b in batches:
                if not len(b):
                    continue
                x, keys = np.stack(b.v.to_numpy()).astype(np.float64), b.k.to_numpy()
                for at in range(0, len(qk), 512):
                    qs, ks = q[at : at + 512], qk[at : at + 512]
                    rough = (qs * qs).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * qs @ x.T
                    if not include_self:
                        rough[ks[:, None] == keys[None, :]] = np.inf
                    m = min(k, len(keys))
                    edge = np.partition(rough, m - 1, axis=1)[:, m - 1]
                    i, j = np.nonzero(rough <= np.where(np.isinf(edge), -np.inf if m == 0 else 1e300, edge + SLACK)[:, None])
                    yield pd.DataFrame({"query": ks[i], "neighbour": keys[j], "dist": ((qs[i] - x[j]) ** 2).sum(1)})

        kind = dict(df.dtypes)[key]
        got = rows.mapInPandas(scan, f"query {kind}, neighbour {kind}, dist double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return ask.select(F.col("k").alias("query"), F.lit(0).alias("rank"), F.col("k").alias("neighbour"), F.lit(0.0).alias("dist")).limit(0)
    return out.selectExpr(
        "query", "row_number() over (partition by query order by dist, neighbour) as rank", "neighbour", "dist"
    ).filter(F.col("rank") <= k)


def approximate_nearest(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, tables: int = 12, width: float = 0.6, seed: int = 0) -> DataFrame:
    """Like ``nearest``, over candidates that share a random-projection bucket; every row is indexed.

    The projections are drawn once from the seed.  The width must suit the distances of the neighbours: the default one
    loses most of them on vectors without clusters, where ``indexed_nearest`` keeps a stated recall."""
    size = len(df.select(vector).filter(F.size(vector) > 0).first()[0])
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(tables, 2, size))
    shifts = rng.uniform(0, width, size=(tables, 2))

    def hashed(d: DataFrame, id_: str, v: str) -> DataFrame:
        dot = lambda p, s: F.floor((F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(x)) for x in p]), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x) + s) / width)
        sig = [F.struct(F.lit(t).alias("t"), dot(planes[t, 0], shifts[t, 0]).alias("a"), dot(planes[t, 1], shifts[t, 1]).alias("b")) for t in range(tables)]
        return d.filter(F.size(vector) > 0).select(F.col(key).alias(id_), F.col(vector).alias(v), F.explode(F.array(*sig)).alias("cell"))

    pairs = hashed(queries, "query", "vq").join(hashed(df, "neighbour", "vn"), "cell").filter("query <> neighbour")
    pairs = pairs.withColumn("dist", l2_squared(F.col("vq"), F.col("vn"))).groupBy("query", "neighbour").agg(F.min("dist").alias("dist"))
    return pairs.selectExpr("query", "row_number() over (partition by query order by dist, neighbour) as rank", "neighbour", "dist").filter(F.col("rank") <= k)


def _cells_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to the centres, less the own squared length."""
    return (centres * centres).sum(1)[None, :] - 2 * x @ centres.T


def _fit_cells(x: np.ndarray, n: int, seed: int, rounds: int = 10) -> np.ndarray:
    """n centres by k-means; a centre that loses all its rows stays where it was."""
    centres = x[np.random.default_rng(seed).choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        cell = _cells_of(x, centres).argmin(1)
        held = np.bincount(cell, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


def indexed_nearest(
    df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, recall: float = 0.95, seed: int = 0, block_bytes: int = QUERY_BYTES
) -> DataFrame:
    """Like ``nearest``, but each query is compared only with the rows of its nearest cells; every row lies in one cell.

    The cells are fitted to a sample of the rows.  A query visits as many of them as hold the stated share of the
    neighbours that a sample of the queries has within the sample of the rows (all of both, if they are few).  Rows left
    out of the sample can only bring nearer neighbours, which lie in nearer cells.  A query whose cells hold at most k
    rows visits more, so that none gets fewer neighbours than there are."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v")).filter("k is not null and size(v) > 0")
    ask = queries.select(F.col(key).alias("k"), F.col(vector).alias("v")).filter("k is not null and size(v) > 0")
    few = lambda d, n: d.orderBy(F.xxhash64("k"), "k").limit(n).toPandas()
    seen, tried, n = few(rows, SAMPLE_ROWS), few(ask, SAMPLE_QUERIES), ask.count()
    if not len(seen) or not n:
        return ask.select(F.col("k").alias("query"), F.lit(0).alias("rank"), F.col("k").alias("neighbour"), F.lit(0.0).alias("dist")).limit(0)
    x, q = (np.stack(p.v.to_numpy()).astype(np.float64) for p in (seen, tried))
    centres = _fit_cells(x, max(1, math.isqrt(len(x))), seed)
    cell = _cells_of(x, centres).argmin(1)
    far = np.stack([_cells_of(q[i : i + 1], x)[0] for i in range(len(q))])
    far[tried.k.to_numpy()[:, None] == seen.k.to_numpy()[None, :]] = np.inf
    near = np.argsort(far, axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(_cells_of(q, centres), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, cell[near], 1)[np.isfinite(np.take_along_axis(far, near, 1))])
    visits = int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1 if len(needed) else len(centres)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                got = np.bincount(_cells_of(np.stack(b.v.to_numpy()).astype(np.float64), centres).argmin(1), minlength=len(centres))
                yield pd.DataFrame({"c": np.arange(len(centres)), "n": got})

    held = np.zeros(len(centres), np.int64)
    for r in rows.mapInPandas(count, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect():
        held[r.c] = r.n
    blocks = _query_blocks(ask, block_bytes)
    out = None
    for block in range(blocks):
        part = ask.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block).toPandas()
        if not len(part):
            continue
        shared = spark.sparkContext.broadcast((part.k.to_numpy(), np.stack(part.v.to_numpy()).astype(np.float64)))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qk, q = shared.value
            by_cell: list[list[np.ndarray]] = [[] for _ in centres]
            for at in range(0, len(q), 4096):
                order = np.argsort(_cells_of(q[at : at + 4096], centres), axis=1, kind="stable")
                before = np.cumsum(held[order], axis=1) - held[order]
                i, j = np.nonzero((np.arange(len(centres))[None, :] < visits) | (before <= k))
                cells = order[i, j]
                for c in np.unique(cells):
                    by_cell[c].append(at + i[cells == c])
            guests = [np.concatenate(g) if g else np.zeros(0, np.int64) for g in by_cell]
            for b in batches:
                if not len(b):
                    continue
                x, keys = np.stack(b.v.to_numpy()).astype(np.float64), b.k.to_numpy()
                cell = _cells_of(x, centres).argmin(1)
                for c in np.unique(cell):
                    xs, xk = x[cell == c], keys[cell == c]
                    for at in range(0, len(guests[c]), 512):
                        g = guests[c][at : at + 512]
                        rough = (q[g] * q[g]).sum(1)[:, None] + (xs * xs).sum(1)[None, :] - 2 * q[g] @ xs.T
                        rough[qk[g][:, None] == xk[None, :]] = np.inf
                        m = min(k, len(xk))
                        edge = np.partition(rough, m - 1, axis=1)[:, m - 1]
                        i, j = np.nonzero(np.isfinite(rough) & (rough <= edge[:, None] + SLACK))
                        yield pd.DataFrame({"query": qk[g][i], "neighbour": xk[j], "dist": ((q[g][i] - xs[j]) ** 2).sum(1)})

        got = rows.mapInPandas(scan, f"query {kind}, neighbour {kind}, dist double")
        out = got if out is None else out.unionByName(got)
    return out.selectExpr(
        "query", "row_number() over (partition by query order by dist, neighbour) as rank", "neighbour", "dist"
    ).filter(F.col("rank") <= k)


def label_match(
    df: DataFrame, store: DataFrame, key: str, vector: str, label: str, strict: float, suggest: float, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(key, sure, suggested): distinct labels within ``strict``, and beyond it within ``suggest``, squared L2, sorted.

    Distinct (vector, label) pairs of the store live in cells that the rows visit (see ``_cell_join``); neither side
    reaches the driver.  Rows without a label in reach, null and empty vectors get empty lists; null labels are none.
    Distinct (row, label) pairs are formed in each block before the lists, whose length is the number of labels."""
    kind, label_kind = dict(df.dtypes)[key], dict(store.dtypes)[label]
    known = store.select(F.col(label).alias("l"), F.col(vector).cast("array<double>").alias("v")).filter("l is not null and size(v) > 0")
    known = known.distinct().select(F.col("l").alias("k"), "v")
    rows = _vectors(df, key, vector)

    def emit(k: np.ndarray, l: np.ndarray, d: np.ndarray) -> pd.DataFrame:  # noqa: E741
        return pd.DataFrame({"k": k, "l": l, "sure": d <= strict}).drop_duplicates()

    hits = _cell_join(rows, known, math.sqrt(max(suggest, 0.0)), suggest, block_rows, f"k {kind}, l {label_kind}, sure boolean", emit)
    lists = hits.distinct().groupBy("k").agg(
        F.sort_array(F.collect_set(F.when(F.col("sure"), F.col("l")))).alias("sure"),
        F.sort_array(F.collect_set(F.when(~F.col("sure"), F.col("l")))).alias("suggested"),
    )
    keys = df.select(F.col(key).alias("k"))
    none = F.array().cast(T.ArrayType(store.schema[label].dataType))
    return keys.join(lists, "k", "left").select(F.col("k").alias(key), F.coalesce("sure", none).alias("sure"), F.coalesce("suggested", none).alias("suggested"))


class FlatIndex:
    """Vectors (or packed hashes) of one length in a table that grows by batches and is searched as a whole, exactly."""

    #: Element types by metric.
    KINDS = {"l2-squared": ("array<float>", "array<double>"), "hamming": ("array<bigint>",)}

    def __init__(self, spark: SparkSession, path: str, metric: str):
        if metric not in self.KINDS:
            raise ValueError(f"unknown metric {metric}")
        self.spark, self.path, self.metric = spark, path, metric

    def add(self, batch: DataFrame, key: str, vector: str) -> None:
        """Append a batch; a wrong element type or length is an error, and then nothing of the batch is added."""
        if dict(batch.dtypes)[vector] not in self.KINDS[self.metric]:
            raise TypeError(f"{self.metric} takes {self.KINDS[self.metric]}")
        rows = batch.select(F.col(key).alias("k"), F.col(vector).cast(self.KINDS[self.metric][-1]).alias("v")).filter("k is not null and size(v) > 0")
        sizes = [d.agg(F.min(F.size("v")), F.max(F.size("v"))).first() for d in (rows, *([self.table()] if path_exists(self.spark, self.path) else []))]
        if len({x for r in sizes for x in r if x is not None}) > 1:
            raise ValueError("vectors of different lengths")
        rows.write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def search(self, queries: DataFrame, key: str, vector: str, k: int, include_self: bool = True) -> DataFrame:
        """(query, rank, neighbour, dist) of the k nearest rows of the index; a query may be one of them."""
        ask = queries.select(F.col(key).alias("k"), F.col(vector).cast(self.KINDS[self.metric][-1]).alias("v"))
        find = nearest if self.metric == "l2-squared" else nearest_hamming
        return find(self.table(), ask, "k", "v", k, include_self)


class LabelStore:
    """Labelled vectors that grow while batches are matched against them, as a table that is appended to.

    ``match`` looks at what has been confirmed so far, ``confirm`` adds to it; a batch that is confirmed twice adds
    nothing the second time, since (key, label) pairs that the store has are left out."""

    def __init__(self, spark: SparkSession, path: str, key: str, vector: str, label: str):
        self.spark, self.path, self.key, self.vector, self.label = spark, path, key, vector, label

    def table(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if path_exists(self.spark, self.path) else None

    def match(self, batch: DataFrame, strict: float, suggest: float) -> DataFrame:
        store = self.table()
        if store is None:
            store = batch.select(self.vector, F.lit(None).cast("string").alias(self.label)).limit(0)
        return label_match(batch, store, self.key, self.vector, self.label, strict, suggest)

    def confirm(self, batch: DataFrame) -> None:
        """Add rows of (key, vector, label)."""
        rows = batch.select(self.key, self.vector, self.label).filter(F.col(self.label).isNotNull())
        store = self.table()
        if store is not None:
            rows = rows.join(store.select(self.key, self.label).distinct(), [self.key, self.label], "left_anti").select(self.key, self.vector, self.label)
        rows.write.mode("append").parquet(self.path)


def neighbour_lists(found: DataFrame) -> DataFrame:
    """(query, neighbours): the ranked neighbours of each query as one list, at most k long."""
    rows = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("x"))
    return rows.select("query", F.transform("x", lambda x: x["neighbour"]).alias("neighbours"))


def block_pairs(left: DataFrame, right: DataFrame, function: Callable, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What ``function(left block, right block)`` makes of every pair of blocks of two frames with a column ``k``.

    It serves functions of whole matrices, such as products, that need every pair; joins with a threshold have their
    own ways above.  Rows are dealt to blocks of about ``block_rows`` by a hash of ``k``; each pair is one group of two."""
    n, m = (max(1, math.ceil(d.count() / block_rows)) for d in (left, right))

    def dealt(d: DataFrame, own: str, other: str, mine: int, others: int) -> DataFrame:
        to = F.sequence(F.lit(0), F.lit(others - 1))
        return d.withColumn(own, F.pmod(F.xxhash64("k"), F.lit(mine)).cast("int")).withColumn(other, F.explode(to))

    a, b = dealt(left, "_x", "_y", n, m), dealt(right, "_y", "_x", m, n)
    drop = lambda d: d.drop(columns=["_x", "_y"])
    return a.groupBy("_x", "_y").cogroup(b.groupBy("_x", "_y")).applyInPandas(lambda x, y: function(drop(x), drop(y)), schema)


def shared_array(spark: SparkSession, array: np.ndarray, most_bytes: int = QUERY_BYTES):
    """A broadcast of an array of a checked size."""
    if array.nbytes > most_bytes:
        raise ValueError(f"{array.nbytes} bytes are too many for every task")
    return spark.sparkContext.broadcast(array)
