"""Places on the globe."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.scalars import EARTH_KM
from mediaframe.operators.simjoin import QUERY_BYTES


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat.astype(np.float64)), np.radians(lon.astype(np.float64))
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)


def nearest_place(points: DataFrame, places: DataFrame, key: str, place: str, lat: str = "lat", lon: str = "lon", block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(key, place, km): for each point the nearest place of a gazetteer by great circles, ties to the smaller name.

    The gazetteer travels in blocks of bounded size and points stay where they lie, each batch keeping one place per
    point and block.  Points or places without a position take no part."""
    spark = points.sparkSession
    there = places.select(F.col(place).alias("p"), F.col(lat).alias("a"), F.col(lon).alias("o")).filter("p is not null and a is not null and o is not null")
    asks = points.select(F.col(key).alias("k"), F.col(lat).alias("a"), F.col(lon).alias("o")).filter("k is not null and a is not null and o is not null")
    kind, name = dict(points.dtypes)[key], dict(places.dtypes)[place]
    blocks, out = max(1, math.ceil(there.count() * 64 / block_bytes)), None
    for block in range(blocks):
        part = there.filter(F.pmod(F.xxhash64("p"), F.lit(blocks)) == block).toPandas().sort_values("p")
        if not len(part):
            continue
        held = spark.sparkContext.broadcast((part.p.to_numpy(), _unit(part.a.to_numpy(), part.o.to_numpy())))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            names, y = held.value
            for b in batches:
                for at in range(0, len(b), 256):
                    some = b.iloc[at : at + 256]
                    x = _unit(some.a.to_numpy(), some.o.to_numpy())
                    best = (x @ y.T).argmax(1)
                    chord = np.sqrt(((x - y[best]) ** 2).sum(1))
                    yield pd.DataFrame({"k": some.k.to_numpy(), "p": names[best], "km": 2 * EARTH_KM * np.arcsin(np.minimum(1, chord / 2))})

        got = asks.mapInPandas(scan, f"k {kind}, p {name}, km double")
        out = got if out is None else out.union(got)
    if out is None:
        return asks.select(F.col("k").alias(key), F.lit(None).cast(name).alias(place), F.lit(None).cast("double").alias("km")).limit(0)
    if blocks > 1:
        out = out.groupBy("k").agg(F.min(F.struct("km", "p")).alias("w")).select("k", "w.p", "w.km")
    return out.select(F.col("k").alias(key), F.col("p").alias(place), "km")
