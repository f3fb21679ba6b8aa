"""Mixed timestamp notations and zones into one UTC instant per entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import shapes
from mediaframe.functions.text import label_key, once
from mediaframe.functions.zones import ZoneTable, zone_tables

MAX_ZONES = 1000
US = shapes.US


def one_row_per_entity(
    rows: DataFrame, wanted: dict[str, str], entity: str, label: str, value: str, device: str
) -> DataFrame:
    """(entity, device, one text per wanted label).  Only the wanted labels are shuffled, combined on the map side.

    An entity never has two different values of a label; should it, the greatest is taken, so a blank one loses."""
    keys = {"".join(name.lower().split()): out for out, name in wanted.items()}
    kept = [F.col(entity).alias("entity"), F.col(device).alias("device"), F.col(value).alias("v")]
    base = once(rows.filter(F.col(value).isNotNull() & F.col(entity).isNotNull()), kept, k=label_key(F.col(label)))
    base = base.filter(F.col("k").isin(*keys))
    picks = [F.max(F.when(F.col("k") == k, F.col("v"))).alias(out) for k, out in keys.items()]
    return base.groupBy("entity").agg(F.max("device").alias("device"), *picks)


def resolve(
    original: pd.Series, subsec: pd.Series, offset: pd.Series, gps: pd.Series, zone: pd.Series, tables: dict[str, ZoneTable]
) -> np.ndarray:
    """UTC texts or the reasons why there is none, vectorised; one zone table is applied to all its rows at once."""
    main = shapes.parse_moments(shapes.clean(original))
    sub = shapes.clean(subsec)
    digits = sub.where(sub.str.fullmatch(r"\d+"), None)
    fraction = np.where(main.fraction >= 0, main.fraction, np.maximum(shapes._micros(digits), 0))
    given = shapes.parse_offsets(shapes.clean(offset).str.replace(r"\s", "", regex=True))
    east = np.where(main.offset != shapes.NO_OFFSET, main.offset, given)
    known = east != shapes.NO_OFFSET
    utc = (main.seconds - np.where(known, east, 0)) * US
    why = np.full(len(utc), "", object)
    why[~main.valid] = "invalid"
    ask = main.valid & ~known
    zones = zone.to_numpy(object)
    codes, names = pd.factorize(zones)
    why[ask & (codes < 0)] = "no zone"
    for i, name in enumerate(names):
        at = np.flatnonzero(ask & (codes == i))
        if name not in tables:
            why[at] = "no zone"
        elif len(at):
            utc[at], count = tables[name].to_utc(main.seconds[at] * US)
            why[at[count == 0]], why[at[count > 1]] = "nonexistent", "ambiguous"
    utc = utc + fraction
    open_ = why != ""
    if open_.any():
        other = shapes.parse_moments(shapes.clean(gps[open_]))
        east = np.where(other.offset != shapes.NO_OFFSET, other.offset, 0)
        at = np.flatnonzero(open_)[other.valid]
        utc[at] = ((other.seconds - east) * US + np.maximum(other.fraction, 0))[other.valid]
        why[at] = ""
    text = np.datetime_as_string(np.where(why == "", utc, 0).astype("datetime64[us]"), unit="us")
    return np.where(why == "", np.char.add(text, "Z"), why).astype(object)


def normalise_timestamps(
    rows: DataFrame,
    devices: DataFrame,
    entity: str = "path",
    label: str = "key_label",
    value: str = "value_label",
    device: str = "device_id",
    original: str = "Exif DateTime original",
    subsec: str = "Exif Sub seconds time original",
    offset: str = "Exif Offset time original",
    gps: str = "GPS GPS DateStamp",
) -> DataFrame:
    """(entity, utc, zone_version): one row per entity that has a non-null ``original`` value.

    utc is ``yyyy-MM-ddTHH:mm:ss.SSSSSSZ`` or the reason why there is none: ``invalid``, ``no zone``, ``ambiguous``,
    ``nonexistent``.  The zone of a value is the one it carries, else a readable offset label, else the home zone of
    the device; a GPS moment stands in where these give no single instant.  Blank values are ``invalid``; a zone name
    that the database does not know counts as none; repeated rows do not matter; an empty input gives no row.
    Devices without a row, or with a null id, have no home zone; a device with two rows must not occur."""
    zones = [r[0] for r in devices.select("home_zone").filter("home_zone is not null").distinct().limit(MAX_ZONES + 1).collect()]
    if len(zones) > MAX_ZONES:
        raise ValueError("more zones than the zone database has")
    tables = zone_tables(zones)
    version = next((t.version for t in tables.values()), "none")
    flat = one_row_per_entity(
        rows, {"original": original, "subsec": subsec, "offset_": offset, "gps": gps}, entity, label, value, device
    ).filter("original is not null")
    homes = devices.select(F.col("device_id").alias("device"), "home_zone").filter("device is not null")
    flat = flat.join(homes.dropDuplicates(["device"]), "device", "left").select(
        "entity", "original", "subsec", "offset_", "gps", "home_zone"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            utc = resolve(b["original"], b["subsec"], b["offset_"], b["gps"], b["home_zone"], tables)
            yield pd.DataFrame({entity: b["entity"], "utc": utc, "zone_version": version})

    return flat.mapInPandas(run, f"`{entity}` string, utc string, zone_version string")
