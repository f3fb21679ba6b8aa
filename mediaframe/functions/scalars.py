"""Geo, rational, JSON, map and image-geometry columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_KM = 6371.0088
#: Orientation values of EXIF to rotation labels (fixed values).
ORIENTATION_LABELS = {1: 0, 3: 2, 6: 1, 8: 3}
#: Orientation after turning an image that has the orientation in the key (fixed values).
ROTATED = {
    "cw": {1: 6, 6: 3, 3: 8, 8: 1},
    "180": {1: 3, 3: 1, 6: 8, 8: 6},
    "ccw": {1: 8, 8: 3, 3: 6, 6: 1},
}
#: Lossless operation that makes an orientation upright (fixed values).
UPRIGHT_OPS = {
    1: "none", 2: "flip horizontal", 3: "rotate 180", 4: "flip vertical",
    5: "transpose", 6: "rotate 90", 7: "transverse", 8: "rotate 270",
}


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table, null for other keys."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def orientation_label(orientation: Column) -> Column:
    """Rotation label; a missing orientation is upright, an unknown one null."""
    return lookup(ORIENTATION_LABELS, F.coalesce(orientation, F.lit(1)))


def dms_to_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column | None = None) -> Column:
    """Decimal degrees; the hemisphere is ignored unless ``ref`` is given (S and W are negative)."""
    value = degrees.cast("double") + minutes.cast("double") / 60 + seconds.cast("double") / 3600
    return value if ref is None else F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def rational(num: Column, den: Column) -> Column:
    """num/den as double, null for a zero denominator."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def closest_fractions(p: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The fractions nearest to p/q (in lowest terms, p not above q) with denominators up to ``most``, ties to the smaller one.

    All rows walk their continued fractions together: (h, k) are the last two convergents, rows that reach the bound
    stop at the best intermediate fraction."""
    out_p, out_q = p.copy(), q.copy()
    at = np.flatnonzero(q > most)
    a, b = p[at], q[at]
    h = [np.zeros_like(a), np.ones_like(a)]
    k = [np.ones_like(a), np.zeros_like(a)]
    while len(at):
        part = a // b
        room = np.where(k[1] > 0, (most - k[0]) // np.maximum(k[1], 1), np.iinfo(np.int64).max)
        stop = part > room
        if stop.any():
            s = np.flatnonzero(stop)
            near_p, near_q = h[0][s] + room[s] * h[1][s], k[0][s] + room[s] * k[1][s]
            # the convergent is nearer unless the last partial quotient was at least half used up
            took = 2 * b[s].astype(object) * near_q.astype(object) <= q[at[s]].astype(object)
            took = took.astype(bool)
            out_p[at[s]] = np.where(took, h[1][s], near_p)
            out_q[at[s]] = np.where(took, k[1][s], near_q)
        go = ~stop
        at, a, b, part = at[go], a[go], b[go], part[go]
        h = [h[1][go], h[0][go] + part * h[1][go]]
        k = [k[1][go], k[0][go] + part * k[1][go]]
        a, b = b, a - part * b
    return out_p, out_q


def limit_fractions(num: np.ndarray, den: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearby fractions whose larger sides have few digits: at most 10^high, then ever smaller powers of ten down to
    10^low, as long as the value stays above zero.  Fractions above one are treated by their reciprocals."""
    num, den = np.where(den < 0, -num, num), np.abs(den)
    sign, num = np.sign(num), np.abs(num)
    g = np.maximum(np.gcd(num, den), 1)
    small, large = np.minimum(num, den) // g, np.maximum(num, den) // g
    live = small > 0
    for e in range(high, low - 1, -1):
        p, q = closest_fractions(small[live], large[live], 10**e)
        at = np.flatnonzero(live)
        kept = p > 0
        small[at[kept]], large[at[kept]] = p[kept], q[kept]
        live[at[~kept]] = False
    flip = num > den
    small, large = np.where(num == 0, 0, small), np.where(num == 0, 1, large)
    return sign * np.where(flip, large, small), np.where(flip, small, large)


@F.pandas_udf(T.StringType())
def nice_fraction(num: pd.Series, den: pd.Series) -> pd.Series:
    """``limit_fractions`` with powers 9 to 4 as text, null for a null or a zero denominator."""
    ok = (num.notna() & den.notna() & (den.fillna(0) != 0)).to_numpy()
    p, q = limit_fractions(num[ok].to_numpy(np.int64), den[ok].to_numpy(np.int64), 4, 9)
    out = pd.Series([None] * len(num), dtype=object)
    out[ok] = [f"{x}/{y}" for x, y in zip(p, q)]
    return out


def manifest_valid(json: Column) -> Column:
    """True for a manifest without validation messages, null where there is no manifest."""
    status = F.from_json(json, "validation_status array<map<string,string>>")["validation_status"]
    return F.when(json.isNotNull(), F.coalesce(F.size(status) <= 0, F.lit(True)))


def override(m: Column, name: str, value: Column) -> Column:
    """The map with one entry set, whatever it held before; a null map counts as empty."""
    base = F.coalesce(m, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, _: k != name), F.create_map(F.lit(name), value))


def parse_override(text: Column) -> Column:
    """A dict literal of texts as a map; blank is an empty map."""
    quoted = F.regexp_replace(F.coalesce(text, F.lit("{}")), "'", '"')
    return F.coalesce(F.from_json(quoted, "map<string,string>"), F.create_map().cast("map<string,string>"))


def crop_box(t: Column, r: Column, b: Column, l: Column, context: int, height: Column, width: Column) -> Column:  # noqa: E741
    """The box with some context, clamped to the image."""
    zero = F.lit(0)
    return F.struct(
        F.greatest(zero, t - context).alias("top"),
        F.least(width, r + context).alias("right"),
        F.least(height, b + context).alias("bottom"),
        F.greatest(zero, l - context).alias("left"),
    )


def half_crop(target: str, width: Column, height: Column) -> Column:
    """(x, y, w, h) of what stays when one half of an image is cut off; an inner edge lies at a multiple of 16.

    The edges are fixed values: lossless cuts of JPEG files lie at blocks of 16 pixels."""
    zero, half_w, half_h = F.lit(0), F.floor(width / 2), F.floor(height / 2)
    x, y = half_w - half_w % 16, half_h - half_h % 16
    kept = {
        "top": (zero, y, width, height - y),
        "bottom": (zero, zero, width, half_h),
        "left": (x, zero, width - x, height),
        "right": (zero, zero, half_w, height),
    }
    if target not in kept:
        raise ValueError(f"unsupported target {target}")
    return F.struct(*[c.cast("bigint").alias(n) for n, c in zip("xywh", kept[target])])


def rotated_label(label: Column, turns: Column) -> Column:
    return F.pmod(label + turns, F.lit(4))


@F.pandas_udf(T.DoubleType())
def geodesic_km(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Distance on the WGS-84 ellipsoid by Vincenty's inverse formula; null where it does not converge."""
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    big = lam = np.radians(lon2 - lon1)
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    with np.errstate(all="ignore"):
        for _ in range(200):
            s, c = np.sin(lam), np.cos(lam)
            sin_sig = np.sqrt((cu2 * s) ** 2 + (cu1 * su2 - su1 * cu2 * c) ** 2)
            cos_sig = su1 * su2 + cu1 * cu2 * c
            sig = np.arctan2(sin_sig, cos_sig)
            sin_al = np.where(sin_sig == 0, 0, cu1 * cu2 * s / np.where(sin_sig == 0, 1, sin_sig))
            cos2 = 1 - sin_al**2
            mid = np.where(cos2 == 0, 0, cos_sig - 2 * su1 * su2 / np.where(cos2 == 0, 1, cos2))
            k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = big + (1 - k) * f * sin_al * (sig + k * sin_sig * (mid + k * cos_sig * (2 * mid**2 - 1)))
            done = np.nanmax(np.abs(new - lam), initial=0) < 1e-12
            lam = new
            if done:
                break
        uu = cos2 * (a**2 - b**2) / b**2
        aa = 1 + uu / 16384 * (4096 + uu * (uu * (320 - 175 * uu) - 768))
        bb = uu / 1024 * (256 + uu * (uu * (74 - 47 * uu) - 128))
        d = bb * sin_sig * (mid + bb / 4 * (cos_sig * (2 * mid**2 - 1) - bb / 6 * mid * (4 * sin_sig**2 - 3) * (4 * mid**2 - 3)))
    return pd.Series(b * aa * (sig - d) / 1000)


def exif_value(c: Column, kind: str) -> Column:
    """The text of an EXIF entry as ``ascii``, ``utf-8``, ``int``, ``float``, ``rational`` or ``tuple-of-rational``.

    Bad values are null, and so is a rational with a zero denominator; rationals are structs (num, den)."""

    def fraction(x: Column) -> Column:
        part = lambda i: F.regexp_extract(x, r"^\s*(-?\d+)/(-?\d+)\s*$", i).try_cast("bigint")
        return F.when(part(2) != 0, F.struct(part(1).alias("num"), part(2).alias("den")))

    if kind == "ascii":
        return F.when(~c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(c, r"\x00+$", ""))
    if kind == "utf-8":
        return c
    if kind in ("int", "float"):
        return F.trim(c).try_cast({"int": "bigint", "float": "double"}[kind])
    if kind == "rational":
        return fraction(c)
    if kind == "tuple-of-rational":
        all_ = F.transform(F.split(c, ","), fraction)
        return F.when(~F.exists(all_, lambda x: x.isNull()), all_)
    raise ValueError(f"unsupported kind {kind}")
