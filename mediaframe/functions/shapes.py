"""Date texts by shape.

A text becomes a mask of character classes: every digit run of length n is ``9`` n times, every letter run is
``A``, other characters stay.  Each distinct mask is compiled to one parser, and all texts of a mask are parsed
together with array operations.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd

#: Month names in English, German, French and Spanish, without marks (fixed values).
MONTH_NAMES = """january february march april may june july august september october november december
januar februar marz april mai juni juli august september oktober november dezember
janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"""


def _month_table() -> dict[str, int]:
    """Every beginning of a month name of at least three letters that fits one month only; "maerz" and "setiembre" too."""
    months: dict[str, set[int]] = {"maerz": {3}, "setiembre": {9}}
    for line in MONTH_NAMES.splitlines():
        for i, name in enumerate(line.split()):
            for n in range(3, len(name) + 1):
                months.setdefault(name[:n], set()).add(i + 1)
    return {name: min(which) for name, which in months.items() if len(which) == 1}


MONTHS = _month_table()
UTC_NAMES = {"z", "utc", "gmt", "ut"}
MAX_OFFSET, MIN_OFFSET = 14 * 3600, -12 * 3600
US = 1_000_000

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
_AMPM = r"(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(?P<z>[Zz]|(?:UTC|GMT|UT|utc|gmt)?\s*[+-]\d{1,2}(?::?\d{2})?|UTC|GMT|UT|utc|gmt))?"
_NAME = r"(?P<mon>[^\W\d_]{3,10})\.?"
_DAY_NAME = r"(?:[^\W\d_]{2,10}\.?,?\s+)?"
_CLOCK = rf"(?:[T\s]\s*|,\s*){_TIME}{_AMPM}{_ZONE}"
#: Notations, tried in this order.
FAMILIES = [
    rf"(?P<y>\d{{4}})[:\-/.](?P<mo>\d{{1,2}})[:\-/.](?P<d>\d{{1,2}}){_CLOCK}",
    rf"(?P<d>\d{{1,2}})[:\-/.](?P<mo>\d{{1,2}})[:\-/.](?P<y>\d{{4}}){_CLOCK}",
    rf"(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})[T\s_-]?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?{_ZONE}",
    rf"{_DAY_NAME}{_NAME}\s+(?P<d>\d{{1,2}})\s+{_TIME}{_AMPM}{_ZONE}\s+(?P<y>\d{{4}})",
    rf"{_DAY_NAME}{_NAME}\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}){_CLOCK}",
    rf"{_DAY_NAME}(?P<d>\d{{1,2}})\.?[\s-]{_NAME}[\s-](?P<y>\d{{4}}){_CLOCK}",
    rf"(?P<y>\d{{4}})[\s-]{_NAME}[\s-](?P<d>\d{{1,2}}){_CLOCK}",
    r"(?P<epoch>\d{10}|\d{13}|\d{16}|\d{19})",
]
_OFFSET = r"(?:UTC|GMT|UT)?\s*(?P<sign>[+-])(?P<oh>\d{1,2})(?::?(?P<om>\d{2}))?"


def clean(texts: pd.Series) -> pd.Series:
    """Compatibility form without NULs and outer white space, with ASCII minus signs; null is ''."""
    plain = texts.fillna("").astype(str)
    odd = ~plain.map(str.isascii)
    if odd.any():
        plain = plain.where(~odd, plain[odd].map(lambda s: re.sub("[−‐-―]", "-", unicodedata.normalize("NFKC", s))))
    return plain.str.replace("\0", " ", regex=False).str.strip()


def mask_of(texts: pd.Series) -> pd.Series:
    return texts.str.replace(r"[^\W\d_]+", "A", regex=True).str.replace(r"\d", "9", regex=True)


_parsers: dict[str, tuple[re.Pattern, ...]] = {}


def parser_for(mask: str) -> tuple[re.Pattern, ...]:
    """The notations that texts of this mask can have; letters keep their freedom, so a mask may have two."""
    if mask not in _parsers:
        if len(_parsers) > 65536:
            _parsers.clear()
        _parsers[mask] = _compile(mask)
    return _parsers[mask]


def _compile(mask: str) -> tuple[re.Pattern, ...]:
    # without letters the mask is itself a text of its kind; what letters mean only the texts can tell
    free = any(c.isalpha() for c in mask)
    return tuple(re.compile(f) for f in FAMILIES if free or re.fullmatch(f, mask))


def month_of(names: pd.Series) -> np.ndarray:
    """Numbers of month names, -1 where unknown."""
    codes, distinct = pd.factorize(names.to_numpy(object))
    bare = ["".join(c for c in unicodedata.normalize("NFKD", x) if c.isalpha()).lower() for x in distinct]
    numbers = [MONTHS.get(x, -1) for x in bare]
    return np.array([*numbers, -1], np.int64)[codes]


@dataclass
class Parsed:
    """Arrays over the texts: local or UTC microseconds without fraction, what they carry, and whether they are valid."""

    valid: np.ndarray  # names a real day and time of day
    seconds: np.ndarray  # seconds of the local time as if it were UTC
    fraction: np.ndarray  # microseconds, -1 if the text has none
    offset: np.ndarray  # seconds east of UTC, NO_OFFSET if the text carries none


NO_OFFSET = np.iinfo(np.int64).min


def parse_offsets(texts: pd.Series) -> np.ndarray:
    """Seconds east of UTC of cleaned offset texts, NO_OFFSET where unreadable or outside -12:00 to +14:00."""
    out = np.full(len(texts), NO_OFFSET, np.int64)
    values = texts.to_numpy(object)
    codes, distinct = pd.factorize(values)
    for i, text in enumerate(distinct):
        if text.lower() in UTC_NAMES:
            out[codes == i] = 0
        elif m := re.fullmatch(_OFFSET, text.upper()):
            hours, minutes = int(m["oh"]), int(m["om"] or 0)
            seconds = (hours * 3600 + minutes * 60) * (-1 if m["sign"] == "-" else 1)
            if minutes < 60 and MIN_OFFSET <= seconds <= MAX_OFFSET:
                out[codes == i] = seconds
    return out


def _numbers(x: pd.Series, default: int = -1) -> np.ndarray:
    return pd.to_numeric(x, errors="coerce").fillna(default).to_numpy(np.int64)


def _micros(digits: pd.Series) -> np.ndarray:
    has = digits.notna()
    cut = digits.where(has, "0").str[:6].str.pad(6, side="right", fillchar="0")
    return np.where(has, cut.astype(np.int64), -1)


def parse_moments(texts: pd.Series) -> Parsed:
    """Parse cleaned texts, one parser per distinct mask."""
    n = len(texts)
    out = Parsed(np.zeros(n, bool), np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, NO_OFFSET, np.int64))
    texts = texts.reset_index(drop=True)
    codes, masks = pd.factorize(mask_of(texts))
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(masks) + 1))
    for i, mask in enumerate(masks):
        at = order[bounds[i] : bounds[i + 1]]
        for pattern in parser_for(mask):
            if not len(at):
                break
            got = texts.iloc[at].str.extract(f"^(?:{pattern.pattern})$")
            hit = got.notna().any(axis=1).to_numpy()
            _fill(out, at[hit], got[hit])
            at = at[~hit]
    return out


def _fill(out: Parsed, at: np.ndarray, got: pd.DataFrame) -> None:
    if not len(at):
        return
    if "epoch" in got:
        size = got["epoch"].str.len().to_numpy()
        value = got["epoch"].astype(np.int64).to_numpy()
        unit = 10 ** (size - 10)
        out.valid[at], out.offset[at] = True, 0
        out.seconds[at] = value // unit
        out.fraction[at] = np.where(size > 10, (value % unit) * US // unit, -1)
        return
    col = lambda name: got[name] if name in got else pd.Series([None] * len(got), index=got.index, dtype=object)
    year, day, hour, minute = (_numbers(col(k)) for k in ("y", "d", "h", "mi"))
    month = _numbers(col("mo")) if "mo" in got else month_of(col("mon"))
    second = _numbers(col("s"), 0)
    half = col("ap").str.lower()
    is12 = half.notna().to_numpy()
    ok = (hour >= 0) & (hour < 24) & (minute < 60) & (second < 60) & (~is12 | ((hour >= 1) & (hour <= 12)))
    hour = np.where(is12, hour % 12 + np.where((half == "p").to_numpy(), 12, 0), hour)
    ok &= (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1)
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(month, 0, 12)]
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    ok &= day <= length + ((month == 2) & leap)
    safe = np.where(ok, year, 2000), np.where(ok, month, 1), np.where(ok, day, 1)
    months = (safe[0] - 1970) * 12 + safe[1] - 1
    days = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + safe[2] - 1
    zone = col("z")
    carried = zone.notna().to_numpy()
    offsets = parse_offsets(zone.fillna("").str.replace(r"\s", "", regex=True))
    out.valid[at] = ok
    out.seconds[at] = days * 86400 + hour * 3600 + minute * 60 + second
    out.fraction[at] = _micros(col("f"))
    out.offset[at] = np.where(carried, offsets, NO_OFFSET)

