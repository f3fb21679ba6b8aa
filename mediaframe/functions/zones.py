"""Versioned transition tables of time zones, built once on the driver and shipped to the workers."""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from importlib import metadata, resources
from zoneinfo import ZoneInfo

import numpy as np

#: Years whose changes are listed.  No zone changed before; after the last listed change of a law the calendar, and
#: with it the rule of every zone, repeats every 400 years, so later moments are looked up in the last such cycle.
FIRST_YEAR, LAST_YEAR = 1800, 2500
SECOND = 1_000_000
CYCLE = 146_097 * 86_400 * SECOND  # 400 years


def database_version() -> str:
    """Version of the zone data that ``zoneinfo`` reads, such as 2026a."""
    for root in ("/usr/share/zoneinfo", "/usr/lib/zoneinfo"):
        try:
            with open(f"{root}/tzdata.zi") as f:
                return f.readline().split()[-1]
        except (OSError, IndexError):
            pass
    try:
        return resources.files("tzdata").joinpath("zones").parent.joinpath("__init__.py").read_text().split('IANA_VERSION = "')[1].split('"')[0]
    except (ModuleNotFoundError, IndexError, OSError):
        try:
            return metadata.version("tzdata")
        except metadata.PackageNotFoundError:
            return "unknown"


@dataclass(frozen=True)
class ZoneTable:
    """Offsets of one zone: from ``starts[i]`` (microseconds, UTC) on, local time is UTC plus ``offsets[i]``."""

    zone: str
    version: str
    starts: np.ndarray
    offsets: np.ndarray

    def to_utc(self, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTC microseconds, number of instants: 0, 1 or 2) of local microseconds, vectorised.

        An instant is right if its offset, applied to the local time, falls into the span of that offset;
        only the spans around the local time can hold one."""
        last_day = (LAST_YEAR - 1970) * 365 * 86_400 * SECOND  # some time before the end of the last year
        cycles = np.maximum(0, -((last_day - local) // CYCLE))
        found, count = self._listed(local - cycles * CYCLE)
        return found + cycles * CYCLE, count

    def _listed(self, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, count = np.zeros_like(local), np.zeros(len(local), np.int8)
        at = np.searchsorted(self.starts, local, side="right") - 1
        last = len(self.starts) - 1
        for step in (-2, -1, 0, 1, 2):
            i = at + step
            inside = (i >= 0) & (i <= last)
            i = np.clip(i, 0, last)
            utc = local - self.offsets[i]
            ends = np.where(i < last, self.starts[np.minimum(i + 1, last)], np.iinfo(np.int64).max)
            hit = inside & (utc >= self.starts[i]) & (utc < ends)
            found = np.where(hit & (count == 0), utc, found)
            count += hit.astype(np.int8)
        return found, count


@functools.cache
def zone_table(zone: str) -> ZoneTable | None:
    """The table of an IANA zone, None if the database does not know it."""
    try:
        info = ZoneInfo(zone)
    except (KeyError, ValueError, OSError):
        return None
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    offset = lambda s: int((epoch + timedelta(seconds=s)).astimezone(info).utcoffset().total_seconds())
    begin = int((datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds())
    end = int((datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds())
    starts, offsets, step = [np.iinfo(np.int64).min // 4], [offset(begin)], 5 * 86400
    for t in range(begin, end, step):
        if offset(t + step) != offsets[-1]:
            lo, hi = t, t + step
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == offsets[-1] else (lo, mid)
            starts.append(hi * SECOND)
            offsets.append(offset(hi))
    return ZoneTable(zone, database_version(), np.array(starts, np.int64), np.array(offsets, np.int64) * SECOND)


def zone_tables(zones: Iterable[str]) -> dict[str, ZoneTable]:
    return {z: t for z in set(zones) if z and (t := zone_table(z)) is not None}
