"""Date and time columns: lenient parsing in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaframe.functions.text import let

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_YEAR_FIRST = rf"^(\d{{4}})[:\-/.](\d{{1,2}})[:\-/.](\d{{1,2}})[T ]+{_TIME}"
_DAY_FIRST = rf"^(\d{{1,2}})[:\-/.](\d{{1,2}})[:\-/.](\d{{4}})[T ]+{_TIME}"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})$"
_CTIME = r"^[A-Za-z]{3} ([A-Za-z]{3}) +(\d{1,2}) (\d{1,2}):(\d{2}):(\d{2}) (\d{4})$"


def _ntz(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, frac: Column | None = None) -> Column:
    """Timestamp without zone, null for a day or time that does not exist."""
    two = lambda c: F.lpad(c, 2, "0")
    text = F.concat(y, F.lit("-"), two(mo), F.lit("-"), two(d), F.lit(" "), two(h), F.lit(":"), two(mi), F.lit(":"))
    text = F.concat(text, F.when(s == "", F.lit("00")).otherwise(two(s)))
    if frac is not None:
        text = F.concat(text, F.when(frac == "", F.lit("")).otherwise(F.concat(F.lit("."), F.substring(frac, 1, 6))))
    return text.try_cast("timestamp_ntz")


def moment(c: Column) -> Column:
    """Local date and time of the usual notations (year first, day first, compact, C, epoch), null if there is none.

    An offset after the time is not applied; epoch numbers give UTC."""
    g = lambda p, i: F.regexp_extract(c, p, i)
    y, d = _YEAR_FIRST, _DAY_FIRST
    hour = lambda p: F.when(c.rlike(r"(?i)pm\b"), F.pmod(g(p, 4).try_cast("int"), F.lit(12)) + 12).when(
        c.rlike(r"(?i)am\b"), F.pmod(g(p, 4).try_cast("int"), F.lit(12))
    ).otherwise(g(p, 4).try_cast("int")).cast("string")
    months = F.create_map(
        *[F.lit(x) for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()) for x in (m, str(i + 1))]
    )
    micros = F.when(c.rlike(r"^\d{10}$"), c.try_cast("bigint") * 1_000_000).when(
        c.rlike(r"^\d{13}$"), c.try_cast("bigint") * 1000
    ).when(c.rlike(r"^\d{16}$"), c.try_cast("bigint")).when(c.rlike(r"^\d{19}$"), (c.try_cast("bigint") / 1000).cast("bigint"))
    return (
        F.when(c.rlike(y), _ntz(g(y, 1), g(y, 2), g(y, 3), hour(y), g(y, 5), g(y, 6), g(y, 7)))
        .when(c.rlike(d), _ntz(g(d, 3), g(d, 2), g(d, 1), hour(d), g(d, 5), g(d, 6), g(d, 7)))
        .when(c.rlike(_COMPACT), _ntz(*[g(_COMPACT, i) for i in range(1, 7)]))
        .when(
            c.rlike(_CTIME),
            _ntz(g(_CTIME, 6), F.coalesce(months[g(_CTIME, 1)], F.lit("x")), *[g(_CTIME, i) for i in range(2, 6)]),
        )
        .otherwise(F.timestamp_micros(micros).cast("timestamp_ntz"))
    )


def moment_text(c: Column) -> Column:
    """``moment`` as ``yyyy-MM-ddTHH:mm:ss.SSSSSS``, which sorts and compares like the moment."""
    return F.date_format(moment(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def exif_datetime(date: Column, subsec: Column, offset: Column) -> Column:
    """Struct (local, offset_seconds, error) of an EXIF date with its sub-seconds and offset.

    NULs at the end and blanks are dropped, a blank date is null without error.  Without an offset the colon and
    the dash form are read, anything after the time is ignored; with one the colon form is required."""
    clean = lambda c: F.trim(F.regexp_replace(c, r"\x00+$", ""))
    d, s, o = clean(date), clean(subsec), clean(offset)
    lenient = r"^(\d+)[:\-](\d+)[:\-](\d+) (\d+):(\d+):(\d+)"
    strict = r"^(\d{4}):(\d{1,2}):(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$"
    part = lambda i: F.regexp_extract(d, lenient, i).try_cast("int")
    has_offset = F.coalesce(F.length(o) > 0, F.lit(False))
    fits = F.when(has_offset, d.rlike(strict)).otherwise(d.rlike(lenient))
    base = F.try_make_timestamp_ntz(*[part(i) for i in range(1, 6)], part(6).cast("decimal(16,6)"))
    base = F.when(fits & (part(1) > 0) & (part(6) < 60), base)
    fraction = F.when(s.rlike(r"^\d+$"), F.rpad(F.substring(s, 1, 6), 6, "0").cast("int")).otherwise(F.lit(0))
    local = base + F.make_interval(secs=fraction.cast("decimal(18,6)") / 1_000_000)
    sign = F.when(o.startswith("-"), -1).otherwise(1)
    hm = F.regexp_extract(o, r"^[+-](\d{2}):?(\d{2})$", 1), F.regexp_extract(o, r"^[+-](\d{2}):?(\d{2})$", 2)
    seconds = F.when(o.isin("Z", "z"), F.lit(0)).otherwise(
        sign * (hm[0].try_cast("int") * 3600 + hm[1].try_cast("int") * 60)
    )
    bad_offset = has_offset & seconds.isNull()
    bad_subsec = F.coalesce(F.length(s) > 0, F.lit(False)) & ~s.rlike(r"^\d+$")
    blank = d.isNull() | (d == "")
    ok = ~blank & base.isNotNull() & ~bad_offset & ~bad_subsec
    return F.struct(
        F.when(ok, local).alias("local"),
        F.when(ok & has_offset, seconds).cast("int").alias("offset_seconds"),
        (~blank & ~ok).alias("error"),
    )


def normalise_iso(c: Column, in_zone: str, out_zone: str) -> Column:
    """ISO text, with or without offset, as local time of ``out_zone``; naive text is in ``in_zone``; blank is null."""
    offset = F.regexp_extract(c, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    body = F.regexp_replace(c, r"(Z|[+-]\d{2}:?\d{2})$", "")
    local = F.when(F.trim(c) != "", F.regexp_replace(body, "T", " ").try_cast("timestamp_ntz"))
    zone = F.when(offset == "", F.lit(in_zone)).when(offset == "Z", F.lit("+00:00")).otherwise(
        F.regexp_replace(offset, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    )
    return F.convert_timezone(zone, F.lit(out_zone), local)


def from_nanos(c: Column) -> Column:
    """Nanoseconds since the epoch as a timestamp; the digits below a microsecond are cut."""
    return F.timestamp_micros(F.floor(c.try_cast("decimal(20,0)") / 1000).cast("bigint"))


def gps_moment(date: Column, hours: Column, minutes: Column, seconds: Column, second_div: Column) -> Column:
    """UTC time of a GPS date ``yyyy:MM:dd`` and rationals whose hours and minutes are whole; exact sub-seconds."""
    p = r"^(\d{4}):(\d{2}):(\d{2})$"
    y, mo, d = (F.regexp_extract(date, p, i).try_cast("int") for i in (1, 2, 3))
    whole = (seconds / F.nullif(second_div, F.lit(0))).cast("decimal(16,6)")
    return F.try_make_timestamp_ntz(y, mo, d, hours, minutes, whole)


def first_date(*columns: Column) -> Column:
    """The first available of several date sources, in the given order."""
    return F.coalesce(*columns)


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def iso_time(c: Column) -> Column:
    """Time of day as ISO text; the fraction only where there is one."""
    return F.regexp_replace(F.date_format(c, "HH:mm:ss.SSSSSS"), r"\.000000$", "")


#: Date, offset and sub-second entries of the three EXIF dates (fixed values, names of the EXIF standard).
EXIF_DATES = {
    "modified": ("0th-DateTime", "Exif-OffsetTime", "Exif-SubSecTime"),
    "original": ("Exif-DateTimeOriginal", "Exif-OffsetTimeOriginal", "Exif-SubSecTimeOriginal"),
    "digitized": ("Exif-DateTimeDigitized", "Exif-OffsetTimeDigitized", "Exif-SubSecTimeDigitized"),
}


def exif_dates(tags: Column) -> Column:
    """Struct (modified, original, digitized) of a map of EXIF entries; missing and malformed dates are null.

    Each is a struct (local, offset_seconds)."""
    out = []
    for name, (date, offset, subsec) in EXIF_DATES.items():
        read = exif_datetime(tags[date], tags[subsec], tags[offset])
        kept = lambda x: F.struct(x["local"].alias("local"), x["offset_seconds"].alias("offset_seconds"))
        out.append(let(read, lambda x: F.when(x["local"].isNotNull(), kept(x))).alias(name))
    return F.struct(*out)
