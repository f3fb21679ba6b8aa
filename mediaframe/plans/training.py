"""Queries of the general training-data problems: wide tables and timestamps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mediaframe.functions.shapes import MONTHS
from mediaframe.operators.timestamps import normalise_timestamps
from mediaframe.operators.wide import cell_issues, read_labels, widen
from mediaframe.plans.tables import table


def _wide(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    labels = read_labels(table(spark, d, "label_types"))
    return widen(table(spark, d, "meta_stats"), labels, oversize=True), labels


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cell_issues(*_wide(spark, d))


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    """All labels as typed columns, and the lists ``unreadable``, ``conflict`` and ``oversize`` of the cells without value."""
    return _wide(spark, d)[0]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise_timestamps(table(spark, d, "meta_stats"), table(spark, d, "devices")).select("path", "utc")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_wide": p1_wide,
    "p3_found": p3_found,
}

_TRIM = r"regexp_replace(value_label, '^[\s\x00\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x00\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g')"
_CELLS = rf"""
  labels as (select key_label, value_type, lower(regexp_replace(key_label, '\s+', '', 'g')) as k from label_types),
  vals as (select path, l.key_label, value_type, {_TRIM} as v, {_TRIM} as v0 from meta_stats m
           join labels l on lower(regexp_replace(m.key_label, '\s+', '', 'g')) = l.k
           where path is not null and value_type in ('integer', 'text')),
  nums as (select *, case when value_type = 'integer' then regexp_replace(regexp_replace(
             regexp_replace(v, '([0-9])[,''’ ]([0-9]{{3}})\b', '\1\2', 'g'),
             '([0-9])[,''’ ]([0-9]{{3}})\b', '\1\2', 'g'), '([0-9])[,''’ ]([0-9]{{3}})\b', '\1\2', 'g') end as s
           from (select * replace (translate(v, '０１２３４５６７８９', '0123456789') as v) from vals) where v <> ''),
  read as (select *, case when value_type = 'text' then v0
             when len(regexp_extract_all(s, '[0-9]+(?:[.][0-9]+)?')) = 1 and regexp_matches(s, '(^|[^0-9.])[0-9]+([.]0+)?($|[^0-9.])')
             then ltrim(regexp_replace(regexp_extract(s, '[0-9]+(?:[.][0-9]+)?'), '[.]0+$', ''), '0') end as c from nums),
  cells as (select path, key_label, value_type, min(c) as lo, max(c) as hi, bool_or(c is null) as bad from read group by all)"""

_CLOCK = r"(?:[T\s]\s*|,\s*)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*([Zz]|(?:UTC|GMT|UT|utc|gmt)?\s*[+-]\d{1,2}(?::?\d{2})?|UTC|GMT|UT|utc|gmt))?"
_DAY = r"(?:[\p{L}]{2,10}\.?,?\s+)?"
_NAME = r"([\p{L}]{3,10})\.?"
#: Notations and the places of year, month, day, hour, minute, second, fraction, half of the day and zone in them.
_FAMILIES = (
    (rf"(\d{{4}})[:\-/.](\d{{1,2}})[:\-/.](\d{{1,2}}){_CLOCK}{_ZONE}", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    (rf"(\d{{1,2}})[:\-/.](\d{{1,2}})[:\-/.](\d{{4}}){_CLOCK}{_ZONE}", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    (rf"(\d{{4}})(\d{{2}})(\d{{2}})[T\s_-]?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (rf"{_DAY}{_NAME}\s+(\d{{1,2}}){_CLOCK}{_ZONE}\s+(\d{{4}})", (9, 1, 2, 3, 4, 5, 6, 7, 8)),
    (rf"{_DAY}{_NAME}\s+(\d{{1,2}}),?\s+(\d{{4}}){_CLOCK}{_ZONE}", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    (rf"{_DAY}(\d{{1,2}})\.?[\s-]{_NAME}[\s-](\d{{4}}){_CLOCK}{_ZONE}", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    (rf"(\d{{4}})[\s-]{_NAME}[\s-](\d{{1,2}}){_CLOCK}{_ZONE}", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
)
_MONTH = "case " + " ".join(f"when strip_accents(lower({{0}})) = '{name}' then {n}" for name, n in MONTHS.items()) + " end"


def _seconds_sql(z: str) -> str:
    """Seconds east of UTC of an offset text, null where unreadable or out of range."""
    z = f"upper(regexp_replace({z}, '\\s', '', 'g'))"
    p = "^(?:UTC|GMT|UT)?([+-])(\\d{1,2}):?(\\d{2})?$"
    part = lambda i: f"coalesce(try_cast(nullif(regexp_extract({z}, '{p}', {i}), '') as int), 0)"
    total = f"(case when regexp_extract({z}, '{p}', 1) = '-' then -1 else 1 end * ({part(2)} * 3600 + {part(3)} * 60))"
    fits = f"regexp_matches({z}, '{p}') and {part(3)} < 60 and {total} between -43200 and 50400"
    return f"case when {z} in ('Z', 'UTC', 'GMT', 'UT') then 0 when {fits} then {total} end"


def _moments_sql(column: str) -> str:
    """(path, ts, micros, east) of the texts of a column that name a real day and time."""
    parts = []
    for rank, (pattern, places) in enumerate(_FAMILIES):
        get = lambda i, p=pattern: f"regexp_extract(v, '^(?:{p})$', {i})" if i else "''"
        y, mo, d, h, mi, s, f, ap, z = map(get, places)
        month = f"try_cast({mo} as int)" if pattern[places[1] - 1 :] and "p{L}" not in pattern else _MONTH.format(mo)
        parts.append(f"""select path, {rank} as rank, try_cast({y} as int) as y, {month} as mo, try_cast({d} as int) as d, try_cast({h} as int) as h,
            try_cast({mi} as int) as mi, coalesce(try_cast(nullif({s}, '') as int), 0) as s, {f} as f, lower({ap}) as ap, {z} as z
            from t where regexp_full_match(v, '{pattern}')""")
    parts.append("""select path, 9, year(e), month(e), day(e), hour(e), minute(e), second(e), f, '', 'Z' from
        (select path, make_timestamp(left(v, 10)::bigint * 1000000) as e, substr(v, 11) as f from t where regexp_full_match(v, '\\d{10}|\\d{13}|\\d{16}|\\d{19}'))""")
    return f"""select path, make_timestamp(y, mo, d, case when ap = '' then h else h % 12 + case ap when 'p' then 12 else 0 end end, mi, s) as ts,
        case when f <> '' then rpad(left(f, 6), 6, '0')::int end as micros, {_seconds_sql("z")} as east
        from (select * from (with t as (select path, {column} as v from flat where {column} is not null) {" union all ".join(parts)}) qualify row_number() over (partition by path order by rank) = 1)
        where y >= 1 and h < 24 and mi < 60 and s < 60 and (ap = '' or h between 1 and 12) and try_cast(lpad(y::varchar, 4, '0') || '-' || mo || '-' || d as date) is not null"""


_CLEAN = r"trim(regexp_replace(translate(replace(value_label, chr(0), ' '), '０１２３４５６７８９：', '0123456789:'), '[−‐-―]', '-', 'g'), ' ' || chr(9) || chr(10) || chr(13))"
_LABELS = {"original": "exifdatetimeoriginal", "sub": "exifsubsecondstimeoriginal", "given": "exifoffsettimeoriginal", "gps": "gpsgpsdatestamp"}
_UTC = "strftime({0}, '%Y-%m-%dT%H:%M:%S.') || lpad(({1})::varchar, 6, '0') || 'Z'"
_TIMES = f"""with rows as (select path, device_id, lower(regexp_replace(key_label, '\\s+', '', 'g')) as k, {_CLEAN} as v from meta_stats where value_label is not null and path is not null),
    flat as (select path, max(device_id) as device_id, {", ".join(f"max(v) filter (k = '{k}') as {n}" for n, k in _LABELS.items())} from rows group by path),
    m as ({_moments_sql("original")}), g as ({_moments_sql("gps")}),
    x as (select flat.path, m.ts, coalesce(m.micros, case when regexp_full_match(sub, '\\d+') then rpad(left(sub, 6), 6, '0')::int end, 0) as micros,
            coalesce(m.east, {_seconds_sql("given")}) as east, home_zone, g.ts - to_seconds(coalesce(g.east, 0)) as gps_ts, coalesce(g.micros, 0) as gps_micros
        from flat left join m using (path) left join g using (path) left join devices using (device_id) where original is not null),
    near as (select x.*, unnest([-1, 1]) as way from x where ts is not null and east is null and home_zone is not null),
    tried as (select path, ts, ts - (timezone(home_zone, timezone('UTC', ts + to_days(way))) - (ts + to_days(way))) as u, home_zone from near),
    homes as (select path, count(distinct u) as n, min(u) as u from tried where timezone(home_zone, timezone('UTC', u)) = ts group by path),
    y as (select x.*, case when ts is null then 'invalid' when east is not null then '' when home_zone is null then 'no zone' when coalesce(n, 0) = 0 then 'nonexistent' when n > 1 then 'ambiguous' else '' end as why,
            case when east is not null then ts - to_seconds(east) else u end as moment from x left join homes using (path))
    select path, case when why = '' then {_UTC.format("moment", "micros")} when gps_ts is not null then {_UTC.format("gps_ts", "gps_micros")} else why end as utc from y"""

ORACLE: dict[str, str] = {
    "p3_found": _TIMES,
    "p1_found": f"with {_CELLS.strip()} select path, key_label, 'unreadable' as issue from cells where bad union all "
    "select path, key_label, 'conflict' as issue from cells where lo <> hi",
}
