"""SQL that checks the queries of this folder on whole tables.  Fixed word lists are those of the operators."""

from __future__ import annotations

from mediaframe.functions.text import LOOKALIKE_FROM, LOOKALIKE_TO
from mediaframe.llm.canonical import NO_MAKER, NOISE

_VALUES = r"""
  rows as (select case lower(regexp_replace(key_label, '\s+', '', 'g')) when '0thmodel' then '0th Model' else 'Exif Lense model' end as key_label,
             path, lower(regexp_replace(value_label, '^[\s\x00\x{A0}\x{3000}]+|[\s\x00\x{A0}\x{3000}]+$', '', 'g')) as v from meta_stats
           where lower(regexp_replace(key_label, '\s+', '', 'g')) in ('0thmodel', 'exiflensemodel') and path is not null),
  used as (select * from rows where v <> ''),
  items as (select key_label, path, 'value' as kind, v as item from used union all
            select key_label, path, 'term', unnest(regexp_extract_all(v, '[\p{L}\p{N}]+')) from used),
  totals as (select key_label, count(distinct path) as n from used group by all),
  counted as (select key_label, kind, item, count(*) as n_occurrences, count(distinct path) as n_records from items group by all),
  marked as (select c.*, case when n_records <= 2 then 'rare' when n_records > 0.06::double * t.n then 'common' end as mark
             from counted c join totals t using (key_label))"""

_DATES = "('1970-01-01 00:00:00', '1980-01-01 00:00:00', '2107-12-31 23:59:58')"
_NONE = "('', 'null', 'unknown', '????', 'n/a', '-', '(none)')"
_ORDER = f"""order by case when checked is null then 2 when checked then 1 else 0 end,
    case when priority >= 0 then priority end nulls last,
    case when mod_date::timestamp::varchar not in {_DATES} then mod_date end desc nulls last,
    case when filesize > 0 then filesize end desc nulls last, row_id"""


def _best(field: str, ok: str) -> str:
    return (
        f"select group_id, '{field}' as field, row_id from dup_groups where group_id is not null and {field} is not null "
        f"and {ok} qualify row_number() over (partition by group_id {_ORDER}) = 1"
    )


_SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_TOKENS = rf"len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]+'))"
_STRETCHES = _TOKENS.replace("(text,", "(x,")
_SOURCE = r"regexp_replace(lower(trim(source)), '[\s_-]+', '-', 'g')"

# paths in their shortest spelling: steps are put on a stack, '..' takes one off
_SHORT = """case when coalesce(p, '') = '' then null else coalesce(nullif((case when p like '/%' then '/' else '' end) || array_to_string(list_reduce(
    list_transform(list_filter(string_split(p, '/'), lambda s: s not in ('', '.')), lambda s: [s]),
    lambda done, s: case when s[1] <> '..' then list_concat(done, s) when len(done) > 0 and done[-1] <> '..' then list_slice(done, 1, len(done) - 1)
        when p like '/%' then done else list_concat(done, s) end, []::varchar[]), '/'), ''), '.') end"""
_GROUPS = f"""with recursive e as (select (select {_SHORT} from (select path_a as p)) as a, (select {_SHORT} from (select path_b as p)) as b from match_pairs),
    l as (select a, b from e where a <> b union select b, a from e where a <> b),
    r as (select a as x, a as y from l union select r.x, l.b from r join l on r.y = l.a),
    g as (select min(y) as root_path, x as path from r group by x)"""

_FULL = "".join(map(chr, range(0xFF01, 0xFF5F))).replace("'", "''")
_HALF = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_HY = r"[-\x{AD}\x{2010}\x{2011}]\p{Cf}{0,4}[ \t]*\n[ \t]*"


def _words_sql(c: str) -> str:
    """The words of a text as a list: markup, quote marks and hyphenation go first, then case, accents, width and invisible characters."""
    for pattern, by in (
        (r"\r\n?|[\x{85}\x{2028}\x{2029}]", "\n"),
        (r"(?i)</?(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|pre|blockquote)\b[^<>]*>", " "),
        (r"</?[A-Za-z][^<>]*>|<!--.*?-->", ""),
        (r"&([A-Za-z])(?:acute|grave|circ|uml|tilde|cedil|ring|caron|slash);", r"\1"),
        (r"&(?:shy|zwj|zwnj|ZeroWidthSpace|#173|#x[aA][dD]|#820[345]|#x200[bcdBCD]);", ""),
        (r"&(?:gt|#62|#x3[eE]);", ">"),
        (r"&(?:[A-Za-z]+|#\d+|#x[0-9A-Fa-f]+);", " "),
        (r"\]\([^()\s]*\)", "]"),
        (r"(?m)^[ \t\x{A0}]*(?:[>»|][ \t\x{A0}]*)+", ""),
        (rf"(\p{{L}}[\p{{M}}\p{{Cf}}]{{0,4}}){_HY}(\p{{Cf}}{{0,4}}\p{{L}})", r"\1\2"),
        (r"([\p{L}\p{N}])(?:\*{1,3}|~~|`)([\p{L}\p{N}])", r"\1\2"),
        (r"([\p{L}\p{N}])(?:\*{1,3}|~~|`)([\p{L}\p{N}])", r"\1\2"),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    c = f"strip_accents(lower(translate({c}, '{_FULL}', '{_HALF}')))"
    return rf"regexp_extract_all(regexp_replace({c}, '[\p{{M}}\p{{Cf}}\x{{115F}}\x{{1160}}\x{{3164}}\x00-\x08\x0E-\x1F\x7F]+', '', 'g'), '[\p{{L}}\p{{N}}]+')"


def _windows_sql(name: str, key: str) -> str:
    return f"""select {key}, i, array_to_string(list_slice(w, i + 1, i + 13), ' ') as g
        from (select {key}, w, unnest(range(0, len(w) - 12)) as i from (select {key}, {_words_sql("text")} as w from {name}) where len(w) > 12)"""


_LEAKS = f"""with i as ({_windows_sql("eval_items", "item_id")}), d as ({_windows_sql("documents", "doc_id")}),
    hits as (select doc_id, item_id, count(distinct i.i) as n_windows from d join i using (g) group by all)"""

# boundaries are marked with a character that no text holds, then the stretches between them are measured
_MARK = rf"replace(replace(regexp_replace(text, '([.!?])([{_SPACE}]|$)', '\1{chr(0xE000)}\2', 'g'), chr(10), chr(10) || chr(57344)), '。', '。' || chr(57344))"
_TRUST = "(case when checked is null then 0.25::double when checked then 0.5::double else 1.0::double end) * (case when priority >= 0 then 1 / (1 + priority)::double else 0.1::double end)"

_USABLE = {
    **{f: f"{f} > 0" for f in ("filesize", "width", "height")},
    **{f: f"{f}::timestamp::varchar not in {_DATES}" for f in ("mod_date", "exif_date_taken")},
    **{f: f"lower(trim({f})) not in {_NONE}" for f in ("maker", "model")},
}
_NORM = {f: f"lower(trim({f}::varchar, ' ' || chr(9) || chr(0)))" for f in _USABLE}


def _elected(f: str) -> str:
    """(group_id, row) of the field: votes added up per value, the row is the most trusted one of the value that wins."""
    return f"""(select group_id, row_id from (select *, round(sum(vote) over (partition by group_id, norm), 12) as votes from
        (select *, {_NORM[f]} as norm from aged where {f} is not null and {_USABLE[f]}))
        qualify row_number() over (partition by group_id order by votes desc, {_ORDER.removeprefix("order by")}) = 1)"""


_ELECTED = f"""with dated as (select *, case when {_USABLE["mod_date"]} then epoch_us(mod_date) / 86400000000 end as day from dup_groups where group_id is not null),
    aged as (select *, ({_TRUST} * pow(2.0::double, -coalesce(max(day) over w - coalesce(day, min(day) over w), 0) / 365.0::double))::decimal(28, 20) as vote
        from dated window w as (partition by group_id)),
    g as (select distinct group_id from ({" union all ".join(f"select group_id from {_elected(f)}" for f in _USABLE)}))
    select g.group_id, {", ".join(f"{f}.{f}, {f}.row_id as {f}_row" for f in _USABLE)}
    from g {" ".join(f"left join (select row_id, group_id, {f if f not in ('maker', 'model') else f'trim({f}) as {f}'} from dup_groups join {_elected(f)} using (group_id, row_id)) {f} on {f}.group_id = g.group_id" for f in _USABLE)}"""

# every near pair first, then the rows that have an earlier one go through a list of accepted rows one by one
_HISTORY = """with recursive h as (select hash_id as id, hash::bit as x from hash_result where octet_length(hash) = 32),
    p as (select a.id as a, b.id as b from h a join h b on a.id < b.id and bit_count(xor(a.x, b.x)) <= 10),
    q as (select id, (select list(a) from p where b = id) as before, row_number() over (order by id) as n
        from (select a as id from p union select b from p)),
    r as (select 0::bigint as n, []::bigint[] as kept union all
        select q.n, case when list_has_any(kept, coalesce(before, [])) then kept else list_append(kept, id) end from r join q on q.n = r.n + 1),
    last as (select unnest(kept) as a from r where n = (select max(n) from r))
    select min(a) as kept_id, b as dup_id from p join last using (a) where b not in (select a from last) group by b"""

_TWINS = (LOOKALIKE_FROM, LOOKALIKE_TO)


def _plain_sql(c: str) -> str:
    """A name as lower-case words of letters and of digits, ``#n`` for a generation."""
    c = f"translate(strip_accents(lower(translate(coalesce({c}, ''), '{_FULL}', '{_HALF}'))), '{_TWINS[0]}', '{_TWINS[1]}')"
    steps = [
        (r"[\p{M}\p{Cf}]+", ""), ("[^a-z0-9]+", " "), ("([a-z])([0-9])", r"\1 \2"), ("([0-9])([a-z])", r"\1 \2"),
        (r"(?:digital *)?camera\b|digital\b", " "), (r"\b(?:" + "|".join(NOISE) + r")\b", " "),
        (r"\b(?:mark|mk) *(iii|ii|iv|vi|v|i|[0-9]+)\b", r" #\1 "), (r"(^|[^#a-z])(iii|ii|iv|vi)\b", r"\1 #\2 "),
        *[(rf"#{roman}\b", f"#{n}") for roman, n in (("iii", 3), ("ii", 2), ("iv", 4), ("vi", 6), ("v", 5), ("i", 1))],
        (r"(^| )([a-z]) +([0-9]+)\b", r"\1\2\3"), (" +", " "),
    ]
    for pattern, by in steps:
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return f"trim({c})"


_GRADE = "^([a-z ]*?[a-z]{3})((?: *(?:pro|lite|plus|max|mini|ultra))+)$"
_HEAD = "regexp_replace(regexp_extract({0}, '^((?:[a-z]+(?: |$))*)', 1), ' ', '', 'g')"


def _split_sql(p: str) -> str:
    """letters and signature of a plain name."""
    body = f"case when regexp_matches({p}, '{_GRADE}') then regexp_extract({p}, '{_GRADE}', 1) else {p} end"
    sig = f"case when regexp_matches({p}, '{_GRADE}') then replace(regexp_extract({p}, '{_GRADE}', 2), ' ', '') else regexp_replace({p}, '^(?:[a-z]+(?: |$))*', '') end"
    return f"{_HEAD.format(f'({body})')} as letters, {sig} as sig"


_EDITS = "case when length({0}) <= 2 then 0 when length({0}) <= 4 then 1 when length({0}) <= 7 then 3 when length({0}) <= 12 then 4 else 5 end"
_NO = ", ".join(f"'{x.replace(' ', '')}'" for x in NO_MAKER)
# every text against every name with the same signature
_CANONICAL = f"""with forms as (select model_id, {_plain_sql("maker")} as mk, unnest([model, maker || ' ' || model, alias, maker || ' ' || alias, model_code, maker || ' ' || model_code]) as f from camera_models),
    names as (select distinct model_id, {_HEAD.format("mk")} as maker_letters, {_split_sql("p")} from (select *, {_plain_sql("f")} as p from forms where f is not null) where p <> ''),
    need as (select item_id, maker, model from rename_items where regexp_replace(model, '^[{_SPACE}\x00]+|[{_SPACE}\x00]+$', '', 'g') <> ''
        and not exists (select 1 from camera_models c where c.maker = rename_items.maker and c.model = rename_items.model)),
    pairs as (select distinct maker, model, {_plain_sql("maker")} as pm, {_plain_sql("model")} as pn from need),
    one as (select maker, model, replace(other, ' ', '') as given, {_split_sql("p")} from (select maker, model, pn as p, pm as other from pairs union all select maker, model, pm, pn from pairs)),
    texts as (select * from one union all select maker, model, given, left(letters, -1), right(letters, 1) || sig from one where length(letters) > 1 and regexp_matches(sig, '^[0-9]')),
    near as (select maker, model, model_id, levenshtein(t.letters, n.letters) as d, case when given in ({_NO}) then 0 else levenshtein(given, maker_letters) end as md, given, maker_letters
        from texts t join names n using (sig) where levenshtein(t.letters, n.letters) <= {_EDITS.format("n.letters")}),
    best as (select maker, model, model_id, min(d + md) as d from near where md = 0 or (md <= {_EDITS.format("maker_letters")} and given not in (select maker_letters from names)) group by all),
    named as (select maker, model, arg_min(model_id, d) as model_id from (select *, rank() over (partition by maker, model order by d) as r from best) where r = 1 group by maker, model having count(*) = 1)
    select item_id, coalesce(named.model_id, 0) as model_id from need left join named on need.maker is not distinct from named.maker and need.model = named.model"""

ORACLE: dict[str, str] = {
    "p4_found": _CANONICAL,
    "p2_found": _HISTORY,
    "p7_found": f"{_GROUPS} select root_path, path from g where path <> root_path",
    "p7_groups": f'{_GROUPS} select root_path as "group", path from g',
    "p8_found": f"{_LEAKS} select doc_id, item_id from hits",
    "p8_items": f"{_LEAKS} select item_id, count(*) as n_documents, max(n_windows) as most_windows from hits group by 1",
    "p5_found": f"with {_VALUES.strip()} select key_label, kind, item, mark from marked where mark is not null",
    "p5_frequencies": f"with {_VALUES.strip()} select key_label, kind, item, n_occurrences, n_records, mark from marked",
    "p6_found": " union all ".join(
        f"({_best(f, ok)})"
        for f, ok in [
            *[(f, f"{f} > 0") for f in ("filesize", "width", "height")],
            *[(f, f"{f}::timestamp::varchar not in {_DATES}") for f in ("mod_date", "exif_date_taken")],
            *[(f, f"lower(trim({f})) not in {_NONE}") for f in ("maker", "model")],
        ]
    ),
    "p6_elected": _ELECTED,
    "p9_found": f"""with d as (select {_SOURCE} as s, {_TOKENS} as n from documents where source is not null),
        m as (select *, {_SOURCE} as s from mix_sources), own as (select m.source, target_share, max_repeats, coalesce(sum(n), 0) as t
        from m left join d using (s) group by all) select source from own
        where target_share * (select sum(t) from own) > max_repeats * t""",
    "p10_found": f"""with m as (select *, {_SOURCE} as s from mix_sources),
        d as (select doc_id, {_SOURCE} as s, {_TOKENS} as n, list_max(list_transform(string_split({_MARK}, chr(57344)), lambda x: {_STRETCHES})) as longest
        from documents where source is not null and text is not null)
        select doc_id, (longest > max_tokens)::int as forced from d join m using (s) where n > max_tokens""",
}
