"""Queries of the media-library operators over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.functions import dates, scalars, text, vectors
from mediaframe.operators import graph, groups, hashing, ordering, priority, rename, simjoin, stats
from mediaframe.plans.tables import table
from mediaframe.sources import readers
from mediaframe.streaming.rescan import event_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# exact duplicates, hashes ------------------------------------------------------------------------------------------


@query("""with h as (select sha256(text) as h, doc_id, n_chars from documents where text is not null),
    g as (select h, min(doc_id) as m from h group by h having count(*) > 1)
    select dense_rank() over (order by g.m) as group_no, doc_id, n_chars,
      row_number() over (partition by h order by n_chars desc nulls last, doc_id) - 1 as priority from h join g using (h)""")
def dup_groups_exact(s, d):
    docs = table(s, d, "documents").filter("text is not null").select(F.sha2("text", 256).alias("h"), "doc_id", "n_chars")
    members = groups.equivalence_groups(docs, F.col("h"), "doc_id", ["n_chars"])
    numbered = groups.numbered_groups(members, "doc_id")
    ranked = groups.priorities(numbered, "group", [F.col("n_chars").desc_nulls_last(), F.col("doc_id")])
    return ranked.select(F.col("group").alias("group_no"), "doc_id", "n_chars", F.col("priority").cast("bigint").alias("priority"))


@query("select hash_id, sha256(hash) as digest from hash_result where hash is not null")
def file_hashes(s, d):
    rows = table(s, d, "hash_result").filter("hash is not null")
    return rows.select("hash_id", F.lower(F.hex(hashing.file_sha256(F.col("hash")))).alias("digest"))


# statistics --------------------------------------------------------------------------------------------------------


@query("select coalesce(nullif(event_type, 'view'), 'N/A') as event_type, count(*) as count from events group by 1")
def group_count_na(s, d):
    ev = table(s, d, "events").withColumn("event_type", F.nullif(F.col("event_type"), F.lit("view")))
    return stats.count_by(ev, "event_type")


@query("select p_partkey, p_name from part where p_type = 'ECONOMY'")
def filter_select(s, d):
    return stats.equals_text(table(s, d, "part"), "p_type", "ECONOMY", ["p_partkey", "p_name"])


@query("select p_partkey, p_name from part where p_name ilike '%RING%'")
def sql_like_ci(s, d):
    return stats.sqlite_sql(table(s, d, "part"), "select p_partkey, p_name from df where p_name like '%RING%'")


_LINES = ", ".join(f'max(case when l_linenumber = {i} then l_quantity end) as "{i}"' for i in range(1, 8))


@query(f"select l_orderkey, {_LINES} from (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity from lineitem group by all) group by 1")
def pivot_wide(s, d):
    long = table(s, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("n")).agg(F.max("l_quantity").alias("q"))
    return stats.pivot_first(long, "l_orderkey", "n", "q", stats.pivot_labels(long, "n"))


@query("select p_partkey, p_brand from part")
def drop_null_cols(s, d):
    return stats.drop_null_columns(table(s, d, "part").select("p_partkey", F.lit(None).cast("string").alias("gone"), "p_brand"))


@query("""select doc_id, lang, source from documents where doc_id <= 600 union all
    select doc_id, lang, null from documents where doc_id > 600""")
def union_keep_first(s, d):
    docs = table(s, d, "documents").withColumn("pos", F.col("doc_id"))
    first = docs.filter("doc_id <= 600").select("doc_id", "lang", "source", "pos")
    second = docs.select("doc_id", "lang", "pos")
    return stats.union_keep_first([first, second], "doc_id", "pos").select("doc_id", "lang", "source")


@query("select count(*) as n_files, count(distinct group_id) as n_groups, count_if(checked) as n_checked from dup_groups")
def totals(s, d):
    return table(s, d, "dup_groups").agg(F.count("*").alias("n_files"), F.count_distinct("group_id").alias("n_groups"), F.count_if("checked").alias("n_checked"))


@query("select group_id, max(width) as w, max(height) as h, count(path) as n from dup_groups where group_id is not null group by 1")
def group_max_size(s, d):
    return table(s, d, "dup_groups").filter("group_id is not null").groupBy("group_id").agg(F.max("width").alias("w"), F.max("height").alias("h"), F.count("path").alias("n"))


@query("select avg(case when (priority = 0) = (checked = false) then 1.0 else 0.0 end) as accuracy from dup_groups where priority is not null and checked is not null")
def accuracy(s, d):
    rows = table(s, d, "dup_groups").filter("priority is not null and checked is not null")
    return stats.accuracy(rows.select((F.col("priority") == 0).alias("p"), (~F.col("checked")).alias("a")), "p", "a")


@query("select c_custkey, start, least(7, n - start) as len from (select c_custkey, (c_custkey % 23) as n, unnest(range(0, c_custkey % 23, 7)) as start from customer)")
def slices(s, d):
    rows = table(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 23).alias("n"))
    return stats.batch_slices(rows, "n", 7).select("c_custkey", "start", "len")


@query("select c_custkey, c_name from customer order by c_name, c_custkey limit 25")
def limit_n(s, d):
    return table(s, d, "customer").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").limit(25)


# similarity --------------------------------------------------------------------------------------------------------

_VEC = "(select vec_id, [x::double for x in embedding] as v, label from embeddings)"
_L2SQ = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


_CLASSES = f"with e as {_VEC}, c as (select min(vec_id) as k, v, count(*) as n from e group by v)"


@query(f"{_CLASSES} select a.k as a, b.k as b, round({_L2SQ}, 6) as dist from c a join c b on a.k < b.k where {_L2SQ} <= 1.2")
def pairs_l2sq(s, d):
    """Pairs between the classes of equal vectors."""
    return simjoin.l2_pairs(table(s, d, "embeddings"), "vec_id", "embedding", 1.2, squared=True).withColumn("dist", F.round("dist", 6))


@query("select min(vec_id) over (partition by embedding) as class, vec_id from embeddings")
def vector_members(s, d):
    return simjoin.vector_classes(table(s, d, "embeddings"), "vec_id", "embedding")


@query(f"""with e as {_VEC}, p as (select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id <> b.vec_id where sqrt({_L2SQ}) <= 1.1)
    select vec_id, (select count(*) from p where p.a = e.vec_id) as links from e""")
def links_l2(s, d):
    emb = table(s, d, "embeddings")
    pairs, classes = simjoin.l2_pairs(emb, "vec_id", "embedding", 1.1), simjoin.vector_classes(emb, "vec_id", "embedding")
    return simjoin.link_counts(emb, pairs, "vec_id", classes)


def _hashes(s, d):
    h = table(s, d, "hash_result").filter("length(hash) = 32")
    return h.select("hash_id", vectors.hash_words(F.col("hash"), 32).alias("w"))


@query("""with c as (select hash::bit as h, min(hash_id) as k from hash_result where octet_length(hash) = 32 group by hash)
    select a.k as a, b.k as b, bit_count(xor(a.h, b.h))::int as dist from c a join c b on a.k < b.k where bit_count(xor(a.h, b.h)) <= 4""")
def pairs_hamming(s, d):
    """Pairs between the classes of equal hashes of at most 4 differing bits."""
    return simjoin.hamming_pairs(_hashes(s, d), "hash_id", "w", 256, 4)


@query("select min(hash_id) over (partition by hash) as class, hash_id from hash_result where octet_length(hash) = 32")
def hash_members(s, d):
    return simjoin.hash_classes(_hashes(s, d), "hash_id", "w")


@query(f"""with e as {_VEC}, r as (select a.vec_id as query, b.vec_id as neighbour, {_L2SQ} as dist from e a join e b on a.vec_id <> b.vec_id
    where a.vec_id % 50 = 0) select query, row_number() over (partition by query order by dist, neighbour) as rank, neighbour, round(dist, 6) as dist
    from r qualify rank <= 5""")
def knn_top5(s, d):
    emb = table(s, d, "embeddings")
    return simjoin.nearest(emb, emb.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5).select("query", F.col("rank").cast("bigint").alias("rank"), "neighbour", F.round("dist", 6).alias("dist"))


@query(f"""with e as {_VEC}, r as (select a.vec_id as query, b.vec_id as neighbour, {_L2SQ} as dist from e a join e b on true where a.vec_id % 50 = 0)
    select query, row_number() over (partition by query order by dist, neighbour) as rank, neighbour from r qualify rank <= 3""")
def knn_with_self(s, d):
    emb = table(s, d, "embeddings")
    return simjoin.nearest(emb, emb.filter("vec_id % 50 = 0"), "vec_id", "embedding", 3, include_self=True).select("query", F.col("rank").cast("bigint").alias("rank"), "neighbour")


@query(None)
def knn_approximate(s, d):
    emb = table(s, d, "embeddings")
    return simjoin.indexed_nearest(emb, emb.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5).select("query", "rank", "neighbour")


@query(f"""with e as {_VEC}, r as (select distinct a.vec_id, b.label, {_L2SQ} <= 1.2 as sure from e a join e b on {_L2SQ} <= 1.4),
    l as (select vec_id, list_sort(list(distinct label) filter (sure)) as x, list_sort(list(distinct label) filter (not sure)) as y from r group by 1)
    select vec_id, coalesce(array_to_string(x, ','), '') as sure, coalesce(array_to_string(y, ','), '') as suggested from e left join l using (vec_id)""")
def label_match(s, d):
    emb = table(s, d, "embeddings")
    got = simjoin.label_match(emb, emb, "vec_id", "embedding", "label", 1.2, 1.4)
    return got.select("vec_id", F.array_join("sure", ",").alias("sure"), F.array_join("suggested", ",").alias("suggested"))


# graph -------------------------------------------------------------------------------------------------------------

_EDGES = f"""with recursive e as {_VEC}, c as (select min(vec_id) as vec_id, v from e group by v),
    p as (select a.vec_id as a, b.vec_id as b from c a join c b on a.vec_id < b.vec_id where {_L2SQ} <= 1.3
        union all select k.vec_id, e.vec_id from c k join e using (v) where k.vec_id < e.vec_id)"""


def _edges(s, d):
    """Pairs between classes of equal vectors, and from each class to its members."""
    emb = table(s, d, "embeddings")
    pairs = simjoin.l2_pairs(emb, "vec_id", "embedding", 1.3, squared=True).select("a", "b")
    return pairs.union(simjoin.vector_classes(emb, "vec_id", "embedding").filter("class < vec_id"))


@query(f"""{_EDGES}, u as (select a as x, b as y from p union all select b, a from p),
    r as (select x, x as y from u union select r.x, u.y from r join u on r.y = u.x) select min(y) as component, x as member from r group by x""")
def components(s, d):
    return graph.connected_components(_edges(s, d))


@query(f'{_EDGES} select a as "group", b as member from p union select a, a from p')
def star_groups(s, d):
    return graph.star_groups(_edges(s, d))


@query("""with g as (select group_id, path from dup_groups where group_id is not null),
    bad as (select distinct group_id from g where path in (select path from g group by path having count(*) > 1))
    select group_id, path from g where group_id in (select group_id from bad)""")
def overlap_groups(s, d):
    rows = table(s, d, "dup_groups").filter("group_id is not null").select("group_id", "path")
    return graph.overlapping_groups(rows, "group_id", "path").select("group_id", "path")


# caches ------------------------------------------------------------------------------------------------------------


@query("""with h as (select path, max_by(hash_id, added_at) as hash_id from (select path, hash_id, epoch_us(added_at)::hugeint * 1000000 + hash_id % 1000000 as added_at
    from hash_result where path is not null) group by path), m as (select distinct path from meta_stats)
    select path, coalesce(h.hash_id, -1) as hash_id from m left join h using (path)""")
def cache_overlay(s, d):
    h = table(s, d, "hash_result").filter("path is not null")
    key = F.unix_micros("added_at").cast("decimal(30,0)") * 1000000 + F.col("hash_id") % 1000000
    latest = readers.latest_versions(h.select("path", "hash_id", key.alias("k")), ("path",), "k").select("path", "hash_id")
    files = table(s, d, "meta_stats").select("path").distinct()
    return readers.overlay_cache(files, latest, ["path"], {"hash_id": F.lit(-1).cast("bigint")}, ["hash_id"])


# curation ----------------------------------------------------------------------------------------------------------


@query("""with f as (select o_custkey, min_by(o_totalprice, o_orderkey) as v, min(o_orderkey) as p from orders group by 1)
    select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as row_rank, g as group_rank
    from orders join (select o_custkey, row_number() over (order by v desc, p) - 1 as g from f) using (o_custkey)""")
def sort_groups_first(s, d):
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return groups.sort_groups_by_first(rows, "o_custkey", "o_totalprice", "o_orderkey", ascending=False).select("o_orderkey", "o_custkey", "row_rank", "group_rank")


@query("""with f as (select o_custkey, row_number() over (order by min(o_orderkey)) - 1 as g from orders group by 1)
    select o_orderkey, row_number() over (partition by o_custkey order by o_orderpriority, o_totalprice desc, o_orderkey) - 1 as row_rank, g as group_rank
    from orders join f using (o_custkey)""")
def sort_within(s, d):
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return groups.sort_within_groups(rows, "o_custkey", [("o_orderpriority", True), ("o_totalprice", False)], "o_orderkey").select("o_orderkey", "row_rank", "group_rank")


_PRIORITY = """select p_partkey, (row_number() over (partition by p_brand order by not regexp_full_match(p_name, '.*ring.*'),
    len(regexp_extract_all(p_name, '(?i)a')) desc, length(p_name), p_size desc nulls last, p_partkey) - 1)::int as priority from part"""


@query(_PRIORITY)
def prioritise(s, d):
    commands = [
        {"column": "p_name", "function": "Match wildcards", "args": ["*ring*"], "order": "asc"},
        {"column": "p_name", "function": "Count regex", "args": ["a"], "order": "desc"},
        {"column": "p_name", "function": "Length", "args": [], "order": "asc"},
        {"column": "p_size", "function": "Value", "args": [], "order": "desc"},
    ]
    return priority.prioritise(table(s, d, "part"), "p_brand", commands, "p_partkey").select("p_partkey", "priority")


@query("""select o_orderkey, lead(o_orderkey) over w as next_key, lag(o_orderkey) over w as prev_key, first_value(o_orderkey) over w as first_key,
    last_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as last_key
    from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def nav_lead_lag(s, d):
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_orderkey").alias("key"))
    return groups.navigate(rows, "o_custkey", "key", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "next_key", "prev_key", "first_key", "last_key")


@query("""with r as (select o_custkey, min(o_orderkey) as ref from orders group by 1) select o_custkey, ref, lead(ref) over w as next_ref, lag(ref) over w as prev_ref,
    first_value(ref) over w as first_group, last_value(ref) over (order by o_custkey rows between unbounded preceding and unbounded following) as last_group
    from r window w as (order by o_custkey)""")
def nav_group(s, d):
    rows = table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("ref"))
    return groups.navigate_groups(rows, "o_custkey", "ref", [F.col("ref")])


@query("""with g as (select o_custkey, count(*) as n from orders group by 1)
    select o_custkey, n, coalesce(sum(n) over (order by o_custkey rows between unbounded preceding and 1 preceding), 0)::bigint as before from g""")
def prefix_sum(s, d):
    sizes = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return ordering.running_sum(sizes, "n", [F.col("o_custkey")], "before")


@query("""select event_id from (select event_id, ts::date as day, lag(ts::date) over (partition by user_id order by ts, event_id) as before from events)
    where day <> before""")
def date_change(s, d):
    ev = table(s, d, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"))
    return groups.changes(ev, ["user_id"], "day", [F.col("ts"), F.col("event_id")]).select("event_id")


@query("""with r as (select *, row_number() over (partition by group_id order by coalesce(priority, 99), row_id) - 1 as p from dup_groups where group_id is not null)
    select row_id, p as priority, case when p = 0 then false else checked end as checked from r""")
def set_reference(s, d):
    rows = table(s, d, "dup_groups").filter("group_id is not null").select("row_id", "group_id", "checked", F.coalesce("priority", F.lit(99)).alias("was"))
    ranked = groups.priorities(rows, "group_id", [F.col("was"), F.col("row_id")])
    return groups.uncheck_reference(ranked).select("row_id", F.col("priority").cast("bigint").alias("priority"), "checked")


@query("select row_id, case when priority <> 0 and filesize < 1000000 then true else checked end as checked from dup_groups")
def set_checked(s, d):
    rows = table(s, d, "dup_groups")
    return groups.set_checked(rows, F.col("filesize") < 1000000).select("row_id", "checked")


@query("""with r as (select row_id, group_id, row_number() over (partition by group_id order by row_id) - 1 as p from dup_groups where group_id is not null)
    select row_id, case p when 1 then 0 when 0 then case when (select count(*) from r x where x.group_id = r.group_id) > 1 then 1 else 0 end else p end as priority from r""")
def swap_reference(s, d):
    rows = table(s, d, "dup_groups").filter("group_id is not null").select("row_id", "group_id", F.lit(False).alias("checked"))
    ranked = groups.priorities(rows, "group_id", [F.col("row_id")])
    return groups.swap_reference(ranked, "group_id", F.col("priority") == 1).select("row_id", F.col("priority").cast("bigint").alias("priority"))


@query("""select p_partkey, 'brand=' || p_brand || ';note=' || p_partkey as entries from part""")
def override_map(s, d):
    start = scalars.parse_override(F.lit("{'note': 'old'}"))
    m = scalars.override(scalars.override(start, "brand", F.col("p_brand")), "note", F.col("p_partkey").cast("string"))
    text_ = F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return table(s, d, "part").select("p_partkey", text_.alias("entries"))


# scalars -----------------------------------------------------------------------------------------------------------


@query("""select o_orderkey, case when o_orderkey % 5 = 0 then null else strftime(o_orderdate + to_microseconds(case when o_orderkey % 3 = 0 then 123000 else 0 end), '%Y-%m-%d %H:%M:%S.%f') end as taken,
    case when o_orderkey % 2 = 0 and o_orderkey % 5 <> 0 then 3600 end as east from orders""")
def exif_date(s, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, "bad").otherwise(F.concat(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"), F.lit("\0")))
    sub, off = F.when(k % 3 == 0, F.lit("123\0")), F.when(k % 2 == 0, F.lit("+0100\0"))
    x = dates.exif_datetime(raw, sub, off)
    return table(s, d, "orders").select("o_orderkey", F.date_format(x["local"], "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("taken"), x["offset_seconds"].alias("east"))


@query("""select row_id, coalesce(exif_date_taken, exif_date_created, exif_date_modified) as taken from dup_groups""")
def date_coalesce(s, d):
    return table(s, d, "dup_groups").select("row_id", dates.first_date(F.col("exif_date_taken"), F.col("exif_date_created"), F.col("exif_date_modified")).alias("taken"))


@query("select o_orderkey, case when o_orderkey % 3 = 0 then o_orderdate - interval 4 hour when o_orderkey % 3 = 1 then o_orderdate - interval 10 hour end as utc from orders")
def iso_normalise(s, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    c = F.when(F.col("o_orderkey") % 3 == 0, F.concat(iso, F.lit("+04:00"))).when(F.col("o_orderkey") % 3 == 1, iso).otherwise("")
    return table(s, d, "orders").select("o_orderkey", dates.normalise_iso(c, "+10:00", "UTC").alias("utc"))


_GPS = "(c_custkey % 60 + (c_custkey % 59) / 60.0::double + (c_custkey % 47) / 3600.0::double)"


@query(f"select c_custkey, round({_GPS}, 6) as degrees from customer")
def gps_degrees(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select("c_custkey", F.round(scalars.dms_to_degrees(k % 60, k % 59, k % 47), 6).alias("degrees"))


@query(f"""with r as (select c_custkey, 2 * 6371.0088 * asin(sqrt(pow(sin(radians(48.0 - {_GPS}) / 2), 2)
      + cos(radians({_GPS})) * cos(radians(48.0)) * pow(sin(radians(11.0 - (c_custkey % 180)) / 2), 2))) as km from customer)
    select c_custkey, round(km, 3) as km, row_number() over (order by round(km, 3), c_custkey) - 1 as rank from r""")
def nearest_km(s, d):
    k = F.col("c_custkey")
    lat = scalars.dms_to_degrees(k % 60, k % 59, k % 47)
    km = F.round(scalars.haversine_km(lat, (k % 180).cast("double"), F.lit(48.0), F.lit(11.0)), 3)
    return ordering.rank_within(table(s, d, "customer").select("c_custkey", km.alias("km")), [], [F.col("km"), F.col("c_custkey")])


@query("""with r as (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_size nulls last, p_partkey) - 1 as n from part)
    select '/lib/' || p_partkey || '.jpg' as path, '/lib/' || n || '_' || replace(p_brand, ' ', '-') || '.jpg' as target,
    count(*) over (partition by n, p_brand) > 1 as conflict from r""")
def rename_plan(s, d):
    parts = table(s, d, "part").withColumn("path", F.concat(F.lit("/lib/"), F.col("p_partkey"), F.lit(".jpg")))
    brand = F.regexp_replace("p_brand", " ", "-")
    return rename.rename_plan(parts, "path", "{count}_{brand}", "p_brand", [F.col("p_size").asc_nulls_last(), F.col("p_partkey")], {"brand": brand})


@query("""select event_id, json_extract_string(props, '$.k') as k, case when event_id % 3 = 0 then null when event_id % 3 = 1 then true else false end as valid from events""")
def json_valid(s, d):
    k = F.col("event_id") % 3
    manifest = F.when(k == 1, '{"validation_status": []}').when(k == 2, '{"validation_status": [{"code": "bad"}]}')
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), scalars.manifest_valid(manifest).alias("valid"))


@query("""select p_partkey, case coalesce(nullif(p_size % 9, 0), 1) when 1 then 0 when 3 then 2 when 6 then 1 when 8 then 3 end as label,
    case p_size % 9 when 1 then 6 when 6 then 3 when 3 then 8 when 8 then 1 end as turned, (p_size + 3) % 4 as rotated,
    case p_size % 9 when 1 then 'none' when 2 then 'flip horizontal' when 3 then 'rotate 180' when 4 then 'flip vertical' when 5 then 'transpose'
      when 6 then 'rotate 90' when 7 then 'transverse' when 8 then 'rotate 270' end as op from part""")
def orient_map(s, d):
    o = F.col("p_size") % 9
    return table(s, d, "part").select(
        "p_partkey", scalars.orientation_label(F.nullif(o, F.lit(0))).alias("label"), scalars.lookup(scalars.ROTATED["cw"], o).alias("turned"),
        scalars.rotated_label(F.col("p_size"), F.lit(3)).alias("rotated"), scalars.lookup(scalars.UPRIGHT_OPS, o).alias("op"),
    )


@query("""select row_id, greatest(0, width // 4 - 100) as "left", least(width, width // 2 + 100) as "right",
    height // 2 - (height // 2) % 16 as y, height - (height // 2 - (height // 2) % 16) as h from dup_groups where width > 0 and height > 0""")
def crop_boxes(s, d):
    rows = table(s, d, "dup_groups").filter("width > 0 and height > 0")
    w, h = F.col("width"), F.col("height")
    box = scalars.crop_box(F.lit(0), F.floor(w / 2).cast("int"), h, F.floor(w / 4).cast("int"), 100, h, w)
    half = scalars.half_crop("top", w, h)
    return rows.select("row_id", box["left"].alias("left"), box["right"].alias("right"), half["y"].alias("y"), half["h"].alias("h"))


def _tv_sql(form: str) -> str:
    at = lambda y, x: f"v[{y * 8 + x + 1}]"
    cells = [f"{at(y + 1, x)} - {at(y, x)}" for y in range(7) for x in range(8)] + [f"{at(y, x + 1)} - {at(y, x)}" for y in range(8) for x in range(7)]
    return f"list_sum([{', '.join(form.format(c) for c in cells)}])"


@query(f"with e as {_VEC} select vec_id, round({_tv_sql('abs({0})')}, 6) as l1, round(sqrt({_tv_sql('({0}) * ({0})')}), 6) as l2 from e")
def tv_norms(s, d):
    v = F.col("embedding")
    return table(s, d, "embeddings").select("vec_id", F.round(vectors.total_variation(v, 8, 8, "l1"), 6).alias("l1"), F.round(vectors.total_variation(v, 8, 8), 6).alias("l2"))


def _lap_sql() -> str:
    at = lambda y, x: f"v[{y * 8 + x + 1}]"
    return ", ".join(f"{at(y - 1, x)} + {at(y + 1, x)} + {at(y, x - 1)} + {at(y, x + 1)} - 4 * {at(y, x)}" for y in range(1, 7) for x in range(1, 7))


@query(f"with e as {_VEC} select vec_id, round(list_var_pop([{_lap_sql()}]), 6) as blur from e")
def laplacian_var(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(vectors.laplacian_variance(F.col("embedding"), 8, 8), 6).alias("blur"))


@query("""select item_id, lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) as suffix, length(path) as n,
    regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, regexp_extract(path, '^(.*/)[^/]*$', 1) || 'new' || regexp_extract(filename, '(\\.[^.]+)$', 1) as renamed
    from rename_items where path is not null and filename is not null""")
def path_parts(s, d):
    rows = table(s, d, "rename_items").filter("path is not null and filename is not null")
    p = F.col("path")
    return rows.select("item_id", F.lower(text.suffix(p)).alias("suffix"), F.length(p).alias("n"), text.dirname(p).alias("folder"), text.with_stem(p, F.lit("new")).alias("renamed"))


@query("select p_partkey, round(p_size / nullif(p_partkey % 7, 0)::double, 9) as ratio from part")
def rational_value(s, d):
    return table(s, d, "part").select("p_partkey", F.round(scalars.rational(F.col("p_size"), F.col("p_partkey") % 7), 9).alias("ratio"))


@query("select row_id, make_timestamp(try_cast(value as bigint) // 1000) as modified from meta_stats where key = 'mtime' and regexp_matches(value, '^[0-9]{19}$')")
def nanos_to_time(s, d):
    rows = table(s, d, "meta_stats").filter("key = 'mtime' and value rlike '^[0-9]{19}$'")
    return rows.select("row_id", dates.from_nanos(F.col("value")).cast("timestamp_ntz").alias("modified"))


@query("select p_partkey, floor(pow(((p_size * 4) % 256) / 255.0::double, (1 / 2.2::double) / (1 / 1.8::double)) * 255)::bigint as level from part")
def gamma_levels(s, d):
    pixels = vectors.apply_table(F.array((F.col("p_size") * 4) % 256), vectors.gamma_table(1 / 1.8))
    return table(s, d, "part").select("p_partkey", pixels[0].cast("bigint").alias("level"))


@query("""select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def event_windows(s, d):
    return event_counts(table(s, d, "events")).select(F.col("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
