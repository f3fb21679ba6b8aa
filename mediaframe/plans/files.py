"""Queries of sources, sinks and the operators around files, over the driver's tables, with the SQL that checks them.

Files are made of whole tables in the shared folder and read back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.functions import dates, scalars, text, vectors
from mediaframe.operators import features, geo, graph, groups, hashing, ordering, priority, rename, simjoin, stats
from mediaframe.plans.tables import table
from mediaframe.session import staged_path
from mediaframe.sources import exif, image_meta, readers, sinks
from mediaframe.streaming.rescan import rescan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# tables through files ----------------------------------------------------------------------------------------------

_PART = "select p_partkey, p_name, p_size from part"


def _through(s, d, suffix: str) -> DataFrame:
    path = staged_path(s, "table") + suffix
    sinks.write_table(table(s, d, "part").select("p_partkey", "p_name", "p_size"), path)
    return readers.read_table(s, path)


@query(_PART)
def file_parquet(s, d):
    return _through(s, d, ".parquet")


@query(_PART)
def file_json(s, d):
    return _through(s, d, ".json").select("p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"))


@query(_PART)
def file_csv(s, d):
    return _through(s, d, ".csv").select(F.col("p_partkey").cast("bigint"), "p_name", F.col("p_size").cast("int"))


@query("select path_a as a, path_b as b from match_pairs where path_a is not null and path_b is not null")
def file_pairs(s, d):
    path = staged_path(s, "pairs") + ".csv"
    sinks.write_pairs(table(s, d, "match_pairs").select("path_a", "path_b").filter("path_a is not null and path_b is not null"), path)
    return readers.read_pairs_csv(s, path)


@query('select group_id as "group", path from dup_groups where group_id is not null and path is not null')
def file_groups(s, d):
    path = staged_path(s, "groups") + ".csv"
    sinks.write_groups(table(s, d, "dup_groups").filter("group_id is not null and path is not null").withColumnRenamed("group_id", "group"), path)
    return readers.read_groups_csv(s, path, "group bigint, path string")


@query("""with g as (select group_id, path from dup_groups where group_id is not null and path is not null),
    bad as (select distinct group_id from g where path in (select path from g group by path having count(*) > 1))
    select group_id::varchar as "group", path from g where group_id in (select group_id from bad)""")
def file_overlap(s, d):
    path = staged_path(s, "groups")
    rows = table(s, d, "dup_groups").filter("group_id is not null and path is not null").select(F.col("group_id").alias("group"), "path")
    sinks.write_overlap(graph.overlapping_groups(rows, "group", "path").select("group", "path"), path + ".csv")
    return readers.read_table(s, path + ".bad.csv")


_REPORT = ["file_id", "device_id", "filesize", "mod_date", "width", "height", "exif_date_modified", "exif_date_taken", "exif_date_created", "maker", "model"]


@query(f"""with m as (select * from dup_groups where path is not null qualify row_number() over (partition by path order by mod_date desc nulls last,
      {", ".join(f"{c} desc nulls last" for c in _REPORT if c != "mod_date")}) = 1)
    select g.group_id as "group", g.path, {", ".join(f"m.{c}" for c in _REPORT)} from dup_groups g left join m on g.path = m.path where g.group_id is not null""")
def report_13(s, d):
    rows = table(s, d, "dup_groups")
    return sinks.duplicate_report(rows.filter("group_id is not null").select(F.col("group_id").alias("group"), "path"), rows)


@query("select row_id, width, height, maker from dup_groups where width is not null and height is not null and maker is not null")
def cache_complete(s, d):
    return readers.complete_rows(table(s, d, "dup_groups"), ["width", "height", "maker"]).select("row_id", "width", "height", "maker")


@query("""select path, arg_max(hash_id, k) as hash_id from (select path, hash_id, (batch_no, hash_id) as k from hash_result where path is not null and batch_no is not null) group by path""")
def cache_append(s, d):
    """The cache grows by one append per half of the batches; the newest version of a path counts."""
    path = staged_path(s, "cache")
    rows = table(s, d, "hash_result").filter("path is not null and batch_no is not null").select("path", "hash_id", "batch_no")
    for part in (rows.filter("batch_no <= 12"), rows.filter("batch_no > 12")):
        sinks.append_cache(part, path)
    k = F.struct("batch_no", "hash_id")
    return readers.latest_versions(s.read.parquet(path).withColumn("k", k), ("path",), "k").select("path", "hash_id")


@query("select c_custkey, upper(c_name) as c_name from customer")
def store_replaced(s, d):
    """A store that is written twice holds what came last."""
    path, rows = staged_path(s, "store"), table(s, d, "customer").select("c_custkey", "c_name")
    sinks.write_store(rows, path)
    sinks.write_store(rows.withColumn("c_name", F.upper("c_name")), path)
    return sinks.read_store(s, path)


@query("select p_brand, count(*) as n from part group by 1")
def memo_table(s, d):
    folder = staged_path(s, "memo")
    make = lambda: table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    readers.memoised(s, folder, d, make)
    return readers.memoised(s, folder, d, lambda: make().limit(0))


@query("select distinct path from meta_stats m where path is not null and not exists (select 1 from dup_groups g where g.path = m.path)")
def anti_meta(s, d):
    paths = table(s, d, "meta_stats").select("path").filter("path is not null").distinct()
    return readers.uncached(paths, table(s, d, "dup_groups").filter("path is not null"), ["path"])


# scans -------------------------------------------------------------------------------------------------------------

_ITEMS = "'item-' || item_id || case item_id % 3 when 0 then '.txt' when 1 then '.JPG' else '.mp4' end"


def _item_files(s, d) -> str:
    """One file per test item in the shared folder, named by its id."""
    folder = staged_path(s, "scan")
    k = F.col("item_id")
    ext = F.when(k % 3 == 0, ".txt").when(k % 3 == 1, ".JPG").otherwise(".mp4")
    rows = table(s, d, "eval_items").select(F.concat(F.lit("item-"), k, ext).alias("name"), F.encode("text", "utf-8").alias("content"))
    sinks.write_files(rows, folder).write.format("noop").mode("overwrite").save()
    return folder


@query(f"select {_ITEMS} as name, strlen(text)::bigint as length, sha256(text) as digest from eval_items where text is not null")
def scan_hash(s, d):
    files = readers.scan_files(s, [_item_files(s, d)])
    return files.select(text.basename(F.col("path")).alias("name"), "length", F.lower(F.hex(hashing.file_sha256(F.col("content")))).alias("digest"))


@query(f"select {_ITEMS} as name, strlen(text)::bigint as length from eval_items where text is not null and item_id % 3 = 1")
def scan_suffix(s, d):
    files = readers.scan_files(s, [_item_files(s, d)], suffixes=readers.JPEG, content=False)
    return files.select(text.basename(F.col("path")).alias("name"), "length")


@query("select case item_id % 3 when 1 then 'image' else 'video' end as kind, count(*) as n from eval_items where text is not null and item_id % 3 > 0 group by 1")
def scan_media(s, d):
    return readers.media_files(s, [_item_files(s, d)]).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"select {_ITEMS} as name, row_number() over (order by item_id) - 1 as rank from eval_items where text is not null")
def scan_natural(s, d):
    names = readers.list_folder(s, _item_files(s, d)).select(text.basename(F.col("path")).alias("name"))
    return ordering.rank_within(names, [], [text.natural_key(F.col("name"))])


@query(f"select {_ITEMS} as name from eval_items where text is not null and item_id % 3 = 1")
def scan_one_file(s, d):
    """A file that is asked for brings the pictures of its folder."""
    folder = _item_files(s, d)
    first = readers.list_folder(s, folder, readers.JPEG).first()
    files, _ = readers.resolve_paths(s, [first.path])
    return files.select(text.basename(F.col("path")).alias("name"))


@query(f"select {_ITEMS} as name, strlen(text)::bigint as filesize, sha256(text) as digest from eval_items where text is not null")
def rescan_folder(s, d):
    """Two rescans of one folder, of which the second finds nothing new."""
    folder, cache = _item_files(s, d), staged_path(s, "cache")
    for i in range(2):
        rescan(s, folder, cache, staged_path(s, f"stream{i}")).awaitTermination()
    rows = s.read.parquet(cache)
    return rows.select(text.basename(F.col("path")).alias("name"), "filesize", F.lower(F.hex("file_sha256")).alias("digest"))


@query("select vec_id, 8 as width, 8 as height, 0::bigint as n_exif from embeddings")
def image_headers(s, d):
    """Sizes out of the headers of pictures that were made of vectors."""
    v = F.transform("embedding", lambda x: (x + 1) * 127)
    grids = table(s, d, "embeddings").select(*features.grid_image(v, 8, 8, F.col("vec_id")))
    files = features.edited(grids, lambda x: x).select(F.col("origin").alias("path"), "content")
    found = image_meta.image_meta(files)
    return found.select(F.col("path").cast("bigint").alias("vec_id"), "width", "height", F.coalesce(F.length("exif"), F.lit(0)).cast("bigint").alias("n_exif"))


def _tiff_of(models: pd.Series) -> pd.Series:
    """A TIFF structure with the model as its only entry."""
    import struct

    out = []
    for m in models:
        body = m.encode("ascii") + b"\0"
        where = struct.pack("<I", 26) if len(body) > 4 else body.ljust(4, b"\0")
        out.append(b"II*\0" + struct.pack("<IHHHI", 8, 1, 272, 2, len(body)) + where + b"\0" * 4 + (body if len(body) > 4 else b""))
    return pd.Series(out)


@query("select model_id, '0th Model' as key_label, model as value_label from camera_models")
def exif_table(s, d):
    make = F.pandas_udf(_tiff_of, T.BinaryType())
    files = table(s, d, "camera_models").select(F.col("model_id").cast("string").alias("path"), make("model").alias("content"))
    return exif.exif_rows(files).select(F.col("path").cast("bigint").alias("model_id"), "key_label", "value_label")


# pictures ----------------------------------------------------------------------------------------------------------

_GREY = "(select vec_id, [floor((x::double + 1) * 127)::int for x in embedding] as g from embeddings)"


def _grids(s, d) -> DataFrame:
    v = F.transform("embedding", lambda x: (x.cast("double") + 1) * 127)
    return table(s, d, "embeddings").select(*features.grid_image(v, 8, 8, F.col("vec_id")))


@query(f"""select vec_id, list_sum(g)::double as turned_sum, (g[57])::bigint as corner from {_GREY}""")
def image_rotate(s, d):
    """The upper left pixel after a quarter turn clockwise is the lower left one."""

    def turned(x: np.ndarray) -> list[float]:
        y = features.rotate(x, 1)
        return [float(y.sum()), float(y[0, 0, 0])]

    rows = features.picture_vectors(_grids(s, d), turned)
    return rows.select(F.col("origin").cast("bigint").alias("vec_id"), F.col("vector")[0].alias("turned_sum"), F.col("vector")[1].cast("bigint").alias("corner"))


@query(f"""select vec_id, round(((g[1] + g[2] + g[9] + g[10]) / 4.0::double), 6) as first from {_GREY}""")
def image_embedding(s, d):
    """The first value of a vector that a model makes: here the mean of the first four pixels."""
    rows = features.picture_vectors(_grids(s, d), lambda x: features._resized(x, 4, 4).ravel())
    return rows.select(F.col("origin").cast("bigint").alias("vec_id"), F.round(F.col("vector")[0], 6).alias("first"))


@query(f"""with p as (select vec_id, unnest(g) as x from {_GREY}), m as (select vec_id, min(x) as lo, max(x) as hi from p group by 1)
    select vec_id, count(*) filter (x = lo) as darkest, count(*) filter (x = hi) as brightest from p join m using (vec_id) group by 1""")
def image_autocontrast(s, d):
    count = lambda x: (lambda y: [int((y == 0).sum()), int((y == 255).sum())])(features.autocontrast(x))
    rows = features.picture_vectors(_grids(s, d), count)
    return rows.select(F.col("origin").cast("bigint").alias("vec_id"), F.col("vector")[0].cast("bigint").alias("darkest"), F.col("vector")[1].cast("bigint").alias("brightest"))


@query("select vec_id, null::double as brisque, null::double as nima from embeddings")
def image_model_scores(s, d):
    """Scores of models that are not there are null."""
    return features.model_scores(_grids(s, d), {}, ["brisque", "nima"]).select(F.col("origin").cast("bigint").alias("vec_id"), "brisque", "nima")


@query(f"""select vec_id, (row_number() over (partition by vec_id order by p) - 1)::int as no, (p - 1)::int as at, x::double as value
    from (select vec_id, unnest(g) as x, generate_subscripts(g, 1) as p from {_GREY}) where x > 160""")
def image_features(s, d):
    """None to many features per picture: its pixels above 160, in their order."""

    def bright(x: np.ndarray) -> list:
        at = np.flatnonzero(x.ravel() > 160)
        return [((i // 8, i % 8 + 1, i // 8 + 1, i % 8), x.ravel()[i : i + 1]) for i in at]

    rows = features.features(_grids(s, d), bright)
    return rows.select(F.col("origin").cast("bigint").alias("vec_id"), "no", (F.col("top") * 8 + F.col("left")).alias("at"), F.col("vector")[0].alias("value"))


# metadata ----------------------------------------------------------------------------------------------------------


@query("""with f as (select row_id, file_id, device_id, path from dup_groups where path is not null),
    l as (select device_id, file_id, arg_min(path, row_id) as first_path, count(distinct path) as n_links from f where device_id is not null and file_id is not null group by all)
    select row_id, f.path, coalesce(l.first_path, f.path) as first_path, coalesce(l.n_links, 1) as n_links from f left join l using (device_id, file_id)""")
def hard_links(s, d):
    rows = table(s, d, "dup_groups").filter("path is not null").select("row_id", "file_id", "device_id", "path")
    return groups.hard_links(rows, "device_id", "file_id", "path", "row_id").select("row_id", "path", "first_path", "n_links")


@query("select group_id, arg_min(path, (coalesce(priority, 99), row_id)) as path from dup_groups where group_id is not null group by 1")
def reference_path(s, d):
    rows = table(s, d, "dup_groups").filter("group_id is not null").select("row_id", "group_id", "path", F.coalesce("priority", F.lit(99)).alias("was"))
    ranked = groups.priorities(rows, "group_id", [F.col("was"), F.col("row_id")])
    return groups.lookup_one(ranked, "group_id", F.col("priority") == 0, "path")


@query("""select key, string_agg(x, ';' order by key_label, value_type) as entries from (select distinct key, key_label, value_type, key_label || '=' || value_type as x from label_types) group by 1""")
def label_sets(s, d):
    got = stats.value_sets(table(s, d, "label_types"), "key", ["key_label", "value_type"])
    return got.select("key", F.array_join(F.transform("values", lambda v: F.concat(v["key_label"], F.lit("="), v["value_type"])), ";").alias("entries"))


@query("""select path, string_agg(group_id, ',' order by group_id) as groups from (select distinct path, group_id from dup_groups where path is not null and group_id is not null) group by 1 having count(*) > 0""")
def groups_of_path(s, d):
    rows = table(s, d, "dup_groups").filter("path is not null and group_id is not null")
    got = stats.value_sets(rows, "path", ["group_id"])
    return got.select("path", F.array_join(F.transform("values", lambda v: v["group_id"].cast("string")), ",").alias("groups"))


@query("select distinct unnest(string_split(lower(p_name), ' ')) as word from part order by 1")
def distinct_words(s, d):
    return stats.distinct_sorted(table(s, d, "part").select(F.split(F.lower("p_name"), " ").alias("word")), "word")


@query("""select o_orderpriority, count(*) as count, row_number() over (order by count(*), o_orderpriority) - 1 as rank from orders group by 1""")
def count_ranked(s, d):
    counted = stats.count_by(table(s, d, "orders"), "o_orderpriority", ranked=True)
    return ordering.rank_within(counted, [], [F.col("count"), F.col("o_orderpriority")])


@query("select c_custkey, row_number() over (order by c_nationkey nulls last, c_mktsegment nulls last, c_custkey) - 1 as rank from customer")
def lexicographic(s, d):
    return ordering.rank_rows(table(s, d, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), ["c_nationkey", "c_mktsegment", "c_custkey"]).select("c_custkey", "rank")


@query("""with p as (select c_custkey, [0.1 + (c_custkey % 7) / 10.0::double, 0.9 - (c_custkey % 7) / 10.0::double] as q, c_custkey % 2 as label from customer)
    select round(avg(-ln(q[label + 1])), 9) as cross_entropy from p""")
def entropy(s, d):
    k = F.col("c_custkey")
    q = F.array(0.1 + (k % 7) / 10.0, 0.9 - (k % 7) / 10.0)
    return stats.cross_entropy(table(s, d, "customer").select(q.alias("q"), (k % 2).alias("label")), "q", "label").select(F.round("cross_entropy", 9).alias("cross_entropy"))


@query("select row_id, width::bigint * height * 3 as n_bytes, width::bigint as last from dup_groups where width is not null and height is not null")
def shape_product(s, d):
    rows = table(s, d, "dup_groups").filter("width is not null and height is not null")
    whole = vectors.concatenated(F.array(F.array("width", "height"), F.array(F.lit(3), F.col("width"))))
    return rows.select("row_id", vectors.product(F.array(F.col("width"), F.col("height"), F.lit(3))).alias("n_bytes"), whole[3].cast("bigint").alias("last"))


@query("""select c_custkey from customer union all select s_suppkey + 1000000 from supplier""")
def union_of_chunks(s, d):
    a = table(s, d, "customer").select("c_custkey")
    b = table(s, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("c_custkey"))
    return stats.union_all([a, b], a)


@query("select row_id, filesize, mod_date, maker, model from dup_groups")
def available(s, d):
    rows = table(s, d, "dup_groups")
    left = stats.other_columns(rows.columns, ["priority"])
    return stats.available_columns(rows.select(left), ("row_id", "filesize", "mod_date", "maker", "model", "iso"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as modified, case when o_orderkey % 3 = 0 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as original,
    case when o_orderkey % 3 = 0 then 7200 end as east, null::varchar as digitized from orders""")
def exif_three_dates(s, d):
    k, raw = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    entries = F.map_filter(
        F.create_map(
            F.lit("0th-DateTime"), raw, F.lit("Exif-DateTimeOriginal"), F.when(k % 3 == 0, raw), F.lit("Exif-OffsetTimeOriginal"), F.lit("+02:00"),
            F.lit("Exif-DateTimeDigitized"), F.lit("broken"),
        ),
        lambda _, v: v.isNotNull(),
    )
    x = dates.exif_dates(entries)
    shown = lambda n: F.date_format(x[n]["local"], "yyyy-MM-dd HH:mm:ss").alias(n)
    return table(s, d, "orders").select("o_orderkey", shown("modified"), shown("original"), x["original"]["offset_seconds"].alias("east"), shown("digitized"))


@query("""select o_orderkey, strftime(o_orderdate + to_microseconds(case when o_orderkey % 2 = 0 then 250000 else 0 end), '%Y-%m-%d') as day,
    strftime(o_orderdate, '%H:%M:%S') || case when o_orderkey % 2 = 0 then '.250000' else '' end as time from orders""")
def iso_parts(s, d):
    ts = F.col("o_orderdate").cast("timestamp_ntz") + F.make_interval(secs=F.when(F.col("o_orderkey") % 2 == 0, 0.25).otherwise(0.0).cast("decimal(8,6)"))
    return table(s, d, "orders").select("o_orderkey", dates.iso_date(ts).alias("day"), dates.iso_time(ts).alias("time"))


@query("""select c_custkey, case when c_custkey % 61 = 60 then null else make_timestamp(2020, 1 + c_custkey % 12, 1 + c_custkey % 28, c_custkey % 24, c_custkey % 60, (c_custkey % 59) + 0.5::double) end as utc
    from customer""")
def gps_moments(s, d):
    k = F.col("c_custkey")
    day = F.when(k % 61 == 60, "2020:13:01").otherwise(F.concat(F.lit("2020:"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lit(":"), F.lpad((1 + k % 28).cast("string"), 2, "0")))
    return table(s, d, "customer").select("c_custkey", dates.gps_moment(day, (k % 24).cast("int"), (k % 60).cast("int"), 2 * (k % 59) + 1, F.lit(2)).alias("utc"))


_POINT = "(c_custkey * 37 % 180) - 90 + 0.25::double as lat, (c_custkey * 53 % 360) - 180 + 0.5::double as lon"
_PLACE = "(n_nationkey * 41 % 170) - 85::double as lat, (n_nationkey * 97 % 360) - 180::double as lon"


@query(f"""with p as (select c_custkey, {_POINT} from customer), q as (select n_name, {_PLACE} from nation),
    r as (select c_custkey, n_name, 2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2)))) as km from p, q)
    select c_custkey, arg_min(n_name, km) as n_name, round(min(km), 3) as km from r group by 1""")
def nearest_city(s, d):
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    points = table(s, d, "customer").select("c_custkey", ((k * 37) % 180 - 90 + 0.25).alias("lat"), ((k * 53) % 360 - 180 + 0.5).alias("lon"))
    places = table(s, d, "nation").select("n_name", ((n * 41) % 170 - 85).cast("double").alias("lat"), ((n * 97) % 360 - 180).cast("double").alias("lon"))
    return geo.nearest_place(points, places, "c_custkey", "n_name").select("c_custkey", "n_name", F.round("km", 3).alias("km"))


@query("select c_custkey, 0.0::double as off from customer")
def geodesic(s, d):
    """On a meridian at the equator the ellipsoid's degree is 110.574 km; 0 says that all distances agree with that to a metre."""
    k = (F.col("c_custkey") % 360 - 180).cast("double")
    km = scalars.geodesic_km(F.lit(0.0) + k * 0, k, F.lit(1.0) + k * 0, k)
    return table(s, d, "customer").select("c_custkey", F.when(F.abs(km - 110.574389) < 1e-3, 0.0).otherwise(1.0).alias("off"))


@query("""select p_partkey, case when p_partkey % 5 = 0 then null else p_size end as int_value, (p_size || '.5')::double as float_value, p_size as num, 7 as den, 'x' || p_partkey as ascii_value from part""")
def exif_values(s, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    i = scalars.exif_value(F.when(k % 5 == 0, "bad").otherwise(size.cast("string")), "int")
    r = scalars.exif_value(F.concat(size, F.lit("/7")), "rational")
    return table(s, d, "part").select(
        "p_partkey", i.cast("int").alias("int_value"), scalars.exif_value(F.concat(size, F.lit(".5")), "float").alias("float_value"),
        r["num"].cast("int").alias("num"), r["den"].cast("int").alias("den"), scalars.exif_value(F.concat(F.lit("x"), k, F.lit("\0")), "ascii").alias("ascii_value"),
    )


@query("select hash_id, octet_length(hash) as n, translate(coalesce(path, ''), ' :', '--') as name from hash_result where hash is not null")
def hex_and_dashes(s, d):
    rows = table(s, d, "hash_result").filter("hash is not null")
    return rows.select("hash_id", F.length(text.hex_bytes(F.hex("hash"))).cast("bigint").alias("n"), text.dashed(F.coalesce("path", F.lit(""))).alias("name"))


@query("select p_partkey, (p_size || '/' || 1)::varchar as fraction from part")
def fractions(s, d):
    return table(s, d, "part").select("p_partkey", scalars.nice_fraction(F.col("p_size").cast("bigint") * 7, F.lit(7).cast("bigint") + F.col("p_partkey") * 0).alias("fraction"))


# plans -------------------------------------------------------------------------------------------------------------

_LIB = "select '/lib/' || (p_partkey % 10) || '/i' || p_partkey as stem, p_partkey from part"


def _library(s, d) -> DataFrame:
    """Paths of pictures and, for every third, a side file."""
    k = F.col("p_partkey")
    stem = F.concat(F.lit("/lib/"), k % 10, F.lit("/i"), k)
    rows = table(s, d, "part").select(k, stem.alias("stem"))
    return rows.select("p_partkey", F.concat("stem", F.lit(".JPG")).alias("path")).union(rows.filter(k % 3 == 0).select("p_partkey", F.concat("stem", F.lit(".AAE"))))


@query(f"with l as ({_LIB}) select stem || '.JPG' as path, stem || '.AAE' as sidecar from l where p_partkey % 3 = 0")
def sidecar_files(s, d):
    return rename.sidecars(_library(s, d), "path")


@query(f"""with l as ({_LIB}), f as (select stem || '.JPG' as src, 'picture file' as kind from l union all select stem || '.AAE', 'sidecar file' from l where p_partkey % 3 = 0)
    select src, regexp_extract(src, '^(.*)/[^/]*$', 1) || '/old/' || regexp_extract(src, '([^/]*)$', 1) as dst, kind, false as conflict from f""")
def move_files(s, d):
    return rename.move_plan(_library(s, d), "path", "old")


@query(f"""with l as ({_LIB}), f as (select stem || '.JPG' as p, 'picture file' as kind from l union all select stem || '.AAE', 'sidecar file' from l where p_partkey % 3 = 0)
    select regexp_extract(p, '^(.*)/[^/]*$', 1) || '/old/' || regexp_extract(p, '([^/]*)$', 1) as src, p as dst, kind from f""")
def undo_moves(s, d):
    return rename.undo_plan(rename.move_plan(_library(s, d), "path", "old"))


@query(f"with l as ({_LIB}) select stem || '.JPG' as path, stem || '.pp.JPG' as output from l where p_partkey % 4 <> 0")
def pending(s, d):
    """Every fourth picture has its output already."""
    rows = _library(s, d).filter("path like '%JPG'")
    done = rows.filter("p_partkey % 4 = 0").select(F.regexp_replace("path", r"\.JPG$", ".pp.JPG").alias("path"))
    return rename.pending_outputs(rows.select("path").union(done), "path")


@query("""select p_partkey, (row_number() over (partition by p_brand order by p_name is null, lower(p_name) = p_name, p_type, length(p_name) desc, p_partkey) - 1)::int as priority
    from part""")
def prioritise_json(s, d):
    """Commands as JSON texts: whether there is a name, whether it matches, the type by letters, long names first."""
    commands = [
        '{"column": "p_size", "function": "Available"}', '{"column": "p_name", "function": "Match regex", "args": [".*[A-Z]"], "order": "asc"}',
        '{"column": "p_type", "function": "Alphabetical"}', '{"column": "p_name", "function": "Length", "order": "desc"}',
    ]
    return priority.prioritise(table(s, d, "part"), "p_brand", commands, "p_partkey").select("p_partkey", "priority")


@query("""select item_id, case model when 'iPhone SE (2nd generation)' then 'iPhone SE 2' else model end as model from rename_items""")
def model_aliases(s, d):
    return table(s, d, "rename_items").select("item_id", rename.model_alias(F.col("model")).alias("model"))


# searches ----------------------------------------------------------------------------------------------------------


@query("""with h as (select hash_id, hash::bit as x from hash_result where octet_length(hash) = 32),
    r as (select a.hash_id as query, b.hash_id as neighbour, bit_count(xor(a.x, b.x))::int as dist from h a join h b on a.hash_id <> b.hash_id where a.hash_id % 50 = 0)
    select query, row_number() over (partition by query order by dist, neighbour) as rank, neighbour, dist from r qualify rank <= 5""")
def knn_hamming(s, d):
    rows = table(s, d, "hash_result").filter("length(hash) = 32").select("hash_id", vectors.hash_words(F.col("hash"), 32).alias("w"))
    got = simjoin.nearest_hamming(rows, rows.filter("hash_id % 50 = 0"), "hash_id", "w", 5)
    return got.select("query", F.col("rank").cast("bigint").alias("rank"), "neighbour", "dist")


@query("""with e as (select vec_id, [x::double for x in embedding] as v from embeddings),
    r as (select a.vec_id as query, b.vec_id as neighbour, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as dist from e a join e b on true where a.vec_id % 50 = 0),
    k as (select query, neighbour, row_number() over (partition by query order by dist, neighbour) as rank from r qualify rank <= 4)
    select query, string_agg(neighbour, ',' order by rank) as neighbours from k group by 1""")
def knn_matrix(s, d):
    emb = table(s, d, "embeddings")
    got = simjoin.neighbour_lists(simjoin.nearest(emb, emb.filter("vec_id % 50 = 0"), "vec_id", "embedding", 4, include_self=True))
    return got.select("query", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query("select r.r_regionkey as x, n.n_nationkey as y, (r.r_regionkey * n.n_nationkey + 1)::double as dot from region r, nation n")
def matrix_product(s, d):
    """Dot products of (region, 1) and (nation, 1), block by block."""
    one = lambda d_, k: d_.select(F.col(k).alias("k"), F.array(F.col(k).cast("double"), F.lit(1.0)).alias("v"))

    def dots(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"x": [], "y": [], "dot": []})
        p = np.stack(a.v.to_numpy()) @ np.stack(b.v.to_numpy()).T
        return pd.DataFrame({"x": np.repeat(a.k.to_numpy(), len(b)), "y": np.tile(b.k.to_numpy(), len(a)), "dot": p.ravel()})

    return simjoin.block_pairs(one(table(s, d, "region"), "r_regionkey"), one(table(s, d, "nation"), "n_nationkey"), dots, "x bigint, y bigint, dot double", 8)


@query("""with e as (select vec_id, [x::double for x in embedding] as v, label from embeddings),
    r as (select distinct b.vec_id, a.label from e b join e a on list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) <= 1.2)
    select vec_id, coalesce((select string_agg(label, ',' order by label) from r where r.vec_id = e.vec_id), '') as sure from e""")
def label_store(s, d):
    """All vectors confirmed in a store, in two batches, then matched against it."""
    emb = table(s, d, "embeddings")
    store = simjoin.LabelStore(s, staged_path(s, "labels"), "vec_id", "embedding", "label")
    first = F.xxhash64("vec_id") > 0
    for batch in (emb.filter(first), emb.filter(~first)):
        store.confirm(batch)
    return store.match(emb, 1.2, 1.2).select("vec_id", F.array_join("sure", ",").alias("sure"))


@query("""with e as (select vec_id, [x::double for x in embedding] as v from embeddings),
    r as (select a.vec_id as query, b.vec_id as neighbour, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as dist from e a join e b on true where a.vec_id % 50 = 0)
    select query, row_number() over (partition by query order by dist, neighbour) as rank, neighbour from r qualify rank <= 6""")
def flat_index(s, d):
    """An index that is built of two batches, searched with the stated query set."""
    emb = table(s, d, "embeddings")
    index = simjoin.FlatIndex(s, staged_path(s, "flat"), "l2-squared")
    first = F.xxhash64("vec_id") > 0
    for batch in (emb.filter(first), emb.filter(~first)):
        index.add(batch, "vec_id", "embedding")
    got = index.search(emb.filter("vec_id % 50 = 0"), "vec_id", "embedding", 6)
    return got.select("query", F.col("rank").cast("bigint").alias("rank"), "neighbour")


@query("""with r as (select p_partkey, p_name, row_number() over (order by p_partkey) - 1 as pos from part)
    select a.p_name as a, b.p_name as b from r x join r a on a.pos = x.pos join r b on b.pos = (x.pos * 7 + 3) % (select count(*) from r)""")
def index_to_name(s, d):
    """Pairs of positions become pairs of names."""
    rows = ordering.rank_within(table(s, d, "part").select("p_partkey", "p_name"), [], [F.col("p_partkey")], "pos")
    n = rows.count()
    pairs = rows.select(F.col("pos").alias("a"), ((F.col("pos") * 7 + 3) % n).alias("b"))
    return ordering.at_positions(pairs, rows, "p_name")


@query("select p_partkey, row_number() over (order by p_partkey) - 1 as rank from part")
def by_position(s, d):
    """The order of the rows in the file, which is that of the keys."""
    rows = ordering.with_position(table(s, d, "part").select("p_partkey"))
    return ordering.rank_within(rows, [], [F.col("pos")]).select("p_partkey", "rank")


@query("select p_brand, avg(p_size) as size, count(*) as n from part group by 1")
def sql_free(s, d):
    return stats.sql(table(s, d, "part"), "select p_brand, avg(p_size) as size, count(*) as n from df group by p_brand")


@query(f"""with p as (select vec_id, unnest(g) as x from {_GREY}), c as (select vec_id, x, count(*) over (partition by vec_id order by x) as upto from p),
    m as (select vec_id, x, upto, min(upto) over (partition by vec_id) as low from c)
    select vec_id, sum(round_even((upto - low) / greatest(1, 64 - low) * 255, 0))::bigint as total from m group by 1""")
def image_equalise(s, d):
    rows = features.picture_vectors(_grids(s, d), lambda x: [int(features.equalised(x).sum())])
    return rows.select(F.col("origin").cast("bigint").alias("vec_id"), F.col("vector")[0].cast("bigint").alias("total"))


@query(f"select vec_id, list_sum(g)::bigint as total, list_min(g)::bigint as darkest from {_GREY}")
def image_grey(s, d):
    """A chain of view filters on a picture that is grey already changes nothing."""
    rows = features.picture_vectors(_grids(s, d), lambda x: [int(features.grey(x).sum()), int(features.grey(x).min())])
    return rows.select(F.col("origin").cast("bigint").alias("vec_id"), F.col("vector")[0].cast("bigint").alias("total"), F.col("vector")[1].cast("bigint").alias("darkest"))


@query("select 1000 as n, 6 as size, true as inside")
def random_rows(s, d):
    m = readers.random_matrix(s, 1000, 6, seed=3)
    inside = F.min((F.array_min("v") >= 0) & (F.array_max("v") <= 1))
    return m.agg(F.count("*").cast("int").alias("n"), F.max(F.size("v")).alias("size"), inside.alias("inside"))
