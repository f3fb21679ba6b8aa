"""File listings and tabular inputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.functions.text import basename, natural_key, suffix
from mediaframe.session import path_exists

#: File suffixes by kind (fixed values).
RAW = (".dng", ".arw", ".nef", ".cr2", ".cr3")
JPEG = (".jpg", ".jpeg")
HEIF = (".heic", ".heif")
TIFF = (".tif", ".tiff", ".dng", ".arw", ".nef", ".cr2")
EXIF = (*JPEG, *HEIF, *TIFF)
IMAGES = (
    ".bmp", ".gif", ".png", ".tif", ".tiff", ".webp", ".avif", *RAW, *JPEG, *HEIF,
    ".pbm", ".pgm", ".ppm", ".pnm", ".xbm", ".sgi", ".ras", ".sun",
)

CACHE_SCHEMA = (
    "path string, file_id bigint, device_id bigint, filesize bigint, mod_date timestamp, file_sha256 binary, "
    "image_sha256 binary, phash binary, width int, height int, exif binary, icc_profile binary, iptc binary, photoshop binary"
)
GROUP_TEXTS = ("path", "maker", "model", "overwrite")
GROUP_SCHEMA = (
    "group bigint, path string, file_id bigint, device_id bigint, filesize bigint, mod_date timestamp, width int, height int, "
    "exif_date_modified timestamp_ntz, exif_date_taken timestamp_ntz, exif_date_created timestamp_ntz, maker string, model string"
)


def scan_files(
    spark: SparkSession, folders: Sequence[str], recursive: bool = True, suffixes: Sequence[str] | None = None, content: bool = True
) -> DataFrame:
    """(path, modificationTime, length, content) of the files below the folders; unreadable files are left out.

    The suffix filter is on the path alone, so contents of other files are never read; without ``content`` none are."""
    read = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    out = read.option("recursiveFileLookup", str(recursive).lower()).load(list(folders))
    if suffixes is not None:
        out = out.filter(F.lower(suffix(F.col("path"))).isin(*suffixes))
    return out if content else out.drop("content")


def read_images(spark: SparkSession, folders: Sequence[str], colour_only: bool = False) -> DataFrame:
    """Decoded pixels (origin, height, width, nChannels, mode, data in BGR order); undecodable files are left out."""
    out = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(list(folders)).select("image.*")
    return out.filter("nChannels >= 3") if colour_only else out


def read_groups_csv(spark: SparkSession, path: str, schema: str = GROUP_SCHEMA) -> DataFrame:
    """A duplicate CSV: empty texts stay empty, typed columns become null."""
    out = spark.read.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").schema(schema).csv(path)
    texts = [f.name for f in out.schema if isinstance(f.dataType, T.StringType)]
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of exactly two columns as (a, b)."""
    out = spark.read.option("header", True).csv(path)
    if len(out.columns) != 2:
        raise ValueError("a pair file has two columns")
    return out.toDF("a", "b")


def _is_table(lines: DataFrame) -> bool:
    """Whether what was read as lines is one JSON table."""
    kind = dict(lines.dtypes).get("data", "")
    return kind.startswith("array<struct") and set(lines.columns) <= {"schema", "data"}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, Parquet, JSON lines or a JSON table ({"schema": …, "data": [rows]}), by the suffix and the first line."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    if path.endswith(".json"):
        lines = spark.read.json(path)
        if lines.columns and "_corrupt_record" not in lines.columns and not _is_table(lines):
            return lines
        return spark.read.option("multiLine", True).json(path).selectExpr("inline(data)")
    raise ValueError(f"unknown kind of file {path}")


def latest_versions(cache: DataFrame, keys: Sequence[str] = ("path",), order: str = "mod_date") -> DataFrame:
    """The newest row per key of an append-only cache; ties go to the larger file size."""
    rest = [c for c in cache.columns if c not in keys]
    by = F.struct(order, *(["filesize"] if "filesize" in cache.columns and order != "filesize" else []))
    best = cache.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("b"))
    return best.select(*keys, *[f"b.{c}" for c in rest])


def complete_rows(cache: DataFrame, required: Sequence[str]) -> DataFrame:
    """Cache rows that count as hits: all required columns are there."""
    out = cache
    for c in required:
        out = out.filter(F.col(c).isNotNull())
    return out


def uncached(files: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    return files.join(cache.select(*keys), list(keys), "left_anti")


def overlay_cache(files: DataFrame, cache: DataFrame, keys: Sequence[str], fresh: dict[str, Column], cached: Sequence[str]) -> DataFrame:
    """Cached columns where there are any, else the fresh expressions."""
    held = cache.select(*keys, *[F.col(c).alias(f"_{c}") for c in cached])
    out = files.join(held, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(f"_{c}"), fresh[c]) for c in cached}).drop(*[f"_{c}" for c in cached])


#: Suffixes of other media (fixed values).
VIDEO = (".mp4", ".mkv", ".avi", ".mov", ".webm", ".wmv", ".mpg", ".mpeg", ".m4v", ".flv", ".3gp", ".ts", ".ogv")
AUDIO = (".mp3", ".flac", ".wav", ".ogg", ".opus", ".m4a", ".aac", ".wma", ".aiff")


def media_files(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """(path, modificationTime, length, kind) of video, audio and image files."""
    files = scan_files(spark, folders, suffixes=(*VIDEO, *AUDIO, *IMAGES), content=False)
    ext = F.lower(suffix(F.col("path")))
    return files.withColumn("kind", F.when(ext.isin(*VIDEO), "video").when(ext.isin(*AUDIO), "audio").otherwise("image"))


def unhandled_keys(entries: DataFrame, handled: Sequence[str]) -> DataFrame:
    """(key, values): keys of (key, label, value) rows that nothing handles, with their distinct (label, value) pairs."""
    rows = entries.filter(~F.col("key").isin(*handled)) if handled else entries
    return rows.select("key", "label", "value").distinct().groupBy("key").agg(F.sort_array(F.collect_list(F.struct("label", "value"))).alias("values"))


def list_folder(spark: SparkSession, folder: str, suffixes: Sequence[str] | None = None) -> DataFrame:
    """(path, length) of one folder, not below it, in the natural order of names."""
    files = scan_files(spark, [folder], recursive=False, suffixes=suffixes, content=False)
    return files.select("path", "length").orderBy(natural_key(basename(F.col("path"))), "path")


def resolve_paths(spark: SparkSession, paths: Sequence[str], suffixes: Sequence[str] | None = IMAGES) -> tuple[DataFrame | None, str | None]:
    """(files, path to show first) of what was asked for.

    Nothing gives (None, None); one file gives its folder, with the file first, or the file alone if its suffix is not
    among those of pictures; one folder gives its files; several paths give the files named and those of the folders."""
    if not paths:
        return None, None
    jvm = spark.sparkContext._jvm
    where = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    kinds = []
    for p in where:
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        kinds.append(None if not fs.exists(p) else "dir" if fs.getFileStatus(p).isDirectory() else "file")
    if len(paths) == 1:
        if kinds[0] is None:
            raise ValueError(f"{paths[0]} is neither a file nor a folder")
        if kinds[0] == "dir":
            return list_folder(spark, paths[0], suffixes), None
        if suffixes is None or paths[0].lower().endswith(tuple(suffixes)):
            return list_folder(spark, where[0].getParent().toString(), suffixes), paths[0]
        return list_folder(spark, paths[0]), paths[0]
    some = [list_folder(spark, p, suffixes if kind == "dir" else None) for p, kind in zip(paths, kinds) if kind]
    out = some[0] if some else None
    for d in some[1:]:
        out = out.union(d)
    return out, None


def random_matrix(spark: SparkSession, rows: int, columns: int, seed: int = 0, kind: str = "float") -> DataFrame:
    """(k, v): uniform numbers from 0 to 1, or bytes, made where they are needed and the same for the same seed."""
    cell = lambda i: F.rand(seed * 1_000_003 + i)
    cells = [cell(i).cast("float") if kind == "float" else F.floor(cell(i) * 256).cast("smallint") for i in range(columns)]
    return spark.range(rows).select(F.col("id").alias("k"), F.array(*cells).alias("v"))


def config_defaults(path: str, defaults: dict) -> dict:
    """Defaults of a command overridden by a JSON file, in whose names dashes stand for underscores; unknown ones are an error."""
    with open(path, encoding="utf-8") as f:
        given = {k.replace("-", "_"): v for k, v in json.load(f).items()}
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return defaults | given


def memoised(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table that ``make`` gives, kept as files under a hash of ``key``; ``rebuild`` makes it again.

    Only a table whose write has ended is read."""
    path = f"{folder}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"
    if rebuild or not path_exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
