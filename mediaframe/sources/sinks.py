"""Tabular outputs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.session import path_exists


def write_table(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV, Parquet or JSON lines by the suffix; maps become JSON text in CSV.  ``read_table`` reads all three."""
    out = df.coalesce(1) if single else df
    if path.endswith(".parquet"):
        out.write.mode("overwrite").parquet(path)
    elif path.endswith(".json"):
        out.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif path.endswith(".csv"):
        flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.MapType | T.ArrayType | T.StructType) else F.col(f.name) for f in out.schema]
        out.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown kind of file {path}")


def write_pairs(df: DataFrame, path: str) -> None:
    write_table(df.toDF("path-a", "path-b"), path)


def write_groups(df: DataFrame, path: str) -> None:
    """(group, path), ordered inside each file."""
    out = df.select("group", "path").repartitionByRange("group", "path").sortWithinPartitions("group", "path")
    write_table(out, path)


#: Columns of a duplicate report behind group and path (fixed values, the names that the reference writes).
REPORT = (
    "file_id", "device_id", "filesize", "mod_date", "width", "height",
    "exif_date_modified", "exif_date_taken", "exif_date_created", "maker", "model",
)


def duplicate_report(groups: DataFrame, meta: DataFrame, columns: Sequence[str] = REPORT) -> DataFrame:
    """(group, path) and the eleven columns of the report, for every member of (group, path).

    Members without metadata keep their row with nulls; columns that the metadata lack are null texts, so the report
    always has its thirteen columns.  Of several rows of a path the one with the newest ``mod_date`` counts."""
    held = [c for c in columns if c in meta.columns]
    known = meta.filter("path is not null")
    rank = [F.col("mod_date")] if "mod_date" in held else []
    latest = known.groupBy("path").agg(F.max_by(F.struct(*held), F.struct(*rank, *[c for c in held if c != "mod_date"])).alias("m"))
    cells = [F.col(f"m.{c}") if c in held else F.lit(None).cast("string").alias(c) for c in columns]
    return groups.select("group", "path").join(latest, "path", "left").select("group", "path", *cells)


def append_cache(df: DataFrame, path: str) -> None:
    """New rows of the cache; versions are told apart when it is read."""
    df.write.mode("append").parquet(path)


def write_overlap(df: DataFrame, groups_path: str) -> None:
    """The bad groups next to the file of groups, as ``….bad.csv``."""
    write_table(df, groups_path.removesuffix(".csv") + ".bad.csv")


def write_store(df: DataFrame, path: str) -> None:
    """Replace a table as a whole: it is written beside the old one, which goes only when the new one is complete."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    where = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new")]
    fs = where[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(where[0]):
        fs.delete(where[0], True)
    if not fs.rename(where[1], where[0]):
        raise OSError(f"cannot put {path} into place")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_store``; a new one that was not put into place yet counts if the old one is gone."""
    return spark.read.parquet(path if path_exists(spark, path) else f"{path}.new")


def print_table(df: DataFrame, rows: int = 1000) -> None:
    """The first rows on standard output, as tab-separated lines under a header; the number of rows is a display limit."""
    print("\t".join(df.columns))
    for r in df.limit(rows).collect():
        print("\t".join("" if x is None else str(x) for x in r))


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """(name, length): write (name, content) rows as files of a folder, each task its own rows.

    A file is written under another name first and put into place complete, so a task that runs again only repeats it.
    Rows without a name or content are left out; a name with a slash is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        for b in batches:
            for name, content in zip(b.name, b.content):
                if "/" in name or name in ("", ".", ".."):
                    raise ValueError(f"{name} is no name of a file")
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(content)
                fs.move(part, f"{root}/{name}")
            yield pd.DataFrame({"name": b.name, "length": b.content.map(len)})

    rows = df.select("name", "content").filter("name is not null and content is not null")
    return rows.mapInPandas(run, "name string, length bigint")
