"""Rename and move plans: tables of sources and targets, no file is touched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import text
from mediaframe.functions.scalars import lookup
from mediaframe.operators.ordering import rank_within

#: Shorter names of models (fixed values).
MODEL_ALIASES = {"iPhone SE (2nd generation)": "iPhone SE 2"}
SIDECAR_SUFFIXES = (".AAE",)


def model_alias(model: Column) -> Column:
    return F.coalesce(lookup(MODEL_ALIASES, model), model)


def rename_plan(
    df: DataFrame, path: str, pattern: str, group: str | None, order: Sequence[Column], columns: dict[str, Column]
) -> DataFrame:
    """(path, target, conflict): ``{count}`` is the 0-based place in the group; a missing value gives the old stem with
    ``.stripped``; ``conflict`` marks targets that several sources have.  Missing order values sort last."""
    named = df.withColumns({f"_c_{k}": v.cast("string") for k, v in columns.items()})
    ranked = rank_within(named, [group] if group else [], list(order), "count")
    filled = text.template(pattern, count=F.col("count"), **{k: F.col(f"_c_{k}") for k in columns})
    stem = F.coalesce(filled, F.concat(text.stem(F.col(path)), F.lit(".stripped")))
    plan = ranked.select(F.col(path).alias("path"), text.with_stem(F.col(path), stem).alias("target"))
    clash = plan.groupBy("target").agg(F.count("*").alias("n")).filter("n > 1").select("target", F.lit(True).alias("c"))
    return plan.join(clash, "target", "left").select("path", "target", F.coalesce("c", F.lit(False)).alias("conflict"))


def sidecars(files: DataFrame, path: str) -> DataFrame:
    """(path, sidecar): pictures and the side files with the same folder and stem."""
    f = files.select(F.col(path).alias("p"), text.dirname(F.col(path)).alias("dir"), text.stem(F.col(path)).alias("stem"), text.suffix(F.col(path)).alias("ext"))
    pictures = f.filter(F.upper("ext").isin(".JPG", ".HEIC", ".PNG")).select(F.col("p").alias("path"), "dir", "stem")
    side = f.filter(F.col("ext").isin(*SIDECAR_SUFFIXES)).select(F.col("p").alias("sidecar"), "dir", "stem")
    return pictures.join(side, ["dir", "stem"]).select("path", "sidecar")


def move_plan(files: DataFrame, path: str, folder: str) -> DataFrame:
    """(src, dst, kind, conflict): pictures and their side files into a sub-folder of where they lie."""
    both = files.select(F.col(path).alias("src"), F.lit("picture file").alias("kind")).union(
        sidecars(files, path).select("sidecar", F.lit("sidecar file"))
    )
    plan = both.groupBy("src").agg(F.max("kind").alias("kind")).withColumn(
        "dst", F.concat_ws("/", text.dirname(F.col("src")), F.lit(folder), text.basename(F.col("src")))
    )
    there = files.select(F.col(path).alias("dst")).distinct().withColumn("there", F.lit(True))
    return plan.join(there, "dst", "left").select("src", "dst", "kind", F.coalesce("there", F.lit(False)).alias("conflict"))


def undo_plan(moves: DataFrame) -> DataFrame:
    return moves.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind")


def pending_outputs(files: DataFrame, path: str, mark: str = ".pp") -> DataFrame:
    """(path, output): files whose output, the name with ``mark`` before the suffix, is not there yet; outputs are none."""
    p = F.col(path)
    folder = F.regexp_extract(p, r"^(.*/)?[^/]*$", 1)
    out = files.select(p.alias("path"), F.concat(folder, text.stem(p), F.lit(mark), text.suffix(p)).alias("output"))
    out = out.filter(~text.stem(F.col("path")).endswith(mark))
    return out.join(files.select(p.alias("output")).distinct(), "output", "left_anti").select("path", "output")
