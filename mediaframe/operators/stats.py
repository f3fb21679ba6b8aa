"""Metadata statistics: counts, filters, unions and free SQL."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _known(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"{column} is not in the data")


def count_by(df: DataFrame, column: str, missing: str = "N/A", ranked: bool = False) -> DataFrame:
    """(column, count); nulls count under ``missing``.  ``ranked`` orders by count, then value."""
    _known(df, column)
    out = df.groupBy(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(missing)).alias(column)).count()
    return out.orderBy("count", column) if ranked else out


def equals_text(df: DataFrame, column: str, value: str, select: Sequence[str] | None = None) -> DataFrame:
    """Rows whose text column has the value; other types never equal a text."""
    _known(df, column)
    is_text = isinstance(df.schema[column].dataType, T.StringType)
    out = df.filter(F.col(f"`{column}`") == value if is_text else F.lit(False))
    return out.select(*[f"`{c}`" for c in select]) if select else out


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are null in every row; one aggregate row decides."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[f"`{c}`" for i, c in enumerate(df.columns) if counts[str(i)]])


def available_columns(df: DataFrame, wanted: Sequence[str] = ("filesize", "mod_date", "maker", "model")) -> DataFrame:
    return df.select(*[f"`{c}`" for c in wanted if c in df.columns])


def union_keep_first(frames: Sequence[DataFrame], key: str, pos: str) -> DataFrame:
    """All columns of all frames; of rows with one key the one of the first frame, smallest position, is kept.

    The winner is an aggregate, so equal keys meet on the map side first."""
    tagged = [f.withColumn("_no", F.lit(i)) for i, f in enumerate(frames)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    names = [c for c in both.columns if c not in (key, "_no")]
    order = [f"`{c}`" for c in ("_no", pos)]
    best = both.groupBy(key).agg(F.min_by(F.struct(*[f"`{c}`" for c in names]), F.struct(*order)).alias("b"))
    return best.select(key, *[F.col(f"b.`{c}`").alias(c) for c in names])


def pivot_labels(df: DataFrame, label: str, most: int = 10_000) -> list[str]:
    """The distinct labels, shorter ones first; they become columns, so more than ``most`` are an error.  Null is none."""
    rows = df.select(F.col(label).alias("x")).filter("x is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labels")
    return sorted((r.x for r in rows), key=lambda x: (len(x), x))


def pivot_first(df: DataFrame, entity: str, label: str, value: str, labels: Sequence[str]) -> DataFrame:
    """Long rows to one column per label; a cell with more than one row is an error when its row is computed."""
    wide = df.groupBy(entity).pivot(label, list(labels))
    out = wide.agg(F.max(value).alias("v"), F.count(F.lit(1)).alias("n"))
    kind = df.schema[value].dataType
    one = lambda x: F.when(
        F.col(f"`{x}_n`") > 1, F.raise_error(F.lit(f"a cell of {x} has more than one row")).cast(kind)
    ).otherwise(F.col(f"`{x}_v`"))
    return out.select(entity, *[one(x).alias(x) for x in labels])


def sql(df: DataFrame, query: str) -> DataFrame:
    """Spark SQL over the table ``df``."""
    df.createOrReplaceTempView("df")
    return df.sparkSession.sql(query)


def sqlite_dialect(query: str) -> str:
    """LIKE outside of quotes becomes ILIKE, as SQLite ignores case there; nothing else is translated."""
    parts = re.split(r"('(?:[^']|'')*'|`[^`]*`|\"[^\"]*\")", query)
    return "".join(p if i % 2 else re.sub(r"\blike\b", "ILIKE", p, flags=re.I) for i, p in enumerate(parts))


def sqlite_sql(df: DataFrame, query: str) -> DataFrame:
    return sql(df, sqlite_dialect(query))


def batch_slices(df: DataFrame, total: str, batch: int) -> DataFrame:
    """One row (start, len) per batch of each total."""
    starts = F.when(F.col(total) > 0, F.sequence(F.lit(0).cast("bigint"), F.col(total) - 1, F.lit(batch).cast("bigint")))
    rows = df.withColumn("start", F.explode(starts))
    return rows.withColumn("len", F.least(F.lit(batch).cast("bigint"), F.col(total) - F.col("start")))


def accuracy(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    return df.agg(F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("accuracy"))


def cross_entropy(df: DataFrame, probabilities: str, label: str) -> DataFrame:
    """(cross_entropy): mean of -ln of the probability that each row gives its label; labels count from 0."""
    p = F.get(F.col(probabilities), F.col(label).cast("int"))
    return df.agg(F.avg(-F.ln(F.greatest(p, F.lit(1e-300)))).alias("cross_entropy"))


def value_sets(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, values): the set of distinct tuples of the columns per key, sorted.

    Tuples are made distinct before they are collected, so a list is as long as the set and no longer."""
    rows = df.select(key, *columns).distinct()
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("values"))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """The distinct elements of a column of lists, sorted; nulls are none."""
    return df.select(F.explode(column).alias(column)).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def union_all(frames: Sequence[DataFrame], empty: DataFrame) -> DataFrame:
    """All rows of the frames by column name; without any frame the (empty) frame that names the columns."""
    out = empty.limit(0)
    for f in frames:
        out = out.unionByName(f)
    return out


def other_columns(columns: Sequence[str], without: Sequence[str]) -> list[str]:
    """The columns that are not among the others, in their order."""
    return [c for c in columns if c not in set(without)]
