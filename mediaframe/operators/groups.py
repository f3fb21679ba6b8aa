"""Duplicate groups and their curation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.operators.ordering import number_groups, rank_within, with_neighbours


def equivalence_groups(df: DataFrame, key: Column, member: str, carry: Sequence[str] = ()) -> DataFrame:
    """(group_key, member, carried columns) of keys with more than one distinct member; null keys form no group.

    Members come once, with the carried values of one of their rows.  Sizes are pre-aggregated and joined back, so no
    list of members is built."""
    pairs = df.select(key.alias("group_key"), F.col(member), *carry).filter("group_key is not null")
    pairs = pairs.groupBy("group_key", member).agg(*[F.max(c).alias(c) for c in carry]) if carry else pairs.distinct()
    sizes = pairs.groupBy("group_key").agg(F.count(member).alias("n")).filter("n > 1").select("group_key")
    return pairs.join(sizes, "group_key")


def numbered_groups(groups: DataFrame, member: str, start: int = 1) -> DataFrame:
    """``groups`` with ``group`` for the key: groups numbered by their smallest member."""
    least = groups.groupBy("group_key").agg(F.min(member).alias("least"))
    numbers = number_groups(least, "group_key", [F.col("least")], start, "group")
    return groups.join(numbers.select("group_key", "group"), "group_key").select("group", *[c for c in groups.columns if c != "group_key"])


def priorities(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """0-based priority inside each group."""
    return rank_within(df, [group], order, "priority").withColumn("priority", F.col("priority").cast("int"))


def uncheck_reference(df: DataFrame) -> DataFrame:
    """The reference row (priority 0) of a group is never marked for removal."""
    return df.withColumn("checked", F.when(F.col("priority") == 0, False).otherwise(F.col("checked")))


def set_checked(df: DataFrame, chosen: Column, value: bool = True) -> DataFrame:
    """Mark the chosen rows; reference rows cannot be marked."""
    return df.withColumn("checked", F.when(chosen & (F.col("priority") != 0), value).otherwise(F.col("checked")))


def swap_reference(df: DataFrame, group: str, chosen: Column) -> DataFrame:
    """Make the chosen row of a group its reference; the two rows change priorities.  Both have to be unmarked."""
    picked = df.filter(chosen & ~F.coalesce("checked", F.lit(False))).groupBy(group).agg(F.min("priority").alias("_old"))
    p = F.col("priority")
    new = F.when(F.col("_old").isNull(), p).when(p == F.col("_old"), 0).when(p == 0, F.col("_old")).otherwise(p)
    return df.join(picked, group, "left").withColumn("priority", new).drop("_old")


def first_rows(df: DataFrame, group: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """(group, first value of each column), by aggregation."""
    ranked = rank_within(df, [group], order, "_rank").filter("_rank = 0")
    return ranked.select(group, *[F.col(c).alias(f"first_{c}") for c in columns])


def sort_groups_by_first(
    df: DataFrame, group: str, by: str, pos: str, ascending: bool = True
) -> DataFrame:
    """``df`` with ``group_rank`` and ``row_rank``: groups ordered by ``by`` of their first row, rows as they were.

    Nulls come last in both directions; groups with equal values keep the order of their first rows."""
    first = df.groupBy(group).agg(F.min(F.struct(pos, by)).alias("f")).select(group, "f.*")
    key = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    order = number_groups(first, group, [key, F.col(pos)], 0, "group_rank").select(group, "group_rank")
    return rank_within(df, [group], [F.col(pos)], "row_rank").join(order, group)


def sort_within_groups(df: DataFrame, group: str, keys: Sequence[tuple[str | Column, bool]], pos: str, sort_groups: bool = False) -> DataFrame:
    """``df`` with ``group_rank`` and ``row_rank``: rows ordered by the keys (dominant first), ties by position.

    Groups keep the order of their first rows, or are sorted.  Nulls come last in both directions."""
    cols = [F.col(k) if isinstance(k, str) else k for k, _ in keys]
    named = df.withColumns({f"_k{i}": c for i, c in enumerate(cols)})
    order = [F.col(f"_k{i}").asc_nulls_last() if up else F.col(f"_k{i}").desc_nulls_last() for i, (_, up) in enumerate(keys)]
    ranked = rank_within(named, [group], [*order, F.col(pos)], "row_rank").drop(*[f"_k{i}" for i in range(len(cols))])
    first = df.groupBy(group).agg(F.min(pos).alias("_first"))
    by = [F.col(group).asc_nulls_last()] if sort_groups else [F.col("_first")]
    return ranked.join(number_groups(first, group, by, 0, "group_rank").select(group, "group_rank"), group)


def navigate(df: DataFrame, group: str, value: str, order: Sequence[Column]) -> DataFrame:
    """``df`` with rank, next and previous value in the group, and the first and last of the group."""
    return with_neighbours(df, [group], value, order, "rank", ends=True)


def navigate_groups(df: DataFrame, group: str, value: str, order: Sequence[Column]) -> DataFrame:
    """(group, reference value, that of the next, previous, first and last group)."""
    refs = first_rows(df, group, order, [value]).withColumnRenamed(f"first_{value}", value)
    around = with_neighbours(refs, [], value, [F.col(group)], "rank", ends=True).drop("rank")
    return around.withColumnsRenamed({f"first_{value}": "first_group", f"last_{value}": "last_group"})


def changes(df: DataFrame, group: Sequence[str], value: str, order: Sequence[Column]) -> DataFrame:
    """Rows whose value differs from the one before; no event where either is null."""
    near = with_neighbours(df, list(group), value, order, "rank")
    return near.filter(F.col(value) != F.col(f"prev_{value}"))


def hard_links(files: DataFrame, device: str, inode: str, path: str, pos: str) -> DataFrame:
    """``files`` with ``first_path`` and ``n_links``: rows of one (device, inode) are one file, of which only the first
    path, by ``pos``, is worked on.

    Rows without a device or an inode are files of their own.  The first path is an aggregate, so a file with a third
    of all paths is reduced where its rows lie."""
    known = files.filter(F.col(device).isNotNull() & F.col(inode).isNotNull())
    first = known.groupBy(device, inode).agg(F.min_by(path, pos).alias("first_path"), F.count_distinct(path).alias("n_links"))
    alone = files.filter(F.col(device).isNull() | F.col(inode).isNull())
    alone = alone.withColumns({"first_path": F.col(path), "n_links": F.lit(1).cast("bigint")})
    return known.join(first, [device, inode]).select(alone.columns).union(alone)


def lookup_one(df: DataFrame, group: str, chosen: Column, column: str) -> DataFrame:
    """(group, column) of the one chosen row of each group; none or several are an error when the group is computed."""
    found = df.groupBy(group).agg(F.count_if(chosen).alias("n"), F.max(F.when(chosen, F.struct(F.col(column)))).alias("w"))
    wrong = F.raise_error(F.concat(F.lit("rows that match in a group: "), F.col("n").cast("string")))
    return found.select(group, F.when(F.col("n") == 1, F.col(f"w.{column}")).otherwise(wrong.cast(dict(df.dtypes)[column])).alias(column))
