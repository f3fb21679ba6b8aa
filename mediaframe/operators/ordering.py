"""Ranks, neighbours and running sums without an unbounded group in one task.

Groups of at most ``HOT_GROUP`` rows are ordered by a window.  The others are counted first and go another way: their
rows are range-partitioned by (group, order) and sorted; a row's rank is its place in the partition plus the number of
rows of its group in the partitions before.  So a group that holds a third of all rows spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.session import stage

#: Rows up to which one task orders a group.
HOT_GROUP = 1_000_000
_PLACE = (1 << 33) - 1


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def split_hot(df: DataFrame, group: Sequence[str], most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups of at most ``most`` rows, rows of the larger ones or None).

    Groups are counted by an aggregate; only larger ones, of which there are few, are looked up in a join."""
    if not group:
        return df.limit(0), df
    most = HOT_GROUP if most is None else most
    sizes = df.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.count("*").alias("_n"))
    hot = stage(sizes.filter(F.col("_n") > most).drop("_n"), "hot")
    if hot.isEmpty():
        return df, None
    on = F.lit(True)
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return df.join(hot, on, "left_anti"), df.join(hot, on, "left_semi")


def _over(group: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(*group).orderBy(*order)


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank", most: int | None = None) -> DataFrame:
    """``df`` with the 0-based row number inside each group, in the given order; nulls of a group column form a group.

    The order has to be total (add a key) for a repeatable result."""
    plain, hot = split_hot(df, group, most)
    ranked = plain.withColumn(name, (F.row_number().over(_over(group, order)) - 1).cast("bigint")) if group else None
    if hot is None:
        return ranked
    spread = _rank_spread(hot, group, order, name)
    return spread if ranked is None else ranked.union(spread)


def _offsets(placed: DataFrame, total: Column) -> list:
    """What the partitions before each one add up to; the driver gets one number per partition."""
    sums = {r.p: r.t or 0 for r in placed.groupBy(F.shiftright("_at", 33).alias("p")).agg(total.alias("t")).collect()}
    out, so_far = [], 0
    for i in range(max(sums, default=-1) + 1):
        out.append(so_far)
        so_far += sums.get(i, 0)
    return out or [0]


def _rank_spread(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``rank_within`` for groups of any size."""
    keys = [F.col(c) for c in group]
    sort = [k.asc_nulls_last() for k in keys] + list(order)
    placed = df.repartitionByRange(_partitions(df), *sort).sortWithinPartitions(*sort)
    placed = stage(placed.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    p, at = F.shiftright("_at", 33).alias("_p"), F.col("_at").bitwiseAND(F.lit(_PLACE))
    if not group:
        before = _offsets(placed, F.count("*"))
        rank = at + F.get(F.array(*[F.lit(x).cast("bigint") for x in before]), F.shiftright("_at", 33).cast("int"))
        return placed.select(*df.columns, rank.cast("bigint").alias(name))
    parts = placed.groupBy(*group, p).agg(F.min(at).alias("_lo"), F.count("*").alias("_n"))
    # one row per group and partition, so the window sees at most as many rows of a group as there are partitions
    over = f"over (partition by {', '.join(f'`{g}`' for g in group)} order by _p rows between unbounded preceding and 1 preceding)"
    parts = parts.withColumn("_before", F.expr(f"coalesce(sum(_n) {over}, 0)")).drop("_n")
    left, right = placed.withColumn("_p", p).alias("l"), parts.alias("r")
    same = F.col("l._p") == F.col("r._p")
    for g in group:
        same &= F.col(f"l.`{g}`").eqNullSafe(F.col(f"r.`{g}`"))
    rank = F.col("l._at").bitwiseAND(F.lit(_PLACE)) - F.col("r._lo") + F.col("r._before")
    return left.join(right, same).select(*[F.col(f"l.`{c}`") for c in df.columns], rank.cast("bigint").alias(name))


def number_groups(df: DataFrame, group: str, order: Sequence[Column] | None = None, start: int = 1, name: str = "group_no") -> DataFrame:
    """(group, number): groups numbered in order, the order being columns of ``df`` (one row per group)."""
    ranked = rank_within(df, [], list(order or [F.col(group).asc_nulls_last()]), name)
    return ranked.withColumn(name, F.col(name) + start)


def running_sum(df: DataFrame, value: str, order: Sequence[Column], name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before, 0 for the first; partition totals are added up first."""
    placed = df.repartitionByRange(_partitions(df), *order).sortWithinPartitions(*order)
    placed = stage(placed.withColumn("_at", F.monotonically_increasing_id()), "running")
    kind = placed.agg(F.sum(value)).schema[0].dataType
    before = F.array(*[F.lit(x).cast(kind) for x in _offsets(placed, F.sum(value))])
    p = F.shiftright("_at", 33)
    inside = F.expr(f"coalesce(sum(`{value}`) over (partition by _p order by _at rows between unbounded preceding and 1 preceding), 0)")
    return (
        placed.withColumn("_p", p.cast("int"))
        .withColumn("_in", inside)
        .select(*df.columns, (F.col("_in") + F.get(before, F.col("_p"))).alias(name))
    )


def with_neighbours(
    df: DataFrame, group: Sequence[str], value: str, order: Sequence[Column], rank: str = "rank", ends: bool = False, most: int | None = None
) -> DataFrame:
    """``df`` with its rank, ``next_<value>`` and ``prev_<value>`` in the group, null at the borders.

    With ``ends`` also ``first_<value>`` and ``last_<value>`` of the group."""
    plain, hot = split_hot(df, group, most)
    w = _over(group, order)
    out = None
    if group:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = plain.select(
            "*",
            (F.row_number().over(w) - 1).cast("bigint").alias(rank),
            F.lead(value).over(w).alias(f"next_{value}"),
            F.lag(value).over(w).alias(f"prev_{value}"),
            *([F.first(value).over(whole).alias(f"first_{value}"), F.last(value).over(whole).alias(f"last_{value}")] if ends else []),
        )
    if hot is None:
        return out
    spread = _neighbours_spread(stage(_rank_spread(hot, group, order, rank), "ranks"), group, value, rank)
    if ends:
        spread = _with_ends(spread, group, value, rank)
    return spread if out is None else out.union(spread)


def _with_ends(ranked: DataFrame, group: Sequence[str], value: str, rank: str) -> DataFrame:
    both = [F.min_by(value, rank).alias(f"first_{value}"), F.max_by(value, rank).alias(f"last_{value}")]
    if not group:
        low, high = ranked.agg(*both).first()  # two values
        kind = ranked.schema[value].dataType
        return ranked.withColumns({f"first_{value}": F.lit(low).cast(kind), f"last_{value}": F.lit(high).cast(kind)})
    border = ranked.groupBy(*[F.col(g).alias(f"_e{i}") for i, g in enumerate(group)]).agg(*both)
    on = F.lit(True)
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_e{i}"))
    return ranked.join(border, on).drop(*[f"_e{i}" for i in range(len(group))])


def _neighbours_spread(ranked: DataFrame, group: Sequence[str], value: str, rank: str) -> DataFrame:
    """Neighbours in groups of any size: joins on group and rank."""
    side = lambda name, shift: ranked.select(
        *[F.col(g).alias(f"_{name}{i}") for i, g in enumerate(group)], (F.col(rank) + shift).alias(f"_{name}r"), F.col(value).alias(name)
    )
    out = ranked
    for name, shift in ((f"next_{value}", -1), (f"prev_{value}", 1)):
        on = F.col(rank) == F.col(f"_{name}r")
        for i, g in enumerate(group):
            on &= F.col(g).eqNullSafe(F.col(f"_{name}{i}"))
        out = out.join(side(name, shift), on, "left").drop(f"_{name}r", *[f"_{name}{i}" for i in range(len(group))])
    return out


def with_position(df: DataFrame, name: str = "pos") -> DataFrame:
    """An explicit row order for a freshly read table: file order where the source keeps one."""
    return df.withColumn(name, F.monotonically_increasing_id().cast(T.LongType()))


def rank_rows(df: DataFrame, columns: Sequence[str], name: str = "rank") -> DataFrame:
    """Rows in lexicographic order of the columns, the first one dominant, nulls last; the rest of ties by nothing."""
    return rank_within(df, [], [F.col(c).asc_nulls_last() for c in columns], name)


def at_positions(pairs: DataFrame, rows: DataFrame, column: str, pos: str = "pos", ends: Sequence[str] = ("a", "b")) -> DataFrame:
    """Pairs of positions as pairs of what stands there, by one equality join per end; positions without a row drop out."""
    out = pairs
    for e in ends:
        there = rows.select(F.col(pos).alias("_pos"), F.col(column).alias("_value"))
        out = out.join(there, F.col(e) == F.col("_pos")).drop("_pos").withColumn(e, F.col("_value")).drop("_value")
    return out
