"""Match graphs: components, star groups, overlapping groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mediaframe.session import stage, unstage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(component, member): every vertex with the smallest vertex of its component.

    Alternates large-star and small-star steps: each vertex links its larger neighbours, then its smaller ones, to
    the smallest vertex it sees.  Every step is an aggregate and an equality join, staged as a table; it ends when the
    edges no longer change.  Null ends are ignored, a self-pair alone is a component of one."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    pairs = stage(pairs, "pairs")
    live = stage(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    before = None
    while True:
        both = live.union(live.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = large.union(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        seen = Observation()
        mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        after = moved.union(small.select("u", F.col("m").alias("v"))).distinct().observe(seen, F.count(F.lit(1)).alias("n"), mark.alias("mark"))
        after = stage(after, "star")
        unstage(live)
        live = after
        if seen.get == before:
            break
        before = seen.get
    roots = live.select(F.col("v").alias("component"), F.col("u").alias("member"))
    nodes = pairs.select(F.col("u").alias("member")).union(pairs.select("v")).distinct()
    return nodes.join(roots, "member", "left").select(F.coalesce("component", "member").alias("component"), "member")


def star_groups(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(group, member): each first end with itself and its second ends; groups may overlap."""
    return edges.select(F.col(a).alias("group"), F.col(b).alias("member")).union(
        edges.select(F.col(a), F.col(a)).distinct()
    ).distinct()


def overlapping_groups(groups: DataFrame, group: str, member: str) -> DataFrame:
    """Rows of the groups that hold a member which occurs more than once, also twice in one group."""
    twice = groups.groupBy(member).agg(F.count("*").alias("n")).filter("n > 1").select(member)
    bad = groups.join(twice, member, "left_semi").select(group).distinct()
    return groups.join(bad, group, "left_semi")
