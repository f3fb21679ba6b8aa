"""Pairwise matches into groups.

Minimum labels move across the edges and pointer jumping shortens the chains of labels.  Every round contracts
the graph to the labels it found, so later rounds work on fewer and fewer edges; each round is checkpointed as
a table in the shared folder.  A vertex that holds a third of all edges costs one pre-aggregated row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.paths import shortest_path
from mediaframe.session import stage, stage_counted, unstage

#: Pointer jumps between two looks at whether a label still moves.
JUMPS = 2


def _ordered_ids(nodes: DataFrame) -> DataFrame:
    """(name, id): ids that sort like the names, without ranking everything in one task.

    The names are range-partitioned and sorted; the id is the partition and the place in it, fixed by writing."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = nodes.repartitionByRange(n, "name").sortWithinPartitions("name")
    return stage(placed.select("name", F.monotonically_increasing_id().alias("id")), "ids")


def _roots(parent: DataFrame) -> DataFrame:
    """(v, p) with every p a root, by pointer jumping: p becomes the parent of p until nothing moves."""
    current = parent
    while True:
        nxt = current
        for _ in range(JUMPS):
            up = nxt.select(F.col("v").alias("w"), F.col("p").alias("pp"))
            nxt = nxt.select("v", "p").join(up, F.col("p") == F.col("w"), "left")
            nxt = nxt.select("v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved"))
        nxt, moving = stage_counted(nxt, F.col("moved"), "jump")
        if current is not parent:
            unstage(current)
        current = nxt
        if not moving:
            return current.select("v", "p")


def minimum_labels(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges (a bigint, b bigint)`` that is not the smallest of its component.

    The graph shrinks by a constant factor each round, chains included, so there are logarithmically many rounds."""
    every = F.lit(True)
    live = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live, n = stage_counted(live, every, "edges")
    labels: DataFrame | None = None
    while n:
        ends = live.select(F.col("a").alias("v"), F.col("b").alias("u")).union(live.select("b", "a"))
        low = ends.groupBy("v").agg(F.min("u").alias("p")).filter("p < v")
        parent = stage(low, "parent")
        root = _roots(parent)
        ra = root.select(F.col("v").alias("a"), F.col("p").alias("ra"))
        rb = root.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        moved = (
            live.join(ra, "a", "left")
            .join(rb, "b", "left")
            .select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        after, n = stage_counted(moved, every, "edges")
        fresh = root.select("v", F.col("p").alias("root"))
        if labels is None:
            merged = stage(fresh, "labels")
        else:
            up = root.select(F.col("v").alias("w"), "p")
            kept = labels.join(up, F.col("root") == F.col("w"), "left").select("v", F.coalesce("p", "root").alias("root"))
            merged = stage(kept.union(fresh), "labels")
        for old in (live, labels, parent):
            unstage(old)
        live, labels = after, merged
    unstage(live)
    return labels if labels is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("root")).limit(0)


def consolidate(pairs: DataFrame, a: str = "path_a", b: str = "path_b", with_roots: bool = False) -> DataFrame:
    """(root_path, path): every linked path with the root of its group, the smallest path of it.

    The root itself has a row only ``with_roots``.
    Paths are compared and reported in their shortest spelling, by code points.  Pairs with a null or empty end and
    pairs of a path with itself link nothing; repeated and mirrored pairs count once; other columns are not read;
    an empty input gives an empty result."""
    links = (
        pairs.select(shortest_path(F.col(a)).alias("x"), shortest_path(F.col(b)).alias("y"))
        .filter("x is not null and y is not null and x <> y")
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .distinct()
    )
    links = stage(links, "links")
    ids = _ordered_ids(links.select(F.col("x").alias("name")).union(links.select("y")).distinct())
    ix = ids.select(F.col("name").alias("x"), F.col("id").alias("a"))
    iy = ids.select(F.col("name").alias("y"), F.col("id").alias("b"))
    edges = links.join(ix, "x").join(iy, "y").select("a", "b")
    labels = minimum_labels(edges)
    if with_roots:
        labels = labels.union(labels.select("root", "root").distinct())
    root = ids.select(F.col("id").alias("root"), F.col("name").alias("root_path"))
    path = ids.select(F.col("id").alias("v"), F.col("name").alias("path"))
    return labels.join(path, "v").join(root, "root").select("root_path", "path")


def group_table(pairs: DataFrame, a: str = "path_a", b: str = "path_b") -> DataFrame:
    """(group, path) over all members, the root included; the group is named by its root path."""
    return consolidate(pairs, a, b, with_roots=True).withColumnRenamed("root_path", "group")
