"""Mixing sources to target weights.

Documents are aggregated by membership pattern (the set of sources they belong to); only these sums reach the
driver.  A min-cost flow routes the tokens of the patterns to the quotas of the sources, each further repetition of
a document being dearer than the one before; the documents are then chosen by a seeded hash, without a global sort.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.functions.text import source_key, token_count
from mediaframe.session import stage, unstage

#: Sources and membership patterns become vertices of a graph on the driver; more than this is an error.
MAX_PATTERNS = 10_000
#: Hash buckets per pattern in the selection; only one bucket of a pattern is ever cut inside.
BUCKETS = 1 << 14


@dataclass(frozen=True)
class Source:
    name: str
    share: Fraction
    max_repeats: int
    shown: str = ""


class MinCostFlow:
    """Successive shortest paths with integer capacities, for small graphs."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, cap, c in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(cap)
            self.cost.append(c)
        return len(self.to) - 2

    def used(self, arc: int) -> int:
        return self.left[arc ^ 1]

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            dist: list[float] = [float("inf")] * len(self.out)
            came = [-1] * len(self.out)
            dist[s], queue, queued = 0, deque([s]), {s}
            while queue:
                x = queue.popleft()
                queued.discard(x)
                for e in self.out[x]:
                    y = self.to[e]
                    if self.left[e] > 0 and dist[x] + self.cost[e] < dist[y]:
                        dist[y], came[y] = dist[x] + self.cost[e], e
                        if y not in queued:
                            queue.append(y)
                            queued.add(y)
            if came[t] < 0:
                return total
            y, push = t, None
            while y != s:
                push = self.left[came[y]] if push is None else min(push, self.left[came[y]])
                y = self.to[came[y] ^ 1]
            y = t
            while y != s:
                self.left[came[y]] -= push
                self.left[came[y] ^ 1] += push
                y = self.to[came[y] ^ 1]
            total += push


def read_sources(table: DataFrame) -> list[Source]:
    """The sources of a mixing table; a row without source, share or repeats is left out."""
    rows = (
        table.select(source_key(F.col("source")).alias("k"), "target_share", "max_repeats", "source")
        .filter("k is not null and target_share is not null and max_repeats is not null")
        .limit(MAX_PATTERNS + 1)
        .collect()
    )
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sources")
    return [Source(r.k, Fraction(str(r.target_share)), int(r.max_repeats), r.source) for r in sorted(rows)]


def route(sources: list[Source], patterns: dict[tuple[str, ...], int]) -> tuple[dict, dict[str, Fraction], dict[str, Fraction]]:
    """((pattern, source) -> tokens, quotas, reached) of the cheapest flow that fills the quotas as far as possible.

    A pattern offers its tokens once per repetition that the source allows; repetition r costs r, so unused
    documents are taken before used ones, and no document is used more than the largest max_repeats of its sources."""
    scale = math.lcm(*[s.share.denominator for s in sources]) if sources else 1
    total = sum(patterns.values())
    names = {s.name: i for i, s in enumerate(sources)}
    repeats = {s.name: s.max_repeats for s in sources}
    keys = sorted(patterns)
    level = {}
    n = 2 + len(sources)
    for k in keys:
        for r in range(1, max((repeats[s] for s in k), default=0) + 1):
            level[k, r], n = n, n + 1
    flow = MinCostFlow(n)
    arcs: dict[tuple, int] = {}
    for (k, r), node in level.items():
        flow.arc(0, node, patterns[k] * scale, r)
        for s in k:
            if r <= repeats[s]:
                arcs[k, r, s] = flow.arc(node, 2 + names[s], patterns[k] * scale, 0)
    for s in sources:
        flow.arc(2 + names[s.name], 1, int(s.share * total * scale), 0)
    flow.run(0, 1)
    use: dict[tuple, Fraction] = {}
    for (k, _, s), e in arcs.items():
        use[k, s] = use.get((k, s), Fraction(0)) + Fraction(flow.used(e), scale)
    quota = {s.name: s.share * total for s in sources}
    reached = {s.name: sum((v for (_, x), v in use.items() if x == s.name), Fraction(0)) for s in sources}
    return use, quota, reached


def measure(documents: DataFrame, sources: list[Source], text: str, source: str, key: str) -> DataFrame:
    """(key, pattern, tokens) of the documents that belong to a source of the mix."""
    known = [s.name for s in sources]
    return (
        documents.select(F.col(key).alias("key"), source_key(F.col(source)).alias("s"), F.col(text).alias("t"))
        .filter(F.col("s").isin(*known) if known else F.lit(False))
        .select("key", F.array("s").alias("pattern"), F.coalesce(token_count(F.col("t")), F.lit(0)).alias("tokens"))
    )


def copies_membership(
    documents: DataFrame, mix: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id"
) -> DataFrame:
    """(key, pattern, tokens): equal texts are one document, under its smallest key, that belongs to the sources of all.

    A pattern is at most as long as the mix, so the list of sources of a text is bounded however many copies it has."""
    known = [s.name for s in read_sources(mix)]
    rows = documents.select(F.col(key).alias("key"), source_key(F.col(source)).alias("s"), F.col(text).alias("t"))
    rows = rows.filter((F.col("s").isin(*known) if known else F.lit(False)) & F.col("t").isNotNull())
    rows = rows.select("key", "s", F.sha2("t", 256).alias("same"), token_count(F.col("t")).alias("tokens"))
    return rows.groupBy("same").agg(F.min("key").alias("key"), F.array_sort(F.collect_set("s")).alias("pattern"), F.max("tokens").alias("tokens")).drop("same")


def pattern_sums(measured: DataFrame) -> dict[tuple[str, ...], int]:
    sums = (
        measured.select(F.array_sort(F.array_distinct("pattern")).alias("pattern"), "tokens")
        .groupBy("pattern")
        .agg(F.sum("tokens").alias("tokens"))
        .limit(MAX_PATTERNS + 1)
        .collect()
    )
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    return {tuple(r.pattern): int(r.tokens or 0) for r in sums}


def _routed(spark: SparkSession, sources: list[Source], measured: DataFrame) -> DataFrame:
    """(key, source, quota_tokens, own_tokens, routed_tokens, routed_share, reaches): one row per source of the mix."""
    sums = pattern_sums(measured)
    _, quota, reached = route(sources, sums)
    got = sum(reached.values()) or Fraction(1)
    rows = [
        (
            s.name,
            s.shown,
            float(quota[s.name]),
            sum(v for k, v in sums.items() if s.name in k),
            float(reached[s.name]),
            float(reached[s.name] / got),
            reached[s.name] >= quota[s.name],
        )
        for s in sources
    ]
    schema = "key string, source string, quota_tokens double, own_tokens bigint, routed_tokens double, routed_share double, reaches boolean"
    return spark.createDataFrame(rows, schema)


def mix_report(
    spark: SparkSession,
    documents: DataFrame,
    mix: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    seed: int = 0,
    membership: DataFrame | None = None,
) -> DataFrame:
    """(source, quota_tokens, own_tokens, routed_tokens, routed_share, reaches, chosen_tokens, chosen_share): one row per source.

    The quota is the target share of the tokens of all documents in the mix.  Null texts have no tokens; documents
    whose source is null or not in the mix do not take part; without documents every quota is 0 and reached.
    ``membership`` may give (key, pattern, tokens) of documents that belong to several sources, such as
    ``copies_membership``; then the tokens of a document count for each of its sources as own ones, once in the total.
    The routed amounts and ``reaches`` are those of the flow, which may end inside a document; the chosen ones are those
    of the whole documents that ``select_documents`` takes with the same seed."""
    sources = read_sources(mix)
    measured = stage(membership if membership is not None else measure(documents, sources, text, source, key), "mix")
    chosen = select_documents(documents, mix, seed, text, source, "key", measured)
    sums = {r.source: int(r.n) for r in chosen.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("n")).collect()}
    got = sum(sums.values()) or 1
    picked = spark.createDataFrame(
        [(s.name, sums.get(s.name, 0), sums.get(s.name, 0) / got) for s in sources], "key string, chosen_tokens bigint, chosen_share double"
    )
    out = _routed(spark, sources, measured).join(F.broadcast(picked), "key").drop("key")  # one row per source
    unstage(measured)
    return out


def select_documents(
    documents: DataFrame,
    mix: DataFrame,
    seed: int = 0,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    membership: DataFrame | None = None,
) -> DataFrame:
    """(key, source, uses, tokens): how often each document is used for a source; unused ones have no row.

    ``membership`` may give (key, pattern, tokens) of documents that belong to several sources.  Of a routed amount,
    whole repetitions go to all documents of the pattern; the rest goes to those first in the order of a seeded hash,
    as long as the running sum of tokens fits.  Sums run over hash buckets, so no task holds a whole source; only the
    documents of the one bucket in which the sum ends are ordered."""
    spark = documents.sparkSession
    sources = read_sources(mix)
    measured = membership if membership is not None else measure(documents, sources, text, source, key)
    measured = measured.select("key", F.array_sort(F.array_distinct("pattern")).alias("pattern"), "tokens").filter("tokens > 0")
    sums = pattern_sums(measured)
    use, _, _ = route(sources, sums)
    rows, start = [], {}
    for (k, s), amount in sorted(use.items()):
        if amount > 0:  # sources of one pattern take consecutive stretches of the seeded order
            rows.append((list(k), s, int(start.get(k, 0)), int(start.get(k, 0) + amount), sums[k]))
            start[k] = start.get(k, 0) + amount
    plan = spark.createDataFrame(
        rows, T.StructType.fromDDL("pattern array<string>, source string, lo bigint, hi bigint, size bigint")
    )
    order = F.xxhash64(F.lit(seed), F.col("key"))
    placed = measured.withColumn("h", order).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    per_bucket = placed.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("n"))
    before = per_bucket.withColumn(
        "before",
        F.expr("coalesce(sum(n) over (partition by pattern order by bucket rows between unbounded preceding and 1 preceding), 0)"),
    ).drop("n")
    n = F.expr("coalesce(sum(tokens) over (partition by pattern, bucket order by h, key rows between unbounded preceding and 1 preceding), 0)")
    at = placed.join(before, ["pattern", "bucket"]).withColumn("at", F.col("before") + n)
    # token k of the pattern serves the stretch [lo, hi) once for every whole turn; a document counts where it fits whole
    last = F.col("at") + F.col("tokens")
    turns = lambda end: F.floor(F.greatest(end - last, -F.col("size")) / F.col("size")) + 1
    uses = turns(F.col("hi")) - turns(F.col("lo"))
    return (
        at.join(F.broadcast(plan), "pattern")  # at most patterns times sources rows
        .select(F.col("key").alias(key), "source", uses.cast("bigint").alias("uses"), "tokens")
        .filter("uses > 0")
    )


def unreachable_sources(spark: SparkSession, documents: DataFrame, mix: DataFrame) -> DataFrame:
    """(source): the sources whose quota the flow cannot fill even with every allowed repetition."""
    sources = read_sources(mix)
    return _routed(spark, sources, measure(documents, sources, "text", "source", "doc_id")).filter("not reaches").select("source")
