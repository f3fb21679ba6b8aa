"""Queries of the training-data problems of this folder, and their SQL where whole tables can be checked with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.llm.canonical import map_to_canonical
from mediaframe.llm.checks import ORACLE as ORACLE
from mediaframe.llm.consolidate import consolidate, group_table
from mediaframe.llm.frequency import term_frequencies
from mediaframe.llm.history import dedup_batches
from mediaframe.llm.leakage import leaked_windows
from mediaframe.llm.mixing import copies_membership, mix_report, select_documents, unreachable_sources
from mediaframe.llm.split import oversized_documents, split_oversized
from mediaframe.llm.survivor import elect_values, most_trusted
from mediaframe.plans.tables import table

FREQUENCY_LABELS = ("0th Model", "Exif Lense model")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup_batches(table(spark, d, "hash_result"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return map_to_canonical(table(spark, d, "rename_items"), table(spark, d, "camera_models"))


def p5_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(table(spark, d, "meta_stats"), FREQUENCY_LABELS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_frequencies(spark, d).filter("mark is not null").select("key_label", "kind", "item", "mark")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return most_trusted(table(spark, d, "dup_groups"))


def p6_elected(spark: SparkSession, d: str) -> DataFrame:
    return elect_values(table(spark, d, "dup_groups"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return consolidate(table(spark, d, "match_pairs"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return group_table(table(spark, d, "match_pairs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_windows(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents."""
    hits = leaked_windows(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return hits.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("n_windows").alias("most_windows"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return unreachable_sources(spark, table(spark, d, "documents"), table(spark, d, "mix_sources"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(spark, table(spark, d, "documents"), table(spark, d, "mix_sources"))


def p9_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The report where equal texts of several sources are one document that belongs to all of them."""
    docs, mix = table(spark, d, "documents"), table(spark, d, "mix_sources")
    return mix_report(spark, docs, mix, membership=copies_membership(docs, mix))


def p9_selected(spark: SparkSession, d: str) -> DataFrame:
    return select_documents(table(spark, d, "documents"), table(spark, d, "mix_sources"), seed=0)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized_documents(p10_pieces(spark, d))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "documents"), table(spark, d, "mix_sources"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p2_found, p4_found, p5_found, p5_frequencies, p6_found, p6_elected, p7_found, p7_groups, p8_found, p8_items,
        p9_found, p9_report, p9_overlap, p9_selected, p10_found, p10_pieces,
    )
}
