"""How often every distinct value and term occurs, and in how many records."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.text import label_key, once, outer_trim
from mediaframe.session import stage

RARE_RECORDS = 2
COMMON_SHARE = 0.06
TERM = r"[\p{L}\p{N}]+"
_KEYS = ["key_label", "kind", "item"]


def occurrences(rows: DataFrame, labels: Sequence[str], record: str, label: str, value: str) -> DataFrame:
    """(key_label, kind, item, record, n): every occurrence of an item in a row, those of one batch of rows added up.

    kind ``value`` is the whole value, ``term`` each run of letters and digits, ``all`` stands for the label itself."""
    names = {"".join(x.lower().split()): x for x in labels}
    shown = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    kept = [F.col(record).cast("string").alias("record"), F.col(value).alias("value")]
    base = once(rows.filter(F.col(record).isNotNull()), kept, key_label=F.element_at(shown, label_key(F.col(label))))
    base = once(base.filter("key_label is not null"), ["record", "key_label"], v=F.lower(outer_trim(F.col("value")))).filter("v <> ''")
    item = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("item"))
    terms = F.transform(F.regexp_extract_all("v", F.lit(TERM), 0), lambda t: item("term", t))
    every = F.concat(F.array(item("all", F.lit("")), item("value", F.col("v"))), terms)
    spread = base.select("key_label", F.explode(every).alias("e"), "record").select("key_label", "e.kind", "e.item", "record")
    return spread.mapInArrow(_add_up, "key_label string, kind string, item string, record string, n bigint")


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map-side combine: the occurrences of an item in a record become one row per batch, so that one pair that holds a
    third of all rows reaches the sort as few rows."""
    for b in batches:
        if b.num_rows:
            got = pa.table(b).group_by([*_KEYS, "record"]).aggregate([([], "count_all")])
            yield from got.rename_columns([*_KEYS, "record", "n"]).combine_chunks().to_batches()


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan a sorted partition: a run of equal items adds up occurrences, its changes of record are distinct records."""
    last: list | None = None  # item key and record of the row before
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        new_item = np.zeros(n, bool)
        for name in _KEYS:
            c = b.column(name)
            new_item[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        record = b.column("record")
        new_record = new_item.copy()
        new_record[1:] |= pc.not_equal(record[1:], record[:-1]).to_numpy(zero_copy_only=False)
        first = [b.column(k)[0].as_py() for k in [*_KEYS, "record"]]
        new_record[0] = last != first
        last = [b.column(k)[n - 1].as_py() for k in [*_KEYS, "record"]]
        new_item[0] = True
        starts = np.flatnonzero(new_item)
        take = pa.array(starts)
        total = np.add.reduceat(b.column("n").to_numpy(), starts)
        records = np.add.reduceat(new_record.astype(np.int64), starts)
        yield pa.RecordBatch.from_arrays(
            [*[b.column(k).take(take) for k in _KEYS], pa.array(total), pa.array(records)],
            names=[*_KEYS, "n_occurrences", "n_records"],
        )


def term_frequencies(
    rows: DataFrame,
    labels: Sequence[str],
    record: str = "path",
    label: str = "key_label",
    value: str = "value_label",
    rare: int = RARE_RECORDS,
    common: float = COMMON_SHARE,
) -> DataFrame:
    """(key_label, kind, item, n_occurrences, n_records, mark) of every distinct value and term of the labels.

    * Labels are equal irrespective of case and white space; values are lower-cased without outer white space and
      NULs; null and blank values and null records do not count.
    * ``mark`` is ``rare`` for at most ``rare`` records, else ``common`` for more than ``common`` of the records that
      have a value of the label, else null.  Repeated rows are occurrences, but one record.
    * Occurrences are range-partitioned and sorted by (item, record), so one hot item spreads over many partitions and
      its partial runs are added up; no step holds all records of an item, and equal pairs lie in one partition.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = occurrences(rows, labels, record, label, value)
    ordered = pairs.repartitionByRange(n, *_KEYS, "record").sortWithinPartitions(*_KEYS, "record")
    runs = ordered.mapInArrow(
        _run_lengths, "key_label string, kind string, item string, n_occurrences bigint, n_records bigint"
    )
    counts = runs.groupBy(*_KEYS).agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))
    counts = stage(counts, "counts")  # read twice below
    totals = counts.filter("kind = 'all'").select("key_label", F.col("n_records").alias("of_label"))
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > common * F.col("of_label"), "common")
    return (
        counts.filter("kind <> 'all'")
        .join(F.broadcast(totals), "key_label")  # one row per wanted label
        .select(*_KEYS, "n_occurrences", "n_records", mark.alias("mark"))
    )
