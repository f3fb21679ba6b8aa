"""Attribute-value rows into wide tables.

Attributes are encoded as column indices.  Rows of one batch are combined to one state per (entity, attribute) where
they lie, so that an entity that holds a third of all rows is shuffled as a few rows per batch.  The states are
hash-partitioned and sorted by entity, once, and an Arrow function streams the grouped rows into sparse columnar
builders: it goes on combining states, names the cells that are unreadable or disagree, puts integers and moments into
typed buffers with a validity mask and gathers texts by index.  An entity is never held as more than one row per attribute.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.functions.dates import moment_text
from mediaframe.functions.numbers import whole_number
from mediaframe.functions.text import label_key, once, outer_trim

#: Value types of an attribute and the type of its column.
COLUMN_TYPES = {
    "integer": (T.LongType(), pa.int64()),
    "text": (T.StringType(), pa.string()),
    "moment": (T.TimestampNTZType(), pa.timestamp("us")),
    "time part": (T.StringType(), pa.string()),
}
MAX_COLUMNS = 10_000


def read_labels(labels: DataFrame) -> list[tuple[str, str]]:
    """(label, value type) of a label table.  It becomes the schema of the result, so it has to be small."""
    rows = labels.select("key_label", "value_type").filter("key_label is not null").limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} labels")
    return sorted((r.key_label, r.value_type) for r in rows)


def _canonical(value: Column, kind: Column) -> Column:
    """One text per value under which equal values are equal; null if the value cannot be typed."""
    return (
        F.when(kind == "integer", whole_number(value)).when(kind == "moment", moment_text(value)).otherwise(value)
    )


_STATE = "entity string, attr int, lo string, hi string, bad boolean"


def cell_states(
    rows: DataFrame, labels: Sequence[tuple[str, str]], entity: str, label: str, value: str
) -> DataFrame:
    """(entity, attr, lo, hi, bad): smallest and largest readable value of a cell and whether any row is unreadable.

    Combined within batches only; a cell may have several states."""
    keys = [(i, "".join(name.lower().split()), kind) for i, (name, kind) in enumerate(labels)]
    index = F.create_map(*[F.lit(x) for i, key, _ in keys for x in (key, i)]) if keys else F.lit(None)
    kinds = F.array(*[F.lit(kind) for _, _, kind in keys]) if keys else F.array(F.lit(""))
    attr = F.element_at(index, label_key(F.col(label))) if keys else F.lit(None).cast("int")
    base = once(rows, [F.col(entity).cast("string").alias("entity")], attr=attr, v=outer_trim(F.col(value)))
    base = base.filter("entity is not null and attr is not null and v <> ''")
    read = base.select("entity", "attr", _canonical(F.col("v"), kinds[F.col("attr")]).alias("lo"))
    return read.selectExpr("entity", "attr", "lo", "lo as hi", "lo is null as bad").mapInArrow(_combine_batches, _STATE)


def _combine(t: pa.Table) -> pa.Table:
    """One state per (entity, attr)."""
    out = t.group_by(["entity", "attr"], use_threads=False).aggregate([("lo", "min"), ("hi", "max"), ("bad", "max")])
    return out.rename_columns(["entity", "attr", "lo", "hi", "bad"]).combine_chunks()


def _combine_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield from _combine(pa.table(b)).to_batches()


def _typed(kind: str, lo: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(values, fits) of the readable texts of one attribute."""
    if kind == "integer":
        digits = pc.utf8_ltrim(lo, "-")
        size = pc.utf8_length(digits)
        top = pc.if_else(pc.starts_with(lo, "-"), "9223372036854775808", "9223372036854775807")
        fits = pc.fill_null(pc.or_(pc.less(size, 19), pc.and_(pc.equal(size, 19), pc.less_equal(digits, top))), False)
        return pc.cast(pc.if_else(fits, lo, None), pa.int64()), fits
    if kind == "moment":
        return pc.cast(lo, pa.timestamp("us")), pc.is_valid(lo)
    return lo, pc.is_valid(lo)


def _builder(labels: Sequence[tuple[str, str]], schema: pa.Schema, oversize: bool):
    names = pa.array([name for name, _ in labels], pa.string())

    def listed(n: int, row: np.ndarray, attr: np.ndarray, flag: np.ndarray) -> pa.Array:
        rows, attrs = row[flag], attr[flag]
        offsets = np.zeros(n + 1, np.int32)
        np.cumsum(np.bincount(rows, minlength=n), out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(attrs)))

    def build(t: pa.Table) -> pa.RecordBatch:
        """One row per entity from its states; only the cells that there are get touched."""
        entities = t["entity"].combine_chunks().dictionary_encode()
        n, row, attr = len(entities.dictionary), entities.indices.to_numpy(), t["attr"].to_numpy()
        lo, hi = t["lo"].combine_chunks(), t["hi"].combine_chunks()
        conflict = pc.fill_null(pc.not_equal(lo, hi), False).to_numpy(zero_copy_only=False)
        bad = t["bad"].to_numpy().astype(bool)
        large = np.zeros(t.num_rows, bool)
        by_row = np.argsort(row, kind="stable")
        by_attr = np.argsort(attr, kind="stable")
        bounds = np.searchsorted(attr[by_attr], np.arange(len(labels) + 1))
        columns = [entities.dictionary]
        for i, (_, kind) in enumerate(labels):
            at = by_attr[bounds[i] : bounds[i + 1]]
            if not len(at):
                columns.append(pa.nulls(n, schema.field(i + 1).type))
                continue
            values, fits = _typed(kind, lo.take(pa.array(at)))
            fits = fits.to_numpy(zero_copy_only=False)
            keep = fits & ~conflict[at]
            large[at] = pc.is_valid(lo.take(pa.array(at))).to_numpy(zero_copy_only=False) & ~fits & ~conflict[at]
            slot = np.full(n, -1, np.int64)
            slot[row[at[keep]]] = np.flatnonzero(keep)
            columns.append(values.take(pa.array(slot, mask=slot < 0)))
        row, attr = row[by_row], attr[by_row]
        columns += [listed(n, row, attr, f[by_row]) for f in ((bad, conflict, large) if oversize else (bad | large, conflict))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None  # the states of the entity that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.table(batch)
            t = _combine(pa.concat_tables([rest, t]) if rest is not None else t)
            open_ = pc.equal(t["entity"], batch.column("entity")[batch.num_rows - 1])
            rest, done = t.filter(open_), t.filter(pc.invert(open_))
            if done.num_rows:
                yield build(done)
        if rest is not None:
            yield build(rest)

    return run


def widen(
    rows: DataFrame,
    labels: Sequence[tuple[str, str]],
    entity: str = "path",
    label: str = "key_label",
    value: str = "value_label",
    oversize: bool = False,
) -> DataFrame:
    """One row per entity with one typed column per label, plus ``unreadable`` and ``conflict``: lists of labels.

    * Labels are equal irrespective of case and white space; rows with another label or a null entity are ignored.
    * Values lose outer white space and NULs; null and blank ones are ignored, an entity with nothing else has no row.
    * A cell is null if it has no readable value or if its readable values disagree; such cells are named.
      Integers that do not fit the column count as unreadable, or with ``oversize`` have a list of that name.
    * Repeated rows do not count twice; other columns of ``rows`` may have any name; an empty input gives no row.
    """
    spark = rows.sparkSession
    lists = T.ArrayType(T.StringType())
    named = ["unreadable", "conflict", *["oversize"] * oversize]
    schema = T.StructType(
        [T.StructField(entity, T.StringType())]
        + [T.StructField(name, COLUMN_TYPES[kind][0]) for name, kind in labels]
        + [T.StructField(name, lists) for name in named]
    )
    arrow = pa.schema(
        [(entity, pa.string())]
        + [(name, COLUMN_TYPES[kind][1]) for name, kind in labels]
        + [(name, pa.list_(pa.string())) for name in named]
    )
    states = cell_states(rows, labels, entity, label, value)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_entity = states.repartition(n, "entity").sortWithinPartitions("entity")
    return by_entity.mapInArrow(_builder(list(labels), arrow, oversize), schema)


def cell_issues(wide: DataFrame, labels: Sequence[tuple[str, str]], entity: str = "path") -> DataFrame:
    """(entity, key_label, issue) of the integer and text cells that a wide table names."""
    shown = [name for name, kind in labels if kind in ("integer", "text")]
    issue = lambda name: F.transform(F.col(name), lambda x: F.struct(x.alias("key_label"), F.lit(name).alias("issue")))
    return (
        wide.select(F.col(entity), F.explode(F.concat(issue("unreadable"), issue("conflict"))).alias("x"))
        .select(entity, "x.key_label", "x.issue")
        .filter(F.col("key_label").isin(shown))
    )
