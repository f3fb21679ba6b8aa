"""Priority commands: a list of {column, function, args, order} becomes sort columns."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.functions import text
from mediaframe.operators.groups import sort_within_groups, uncheck_reference

_NUMBERS = (T.IntegerType, T.LongType)
_DATES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _value(c: Column) -> Column:
    return c


#: (type, name) of a ranking function, its builder and its number of arguments.  The names are fixed values: commands that
#: users have stored name them.
FUNCTIONS: dict[tuple[type, str], tuple] = {
    (T.StringType, "Available"): (lambda c: F.length(c) > 0, 0),
    (T.StringType, "Alphabetical"): (_value, 0),
    (T.StringType, "Length"): (F.length, 0),
    (T.StringType, "Match regex"): (text.matches_regex, 1),
    (T.StringType, "Match wildcards"): (text.matches_wildcard, 1),
    (T.StringType, "Count regex"): (text.count_regex, 1),
    (T.BooleanType, "Value"): (_value, 0),
    **{(t, "Available"): (F.isnull, 0) for t in (*_NUMBERS, *_DATES)},
    **{(t, "Value"): (_value, 0) for t in (*_NUMBERS, *_DATES)},
}


def available() -> dict[str, list[str]]:
    """Function names by type; a name has the same number of arguments for every type."""
    arity: dict[str, int] = {}
    out: dict[str, list[str]] = {}
    for (kind, name), (_, n) in FUNCTIONS.items():
        if arity.setdefault(name, n) != n:
            raise ValueError(f"{name} has differing numbers of arguments")
        out.setdefault(kind.__name__, []).append(name)
    return out


def compile_commands(df: DataFrame, commands: Sequence[str | dict]) -> list[tuple[Column, bool]]:
    """(key, ascending) per command; unknown columns, functions and wrong numbers of arguments are a ValueError."""
    kinds = {f.name: type(f.dataType) for f in df.schema}
    out = []
    for c in commands:
        c = json.loads(c) if isinstance(c, str) else c
        name, function, args = c["column"], c["function"], c.get("args", [])
        if name not in kinds or (kinds[name], function) not in FUNCTIONS:
            raise ValueError(f"no function {function} for column {name}")
        build, n = FUNCTIONS[kinds[name], function]
        if len(args) != n:
            raise ValueError(f"{function} takes {n} arguments")
        out.append((build(F.col(f"`{name}`"), *args), c.get("order", "asc") == "asc"))
    return out


def prioritise(df: DataFrame, group: str, commands: Sequence[str | dict], pos: str) -> DataFrame:
    """``df`` reordered inside its groups, with the new ``priority``; the new reference rows are unmarked."""
    ranked = sort_within_groups(df, group, compile_commands(df, commands), pos)
    out = ranked.withColumn("priority", F.col("row_rank").cast("int"))
    return uncheck_reference(out) if "checked" in df.columns else out
