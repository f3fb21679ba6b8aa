"""POSIX paths as places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shortest_path(c: Column) -> Column:
    """Shortest spelling of the place that a path leads to in a tree without links; blank text is null.

    Empty and ``.`` steps vanish, ``..`` removes the step before it, at the root it vanishes, and before a relative
    path it stays.  Upper and lower case differ."""
    absolute = c.startswith("/")
    steps = F.filter(F.split(c, "/"), lambda s: ~s.isin("", "."))

    def walk(done: Column, step: Column) -> Column:
        back = (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != "..")
        return (
            F.when(step != "..", F.concat(done, F.array(step)))
            .when(back, F.slice(done, F.lit(1), F.size(done) - 1))
            .when(absolute, done)
            .otherwise(F.concat(done, F.array(step)))
        )

    kept = F.aggregate(steps, F.array().cast("array<string>"), walk)
    short = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(kept, "/"))
    odd = c.rlike(r"//|(?:^|/)\.{1,2}(?:/|$)|[^/]/$")
    return F.when(c == "", None).when(~odd, c).when(short == "", ".").otherwise(short)
