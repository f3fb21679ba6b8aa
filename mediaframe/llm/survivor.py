"""One surviving record per duplicate group, field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.text import outer_trim

#: Default and limit dates of file systems and clocks (fixed values).
FILE_SYSTEM_DATES = (
    "0001-01-01 00:00:00",
    "1601-01-01 00:00:00",
    "1899-12-30 00:00:00",
    "1899-12-31 00:00:00",
    "1900-01-01 00:00:00",
    "1901-12-13 20:45:52",
    "1904-01-01 00:00:00",
    "1969-12-31 23:59:59",
    "1970-01-01 00:00:00",
    "1979-12-31 00:00:00",
    "1980-01-01 00:00:00",
    "2038-01-19 03:14:07",
    "2040-02-06 06:28:15",
    "2098-01-01 00:00:00",
    "2099-12-31 23:59:59",
    "2106-02-07 06:28:15",
    "2107-12-31 23:59:58",
    "2107-12-31 23:59:59",
    "2446-05-10 22:38:55",
    "9999-12-31 23:59:59",
)
#: Texts that stand for "no value" once case and punctuation at the ends are gone (fixed values).
STAND_INS = (
    "", "n/a", "na", "nan", "null", "nil", "none", "no value", "unknown", "undefined", "unset", "not set",
    "not available", "not applicable", "missing", "empty", "unspecified", "tbd",
)
FIELDS = ("filesize", "mod_date", "width", "height", "exif_date_taken", "maker", "model")
_LOW = -(2**62)


def usable(name: str, kind: str) -> Column:
    """Whether the value of a column can be used, by its type: numbers above 0 (priority from 0 on), real dates, texts."""
    c = F.col(f"`{name}`")
    if kind.startswith("timestamp") or kind == "date":
        ok = ~F.date_trunc("second", c.cast("timestamp_ntz")).cast("string").isin(*FILE_SYSTEM_DATES)
    elif kind == "string":
        bare = F.regexp_replace(F.lower(outer_trim(c)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
        ok = ~bare.isin(*STAND_INS)
    elif name == "priority":
        ok = c >= 0
    else:
        ok = c > 0
    return F.coalesce(ok, F.lit(False))


def trust_order(kinds: dict[str, str]) -> Column:
    """Struct that is greatest for the most trusted row: checked false, true, null; small priority; late mod_date;
    large filesize; small row_id.  Unusable values come last in their place."""
    get = lambda n, x: F.when(usable(n, kinds[n]), x).otherwise(F.lit(_LOW))
    date = F.col("mod_date").cast("timestamp")
    return F.struct(
        F.when(F.col("checked").isNull(), 0).when(F.col("checked"), 1).otherwise(2).alias("c"),
        get("priority", -F.col("priority").cast("bigint")).alias("p"),
        get("mod_date", F.unix_micros(date)).alias("m"),
        get("filesize", F.col("filesize").cast("bigint")).alias("f"),
        F.coalesce(-F.col("row_id").cast("bigint"), F.lit(_LOW)).alias("r"),
    )


def _with_span(rows: DataFrame) -> DataFrame:
    """``rows`` with ``age``: days between the row and the newest dated row of its group.

    Undated rows are as old as the oldest dated one; without any dated row all are new."""
    span = rows.groupBy("group_id").agg(F.max("day").alias("newest"), F.min("day").alias("oldest"))
    same = F.col("r.group_id") == F.col("s.group_id")
    age = F.coalesce(F.col("newest") - F.coalesce("day", "oldest"), F.lit(0.0))
    return rows.alias("r").join(span.alias("s"), same).select("r.*", age.alias("age"))


def _votes(groups: DataFrame, fields: Sequence[str], half_life_days: float | None) -> DataFrame:
    """Unpivoted: (group_id, field, value, norm, row_id, trust, vote) of the usable values only."""
    kinds = dict(groups.dtypes)
    text = lambda f: outer_trim(F.col(f"`{f}`").cast("string"))
    cells = F.array(
        *[
            F.when(usable(f, kinds[f]), F.struct(F.lit(f).alias("field"), text(f).alias("value"), F.lower(text(f)).alias("norm")))
            for f in fields
        ]
    )
    rows = groups.filter("group_id is not null").select(
        "group_id", "row_id", "checked", "priority", trust_order(kinds).alias("trust"), cells.alias("cells"),
        usable("priority", kinds["priority"]).alias("ranked"),
        F.when(usable("mod_date", kinds["mod_date"]), F.unix_micros(F.col("mod_date").cast("timestamp")) / 86_400_000_000).alias("day"),
    )
    if half_life_days is None:
        vote = F.col("trust")
    else:
        rows = _with_span(rows)
        source = F.when(F.col("checked").isNull(), 0.25).when(F.col("checked"), 0.5).otherwise(1.0)
        rank = F.when(F.col("ranked"), 1 / (1 + F.col("priority"))).otherwise(0.1)
        vote = (source * rank * F.pow(F.lit(2.0), -F.col("age") / half_life_days)).cast("decimal(28,20)")
    present = F.filter("cells", lambda x: x.isNotNull())
    return rows.select("group_id", "row_id", "trust", vote.alias("vote"), F.explode(present).alias("x")).select(
        "group_id", "row_id", "trust", "vote", "x.*"
    )


def elect_values(groups: DataFrame, fields: Sequence[str] = FIELDS, half_life_days: float | None = 365.0) -> DataFrame:
    """One row per group: for each field the value with most votes (typed as before), and ``…_row``, the row that holds it.

    Fields are unpivoted to long rows, votes are added up per normalised value, the winner is taken by ``max_by`` and
    the winners are pivoted back; ties go to the more trusted row.  Each step is an aggregate with map-side combine, so
    a group that holds a third of all rows is reduced before it is shuffled.

    * A vote is source trust times recency decay, half per ``half_life_days`` between the row and the newest of its
      group.  Votes are decimals of 20 digits behind the point, so sums do not depend on the order of rows, and sums
      are compared to 12 digits, so equal ones tie; the newest row of a group alone is far above that.
    * With ``half_life_days`` None a vote outweighs all votes of less trusted rows together, however many they are.
      The sum of such votes is ordered like its greatest one, so that one stands for it.

    Rows without a group are ignored; a field without a usable value is null; a group without any has no row; repeated
    rows tie, and the smaller row_id wins; an empty input gives no row; other columns are not read."""
    total = F.max if half_life_days is None else lambda vote: F.round(F.sum(vote), 12)
    winners = (
        _votes(groups, fields, half_life_days)
        .groupBy("group_id", "field", "norm")
        .agg(total("vote").alias("votes"), F.max(F.struct("trust", "row_id", "value")).alias("w"))
        .groupBy("group_id", "field")
        .agg(F.max_by("w", F.struct("votes", "w")).alias("w"))
    )
    pick = lambda f, x: F.max(F.when(F.col("field") == f, x))
    kinds = dict(groups.dtypes)
    return winners.groupBy("group_id").agg(
        *[pick(f, F.col("w.value")).try_cast(kinds[f]).alias(f) for f in fields],
        *[pick(f, F.col("w.row_id")).alias(f"{f}_row") for f in fields],
    )


def most_trusted(groups: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(group_id, field, row_id): for each group and field the most trusted row with a usable value.

    It is the election in which trust outweighs numbers, one row per field that has a winner."""
    elected = elect_values(groups, fields, None)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_row").alias("row_id")) for f in fields])
    return elected.select("group_id", F.inline(F.filter(cells, lambda x: x["row_id"].isNotNull())))
