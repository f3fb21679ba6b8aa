"""Numbers out of dressed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaframe.functions.text import let

_GROUP = r"[,'\u2019 \u00A0\u2009\u202F]"
#: A number: optional sign, digits with or without thousands marks, optional decimals.
NUMBER = (
    rf"(?:(?<![\p{{L}}\p{{N}}])[-+−])?"
    rf"(?:\d{{1,3}}(?:{_GROUP}\d{{3}})+(?!\d)|\d{{1,3}}(?:\.\d{{3}}){{2,}}(?!\d)|\d+)(?:[.,]\d+)?"
)


def whole_number(c: Column) -> Column:
    """The one whole number in the text as canonical decimal digits, null if it holds none, several or a fraction.

    ``4,096``, ``4 096 px``, ``[4096]`` and ``4096.0`` all give ``4096``; the result may exceed 64 bits."""
    dotted = r"\.\d{3}\.\d{3}"

    def canonical(one: Column) -> Column:
        body = F.when(one.rlike(dotted), F.regexp_replace(one, r"\.(?=\d{3}(?!\d))", "")).otherwise(one)
        return F.regexp_replace(body, rf"(?<=\d){_GROUP}(?=\d{{3}}(?!\d))", "")

    def whole(body: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"[.,]0*$", ""), "^[+]", ""), "^−", "-")
        trimmed = F.regexp_replace(F.regexp_replace(bare, r"^(-?)0+(?=\d)", "$1"), "^-0$", "0")
        return F.when(body.rlike(r"^[-+−]?\d+(?:[.,]0*)?$"), trimmed)

    found = F.regexp_extract_all(F.translate(c, "０１２３４５６７８９", "0123456789"), F.lit(NUMBER), 0)
    other = let(found, lambda x: F.when(F.size(x) == 1, let(let(x[0], canonical), whole)))
    return F.when(c.rlike(r"^\d{1,18}$"), F.regexp_replace(c, r"^0+(?=\d)", "")).otherwise(other)
