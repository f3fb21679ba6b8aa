"""Text columns: trimming, folding, wildcard and regex helpers.  Everything stays in the JVM."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java class of what counts as outer dirt of a value: Unicode white space and NUL.
OUTER = r"[\s\x00\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_TRIM = rf"^{OUTER}+|{OUTER}+$"
_SPACE = rf"{OUTER}+"

#: Public word-and-punctuation pattern with Unicode classes as Python reads it: letters, numbers of
#: all kinds and the underscore are word characters, marks are not.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"

#: Cyrillic and Greek letters that look like Latin ones (fixed values, from the Unicode confusables).
LOOKALIKE_FROM = "авекмнорстухіјѕԁһԛԝɡαβεικνορτυχ"
LOOKALIKE_TO = "abekmhopctyxijsdhqwgabeiknoptux"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def once(df: DataFrame, keep: Sequence[str | Column], **columns: Column) -> DataFrame:
    """``keep`` and the named columns, each evaluated once: a filter on them stays behind them instead of repeating them."""
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = df.select(*keep, F.explode(F.array(made)).alias("_once"))
    return kept.select(*[f"`{c}`" for c in kept.columns[:-1]], "_once.*")


def outer_trim(c: Column) -> Column:
    """Without outer white space and NULs; null stays null."""
    return F.regexp_replace(c, _TRIM, "")


def label_key(c: Column) -> Column:
    """Key under which labels are equal irrespective of case and white space."""
    return F.lower(F.regexp_replace(c, _SPACE, ""))


def source_key(c: Column) -> Column:
    """Key under which source names are equal: case, outer white space and word separators do not count."""
    return F.regexp_replace(F.lower(outer_trim(c)), r"[\s_\-‐-―./ ]+", "-")


def token_count(c: Column) -> Column:
    """Number of tokens of the public word-and-punctuation pattern."""
    return F.regexp_count(c, F.lit(TOKEN)).cast("bigint")


@functools.cache
def fold_table() -> tuple[str, str]:
    """Characters whose compatibility decomposition without marks is one other character, and that character.

    Built from the Unicode data by rule, so that ``translate`` undoes accents and width inside the JVM."""
    src, dst = [], []
    spans = [(0xA0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x10000), (0x1D400, 0x1D800)]
    for lo, hi in spans:
        for cp in range(lo, hi):
            ch = chr(cp)
            if ch != ch.lower():  # the text is lower-cased before
                continue
            plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)).lower()
            if len(plain) == 1 and plain != ch:
                src.append(ch)
                dst.append(plain)
    return "".join(src), "".join(dst)


def fold(c: Column, lookalikes: bool = False) -> Column:
    """Lower case without accents, width variants and invisible characters.

    ASCII text skips the table.  ``lookalikes`` also maps Cyrillic and Greek twins of Latin letters."""
    src, dst = fold_table()

    def wide(x: Column) -> Column:
        y = F.translate(F.lower(x), src, dst)
        y = F.regexp_replace(F.regexp_replace(y, "ﬁ", "fi"), "ﬂ", "fl")
        if lookalikes:
            y = F.translate(y, LOOKALIKE_FROM, LOOKALIKE_TO)
        return F.regexp_replace(y, r"[\p{M}\p{Cf}\u115F\u1160\u3164]+", "")

    plain = let(c, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), wide(x)).otherwise(F.lower(x)))
    return F.regexp_replace(plain, r"[\x00-\x08\x0E-\x1F\x7F]+", "")


def matches_regex(c: Column, pattern: str, case: bool = True) -> Column:
    """True where the start of the text does not match, so that matches come first in ascending order.

    The reference compares case-sensitively; ``case=False`` does not."""
    return ~c.rlike(("" if case else "(?i)") + "^(?:" + java_regex(pattern) + ")")


def count_regex(c: Column, pattern: str) -> Column:
    """Number of non-overlapping matches, irrespective of case."""
    return F.regexp_count(c, F.lit("(?i)" + java_regex(pattern)))


def wildcard_regex(pattern: str) -> str:
    """Shell wildcards as a Java regex that must match the whole text."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append("(?s:.*)")
        elif ch == "?":
            out.append("(?s:.)")
        elif ch == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append(re.escape(ch) if not ch.isalnum() else ch)
        i += 1
    return "".join(out) + r"\z"


def matches_wildcard(c: Column, pattern: str, case: bool = True) -> Column:
    """True where the whole text does not match the shell wildcards."""
    return ~c.rlike(("" if case else "(?i)") + "^" + wildcard_regex(pattern))


def java_regex(pattern: str) -> str:
    """A Python regex for Java: named groups and the end anchor differ; what Python rejects is a ValueError."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"Regex error: {e}") from e
    return pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Last dot part of the file name with its dot, '' if none; a leading dot is no suffix."""
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def with_stem(path: Column, new_stem: Column) -> Column:
    """The path with another stem and the same suffix; null for a path without a name."""
    name = basename(path)
    head = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    return F.when(name.isin("", ".", ".."), F.lit(None).cast("string")).otherwise(
        F.concat(head, new_stem, suffix(path))
    )


def natural_key(c: Column) -> Column:
    """Sort key for file names in which digit runs count as numbers."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def template(pattern: str, **columns: Column) -> Column:
    """``{name}`` placeholders filled from columns; null if any of them is null."""
    pieces, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", pattern):
        if m.group(1) not in columns:
            raise ValueError(f"unknown placeholder {m.group(1)}")
        pieces += [F.lit(pattern[at : m.start()]), columns[m.group(1)].cast("string")]
        at = m.end()
    return F.concat(*pieces, F.lit(pattern[at:]))


def dashed(c: Column) -> Column:
    """Spaces and colons as dashes, as names of files have them."""
    return F.translate(c, " :", "--")


def hex_bytes(c: Column) -> Column:
    """Bytes of a hexadecimal text, null if it is none."""
    return F.when(c.rlike("^(?:[0-9A-Fa-f]{2})*$"), F.unhex(c))
