"""Free-entered values to the entries of a reference list, in SQL expressions only.

A name is folded and split into its letters (which may be misspelt) and its signature: numbers, generation and grade,
which have to be equal.  The letters of every reference name of length L are cut into k+1 segments; a text within k
edits holds one of them unchanged and hardly moved, so an equality join on (signature, L, segment number, substring)
finds every candidate.  Candidates are verified with the built-in levenshtein; what is left over is reported by an
anti-join.  Texts are made distinct first, so a value that fills a third of all rows is matched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.text import fold, outer_trim

#: Words around a name that name nothing (fixed values): packaging, regions, legal forms.
NOISE = (
    "camera", "cameras", "digital", "body", "kit", "eu", "us", "uk", "jp", "intl", "corporation", "corp", "company",
    "co", "ltd", "limited", "gmbh", "inc", "incorporated", "llc", "ag", "kg", "kk", "sa", "spa", "bv", "plc",
)
#: Texts of a maker field that give no maker (fixed values).
NO_MAKER = ("", "unknown", "na", "n a", "none", "null", "nan", "no name available", "unbekannt", "undefined", "other")
#: Greatest number of edits of any text; the built-in levenshtein gives up beyond it.
MOST_EDITS = 5
#: Rows of reference segments that may be broadcast; beyond, the join shuffles.
MAX_BROADCAST = 500_000
#: Grades (fixed values) that end a name without a number and must be equal.
_GRADED = r"^([a-z ]*?[a-z]{3})((?: *(?:pro|lite|plus|max|mini|ultra))+)$"
_ROMAN = {"iii": "3", "ii": "2", "iv": "4", "vi": "6", "v": "5", "i": "1"}


def _k_sql(length: str) -> str:
    """Allowed edits of a name or a maker by its number of letters; two swapped pairs of neighbours are four edits."""
    return f"case when {length} <= 2 then 0 when {length} <= 4 then 1 when {length} <= 7 then 3 when {length} <= 12 then 4 else 5 end"


def plain_name(c: Column) -> Column:
    """Lower-case words of letters and of digits; ``#n`` is a generation, a letter before a number stays with it."""
    x = F.regexp_replace(fold(F.coalesce(c, F.lit("")), lookalikes=True), "[^a-z0-9]+", " ")
    x = F.regexp_replace(x, "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ")
    x = F.regexp_replace(x, r"(?:digital *)?camera\b|digital\b", " ")  # also where they are glued to a word
    x = F.regexp_replace(x, r"\b(?:" + "|".join(NOISE) + r")\b", " ")
    x = F.regexp_replace(x, r"\b(?:mark|mk) *(iii|ii|iv|vi|v|i|[0-9]+)\b", " #$1 ")
    x = F.regexp_replace(x, r"(?<![#a-z])\b(iii|ii|iv|vi)\b", " #$1 ")
    for roman, digit in _ROMAN.items():
        x = F.regexp_replace(x, rf"#{roman}\b", f"#{digit}")
    x = F.regexp_replace(x, r"(?<= |^)([a-z]) +([0-9]+)\b", "$1$2")
    return F.trim(F.regexp_replace(x, " +", " "))


def _words(plain: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(plain, r"^((?:[a-z]+(?: |$))*)", 1), " ", "")


def _letters(plain: Column) -> Column:
    return _words(F.when(plain.rlike(_GRADED), F.regexp_extract(plain, _GRADED, 1)).otherwise(plain))


def _signature(plain: Column) -> Column:
    """What must be equal: all from the first number on, or else the grade; '' if there is neither."""
    grade = F.regexp_replace(F.regexp_extract(plain, _GRADED, 2), " ", "")
    return F.when(plain.rlike(_GRADED), grade).otherwise(F.regexp_replace(plain, r"^(?:[a-z]+(?: |$))*", ""))


def reference_names(reference: DataFrame) -> DataFrame:
    """(model_id, maker_letters, letters, sig): every way to name an entry, with and without its maker."""
    m = lambda *c: plain_name(F.concat_ws(" ", *[F.col(x) for x in c]))
    ways = [w for n in ("model", "alias", "model_code") for w in ((n,), ("maker", n))]
    forms = F.array(*[F.when(F.col(w[-1]).isNotNull(), m(*w)) for w in ways])
    return (
        reference.select("model_id", plain_name(F.col("maker")).alias("mk"), F.explode(forms).alias("plain"))
        .filter("plain is not null and plain <> ''")
        .select("model_id", _words(F.col("mk")).alias("maker_letters"), _letters(F.col("plain")).alias("letters"), _signature(F.col("plain")).alias("sig"))
        .distinct()
    )


def reference_segments(names: DataFrame) -> DataFrame:
    """The k+1 segments of every name: (…, len, k, seg_no, seg)."""
    return names.selectExpr("*", "length(letters) as len").selectExpr("*", f"{_k_sql('len')} as k").selectExpr(
        "*",
        """posexplode(transform(sequence(0, k), i ->
             substring(letters, cast(floor(i * len / (k + 1)) as int) + 1,
                       cast(floor((i + 1) * len / (k + 1)) - floor(i * len / (k + 1)) as int)))) as (seg_no, seg)""",
    )


def text_substrings(texts: DataFrame, most: int = MOST_EDITS) -> DataFrame:
    """The substrings of every text at which a segment of a name of length ``len`` can lie, shifts included.

    Segment i starts at most i edits off its place, and the edits after it have to make up for the lengths."""
    per_length = texts.selectExpr("*", "length(letters) as n").selectExpr(
        "*", f"explode(sequence(greatest(n - {most}, 0), n + {most})) as len"
    ).selectExpr("*", f"{_k_sql('len')} as k").filter("abs(n - len) <= k")
    per_segment = per_length.selectExpr("*", "explode(sequence(0, k)) as seg_no").selectExpr(
        "*",
        "cast(floor(seg_no * len / (k + 1)) as int) as p",
        "cast(floor((seg_no + 1) * len / (k + 1)) - floor(seg_no * len / (k + 1)) as int) as size",
        "greatest(-seg_no, n - len - (k - seg_no)) as lo",
        "least(seg_no, n - len + (k - seg_no)) as hi",
    ).filter("lo <= hi")
    return (
        per_segment.selectExpr("*", "explode(sequence(lo, hi)) as shift")
        .filter("p + shift >= 0 and p + shift + size <= n")
        .selectExpr("*", "substring(letters, p + shift + 1, size) as seg")
        .drop("p", "size", "lo", "hi", "shift", "n")
    )


def match_names(items: DataFrame, reference: DataFrame) -> DataFrame:
    """(maker, model, model_id, distance): the entry that each distinct pair of texts names, no row if none.

    The name may stand in either field, the maker in either field or nowhere; a given maker has to be the entry's.
    The nearest entry wins; texts that are as near to several entries name none."""
    pairs = items.select("maker", "model").distinct()
    both = pairs.select("maker", "model", plain_name(F.col("maker")).alias("pm"), plain_name(F.col("model")).alias("pn"))
    side = lambda text, other: F.struct(F.col(text).alias("plain"), F.col(other).alias("other"))
    texts = both.select("maker", "model", F.explode(F.array(side("pn", "pm"), side("pm", "pn"))).alias("x")).select(
        "maker", "model", _letters(F.col("x.plain")).alias("letters"), _signature(F.col("x.plain")).alias("sig"), F.col("x.other").alias("other")
    )
    texts = texts.selectExpr(  # a letter glued to the word before may belong to the number
        "maker", "model", "other",
        """inline(array_compact(array(
             named_struct('letters', letters, 'sig', sig),
             if(length(letters) > 1 and sig rlike '^[0-9]', named_struct(
                'letters', left(letters, length(letters) - 1), 'sig', concat(right(letters, 1), sig)), null)))) as (letters, sig)""",
    )
    names = reference_names(reference)
    makers = names.select("maker_letters").distinct()
    segments = reference_segments(names)
    small = segments.count() <= MAX_BROADCAST
    # only signatures of the list are cut into substrings
    sigs = names.select("sig").distinct()
    texts = texts.join(F.broadcast(sigs) if small else sigs, "sig", "left_semi")
    probe = text_substrings(texts.select("letters", "sig").distinct())
    refs = segments.withColumnRenamed("letters", "ref")
    found = (
        probe.join(F.broadcast(refs) if small else refs, ["sig", "len", "k", "seg_no", "seg"])
        .select("letters", "sig", "model_id", "maker_letters", "ref", "k")
        .distinct()
        .withColumn("d", F.levenshtein("letters", "ref", MOST_EDITS))
        .filter("d between 0 and k")
    )
    given = F.regexp_replace("other", " ", "")
    none = [x.replace(" ", "") for x in NO_MAKER]
    scored = texts.withColumn("given", F.when(given.isin(*none), F.lit(None)).otherwise(given)).join(found, ["letters", "sig"])
    scored = scored.join(makers.withColumnRenamed("maker_letters", "given").withColumn("is_maker", F.lit(True)), "given", "left")
    near = F.levenshtein("given", "maker_letters", MOST_EDITS)
    maker_k = F.expr(_k_sql("length(maker_letters)"))
    scored = scored.withColumn("md", F.when(F.col("given").isNull(), 0).otherwise(near)).filter(F.col("md").between(0, maker_k))
    scored = scored.filter("md = 0 or is_maker is null")  # the name of another maker is no misspelling
    best = scored.groupBy("maker", "model", "model_id").agg(F.min(F.col("d") + F.col("md")).alias("distance"))
    return (
        best.groupBy("maker", "model")
        .agg(F.min(F.struct("distance", "model_id")).alias("w"), F.min(F.struct("distance", -F.col("model_id"))).alias("v"))
        .filter("w.model_id = -v.col2")  # the smallest and the largest of the nearest entries
        .select("maker", "model", "w.model_id", "w.distance")
    )


def map_to_canonical(items: DataFrame, reference: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, model_id): every item whose model is not blank and whose texts are not those of one entry; 0 if none is named.

    Blank means null, white space and NULs.  An item whose maker and model equal an entry to the letter needs no
    mapping and has no row.  Repeated items each have a row; an empty reference list names nothing."""
    need = items.select(F.col(key).alias("key"), "maker", "model").filter(outer_trim(F.col("model")) != "")
    exact = reference.select("maker", "model").filter("maker is not null and model is not null").distinct()
    need = need.join(exact, ["maker", "model"], "left_anti")
    named = match_names(need, reference)
    same = F.col("n.maker").eqNullSafe(F.col("m.maker")) & (F.col("n.model") == F.col("m.model"))
    hits = need.alias("n").join(named.alias("m"), same).select("key", "m.model_id")
    misses = need.alias("n").join(named.alias("m"), same, "left_anti").select("key", F.lit(0).cast("bigint").alias("model_id"))
    return hits.union(misses).withColumnRenamed("key", key)
