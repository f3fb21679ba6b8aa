"""Evaluation texts leaking into training text.

Every 13-word window of a test item is a set of nine five-word shingles that a document must hold completely, one after
the other.  Texts are folded and taken apart once: of each document only the runs of at least nine neighbouring
shingles that some item has go on (a bitmap of fixed size knows the shingles of the items), with counts of every
such shingle over all documents.  The necessary prefix of a window is its rarest shingle by these counts; runs meet
windows by prefix only, windows that would stick out of the run are dropped by position, and the 13 words are compared.
Documents are never shuffled, only (document, item) hits are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.text import fold, let
from mediaframe.session import stage

WINDOW = 13
SHINGLE = 5
_TOKENS = WINDOW - SHINGLE + 1
#: Windows of items that may be broadcast (13 words and a hash each, some 200 bytes); beyond, the join shuffles.
MAX_BROADCAST = 100_000
#: Bits of the bitmap of item shingles, 8 MB however many items there are.  False hits only cost work.
BITMAP_BITS = 26
#: Odd multipliers of the words of a shingle (any would do).
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

_BLOCK = r"(?i)</?(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|pre|blockquote)\b[^<>]*>"
_ACCENT = r"&([A-Za-z])(?:acute|grave|circ|uml|tilde|cedil|ring|caron|slash);"


def plain_text(c: Column) -> Column:
    """Text without markup, quote marks at line starts and hyphenation at line ends."""
    when = lambda t, asked, done: let(t, lambda x: F.when(asked(x), done(x)).otherwise(x))
    t = when(c, lambda x: x.rlike(r"[\r\u0085\u2028\u2029]"), lambda x: F.regexp_replace(x, r"\r\n?|[\u0085\u2028\u2029]", "\n"))
    t = when(t, lambda x: x.contains("<"), _without_tags)
    t = when(t, lambda x: x.contains("&"), _without_entities)
    t = when(t, lambda x: x.contains("]("), lambda x: F.regexp_replace(x, r"\]\([^()\s]*\)", "]"))
    quote = r"(?m)^[ \t\u00A0]*(?:[>»|][ \t\u00A0]*)+"
    t = when(t, lambda x: x.rlike("[>»|]"), lambda x: F.regexp_replace(x, quote, ""))
    hyphen = r"(?<=\p{L})[\p{M}\p{Cf}]{0,4}[-\u00AD\u2010\u2011]\p{Cf}{0,4}[ \t]*\n[ \t]*(?=\p{Cf}{0,4}\p{L})"
    ends = r"[-\u00AD\u2010\u2011]\p{Cf}{0,4}[ \t]*\n"
    t = when(t, lambda x: x.rlike(ends), lambda x: F.regexp_replace(x, hyphen, ""))
    inside = r"(?<=[\p{L}\p{N}])(?:\*{1,3}|~~|`)(?=[\p{L}\p{N}])"
    return when(t, lambda x: x.rlike("[*~`]"), lambda x: F.regexp_replace(x, inside, ""))


def _without_tags(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, _BLOCK, " "), r"</?[A-Za-z][^<>]*>|<!--.*?-->", "")


def _without_entities(x: Column) -> Column:
    x = F.regexp_replace(x, _ACCENT, "$1")
    x = F.regexp_replace(x, r"&(?:shy|zwj|zwnj|ZeroWidthSpace|#173|#x[aA][dD]|#820[345]|#x200[bcdBCD]);", "")
    x = F.regexp_replace(x, r"&(?:gt|#62|#x3[eE]);", ">")
    return F.regexp_replace(x, r"&(?:[A-Za-z]+|#\d+|#x[0-9A-Fa-f]+);", " ")


def words(c: Column) -> Column:
    """Runs of letters and digits, compared without case, accents, width and invisible characters."""
    return F.regexp_extract_all(fold(plain_text(c)), F.lit(r"[\p{L}\p{N}]+"), 0)


def _shingles(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, position) of every shingle of the word lists; only distinct words are hashed."""
    offsets = words.offsets.to_numpy()
    flat = words.values[offsets[0] : offsets[-1]].dictionary_encode()
    each = pd.util.hash_array(np.array(flat.dictionary.to_pylist(), object), categorize=False)
    code = flat.indices.to_numpy()
    row = np.repeat(np.arange(len(words)), np.diff(offsets))
    at = np.arange(len(row)) - (offsets[:-1] - offsets[0])[row]
    n = max(0, len(row) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h += each[code[k : k + n]] * _MULTIPLIERS[k] if n else h
    h ^= h >> np.uint64(32)
    h *= _MULTIPLIERS[0]
    whole = row[:n] == row[SHINGLE - 1 :] if n else np.zeros(0, bool)
    return h[whole], row[:n][whole], at[:n][whole]


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, w) with the hashes of all shingles as a third column."""
    for b in batches:
        h, row, _ = _shingles(b.column("w"))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]).astype(np.int32)
        sh = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("item"), b.column("w"), sh], names=["item", "w", "sh"])


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bitmap of a column ``h`` of hashes.  It is put together in pieces of 4 KB; the driver gets these, 8 MB at most."""
    slot = F.shiftrightunsigned("h", 64 - BITMAP_BITS) + 1
    pieces = hashes.groupBy(F.bitmap_bucket_number(slot).alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in pieces.collect():
        piece = np.frombuffer(bytes(r.bits), np.uint8)
        out[(r.no - 1) * len(piece) : r.no * len(piece)] = piece
    return out


def _run_finder(shared):
    """Word lists of documents to runs (doc, w, sh) and, per batch, counts (h, n) of the shingles in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            words = b.column("w")
            h, row, at = _shingles(words)
            slot = _slots(h)
            hit = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
            if not len(hit):
                continue
            first = np.ones(len(hit), bool)
            first[1:] = (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]])
            starts = np.flatnonzero(first)
            size = np.diff(np.append(starts, len(hit)))
            starts, size = starts[size >= _TOKENS], size[size >= _TOKENS]
            counted, n = np.unique(h[hit], return_counts=True)
            spread = lambda begin, length: np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
            ends = lambda length: pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
            begin = hit[starts]
            base = words.offsets.to_numpy()[row[begin]] + at[begin]
            w = pa.ListArray.from_arrays(ends(size + SHINGLE - 1), words.values.take(pa.array(spread(base, size + SHINGLE - 1))))
            sh = pa.ListArray.from_arrays(ends(size), pa.array(h[spread(begin, size)].view(np.int64)))
            none = lambda kind, m: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([b.column("doc").take(pa.array(row[begin])), none(b.column("doc").type, len(n))]),
                    pa.concat_arrays([w, none(w.type, len(n))]),
                    pa.concat_arrays([sh, none(sh.type, len(n))]),
                    pa.concat_arrays([none(pa.int64(), len(begin)), pa.array(counted.view(np.int64))]),
                    pa.concat_arrays([none(pa.int64(), len(begin)), pa.array(n.astype(np.int64))]),
                    pa.array(np.arange(len(begin) + len(n)) < len(begin)),
                ],
                names=["doc", "w", "sh", "h", "n", "is_run"],
            )

    return run


def leaked_windows(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(key, item, first_window, n_windows): documents that hold at least 13 consecutive words of an item.

    Case, accents, width, invisible characters, markup, quote marks at line starts and hyphenation at line ends do not
    matter.  Null, empty and short texts and items of fewer than 13 words match nothing; equal texts each report their
    own hits; a null key or item id is kept as it is.  Whole texts of any length are searched."""
    spark = documents.sparkSession
    kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    it = items.select(F.col(item).alias("item"), words(F.col(item_text)).alias("w")).filter(F.size("w") >= WINDOW)
    it = stage(it.mapInArrow(_with_shingles, f"item {item_kind}, w array<string>, sh array<bigint>"), "items")
    shared = spark.sparkContext.broadcast(_bitmap(it.select(F.explode("sh").alias("h"))))
    # explode of the one word list keeps the filter behind it, so the text is taken apart once
    docs = documents.select(F.col(key).alias("doc"), F.explode(F.array(words(F.col(text)))).alias("w")).filter(F.size("w") >= WINDOW)
    found = docs.mapInArrow(_run_finder(shared), f"doc {kind}, w array<string>, sh array<bigint>, h bigint, n bigint, is_run boolean")
    found = stage(found, "runs", by="is_run")
    counts = found.filter("not is_run").groupBy("h").agg(F.sum("n").alias("n"))
    starts = F.sequence(F.lit(0), F.size("w") - WINDOW)
    windows = it.select("item", "w", "sh", F.explode(starts).alias("start")).select(
        "item", "start", F.slice("w", F.col("start") + 1, F.lit(WINDOW)).alias("ww"), F.slice("sh", F.col("start") + 1, F.lit(_TOKENS)).alias("sh")
    )
    tokens = windows.select("item", "start", F.posexplode("sh").alias("o", "h")).join(counts, "h", "left")
    prefix = (  # windows with a shingle that no document has cannot occur
        tokens.groupBy("item", "start")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "o")).alias("x"))
        .filter("x.n > 0")
        .select("item", "start", "x.h", "x.o")
        .join(windows.select("item", "start", "ww"), ["item", "start"])
    )
    prefix = stage(prefix, "prefix")
    small = prefix.count() <= MAX_BROADCAST
    back = WINDOW - SHINGLE
    at = F.greatest(F.col("p") - back, F.lit(0))
    # of each place the words around it, so that a shuffled row stays small whatever the length of the run
    spread = found.filter("is_run").select("doc", "w", F.posexplode("sh").alias("p", "h"))
    spread = spread.select("doc", "h", (F.col("p") - at).alias("here"), F.slice("w", at + 1, F.lit(back + WINDOW)).alias("ctx"))
    begin = F.col("here") - F.col("o")
    return (
        spread.join(F.broadcast(prefix) if small else prefix, "h")
        .filter((begin >= 0) & (begin + WINDOW <= F.size("ctx")))
        .filter(F.slice("ctx", begin + 1, F.lit(WINDOW)) == F.col("ww"))
        .groupBy("doc", "item")
        .agg(F.min("start").alias("first_window"), F.count_distinct("start").alias("n_windows"))
        .select(F.col("doc").alias(key), F.col("item").alias(item), "first_window", "n_windows")
    )
