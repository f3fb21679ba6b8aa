"""Splitting oversized items at natural boundaries."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.text import source_key, token_count

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Natural boundaries lie at the end of these matches.
BOUNDARY = re.compile(r"\n|[.!?](?=\s|$)|。")
#: Strength of a cut: inside a stretch, after a sentence, after a line, between paragraphs.
INSIDE, SENTENCE, LINE, PARAGRAPH = range(4)


def boundaries(text: str) -> list[tuple[int, int]]:
    """(position, strength) of the natural boundaries inside the text."""
    found: list[tuple[int, int]] = []
    last_feed = -2  # position of the line feed before
    for m in BOUNDARY.finditer(text):
        strength, at = SENTENCE, m.start()
        if m.group() == "\n":
            blank = last_feed == at - 1 or (last_feed == at - 2 and text[at - 1] == "\r")
            strength, last_feed = PARAGRAPH if blank else LINE, at
        if m.end() < len(text):
            found.append((m.end(), strength))
    return found


def _atoms(spans: list[tuple[int, int]], marks: list[tuple[int, int]], limit: int, overlap: int) -> tuple[list[int], list[int], bool]:
    """(tokens per atom, strength of the cut after each, forced): the stretches between natural boundaries.

    A stretch that fits no piece, together with the overlap that it would have, is cut between tokens."""
    sizes: list[int] = []
    cuts: list[int] = []
    forced, at = False, 0
    for position, strength in marks:
        first = at
        while at < len(spans) and spans[at][0] < position:
            at += 1
        n = at - first
        forced |= n > limit
        if not n:  # nothing between two boundaries: the stronger one counts
            if cuts:
                cuts[-1] = max(cuts[-1], strength)
            continue
        while n > (room := limit - min(overlap, at - n)):
            sizes.append(room)
            cuts.append(INSIDE)
            n -= room
        sizes.append(n)
        cuts.append(strength)
    return sizes, cuts, forced


def split_text(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Pieces (start, end, tokens, shared) of a text and whether a cut was forced.

    ``start`` and ``end`` are positions in the text, ``tokens`` the size of the piece, of which the first ``shared``
    are the last ones of the piece before.  Adjacent atoms are merged, the weakest boundary first (among equal ones the
    one with the smaller sum, then the left one), while their tokens and the overlap before them fit the limit; a piece
    at the start of the text has no overlap, one behind fewer tokens than the overlap shares these."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    if not spans:
        return [], 0
    overlap = max(0, min(overlap, limit - 1))
    sizes, cuts, forced = _atoms(spans, [*boundaries(text), (len(text) + 1, PARAGRAPH)], limit, overlap)
    before = [0] * len(sizes)  # tokens before each atom
    for i in range(1, len(sizes)):
        before[i] = before[i - 1] + sizes[i - 1]
    alive, right, left = [True] * len(sizes), list(range(1, len(sizes) + 1)), list(range(-1, len(sizes) - 1))
    fits = lambda i, j: sizes[i] + sizes[j] + min(overlap, before[i]) <= limit
    heap = [(cuts[i], sizes[i] + sizes[i + 1], i, i + 1) for i in range(len(sizes) - 1) if fits(i, i + 1)]
    heapq.heapify(heap)
    while heap:
        _, total, i, j = heapq.heappop(heap)
        if not alive[i] or not alive[j] or right[i] != j or sizes[i] + sizes[j] != total:
            continue
        sizes[i], alive[j], cuts[i], right[i] = total, False, cuts[j], right[j]
        if right[i] < len(sizes):
            left[right[i]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < len(sizes) and fits(a, b):
                heapq.heappush(heap, (cuts[a], sizes[a] + sizes[b], a, b))
    pieces, at = [], 0
    for i in range(len(sizes)):
        if alive[i]:
            shared = min(overlap, at)
            pieces.append((spans[at - shared][0], spans[at + sizes[i] - 1][1], sizes[i] + shared, shared))
            at += sizes[i]
    return pieces, int(forced)


def split_oversized(
    documents: DataFrame,
    limits: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(key, piece_no, piece, tokens, shared, forced): the pieces of each document larger than the limit of its source.

    * Sizes are tokens of the public word-and-punctuation pattern; pieces of neighbouring numbers share
      ``overlap_tokens`` of the source (fewer only where the text before is shorter); no piece exceeds ``max_tokens``.
    * ``forced`` is 1 for documents with a stretch between natural boundaries that alone exceeds the limit.
    * Documents that fit, null texts, and null or unlisted sources give no row.  A limit below 1 counts as 1.
    * Each document is split by itself, in the order it comes: no shuffle, whatever its length or source.
    """
    lim = limits.select(
        source_key(F.col("source")).alias("_s"),
        F.greatest(F.col("max_tokens"), F.lit(1)).alias("_max"),
        F.coalesce("overlap_tokens", F.lit(0)).alias("_over"),
    ).filter("_s is not null and _max is not null")
    large = (
        documents.select(F.col(key).alias("k"), source_key(F.col(source)).alias("_s"), F.col(text).alias("t"))
        .filter("_s is not null and t is not null")
        .join(lim, "_s")
        .filter(token_count(F.col("t")) > F.col("_max"))
        .select("k", "t", "_max", "_over")
    )
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "piece_no", "piece", "tokens", "shared", "forced"]
        for b in batches:
            rows = []
            for k, t, limit, overlap in b.itertuples(index=False):
                pieces, forced = split_text(t, int(limit), int(overlap))
                rows += [(k, i, t[x:y], n, shared, forced) for i, (x, y, n, shared) in enumerate(pieces)]
                if len(rows) > 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return large.mapInPandas(run, f"`{key}` {kind}, piece_no int, piece string, tokens int, shared int, forced int")


def oversized_documents(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, forced): one row per split document, taken from its first piece."""
    return pieces.filter("piece_no = 0").select(key, "forced")
