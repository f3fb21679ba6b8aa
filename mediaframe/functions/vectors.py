"""Vectors and packed bit hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_squared(a: Column, b: Column) -> Column:
    """Squared distance in double; null elements give null."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def hash_words(c: Column, n_bytes: int) -> Column:
    """A binary hash as 64-bit words, the last one padded with zero bits."""
    words = [F.rpad(F.hex(F.substring(c, 1 + 8 * i, 8)), 16, "0") for i in range((n_bytes + 7) // 8)]
    return F.array(*[F.conv(w, 16, -10).cast("bigint") for w in words])


def sign_word(vector: Column) -> Column:
    """The signs of the first 64 elements as one word, element 0 in the lowest bit."""
    bits = F.transform(F.slice(vector, 1, 64), lambda x, i: F.call_function("shiftleft", F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"), i))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda w, x: w.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    """Number of different bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def total_variation(grid: Column, height: int, width: int, norm: str = "l2") -> Column:
    """Total variation of a row-major grid in signed arithmetic; norms ``l1``, ``l2``, ``l2_squared``."""
    g = F.transform(grid, lambda x: x.cast("double"))
    at = lambda y, x: g[y * width + x]
    down = [at(y + 1, x) - at(y, x) for y in range(height - 1) for x in range(width)]
    right = [at(y, x + 1) - at(y, x) for y in range(height) for x in range(width - 1)]
    if norm == "l1":
        return _sum([F.abs(d) for d in down + right])
    total = _sum([d * d for d in down]) + _sum([d * d for d in right])
    if norm == "l2_squared":
        return total
    if norm == "l2":
        return F.sqrt(total)
    raise ValueError(f"unknown norm {norm}")


def _sum(columns: list[Column]) -> Column:
    return F.aggregate(F.array(*columns), F.lit(0.0), lambda s, x: s + x)


def laplacian_variance(grid: Column, height: int, width: int) -> Column:
    """Population variance of the 4-neighbour Laplacian over the inner pixels."""
    g = F.transform(grid, lambda x: x.cast("double"))
    at = lambda y, x: g[y * width + x]
    values = F.array(
        *[
            at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x)
            for y in range(1, height - 1)
            for x in range(1, width - 1)
        ]
    )
    n = (height - 2) * (width - 2)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x) / n - mean * mean


def gamma_table(inv_in: float, inv_out: float = 1 / 2.2) -> list[int]:
    """256 entries ``(i/255)^(inv_out/inv_in) * 255``, cut to whole numbers."""
    return [int((i / 255) ** (inv_out / inv_in) * 255) for i in range(256)]


def apply_table(pixels: Column, table: list[int]) -> Column:
    lut = F.array(*[F.lit(x) for x in table])
    return F.transform(pixels, lambda p: lut[p.cast("int")])


def product(shape: Column) -> Column:
    """Product of the elements, 1 for an empty array."""
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda p, x: p * x.cast("bigint"))


def concatenated(chunks: Column) -> Column:
    """One array out of an array of arrays; no chunks give an empty array."""
    return F.flatten(chunks)
