"""Content hashes and image scores.  Pixel work runs in Arrow batches on decoded images."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL_SIDE = 256
PHASH_SIDE, PHASH_LOW = 64, 16


def file_sha256(content: Column) -> Column:
    """32 bytes over the file as it is."""
    return F.unhex(F.sha2(content, 256))


def _grid(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def _grey(image: np.ndarray) -> np.ndarray:
    if image.shape[2] == 1:
        return image[:, :, 0].astype(np.float64)
    b, g, r = (image[:, :, i].astype(np.float64) for i in range(3))
    return 0.114 * b + 0.587 * g + 0.299 * r


def _shrink(plane: np.ndarray, side: int) -> np.ndarray:
    """Area average to side × side, by summing weighted rows and columns."""

    def weights(n: int) -> np.ndarray:
        edges = np.linspace(0, n, side + 1)
        cells = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, 1) * side / n

    return weights(plane.shape[0]) @ plane @ weights(plane.shape[1]).T


def pixel_hash_bytes(image: np.ndarray) -> bytes:
    """SHA-256 of the picture brought to a fixed size and turned so that its brightest corner comes first."""
    import hashlib

    planes = np.stack([_shrink(image[:, :, c].astype(np.float64), PIXEL_SIDE) for c in range(image.shape[2])], -1)
    half = PIXEL_SIDE // 2
    corners = [np.rot90(planes, k)[:half, :half].sum() for k in range(4)]
    return hashlib.sha256(np.ascontiguousarray(np.rot90(planes, int(np.argmax(corners))).round().astype(np.uint8)).tobytes()).digest()


def perceptual_hash_bytes(image: np.ndarray) -> bytes:
    """256 bits: low block of the DCT-II of the grey picture against its median."""
    n = np.arange(PHASH_SIDE)
    dct = np.cos(np.pi * (2 * n[None, :] + 1) * n[:, None] / (2 * PHASH_SIDE))
    low = (dct @ _shrink(_grey(image), PHASH_SIDE) @ dct.T)[:PHASH_LOW, :PHASH_LOW]
    return np.packbits((low > np.median(low)).ravel()).tobytes()


def total_variation(image: np.ndarray) -> float:
    x = image.astype(np.int64)
    return float(np.sqrt((np.diff(x, axis=0) ** 2).sum() + (np.diff(x, axis=1) ** 2).sum()))


def laplacian_variance(image: np.ndarray) -> float:
    g = _grey(image)
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var()) if min(g.shape) > 2 else float("nan")


def equalise(image: np.ndarray) -> np.ndarray:
    """Histogram equalisation of a grey 8-bit picture through its cumulative counts."""
    counts = np.bincount(image.ravel(), minlength=256)
    total = np.cumsum(counts)
    low = total[np.nonzero(counts)[0][0]]
    table = np.round((total - low) / max(1, image.size - low) * 255).clip(0, 255).astype(np.uint8)
    return table[image]


def _per_image(f: Callable, kind: str) -> Callable[[Column, Column, Column, Column], Column]:
    @F.pandas_udf(f"struct<value {kind}, error string>")
    def run(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
        values, errors = [], []
        for h, w, c, d in zip(height, width, channels, data):
            try:
                values.append(f(_grid(h, w, c, d)))
                errors.append(None)
            except Exception as e:  # one bad picture must not stop the others
                values.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    return run


#: Providers by name: hash modes and scores, each a function of one decoded picture.
PROVIDERS: dict[str, tuple[Callable, str]] = {
    "image-hash": (pixel_hash_bytes, "binary"),
    "phash": (perceptual_hash_bytes, "binary"),
    "total-variation": (total_variation, "double"),
    "laplacian": (laplacian_variance, "double"),
}


def register_provider(name: str, function: Callable, kind: str) -> None:
    PROVIDERS[name] = (function, kind)


def image_values(images: DataFrame, provider: str) -> DataFrame:
    """``images`` with ``value`` and ``error`` of a provider; bad pictures have an error instead of a value."""
    f, kind = PROVIDERS[provider]
    got = _per_image(f, kind)(F.col("height"), F.col("width"), F.col("nChannels"), F.col("data"))
    return images.withColumn("_r", got).select(*images.columns, "_r.value", "_r.error")


def quarantine(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows)."""
    return values.filter("error is null").drop("error"), values.filter("error is not null")


def quality_scores(images: DataFrame, limit: int | None = None) -> DataFrame:
    """Scores per picture that need no model, a failed one null; with a limit the first pictures by path."""
    if limit is not None:
        images = images.orderBy("origin").limit(limit)
    out = images
    for name in ("total-variation", "laplacian"):
        out = image_values(out, name).withColumnRenamed("value", name.replace("-", "_")).drop("error")
    return out.drop("data")
