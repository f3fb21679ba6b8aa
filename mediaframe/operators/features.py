"""Vectors, features and scores that a model makes of pictures, and pictures made of pictures.

No model is part of this package: functions take arrays and are passed in, Spark brings them batches of bounded size.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.operators.hashing import _grey, _grid, _shrink, equalise

_PIXELS = ("height", "width", "nChannels", "data")


def embeddings(images: DataFrame, model: Callable[[np.ndarray], np.ndarray], side: int = 224, batch: int = 100) -> DataFrame:
    """``origin, vector`` of each decoded picture: ``model`` gets (n, side, side, 3) floats from 0 to 1 in RGB order and
    gives n vectors.  Grey pictures are left out, as are those whose model call fails with them alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                x = np.stack([_resized(_grid(r.height, r.width, r.nChannels, r.data), side, side)[:, :, 2::-1] / 255.0 for r in part.itertuples()])
                yield pd.DataFrame({"origin": part.origin.to_numpy(), "vector": list(np.asarray(model(x), np.float64))})

    colour = images.filter("nChannels >= 3").select("origin", *_PIXELS)
    return colour.mapInPandas(run, "origin string, vector array<double>")


def picture_vectors(images: DataFrame, model: Callable[[np.ndarray], Iterable[float]]) -> DataFrame:
    """``origin, vector`` of each decoded picture, grey ones too, by a function of one picture; null where it fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            vectors = []
            for r in b.itertuples():
                try:
                    vectors.append(np.asarray(list(model(_grid(r.height, r.width, r.nChannels, r.data))), np.float64))
                except Exception:  # one bad picture must not stop the others
                    vectors.append(None)
            yield pd.DataFrame({"origin": b.origin, "vector": pd.Series(vectors, index=b.index, dtype=object)})

    return images.select("origin", *_PIXELS).mapInPandas(run, "origin string, vector array<double>")


def features(images: DataFrame, find: Callable[[np.ndarray], Iterable[tuple[tuple[int, int, int, int], np.ndarray]]]) -> DataFrame:
    """(origin, no, top, right, bottom, left, vector): what ``find`` sees in each picture, none to many rows.

    A picture on which ``find`` fails has one row with an error and nothing else."""
    names = ["origin", "no", "top", "right", "bottom", "left", "vector", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            rows = []
            for r in b.itertuples():
                try:
                    for i, (box, v) in enumerate(find(_grid(r.height, r.width, r.nChannels, r.data))):
                        rows.append((r.origin, i, *map(int, box), np.asarray(v, np.float64), None))
                except Exception as e:  # one bad picture must not stop the others
                    rows.append((r.origin, *[None] * 6, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names).astype(dict.fromkeys(names[1:6], "Int32"))

    schema = "origin string, no int, top int, right int, bottom int, left int, vector array<double>, error string"
    return images.select("origin", *_PIXELS).mapInPandas(run, schema)


def model_scores(images: DataFrame, scorers: dict[str, Callable[[np.ndarray], float]], names: Iterable[str]) -> DataFrame:
    """(origin, one column per name): scores of the pictures; null where a scorer fails or there is none of that name."""
    names = list(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            out = {"origin": b.origin.to_numpy()}
            grids = [_grid(r.height, r.width, r.nChannels, r.data) for r in b.itertuples()]
            for name in names:
                out[name] = [_score(scorers.get(name), g) for g in grids]
            yield pd.DataFrame(out)

    return images.select("origin", *_PIXELS).mapInPandas(run, "origin string, " + ", ".join(f"`{n}` double" for n in names))


def _score(f: Callable | None, grid: np.ndarray) -> float | None:
    try:
        return float(f(grid)) if f else None
    except Exception:
        return None


def _resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average to the given size."""
    side = max(height, width)
    if height == width:
        return np.stack([_shrink(image[:, :, c].astype(np.float64), side) for c in range(image.shape[2])], -1)

    def weights(n: int, m: int) -> np.ndarray:
        edges, cells = np.linspace(0, n, m + 1), np.arange(n)
        return np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, 1) * m / n

    return np.einsum("ij,jkc,lk->ilc", weights(image.shape[0], height), image.astype(np.float64), weights(image.shape[1], width))


def thumbnail(image: np.ndarray, most: int) -> np.ndarray:
    """The picture within a square of ``most`` pixels; smaller ones stay as they are."""
    scale = min(1.0, most / max(image.shape[:2]))
    h, w = (max(1, round(n * scale)) for n in image.shape[:2])
    return image if scale == 1.0 else _resized(image, h, w).round().clip(0, 255).astype(np.uint8)


def rotate(image: np.ndarray, quarter_turns: int) -> np.ndarray:
    """Turned clockwise, without loss."""
    return np.ascontiguousarray(np.rot90(image, -quarter_turns))


def grey(image: np.ndarray) -> np.ndarray:
    return _grey(image).round().astype(np.uint8)[:, :, None]


def autocontrast(image: np.ndarray) -> np.ndarray:
    """Each channel stretched to the whole range; a flat one stays."""
    out = image.astype(np.float64)
    low, high = out.min((0, 1)), out.max((0, 1))
    scale = np.where(high > low, 255 / np.where(high > low, high - low, 1), 1)
    return np.where(high > low, (out - low) * scale, out).round().astype(np.uint8)


def equalised(image: np.ndarray) -> np.ndarray:
    """Histogram equalisation, each channel by itself."""
    return np.stack([equalise(image[:, :, c]) for c in range(image.shape[2])], -1)


#: View filters by name; a chain of them is applied in the order given.
FILTERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"grey": grey, "autocontrast": autocontrast, "equalise": equalised}


def png_bytes(image: np.ndarray) -> bytes:
    """A PNG file of a grey, BGR or BGRA picture."""
    h, w, c = image.shape
    rgb = image if c == 1 else image[:, :, [2, 1, 0, *range(3, c)]]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * c)], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def edited(images: DataFrame, edit: Callable[[np.ndarray], np.ndarray], filters: Iterable[str] = ()) -> DataFrame:
    """(origin, content, error): each picture after ``edit`` and a chain of view filters, as a PNG file."""
    chain = [edit, *[FILTERS[f] for f in filters]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            rows = []
            for r in b.itertuples():
                try:
                    x = _grid(r.height, r.width, r.nChannels, r.data)
                    for f in chain:
                        x = f(x)
                    rows.append((r.origin, png_bytes(x), None))
                except Exception as e:  # one bad picture must not stop the others
                    rows.append((r.origin, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["origin", "content", "error"])

    return images.select("origin", *_PIXELS).mapInPandas(run, "origin string, content binary, error string")


def grid_image(vector: Column, height: int, width: int, origin: Column) -> list[Column]:
    """Columns of a decoded grey picture from a row-major grid of numbers from 0 to 255."""
    data = F.unhex(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(F.floor(F.least(F.greatest(x, F.lit(0)), F.lit(255)))), 2, "0")), ""))
    return [origin.cast("string").alias("origin"), F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(1).alias("nChannels"), data.alias("data")]


def rotation_model(images: DataFrame, side: int = 12, seed: int = 0):
    """A classifier of quarter turns, trained on upright pictures and their turned copies: (model, share that it gets right
    on held-out pictures, cross-entropy there).

    A multinomial regression on small grey thumbnails takes the place of a network; a fifth of the pictures is held out
    by a hash of their names, with all four turns of each."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from mediaframe.operators.stats import accuracy, cross_entropy

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            rows = []
            for r in b.itertuples():
                x = _shrink(_grey(_grid(r.height, r.width, r.nChannels, r.data)), side) / 255.0
                rows += [(r.origin, k, rotate(x, k).ravel()) for k in range(4)]
            yield pd.DataFrame(rows, columns=["origin", "label", "x"])

    rows = images.select("origin", *_PIXELS).mapInPandas(run, "origin string, label int, x array<double>")
    rows = rows.select("origin", "label", array_to_vector("x").alias("features"))
    held = F.pmod(F.xxhash64(F.lit(seed), "origin"), F.lit(5)) == 0
    model = LogisticRegression(maxIter=50, regParam=0.01, family="multinomial").fit(rows.filter(~held))
    tried = model.transform(rows.filter(held)).select("label", F.col("prediction").cast("int").alias("p"), vector_to_array("probability").alias("q"))
    right, entropy = accuracy(tried, "p", "label").first()[0], cross_entropy(tried, "q", "label").first()[0]
    return model, right, entropy
