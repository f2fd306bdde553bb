"""Perceptual hashes of images (X25, E09): Spark's image source decodes in the JVM, numpy hashes whole batches.

The hash is the usual one of 64 bits: grey values, reduced to 32 by 32 pixels, a two-dimensional cosine
transform, of which the 8 by 8 lowest frequencies are compared with their median.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SIDE, LOW = 32, 8
#: Lobes of the filter that reduces an image.
LOBES = 3


@cache
def cosines() -> np.ndarray:
    """The first rows of a cosine transform of type two, float64 [LOW, SIDE]."""
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None]
    return 2 * np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


@cache
def reduction(size: int) -> np.ndarray:
    """Weights of windowed sinc interpolation from ``size`` pixels to SIDE, float64 [SIDE, size]."""
    step = size / SIDE
    wide = max(step, 1.0)
    centre = (np.arange(SIDE) + 0.5) * step
    x = (np.arange(size)[None] + 0.5 - centre[:, None]) / wide
    weight = np.where(np.abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)
    return weight / weight.sum(axis=1, keepdims=True)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luminance of pixels [height, width, channels], which are grey or blue, green, red and perhaps opacity."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].astype(np.float64)
    blue, green, red = (pixels[:, :, i].astype(np.int64) for i in range(3))
    return ((19595 * red + 38470 * green + 7471 * blue + 32768) >> 16).astype(np.float64)


def perceptual_hash(pixels: np.ndarray) -> str:
    """16 hexadecimal digits for pixels [height, width, channels]."""
    small = grey(pixels)
    for size in (small.shape[1], small.shape[0]):  # along the width, then along the height
        small = (small if size == SIDE else np.clip(np.floor(small @ reduction(size).T + 0.5), 0, 255)).T
    low = cosines() @ small @ cosines().T
    bits = (low > np.median(low)).ravel()
    return np.packbits(bits).tobytes().hex()


@F.pandas_udf(StringType())
def _hash(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    out = []
    for h, w, c, body in zip(height, width, channels, data, strict=True):
        out.append(perceptual_hash(np.frombuffer(body, np.uint8).reshape(h, w, c)) if h > 0 and w > 0 else None)
    return pd.Series(out, dtype="object")


def hash_of(image: Column) -> Column:
    """The hash of an image struct as Spark's image source reads it; null where it could not be decoded."""
    return _hash(image["height"], image["width"], image["nChannels"], image["data"])


def image_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Path and cover_hash of every file below a folder; files that are no image have a null hash."""
    # decoded images are large; Arrow batches are cut by bytes
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    files = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(folder)
    return files.select(F.col("image.origin").alias("path"), hash_of(F.col("image")).alias("cover_hash"))
