"""One-bit codes of randomly rotated vectors with correction factors: unbiased inner products and their error."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR_WIDTH = 4.0  # standard deviations of the estimate that a bound allows


@lru_cache(maxsize=64)
def rotation(dim: int, number: int = 0) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere for the same arguments."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths, scaled first so that no square over- or underflows."""
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / scale
    length = np.linalg.norm(scaled, axis=1, keepdims=True)
    return scaled / length, (length * scale)[:, 0]


def encode(directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated directions, and the inner product of each with its code."""
    turned = directions @ rotation(directions.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(directions.shape[1])


def estimates(codes: np.ndarray, fit: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes x queries) estimates of the cosine, and the error bound of each code.

    The code's inner product with the rotated query, divided by its inner
    product with its own vector, is unbiased; the part of the code that is
    orthogonal to the vector sets the spread.
    """
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * np.float32(2) - np.float32(1)
    turned = (queries @ rotation(dim)).astype(np.float32) / np.float32(np.sqrt(dim))
    error = ERROR_WIDTH * np.sqrt(np.maximum(1 - fit**2, 0) / fit**2 / max(dim - 1, 1)) + 1e-5
    return (signs @ turned.T) / fit[:, None].astype(np.float32), error
