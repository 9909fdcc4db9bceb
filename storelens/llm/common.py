"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 16
MULTIPLIER = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

#: Arrow batches to Python hold at most so many rows and bytes, so a few long texts don't fill a worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    for key, value in BATCH.items():
        df.sparkSession.conf.set(key, value)
    return df


def release() -> None:
    """Give memory that a fit has used on the driver back to the system, so that later stages have it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of an Arrow column as views of one array of their values."""
    held = column.combine_chunks()
    if not len(held):
        return []
    offsets = held.offsets.to_numpy()
    return np.split(held.flatten().to_numpy(), offsets[1:-1] - offsets[0])


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % n


def is_fold(key: str, n: int, fold: int) -> Column:
    """Whether a row belongs to the fold; rows without a key belong to none."""
    return F.coalesce(crc_mod(key, n) == fold, F.lit(False))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; an empty array for null or blank texts."""
    split = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.array_remove(split, "")


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = powers(MULTIPLIER, CHUNK)
_INVERSES = powers(pow(MULTIPLIER, -1, 1 << 64), CHUNK)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))
_BYTE[_IS_SPACE] = 0


def pieces(text: bytes, chunk: int = CHUNK) -> Iterator[bytes]:
    """The text in parts of about ``chunk`` bytes that end between words; a longer word stays whole."""
    at = 0
    while len(text) - at > chunk:
        cut = max(text.rfind(bytes([c]), at, at + chunk) for c in SPACES)
        if cut <= at:
            later = [p for p in (text.find(bytes([c]), at + chunk) for c in SPACES) if p >= 0]
            cut = min(later, default=len(text) - 1)
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text in which A-Z are lower-cased.

    A word's hash is a polynomial over its bytes, summed for all words of a part at once.
    """
    out = []
    for part in pieces(text.lower()):
        codes = np.frombuffer(part, np.uint8)
        space = _IS_SPACE[codes]
        starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(codes) else np.zeros(0, np.int64)
        if not len(starts):
            continue
        if len(codes) > CHUNK:
            up, down = powers(MULTIPLIER, len(codes)), powers(pow(MULTIPLIER, -1, 1 << 64), len(codes))
        else:
            up, down = _POWERS, _INVERSES
        sums = np.add.reduceat(_BYTE[codes] * up[: len(codes)], starts)
        out.append(mix(sums * down[starts]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_PLACES = odd_numbers(64, 0xD1B54A32D192ED03)


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a shorter text is one shingle, one without words none."""
    hashed = word_hashes(text)
    n = len(hashed)
    if n == 0:
        return hashed
    if n < width:
        return mix(np.array([(hashed * _PLACES[:n]).sum(dtype=np.uint64)]) + np.uint64(n))
    total = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total += hashed[j : n - width + 1 + j] * _PLACES[j]
    return np.unique(mix(total + np.uint64(width)))


def utf8(values: pa.Array | pa.ChunkedArray) -> Iterable[bytes | None]:
    """Strings of an Arrow column as bytes, one after another."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    for value in values.cast(kind):
        yield value.as_py()
