"""Shared helpers of the training-data operators: tables in the shared folder, word hashing, bucketed blobs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize, remove, shared_dir

__all__ = ["materialize", "remove", "shared_dir"]

#: Multiplier of the rolling combination and of the finaliser (odd 64-bit constants).
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xFF51AFD7ED558CCD)
_S33 = np.uint64(33)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is None."""
    return col.cast(pa.binary()).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; null has none."""
    return text.lower().split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; it stands for the word (two of a billion words collide with odds of 3 %)."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def finish(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _S33)) * _Q
        return x ^ (x >> _S33)


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles in order; with fewer words, of the whole sequence; none without words."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    with np.errstate(over="ignore"):
        s = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            s = s * _P + h[j : n - k + 1 + j]
    return finish(s)


def pairs_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of each pair (a, b) of 64-bit values, in this order."""
    with np.errstate(over="ignore"):
        return finish(a * _P + b)


def segments(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that groups keys by key mod buckets and sorts them within; and the buckets' bounds in it."""
    b = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, b))
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


def checksum_mod(col: str, m: int):
    """crc32(col as text) mod m; a null key is none of the remainders (-1)."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % m, F.lit(-1))
