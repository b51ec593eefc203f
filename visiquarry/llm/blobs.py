"""Sorted hashes and counts as compressed bytes, so that shuffles carry two to four bytes a hash; sets of hashes as bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(values: np.ndarray) -> bytes:
    """Numbers of 0 and up as planes of their bytes, compressed; few bytes for small ones."""
    values = np.ascontiguousarray(values, np.uint64)
    wide = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    raw = values.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()
    return len(values).to_bytes(4, "little") + bytes([wide]) + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(blob: bytes) -> np.ndarray:
    n, wide = int.from_bytes(blob[:4], "little"), blob[4]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :wide] = np.frombuffer(pa.decompress(blob[5:], n * wide, codec="zstd", asbytes=True), np.uint8).reshape(wide, n).T
    return out.reshape(-1).view(np.uint64)


def parts_of(keys: np.ndarray, bits: int, n_parts: int) -> np.ndarray:
    """Where each part begins in the sorted keys, and the end."""
    part = (keys >> np.uint64(bits - 32)) * np.uint64(n_parts) >> np.uint64(32)
    return np.searchsorted(part, np.arange(n_parts + 1, dtype=np.uint64))


def gaps(keys: np.ndarray) -> bytes:
    """Sorted keys by the differences between them."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def keys_of(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob), dtype=np.uint64)


def bit_set(keys: DataFrame, bits: int) -> np.ndarray:
    """Bits for the long column ``key``: one for all keys with equal low bits. ``bits`` is a power of two; its eighth are the bytes that reach the driver.

    The maps are fetched together, in one job: an iterator over them would run a job for every shuffle partition, one after the other.
    """
    bit = keys.select(F.col("key").bitwiseAND(bits - 1).alias("bit"))
    maps = bit.groupBy(F.shiftright("bit", 15).alias("at")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for row in maps.collect():
        out[row["at"] << 12 : (row["at"] + 1) << 12] = np.frombuffer(row["map"], np.uint8)
    return out


def in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & (8 * len(bits) - 1)
    return (bits[bit >> 3] >> (bit & 7) & 1).astype(bool)
