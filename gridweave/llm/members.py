"""A Bloom filter over 64-bit keys, to keep rows that can't join out of a shuffle.

Its size follows the number of keys, about ten bits each, up to ``MOST_BITS`` (16 MB). Where there
are more keys than that serves, there is no filter: all rows pass, and the shuffled join does it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

LEAST_BITS, MOST_BITS = 16, 27
#: Bits a key that the smallest fitting filter has at least.
BITS_A_KEY = 10
#: Fixed odd multipliers of the three hashes.
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def filter_bits(keys: int) -> int | None:
    """log2 of the bits of a filter for so many keys; None for too many."""
    bits = max(LEAST_BITS, (BITS_A_KEY * keys).bit_length())
    return bits if bits <= MOST_BITS else None


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Three filter positions of each key (int64 or uint64), in filters of 2**bits bits."""
    k = np.ascontiguousarray(keys).view(np.uint64)
    k = k ^ (k >> np.uint64(32))
    return ((k[:, None] * _MULTIPLIERS) >> np.uint64(64 - bits)).astype(np.int64)


def passes(words: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    if words is None:
        return np.ones(len(keys), bool)
    at = places(keys, len(words).bit_length() + 4)
    return ((words[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)).all(axis=1)


def filter_of(keys: np.ndarray) -> bytes:
    """The filter of some keys in one task; empty, which lets all pass, for too many."""
    bits = filter_bits(len(keys))
    if bits is None:
        return b""
    at = places(keys, bits).ravel()
    out = np.zeros(1 << (bits - 5), np.uint32)
    np.bitwise_or.at(out, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
    return out.tobytes()


def _words(bits: int):
    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = np.unique(places(b.column(0).to_numpy(), bits))
                word, first = np.unique(at >> 5, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bitwise_or.reduceat(np.int64(1) << (at & 31), first))], names=["word", "mask"])

    return do


def member_filter(keys: DataFrame) -> np.ndarray | None:
    """keys: one column of longs without nulls. At most 2**(MOST_BITS - 5) small rows reach the driver."""
    bits = filter_bits(keys.count())
    if bits is None:
        return None
    words = keys.transform(in_batches, _words(bits), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().astype(np.uint32)
    return out
