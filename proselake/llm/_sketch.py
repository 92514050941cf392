"""A Bloom filter of document ids, built by a distributed OR and sent to the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import mix

#: The filter has at most so many bits (8 MB), however many ids there are.
MOST_BITS = 1 << 26
BITS_PER_ID = 16
HASHES = 3


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = mix(h) | np.uint64(1)
    return [((h + step * np.uint64(i)) % np.uint64(bits)).astype(np.int64) for i in range(HASHES)]


class BloomFilter:
    """No id that was put in is missed; others pass with a chance that depends on how full the filter is."""

    def __init__(self, bits: int, count: int, words: np.ndarray):
        self.bits, self.full = bits, count * 4 > bits
        self.packed = pa.compress(words.tobytes(), codec="zstd", asbytes=True)
        self._words: np.ndarray | None = None

    @classmethod
    def of(cls, ids: DataFrame, column: str) -> BloomFilter:
        """The filter of all ids of a column without nulls. What reaches the driver is the filter itself."""
        count = ids.count()
        bits = min(MOST_BITS, max(1 << 10, 1 << (count * BITS_PER_ID).bit_length()))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                place = np.concatenate(_places(b[column].to_numpy(zero_copy_only=False), bits))
                word, at = np.unique(place >> 6, return_inverse=True)
                bit = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(bit, at, np.uint64(1) << (place & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], names=["word", "bit"])

        words = np.zeros(bits >> 6, np.int64)
        if count * 4 <= bits:
            got = ids.select(column).mapInArrow(mark, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
            words[got["word"].to_numpy()] = got["bit"].to_numpy()
        return cls(bits, count, words)

    def __getstate__(self):
        return self.__dict__ | {"_words": None}

    def holds(self, ids: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Which ids may be in the filter; a full filter says nothing and lets all pass."""
        if self.full:
            return valid
        if self._words is None:
            self._words = np.frombuffer(pa.decompress(self.packed, self.bits >> 3, codec="zstd", asbytes=True), np.uint64)
        out = valid.copy()
        for place in _places(ids, self.bits):
            out &= (self._words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out
