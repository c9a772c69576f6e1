"""A filter of fixed size over the keys of a table, to leave out rows early that no later exact step can want.

Each key sets one bit. A key of the table always passes; others pass by chance, more of them the fuller the filter is, which costs
work and never changes a result, as an exact join or threshold follows. The size is ``BITS`` whatever the input, so the filter may be sent to every task.

Cases: an empty table gives a filter that nothing passes; null keys set no bit and do not pass; repeated keys set one bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23


def key_filter(keys: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The bits of all rows of ``keys``, whose hashes (uint64) ``hashes`` computes; what reaches the driver is at most BITS / 64 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at = hashes(b) & np.uint64(BITS - 1)
            word = (at >> np.uint64(6)).astype(np.int64)
            bit = np.left_shift(np.uint64(1), at & np.uint64(63))
            words, place = np.unique(word, return_inverse=True)
            bits = np.zeros(len(words), dtype=np.uint64)
            np.bitwise_or.at(bits, place, bit)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits.view(np.int64))], names=["word", "bits"])

    set_bits = keys.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    found = np.zeros(BITS // 64, dtype=np.uint64)
    found[set_bits.column("word").to_numpy()] = set_bits.column("bits").to_numpy().view(np.uint64)
    return found


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True for every hash whose bit is set."""
    at = hashes & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
