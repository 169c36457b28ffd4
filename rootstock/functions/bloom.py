"""A Bloom filter built and probed inside the JVM from built-in functions.

Up to `MAX_BITS` the filter is one array of 64-bit words, made by one aggregation and read as a scalar subquery, so
it reaches every task once and probing is an array look-up within generated code.  A filter of more keys has as
many bits per key, but isn't broadcast: keys are hashed to blocks of `BLOCK_BITS` bits, and probes meet the block that would hold
them by a join on its number, which adaptive execution splits where a block is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootstock.functions.storage import keep

HASHES = 5
MAX_BITS = 1 << 26  # 8 MB
BLOCK_BITS = 1 << 20  # 128 kB


def bits_for(keys: int) -> int:
    """A power of two of at least ten bits per key, from 2^12."""
    return max(1 << 12, 1 << (10 * max(1, keys) - 1).bit_length())


def _positions(key: list[Column], bits: int) -> list[Column]:
    """Positions from two 31-bit halves of one hash: their combinations can't overflow."""
    h = F.xxhash64(*key)
    a, b = h.bitwiseAND(F.lit(2**31 - 1)), F.shiftright(h, 32).bitwiseAND(F.lit(2**31 - 1))
    return [F.pmod(a + F.lit(i) * b, F.lit(bits).cast("bigint")) for i in range(HASHES)]


@dataclass(frozen=True)
class Filter:
    """`frame` has one row with the array `words`, or one per block with its number `__block`."""

    frame: DataFrame
    bits: int
    blocks: int

    def mark(self, df: DataFrame, key: list[str], name: str) -> DataFrame:
        """df with the boolean column `name`: False proves that the row's key, of no NULL columns, isn't among those held."""
        columns = [F.col(c) for c in key]
        if self.blocks == 1:
            return df.withColumn(name, might_contain(columns, self.frame.scalar(), self.bits))
        met = df.withColumn("__block", _block(columns, self.blocks)).join(self.frame, "__block", "left")
        return met.withColumn(name, F.coalesce(might_contain(columns, F.col("words"), BLOCK_BITS), F.lit(False))).drop("__block", "words")


def _block(key: list[Column], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*key, F.lit("block")), F.lit(blocks)).cast("int")


def build(keys: DataFrame, columns: list[str], count: int, max_bits: int = MAX_BITS) -> Filter:
    """The filter of at most `count` keys. Keys with a NULL column aren't held."""
    bits, known, key = bits_for(count), keys.dropna(subset=columns), [F.col(c) for c in columns]
    if bits > max_bits:
        blocks = max(2, bits // BLOCK_BITS)
        hashed = known.select(_block(key, blocks).alias("__block"), F.xxhash64(*key).alias("h"))
        return Filter(keep(hashed.groupBy("__block").applyInArrow(_filled, "__block int, words array<bigint>")), bits, blocks)
    positions = known.select(F.explode(F.array(*_positions(key, bits))).alias("p"))
    words = positions.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(63).cast("int"))).alias("x"))
    empty = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("x"))
    full = words.unionByName(empty).groupBy("w").agg(F.bit_or("x").alias("x"))
    # Kept: every probe of the filter then reads one stored row instead of planning the aggregation again.
    return Filter(keep(full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "x"))), lambda s: s["x"]).alias("words"))), bits, 1)


def _filled(hashes: pa.Table) -> pa.Table:
    """A block's words; the same positions as `_positions`."""
    h = hashes["h"].to_numpy()
    a, b, flags = h & (2**31 - 1), (h >> 32) & (2**31 - 1), np.zeros(BLOCK_BITS, np.uint8)
    for i in range(HASHES):
        flags[(a + i * b) % BLOCK_BITS] = 1
    words = np.packbits(flags, bitorder="little").view("<i8")
    return pa.table({"__block": pa.array([hashes["__block"][0].as_py()], pa.int32()), "words": pa.array([words], pa.list_(pa.int64()))})


def might_contain(key: list[Column], words: Column, bits: int) -> Column:
    """False proves that the key, of no NULL columns, isn't among those held."""
    out = None
    for p in _positions(key, bits):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        hit = F.call_function("shiftrightunsigned", word, p.bitwiseAND(63).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
        out = hit if out is None else out & hit
    return out
