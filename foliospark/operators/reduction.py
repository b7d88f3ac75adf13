"""Reduction of large histories to the keys that matter, before anything of them is shuffled.

The keys of a small table (clients that opened an account) are gathered once. Few of them are joined exactly; of more,
a Bloom filter of a fixed share of wrong positives is built: a key sets a few bits of one 64-bit word, so that a look
is one lookup in a table of words whose size is known beforehand. Either is small enough to be broadcast whatever the
history holds, so the filter stands below the first grouping of the history. It may let further keys pass and never
holds one back: what follows has to join on the key anyway.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.skew import key_id
from foliospark.sources.io import store


@dataclass(frozen=True)
class ReductionPolicy:
    exact_keys: int = 200_000  # up to so many keys (8 bytes each) are joined exactly
    bits_per_key: int = 16  # of the filter: about 0.5 % wrong positives
    most_words: int = 1 << 22  # of 8 bytes each; the filter lets more pass as it fills
    least_bits: float = 2.0  # with fewer bits per key it would hold back too little to be worth its look


DEFAULT = ReductionPolicy()
LOOKS = 4  # bits that a key sets


def _word(words: int) -> Column:
    return F.col("__key").bitwiseAND(F.lit(words - 1))


def _mask() -> Column:
    """The bits of a key, from parts of its hash that the number of its word does not use."""
    bit = lambda k: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(__key, {34 + 6 * k}) & 63 AS int))")
    out = bit(0)
    for k in range(1, LOOKS):
        out = out.bitwiseOR(bit(k))
    return out


@dataclass(frozen=True)
class KeyFilter:
    """Keys by their hash: a list (``bits`` is 0), words of a Bloom filter (their number), or nothing (all keys pass)."""

    table: DataFrame | None
    bits: int = 0

    def reduce(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of ``df`` whose key is in the set (or seems to be); a NULL key is in none."""
        if self.table is None:
            return df.filter(F.col(column).isNotNull())
        rows = df.filter(F.col(column).isNotNull()).withColumn("__key", key_id(df, [column]))
        if not self.bits:
            return rows.join(F.broadcast(self.table), "__key", "left_semi").drop("__key")
        rows = rows.withColumn("__word", _word(self.bits))
        found = rows.join(F.broadcast(self.table), "__word").filter(F.col("__bits").bitwiseAND(_mask()) == _mask())
        return found.select(*df.columns)


def key_filter(df: DataFrame, column: str, policy: ReductionPolicy = DEFAULT) -> KeyFilter:
    """The filter of the keys of a column. Runs a job: the different keys are stored, and so are the filter's words."""
    keys = store(df.filter(F.col(column).isNotNull()).select(key_id(df, [column]).alias("__key")).distinct(), "keys")
    n = keys.count()
    if n <= policy.exact_keys:
        return KeyFilter(keys)
    words = min(policy.most_words, 1 << max(0, math.ceil(math.log2(n * policy.bits_per_key / 64))))
    if words * 64 < policy.least_bits * n:
        return KeyFilter(None)
    bits = keys.select(_word(words).alias("__word"), _mask().alias("__mask")).groupBy("__word").agg(F.bit_or("__mask").alias("__bits"))
    return KeyFilter(store(bits, "key_bits"), words)
