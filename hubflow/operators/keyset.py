"""A set of key bits of fixed size, which thins rows of a log before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the bits: 1 MB, whatever the number of keys. More keys let more rows pass that the exact join drops afterwards.
LOG2_BITS = 23
_WORD = 6


class KeyBits:
    """The bits of a key column, built by Spark as the plan runs, as a scalar that every task gets once.

    ``may_hold`` is true for each key of the set and, by chance, for some others, so a join on the key must follow. Nulls
    are in no set. Keys are united per word of 64 bits before they are shuffled; a hot key costs one bit.
    """

    def __init__(self, keys: DataFrame, column: str, *, log2_bits: int = LOG2_BITS):
        self._mask = (1 << log2_bits) - 1
        place = self._place(F.col(column))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
        marked = keys.filter(F.col(column).isNotNull()).select(F.shiftright(place, _WORD).alias("word"), bit.alias("bits"))
        empty = keys.sparkSession.range(1 << max(0, log2_bits - _WORD)).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
        words = marked.union(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        self._words = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("words")).scalar()

    def _place(self, value: Column) -> Column:
        return F.xxhash64(value).bitwiseAND(F.lit(self._mask).cast("bigint"))

    def may_hold(self, value: Column) -> Column:
        place = self._place(value)
        word = F.get(self._words, F.shiftright(place, _WORD).cast("int"))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
        return value.isNotNull() & (word.bitwiseAND(bit) != 0)
