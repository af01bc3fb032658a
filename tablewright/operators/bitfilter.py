"""A broadcast filter of bits: which keys may occur in a table of keys.

A semi join with a large table of keys moves the rows of the other side.  This
filter marks them where they lie: every key sets the bit at its place modulo
the number of bits.  A row whose key shares its bit with another one is let
through, so the filter never loses a row, and what passes is checked exactly by
the caller.  The number of bits follows the number of keys up to MOST_BITS,
which bounds what is broadcast (a word of 64 bits and its place per row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..session import durable

#: Bits a key, and the bounds of a filter's bits: 4 million words at most.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one like it which no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


class BitFilter:
    """Built from a table with one long column ``key``; it is read twice."""

    def __init__(self, keys: DataFrame) -> None:
        wanted = BITS_A_KEY * keys.count()
        self.bits = min(max(LEAST_BITS, 1 << max(wanted - 1, 0).bit_length()), MOST_BITS)
        place = F.pmod("key", F.lit(self.bits))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
        self.words = durable(keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(one).alias("bits")))

    def _found(self, df: DataFrame, key: Column) -> tuple[DataFrame, Column, list[str]]:
        word, bits = unused(df, "word"), unused(df, "bits")
        place = F.pmod(key, F.lit(self.bits))
        bit = F.call_function("shiftright", F.col(bits), (place % 64).cast("int")).bitwiseAND(F.lit(1))
        words = F.broadcast(self.words.toDF(word, bits))
        return df.withColumn(word, F.shiftright(place, 6)).join(words, word, "left"), F.coalesce(bit == 1, F.lit(False)), [word, bits]

    def marked(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """``df`` with ``out``: false only where ``key`` was not there."""
        found, hit, helpers = self._found(df, quoted(key))
        return found.withColumn(out, hit).drop(*helpers)

    def passing(self, df: DataFrame, key: Column) -> DataFrame:
        """The rows of ``df`` whose key may be there; no row is moved."""
        found, hit, helpers = self._found(df, key)
        return found.filter(hit).drop(*helpers)
