"""A Bloom filter built by aggregation and tested inside the row.

Bits are set by ``bit_or`` over 64-bit cells; the filter is an array of cells, a scalar
of the plan.  It has ``BITS`` bits an entry up to ``MOST_BITS`` in all (8 MB), beyond
which it lets more strangers through; what it lets through is to be joined, so results
do not depend on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 12
HASHES = 6
MOST_BITS = 1 << 26


def _places(word: Column, bits: int) -> list[Column]:
    """The bit numbers of a word: double hashing, with hashes whose sum stays in a long."""
    a, b = F.xxhash64(word).bitwiseAND(F.lit((1 << 48) - 1)), F.xxhash64(word, F.lit(1))
    return [(a + F.lit(k) * F.shiftright(b, 20)).bitwiseAND(F.lit(bits - 1)) for k in range(HASHES)]


@dataclass
class Bloom:
    cells: Column
    bits: int

    def may_hold(self, word: Column) -> Column:
        """False only for words that are not in the filter."""
        out = F.lit(True)
        for at in _places(word, self.bits):
            out = out & (F.getbit(F.get(self.cells, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out


def build(words: DataFrame, col: str) -> Bloom:
    """A filter of the words of a column, sized by their number."""
    n = words.count()
    bits = min(MOST_BITS, max(1024, 1 << (n * BITS - 1).bit_length() if n else 0))
    at = words.select(F.explode(F.array(*_places(F.col(col), bits))).alias("at"))
    cells = (at.groupBy(F.shiftright("at", 6).alias("cell"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")))
    every = words.sparkSession.range(bits >> 6).join(cells, F.col("id") == F.col("cell"), "left")
    full = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("x"))
    return Bloom(full.select(F.transform("x", lambda s: s["bits"]).alias("cells")).scalar(), bits)
