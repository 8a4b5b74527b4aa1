"""A Bloom filter of ids as a column expression, to drop rows ahead of an exchange."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per id, and bytes of a filter at most. Beyond that it lets more rows pass, and the join stays right.
BITS_PER_ID, MOST_BYTES = 12, 32 << 20
_HASHES = 3


def _places(column: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(column, F.lit(number)), F.lit(bits)) for number in range(_HASHES)]


def may_be_among(column: Column, ids: DataFrame, count: int) -> Column:
    """True for every value of `column` that `ids` (one column, about `count` rows) has, false for nearly all others.

    The filter is made where the ids lie: bits are merged before and after the shuffle, and at most
    `MOST_BYTES` of them pass through the driver. It is a scalar subquery, so rows are tested in the JVM as they are read.
    """
    words = max(1, min(-(-count * BITS_PER_ID // 64), MOST_BYTES // 8))
    places = F.explode(F.array(*_places(ids[ids.columns[0]], 64 * words))).alias("place")
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    merged = ids.select(places).groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    held = np.zeros(words, np.int64)
    held[merged["word"].to_numpy()] = merged["bits"].to_numpy()
    row = pa.table({"bits": pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array(held))})
    bits = ids.sparkSession.createDataFrame(row).scalar()
    found = F.lit(True)
    for place in _places(column, 64 * words):
        word = F.get(bits, F.floor(place / 64).cast("int"))
        found = found & (F.getbit(word, (place % 64).cast("int")) == 1)
    return found
