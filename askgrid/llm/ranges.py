"""Rows in stretches of a sorted order, for work on neighbours in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges per shuffle partition; a range never depends on how Spark deals out the partitions.
PER_PARTITION = 4


def below(bounds: Column, value: Column, most: int) -> Column:
    """How many of the sorted `bounds` (at most `most`) are at or below `value`, by binary search.
    A null value is below all."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(max(1, most.bit_length())))])

    def step(low: Column, width: Column) -> Column:
        there = F.get(bounds, low + width - 1)
        return F.when(there.isNotNull() & (there <= value), low + width).otherwise(low)

    return F.aggregate(steps, F.lit(0), step)


def with_range(df: DataFrame, column: str, to: str) -> DataFrame:
    """Add the number of a row's range in the order of a numeric column as `to`.

    Bounds are approximate quantiles, PER_PARTITION for each shuffle partition, and go to the rows as
    a literal, so the range of a row is the same whenever it is computed.
    """
    spark = df.sparkSession
    ranges = PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(column, shares, 100 * ranges).alias("bounds")).first()["bounds"]
    bounds = sorted(set(found or []))
    if not bounds:
        return df.withColumn(to, F.lit(0))
    return df.withColumn(to, below(F.lit(bounds), F.col(column), len(bounds)))


def with_sampled_range(df: DataFrame, key: Column, to: str, draws: int = 16) -> DataFrame:
    """Add the number of a row's range in the order of a text as `to`.

    Bounds are quantiles of a sample of about `draws` keys per range, drawn by hash and cut to 256
    characters; they go to the rows as a literal. They decide only how evenly the ranges come out.
    """
    ranges = PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scale = 1 << 30
    rows = df.count()
    below_ = scale if rows <= ranges * draws else scale * ranges * draws // rows
    drawn = df.select(F.substring(key, 1, 256).alias("key")).where(
        F.pmod(F.xxhash64("key"), F.lit(scale)) < below_
    )
    sample = sorted(r["key"] for r in drawn.distinct().collect() if r["key"] is not None)
    bounds = sample[draws::draws]
    if not bounds:
        return df.withColumn(to, F.lit(0))
    return df.withColumn(to, below(F.lit(bounds), key, len(bounds)))


def ranges_beside(rows: DataFrame, column: str, ring: bool = False) -> DataFrame:
    """Each range number in `column` with the range before and after it that has rows, as `range_before`
    and `range_after`: null at the ends, or the other end's if `ring`.

    Numbers alone come to the driver, PER_PARTITION for each shuffle partition at most.
    """
    there = sorted(r[0] for r in rows.select(column).distinct().collect())
    ends = (there[-1:], there[:1]) if ring else ([None], [None])
    steps = zip(there, [*ends[0], *there[:-1]], [*there[1:], *ends[1]], strict=False)
    schema = f"{column} int, range_before int, range_after int"
    return F.broadcast(rows.sparkSession.createDataFrame(list(steps), schema))
