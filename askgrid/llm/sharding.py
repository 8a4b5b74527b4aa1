"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, ranges.

Records are put in the order of (hash of the text, id), so equal texts stand side by side, and the
order is cut into shards of near equal size. To do that without a global sort or a single task:

1. a size-weighted sample of keys gives the boundaries of many small ranges (a row is drawn in
   proportion to its size, so the sample's quantiles are quantiles of the bytes);
2. rows find their range by binary search; ranges that came out overfull are sampled again, more
   densely, and subdivided. Boundaries are pairs of key and id, so a text that holds a third of all
   rows is subdivided like any other range;
3. the sizes of the ranges, added up, say where each range starts; a window within each range says
   where each row starts. The row's start in the whole decides its shard.

The sample decides only how evenly the work is dealt out, not the result: the shard depends on the
exact sum of sizes ahead of a row. Everything is built-in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.llm.ranges import below
from askgrid.session import materialise

OVERHEAD = 16


def text_size(text: Column) -> Column:
    """Bytes of the text in UTF-8 (null: none) and a fixed overhead per record."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + F.lit(OVERHEAD)).cast("long")


def text_key(text: Column) -> Column:
    """60 bits of the text's MD5, so that equal texts have equal keys; a null counts as empty."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _position(key: Column, identity: Column) -> Column:
    return F.struct(key.alias("key"), identity.alias("id"))


def _drawn(rows: DataFrame, per_byte: float, salt: int) -> DataFrame:
    """Rows drawn in proportion to their size; `drawn` says how often."""
    uniform = F.shiftrightunsigned(F.xxhash64("key", "id", F.lit(salt)), 11) / F.lit(float(1 << 53))
    drawn = rows.withColumn("drawn", F.floor(F.col("size") * F.lit(per_byte) + uniform))
    return drawn.where("drawn > 0").select("key", "id", "drawn")


def _quantiles(sample: DataFrame, per_range: int) -> DataFrame:
    """Every `per_range`-th drawn position. The sample is bounded, so one task may sort it."""
    order = Window.orderBy("key", "id")
    running = sample.withColumn("upto", F.sum("drawn").over(order))
    crosses = F.floor(F.col("upto") / per_range) > F.floor((F.col("upto") - F.col("drawn")) / per_range)
    return running.where(crosses).select("key", "id")


def _ranged(rows: DataFrame, boundaries: DataFrame, most: int) -> DataFrame:
    """Add the number of boundaries at or below each row, found by binary search."""
    array = boundaries.select(
        F.sort_array(F.collect_list(_position(F.col("key"), F.col("id")))).alias("all")
    )
    placed = rows.withColumn("_boundaries", array.scalar())
    here = _position(F.col("key"), F.col("id"))
    return placed.withColumn("range", below(F.col("_boundaries"), here, most)).drop("_boundaries")


def assign_shards(
    rows: DataFrame, shards: int, ranges_per_shard: int = 32, draws_per_range: int = 8, rounds: int = 2
) -> DataFrame:
    """Shard and slot of each row of `rows` (id, key, size, and any other columns).

    Adds `shard` (0 to `shards` - 1; consecutive stretches of the order of key and id, a row going
    where its first byte falls, so sizes differ by one row's size at most) and `slot` (gapless from
    0 within the shard). `ranges_per_shard` and `draws_per_range` bound the sample, about
    shards * ranges_per_shard * draws_per_range rows, whatever the input's size.

    Null ids come first within their key. Repeated rows are kept, each with a slot of its own.
    An empty table gives an empty result. Sizes have to be positive.
    """
    rows = materialise(rows, "sizes")
    total = rows.agg(F.sum("size").alias("bytes")).first()["bytes"] or 0
    if not total:
        empty = rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
        return empty
    ranges = shards * ranges_per_shard
    per_byte = ranges * draws_per_range / total
    boundaries = materialise(_quantiles(_drawn(rows, per_byte, 0), draws_per_range), "boundaries")
    most = 2 * ranges
    for attempt in range(rounds):
        placed = _ranged(rows, boundaries, most)
        sizes = materialise(
            placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "ranges"
        )
        overfull = sizes.where((F.col("bytes") > F.lit(2 * total // ranges)) & (F.col("rows") > 1))
        if attempt == rounds - 1 or overfull.isEmpty():
            break
        inside = placed.join(F.broadcast(overfull.select("range")), "range")
        denser = _quantiles(_drawn(inside, per_byte * 4, attempt + 1), draws_per_range)
        boundaries = materialise(boundaries.union(denser).distinct(), "boundaries")
        most *= 4

    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )
    within = Window.partitionBy("range").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        placed.join(F.broadcast(starts), "range")
        .withColumn("first_byte", F.col("bytes_before") + F.sum("size").over(within) - F.col("size"))
        .withColumn("place", F.col("rows_before") + F.count("*").over(within) - 1)
        .withColumn("shard", F.expr(f"int((first_byte * {shards}L) div {total}L)"))
    )
    placed = materialise(placed.drop("range", "bytes_before", "rows_before", "first_byte"), "places")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    slots = placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("place") - F.col("first_place"))
    return slots.drop("place", "first_place")


def shard_documents(docs: DataFrame, shards: int = 40, **options: int) -> DataFrame:
    """Shards of near equal size for documents: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Only `doc_id` and `text` are read. Null texts count as empty ones.
    """
    rows = docs.select(
        F.col("doc_id").alias("id"),
        text_key(F.col("text")).alias("key"),
        text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return assign_shards(rows, shards, **options).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
