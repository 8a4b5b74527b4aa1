"""Documents in blocks of even size, and texts compressed for the way through a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.llm.words import stretches


def block_count(docs: DataFrame, block_bytes: int) -> int:
    """Blocks of `block_bytes` that the texts of `docs` fill, at least one."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()["bytes"]
    return max(1, -(-(total or 0) // block_bytes))


def with_block(docs: DataFrame, block_bytes: int, to: str = "block", blocks: int | None = None) -> DataFrame:
    """Add the number of a row's block, about `block_bytes` of text each (or one of `blocks`, if that is known).

    Rows are dealt out by a hash of (doc_id, text), so blocks come out even however ids are spread, and
    rows without an id or with one id are dealt out like all others. Rows equal in id and text are in
    one block. Only the total of bytes goes through the driver. `doc_id` has to be a number.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.coalesce("text", F.lit("")))
    blocks = block_count(docs, block_bytes) if blocks is None else blocks
    return docs.withColumn(to, F.pmod(key, F.lit(blocks).cast("long")))


def packed(
    df: DataFrame,
    to: str = "packed",
    first: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """`df` with its column `text` replaced by `to`, the text compressed (null: empty).

    `first` may drop rows of the batches before; a step of its own would be a second Python worker in each task, whose
    memory comes on top."""
    kept = df.drop("text")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for whole in batches if first is None else first(batches):
            for batch in stretches(whole, "text"):
                texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
                column = pa.array([pack(t.as_buffer()) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], column], [*names, to])

    schema = T.StructType([*kept.schema.fields, T.StructField(to, T.BinaryType())])
    return df.mapInArrow(run, schema)


def unpacked(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of a `packed` column, in UTF-8."""
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(p) for p in column.to_pylist()]
