"""Building the chunk table that questions are searched in."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.operators.chunking import split_documents
from askgrid.operators.embedding import Embedder, embed_text
from askgrid.session import spread


def chunk_table(
    documents: DataFrame,
    size: int = 2000,
    overlap: int = 500,
    metadata: Sequence[str] = ("title",),
    embedder: Callable[[], Embedder] | None = None,
    concurrency: int | None = None,
) -> DataFrame:
    """Documents (`doc_id, title, text`) as `chunk_id, doc_id, chunk_no, title, metadata, chunk,
    text_vector`.

    The stages are all row-local, so a large table is cut and embedded where it lies.
    """
    pairs = [part for name in metadata for part in (F.lit(name), F.col(name).cast("string"))]
    chunks = split_documents(spread(documents, "doc_id"), size=size, overlap=overlap).select(
        "chunk_id", "doc_id", "chunk_no", "title", F.create_map(*pairs).alias("metadata"), "chunk"
    )
    return embed_text(chunks, "chunk", "text_vector", embedder, concurrency)
