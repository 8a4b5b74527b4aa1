"""Documents cut into overlapping chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_documents(
    documents: DataFrame, text: str = "text", key: str = "doc_id", size: int = 2000, overlap: int = 500
) -> DataFrame:
    """One row per chunk of `size` characters, each sharing `overlap` with the one before.

    Adds `chunk_id` (`key:number`), `chunk_no` and `chunk`, in place of the text. A row-local
    generator: no shuffle. A text is cut once into pieces of the chunks' distance, and each chunk is
    joined from the few pieces it covers, so work grows with the text's length and no faster.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    length = F.length(F.col(text))
    number = F.greatest(F.ceil((length - overlap) / F.lit(step)), F.lit(1)).cast("int")
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), 0)
    covered = -(-size // step)
    others = [c for c in documents.columns if c != text]
    # Columns of their own: neither is made again for each chunk, and the text goes no further.
    cut = documents.filter(length > 0).select(*others, pieces.alias("_pieces"), number.alias("_number"))
    ahead = [F.slice("_pieces", i + 1, F.greatest(F.size("_pieces"), F.lit(1))).alias(f"p{i}") for i in range(covered)]
    chunks = F.transform(
        F.slice(F.arrays_zip(*ahead), F.lit(1), F.col("_number")),
        lambda p: F.substring(F.concat(*[F.coalesce(p[f"p{i}"], F.lit("")) for i in range(covered)]), 1, size),
    )
    return cut.select(*others, F.posexplode(chunks).alias("chunk_no", "chunk")).withColumn(
        "chunk_id", F.concat(F.col(key).cast("string"), F.lit(":"), F.col("chunk_no").cast("string"))
    )
