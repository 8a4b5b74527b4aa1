"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text. A chunk ends where the hash's top bits are zero, so an
insertion moves only the boundaries next to it. Chunking is normalised: up to the normal length
more bits have to be zero than after it, which keeps lengths near the normal one. A fingerprint is
the set of the chunks' digests with their lengths, and the likeness of two is containment: the bytes
in common by the bytes of the smaller one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm.ranges import ranges_beside, with_range
from askgrid.session import materialise

SHORTEST, NORMAL, LONGEST = 16, 64, 256
HARD_BITS, EASY_BITS = 7, 5

_RESULT = (
    "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _gear_table() -> np.ndarray:
    """32 pseudo-random bits per byte value, by a rule (splitmix)."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: bytes, table: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = (h << 1) + table[byte], in 32 bits.

    A byte has left a 32-bit hash after 32 steps, so it is a sum over 32 bytes, made by doubling.
    """
    hashes = table[np.frombuffer(data, np.uint8)]
    for shift in (1, 2, 4, 8, 16):
        later = hashes.copy()
        later[shift:] += hashes[:-shift] << np.uint32(shift)
        hashes = later
    return hashes


def cut_points(data: bytes, table: np.ndarray) -> list[int]:
    """Ends of the chunks."""
    hashes = gear_hashes(data, table)
    easy_at = np.flatnonzero(hashes < np.uint32(1 << (32 - EASY_BITS)))
    hard = easy_at[hashes[easy_at] < np.uint32(1 << (32 - HARD_BITS))].tolist()
    easy = easy_at.tolist()
    cuts, start, size = [], 0, len(data)
    while size - start > SHORTEST:
        at = bisect_left(hard, start + SHORTEST - 1)
        if at < len(hard) and hard[at] < start + NORMAL - 1:
            start = hard[at] + 1
        else:
            at = bisect_left(easy, start + NORMAL - 1)
            start = min(easy[at] + 1 if at < len(easy) else size, start + LONGEST, size)
        cuts.append(start)
    if start < size:
        cuts.append(size)
    return cuts


def chunk_set(text: str, table: np.ndarray) -> dict[int, int]:
    """Digest of each distinct chunk of the whole text, with its length in bytes."""
    data, start, chunks = text.encode("utf-8", "surrogatepass"), 0, {}
    for end in cut_points(data, table):
        chunks[xxhash.xxh3_64_intdigest(data[start:end])] = end - start
        start = end
    return chunks


def as_text(chunks: dict[int, int]) -> str:
    """The fingerprint as text: `digest:length` of each chunk, in order of the digests."""
    return " ".join([f"{d:016x}:{n}" for d, n in sorted(chunks.items())])


def containment(one: dict[int, int], other: dict[int, int]) -> float:
    """Bytes of common chunks by those of the smaller set; two empty ones are alike, one is not."""
    if not one or not other:
        return float(not one and not other)
    if len(other) < len(one):
        one, other = other, one
    common = sum(n for d, n in one.items() if d in other)
    return common / min(sum(one.values()), sum(other.values()))


def _row(doc_id, text: str, chunks: dict, following: str, next_chunks: dict, table) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    edited_chunks = chunk_set(edited, table)
    return (
        doc_id,
        len(text),
        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        as_text(chunks),
        as_text(edited_chunks),
        containment(chunks, edited_chunks),
        containment(chunks, next_chunks),
    )


_NAMES = [
    "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
]


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that are followed by another one in their range, each compared with that one."""
    table, previous = _gear_table(), None
    for batch in batches:
        out = []
        for place, doc_id, text in batch[["_range", "doc_id", "text"]].itertuples(index=False):
            text = text or ""
            chunks = chunk_set(text, table)
            if previous is not None and previous[0] == place:
                out.append(_row(*previous[1:], text, chunks, table))
            previous = (place, None if pd.isna(doc_id) else doc_id, text, chunks)
        yield _frame(out, _NAMES)


def _range_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First (1) and last (2) row of each range, whose neighbours are in other ranges."""
    previous, names = None, ["_range", "doc_id", "text", "part_end"]
    for batch in batches:
        out = []
        for place, doc_id, text in batch[["_range", "doc_id", "text"]].itertuples(index=False):
            row = (place, None if pd.isna(doc_id) else doc_id, text or "")
            if previous is None or previous[0] != place:
                out += [] if previous is None else [(*previous, 2)]
                out.append((*row, 1))
            previous = row
        yield _frame(out, names)
    if previous is not None:
        yield _frame([(*previous, 2)], names)


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    table = _gear_table()
    for batch in batches:
        out = []
        for doc_id, text, following in zip(batch["doc_id"], batch["text"], batch["following"], strict=True):
            doc_id = None if pd.isna(doc_id) else doc_id
            out.append(
                _row(doc_id, text, chunk_set(text, table), following, chunk_set(following, table), table)
            )
        yield _frame(out, _NAMES)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows as objects, so that nulls don't turn integers into floats."""
    return pd.DataFrame(rows, columns=names, dtype=object)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document, of its edited text, and their likeness.

    The edited text is the first half with the second replaced by the start of the next document in
    order of `doc_id` (after the last: the first). Only `doc_id` and `text` are read. Null texts
    count as empty. Rows with equal ids follow each other in order of their texts; null ids come
    first. A single document is its own neighbour. Empty table: empty result.

    Texts are shuffled into ranges of ids, once for the ends of the ranges and once for the pairs. Each task reads its ranges in order, holding two
    texts at a time; the last text of each range is joined with the first of the next range by the
    range's number. Ids have to be numbers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = _RESULT.format(id=kind)
    rows = with_range(docs.select("doc_id", "text"), "doc_id", "_range")
    ordered = rows.repartition("_range").sortWithinPartitions("_range", "doc_id", "text")
    inside = ordered.mapInPandas(_neighbours, schema)

    # Two rows per range, whatever the number of documents.
    ends = ordered.mapInPandas(_range_ends, f"_range int, doc_id {kind}, text string, part_end int")
    ends = materialise(ends, "range_ends")
    first = ends.where("part_end = 1").select(F.col("_range").alias("range_after"), F.col("text").alias("following"))
    last = ends.where("part_end = 2").join(ranges_beside(ends, "_range", ring=True), "_range")
    last = last.join(first, "range_after").select("doc_id", "text", "following")
    return inside.union(last.mapInPandas(_pairs, schema))


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
