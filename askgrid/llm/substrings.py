"""Substring dedup: documents as factors of what stands earlier in the corpus.

In the manner of relative Lempel-Ziv parsing, documents are factored against reference blocks that
are indexed over the whole corpus, and long factors are duplicate spans. A window of WINDOW words is
a duplicate if its words also start earlier: in a document with a smaller id, or earlier in the same.

The index holds anchors: of the short word runs in a window the one with the least hash. Equal
windows have the same anchor, so each anchor stands for a stretch of consecutive windows, its context.

1. Every anchor of every document is indexed, once for each block of documents and anchor.
   Anchors that occur once in the corpus can't be part of a factor and go. If all occurrences of an
   anchor have one and the same context, it lies inside its factors; else it is at a boundary.
2. Each block of documents gets its repeated anchors back. Inside factors the context as a whole is
   the unit that is compared; at boundaries it is each window by itself. Units met again within the
   block are duplicates at once; the first of each goes on.
3. Of equal units from all blocks the earliest is the source; the others are duplicates.
4. Each block gets its duplicate stretches and removes the words that they cover.

A unit is identified by 128 bits. A block passes on each anchor and each unit once, so a text or passage
that fills a third of the corpus costs one row per block, not one per copy. Texts travel compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from askgrid.llm.blocks import packed, unpacked, with_block
from askgrid.llm.words import MULTIPLIER, WordHashes, mixed, split_words, stretches, whole_windows, windows

WINDOW = 20
ANCHOR = 6
#: Bytes of text in a block, on average.
BLOCK_BYTES = 4 << 20
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_PLACE_BITS = 24


def _powers(base: np.uint64, count: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    result = np.full(max(count, 1), base, np.uint64)
    result[0] = 1
    return np.multiply.accumulate(result)


class _Spans:
    """Hashes of any stretch of a sequence of word hashes, by differences of sums."""

    def __init__(self, hashes: np.ndarray):
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * _powers(MULTIPLIER, len(hashes)))])
        self.back = _powers(_INVERSE, len(hashes) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def _anchored(hashes: np.ndarray, counts: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one anchor: anchor hash, first window, last window, anchor's place.

    `hashes` are the words of texts laid end to end, `counts` words each; windows stay within a text.
    """
    starts = np.cumsum(counts) - counts
    inside = whole_windows(starts, counts, window)
    if not inside.any():
        nothing = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), nothing, nothing, nothing
    runs = windows(hashes, anchor)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    # The hash's upper bits, then the place, so that the least is the leftmost of the least.
    least = (runs & ~low) | (np.arange(len(runs), dtype=np.uint64) & low)
    width, have = window - anchor + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    at = np.flatnonzero(inside)
    place = (least[at] & low).astype(np.int64)
    place += (at - place + (1 << _PLACE_BITS) - 1) >> _PLACE_BITS << _PLACE_BITS  # undo the cut to 24 bits
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    return runs[place[new]], at[new], at[last], place[new]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _anchors(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """Distinct anchors of each block, as far as a task sees it: anchor, block, context, many.

    `context` is a 40-bit hash of the words around the anchor, -1 if they differ; `many`: the anchor
    occurs more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for batch in stretches(whole, "text", 2 << 20):
                cut = [split_words(t) for t in batch.column("text").to_pylist()]
                counts = np.array([len(c) for c in cut], np.int64)
                hashes = known.of([w for c in cut for w in c])
                found, first, last, place = _anchored(hashes, counts, window, anchor)
                context = _Spans(hashes).of(first, last + window) ^ mixed((place - first).astype(np.uint64))
                context = (context >> np.uint64(24)).astype(np.int64)
                block = np.repeat(batch.column("block").to_numpy(zero_copy_only=False), counts)[first]
                order = np.lexsort((found, block))
                found, context, block = found[order], context[order], block[order]
                new = np.concatenate([[True], (found[1:] != found[:-1]) | (block[1:] != block[:-1])])[: len(found)]
                at = np.flatnonzero(new)
                size = np.diff(np.concatenate([at, [len(found)]]))
                if len(at):
                    least, most = np.minimum.reduceat(context, at), np.maximum.reduceat(context, at)
                    context = np.where(least == most, least, -1)
                arrays = [_signed(found[at]), pa.array(block[at]), pa.array(context[: len(at)]), pa.array(size > 1)]
                yield pa.RecordBatch.from_arrays(arrays, ["anchor", "block", "context", "many"])

    schema = "anchor long, block long, context long, many boolean"
    return rows.select("block", "text").mapInArrow(run, schema)


def _units(
    texts: list[bytes], anchors: np.ndarray, boundary: np.ndarray, window: int, anchor: int
) -> tuple[np.ndarray, ...]:
    """Units of a block's texts that have a repeated anchor: two keys, first window, number of windows.

    `anchors` are sorted; `boundary` says which of them have different contexts.
    """
    cut = [t.split() for t in texts]
    counts = np.array([len(c) for c in cut], np.int64)
    hashes = WordHashes().of([w for c in cut for w in c])
    found, first, last, place = _anchored(hashes, counts, window, anchor)
    at = np.minimum(np.searchsorted(anchors, found), max(0, len(anchors) - 1))
    hit = anchors[at] == found if len(anchors) else np.zeros(len(found), bool)
    first, last, place = first[hit], last[hit], place[hit]
    edge = boundary[at[hit]] if len(anchors) else np.zeros(0, bool)
    # Windows of the boundary, one by one.
    number = (last - first + 1)[edge]
    each = np.repeat(first[edge], number) + np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    begin = np.concatenate([first[~edge], each])
    end = np.concatenate([last[~edge], each])
    inner = np.concatenate([place[~edge] - first[~edge] + 1, np.zeros(len(each), np.int64)]).astype(np.uint64)
    one = _Spans(hashes).of(begin, end + window) ^ mixed(inner + np.uint64(1))
    two = _Spans(mixed(hashes ^ _SECOND)).of(begin, end + window) ^ mixed(inner + np.uint64(2))
    return one, two, begin, end - begin + 1, np.cumsum(counts) - counts


def _block_units(window: int, anchor: int):
    """For each block: the first of each unit (kind 0), and stretches that are duplicates of it (1)."""

    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _unit_table(*[np.zeros(0, np.int64)] * 8)
        block = docs["_block"][0].as_py()
        docs = docs.group_by(["_id", "_tie"]).aggregate([("_packed", "min")])
        docs = docs.sort_by([("_id", "ascending"), ("_tie", "ascending")])
        ids, ties = docs["_id"].to_numpy(), docs["_tie"].to_numpy()
        texts = unpacked(docs["_packed_min"])
        keys = anchors["anchor"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        one, two, begin, number, starts = _units(
            texts, keys[order], anchors["boundary"].to_numpy(zero_copy_only=False)[order].astype(bool), window, anchor
        )
        order = np.lexsort((begin, two, one))
        one, two, begin, number = one[order], two[order], begin[order], number[order]
        again = np.zeros(len(one), bool)
        again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        from_, length = _merged(begin[again], number[again], starts)
        first = ~again
        begin = np.concatenate([begin[first], from_])
        number = np.concatenate([number[first], length])
        # Keys of their own, so that no other unit meets them and none is hot.
        alone = mixed(np.arange(len(from_), dtype=np.uint64) + (np.uint64(block) << np.uint64(32)))
        doc = np.searchsorted(starts, begin, "right") - 1
        return _unit_table(
            np.repeat([0, 1], [int(first.sum()), len(from_)]),
            np.full(len(begin), block),
            np.concatenate([one[first], alone]),
            np.concatenate([two[first], mixed(alone ^ _SECOND)]),
            ids[doc],
            ties[doc],
            begin - starts[doc],
            number,
        )

    return run


def _unit_table(kind, block, one, two, id_, tie, first, number) -> pa.Table:
    return pa.table(
        {
            "kind": pa.array(kind.astype(np.int32)),
            "block": pa.array(block.astype(np.int64)),
            "one": _signed(one.astype(np.uint64)),
            "two": _signed(two.astype(np.uint64)),
            "id": pa.array(id_),
            "tie": pa.array(tie),
            "first": pa.array(first.astype(np.int32)),
            "number": pa.array(number.astype(np.int32)),
        }
    )


def _merged(begin: np.ndarray, number: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of windows that follow on each other within a text, as one each."""
    order = np.argsort(begin)
    begin, end = begin[order], (begin + number)[order]
    if not len(begin):
        return begin, number
    doc = np.searchsorted(starts, begin, "right")
    new = np.flatnonzero(np.concatenate([[True], (begin[1:] != end[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([new[1:], [len(begin)]]) - 1
    return begin[new], end[last] - begin[new]


def _without(window: int, schema: pa.Schema):
    """Remove the covered words of a block's texts. Adds n_words, n_removed and kept."""

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        spans = spans.sort_by([("id", "ascending"), ("tie", "ascending")])
        columns = [spans[c].to_pylist() for c in ("id", "tie", "first", "number")]
        of_doc: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for id_, tie, first, number in zip(*columns, strict=True):
            of_doc.setdefault((id_, tie), []).append((first, first + number - 1 + window))
        total, removed, kept = [], [], []
        texts = unpacked(docs["_packed"])
        for id_, tie, text in zip(docs["_id"].to_pylist(), docs["_tie"].to_pylist(), texts, strict=True):
            words = text.split()
            total.append(len(words))
            gone = 0
            if (id_, tie) in of_doc:
                rest, at = [], 0
                for first, end in sorted(of_doc[id_, tie]):
                    rest += words[at : max(first, at)]
                    gone += max(0, end - max(first, at))
                    at = max(at, end)
                words = rest + words[at:]
            removed.append(gone)
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        if "text" in schema.names:
            docs = docs.append_column("text", pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string()))
        docs = docs.append_column("n_words", pa.array(total, pa.int64()))
        docs = docs.append_column("n_removed", pa.array(removed, pa.int64()))
        docs = docs.append_column("kept", pa.array(kept, pa.string()))
        return docs.select(schema.names).cast(schema)

    return run


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    block_bytes: int = BLOCK_BYTES,
    keep_text: bool = False,
) -> DataFrame:
    """Add n_words, n_removed and kept (the words that stay, joined by one space) to `docs`.

    `docs` has doc_id (a number), text and any other columns, which pass through; columns that are
    called like the three added ones, or `_block`, `_id`, `_tie` or `_packed`, are replaced. The text itself
    passes through only with `keep_text` (a null text then comes back empty). A word goes if a window of
    `window` words around it also starts earlier in the corpus as it was given.

    Null and empty texts have no words. A null id comes before all others. Rows with equal ids and
    different texts are ordered by a hash of the text; rows equal in both count as one document, and
    each gets its result. Texts shorter than a window stay whole. Empty table: empty result.
    """
    docs = docs.drop("n_words", "n_removed", "kept", "_block", "_id", "_tie", "_packed")
    rows = with_block(docs, block_bytes, "_block").withColumns(
        {
            "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))),
            "_tie": F.xxhash64(F.coalesce("text", F.lit(""))),
        }
    )

    everywhere = Window.partitionBy("anchor")
    indexed = _anchors(rows.select(F.col("_block").alias("block"), "text"), window, anchor).withColumns(
        {
            "blocks": F.count("*").over(everywhere),
            "least": F.min("context").over(everywhere),
            "most": F.max("context").over(everywhere),
        }
    )
    repeated = indexed.where((F.col("blocks") > 1) | F.col("many")).select(
        "block", "anchor", ((F.col("least") != F.col("most")) | (F.col("least") < 0)).alias("boundary")
    )
    texts = packed(rows, "_packed")  # read twice; one exchange serves both
    units = (
        texts.groupBy("_block")
        .cogroup(repeated.groupBy("block"))
        .applyInArrow(
            _block_units(window, anchor),
            "kind int, block long, one long, two long, id long, tie long, first int, number int",
        )
    )
    order = Window.partitionBy("one", "two")
    place = F.struct("id", "tie", "first")
    duplicates = units.withColumn("source", F.min(place).over(order)).where((F.col("source") != place) | (F.col("kind") == 1))
    spans = duplicates.select("block", "id", "tie", "first", "number")
    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    result = T.StructType(
        [
            *fields,
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )
    return (
        texts.groupBy("_block")
        .cogroup(spans.groupBy("block"))
        .applyInArrow(_without(window, to_arrow_schema(result)), result)
    )


def op1_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id",
        "n_words",
        "n_removed",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )
