"""Suffix-array dedup: suffixes of all texts, ordered only through their first LENGTH bytes.

A string of LENGTH bytes goes if it also starts in a document with a smaller id. A full suffix array isn't
needed for that: a most-significant-digit radix sort that stops after LENGTH bytes leaves the equal
strings, and nothing else, together in groups. Each pass looks at one digit and goes on only with groups that
still have several members (`equal_groups`).

A row for each byte of the corpus would be shuffled if suffixes were dealt out by their leading bytes. So the
first pass takes as its digit a part of the string that equal strings share and neighbouring strings
share as well: its anchor, of the runs of ANCHOR bytes in it the one with the least hash. Neighbouring
strings with one anchor are a stretch, and travel as one row.

1. Each block of documents passes on its anchors, each once. Those in one document only are groups of one
   and go: their strings can't be repeated.
2. Of the others each block passes on its stretches with their bytes, equal ones once, with the least id of a
   document that has them. They are dealt out by anchor.
3. There the further passes run over the bytes, eight a digit: first over whole stretches, then, for
   anchors whose stretches differ, over each string in them. Groups that are equal through LENGTH bytes are the
   repeated strings; the least id in a group is its source, and each block learns which of its
   strings have a source before their own.
4. Each block removes the bytes that such strings cover.

An anchor with more than `most_stretches` different stretches (a frequent phrase among ever different
words) would make one large group, so its strings are dealt out one by one by a hash of all their bytes.
All comparisons are by bytes; hashes only decide which rows meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from askgrid.llm.blocks import block_count, packed, unpacked, with_block
from askgrid.llm.words import MULTIPLIER, mixed

#: Bytes of a string that counts as a passage, and of an anchor.
LENGTH = 50
ANCHOR = 16
#: Bytes of text in a block, on average.
BLOCK_BYTES = 8 << 20
#: Bytes of text whose anchors meet in a bucket, on average.
BUCKET_BYTES = 16 << 20
#: Different stretches of one anchor that are sorted together.
MOST_STRETCHES = 1 << 16
#: Strings whose anchors are looked for at a time; bounds the memory of long texts.
_SEGMENT = 1 << 20
#: Strings that are sorted at a time, and stretches that are answered at a time.
_STRINGS, _ANSWERS = 1 << 18, 1 << 14
_ID_BYTES = 6  # bytes of an anchor's hash that are passed on
_NO_ID = -(1 << 63)


def equal_groups(records: np.ndarray) -> np.ndarray:
    """For each row of a byte matrix the place of one row that all rows equal to it name.

    A most-significant-digit radix sort: a digit is eight bytes, and each pass orders only the groups
    that are still equal and have several members.
    """
    rows, width = records.shape
    digits = np.zeros((rows, -(-width // 8) * 8), np.uint8)
    digits[:, :width] = records
    digits = digits.view(">u8")
    group, live = np.zeros(rows, np.int64), np.arange(rows)
    for place in range(digits.shape[1]):
        if not len(live):
            break
        digit = digits[live, place].astype(np.uint64)
        order = np.lexsort((digit, group[live])) if place else np.argsort(digit, kind="stable")
        live, digit = live[order], digit[order]
        held = group[live]
        new = np.concatenate([[True], (held[1:] != held[:-1]) | (digit[1:] != digit[:-1])])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(live)))
        group[live] = np.repeat(live[start], size)
        live = live[np.repeat(size > 1, size)]
    return group


def _least(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row the least of the values of its group (groups are places of rows)."""
    least = values.copy()
    np.minimum.at(least, group, values)
    return least[group]


def _anchored(text: np.ndarray, starts: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Stretches of strings with one anchor: its hash, its place, the first string, the number of strings.

    `text` holds the texts end to end, which begin at `starts`; strings stay within a text. A stretch also
    ends at a multiple of _SEGMENT.
    """
    inside = np.ones(max(0, len(text) - length + 1), bool)
    for end in starts[1:]:
        inside[max(0, end - length + 1) : end] = False
    found = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    bits = np.uint64(_SEGMENT.bit_length() + 1)
    low = (np.uint64(1) << bits) - np.uint64(1)
    for begin in range(0, len(inside), _SEGMENT):
        here = inside[begin : begin + _SEGMENT]
        at = np.flatnonzero(here)
        if not len(at):
            continue
        runs = len(here) + length - anchor
        part = np.zeros(runs + anchor + 8, np.uint8)
        piece = text[begin : begin + runs + anchor - 1]
        part[: len(piece)] = piece
        hashes = np.zeros(runs, np.uint64)
        for offset in range(0, anchor, 8):
            eight = np.ndarray((runs,), "<u8", part, offset, (1,))
            left = min(8, anchor - offset)
            hashes = (hashes ^ (eight & np.uint64((1 << 8 * left) - 1))) * MULTIPLIER
            hashes ^= hashes >> np.uint64(29)
        hashes = mixed(hashes)
        # The hash's upper bits, then the place: the least is the leftmost of the least.
        least = (hashes & ~low) | np.arange(runs, dtype=np.uint64)
        width, have = length - anchor + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[: len(least) - have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        place = (least[at] & low).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
        hash_ = hashes[place[new]] >> np.uint64(64 - 8 * _ID_BYTES)
        found.append((hash_, place[new] + begin, at[new] + begin, np.diff(np.append(new, len(at)))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class _Block:
    """The texts of a block in the order of their ids, end to end."""

    def __init__(self, docs: pa.Table, length: int, anchor: int):
        self.length, self.anchor = length, anchor
        self.most = length - anchor + 1
        self.order = np.lexsort((docs["_tie"].to_numpy(), docs["_id"].to_numpy()))
        self.ids = docs["_id"].to_numpy()[self.order]
        texts = unpacked(docs["_packed"])
        texts = [texts[i] for i in self.order]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.hash, self.place, self.first, self.number = _anchored(self.text, self.starts, length, anchor)
        self.id = self.ids[np.searchsorted(self.starts, self.first, "right") - 1] if len(texts) else self.ids

    def choose(self, which: np.ndarray) -> None:
        self.hash, self.place, self.first, self.number, self.id = (
            x[which] for x in (self.hash, self.place, self.first, self.number, self.id)
        )

    def stretches(self) -> np.ndarray:
        """A row per stretch: its anchor, the anchor's place in it, its number of strings, its bytes."""
        head = 8
        rows = np.zeros((len(self.first), head + self.length + self.most - 1), np.uint8)
        rows[:, :_ID_BYTES] = _as_bytes(self.hash)
        rows[:, 6], rows[:, 7] = self.place - self.first, self.number
        width = self.length + self.most - 1
        rows[:, head:] = _cut(np.concatenate([self.text, np.zeros(width, np.uint8)]), self.first, width)
        rows[:, head:][~_inside(rows, self.length)] = 0
        return rows

    def strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row of bytes per string of the chosen stretches, the stretch that it belongs to, and its place there."""
        stretch, offset = _expanded(self.number)
        return _cut(self.text, self.first[stretch] + offset, self.length), stretch, offset


def _cut(text: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The `width` bytes from each start on, as a matrix."""
    if not len(starts):
        return np.zeros((0, width), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(text, width)[starts]


def _expanded(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 to n - 1 for each of `numbers`, with the place of the number."""
    numbers = numbers.astype(np.int64)
    of = np.repeat(np.arange(len(numbers)), numbers)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(numbers) - numbers, numbers)


def _as_bytes(hashes: np.ndarray) -> np.ndarray:
    """The last _ID_BYTES bytes of 64-bit values, as a matrix."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _ID_BYTES :]


def _from_bytes(matrix: np.ndarray) -> np.ndarray:
    whole = np.zeros((len(matrix), 8), np.uint8)
    whole[:, 8 - _ID_BYTES :] = matrix[:, :_ID_BYTES]
    return whole.view(">u8").ravel().astype(np.uint64)


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of a byte matrix."""
    total = np.full(len(rows), np.uint64(rows.shape[1]), np.uint64)
    for column in range(rows.shape[1]):
        total = (total ^ rows[:, column]) * MULTIPLIER
        total ^= total >> np.uint64(29)
    return mixed(total)


def _pieces(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct key with the rows that have it, in their order."""
    order = np.argsort(keys, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
        if len(part):
            yield int(keys[part[0]]), part


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema.names]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


_ANCHORS = "bucket long, block long, anchors binary, counts binary"
_REPEATED = "block long, kind int, bucket long, body binary, many binary"
_STRETCHES = "bucket long, block long, kind int, heads binary, ids binary, body binary"


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _block_anchors(length: int, anchor: int, buckets: int, schema: pa.Schema):
    """Step 1 in a block: its anchors by bucket, with the number of their stretches and if several ids have them."""

    def run(docs: pa.Table) -> pa.Table:
        block = _Block(docs, length, anchor)
        order = np.lexsort((block.id, block.hash))
        block.choose(order)
        at = np.flatnonzero(np.concatenate([[True], block.hash[1:] != block.hash[:-1]])[: len(order)])
        size = np.diff(np.append(at, len(order)))
        hashes, last = block.hash[at], at + size - 1
        several = block.id[last] != block.id[at]
        block.choose(np.repeat(size > 1, size))
        group = equal_groups(block.stretches())
        different = np.zeros(len(at), np.int64) + 1
        if len(group):
            of = np.repeat(np.cumsum(size > 1) - 1, size)[np.repeat(size > 1, size)]
            different[size > 1] = np.bincount(of[np.unique(group)], minlength=int((size > 1).sum()))
        counts = (np.minimum(different, (1 << 15) - 1) * 2 + several).astype("<u2")
        number = docs["_block"][0].as_py()
        rows = [
            (bucket, number, _as_bytes(hashes[part]).tobytes(), counts[part].tobytes())
            for bucket, part in _pieces((hashes % np.uint64(buckets)).astype(np.int64))
        ]
        return _table(rows, schema)

    return run


def _bucket_anchors(most_stretches: int, schema: pa.Schema):
    """Step 1 in a bucket: what each block has of anchors that are in several documents (kind 0)."""

    def run(pieces: pa.Table) -> pa.Table:
        blocks, bucket = pieces["block"].to_numpy(), pieces["bucket"][0].as_py()
        anchors = _from_bytes(_joined(pieces["anchors"]).reshape(-1, _ID_BYTES))
        counts = _joined(pieces["counts"]).view("<u2").astype(np.int64)
        piece = np.repeat(np.arange(len(blocks)), [len(c) // 2 for c in pieces["counts"].to_pylist()])
        order = np.argsort(anchors, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], anchors[order][1:] != anchors[order][:-1]])[: len(order)])
        size = np.diff(np.append(at, len(order)))
        counts = counts[order]
        repeated = (size > 1) | (np.maximum.reduceat(counts & 1, at) > 0)
        # A block that has an anchor in one stretch only passes on one row; only more than that can pile up.
        many = np.add.reduceat((counts >> 1) - 1, at) > most_stretches
        keep = np.repeat(repeated, size)
        many, chosen = np.repeat(many, size)[keep], order[keep]
        rows = []
        for number, part in _pieces(piece[chosen]):
            body = _as_bytes(anchors[chosen[part]]).tobytes()
            rows.append((int(blocks[number]), 0, bucket, body, many[part].astype(np.uint8).tobytes()))
        return _table(rows, schema)

    return run


def _units(block: _Block, replies: pa.Table, buckets: int) -> Iterator[tuple]:
    """Step 2 in a block: its distinct stretches (kind 0) and single strings (kind 1) of repeated anchors.

    For each kind: the rows in the order of their buckets, their buckets, the least id that has each, and for
    step 4 the first string, the number of strings, the id and the row of each occurrence. The same texts
    and replies give the same rows.
    """
    replies = replies.filter(pc.equal(replies["kind"], 0))
    anchors = _from_bytes(_joined(replies["body"]).reshape(-1, _ID_BYTES))
    many = _joined(replies["many"]).astype(bool)
    order = np.argsort(anchors)
    anchors, many = anchors[order], many[order]
    at = np.minimum(np.searchsorted(anchors, block.hash), max(0, len(anchors) - 1))
    known = anchors[at] == block.hash if len(anchors) else np.zeros(len(block.hash), bool)
    crowded = known.copy()
    crowded[known] = many[at[known]]

    def dealt(kind: int, rows: np.ndarray, hashes: np.ndarray, first: np.ndarray, number: np.ndarray, ids: np.ndarray):
        group = equal_groups(rows)
        kept, unit = np.unique(group, return_inverse=True)
        bucket = (hashes[kept] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        kept = kept[order]
        return kind, rows[kept], bucket[order], _least(ids, group)[kept], first, number, ids, place[unit]

    rest = _copy(block, known & ~crowded)
    yield dealt(0, rest.stretches(), rest.hash, rest.first, rest.number, rest.id)
    crowd = _copy(block, crowded)
    rows, stretch, offset = crowd.strings()
    yield dealt(1, rows, _hash_rows(rows), crowd.first[stretch] + offset, np.ones(len(rows), np.int64), crowd.id[stretch])


def _copy(block: _Block, which: np.ndarray) -> _Block:
    other = object.__new__(_Block)
    other.__dict__.update(block.__dict__)
    other.choose(which)
    return other


def _block_stretches(length: int, anchor: int, buckets: int, schema: pa.Schema):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows and replies.num_rows:
            number = docs["_block"][0].as_py()
            for kind, units, bucket, least, *_ in _units(_Block(docs, length, anchor), replies, buckets):
                least = least.astype("<i8")
                for to, part in _pieces(bucket):
                    these = units[part]
                    if kind:
                        heads, body = b"", these.tobytes()
                    else:
                        heads, body = these[:, :8].tobytes(), these[:, 8:][_inside(these, length)].tobytes()
                    rows.append((to, number, kind, heads, least[part].tobytes(), body))
        return _table(rows, schema)

    return run


def _inside(stretches: np.ndarray, length: int) -> np.ndarray:
    """Which bytes behind the heads belong to the stretches."""
    return np.arange(stretches.shape[1] - 8) < (stretches[:, 7].astype(np.int64) + length - 1)[:, None]


def _sources(kept: np.ndarray, least: np.ndarray, length: int, most: int) -> np.ndarray:
    """For each string of each of the distinct stretches `kept` the least id of a document that has it."""
    source = np.repeat(least[:, None], most, 1)
    if not len(kept):
        return source
    hashes = _from_bytes(kept[:, :_ID_BYTES])
    order = np.argsort(hashes, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])[: len(order)])
    size = np.diff(np.append(at, len(order)))
    # Anchors whose stretches differ: their strings, about _STRINGS at a time.
    strings = np.add.reduceat(kept[order, 7].astype(np.int64), at) * (size > 1)
    turn = np.where(size > 1, (np.cumsum(strings) - strings) // _STRINGS, -1)
    for number in np.unique(turn[turn >= 0]):
        these = order[np.repeat(turn == number, size)]
        stretch, offset = _expanded(kept[these, 7])
        rows = _cut(kept.reshape(-1), these[stretch] * kept.shape[1] + 8 + offset, length)
        source[these[stretch], offset] = _least(least[these[stretch]], equal_groups(rows))
    return source


def _bucket_stretches(length: int, anchor: int, schema: pa.Schema):
    """Step 3: for each unit of each block, which of its strings have a source with a smaller id (kinds 1 and 2)."""
    most = length - anchor + 1

    def stretches(pieces: pa.Table) -> np.ndarray:
        heads = _joined(pieces["heads"]).reshape(-1, 8)
        ids = _joined(pieces["ids"]).view("<i8")
        rows = np.zeros((len(heads), 8 + length + most - 1), np.uint8)
        rows[:, :8] = heads
        rows[:, 8:][_inside(rows, length)] = _joined(pieces["body"])
        group = equal_groups(rows)
        kept, unit = np.unique(group, return_inverse=True)
        source = _sources(rows[kept], _least(ids, group)[kept], length, most)
        parts = [slice(i, i + _ANSWERS) for i in range(0, len(ids), _ANSWERS)]
        return np.concatenate([np.packbits(source[unit[p]] < ids[p, None], axis=1) for p in parts])

    def strings(pieces: pa.Table) -> np.ndarray:
        ids = _joined(pieces["ids"]).view("<i8")
        group = equal_groups(_joined(pieces["body"]).reshape(-1, length))
        return np.packbits((_least(ids, group) < ids)[:, None], axis=1)

    def run(pieces: pa.Table) -> pa.Table:
        rows = []
        for kind, answer in ((0, stretches), (1, strings)):
            these = pieces.filter(pc.equal(pieces["kind"], kind))
            if not these.num_rows:
                continue
            answers, at = answer(these), 0
            blocks, buckets = these["block"].to_pylist(), these["bucket"].to_pylist()
            for block, bucket, ids in zip(blocks, buckets, these["ids"].to_pylist(), strict=True):
                units = len(ids) // 8
                rows.append((block, kind + 1, bucket, answers[at : at + units].tobytes(), b""))
                at += units
        return _table(rows, schema)

    return run


def _without(length: int, anchor: int, buckets: int, schema: pa.Schema):
    """Step 4: the texts of a block without their repeated strings. Adds n_bytes, n_removed, n_spans and kept."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        block = _Block(docs, length, anchor)
        change = np.zeros(len(block.text) + 1, np.int32)
        for kind, units, _, least, first, number, ids, unit in _units(block, replies, buckets):
            answers = replies.filter(pc.equal(replies["kind"], kind + 1)).sort_by("bucket")
            bits = _joined(answers["body"]).reshape(len(units), -1) if len(units) else np.zeros((0, 1), np.uint8)
            gone = np.unpackbits(bits, axis=1).astype(bool)[unit] | (ids > least[unit])[:, None]
            row, offset = np.nonzero(gone)
            inside = offset < number[row]
            start = first[row[inside]] + offset[inside]
            np.add.at(change, start, 1)
            np.add.at(change, start + length, -1)
        covered = np.cumsum(change[:-1], dtype=np.int32) > 0
        result = {"n_removed": [], "n_spans": [], "kept": []}
        for start, size in zip(block.starts.tolist(), block.sizes.tolist(), strict=True):
            gone = covered[start : start + size]
            result["n_removed"].append(int(gone.sum()))
            result["n_spans"].append(int((gone[1:] & ~gone[:-1]).sum()) + int(size > 0 and gone[0]))
            result["kept"].append(block.text[start : start + size][~gone].tobytes())
        docs = docs.take(pa.array(block.order))
        docs = docs.append_column("n_bytes", pa.array(block.sizes))
        for name, values in result.items():
            docs = docs.append_column(name, pa.array(values, schema.field(name).type))
        return docs.select(schema.names).cast(schema)

    return run


def remove_repeated_strings(
    docs: DataFrame,
    length: int = LENGTH,
    anchor: int = ANCHOR,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    most_stretches: int = MOST_STRETCHES,
) -> DataFrame:
    """`docs` without its text, with n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: the
    bytes that stay).

    `docs` has doc_id (a number), text and any other columns, which pass through; columns that are called like
    the four added ones, or `_block`, `_id`, `_tie` or `_packed`, are replaced. `length` is at least `anchor`, and
    at most 255 more.

    Null and empty texts have no bytes. A null id is smaller than all others; rows without an id, and rows with
    equal ids, take nothing from each other. Repeated rows each get the same result. Texts shorter than `length`
    stay whole. Empty table: empty result. A block holds about `block_bytes` of text, but never less than one text.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    docs = docs.drop(*added, "_block", "_id", "_tie", "_packed")
    buckets = block_count(docs, bucket_bytes)
    rows = with_block(docs, block_bytes, "_block").withColumns(
        {
            "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)),
            "_tie": F.xxhash64(F.coalesce("text", F.lit(""))),
        }
    )
    # Read three times; one exchange serves all.
    texts = packed(rows, "_packed")
    anchors = texts.groupBy("_block").applyInArrow(_block_anchors(length, anchor, buckets, _arrow(_ANCHORS)), _ANCHORS)
    repeated = anchors.groupBy("bucket").applyInArrow(_bucket_anchors(most_stretches, _arrow(_REPEATED)), _REPEATED)
    stretches = (
        texts.groupBy("_block")
        .cogroup(repeated.groupBy("block"))
        .applyInArrow(_block_stretches(length, anchor, buckets, _arrow(_STRETCHES)), _STRETCHES)
    )
    sources = stretches.groupBy("bucket").applyInArrow(_bucket_stretches(length, anchor, _arrow(_REPEATED)), _REPEATED)
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.BinaryType()]
    fields = [f for f in docs.schema.fields if f.name != "text"]
    result = T.StructType([*fields, *[T.StructField(n, k) for n, k in zip(added, kinds, strict=True)]])
    return (
        texts.groupBy("_block")
        .cogroup(repeated.unionByName(sources).groupBy("block"))
        .applyInArrow(_without(length, anchor, buckets, to_arrow_schema(result)), result)
    )


def op12_suffix_sort(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_strings(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
