"""N-gram Jaccard join by PartEnum signatures, and the groups that its links make.

A document's set are the hashes of its word shingles. Equal sets are one node from the start. Sizes of
linked sets lie in one band of sizes or in two that follow on each other. For each such pair of bands
the similarity bounds how many elements two linked sets can differ in, k. Elements are dealt by hash into
more than k parts, so two linked sets agree in some: each part's elements, hashed, are a signature, and
linked sets share one.

1. The corpus is cut into blocks of documents that ask buckets which of their elements another set holds, too.
   A set that has less than the similarity's share of such elements is linked with none, so a common passage in
   texts that are otherwise their own ties nothing. Each block makes the signatures of its other sets and passes on
   each signature once; nodes that share one within the block are tied to its first node there.
2. Nodes that share a signature are tied to the least of them. The connected components of these ties are
   families: no link leaves a family. Most documents are in none.
3. A family of up to PART nodes meets in one task, which counts the intersections of all its sets exactly
   (a matrix product over the elements they share) and passes on only a spanning forest of the links.
   A larger one is cut by bands of sizes and by hash into parts of about 4 * PART nodes, and parts of one or
   of neighbouring bands meet pair by pair. There, bitmaps go first: a bit is the parity of the elements
   dealt to it, so two sets differ in at least as many elements as their bitmaps in bits. Only sets
   with a partner that this does not rule out meet as a whole.
4. The components of these links are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askgrid.llm.blocks import block_count, packed, unpacked
from askgrid.llm.components import components
from askgrid.llm.ranges import below
from askgrid.llm.words import WordHashes, mixed, stretches, windows
from askgrid.session import materialise

PART = 256
_COLUMNS = 4096
#: Bytes of text in a block, on average, and elements whose signatures are made at a time.
BLOCK_BYTES = 4 << 20
_AT_ONCE = 1 << 18
#: Bytes of text whose words stand as objects at a time.
STRETCH = 1 << 20
_TIE = np.uint64(0xA24BAED4963EE407)
_LAST = (1 << 63) - 1


def bands(most: int, share: int) -> np.ndarray:
    """Starts of the bands of sizes, beyond `most`. A band ends after its start by the similarity."""
    starts = [1]
    while starts[-1] <= most or len(starts) < 4:
        starts.append(max(starts[-1] + 1, starts[-1] * 100 // share + 1))
    return np.array([*starts, starts[-1] * 100 // share + 1, 2 * starts[-1] * 100 // share + 2], np.int64)


def _sets(texts: list[bytes], words: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all sets one after the other, sorted within each, and the number in each.

    A text with fewer than `words` words has one element, the whole sequence.
    """
    cut = [t.lower().split() for t in texts]
    counts = np.array([len(c) for c in cut], np.int64)
    hashes = known.of([w for c in cut for w in c])
    ends = np.cumsum(counts)
    starts = ends - counts
    owner = np.repeat(np.arange(len(cut)), counts)
    elements = windows(hashes, words)
    inside = owner[: len(elements)] == owner[words - 1 :][: len(elements)]
    elements, doc = elements[inside], owner[: len(inside)][inside]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        whole = np.array([windows(hashes[starts[i] : ends[i]], int(counts[i]))[0] for i in short], np.uint64)
        elements, doc = np.concatenate([elements, whole]), np.concatenate([doc, short])
    order = np.argsort(elements)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(cut) <= 1 << 16 else np.int64), kind="stable")]
    elements, doc = elements[order], doc[order]
    new = np.ones(len(elements), bool)
    new[1:] = (elements[1:] != elements[:-1]) | (doc[1:] != doc[:-1])
    return elements[new], np.bincount(doc[new], minlength=len(cut)).astype(np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each stretch of `values`; 0 for an empty one."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def _nodes(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set."""
    return mixed(_sums(mixed(elements ^ _TIE), sizes) + sizes.astype(np.uint64))


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def row_key() -> dict[str, Column]:
    """What a row of (doc_id, text) is known by: its id, nulls last, and 128 bits of its text."""
    return {
        "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)),
        "digest": F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))),
    }


def _keys() -> list[Column]:
    return [column.alias(name) for name, column in row_key().items()]


def _classes(docs: DataFrame, words: int) -> DataFrame:
    """id, digest, node, size of each row of `docs` (id, digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for batch in stretches(whole, "text", STRETCH):
                elements, sizes = _sets(_bytes(batch), words, known)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("digest"), _signed(_nodes(elements, sizes)), pa.array(sizes)],
                    ["id", "digest", "node", "size"],
                )

    return docs.select("id", "digest", "text").mapInArrow(run, "id long, digest binary, node long, size long")


def parts_for(low: int, most: int, share: int) -> tuple[int, int]:
    """Number of parts for sets of `low` to `most` elements, and of empty parts that need no signature.

    Linked sets differ in at most k elements, so of k + 1 + spare parts they agree in spare + 1. If one
    has no more than `spare` empty parts, a part with elements is among those. `spare` is chosen
    so that this holds for nearly all sets. With k = 0 linked sets are equal, and no part is needed.
    """
    k = 2 * most * (100 - share) // (100 + share)
    if k == 0:
        return 0, 0
    spare = 0
    while True:
        parts = k + 1 + spare
        empty = parts * math.exp(-low / parts)
        enough = math.ceil(empty + 2 * math.sqrt(empty)) if empty > 0.01 else 0
        if spare >= enough or spare > 2 * k + 8:
            return parts, spare
        spare += 1


def signatures(elements: np.ndarray, sizes: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and the place of the set that each belongs to.

    A part with elements gives a signature. If a set has more empty parts than `spare`, the first of
    them give one each, all but `spare`: two such sets that agree in spare + 1 empty parts have one of
    these in common. Sets too small to differ from a linked one have none.
    """
    starts = bands(int(sizes.max(initial=1)), share)
    band = np.searchsorted(starts, sizes, "right") - 1
    doc = np.repeat(np.arange(len(sizes)), sizes)
    weights = mixed(elements)
    found, owners = [], []
    for ahead in (0, 1):  # with the band below, and with the band above
        pair = band + ahead
        plan = np.zeros((len(starts), 2), np.int64)
        for p in np.unique(pair[sizes > 0]).tolist():
            plan[p] = parts_for(int(starts[max(p - 1, 0)]), int(starts[p + 1]) - 1, share)
        parts = np.where(sizes > 0, plan[np.maximum(pair, 0), 0], 0)
        spare = plan[np.maximum(pair, 0), 1]
        offset = np.cumsum(parts) - parts
        used = parts[doc] > 0
        d = doc[used]
        part = mixed(elements[used] ^ mixed(pair[d].astype(np.uint64))) % parts[d].astype(np.uint64)
        place = offset[d] + part.astype(np.int64)
        order = np.argsort(place, kind="stable")
        filled, first = np.unique(place[order], return_index=True)
        owner = np.repeat(np.arange(len(sizes)), parts)
        number = (np.arange(len(owner)) - offset[owner]).astype(np.uint64)
        key = mixed((pair[owner].astype(np.uint64) << np.uint64(40)) + number)
        if len(filled):
            sums = np.add.reduceat(weights[used][order], first)
            found.append(mixed(sums + key[filled]))
            owners.append(owner[filled])
        empty = np.ones(len(owner), bool)
        empty[filled] = False
        empty = np.flatnonzero(empty)
        many = np.bincount(owner[empty], minlength=len(sizes))
        rank = np.arange(len(empty)) - (np.cumsum(many) - many)[owner[empty]]
        empty = empty[rank < (many - spare)[owner[empty]]]
        found.append(mixed(key[empty] ^ _TIE))
        owners.append(owner[empty])
    return np.concatenate(found), np.concatenate(owners)


def _once_a_batch(rows: DataFrame) -> DataFrame:
    """block, digest and the packed text of the rows, without those whose text stands earlier in their batch, so a text
    in a third of all rows costs a row per batch. One Python worker in a task does both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[bytes, int] = {}
            for i, digest in enumerate(batch.column("digest").to_pylist()):
                first.setdefault(digest, i)
            yield batch if len(first) == batch.num_rows else batch.take(pa.array(first.values(), pa.int64()))

    return packed(rows.select("block", "digest", "text"), first=run)


def _deltas(values: np.ndarray) -> bytes:
    """Rising 32-bit values as their differences, first bytes first, compressed."""
    steps = np.diff(values, prepend=np.uint32(0)).astype(np.uint32)
    planes = steps.view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(planes)


def _undone(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The values that `_deltas` has packed."""
    unpack = zstandard.ZstdDecompressor().decompress
    planes = [np.frombuffer(unpack(b), np.uint8).reshape(4, -1) for b in column.to_pylist()]
    return [np.cumsum(np.ascontiguousarray(p.T).reshape(-1).view(np.uint32), dtype=np.uint32) for p in planes]


class _Block:
    """The different sets of a block's texts, and its elements in the order in which it asks for them: by bucket
    and lowest 32 bits. Elements that agree in both are asked for as one."""

    def __init__(self, texts: pa.Table, words: int, buckets: int):
        known, found = WordHashes(), []
        for batch in texts.select(["packed"]).to_batches(max_chunksize=512):
            elements, sizes = _sets(unpacked(batch.column("packed")), words, known)
            found.append((elements, sizes, _nodes(elements, sizes)))
        elements, sizes, nodes = (np.concatenate(x) for x in zip(*found, strict=True))
        _, first = np.unique(nodes, return_index=True)  # equal sets: once
        keep = np.zeros(len(nodes), bool)
        keep[first] = True
        self.elements, self.sizes, self.nodes = elements[np.repeat(keep, sizes)], sizes[keep], nodes[keep]
        bucket = (self.elements >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
        keys = bucket << np.uint64(32) | (self.elements & np.uint64(0xFFFFFFFF))
        keys, self.place, holders = np.unique(keys, return_inverse=True, return_counts=True)
        self.bucket, self.values = (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32)
        self.many = holders > 1

    def asks(self, block: int) -> pa.Table:
        """A row per bucket: the block's elements there, and which of them several of its sets hold."""
        starts = np.flatnonzero(np.append(np.ones(min(1, len(self.bucket)), bool), np.diff(self.bucket) > 0))
        ends = np.append(starts[1:], len(self.bucket))
        spans = list(zip(starts.tolist(), ends.tolist(), strict=True)) if len(starts) else []
        columns = {
            "bucket": pa.array(self.bucket[starts]),
            "block": pa.array(np.full(len(starts), block, np.int64)),
            "elements": pa.array([_deltas(self.values[s:e]) for s, e in spans], pa.binary()),
            "several": pa.array([np.packbits(self.many[s:e]).tobytes() for s, e in spans], pa.binary()),
        }
        return pa.table(columns)

    def linkable(self, replies: pa.Table, share: int) -> np.ndarray:
        """Which sets share enough of their elements with others."""
        replies = replies.sort_by("bucket")
        number = np.bincount(self.bucket)
        bits = [
            np.unpackbits(np.frombuffer(b, np.uint8), count=int(number[at]))
            for at, b in zip(replies["bucket"].to_pylist(), replies["several"].to_pylist(), strict=True)
        ]
        shared = np.concatenate([np.zeros(0, np.uint8), *bits])[self.place]
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        held = np.bincount(owner, weights=shared, minlength=len(self.sizes)).astype(np.int64)
        return (self.sizes > 0) & (100 * held >= share * self.sizes)


def _several(asks: pa.Table) -> pa.Table:
    """What a bucket replies to all blocks: which of their elements several sets hold. Elements are compared by bucket
    and 32 bits, so one may seem to be held by several sets, but none that is seems not to be."""
    values = _undone(asks["elements"])
    bits = [
        np.unpackbits(np.frombuffer(b, np.uint8), count=len(v)).astype(bool)
        for b, v in zip(asks["several"].to_pylist(), values, strict=True)
    ]
    _, place, blocks = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    several = blocks > 1
    several[place[np.concatenate(bits)]] = True
    replies = np.split(several[place], np.cumsum([len(v) for v in values])[:-1])
    column = pa.array([np.packbits(r).tobytes() for r in replies], pa.binary())
    return pa.table({"bucket": asks["bucket"], "block": asks["block"], "several": column})


def _signature_table(elements: np.ndarray, sizes: np.ndarray, nodes: np.ndarray, share: int) -> pa.Table:
    """Each signature once, with the first node that has it; other nodes that have it share a signature made of
    that node."""
    found, owner = signatures(elements, sizes, share)
    order = np.lexsort((owner, found))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    leader = owner[new][np.cumsum(new) - 1]
    tied = np.unique(np.stack([leader[~new], owner[~new]], axis=1), axis=0)
    leaders = np.unique(tied[:, 0])
    tie = lambda at: mixed(nodes[at] ^ _TIE)
    return pa.table(
        {
            "signature": _signed(np.concatenate([found[new], tie(tied[:, 0]), tie(leaders)])),
            "node": _signed(np.concatenate([nodes[owner[new]], nodes[tied[:, 1]], nodes[leaders]])),
        }
    )


def _signature_rows(docs: DataFrame, words: int, share: int, block_bytes: int) -> DataFrame:
    """signature, node: the signatures of the sets in `docs` (digest, text) that may have a link."""
    blocks = block_count(docs, block_bytes)
    buckets = -(-blocks // 2)
    block = F.pmod(F.xxhash64("digest"), F.lit(blocks).cast("long"))
    texts = _once_a_batch(docs.withColumn("block", block))  # read twice; one exchange serves both

    def asked(texts: pa.Table) -> pa.Table:
        return _Block(_distinct(texts), words, buckets).asks(texts["block"][0].as_py())

    def signed(texts: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(_distinct(texts), words, buckets)
        kept = block.linkable(replies, share)
        elements, sizes = block.elements[np.repeat(kept, block.sizes)], block.sizes[kept]
        nodes, ends = block.nodes[kept], np.cumsum(sizes)
        tables, start = [_signature_table(elements[:0], sizes[:0], nodes[:0], share)], 0
        while start < len(sizes):
            begin = int(ends[start] - sizes[start])
            end = max(start + 1, int(np.searchsorted(ends, begin + _AT_ONCE, "right")))
            stretch = elements[begin : ends[end - 1]]
            tables.append(_signature_table(stretch, sizes[start:end], nodes[start:end], share))
            start = end
        return pa.concat_tables(tables)

    asks = texts.groupBy("block").applyInArrow(asked, "bucket long, block long, elements binary, several binary")
    replies = asks.groupBy("bucket").applyInArrow(_several, "bucket long, block long, several binary")
    return (
        texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(signed, "signature long, node long")
    )


def _distinct(texts: pa.Table) -> pa.Table:
    """One row for each text."""
    once = texts.group_by("digest").aggregate([("packed", "min")])
    return pa.table({"packed": once["packed_min"]})


def sketch(elements: np.ndarray) -> bytes:
    """Parities of the elements dealt to the bits, two bits or more per element.

    Halves laid over each other by exclusive or give the sketch of half the length.
    """
    bits = 1 << max(6, (2 * len(elements) - 1).bit_length())
    place = (mixed(elements ^ _TIE) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits) & 1, bitorder="little").tobytes()


_PLACE = ["family", "parts", "part", "band", "node", "size"]


def _split(texts: pa.ChunkedArray, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sets of packed texts, one array each, and their nodes."""
    elements, sizes = _sets(unpacked(texts), words, WordHashes())
    ends = np.cumsum(sizes)
    sets = [elements[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    return sets, _nodes(elements, sizes).view(np.int64)


def _sketched(rows: DataFrame, words: int) -> DataFrame:
    """Add the sketch of each packed text's set; of rows with one id only those that the node was made
    of stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, nodes = _split(batch.column("packed"), words)
            arrays = [batch.column(n) for n in [*_PLACE, "packed"]] + [pa.array([sketch(x) for x in sets], pa.binary())]
            same = pa.array(nodes == batch.column("node").to_numpy())
            yield pa.RecordBatch.from_arrays(arrays, [*_PLACE, "packed", "sketch"]).filter(same)

    return rows.mapInArrow(
        run, "family long, parts int, part int, band int, node long, size long, packed binary, sketch binary"
    )


def _near(share: int):
    """Nodes of two parts that have a partner in the other one (or in the part, if it is one) which
    their sketches do not rule out."""

    def run(table: pa.Table) -> pa.Table:
        sizes, part = table["size"].to_numpy(), table["part"].to_numpy()
        sketches = table["sketch"].to_pylist()
        lengths = np.array([len(s) for s in sketches])
        two = table["low"][0].as_py() != table["high"][0].as_py()
        near = np.zeros(len(sizes), bool)
        for length in np.unique(lengths).tolist():
            # Linked sizes are within a factor of two, so sketches are as long or twice as long.
            mine, other = np.flatnonzero(lengths == length), np.flatnonzero(lengths == 2 * length)
            whole = np.frombuffer(b"".join(sketches[i] for i in mine), np.uint64).reshape(len(mine), length // 8)
            twice = np.frombuffer(b"".join(sketches[i] for i in other), np.uint64).reshape(len(other), 2, length // 8)
            folded = twice[:, 0] ^ twice[:, 1] if len(other) else whole[:0]
            all_, bits = np.concatenate([mine, other]), np.concatenate([whole, folded])
            rows = max(1, (1 << 21) // bits.size)
            for start in range(0, len(mine), rows):
                at = mine[start : start + rows]
                differ = np.bitwise_count(whole[start : start + rows, None] ^ bits[None]).sum(axis=2, dtype=np.int64)
                allowed = (sizes[at][:, None] + sizes[all_][None]) * (100 - share) // (100 + share)
                maybe = (differ <= allowed) & (at[:, None] != all_[None])
                if two:
                    maybe &= part[at][:, None] != part[all_][None]
                near[at] |= maybe.any(axis=1)
                near[all_] |= maybe.any(axis=0)
        return table.select(["family", "pair", "low", "high", "node"]).filter(pa.array(near))

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products over the elements they share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        low, high = np.searchsorted(column, [start, start + _COLUMNS])
        matrix = np.zeros((len(sets), _COLUMNS), np.float32)
        matrix[owner[low:high], column[low:high] - start] = 1
        total += matrix @ matrix.T
    return total.astype(np.int64)


def _links(words: int, share: int):
    """Spanning forest of the links among sets that meet."""

    def run(table: pa.Table) -> pa.Table:
        sets, nodes = _split(table["packed"], words)
        sizes = np.array([len(s) for s in sets])
        common = intersections(sets)
        linked = 100 * common >= share * (sizes[:, None] + sizes[None, :] - common)
        np.fill_diagonal(linked, True)
        label = np.arange(len(nodes))
        while True:
            least = np.where(linked, label[None, :], len(nodes)).min(axis=1)
            least = np.minimum(least, least[least])
            if (least == label).all():
                break
            label = least
        rest = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table({"a": pa.array(nodes[label[rest]]), "b": pa.array(nodes[rest])})

    return run


def _grouped(rows: DataFrame, words: int, share: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The classes of `rows` (id, digest, text), and node, id and digest of the least row that a chain
    of links reaches from each node with elements."""
    classes = materialise(_classes(rows, words), "classes")

    of_signature = Window.partitionBy("signature")
    ties = (
        _signature_rows(rows, words, share, block_bytes)
        .withColumn("least", F.min("node").over(of_signature))
        .where("node != least")
        .select(F.col("least").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    families = materialise(components(materialise(ties, "ties")).select("node", F.col("root").alias("family")), "families")

    first = F.min(F.struct("id", "digest")).alias("first")
    standing = classes.where("size > 0").groupBy("node").agg(first, F.min("size").alias("size"))
    standing = materialise(standing.select("node", "first.*", "size"), "standing")
    starts = bands(standing.agg(F.max("size")).first()[0] or 1, share).tolist()
    placed = families.join(standing, "node").withColumn("band", below(F.lit(starts), F.col("size"), len(starts)) - 1)
    placed = materialise(placed, "placed")
    many = placed.groupBy("family", "band").count().groupBy("family").agg(
        F.sum("count").alias("nodes"), F.ceil(F.max("count") / (4 * PART)).cast("int").alias("parts")
    )
    large = materialise(many.where(F.col("nodes") > PART).select("family", "parts"), "large")
    # Families of one part have parts = 0.
    placed = placed.join(large, "family", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
    part = F.pmod(F.xxhash64("node", F.lit("part")), F.greatest("parts", F.lit(1)))
    wanted = materialise(placed.withColumn("part", part.cast("int")), "wanted")
    # A merge join at every size: what is wanted grows with the documents.
    # Rows without an id have one id, so the digest is part of the key: a wanted set meets its own text alone.
    texts = packed(rows.select("id", "digest", "text")).join(wanted.hint("merge"), ["id", "digest"])
    texts = texts.dropDuplicates(["id", "digest"])
    sets = materialise(_sketched(texts.drop("id", "digest"), words), "sets")

    meeting = ["family", "pair", "low", "high"]
    none = [F.lit(0).alias(c) for c in meeting[1:]]
    small = sets.where("parts = 0").select("family", *none, "packed")
    met = (
        sets.where("parts > 0")
        .withColumn("pair", F.explode(F.array("band", F.col("band") + 1)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
        .select(*meeting, "node", "part", "size", "sketch")
    )
    near = met.groupBy(*meeting).applyInArrow(_near(share), "family long, pair int, low int, high int, node long")
    near = materialise(near.distinct(), "near_sets")
    near = near.join(sets.where("parts > 0").select("node", "packed"), "node").select(*meeting, "packed")
    links = small.union(near).groupBy(*meeting).applyInArrow(_links(words, share), "a long, b long")
    groups = components(materialise(links.distinct(), "links"))

    rooted = standing.drop("size").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialise(rooted, "rooted")
    least = materialise(rooted.groupBy("root").agg(first).select("root", "first.*"), "least")
    return classes, materialise(rooted.select("node", "root").join(least, "root").drop("root"), "of_node")


def jaccard_groups(
    docs: DataFrame, words: int = 3, share: int = 90, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of `docs` (doc_id, text).

    Two documents are linked if the intersection of their sets of `words`-word shingles (A-Z lower-cased)
    has at least `share` percent of the union. component_id is the least doc_id that a chain of links
    reaches, the own included. With fewer words the whole sequence is the one element; a document without
    words (null, empty) has no element and no link, and its component is itself.

    Rows with null ids take part and get the least id of their group, null if there is none. Repeated rows
    are in one group. Empty table: empty result. Sets are told apart by 64-bit hashes.
    """
    classes, of_node = _grouped(docs.select("text", *_keys()), words, share, block_bytes)
    of_node = of_node.select("node", F.col("id").alias("least"))
    known = lambda c: F.when(F.col(c) != F.lit(_LAST), F.col(c))
    return classes.join(of_node, "node", "left").select(
        known("id").alias("doc_id"),
        F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, known("least")).otherwise(known("id")).alias("component_id"),
    )


def copies(docs: DataFrame, words: int, share: int) -> DataFrame:
    """id, digest and near_copy of the rows of `docs` (doc_id, text) that are linked to a row that stays,
    by their `row_key`, each once.

    Of each group the least key stays. near_copy: the key isn't that one, so its rows go. Else several
    rows have that key, and one of them is to stay. Rows without words have no link; those of one key
    with an id are repeated rows, those without an id all stay.
    """
    classes, of_node = _grouped(docs.select("text", *_keys()), words, share)
    of_node = of_node.select("node", F.struct("id", "digest").alias("least"))
    keys = classes.groupBy("id", "digest", "node", "size").count().join(of_node, "node", "left")
    near = (F.col("size") > 0) & (F.struct("id", "digest") != F.col("least"))
    repeated = (F.col("count") > 1) & ((F.col("size") > 0) | (F.col("id") != F.lit(_LAST)))
    return keys.withColumn("near_copy", near).where(F.col("near_copy") | repeated).select("id", "digest", "near_copy")


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
