"""Byte-level BPE over padded numpy matrices.

A text is cut into pieces by the vocabulary's pattern, and each piece is encoded by itself. The
distinct pieces of a task are put, by length, into padded matrices of token ids. Each round, every
row merges its leftmost pair of least rank; pairs are looked up in an open-addressing hash table.
Rows without a pair left are taken out, and the matrix gets one column narrower.

Vocabularies are files of `base64(token) rank` lines; a token's id is its rank. They are read on the
driver and broadcast: their size is that of the file (some 50,000 entries), whatever the input's.
Nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.llm.words import stretches

#: No pair: above any rank.
NONE = np.int32(2**31 - 1)
#: Upper lengths of the matrices; longer pieces go through a heap instead, in n log n.
LENGTHS = (2, 4, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256)
CELLS = 1 << 20
#: Distinct words whose ids a task keeps.
REMEMBERED = 75_000
#: Bytes of text that a task encodes at a time.
STRETCH = 1 << 20
_CHUNKS = r"\s*\S+|\s+"
#: White space to Python's `re`, but not to the patterns of vocabularies.
_SEPARATORS = r"[\x1c-\x1f]"


@dataclass
class Vocabulary:
    """Tokens by rank, ranks by token, and a hash table from pairs of ids to the id of both joined."""

    pattern: str
    tokens: list[bytes]
    ranks: dict[bytes, int]
    keys: np.ndarray
    values: np.ndarray
    probes: int
    bytes_: np.ndarray

    @staticmethod
    def read(path: str, pattern: str) -> Vocabulary:
        ranks = {}
        for line in Path(path).read_bytes().splitlines():
            if line:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        return Vocabulary.of(ranks, pattern)

    @staticmethod
    def of(ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        pairs = [
            ((ranks[t[:i]] << 32) | ranks[t[i:]], rank)
            for t, rank in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        size = 1 << max(4, (4 * len(pairs)).bit_length())
        keys, values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        left = np.array([p[0] for p in pairs], np.int64).reshape(-1)
        found = np.array([p[1] for p in pairs], np.int32).reshape(-1)
        at, probes = _slot(left, size), 0
        while len(left):  # of the pairs that want a free slot, one gets it; the others go on
            probes += 1
            slots, first = np.unique(at, return_index=True)
            first = first[keys[slots] == -1]
            keys[at[first]], values[at[first]] = left[first], found[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, found, at = left[rest], found[rest], (at[rest] + 1) & (size - 1)
        single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        return Vocabulary(pattern, tokens, ranks, keys, values, max(1, probes), single)

    def joined(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Ids of the joined pairs, `NONE` where there is none (or an id is padding, -1)."""
        want = (one.astype(np.int64) << 32) | other.astype(np.int64)
        want = np.where((one < 0) | (other < 0), np.int64(-2), want)
        at = _slot(want, len(self.keys))
        result = np.full(want.shape, NONE, np.int32)
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == want
            result[hit] = self.values[at[hit]]
            if not (~hit & (there != -1)).any():
                break
            at = (at + 1) & (len(self.keys) - 1)
        return result


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def _encode_matrix(
    pieces: list[bytes], width: int, vocabulary: Vocabulary
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each piece, padded, and their number; all have at most `width` bytes."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    inside = np.arange(width) < lengths[:, None]
    ids = np.full((len(pieces), width), -1, np.int32)
    ids[inside] = vocabulary.bytes_[np.frombuffer(b"".join(pieces), np.uint8)]
    pairs = vocabulary.joined(ids[:, :-1], ids[:, 1:])
    rows, result, counts = np.arange(len(pieces)), ids.copy(), lengths.copy()
    while len(rows) and pairs.shape[1]:
        best = pairs.argmin(axis=1)
        rank = pairs[np.arange(len(rows)), best]
        over = rank == NONE
        if over.any():
            done, going = rows[over], ~over
            result[done, : ids.shape[1]] = ids[over]
            counts[done] = lengths[over]
            rows, ids, pairs, lengths = rows[going], ids[going], pairs[going], lengths[going]
            best, rank = best[going], rank[going]
            if not len(rows):
                break
    # Merge: one column less, and only the pairs beside the merged token are looked up again.
        here, width = np.arange(len(rows)), ids.shape[1] - 1
        columns = np.arange(width)
        ids = np.take_along_axis(ids, columns + (columns > best[:, None]), axis=1)
        ids[here, best] = rank
        lengths = lengths - 1
        columns = np.arange(max(width - 1, 0))
        pairs = np.take_along_axis(pairs, columns + (columns >= best[:, None]), axis=1)
        right = best < width - 1
        pairs[here[right], best[right]] = vocabulary.joined(
            ids[here[right], best[right]], ids[here[right], best[right] + 1]
        )
        left = best > 0
        pairs[here[left], best[left] - 1] = vocabulary.joined(
            ids[here[left], best[left] - 1], ids[here[left], best[left]]
        )
    result[rows, : ids.shape[1]], counts[rows] = ids, lengths
    return result, counts


def _encode_long(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """The same merges for a very long piece, with the pairs in a heap instead of in rows."""
    tokens, ranks = vocabulary.tokens, vocabulary.ranks
    ids = [ranks[bytes([b])] for b in piece]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(ids):
            rank = ranks.get(tokens[ids[i]] + tokens[ids[after[i]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[after[i]]))

    for i in range(len(ids)):
        offer(i)
    while heap:
        rank, i, one, other = heapq.heappop(heap)
        if ids[i] != one or after[i] >= len(ids) or ids[after[i]] != other:
            continue  # one of the two was merged meanwhile
        gone = after[i]
        ids[i], ids[gone] = rank, -1
        after[i] = after[gone]
        if after[i] < len(ids):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [x for x in ids if x >= 0]


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after the other, and how many each has."""
    whole = np.fromiter((vocabulary.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    counts, found = np.ones(len(pieces), np.int64), [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
    for i in np.flatnonzero((whole < 0) & (lengths > LENGTHS[-1])).tolist():
        ids = np.array(_encode_long(pieces[i], vocabulary), np.int32)
        counts[i] = len(ids)
        found.append((np.array([i]), ids))
    shorter = 0
    for width in LENGTHS:
        members = np.flatnonzero((whole < 0) & (lengths > shorter) & (lengths <= width))
        shorter, rows = width, max(1, CELLS // width)
        for start in range(0, len(members), rows):
            part = members[start : start + rows]
            ids, number = _encode_matrix([pieces[i] for i in part.tolist()], width, vocabulary)
            counts[part] = number
            found.append((part, ids[np.arange(width) < number[:, None]]))
    starts = np.cumsum(counts) - counts
    flat = np.empty(int(counts.sum()), np.int32)
    for members, ids in found:
        flat[_spans(starts[members], counts[members])] = ids
    return flat, counts


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of all spans, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class Spans:
    """Ids of strings, kept in one flat array."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def add(self, names: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.place.update(zip(names, range(len(self.place), len(self.place) + len(names)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])

    def take(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all names, one after the other, and how many each has."""
        which = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))
        return self.ids[_spans(self.starts[which], self.counts[which])], self.counts[which]


class Encoder:
    """Encodes texts; keeps the ids of words seen before, up to a number of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(vocabulary.pattern)
        self.chunks = re.compile(_CHUNKS)
        self.odd = re.compile(_SEPARATORS)
        self.forget()

    def forget(self) -> None:
        self.words, self.parts = Spans(), Spans()

    def _learn(self, words: list[str]) -> None:
        """Encode words not seen yet: each distinct piece once."""
        cut = [self.pieces.findall(w) for w in words]
        pieces = list(chain.from_iterable(cut))
        new = list(set(pieces).difference(self.parts.place))
        self.parts.add(new, *encode_pieces([p.encode("utf-8", "surrogatepass") for p in new], self.vocabulary))
        ids, counts = self.parts.take(pieces)
        per_word = np.cumsum([0, *map(len, cut)])
        self.words.add(words, ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[per_word]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids end (from 0)."""
        if len(self.words.place) > REMEMBERED:
            self.forget()
        # A piece never goes from a non-blank to a blank, so what follows can be cut off there.
        cut = [self.chunks.findall(t) if not self.odd.search(t) else [t] for t in texts]
        words = list(chain.from_iterable(cut))
        new = list(set(words).difference(self.words.place))
        if new:
            self._learn(new)
        ids, counts = self.words.take(words)
        per_text = np.cumsum([0, *map(len, cut)])
        return ids, np.concatenate([[0], np.cumsum(counts)])[per_text]


def _with_ids(batch: pa.RecordBatch, column: str, to: str, encoder: Encoder) -> pa.RecordBatch:
    """`batch` with the ids of its texts."""
    ids, ends = encoder.encode([t or "" for t in batch.column(column).to_pylist()])
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
    return pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, to])


def _with_bytes(batch: pa.RecordBatch, column: str, to: str, tokens: list[bytes]) -> pa.RecordBatch:
    """`batch` with the bytes that its ids stand for."""
    lists, texts = batch.column(column), []
    for row in range(len(lists)):
        ids = lists[row].values
        ids = [] if ids is None else ids.to_numpy().tolist()
        if ids and min(ids) < 0:
            raise ValueError("a token id is negative")
        texts.append(b"".join([tokens[i] for i in ids]))
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, to])


def _ids(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType()))


def encode(df: DataFrame, vocabulary: Vocabulary, column: str = "text", to: str = "ids") -> DataFrame:
    """Add the ids of the whole text in `column` as array<int> `to`, without special tokens.

    Null and empty texts have no ids (an empty array). Other columns pass through as they are; a
    column that is called like `to` is replaced. Empty table: empty result.
    """
    kept = df.drop(to)
    shared = df.sparkSession.sparkContext.broadcast(vars(vocabulary))  # executors may lack the class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(**shared.value))
        for whole in batches:
            for batch in stretches(whole, column, STRETCH):
                yield _with_ids(batch, column, to, encoder)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, _ids(to)]))


def decode(df: DataFrame, vocabulary: Vocabulary, column: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the bytes that the ids in `column` stand for as binary `to`; null ids give no bytes.

    Other columns pass through as they are; a column that is called like `to` is replaced. An id
    outside the vocabulary fails the job.
    """
    kept = df.drop(to)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _with_bytes(batch, column, to, shared.value)

    schema = T.StructType([*kept.schema.fields, T.StructField(to, T.BinaryType())])
    return kept.mapInArrow(run, schema)


def there_and_back(
    df: DataFrame, vocabulary: Vocabulary, column: str = "text", ids: str = "ids", to: str = "decoded"
) -> DataFrame:
    """`decode` of `encode`, in one Python worker per task and with one vocabulary in it.

    The ids are those that `encode` gives, the bytes are looked up from them alone.
    """
    kept = df.drop(ids, to)
    shared = df.sparkSession.sparkContext.broadcast(vars(vocabulary))  # executors may lack the class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(**shared.value))
        for whole in batches:
            for batch in stretches(whole, column, STRETCH):
                encoded = _with_ids(batch, column, ids, encoder)
                yield _with_bytes(encoded, ids, to, encoder.vocabulary.tokens)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, _ids(ids), T.StructField(to, T.BinaryType())]))


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> Vocabulary:
    """A vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return Vocabulary.read(public_tokenizers.path(name), public_tokenizers.PATTERN)


def tokenize_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document's whole text."""
    return there_and_back(docs.select("doc_id", "text"), vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return tokenize_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary())
