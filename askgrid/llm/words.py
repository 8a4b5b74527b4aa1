"""Words and word windows as 64-bit hashes, for whole batches of texts at a time."""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words whose hashes a task keeps.
REMEMBERED = 100_000



class WordHashes(dict):
    """Hash of each word, computed when first asked for."""

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: what stands between blanks and the controls \\t \\n \\v \\f \\r."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values (splitmix), as evenly spread in their low bits as in their high ones."""
    x = hashes.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of each window of `length` consecutive words, in the order of their starts."""
    count = max(0, len(hashes) - length + 1)
    total = np.full(count, np.uint64(salt) + np.uint64(length), np.uint64)
    for i in range(length):
        total = total * MULTIPLIER + hashes[i : i + count]
        total ^= total >> np.uint64(29)
    return mixed(total)


def whole_windows(starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Which windows over texts laid end to end stay within one text.

    `starts` are the places of the texts' first words and `counts` the numbers of their words.
    """
    total = int(counts.sum())
    inside = np.ones(max(0, total - length + 1), bool)
    for ahead in range(1, length):
        # a window that begins `ahead` words before a text's start crosses into it
        crossing = starts[1:] - ahead
        inside[crossing[(crossing >= 0) & (crossing < len(inside))]] = False
    return inside


def stretches(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of about `most` bytes of text, so that memory does not depend on how
    long the texts of a batch are (a single text is never cut)."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        held += int(size)
        if held >= most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)
