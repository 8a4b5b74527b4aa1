"""Text to vectors through a client that the caller supplies."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]

#: Texts whose counts are scaled at a time, and words whose places a client remembers.
_TEXTS_AT_A_TIME, _WORDS = 256, 1 << 17
_WORD = re.compile(r"[^\W_]+")
#: The bytes of Latin-1 in lower case, a blank for what belongs to no word.
_FOLDED = bytes(ord(c) if _WORD.fullmatch(c) else ord(" ") for c in bytes(range(256)).decode("latin-1").lower())


def _words(text: str) -> list:
    """The lower-case words of a text, as Latin-1 bytes if it has no other characters."""
    try:
        return text.encode("latin-1").translate(_FOLDED).split()
    except UnicodeEncodeError:
        return _WORD.findall(text.lower())


class _Places(dict):
    """The places of words, found as they are asked for."""

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, word) -> int:
        if len(self) >= _WORDS:
            self.clear()
        text = word.decode("latin-1") if isinstance(word, bytes) else word
        place = int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "big") % self.dimensions
        self[word] = place
        return place


def hashed_terms(dimensions: int = 64) -> Callable[[], Embedder]:
    """The offline embedder: counts of hashed words, scaled to unit length.

    A word's place is the first 8 hexadecimal digits of its MD5, modulo the dimensions.
    """

    def client() -> Embedder:
        place_of = _Places(dimensions).__getitem__

        def counts(text: str) -> np.ndarray:
            words = _words(text)
            return np.bincount(np.fromiter(map(place_of, words), np.int64, len(words)), minlength=dimensions)

        def embed(texts: Sequence[str]) -> np.ndarray:
            vectors = np.empty((len(texts), dimensions), np.float32)
            for start in range(0, len(texts), _TEXTS_AT_A_TIME):
                some = np.stack([counts(text or "") for text in texts[start : start + _TEXTS_AT_A_TIME]])
                length = np.sqrt((some.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
                vectors[start : start + len(some)] = some / np.where(length == 0, 1.0, length)
            return vectors

        return embed

    return client


def embed_text(
    df: DataFrame,
    column: str,
    output: str,
    embedder: Callable[[], Embedder] | None = None,
    concurrency: int | None = None,
) -> DataFrame:
    """Add the vector of a text column.

    `embedder` makes a client; each task makes one and uses it for all its Arrow batches.
    `concurrency` sets the number of partitions, and so of calls at a time.
    """
    make = embedder or hashed_terms()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for texts in batches:
            yield pd.Series(list(client(texts.tolist())))

    source = df if concurrency is None else df.repartition(concurrency)
    return source.withColumn(output, embed(F.col(column)))
