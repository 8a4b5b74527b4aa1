"""Spelling variant grouping: words that differ by a single edit, by dense prefix-suffix tiling.

Two different words are one inserted, deleted or replaced code point apart exactly if the length of their common
prefix plus that of their common suffix reaches the longer length minus one. Words are put as rows of padded
code-point matrices, once from the left and once from the right, and rows of two blocks are compared at once.

Only rows that can be near meet: of a longer length m, m - 1 code points are shared by prefix and suffix, so
either the front half or the back half is shared as a whole, and of the rest again one half. That gives
each word four keys for each of the two lengths that the longer word may have (`_keys`). Rows with one key
are a block; a block of more than `tile` rows is cut into tiles that meet pair by pair in different tasks. A
pair is taken under the first key that it shares, so it comes out once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.llm.words import stretches
from askgrid.session import materialise

#: Least code points and occurrences of a word; how many times as frequent a word's form is at least.
LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_FACTOR = 5
#: A run whose hash this divides loses a code point.
DAMAGED = 199
#: Rows of a tile, and rows that a task compares, on average.
TILE = 1024
TASK_ROWS = 1 << 16
#: Pairs that are compared at a time; words that a task counts before it passes them on; characters that are cut
#: into words at a time.
_PAIRS, _REMEMBERED, _CHARACTERS = 1 << 18, 100_000, 1 << 20

_LETTER = "a-zÀ-ÿ"


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about _CHARACTERS that end where no run of letters does."""
    if len(text) <= _CHARACTERS:
        yield text
        return
    gap = re.compile(f"[^{_LETTER}]")
    begin = 0
    while begin < len(text):
        found = gap.search(text, min(len(text), begin + _CHARACTERS))
        end = found.end() if found else len(text)
        yield text[begin:end]
        begin = end


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, damaged: int = DAMAGED) -> DataFrame:
    """word and n: how often each word of at least `least_length` code points occurs in `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"[{_LETTER}]{{{least_length},}}").findall
        counts: Counter = Counter()

        def held() -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for whole in batches:
            for batch in stretches(whole, "text", 1 << 20):
                for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    # bytes.lower() changes A-Z alone
                    lowered = (text or "").encode().lower().decode()
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for piece in _pieces(lowered):
                        for word, n in Counter(find(piece)).items():
                            hashed = zlib.crc32(word.encode(), start)
                            if hashed % damaged == 0:
                                at = hashed % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least_length:
                                    continue
                            counts[word] += n
                        if len(counts) >= _REMEMBERED:
                            yield held()
                            counts.clear()
        yield held()

    texts = docs.select(F.col("doc_id").cast("string").alias("id"), "text")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keys(word: Column) -> Column:
    """Of each key of a word: longest (the longer word's length), kind, and a hash of all three.

    Kinds, with a = longest // 2 and b = longest - a: a longer prefix than a; prefix a and a suffix; a longer
    suffix than b; suffix b and a prefix.
    """
    keys = []
    for more in (0, 1):
        longest = F.length(word) + more
        for kind in range(4):
            prefix, suffix = _lengths(longest, kind, lambda x: F.floor(x / 2))
            key = F.xxhash64(longest, F.lit(kind), F.substr(word, F.lit(1), prefix), F.right(word, suffix))
            keys.append(F.struct(longest.alias("longest"), F.lit(kind).alias("kind"), key.alias("key")))
    return F.array(*keys)


def _lengths(longest, kind: int, half):
    """Lengths of the prefix and the suffix that words with a common key of this kind share."""
    a = half(longest)
    if kind < 2:
        rest = longest - 1 - a
        more = half(rest + 1)
        return (a + more, longest * 0) if kind == 0 else (a, rest - more + 1)
    b = longest - a
    rest = longest - 1 - b
    more = half(rest + 1)
    return (longest * 0, b + more) if kind == 2 else (rest - more + 1, b)


def _blocks(words: DataFrame, tile: int) -> DataFrame:
    """A row for each word, key and tile pair: key, low, high (the tiles), part (1: the word is in the higher)."""
    keyed = words.select("word", "n", F.explode(_keys(F.col("word"))).alias("k")).select("word", "n", "k.*")
    large = keyed.groupBy("key").count().where(F.col("count") > tile)
    large = large.select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    tiles = F.coalesce("tiles", F.lit(1))
    own = F.pmod(F.xxhash64("word", "key"), tiles).cast("int")
    dealt = keyed.join(large, "key", "left").select(
        "word", "n", "longest", "kind", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")
    )
    return dealt.select(
        "word", "n", "longest", "kind", "key",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("part"),
    )


def _near(bucket: pa.Table) -> pa.Table:
    """Near words of one another among the rows of each key: word, near, near_n."""
    words = np.array(bucket["word"].to_pylist(), object)
    columns = {c: bucket[c].to_numpy() for c in ("n", "longest", "kind", "key", "low", "high", "part")}
    found = [(words[:0], words[:0], columns["n"][:0])]
    for longest in np.unique(columns["longest"]).tolist():
        here = np.flatnonzero(columns["longest"] == longest)
        order = np.lexsort([columns[c][here] for c in ("part", "high", "low", "key")])
        here = here[order]
        n, kind, key, low, high, part = (columns[c][here] for c in ("n", "kind", "key", "low", "high", "part"))
        text = words[here]
        left = np.array(text.tolist(), f"U{longest}").view(np.uint32).reshape(-1, longest)
        size = (left > 0).sum(1)
        right = np.array([w[::-1] for w in text], f"U{longest}").view(np.uint32).reshape(-1, longest)
        first, second = _pairs(key, low, high, part)
        for begin in range(0, len(first), _PAIRS):
            i, j = first[begin : begin + _PAIRS], second[begin : begin + _PAIRS]
            some = (size[i] == longest) | (size[j] == longest)
            i, j = i[some], j[some]
            prefix, suffix = _common(left, i, j), _common(right, i, j)
            near = (prefix < longest) & (prefix + suffix >= longest - 1)
            earliest = np.full(len(i), 4)
            for k in reversed(range(4)):
                shared = _lengths(longest, k, lambda x: x // 2)
                earliest[(prefix >= shared[0]) & (suffix >= shared[1])] = k
            near &= earliest == kind[i]
            i, j = i[near], j[near]
            found += [(text[i], text[j], n[j]), (text[j], text[i], n[i])]
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])


def _pairs(key: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (sorted by all four) that meet: within a tile each two, of two tiles each from either."""
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(key)))
    upper = np.add.reduceat(part, start)
    place = np.arange(len(key)) - np.repeat(start, size)
    own = np.repeat(low[start] == high[start], size)
    from_ = np.where(own, place + 1, np.repeat(size - upper, size))  # the first partner's place in the block
    many = np.where(part == 1, 0, np.repeat(size, size) - from_)
    one = np.repeat(np.arange(len(key)), many)
    step = np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many)
    return one, np.repeat(np.repeat(start, size) + from_, many) + step


def _common(matrix: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many code points the rows i and j of a padded matrix have in common from its left side on."""
    other = matrix[i] != matrix[j]
    return np.where(other.any(1), other.argmax(1), matrix.shape[1])


def near_words(words: DataFrame, tile: int = TILE, task_rows: int = TASK_ROWS) -> DataFrame:
    """word, near and near_n for every word of `words` (word, n; each word once) and each of its near words."""
    tasks = max(1, -(-8 * words.count() // task_rows))
    blocks = _blocks(words, tile).withColumn("bucket", F.pmod(F.xxhash64("key", "low", "high"), F.lit(tasks)))
    return blocks.groupBy("bucket").applyInArrow(_near, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form (word, form), by following two steps at once each round."""
    roots = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        followed = roots.join(further, "root", "left")
        followed = followed.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        followed = materialise(followed, "roots")
        roots = followed.drop("moved")
        if followed.where("moved").isEmpty():
            return roots


def group_variants(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    factor: int = FORM_FACTOR,
    tile: int = TILE,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of `docs` (doc_id, text; other columns don't matter).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased and a code point less where the
    hash of id and run says so; those of at least `least_length` code points and `least_count` occurrences are kept.
    `form` is the most frequent near word (ties: the least in code-point order) if it is `factor` times as frequent
    (more than once) as the word, `root` the end of the chain of forms. `least_length` is at least 4.

    Null and empty texts have no words; of a row without an id the hash is that of ":" and the run. Repeated rows
    count each. A word without near words has n_near 0 and no form. Empty table: empty result.
    """
    words = materialise(count_words(docs, least_length).where(F.col("n") >= least_count), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words, tile, task_rows).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= factor * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word",
        F.when(enough, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    forms = materialise(forms, "forms")
    return forms.join(_roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
