"""Benchmark decontamination by templates.

Texts become templates: numbers and units turn into typed placeholders, and in one of two forms also
names (words with a capital). Windows of template words are joined by hash, so a question is found
again with other numbers, units or names put into it. A match counts if its slots are consistent: a
value of the item stands for one value in the document throughout, and two names never become one.

Phrases that many items share ("read the following question and ...") say nothing about one item, so a window
finds an item only if it is the item's own, held by few other items. An item without any such window has
to stand in the document as a whole. Items that differ only in their slots count as one here.

The other form keeps all words but folds case, so a copy in capitals or small letters is found, too.

Windows with few plain words (sums, tables, dates) say little as templates. They, and items of under
SHORTEST_ITEM words as a whole, are matched exactly instead: words folded, slots with their values, operators
between them. In scripts without blanks each character is a word, matched exactly as well, in windows of
CHARACTERS.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.llm.words import REMEMBERED, stretches, whole_windows, windows
from askgrid.session import materialise

WINDOW = 8
#: Least share of a window's words that are neither number, unit nor name.
LITERAL = 0.6
#: Items of fewer words are matched exactly only.
SHORTEST_ITEM = 4
#: Window of texts in scripts without blanks.
CHARACTERS = 24
#: Windows of the benchmark up to which their hashes go to all tasks (8 bytes each).
BROADCAST_WINDOWS = 1_000_000
#: Different items up to which a window counts as an item's own.
OWN_ITEMS = 8

# Words read as numbers and as units.
_NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion dozen".split()
)
_UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms "
    "ounce ounces pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons cup cups "
    "second seconds sec minute minutes min hour hours hr hrs day days week weeks month months year "
    "years cent cents dollar dollars euro euros usd eur gbp percent % degree degrees celsius "
    "fahrenheit mph kmh km/h m/s watt watts kw kwh volt volts hz".split()
)
_NUMBER = re.compile(
    r"([$€£¥]?)[+-]?(?:\d[\d.,:/]*\d|\d)(?:st|nd|rd|th)?(%|[a-zA-Z°/]{1,9})?"
)
_EDGES = " \t\n\r\v\f.,;:!?\"'()[]{}<>|*#&`~_=…“”‘’«»¿¡-–—/\\^@$%+。、，．；：？！（）「」『』【】《》〈〉・～"
_AROUND = " .,;:!?\"'()[]{}<>|*#"
_OPERATORS = frozenset("+-*/=^<>~")
# Han, kana, bopomofo, Thai, Lao, Tibetan, Burmese, Khmer.
_BLANKLESS = (
    "\u2e80-\u2fdf\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
    "\uff66-\uff9f\U00020000-\U0003ffff\u0e01-\u0e3e\u0e40-\u0fff\u1000-\u109f\u1780-\u17ff"
)
_HAS_BLANKLESS = re.compile(f"[{_BLANKLESS}]")
_PIECES = re.compile(f"[{_BLANKLESS}]|[^{_BLANKLESS}]+")
#: Forms of a window: two of templates, and exact words without and with characters of such scripts.
_TEMPLATES, _EXACT, _BY_CHARACTER = (0, 1), 2, 3
_NUM, _UNIT, _NAME = "<number>", "<unit>", "<name>"
_NAME_HASH = xxhash.xxh3_64_intdigest(_NAME)


def both_templates(word: str) -> tuple[str, str]:
    """The templates of one word: with names as slots, and with names as words.

    Both are empty if the word is only punctuation.
    """
    bare = word.strip(_EDGES)
    if not bare.isalpha():
        number = _NUMBER.fullmatch(word.strip(_AROUND))
        if number and (not number[2] or number[2] == "%" or number[2].lower() in _UNITS):
            shape = _NUM + _UNIT if number[1] or number[2] else _NUM
            return shape, shape
        if not bare:
            return (_UNIT, _UNIT) if word.strip(_AROUND) == "%" else ("", "")
    low = bare.lower()
    if low in _NUMBERS:
        return _NUM, _NUM
    if low in _UNITS and len(low) > 1:
        return _UNIT, _UNIT
    return (_NAME if bare[0].isupper() else low), low


def cut_words(text: str | None) -> list[str]:
    """What stands between blanks; characters of scripts without blanks each by itself."""
    words = (text or "").split()
    if text is None or text.isascii() or not _HAS_BLANKLESS.search(text):
        return words
    return [piece for word in words for piece in _PIECES.findall(word)]


def exact_word(word: str) -> str:
    """The word with case folded, without what stands around it; empty if both its templates are."""
    shape = both_templates(word)[1]
    return (word.strip(_AROUND).lower() or shape) if shape[:1] == "<" else shape


def _hashed(word: str) -> tuple[tuple[int, int, int], int]:
    """Hashes of both templates (0: left out) and of the exact word, and which are literals (see `_Templates`)."""
    digest = xxhash.xxh3_64_intdigest
    blankless = 0 if word.isascii() else 8 * (_HAS_BLANKLESS.match(word) is not None)
    bare = word.strip(_EDGES)
    if bare.isalpha():
        low = bare.lower()
        if low not in _NUMBERS and low not in _UNITS and low.isalpha():  # nearly all words: one hash serves
            same = digest(low)
            if bare[0].isupper():
                return (_NAME_HASH, same, same), 6 + blankless
            return (same, same, same), 7 + blankless
    one, other = both_templates(word)
    folded = other if word == word.lower() else both_templates(word.lower())[1]
    shapes = (one, other, exact_word(word))
    literal = (one[:1] != "<") + 2 * (other[:1] != "<") + 4 * (folded[:1] != "<")
    return tuple(digest(x) if x else 0 for x in shapes), literal + blankless


class _Templates:
    """Hashes of words by both templates (0: left out) and exactly, and whether they are literals (bit per
    template, a third for the folded word, a fourth for characters of scripts without blanks)."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.hashes, self.literal = np.zeros((0, 3), np.uint64), np.zeros(0, np.int64)

    def of(self, words: list[str]) -> np.ndarray:
        """Places of the words in `hashes` and `literal`."""
        if len(self.place) > REMEMBERED:
            self.__init__()
        new = list(set(words).difference(self.place))
        if new:
            hashes, literal = zip(*map(_hashed, new), strict=True)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            flat = np.fromiter(chain.from_iterable(hashes), np.uint64, 3 * len(new))
            self.hashes = np.concatenate([self.hashes, flat.reshape(-1, 3)])
            self.literal = np.concatenate([self.literal, np.fromiter(literal, np.int64, len(new))])
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))


class _Wanted:
    """Membership in a sorted array of hashes; a bitmap rules out nearly all others first."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.mask = hashes, np.uint64((1 << max(16, (8 * len(hashes)).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[hashes & self.mask] = True

    def among(self, found: np.ndarray) -> np.ndarray:
        take = self.bits[found & self.mask]
        maybe = np.flatnonzero(take)
        at = np.minimum(np.searchsorted(self.hashes, found[maybe]), max(0, len(self.hashes) - 1))
        take[maybe] = self.hashes[at] == found[maybe] if len(self.hashes) else False
        return take


_COLUMNS = ["key", "form", "length", "n_words", "hash", "template", "start", "slots"]
_SCHEMA = (
    "key {key}, form int, length int, n_words int, hash long, template string, start int, "
    "slots array<string>"
)


def _emit(
    keys: list, texts: list, kinds: list[tuple[int, int]], wanted: _Wanted | None, known: _Templates
) -> list:
    """Windows of the texts, of each kind (form, length), all of them or those whose hash is `wanted`."""
    cut = [cut_words(text) for text in texts]
    words = list(chain.from_iterable(cut))
    places = known.of(words)
    kept = np.flatnonzero(known.hashes[places, 0])
    owner = np.repeat(np.arange(len(cut)), [len(each) for each in cut])[kept]
    counts = np.bincount(owner, minlength=len(cut))
    starts = np.cumsum(counts) - counts
    places, rows = places[kept], []
    literal = known.literal[places]
    sums = [np.concatenate([[0], np.cumsum((literal >> bit) & 1)]) for bit in range(4)]
    for form, length in kinds:
        if len(places) < length:
            continue
        inside = lambda bit: sums[bit][length:] - sums[bit][:-length]  # noqa: B023, E731
        if form == _BY_CHARACTER:
            take = inside(3) > 0
        elif form == _EXACT:
            take = inside(3) == 0
            if length >= SHORTEST_ITEM:
                take &= inside(2) < LITERAL * length
        else:
            take = (inside(form) >= LITERAL * length) & (inside(3) == 0)
        if not take.any():
            continue
        take &= whole_windows(starts, counts, length)
        found = windows(known.hashes[places, min(form, _EXACT)], length, salt=form)
        if wanted is not None:
            take &= wanted.among(found)
        # Of items that are one window as a whole the first place in a text is enough.
        once = length < (CHARACTERS if form == _BY_CHARACTER else WINDOW) and form not in _TEMPLATES
        met = set()
        for i in np.flatnonzero(take).tolist():
            doc = int(owner[i])
            if form in _TEMPLATES:
                here = [words[j] for j in kept[i : i + length].tolist()]
                shapes = [both_templates(w)[form] for w in here]
                slots = [_slot(w, s) for w, s in zip(here, shapes, strict=True) if s[:1] == "<"]
            else:
                here = words[int(kept[i]) : int(kept[i + length - 1]) + 1]
                shapes = [x for x in ((exact_word(w) or _operators(w)) for w in here) if x]
                slots = []
            template = " ".join(shapes)
            if once and (doc, template) in met:
                continue
            if once:
                met.add((doc, template))
            hash_ = int(found[i : i + 1].view(np.int64)[0])
            rows.append((keys[doc], form, length, int(counts[doc]), hash_, template, int(i - starts[doc]), slots))
    return rows


def _operators(word: str) -> str:
    """The operators in a word that is only punctuation."""
    return "".join([c for c in word if c in _OPERATORS])


def _slot(word: str, shape: str) -> str:
    """A slot's value with its type in front."""
    return f"{shape}{word.strip(_EDGES).lower()}"


def template_windows(
    df: DataFrame, key: str, kinds: list[tuple[int, int]], wanted: np.ndarray | None = None
) -> DataFrame:
    """Windows of the texts in `df` (`key`, text) of `kinds` (form, length): key, form, length, template,
    start, slots.

    `wanted`: sorted hashes; only windows with one of them are returned. Its size is for the caller to
    bound. Null and empty texts have no windows.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = None if wanted is None else df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Templates()
        asked = None if shared is None else _Wanted(shared.value)
        for whole in batches:
            types = [whole.schema.types[0], pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            types += [pa.int32(), pa.list_(pa.string())]
            for batch in stretches(whole, "text", 1 << 20):
                rows = _emit(batch.column(0).to_pylist(), batch.column(1).to_pylist(), kinds, asked, known)
                columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * len(_COLUMNS)
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, _COLUMNS)

    return df.select(key, "text").mapInArrow(run, _SCHEMA.format(key=kind))


def _item_windows(benchmark: DataFrame, own_items: int) -> DataFrame:
    """Windows that the benchmark's items are found by: those that at most `own_items` different items hold.
    An item that has none, or is shorter than a window, is one window as a whole."""
    kinds = [(form, n) for form in _TEMPLATES for n in range(SHORTEST_ITEM, WINDOW + 1)]
    kinds += [(_EXACT, n) for n in range(1, WINDOW + 1)] + [(_BY_CHARACTER, n) for n in range(1, CHARACTERS + 1)]
    every = template_windows(benchmark, "item_id", kinds)
    most = F.when(F.col("form") == _BY_CHARACTER, CHARACTERS).otherwise(WINDOW)
    whole = (F.col("length") == most) | (F.col("length") == F.col("n_words"))
    found = materialise(every.where(whole), "item_windows")
    # Items whose windows are all the same in a form are one kind of item in it.
    sequence = F.xxhash64(F.sort_array(F.collect_list(F.struct("start", "hash")))).alias("item")
    items = found.groupBy("key", "form", "length").agg(sequence)
    window = ["form", "length", "hash", "template"]
    holders = found.join(items, ["key", "form", "length"]).groupBy(*window).agg(F.count_distinct("item").alias("items"))
    common = holders.where(F.col("items") > own_items).drop("items")
    own = materialise(found.join(common, window, "left_anti"), "own_windows")
    rest = materialise(found.join(own.select("key"), "key", "left_anti").select("key", "n_words").distinct(), "common_items")
    lengths = [r["n_words"] for r in rest.select("n_words").distinct().collect()]
    if lengths:
        texts = benchmark.join(rest.select(F.col("key").alias("item_id")).distinct(), "item_id", "left_semi")
        forms = (*_TEMPLATES, _EXACT, _BY_CHARACTER)
        entire = template_windows(texts, "item_id", [(form, n) for form in forms for n in sorted(lengths)])
        own = own.unionByName(materialise(entire.where("length = n_words"), "whole_items").select(*own.columns))
    named = own.withColumnsRenamed({"key": "item_id", "start": "item_start", "slots": "item_slots"})
    return named.drop("n_words")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    broadcast_windows: int = BROADCAST_WINDOWS,
    own_items: int = OWN_ITEMS,
) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other numbers, units or names.

    One row per document and item: `key`, item_id, n_windows, first_word, last_word (places among the
    document's words without those that are only punctuation) and n_changed, the number of slots
    with another value than in the item. Only `key` and text of `docs`, item_id and text of
    `benchmark` are read.

    An item is found by any WINDOW consecutive words of it that at most `own_items` different items have (an
    item without such words, and a shorter item, by all its words); n_windows counts these alone. If a share of
    LITERAL of them are plain words, numbers, units and names may differ; else, and if the item has under
    SHORTEST_ITEM words, only case and punctuation around words may. Characters of scripts without blanks
    are words; CHARACTERS of them, or all words of a shorter item, must be the same. Rows with the same key count
    as one document, null keys as one, too. Null and empty texts match nothing; repeated items count
    once each by item_id. An empty table on either side gives an empty result.

    If the benchmark has up to `broadcast_windows` windows, tasks pass on only windows with one of
    their hashes; beyond that all windows of the documents are shuffled to the join.
    """
    items = _item_windows(benchmark, own_items)
    kinds = sorted((r["form"], r["length"]) for r in items.select("form", "length").distinct().collect())
    wanted = None
    if items.count() <= broadcast_windows:
        hashes = [r["hash"] for r in items.select("hash").distinct().collect()]
        wanted = np.sort(np.array(hashes, np.int64).view(np.uint64))
    found = template_windows(docs, key, kinds, wanted).drop("n_words")
    if wanted is not None:
        found = materialise(found, "windows")
    met = found.join(items, ["hash", "form", "length", "template"]).withColumn(
        "offset", F.col("start") - F.col("item_start")
    )
    # A run is one stretch of a document laid beside one item; it has as many windows as the item.
    run = ["key", "item_id", "form", "length", "offset"]
    pairs = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("item_slots", "slots"))))
    runs = met.groupBy(*run).agg(
        F.size(F.collect_set("start")).alias("n_windows"),
        F.min("start").alias("first_word"),
        (F.max("start") + F.col("length") - 1).alias("last_word"),
        pairs.alias("pairs"),
    )
    values = F.array_distinct(F.transform("pairs", lambda p: p["item_slots"]))
    names = F.filter("pairs", lambda p: p["slots"].startswith(_NAME))
    renamed = F.array_distinct(F.transform(names, lambda p: p["slots"]))
    consistent = runs.where(
        (F.size(values) == F.size("pairs")) & (F.size(renamed) == F.size(names))
    ).withColumn("n_changed", F.size(F.filter("pairs", lambda p: p["item_slots"] != p["slots"])))
    best = F.max_by(
        F.struct("n_windows", "first_word", "last_word", "n_changed"),
        F.struct("n_windows", -F.col("n_changed"), -F.col("first_word")),
    )
    leaks = consistent.groupBy("key", "item_id").agg(best.alias("best"))
    return leaks.select(F.col("key").alias(key), "item_id", "best.*")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents with benchmark items in them: doc_id, item_id, n_windows, first_word, last_word, n_changed."""
    return find_leaks(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
