"""LM scoring with a probabilistic suffix tree over words.

The root of the tree holds the smoothed distribution of single words. A context of one or two words
gets a state of its own if it is frequent, and if the words after it diverge significantly from what its
longest shorter state says (a G-test). Its distribution is smoothed towards that state: words that
follow it often have a probability of their own, all others keep the shorter state's, scaled so that the
sum is one. A text is scored word by word, each in the state of the longest context it stands in.

All of it grows with the corpus and nothing of it is in one place. The corpus is cut into blocks of documents
that ask buckets: first for the counts of their words, then for their runs of two words and for those of three. A run's
bucket is that of its context's last word, which sums the counts of all blocks and decides on the context's state; each block
gets back the numbers for its own entries, in the order in which it asked. A run of three words is asked for only if its first
two occur often enough for a context. A bucket keeps the runs of two words that it has summed for those of three, which meet
them there, so no block has to say what the shorter state says. Texts are cut into words and hashed once;
from then on a block is the numbers of its words, frequent ones first, and numbers for those that are frequent in the corpus
come back with their counts. Contexts of over PART occurrences are cut into parts by the next word; their sums, a few numbers
per PART tokens of the corpus, meet on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from askgrid.llm.blocks import block_count, packed, unpacked, with_block
from askgrid.llm.words import MULTIPLIER, WordHashes, mixed
from askgrid.session import materialise

#: Least occurrences of a context, and of a word in it: fewer say nothing in a G-test.
LEAST_CONTEXT, LEAST_PAIR = 16, 2
#: Least share of the corpus that they must have as well: none, so the tree grows with the corpus.
CONTEXT_SHARE, PAIR_SHARE = 0.0, 0.0
#: Occurrences of a context per part.
PART = 4 << 20
SMOOTHING = 4.0
BLOCK_BYTES = 8 << 20
CUT = 1 << 20
FOLDS, HELD_OUT = 7, 2
#: Stands for the end of a text. No word contains a blank.
END = xxhash.xxh3_64_intdigest(b" end")
#: Numbers of frequent words have at most so many bits, so two of them are one number.
WORD_BITS = 32
_SHIFT, _LOW = np.uint64(WORD_BITS), np.uint64((1 << WORD_BITS) - 1)


def held_out(doc_id: Column) -> Column:
    """Documents that the model does not learn from; one without an id is not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _tokens(texts: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z lower-cased), each followed by END; number per text.

    Words stand as objects for about CUT bytes of text at a time only."""
    found, counts, held, start = [np.zeros(0, np.uint64)], [], 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= CUT or i + 1 == len(texts):
            for words in [t.lower().split() for t in texts[start : i + 1]]:
                found.append(np.append(known.of(words), np.uint64(END)))
                counts.append(len(words) + 1)
            held, start = 0, i + 1
    return np.concatenate(found), np.array(counts, np.int64)


def _after(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token the hash of the one word and of the two words ahead of it in its text, and
    whether there are as many."""
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    one = np.roll(hashes, 1)
    two = joined(np.roll(hashes, 2), one)
    return one, place >= 1, two, place >= 2


def joined(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Hash of a word or context and the word after it."""
    return mixed(one * MULTIPLIER + other)


def _bytes(values: np.ndarray) -> bytes:
    """A column of values, first bytes first, compressed: most counts are small."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(planes)


def _values(column: pa.ChunkedArray, dtype: type) -> list[np.ndarray]:
    """The columns that `_bytes` has packed."""
    unpack = zstandard.ZstdDecompressor().decompress
    width = np.dtype(dtype).itemsize
    planes = [np.frombuffer(unpack(b), np.uint8).reshape(width, -1) for b in column.to_pylist()]
    return [np.ascontiguousarray(p.T).reshape(-1).view(dtype) for p in planes]


def _joined_values(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *_values(column, dtype)])


def _steps(rising: np.ndarray) -> bytes:
    """A rising column by its differences."""
    return _bytes(np.diff(rising, prepend=rising.dtype.type(0)))


def _risen(column: pa.ChunkedArray, dtype: type) -> list[np.ndarray]:
    """The columns that `_steps` has packed."""
    return [np.cumsum(x, dtype=dtype) for x in _values(column, dtype)]


def _dealt(word: np.ndarray, piece: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a piece of the contexts that end with a word."""
    return mixed(word + piece.astype(np.uint64) * MULTIPLIER) % np.uint64(buckets)


class _Members:
    """Places of hashes in a sorted array; a bitmap rules out nearly all others first."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.mask = np.uint64((1 << max(16, (8 * len(hashes)).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[hashes & self.mask] = True

    def find(self, wanted: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of `wanted` at the places `among` are members, and their places here."""
        if not len(self.hashes):
            return among[:0], among[:0]
        maybe = among[self.bits[wanted[among] & self.mask]]
        at = np.minimum(np.searchsorted(self.hashes, wanted[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == wanted[maybe]
        return maybe[hit], at[hit]


@dataclass
class Tree:
    """States by the hash of their context: log10 of the factor for words without a probability of
    their own; and by the hash of context and word, log10 of that probability."""

    tokens: int
    types: int
    states: list[tuple[np.ndarray, np.ndarray]]
    words: list[tuple[np.ndarray, np.ndarray]]

    @property
    def scale(self) -> float:
        return float(self.tokens + self.types + 1)


def _factors(seen, after, before, gain, freedom) -> np.ndarray:
    """Factor of the shorter state's chances in each context that diverges from it, NaN for others.

    Of the words with a chance of their own there: sums of their chances in the context and in the shorter state, of
    after * log(after / before), and their number.
    """
    rest_after, rest_before = 1 - after, 1 - before
    kept = (rest_after > 0) & (rest_before > 0)
    factor = np.divide(rest_after, rest_before, out=np.ones(len(seen)), where=kept)
    divergence = gain + rest_after * np.log(factor, out=np.zeros(len(seen)), where=kept)
    kept &= 2 * seen * divergence >= freedom + 4 * np.sqrt(2 * freedom) + 10
    return np.where(kept, factor, np.nan)


def _grown(runs: pa.Table, tokens: int, types: int) -> Tree:
    """The tree of a small table of runs (words, context, parent, word, count, total of the word, seen: that of the
    context) in one place."""
    tree = Tree(tokens, types, [], [])
    columns = {c: runs[c].to_numpy() for c in runs.column_names}
    for length in (2, 3):
        here = columns["words"] == length
        context, parent, word = (columns[c][here].astype(np.int64).view(np.uint64) for c in ("context", "parent", "word"))
        before = (columns["total"][here] + 1) / tree.scale
        if length == 3:  # what the state of the last word alone says, where there is one
            (states, factors), (pairs, chances) = tree.states[0], tree.words[0]
            at, state = _Members(states).find(parent, np.arange(len(parent)))
            before[at] *= 10 ** factors[state]
            hit, place = _Members(pairs).find(joined(parent[at], word[at]), np.arange(len(at)))
            before[at[hit]] = 10 ** chances[place]
        contexts, first, group = np.unique(context, return_index=True, return_inverse=True)
        seen = columns["seen"][here][first].astype(float)

        def over(values: np.ndarray, group: np.ndarray = group, most: int = len(contexts)) -> np.ndarray:
            return np.bincount(group, weights=values, minlength=most)

        after = (columns["count"][here] + SMOOTHING * before) / (seen[group] + SMOOTHING)
        gain = after * np.log(after / before)
        factor = _factors(seen, over(after), over(before), over(gain), over(np.ones(len(group))))
        kept = ~np.isnan(factor)
        own = kept[group]
        tree.states.append(_sorted(contexts[kept], np.log10(factor[kept])))
        tree.words.append(_sorted(joined(context[own], word[own]), np.log10(after[own])))
    return tree


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


def _scores(tree: Tree, logs: np.ndarray, hashes: np.ndarray, counts: np.ndarray, members: list) -> np.ndarray:
    """log10 probability of each token in the state of its longest context; `logs` are the root's."""
    one, has_one, two, has_two = _after(hashes, counts)
    result = logs
    for (states, words), context, has in zip(members, (one, two), (has_one, has_two), strict=False):
        at, state = states.find(context, np.flatnonzero(has))
        scored = result.copy()
        scored[at] = result[at] + states.values[state]
        keys = joined(context[at], hashes[at])
        hit, place = words.find(keys, np.arange(len(at)))
        scored[at[hit]] = words.values[place]
        result = scored
    return result


def _grouped(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of `keys` (from 0, at most `most`), rising: the first place of each; and for each place its
    value's number. Key and place are sorted as one number if they fit into 64 bits."""
    shift = len(keys).bit_length()
    if most.bit_length() + shift <= 64:
        both = np.sort(keys.astype(np.uint64) << np.uint64(shift) | np.arange(len(keys), dtype=np.uint64))
        order = both & np.uint64((1 << shift) - 1)
        both >>= np.uint64(shift)
        order, rising = order.view(np.int64), both
    else:
        order = np.argsort(keys, kind="stable")
        rising = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = rising[1:] != rising[:-1]
    number = np.cumsum(new, out=rising.view(np.int64))
    number -= 1
    place = np.empty(len(keys), np.int32 if len(keys) < 1 << 31 else np.int64)
    place[order] = number
    return order[new], place


class _Entries:
    """Distinct runs of a context and a word at the tokens `at`, in the order in which a block asks for them: by bucket,
    context and word. `context` and `word` are places at these tokens, `keys` and `words` their numbers by place.

    A context of two words has its last word's number in the high bits of its own; `wide` is in how many parts its last
    word is, None for contexts of one word."""

    def __init__(self, at, context, keys, word, words, seen, wide, buckets: int, part: int):
        parts = (1 + seen // part).astype(np.uint64)
        piece, of_context = np.zeros(len(keys), np.uint64), np.arange(len(keys))
        if (parts > 1).any():  # each part is a context by itself here
            piece = words[word] % parts
            many = int(piece.max()) + 1
            first, number = _grouped(context.astype(np.int64) * many + piece.astype(np.int64), len(keys) * many)
            piece, of_context, context = piece[first], context[first], number
        present = np.flatnonzero(np.bincount(context, minlength=len(of_context)))
        key, piece = keys[of_context[present]], piece[present]
        if wide is None:
            number = _dealt(key, piece, buckets)
        else:
            piece = mixed((key & _LOW) + piece * MULTIPLIER) % wide[of_context[present]].astype(np.uint64)
            number = _dealt(key >> _SHIFT, piece, buckets)
        order = np.lexsort((key, number))
        rank = np.zeros(len(of_context), np.int64)
        rank[present[order]] = np.arange(len(order))
        first, place = _grouped(rank[context] * len(words) + word, len(order) * len(words))
        of = rank[context[first]]
        #: For each token of `at` the place of its run; a token of each run; its values there.
        self.place, self.token = place, at[first]
        self.bucket, self.context, self.word = number[order][of], key[order][of], words[word[first]]
        #: Place of each run's context.
        self.of = of_context[context[first]]
        new = (self.bucket[1:] != self.bucket[:-1]) | (self.context[1:] != self.context[:-1])
        #: First run of each context in a bucket.
        self.starts = np.flatnonzero(np.append(np.ones(min(1, len(of)), bool), new))


#: Words of two-word runs are places in `known`, the words there with their `totals` in the corpus; `ahead` are the words
#: ahead of the last in contexts of two words; `unasked` says whether rare words follow a context in the block, too.
_ASKS = (
    "bucket long, block long, words binary, counts binary, contexts binary, ahead binary, sizes binary, seen binary, "
    "known binary, totals binary, unasked binary"
)
#: Replies to blocks; sums of contexts in parts (block PARTS); runs of two words for a bucket (block RUNS), whose columns
#: are the last ones.
_REPLIES = (
    "level int, block long, bucket long, counts binary, factors binary, tokens long, types long, "
    "contexts binary, sizes binary, seen binary, words binary, totals binary"
)
PARTS, RUNS = -1, -2
_RESULT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: The first asks, and the block itself for about CUT bytes of text in a row, in buckets under 0.
_FIRST = (
    "bucket long, block long, words binary, counts binary, ids array<{id}>, held binary, places binary, dealt binary"
)


def _first(buckets: int, shown: pa.DataType):
    """A row per bucket: the block's words there with their number in training texts (may be 0). And the block's texts
    as places of their words among all of the block, frequent ones first, and each word's bucket and their number."""

    def run(docs: pa.Table) -> pa.Table:
        block, held = docs["block"][0].as_py(), docs["held"].to_numpy().astype(bool)
        texts = unpacked(docs["packed"])
        hashes, counts = _tokens(texts, WordHashes())
        words, place, often = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        place, words = rank[place], words[order]
        bucket = words % np.uint64(buckets)
        dealt = _bytes(np.append(bucket, buckets).astype(np.uint32))
        learnt = np.bincount(place, weights=np.repeat(~held, counts), minlength=len(words)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        words, bucket, learnt = words[order], bucket[order], learnt[order]
        rows = [
            (int(bucket[s]), block, _bytes(words[s:e]), _bytes(learnt[s:e]), None, None, None, None)
            for s, e in _spans(bucket)
        ]
        ids, ends = docs["doc_id"].cast(shown).to_pylist(), np.append(0, np.cumsum(counts))
        cut = np.cumsum([len(t) for t in texts]) // CUT
        for number, (s, e) in enumerate(_spans(cut)):
            parts = _bytes(counts[s:e]), ids[s:e], _bytes(held[s:e]), _bytes(place[ends[s] : ends[e]])
            rows.append((-1 - number, block, None, *parts, None if number else dealt))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(shown), *[pa.binary()] * 3]
        columns = zip(zip(*rows, strict=True), types, strict=True)
        return pa.table([pa.array(list(c), t) for c, t in columns], _names(_FIRST))

    return run


def _spans(values: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of equal values."""
    starts = np.flatnonzero(np.append(np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))
    return list(zip(starts.tolist(), np.append(starts, len(values))[1:].tolist(), strict=True))


class _Block:
    """Tokens of a block of documents, and what the buckets have replied to it so far."""

    def __init__(self, docs: pa.Table, replies: pa.Table, model: dict):
        self.number, self.model, self.replies = docs["block"][0].as_py(), model, replies
        self.ids = pc.list_flatten(docs["ids"])
        self.held, self.counts = _joined_values(docs["held"], bool), _joined_values(docs["counts"], np.int64)
        self.place = _joined_values(docs["places"], np.int32)
        self.learnt = np.repeat(~self.held, self.counts)
        dealt = _joined_values(docs["dealt"].drop_null(), np.uint32).astype(np.uint64)
        bucket, buckets = dealt[:-1], dealt[-1]
        order = np.argsort(bucket, kind="stable")
        replied = self._replied(0, "counts", np.int64)
        self.of_word = counts = np.empty_like(replied)
        counts[order] = replied
        #: Numbers in the corpus of the words that occur often enough for a run, 0 for others.
        self.words = np.zeros(len(counts), np.uint64)
        often = order[replied >= LEAST_CONTEXT]
        self.words[often] = self._replied(0, "factors", np.uint64) * buckets + bucket[often] + np.uint64(1)
        self.logs = self.base
        #: Whether a token has as many words ahead of it in its text as a context has; the place of that context, its
        #: occurrences in training texts, and numbers by place.
        self.has = np.ones(len(self.place), bool)
        self.has[np.cumsum(self.counts) - self.counts] = False
        self.has_one = self.has
        self.context, self.keys = np.roll(self.place, 1), self.words
        self.of_context = counts[self.context]
        self.level = 1

    @property
    def seen(self) -> np.ndarray:
        """Occurrences of each token in training texts."""
        return self.of_word[self.place]

    @property
    def base(self) -> np.ndarray:
        """log10 probability of each token by the root."""
        return np.log10((self.of_word + 1) / self.model["scale"])[self.place]

    def _replied(self, level: int, column: str, dtype: type) -> np.ndarray:
        rows = self.replies.filter(pc.equal(self.replies["level"], level)).sort_by("bucket")
        return _joined_values(rows[column], dtype)

    def entries(self) -> _Entries:
        """Runs of one more word than those that are replied."""
        self.after = np.flatnonzero(self.has & (self.of_context >= self.model["least"]))
        self.at = at = self.after[(self.of_word >= LEAST_CONTEXT)[self.place[self.after]]]
        model, words, wide = self.model, (self.place[at], self.words), None
        if self.level > 1:
            wide = np.ones(len(self.keys), np.int64)
            wide[self.context[at]] = 1 + self.of_word[self.place[at - 1]] // model["part"]
        return _Entries(
            at, self.context[at], self.keys, *words, self.of_context[at], wide, model["buckets"], model["part"]
        )

    def grow(self, scored: bool = True) -> None:
        """Take in the runs of the next level, and unless `scored` is false the states."""
        level, runs = self.level, self.entries()
        number = self._replied(level, "counts", np.int64)
        if scored:
            self._score(runs, number)
        # The run that ends at a token is the next token's context.
        self.context = np.zeros(len(self.place) + 1, runs.place.dtype)
        self.context[self.at + 1] = runs.place
        self.of_context = np.zeros(len(self.place) + 1, np.int64)
        self.of_context[self.at + 1] = number[runs.place]
        self.context, self.of_context = self.context[:-1], self.of_context[:-1]
        self.keys = runs.word << _SHIFT | runs.context & _LOW
        self.has = self.has & np.roll(self.has_one, level)
        self.level += 1

    def _score(self, runs: _Entries, number: np.ndarray) -> None:
        """Score each token in the state of this level, where it has one."""
        level, before = self.level, 10 ** self.logs[runs.token]
        factors = self._replied(level, "factors", np.float64).copy()
        contexts = runs.context[runs.starts]
        hot, of_hot = self.model["hot"][level - 1]
        if len(hot):
            at = np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)
            factors = np.where(hot[at] == contexts, of_hot[at], factors)
        seen = self.of_context[runs.token]
        after = (number + SMOOTHING * before) / (seen + SMOOTHING)
        of = np.repeat(factors, np.diff(np.append(runs.starts, len(runs.word))))
        own = (number > 0) & ~np.isnan(of)
        state = np.full(len(self.keys), np.nan)
        state[runs.of] = np.log10(of)
        lower = state[self.context[self.after]]
        here = ~np.isnan(lower)
        self.logs[self.after[here]] += lower[here]
        del lower
        here = own[runs.place]
        chance = np.log10(after, out=np.zeros(len(after)), where=own)
        self.logs[self.at[here]] = chance[runs.place[here]]

    def asks(self) -> pa.Table:
        """A row per bucket: the block's runs there with their number in training texts (may be 0)."""
        runs = self.entries()
        of_word = self.of_word[self.place[runs.token]]
        unasked = np.zeros(len(self.keys), bool)
        unasked[self.context[self.after[(self.of_word < LEAST_CONTEXT)[self.place[self.after]]]]] = True
        count = np.bincount(runs.place, weights=self.learnt[self.at], minlength=len(runs.word)).astype(np.int64)
        rows = []
        for start, end in _spans(runs.bucket):
            begin = runs.starts[np.searchsorted(runs.starts, start) : np.searchsorted(runs.starts, end)]
            size, seen = np.diff(np.append(begin, end)), self.of_context[runs.token[begin]]
            words, contexts = runs.word[start:end], runs.context[begin]
            if self.level == 1:
                known, token, place = np.unique(words, return_index=True, return_inverse=True)
                words, contexts = _bytes(place.astype(np.uint64)), (_steps(contexts), None)
                known = _steps(known), _bytes(of_word[start:end][token])
            else:
                words, contexts = _bytes(words), (_steps(contexts >> _SHIFT), _bytes(contexts & _LOW))
                known = None, None
            row = [int(runs.bucket[start]), self.number, words, _bytes(count[start:end])]
            rows.append([*row, *contexts, _bytes(size), _bytes(seen), *known, _bytes(unasked[runs.of[begin]])])
        types = [pa.int64(), pa.int64(), *[pa.binary()] * 9]
        columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 11
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _names(_ASKS))


def _asked(level: int, model: dict):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(docs, replies, model)
        for _ in range(level - 1):
            block.grow(scored=False)
        return block.asks()

    return run


def _shorter(runs: pa.Table, hot: tuple[np.ndarray, np.ndarray], scale: float, context, word) -> np.ndarray:
    """Chances of words in the states of one word, by the runs of two words (`_kept`) that are all among `runs`."""
    sizes = _joined_values(runs["sizes"], np.int64)
    contexts = np.concatenate([np.zeros(0, np.uint64), *_risen(runs["contexts"], np.uint64)])
    state, found = _joined_values(runs["factors"], bool).copy(), np.isin(contexts, hot[0])
    state[found] = ~np.isnan(hot[1])[np.searchsorted(hot[0], contexts[found])]
    keys = np.repeat(contexts, sizes) << _SHIFT | _joined_values(runs["words"], np.uint64)
    order = np.argsort(keys)
    place = order[np.searchsorted(keys[order], context << _SHIFT | word)]
    of = np.repeat(np.arange(len(sizes)), sizes)[place]
    base = (_joined_values(runs["totals"], np.int64)[place] + 1) / scale
    seen = _joined_values(runs["seen"], np.int64)[of]
    after = (_joined_values(runs["counts"], np.int64)[place] + SMOOTHING * base) / (seen + SMOOTHING)
    return np.where(state[of], after, base)


def _kept(model: dict, bucket: int, contexts, seen, state, group, word, count, total) -> list[tuple]:
    """Rows of runs of two words for the buckets where contexts of two words end with the one that these have."""
    wide = 1 + seen // model["part"]
    chosen = [(bucket, wide == 1)] if (wide == 1).any() else []
    for i in np.flatnonzero(wide > 1):
        of = np.repeat(contexts[i], wide[i])
        chosen += [(int(b), np.arange(len(wide)) == i) for b in np.unique(_dealt(of, np.arange(wide[i]), model["buckets"]))]
    rows = []
    for to, those in chosen:
        here = those[group]
        sizes = np.bincount(group[here], minlength=len(those))[those]
        columns = [_steps(contexts[those]), *map(_bytes, (sizes, seen[those], word[here], total[here]))]
        rows.append((1, RUNS, to, _bytes(count[here]), _bytes(state[those]), 0, 0, *columns))
    return rows


def _answered(level: int, model: dict):
    """What a bucket replies to all blocks: for each word or run its number in the corpus (0 if too few), and for each
    context the factor of its state (1 if all that follows it in the block has a probability of its own); for words instead
    the ranks of those that occur often. The sums of a context in parts
    come in a row of block PARTS. Runs of two words come once more for buckets (block RUNS), which have them as `runs`
    when they reply for three words."""

    def reply(asks: pa.Table, runs: pa.Table | None = None) -> pa.Table:
        blocks, more, rows = asks["block"].to_pylist(), [], []
        bucket = asks["bucket"][0].as_py() if blocks else None
        words = _values(asks["words"], np.uint64)
        ends, factors = np.cumsum([len(w) for w in words])[:-1], [None] * len(words)
        count, total, place = _joined_values(asks["counts"], np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        tokens = types = 0
        if level == 0:
            _, place = np.unique(np.concatenate(words), return_inverse=True)
            total = np.bincount(place, weights=count).astype(np.int64)
            tokens, types = int(count.sum()), int((total > 0).sum())
            # Rank and bucket are a word's number in the whole corpus: fewer bytes than its hash, fewest for frequent words.
            rank = np.empty(len(total), np.uint64)
            rank[np.argsort(-total, kind="stable")] = np.arange(len(total), dtype=np.uint64)
            if int((total >= LEAST_CONTEXT).sum()) * model["buckets"] >> WORD_BITS:
                raise OverflowError(f"more than 2 ** {WORD_BITS} frequent words")
            often = total[place] >= LEAST_CONTEXT
            pairs = zip(np.split(rank[place], ends), np.split(often, ends), strict=True)
            factors = [_bytes(mine[known]) for mine, known in pairs]
        elif blocks:
            asked, of_word = _risen(asks["contexts"], np.uint64), None
            if level == 1:
                known, totals = _risen(asks["known"], np.uint64), _values(asks["totals"], np.int64)
                of_word = np.concatenate([t[w] for t, w in zip(totals, words, strict=True)])
                words = [k[w] for k, w in zip(known, words, strict=True)]
            else:
                ahead = _values(asks["ahead"], np.uint64)
                asked = [last << _SHIFT | first for last, first in zip(asked, ahead, strict=True)]
            word = np.concatenate(words)
            sizes = _joined_values(asks["sizes"], np.int64)
            numbers, of_asked = np.unique(np.concatenate(asked), return_inverse=True)
            of = np.repeat(of_asked, sizes)
            seen = np.repeat(_joined_values(asks["seen"], np.int64), sizes)
            _, first, place = np.unique(of.astype(np.uint64) << _SHIFT | word, return_index=True, return_inverse=True)
            total = np.bincount(place, weights=count).astype(np.int64)
            total[total < model["least_run"]] = 0
            own = first[total > 0]
            there, group = np.unique(of[own], return_inverse=True)
            contexts = numbers[there]
            if level == 1:
                before = (of_word[own] + 1) / model["scale"]
            else:
                before = _shorter(runs, model["hot"][0], model["scale"], numbers[of[own]] >> _SHIFT, word[own])
            after = (total[total > 0] + SMOOTHING * before) / (seen[own] + SMOOTHING)
            sums = [after, before, after * np.log(after / before), np.ones(len(own))]
            sums = [np.bincount(group, weights=x, minlength=len(contexts)) for x in sums]
            of_context = np.zeros(len(contexts), np.int64)
            of_context[group] = seen[own]
            factor = _factors(of_context.astype(float), *sums)
            cut = of_context >= model["part"]
            factor[cut] = np.nan
            if cut.any():
                sums = _bytes(np.concatenate([x[cut] for x in (of_context.astype(float), *sums)]))
                more.append((level, PARTS, bucket, _bytes(contexts[cut]), sums, 0, 0, *[None] * 5))
            if level == 1:
                values = word[own], total[total > 0], of_word[own]
                more += _kept(model, bucket, contexts, of_context, ~np.isnan(factor), group, *values)
            by_number = np.full(len(numbers), np.nan)
            by_number[there] = factor
            found = by_number[of_asked]
            rare = np.add.reduceat(total[place] == 0, np.cumsum(sizes) - sizes, dtype=np.int64) > 0
            found[~(rare | _joined_values(asks["unasked"], bool) | np.isnan(found))] = 1
            factors = [_bytes(f) for f in np.split(found, np.cumsum([len(mine) for mine in asked])[:-1])]
        if blocks:
            rows = [
                (level, block, bucket, _bytes(part), of, 0, 0, *[None] * 5)
                for block, part, of in zip(blocks, np.split(total[place], ends), factors, strict=True)
            ]
            rows[0] = (*rows[0][:5], tokens, types, *[None] * 5)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        columns = [list(c) for c in zip(*rows, *more, strict=True)] or [[]] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _names(_REPLIES))

    def run(asks: pa.Table) -> pa.Table:
        return reply(asks)

    return reply if level == 2 else run


def _hot_factors(replies: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Contexts in parts, and the factors of their states: their parts' sums meet here."""
    rows = replies.where(F.col("block") == PARTS).select("counts", "factors").toArrow()
    contexts = _joined_values(rows["counts"], np.uint64)
    sums = np.concatenate([np.zeros((5, 0)), *[x.reshape(5, -1) for x in _values(rows["factors"], np.float64)]], axis=1)
    distinct, first, group = np.unique(contexts, return_index=True, return_inverse=True)
    total = [np.bincount(group, weights=x, minlength=len(distinct)) for x in sums[1:]]
    return distinct, _factors(sums[0][first], *total)


def score_documents(
    docs: DataFrame,
    context_share: float = CONTEXT_SHARE,
    pair_share: float = PAIR_SHARE,
    block_bytes: int = BLOCK_BYTES,
    part: int = PART,
) -> DataFrame:
    """Learn from `docs` (doc_id, text) outside the held-out fold and score all of them.

    A context of one or two words needs LEAST_CONTEXT occurrences in training texts and `context_share` of all their
    tokens; a word has a probability of its own in it from LEAST_PAIR occurrences there and `pair_share`, and
    LEAST_CONTEXT in all.

    doc_id, held_out, n_tokens (words and one end), n_known (tokens seen in training), train_tokens,
    base_score (log10 probability by single words, add-one smoothed) and score (by the tree).

    Null and empty texts consist of the end only. Rows without an id are training rows. Repeated rows
    are counted and scored each. Without training rows all counts are 0. Empty table: empty result.
    Words are told apart by 64-bit hashes.
    """
    blocks = block_count(docs, block_bytes)
    rows = with_block(docs.select("doc_id", "text"), block_bytes, blocks=blocks)
    rows = rows.withColumn("held", held_out(F.col("doc_id")))
    texts = packed(rows.select("block", "doc_id", "held", "text"))
    id_type = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    shown = to_arrow_type(id_type)
    model = {"buckets": blocks, "part": part, "hot": []}

    first = _FIRST.format(id=id_type.simpleString())
    cut = materialise(texts.groupBy("block").applyInArrow(_first(blocks, shown), first), "cut")
    texts = cut.where("bucket < 0").select("block", "counts", "ids", "held", "places", "dealt")
    asks = cut.where("bucket >= 0").select("bucket", "block", "words", "counts")
    sums = Observation()
    found = asks.groupBy("bucket").applyInArrow(_answered(0, dict(model)), _REPLIES)
    found = found.observe(sums, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types")])
    columns = "level", "block", "bucket", "counts", "factors"
    replies = materialise(found, "words").select(*columns)
    tokens, types = sums.get["tokens"], sums.get["types"]
    model["scale"] = float(tokens + types + 1)
    model["least"] = max(LEAST_CONTEXT, context_share * tokens)
    model["least_run"] = max(LEAST_PAIR, pair_share * tokens)
    for level in (1, 2):
        # Blocks ask without their scores, so without the factors of states.
        known = replies.withColumn("factors", F.when(F.col("level") == 0, F.col("factors")))
        asks = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_asked(level, dict(model)), _ASKS)
        answered, asks = _answered(level, dict(model, hot=list(model["hot"]))), asks.groupBy("bucket")
        if level == 2:
            runs = found.where(F.col("block") == RUNS).drop("level", "block", "tokens", "types")
            asks = asks.cogroup(runs.groupBy("bucket"))
        found = materialise(asks.applyInArrow(answered, _REPLIES), f"runs_{level}")
        model["hot"].append(_hot_factors(found))
        replies = replies.union(found.where("block >= 0").select(*columns))

    def scored(docs: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(docs, replies, model)
        for _ in (1, 2):
            block.grow()
        starts = np.cumsum(block.counts) - block.counts

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, starts) if len(starts) else np.zeros(0)

        return pa.table(
            {
                "doc_id": block.ids.cast(shown),
                "held_out": pa.array(block.held),
                "n_tokens": pa.array(block.counts),
                "n_known": pa.array(per_text((block.seen > 0).astype(np.int64)).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(block.counts), tokens, np.int64)),
                "base_score": pa.array(per_text(block.base).astype(float)),
                "score": pa.array(per_text(block.logs).astype(float)),
            }
        )

    return (
        texts.groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInArrow(scored, f"doc_id {id_type.simpleString()}, {_RESULT}")
    )


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def op7_suffix_tree(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
