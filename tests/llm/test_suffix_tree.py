"""LM scoring: counts against brute force, probabilities that sum to one, better than single words."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from askgrid.llm import suffix_tree


def brute_force(rows):
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for words, h in zip(tokens, held, strict=True) if not h for w in words)
    total, types = sum(counts.values()), len(counts)
    return [
        (i, h, len(words), sum(counts[w] > 0 for w in words), total,
         sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in words))
        for (i, _), words, h in zip(rows, tokens, held, strict=True)
    ]


def compare(found, rows):
    got = sorted([tuple(r)[:6] for r in found], key=lambda r: (str(r[0]), r[2], r[5]))
    expected = sorted(brute_force(rows), key=lambda r: (str(r[0]), r[2], r[5]))
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def test_counts_over_several_blocks(documents, prose):
    rows = [(i, " ".join([prose(i % 9, 30), "The END of it", prose(i, 5)])) for i in range(120)]
    rows += [(None, "the end"), (None, None), (200, ""), (201, None), (7, "the the"), (7, "the the"), (202, "w " * 5000)]
    compare(suffix_tree.score_documents(documents(rows), block_bytes=2000).collect(), rows)


def test_nothing_to_learn_from(documents):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    compare(suffix_tree.score_documents(documents([(held, "some words")])).collect(), [(held, "some words")])
    assert suffix_tree.score_documents(documents([])).count() == 0


def _corpus(n):
    chosen = random.Random(4)
    words = ["new", "york", "the", "city", "of", "old", "town"] + [f"w{i}" for i in range(30)]
    for i in range(n):
        text = []
        for _ in range(40):
            text.append(chosen.choice(words))
            if text[-1] == "new":
                text.append("york" if chosen.random() < 0.9 else chosen.choice(words))
            if text[-2:] == ["the", "city"]:
                text.append("of")
        yield i, " ".join(text)


def test_contexts_help_on_held_out_text(documents):
    rows = list(_corpus(400))
    found = suffix_tree.score_documents(documents(rows), pair_share=1e-6).collect()
    held = [r for r in found if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.02


def plain_scores(rows, context_share, pair_share):
    """The tree's scores by dictionaries of words: log10 probability of each text."""
    cut = [[*(t or "").lower().split(), None] for _, t in rows]
    learnt = [w for (i, _), w in zip(rows, cut, strict=True) if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for words in learnt for w in words)
    tokens = sum(counts.values())
    scale = tokens + len(counts) + 1
    runs = Counter(tuple(w[i : i + n]) for w in learnt for n in (2, 3) for i in range(len(w) - n + 1))
    least, least_run = max(16, context_share * tokens), max(2, pair_share * tokens)
    own, factor = {(): {}}, {}

    def chance(context, word):
        if context == ():
            return (counts[word] + 1) / scale
        if context not in factor:
            return chance(context[1:], word)
        return own[context].get(word, factor[context] * chance(context[1:], word))

    contexts = [(w,) for w, c in counts.items() if w is not None and c >= least]
    contexts += [r for r, c in runs.items() if len(r) == 2 and c >= least and r[1] is not None]
    for context in sorted(contexts, key=len):
        seen = counts[context[0]] if len(context) == 1 else runs[context]
        after = {r[-1]: c for r, c in runs.items() if r[:-1] == context and c >= least_run and counts[r[-1]] >= 16}
        if not after:
            continue
        before = {w: chance(context[1:], w) for w in after}
        after = {w: (c + 4 * before[w]) / (seen + 4) for w, c in after.items()}
        rest, rest_before = 1 - sum(after.values()), 1 - sum(before.values())
        gained = sum(p * math.log(p / before[w]) for w, p in after.items()) + rest * math.log(rest / rest_before)
        if 2 * seen * gained >= len(after) + 4 * math.sqrt(2 * len(after)) + 10:
            own[context], factor[context] = after, rest / rest_before
    scores = [
        sum(math.log10(chance(tuple(words[max(0, i - 2) : i]), w)) for i, w in enumerate(words)) for words in cut
    ]
    return scores, own


def test_scores_against_a_plain_tree(documents):
    """Rare words after frequent ones have a probability of their own, too."""
    chosen = random.Random(9)
    rows = [(i, t.replace("new york", "new york mayor")) for i, t in _corpus(300)]
    rows = [(i, t.replace("w7", f"w7 rare{i % 9}") if chosen.random() < 0.7 else t) for i, t in rows]
    expected, states = plain_scores(rows, 1 / 100, 1e-6)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(documents(rows), 1 / 100, block_bytes=9000).collect()}
    assert all(math.isclose(got[i], e, rel_tol=1e-9) for (i, _), e in zip(rows, expected, strict=True))
    assert {len(c) for c in states} == {0, 1, 2}
    assert "rare1" in states["w7",]


def test_contexts_of_any_share_are_states(documents):
    """Without a share of the corpus that they must have, also in parts and over many blocks."""
    rows = list(_corpus(100))
    rows += [(1000 + i, f"seldom {i % 2} met {('here', 'there')[i % 2]} " + " ".join(f"u{i}x{j}" for j in range(200))) for i in range(200)]
    rows += [(None, "seldom 1 met"), (3000, None)]
    expected, states = plain_scores(rows, 0, 0)
    assert ("seldom",) in states and ("1", "met") in states
    for options in ({"block_bytes": 9000}, {"block_bytes": 9000, "part": 20}, {}):
        got = {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(documents(rows), **options).collect()}
        assert all(math.isclose(got[i], e, rel_tol=1e-9) for (i, _), e in zip(rows, expected, strict=True))


def test_each_state_sums_to_one():
    """Over all words and the unknown one, in every state that was kept."""
    hash_ = lambda n: [int(x) for x in np.arange(1, n + 1, dtype=np.uint64) * np.uint64(1 << 40)]
    a, b, c, d = words = hash_(4)
    often = dict(zip(words, (400, 300, 200, 100), strict=True))
    pair = suffix_tree.joined(np.array([a], np.uint64), np.array([b], np.uint64)).view(np.int64)[0].item()
    rows = [(2, a, a, b, 350), (2, a, a, c, 20), (2, b, b, a, 250), (3, pair, b, c, 300), (3, pair, b, a, 20)]
    rows = [(*r, often[r[3]], {**often, pair: 350}[r[1]]) for r in rows]
    columns = ["words", "context", "parent", "word", "count", "total", "seen"]
    runs = pa.table(dict(zip(columns, zip(*rows, strict=True), strict=True)))
    tree = suffix_tree._grown(runs, 1000, 4)
    members = []
    for states, of_words in zip(tree.states, tree.words, strict=True):
        two = suffix_tree._Members(states[0]), suffix_tree._Members(of_words[0])
        two[0].values, two[1].values = states[1], of_words[1]
        members.append(two)
    assert [len(s[0]) for s in tree.states] == [2, 1]
    unknown = 5 << 40
    for context in ([], [a], [b], [c], [a, b], [c, b]):
        total = 0.0
        for word in [*words, unknown]:
            hashes = np.array([*context, word], np.uint64)
            logs = np.log10([(often.get(int(h), 0) + 1) / tree.scale for h in hashes])
            total += 10 ** suffix_tree._scores(tree, logs, hashes, np.array([len(hashes)]), members)[-1]
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    compare(suffix_tree.op7_suffix_tree(spark, folder).collect(), rows)


def test_texts_are_cut_once():
    """A block is made again from the numbers of its words, without its texts."""
    texts = [b"The end of the Day", b"", b"of the day " * 20]
    packed = pa.array([suffix_tree.zstandard.compress(t) for t in texts], pa.binary())
    docs = pa.table({"block": [3, 3, 3], "doc_id": [5, None, 9], "held": [True, False, False], "packed": packed})
    rows = suffix_tree._first(2, pa.int64())(docs)
    asks, own = (rows.filter(suffix_tree.pc.equal(suffix_tree.pc.less(rows["bucket"], 0), x)) for x in (False, True))
    replies = [
        suffix_tree._answered(0, {"buckets": 2})(asks.filter(suffix_tree.pc.equal(asks["bucket"], b))) for b in asks["bucket"].unique().to_pylist()
    ]
    block = suffix_tree._Block(own, pa.concat_tables(replies), {"scale": 1.0})
    assert block.ids.to_pylist() == [5, None, 9] and block.held.tolist() == [True, False, False]
    words = [[*t.lower().split(), None] for t in texts]
    counts = Counter(w for ws in words[1:] for w in ws)
    assert block.counts.tolist() == [len(w) for w in words]
    assert block.seen.tolist() == [counts[w] for ws in words for w in ws]
    numbers = {(n, w) for n, w in zip(block.words[block.place].tolist(), [w for ws in words for w in ws], strict=True)}
    assert {w for n, w in numbers if n} == {b"of", b"the", b"day"} and len({n for n, _ in numbers}) == 4


def test_groups_by_one_number_or_by_sorting():
    """Keys and places that don't fit into one number are grouped alike."""
    keys = np.array([random.Random(3).randrange(50) for _ in range(1000)], np.int64)
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    for most in (50, 1 << 62):
        got = suffix_tree._grouped(keys, most)
        assert (got[0] == first).all() and (got[1] == number).all()


def _replied(texts, buckets):
    """A block of these training texts and all that buckets reply to it, in one process: asks and replies by level."""
    packed = pa.array([suffix_tree.zstandard.compress(t.encode()) for t in texts], pa.binary())
    n = len(texts)
    docs = pa.table({"block": [0] * n, "doc_id": [None] * n, "held": [False] * n, "packed": packed})
    rows = suffix_tree._first(buckets, pa.int64())(docs)
    less = suffix_tree.pc.less(rows["bucket"], 0)
    own, asks = rows.filter(less), [rows.filter(suffix_tree.pc.invert(less))]
    model = {"buckets": buckets, "part": 1 << 30, "hot": [(np.zeros(0, np.uint64), np.zeros(0))] * 2}
    model |= {"scale": 1000.0, "least": 16, "least_run": 2}
    replies = []
    for level in (0, 1, 2):
        if level:
            told = pa.concat_tables(replies)
            told = told.filter(suffix_tree.pc.equal(told["block"], 0))
            asks.append(suffix_tree._asked(level, model)(own, told))
        parts = []
        for b in asks[level]["bucket"].unique().to_pylist():
            here = [asks[level].filter(suffix_tree.pc.equal(asks[level]["bucket"], b))]
            if level == 2:
                known = replies[1].filter(suffix_tree.pc.equal(replies[1]["bucket"], b))
                here.append(known.filter(suffix_tree.pc.less(known["block"], -1)))
            parts.append(suffix_tree._answered(level, model)(*here))
        replies.append(pa.concat_tables(parts))
    return asks, replies


def _size(table, *columns):
    return sum(len(b) for c in columns for b in table[c].to_pylist() if b is not None)


def test_runs_are_asked_for_in_few_bytes():
    """A block says neither hashes of contexts nor chances of words, and hears factors only where it needs them."""
    chosen = random.Random(5)
    texts = [" ".join(f"w{int(chosen.paretovariate(0.6)) % 300}" for _ in range(300)) for _ in range(300)]
    asks, replies = _replied(texts, 2)
    for level, most in ((1, 2), (2, 2)):  # 2.8 and 8.2 bytes a run before, 1.4 and 1.3 now
        binary = [c for c in asks[level].column_names if asks[level].schema.field(c).type == pa.binary()]
        runs = sum(len(w) for w in suffix_tree._values(asks[level]["words"], np.uint64))
        assert runs > 5000 and _size(asks[level], *binary) < most * runs
    # All that follows "a" has a probability of its own; a rare word follows "b", too.
    _, replies = _replied(["x y z " * 30, *["a x", "a y"] * 20, *["b x", "b y"] * 20, "b rare"], 1)
    blocks = replies[1].filter(suffix_tree.pc.equal(replies[1]["block"], 0))
    factors = suffix_tree._joined_values(blocks["factors"], np.float64)
    assert (factors == 1).any() and (factors[~np.isnan(factors)] < 1).any()


def test_contexts_that_end_with_a_word_without_runs(documents):
    """Their bucket has no run of two words: whatever follows `b` does so once."""
    rows = [(None, f"a b w{i}") for i in range(20)] + [(None, f"w{i}") for i in range(20) for _ in range(15)]
    rows += [(None, f"w{i}") for i in range(3)]
    expected, _ = plain_scores(rows, 0, 0)
    found = suffix_tree.score_documents(documents(rows), block_bytes=100).collect()
    got = sorted(r["score"] for r in found)
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got, sorted(expected), strict=True))
