"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from askgrid.llm import spelling


def is_near(a, b):
    """One inserted, deleted or replaced code point apart, by trying them all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def brute_force(rows):
    words = counted(rows)
    forms, result = {}, {}
    for word, n in words.items():
        near = [w for w in words if abs(len(w) - len(word)) <= 1 and is_near(word, w)]
        best = min(near, key=lambda w: (-words[w], w), default=None)
        forms[word] = best if best and words[best] >= 5 * n else None
        result[word] = (n, len(near))
    for word in words:
        root = word
        while forms[root]:
            root = forms[root]
        form = forms[word]
        result[word] = (form, root, *result[word], words[form] if form else None)
    return result


def found(df, **options):
    return {r["word"]: tuple(r)[1:] for r in spelling.group_variants(df, **options).collect()}


def varied(seed, words):
    """Texts of words and of words with an edit, frequent ones among them."""
    chosen = random.Random(seed)
    letters = "abcéÉ"
    stems = ["".join(chosen.choice(letters) for _ in range(chosen.randint(6, 9))) for _ in range(12)]
    pool = []
    for stem in stems:
        pool += [stem] * chosen.choice([5, 40, 300])
        for _ in range(12):
            at, new = chosen.randrange(len(stem)), chosen.choice(letters)
            edited = chosen.choice([stem[:at] + stem[at + 1 :], stem[:at] + new + stem[at:], stem[:at] + new + stem[at + 1 :]])
            pool += [edited] * chosen.choice([1, 3, 6, 30])
    for stem in ("quartzes", "jukebox"):  # chains of forms
        pool += [stem] * 200 + [stem + "y"] * 30 + [stem + "yz"] * 5
    picked = [chosen.choice(pool) for _ in range(words)]
    return [(i, chosen.choice([" ", ", ", "-", "1"]).join(picked[k : k + 60])) for i, k in enumerate(range(0, words, 60))]


@pytest.mark.parametrize("options", [{}, {"tile": 3, "task_rows": 50}])
def test_edited_words(documents, options):
    rows = varied(11, 12000)
    expected = brute_force(rows)
    assert sum(r[0] is not None for r in expected.values()) > 20 and any(r[0] and r[0] != r[1] for r in expected.values())
    assert found(documents(rows), **options) == expected


def test_every_edit_of_every_length(spark):
    """Words of 6 to 13 letters of an alphabet of two: overlaps of prefix and suffix, and many near words."""
    chosen = random.Random(2)
    words = {"".join(chosen.choice("ab") for _ in range(size)) for size in range(6, 14) for _ in range(60)}
    df = spark.createDataFrame([(w, 5) for w in sorted(words)], "word STRING, n LONG")
    expected = sorted((a, b) for a in words for b in words if abs(len(a) - len(b)) <= 1 and a != b and is_near(a, b))
    for options in ({}, {"tile": 7, "task_rows": 100}):
        assert sorted((r["word"], r["near"]) for r in spelling.near_words(df, **options).collect()) == expected


def test_damaged_runs_and_long_texts(documents, monkeypatch):
    monkeypatch.setattr(spelling, "_CHARACTERS", 100)
    chosen = random.Random(5)
    words = ["".join(chosen.choice("abcdefgh") for _ in range(chosen.randint(5, 9))) for _ in range(40)]
    rows = [(i, " ".join(chosen.choices(words, k=200)) + "×÷ÀÿÞ" * 2) for i in range(60)]
    expected = brute_force(rows)
    assert any(w not in words for w in expected)  # some runs lost a code point
    assert found(documents(rows)) == expected


def test_nulls_ties_repeated_rows_and_empty_tables(documents):
    rows = [(None, "Letter letter LETTER"), (1, None), (2, ""), (3, "short few"), (4, "letter letteR ñandúes")] * 5
    rows += [(5, " ".join(["lettes"] * 25 + ["lettet"] * 25 + ["lette"] * 99 + ["letted"] * 5))]
    expected = brute_force(rows)
    assert expected["letted"][0] is None or expected["letted"][0] == "letter"
    assert expected["ñandúes"][:2] == (None, "ñandúes")
    assert found(documents(rows)) == expected
    assert found(documents([])) == {}
    assert found(documents([(1, None), (None, "  ")])) == {}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["word"]: tuple(r)[1:] for r in spelling.op13_spelling(spark, folder).collect()} == brute_force(rows)
