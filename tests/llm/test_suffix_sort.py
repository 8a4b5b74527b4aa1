"""Suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from askgrid.llm import suffix_sort


def brute_force(rows, length=50):
    """(bytes, removed, spans, kept) per row: a byte goes if a string that covers it starts in a smaller id."""
    least = {}
    encoded = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    for doc_id, text in encoded:
        for p in range(len(text) - length + 1):
            string = text[p : p + length]
            least[string] = min(doc_id, least.get(string, doc_id))
    result = []
    for doc_id, text in encoded:
        gone = [False] * len(text)
        for p in range(len(text) - length + 1):
            if least[text[p : p + length]] < doc_id:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        result.append((len(text), sum(gone), spans, bytes(b for b, g in zip(text, gone, strict=True) if not g)))
    return result


def found(df, **options):
    rows = suffix_sort.remove_repeated_strings(df, **options).collect()
    return [(r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in rows]


def test_equal_groups_are_the_equal_rows():
    chosen = np.random.default_rng(3)
    rows = chosen.integers(0, 2, (2000, 11)).astype(np.uint8)
    group = suffix_sort.equal_groups(rows)
    by_row = {}
    for row, g in zip(map(bytes, rows), group, strict=True):
        assert by_row.setdefault(row, g) == g
    assert len(set(by_row.values())) == len(by_row)
    assert len(suffix_sort.equal_groups(rows[:0])) == 0


@pytest.fixture
def shared(prose):
    chosen = random.Random(7)
    passages = [prose(300 + i, chosen.randint(5, 40)) for i in range(5)] + ["é日本 " * 20, "ab" * 60, "x" * 90]
    rows = []
    for i in range(50):
        parts = [chosen.choice([prose(i * 3 + k, chosen.randint(0, 20)), chosen.choice(passages)]) for k in range(3)]
        rows.append((chosen.randint(-50, 10**6), chosen.choice(["", " "]).join(parts)))
    rows += [(2 * 10**6 + i, rows[0][1]) for i in range(6)]
    rows += [(3 * 10**6, "y" * 49), (3 * 10**6 + 1, "y" * 50), (3 * 10**6 + 2, "y" * 51)]
    return list({r[0]: r for r in rows}.values())


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"block_bytes": 900, "bucket_bytes": 500},
        {"block_bytes": 900, "bucket_bytes": 1500, "most_stretches": 0},
        {"anchor": 11, "block_bytes": 2000},
    ],
)
def test_texts_with_shared_passages(documents, shared, options):
    got = dict(found(documents(shared), **options))
    expected = dict(zip([i for i, _ in shared], brute_force(shared), strict=True))
    assert sum(r[1] for r in expected.values()) > 1000
    assert got == expected


def test_a_frequent_phrase_among_different_words(documents, prose):
    """An anchor with many different stretches: the same result from strings dealt out one by one."""
    rows = [(i, f"{prose(i, 9)} the very frequent phrase {prose(i + 500, 9)}") for i in range(200)]
    rows += [(1000 + i, rows[i][1][20:]) for i in range(0, 200, 7)]
    expected = dict(zip([i for i, _ in rows], brute_force(rows), strict=True))
    for most in (0, 3, 1 << 16):
        assert dict(found(documents(rows), block_bytes=2000, bucket_bytes=3000, most_stretches=most)) == expected


def test_segments_of_a_long_text(documents, prose, monkeypatch):
    monkeypatch.setattr(suffix_sort, "_SEGMENT", 512)
    long = prose(1, 2500)
    rows = [(5, long), (6, "start " + long[3000:9000] + " end"), (7, long)]
    expected = brute_force(rows)
    assert dict(found(documents(rows))) == dict(zip([5, 6, 7], expected, strict=True))


def test_nulls_ties_and_repeated_rows(documents, prose):
    text = prose(1, 30)
    size = len(text)
    rows = [(None, text), (None, "a " + text), (1, None), (2, ""), (4, text), (4, text), (4, text + " more"), (9, "few")]
    got = {}
    for doc_id, result in found(documents(rows)):
        got.setdefault(doc_id, []).append(result)
    assert sorted(r[1] for r in got[None]) == [0, 0]  # rows without an id come first and take nothing from each other
    assert got[1] == got[2] == [(0, 0, 0, b"")]
    assert sorted(got[4]) == [(size, size, 1, b""), (size, size, 1, b""), (size + 5, size, 1, b" more")]
    assert got[9] == [(3, 0, 0, b"few")]
    assert [r for _, r in found(documents([(4, text), (4, text)]))] == [(size, 0, 0, text.encode())] * 2


def test_other_columns_pass_and_empty_table(documents, prose):
    df = documents([(1, prose(1, 30)), (2, prose(1, 30))])
    result = suffix_sort.remove_repeated_strings(df)
    assert set(df.columns) - {"text"} <= set(result.columns)
    assert {(r["id"], r["lang"]) for r in result.collect()} == {("x", "en")}
    assert suffix_sort.remove_repeated_strings(documents([])).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    expected = {
        i: (n, gone, spans, hashlib.sha256(kept).hexdigest())
        for (i, _), (n, gone, spans, kept) in zip(rows, brute_force(rows), strict=True)
    }
    got = {r[0]: tuple(r)[1:] for r in suffix_sort.op12_suffix_sort(spark, folder).collect()}
    assert got == expected
