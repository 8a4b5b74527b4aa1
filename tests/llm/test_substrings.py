"""Substring dedup against brute force."""

import hashlib
import random

import pytest

from askgrid.llm import substrings
from askgrid.llm.blocks import with_block


def brute_force(rows, window):
    """(words, removed, kept) per distinct (id, text): a window goes if it starts earlier."""
    seen, result = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if tuple(words[i : i + window]) in seen:
                gone[i : i + window] = [True] * window
            seen.add(tuple(words[i : i + window]))
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        result[doc_id, text] = (len(words), sum(gone), kept)
    return result


def found(df, **options):
    rows = substrings.remove_repeats(df, keep_text=True, **options).collect()
    return [(r["doc_id"], r["text"], (r["n_words"], r["n_removed"], r["kept"])) for r in rows]


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_random_texts_with_shared_passages(documents, prose, block_bytes):
    chosen = random.Random(5)
    passages = [prose(100 + i, chosen.randint(15, 60)) for i in range(6)]
    rows = []
    for i in range(60):
        parts = [chosen.choice([prose(i, chosen.randint(0, 30)), chosen.choice(passages)]) for _ in range(3)]
        rows.append((chosen.randint(0, 10**6), " ".join(parts)))
    rows += [(2 * 10**6 + i, rows[0][1]) for i in range(5)] + [(3 * 10**6, "a " * 300), (3 * 10**6 + 1, "a " * 50)]
    rows = list({r[0]: r for r in rows}.values())
    expected = brute_force(rows, 20)
    got = found(documents(rows), block_bytes=block_bytes)
    assert len(got) == len(rows)
    assert all(expected[i, t] == result for i, t, result in got)


def test_blocks_are_bounded_whatever_the_ids(documents, prose):
    """A far-off id, clusters of ids, null ids and one id on many texts: no block gets much more than the others."""
    ids = [*range(60), *range(10**9, 10**9 + 60), 10**12, *[None] * 60, *[-5] * 60]
    rows = [(i, prose(n, 20)) for n, i in enumerate(ids)]
    sizes = {}
    for row in with_block(documents(rows), 1000, "_b").collect():
        sizes[row["_b"]] = sizes.get(row["_b"], 0) + len(row["text"])
    assert max(sizes.values()) < 2000 and len(sizes) > sum(sizes.values()) / 2000
    shared = prose(999, 30)
    rows = [(i, f"{t} {shared}") for i, t in rows]
    expected = brute_force(rows, 20)
    got = found(documents(rows), block_bytes=3000)
    assert sum(r[1] for _, _, r in got) == sum(r[1] for r in expected.values()) > 0
    assert all(expected[i, t][0] == r[0] and (i in (None, -5) or expected[i, t] == r) for i, t, r in got)


def test_nulls_short_and_repeated_rows(documents, prose):
    long = prose(1, 40)
    rows = [(None, long), (1, None), (2, ""), (3, "few words"), (4, long), (4, long), (5, " \t\n " + long + " \x0b")]
    got = {}
    for doc_id, text, result in found(documents(rows)):
        got.setdefault(doc_id, []).append(result)
    assert got[None] == [(40, 0, long)]  # before all others, so it is the source
    assert got[1] == got[2] == [(0, 0, "")]
    assert got[3] == [(2, 0, "few words")]
    assert got[4] == [(40, 40, "")] * 2  # one document, given twice
    assert got[5] == [(40, 40, "")]


def test_a_repeated_row_alone_is_no_duplicate_of_itself(documents, prose):
    assert [r for _, _, r in found(documents([(4, prose(1, 40))] * 3))] == [(40, 0, prose(1, 40))] * 3


def test_other_columns_pass_and_empty_table(documents, prose):
    df = documents([(1, prose(1, 30)), (2, prose(1, 30))])
    result = substrings.remove_repeats(df)
    assert set(df.columns) - {"text"} <= set(result.columns)
    assert {r["id"] for r in result.collect()} == {"x"}
    assert substrings.remove_repeats(documents([])).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    expected = {
        i: (n, gone, hashlib.sha256(kept.encode()).hexdigest())
        for (i, _), (n, gone, kept) in brute_force(rows, 20).items()
    }
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.op1_substrings(spark, folder).collect()}
    assert got == expected
