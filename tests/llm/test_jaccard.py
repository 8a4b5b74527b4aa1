"""Similarity groups against all pairs."""

import random

import pytest

from askgrid.llm import jaccard


def brute_force(rows, n, share):
    sets = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words)} if 0 < len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (doc_id, _) in zip(group, rows, strict=True):
        ids = [x for x in (least.get(g), doc_id) if x is not None]
        least[g] = min(ids) if ids else None
    return sorted([(r[0], len(s), least[g]) for r, s, g in zip(rows, sets, group, strict=True)], key=str)


def variants(prose, seed, n, many, most):
    chosen, base = random.Random(seed), prose(seed, n).split()
    for _ in range(many):
        words = list(base)
        for _ in range(chosen.randint(0, most)):
            words[chosen.randrange(len(words))] = prose(chosen.random(), 1)
        yield " ".join(words)


@pytest.mark.parametrize(("n", "share", "part"), [(3, 90, 256), (5, 80, 8)])
def test_families_of_variants(documents, prose, monkeypatch, n, share, part):
    monkeypatch.setattr(jaccard, "PART", part)
    texts = [t for s, size in ((1, 60), (2, 150), (3, 400), (4, 12)) for t in variants(prose, s, size, 25, size // 25 + 1)]
    texts += ["", " \t", "one", "one", "One", "one two", "one two", None] + [texts[0].upper()] * 6
    texts += [prose(s, s % 30) for s in range(40)]
    ids = random.Random(1).sample(range(10**6), len(texts))
    rows = list(zip(ids, texts, strict=True))
    got = jaccard.jaccard_groups(documents(rows), n, share).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_force(rows, n, share)


def test_null_ids_repeated_rows_and_empty_table(documents, prose):
    rows = [(None, "x y z"), (None, prose(1, 30)), (7, prose(1, 30)), (7, prose(1, 30)), (3, None)]
    got = jaccard.jaccard_groups(documents(rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_force(rows, 3, 90)
    assert jaccard.jaccard_groups(documents([])).count() == 0


def test_bands_hold_all_linked_sizes():
    for share in (80, 90):
        starts = jaccard.bands(3000, share).tolist()
        band = {s: max(i for i, b in enumerate(starts) if b <= s) for s in range(1, 3001)}
        assert all(band[t] - band[s] <= 1 for s in range(1, 3001) for t in range(s, min(3000, s * 100 // share) + 1))


def test_linked_sets_share_a_signature():
    chosen = random.Random(8)
    import numpy as np

    for share in (80, 90):
        for _ in range(1500):
            size = int(3 * 1.01 ** chosen.randint(0, 450))
            base = [chosen.getrandbits(64) for _ in range(size)]
            gone = chosen.randint(0, size * (100 - share) // (100 + share) + 1)
            other = base[gone:] + [chosen.getrandbits(64) for _ in range(chosen.randint(0, gone))]
            common = len(base) - gone
            if not other or 100 * common < share * (len(base) + len(other) - common):
                continue
            sets = [np.sort(np.array(x, np.uint64)) for x in (base, other)]
            found, owner = jaccard.signatures(np.concatenate(sets), np.array([len(x) for x in sets]), share)
            if set(base) != set(other):
                assert set(found[owner == 0].tolist()) & set(found[owner == 1].tolist())


def test_a_common_passage_ties_nothing(documents, prose):
    passage = prose(1000, 30)
    rows = [(i, f"{prose(i, 60)} {passage} {prose(500 + i, 60)}") for i in range(120)]
    near = [(200, f"{rows[7][1]} x"), (201, rows[9][1]), (202, rows[9][1].upper()), (203, ""), (204, None), (205, "one")]
    keyed = documents(rows + near).select("text", *jaccard._keys())
    for block_bytes in (1 << 30, 1 << 12):
        tied = {r["node"] for r in jaccard._signature_rows(keyed, 5, 80, block_bytes).collect()}
        classes = {r["id"]: r["node"] for r in jaccard._classes(keyed, 5).collect()}
        assert {classes[7], classes[200]} <= tied <= {classes[i] for i in (7, 200, 9)}
    got = jaccard.jaccard_groups(documents(rows + near), 5, 80, block_bytes=1 << 12).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_force(rows + near, 5, 80)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in jaccard.op5_jaccard(spark, folder).collect()], key=str) == brute_force(rows, 3, 90)


def test_one_python_worker_packs_texts_once_a_batch(spark):
    """A second worker in each task stays on beside the first, in the executor's memory."""
    rows = [(0, b"a", "one two"), (0, b"b", None), (0, b"a", "one two")]
    found = jaccard._once_a_batch(spark.createDataFrame(rows, "block long, digest binary, text string").coalesce(1))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    texts = found.orderBy("digest").toArrow()
    assert texts["digest"].to_pylist() == [b"a", b"b"]
    assert jaccard.unpacked(texts["packed"]) == [b"one two", b""]
