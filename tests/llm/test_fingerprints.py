"""Content-defined chunking and its neighbours."""

import hashlib
import random

from askgrid.llm import fingerprints

TABLE = fingerprints._gear_table()


def test_hashes_are_those_of_a_rolling_loop():
    data = random.Random(1).randbytes(500)
    h, expected = 0, []
    for byte in data:
        h = ((h << 1) + int(TABLE[byte])) & 0xFFFFFFFF
        expected.append(h)
    assert fingerprints.gear_hashes(data, TABLE).tolist() == expected


def test_cut_points_are_those_of_a_loop():
    f = fingerprints
    for size in (0, 1, 15, 16, 17, 64, 5000):
        data = random.Random(size).randbytes(size)
        hashes, expected, start = f.gear_hashes(data, TABLE).tolist(), [], 0
        for i, h in enumerate(hashes):
            length = i + 1 - start
            bits = f.HARD_BITS if length < f.NORMAL else f.EASY_BITS
            if (length >= f.SHORTEST and h >> (32 - bits) == 0) or length == f.LONGEST:
                expected.append(i + 1)
                start = i + 1
        if start < size:
            expected.append(size)
        assert f.cut_points(data, TABLE) == expected


def test_an_insertion_moves_few_boundaries(prose):
    text = prose(1, 2000)
    near = fingerprints.containment(fingerprints.chunk_set(text, TABLE), fingerprints.chunk_set("x" + text, TABLE))
    assert near > 0.95


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in rows]
    for (doc_id, _), text, after in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        sets = [fingerprints.chunk_set(t, TABLE) for t in (text, edited, after)]
        near = [fingerprints.containment(sets[0], s) for s in sets[1:]]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        yield (doc_id, len(text), digest, fingerprints.as_text(sets[0]), fingerprints.as_text(sets[1]), *near)


def test_neighbours_across_ranges(documents, prose):
    rows = [(i * 3, prose(i, i % 70)) for i in range(300)] + [(5000, "é" * 40000), (5001, None), (5002, "")]
    rows += [(7, "same id, other text"), (7, "same id"), (None, "no id"), (6000, prose(1, 9)), (6000, prose(1, 9))]
    got = sorted([tuple(r) for r in fingerprints.fingerprint_documents(documents(rows)).collect()], key=str)
    assert got == sorted(expected(rows), key=str)


def test_one_document_and_none(documents):
    rows = [(1, "alone in the world")]
    assert [tuple(r) for r in fingerprints.fingerprint_documents(documents(rows)).collect()] == list(expected(rows))
    assert fingerprints.fingerprint_documents(documents([])).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted([tuple(r) for r in fingerprints.op9_fingerprints(spark, folder).collect()])
    assert got == sorted(expected(rows))
