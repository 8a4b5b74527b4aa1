"""The searches against brute force on small data, in one slice and in many, with and without floors."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.functions import bm25, ranking
from askgrid.operators import chunking, embedding, lexical, membership, retrieval
from askgrid.plans import rag

K = 4


def unit_vectors(count, width, seed, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width)) * 3
    return (centres[rng.integers(0, clusters, count)] + rng.normal(size=(count, width))).astype(np.float32)


def as_table(spark, ids, vectors, key, column):
    rows = [(i, v.tolist()) for i, v in zip(ids, vectors)]
    kind = "STRING" if isinstance(ids[0], str) else "BIGINT"
    return spark.createDataFrame(rows, f"{key} {kind}, {column} ARRAY<FLOAT>").repartition(6)


def brute_vector(question_ids, questions, chunk_ids, chunks, k):
    def unit(m):
        m = m.astype(np.float64)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(length == 0, 1, length)

    scores = np.round(unit(questions) @ unit(chunks).T, 9)
    found = []
    for q, row in zip(question_ids, scores):
        best = sorted(zip(-row, chunk_ids))[:k]
        found += [(q, rank, c, -s) for rank, (s, c) in enumerate(best, 1)]
    return sorted(found)


def rows(df):
    return sorted((r["question_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


def assert_same(got, expected):
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in expected], abs=1e-8)


# In the second way there are several slices of questions, and samples of samples are searched ahead.
WAYS = [{}, {"slice_bytes": 4000, "first_rows": 60, "growth": 4}]


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("text_ids", [False, True])
def test_vector_search(spark, way, text_ids):
    chunks, questions = unit_vectors(400, 8, 1), unit_vectors(60, 8, 2)
    chunks[:130] = chunks[0]  # a third are copies of one vector
    questions[:25] = chunks[0]  # and many questions ask for it
    chunks[200] = 0
    name = (lambda p, n: [f"{p}{i}" for i in range(n)]) if text_ids else (lambda p, n: list(range(n)))
    question_ids, chunk_ids = name("q", 60), name("c", 400)
    found = retrieval.topk_by_vector(
        as_table(spark, question_ids, questions, "question_id", "question_vector"),
        as_table(spark, chunk_ids, chunks, "chunk_id", "text_vector"),
        K,
        **way,
    )
    assert_same(rows(found), brute_vector(question_ids, questions, chunk_ids, chunks, K))


@pytest.mark.parametrize("way", WAYS)
def test_fewer_chunks_than_k(spark, way):
    chunks, questions = unit_vectors(3, 8, 3), unit_vectors(5, 8, 4)
    found = retrieval.topk_by_vector(
        as_table(spark, list(range(5)), questions, "question_id", "question_vector"),
        as_table(spark, list(range(3)), chunks, "chunk_id", "text_vector"),
        K,
        **way,
    )
    assert_same(rows(found), brute_vector(list(range(5)), questions, list(range(3)), chunks, K))


@pytest.mark.parametrize("way", WAYS)
def test_nothing_to_search(spark, way):
    vectors = as_table(spark, [1, 2], unit_vectors(2, 8, 5), "question_id", "question_vector")
    empty = spark.createDataFrame([], "chunk_id BIGINT, text_vector ARRAY<FLOAT>")
    assert retrieval.topk_by_vector(vectors, empty, K, **way).count() == 0
    chunks = vectors.select(F.col("question_id").alias("chunk_id"), F.col("question_vector").alias("text_vector"))
    assert retrieval.topk_by_vector(vectors.limit(0), chunks, K, **way).count() == 0


def test_vectors_of_different_length_fail(spark):
    questions = as_table(spark, [1], unit_vectors(1, 8, 5), "question_id", "question_vector")
    chunks = as_table(spark, [1], unit_vectors(1, 4, 5), "chunk_id", "text_vector")
    with pytest.raises(Exception, match="question vectors have 8 numbers, chunk vectors 4"):
        retrieval.topk_by_vector(questions, chunks).collect()


WORDS = ["the", "of", "and"] + [f"w{i}" for i in range(40)]


def sentences(count, seed, length=12):
    rng = random.Random(seed)
    # The first words are in almost every text.
    return [" ".join(rng.choice(WORDS[:3] if rng.random() < 0.4 else WORDS) for _ in range(rng.randint(1, length))) for _ in range(count)]


def brute_text(questions, chunks):
    """Per question all chunks that share a word, best first: [(chunk, score)]."""
    split = [re.findall(r"\w+", t) for t in chunks]
    mean = sum(map(len, split)) / len(split)
    frequency = Counter(w for ws in split for w in set(ws))
    ranked = {}
    for q, question in enumerate(questions):
        scores = {}
        for c, ws in enumerate(split):
            counts = Counter(ws)
            score = 0.0
            for w in re.findall(r"\w+", question):
                if counts[w]:
                    idf = math.log(1 + (len(split) - frequency[w] + 0.5) / (frequency[w] + 0.5))
                    score += idf * counts[w] / (counts[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean))
            if any(counts[w] for w in re.findall(r"\w+", question)):
                scores[c] = round(score, 9)
        ranked[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    return ranked


@pytest.fixture
def texts(spark):
    questions, chunks = sentences(30, 1, 6) + ["nothing shared", "..."], sentences(300, 2)
    chunks[:100] = [chunks[0]] * 100  # a third are copies
    return questions, chunks


def text_tables(spark, questions, chunks, width=16):
    q = spark.createDataFrame(list(enumerate(questions)), "question_id BIGINT, question STRING").repartition(3)
    c = spark.createDataFrame(list(enumerate(chunks)), "chunk_id BIGINT, chunk STRING").repartition(5)
    client = embedding.hashed_terms(width)
    return (
        embedding.embed_text(q, "question", "question_vector", client),
        embedding.embed_text(c, "chunk", "text_vector", client),
    )


@pytest.mark.parametrize("way", WAYS)
def test_text_search(spark, texts, way):
    questions, chunks = texts
    q, c = text_tables(spark, questions, chunks)
    expected = [
        (question, rank, chunk, score)
        for question, ranked in brute_text(questions, chunks).items()
        for rank, (chunk, score) in enumerate(ranked[:K], 1)
    ]
    assert_same(rows(lexical.topk_by_text(q, c, K, **way)), sorted(expected))


@pytest.mark.parametrize("recall", [K, 20, None])
@pytest.mark.parametrize("way", WAYS)
def test_hybrid_search(spark, texts, way, recall):
    """The fusion equals that of the two full lists."""
    questions, chunks = texts
    q, c = text_tables(spark, questions, chunks)
    embed = embedding.hashed_terms(16)()
    by_vector = brute_vector(range(len(questions)), embed(questions), range(len(chunks)), embed(chunks), K)
    by_text = brute_text(questions, chunks)
    expected = []
    for number in range(len(questions)):
        score = Counter()
        for question, rank, chunk, _ in by_vector:
            if question == number:
                score[chunk] += 1 / (60 + rank)
        for rank, (chunk, _) in enumerate(by_text[number][:recall], 1):
            score[chunk] += 1 / (60 + rank)
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:K]
        expected += [(number, rank, chunk, s) for rank, (chunk, s) in enumerate(best, 1)]
    assert_same(rows(lexical.topk_hybrid(q, c, K, text_recall=recall, **way)), sorted(expected))


def test_split_documents(spark):
    text = "".join(chr(97 + i % 26) for i in range(103))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, None), (5, text[:30])], "doc_id INT, text STRING")
    got = chunking.split_documents(df, size=30, overlap=10).orderBy("doc_id", "chunk_no").collect()
    pieces = {}
    for r in got:
        assert r["chunk_id"] == f"{r['doc_id']}:{r['chunk_no']}"
        pieces.setdefault(r["doc_id"], []).append(r["chunk"])
    assert set(pieces) == {1, 2, 5}
    assert pieces[2] == ["short"] and pieces[5] == [text[:30]]
    assert pieces[1][0] == text[:30] and all(a[-10:] == b[:10] for a, b in zip(pieces[1], pieces[1][1:]))
    assert pieces[1][0] + "".join(p[10:] for p in pieces[1][1:]) == text
    with pytest.raises(ValueError):
        chunking.split_documents(df, size=10, overlap=10)


def test_embedding_is_unit_length_and_uses_the_client(spark):
    df = spark.createDataFrame([("a b b",), ("",), (None,)], "x STRING")
    got = [r["v"] for r in embedding.embed_text(df, "x", "v").collect()]
    assert np.linalg.norm(got[0]) == pytest.approx(1) and got[1] == got[2] == [0.0] * 64
    own = embedding.embed_text(df, "x", "v", lambda: lambda texts: [[float(len(t or ""))] for t in texts], concurrency=2)
    assert sorted(r["v"] for r in own.collect()) == [[0.0], [0.0], [5.0]]


def test_samples_grow_to_the_chunks():
    assert retrieval.shares(1 << 17) == []
    assert retrieval.shares((1 << 17) + 1) == [256]
    assert retrieval.shares(10**9) == [256**2, 256]
    assert retrieval.shares(10**6, 100, 10) == [10**4, 1000, 100, 10]


def test_tasks_pass_on_rows_by_the_questions(spark):
    """With floors from a sample, 60 tasks pass on little more than one task would."""
    chunks, questions = unit_vectors(6000, 8, 7), unit_vectors(20, 8, 8)
    passed = []

    def scan(chunks_, floor):
        ids, vectors = list(range(20)), questions

        def run(batches):
            best = ranking.BestChunks(20, K, floor)
            unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
            for batch in batches:
                ranking.add_similarities(best, unit, ranking.vector_matrix(batch.column(1)), ranking.identifiers(batch.column(0)))
            yield best.table(np.array(ids), out)

        schema = retrieval.result_schema(T.LongType(), T.LongType())
        out = retrieval.arrow_schema(schema)
        found = chunks_.mapInArrow(run, schema)
        passed.append(found.count())
        return found

    table = as_table(spark, list(range(6000)), chunks, "chunk_id", "text_vector").repartition(60)
    found = retrieval.search_with_floors(table, 6000, np.arange(20), K, scan, first_rows=500, growth=16)
    assert_same(rows(retrieval.keep_best(found, K)), brute_vector(list(range(20)), questions, list(range(6000)), chunks, K))
    assert len(passed) == 2 and passed[1] < 20 * K * 16 * 1.5 < 20 * K * 60


def test_bounds_of_words_leave_no_match_out():
    """Scores at or above a floor, from postings with pruning, against plain sums."""
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.3, (80, 30)) * (rng.random((80, 30)) < 0.5)
    lengths = counts.sum(1) + 1
    lists = [np.flatnonzero(c).astype(np.int32) for c in counts]
    postings = bm25.Postings(
        pa.array(lists, pa.list_(pa.int32())), pa.array([c[i].astype(np.int32) for c, i in zip(counts, lists)], pa.list_(pa.int32())),
        lengths, 30, lengths.mean(),
    )
    weight = rng.random((25, 30)) * (rng.random((25, 30)) < 0.4)
    weight[7] = 0
    question, term = np.nonzero(weight)
    terms = bm25.QuestionTerms(question, term, weight[question, term], 25)
    saturated = counts / (counts + 1.2 * (0.25 + 0.75 * (lengths / lengths.mean())[:, None]))
    scores = ranking.rounded(weight @ saturated.T)
    for floor in (np.full(25, -np.inf), rng.random(25) * 2, np.where(np.arange(25) % 3 == 0, np.inf, 0.4)):
        found = [x for x in terms.matches(postings, floor)]
        got = {(q, r): s for qs, rs, ss in found for q, r, s in zip(qs, rs, ss)}
        expected = {(q, r): scores[q, r] for q, r in zip(*np.nonzero((scores >= floor[:, None]) & (scores > 0)))}
        assert got == pytest.approx(expected)
    q, r = np.nonzero(scores >= 0)
    assert terms.of_pairs(postings, q, r) == pytest.approx(scores[q, r])


def test_the_filter_of_ids_keeps_them_and_drops_others(spark, monkeypatch):
    ids = spark.range(0, 30000, 3).selectExpr("cast(id as string) as chunk_id")
    table = spark.range(30000).selectExpr("cast(id as string) as chunk_id")
    for most in (membership.MOST_BYTES, 64):
        monkeypatch.setattr(membership, "MOST_BYTES", most)
        passed = table.filter(membership.may_be_among(F.col("chunk_id"), ids, 10000))
        assert passed.join(ids, "chunk_id").count() == 10000
        assert passed.count() < 12000 or most == 64
    assert table.filter(membership.may_be_among(F.col("chunk_id"), ids.limit(0), 0)).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [0, 64 << 20])
def test_retrieved_texts_come_with_their_rank(spark, texts, monkeypatch, capsys, broadcast_bytes):
    monkeypatch.setattr(rag, "FOUND_BYTES_TO_BROADCAST", broadcast_bytes)
    q, c = text_tables(spark, *texts)
    c = c.withColumns({"title": F.concat(F.lit("t"), "chunk_id"), "metadata": F.create_map(F.lit("a"), F.lit("b"))})
    for search in ("vector", "hybrid"):
        found = rag.retrieve(q, c, 3, search).collect()
        assert len(found) == 3 * len(texts[0])
        for r in found:
            assert r["title"] == f"t{r['chunk_id']}" and r["chunk"] == texts[1][r["chunk_id"]]
    rag.retrieve(q, c, 3, "vector").explain("formatted")
    plan = capsys.readouterr().out
    assert ("getbit" in plan) == (broadcast_bytes == 0)
    with pytest.raises(ValueError):
        rag.retrieve(q, c, 3, "random")
    with pytest.raises(ValueError):
        rag.retrieve(q, c.drop("text_vector"), 3)


def test_memory_of_the_embedder_does_not_grow_with_its_batch():
    """Words of a batch are held for a part of its texts at a time, with the same vectors."""
    import tracemalloc

    texts = [f"word{i} " + " ".join(f"w{i * j % 9973}" for j in range(300)) for i in range(4000)] + [None, ""]
    embed = embedding.hashed_terms()()
    tracemalloc.start()
    found = embed(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    assert np.array_equal(found, np.concatenate([embed([t]) for t in texts]))
    assert embed([]).shape == (0, 64)


def unit_rows(numbers):
    return numbers / np.linalg.norm(numbers, axis=1, keepdims=True)


def test_scores_are_held_for_a_tile():
    """A batch of any length is scored in tiles, so no array holds a score for each question and chunk."""
    import tracemalloc

    rng = np.random.default_rng(11)
    asked, vectors = unit_rows(rng.normal(size=(300, 8))), unit_rows(rng.normal(size=(40_000, 8)))
    best = ranking.BestChunks(300, K)
    tracemalloc.start()
    ranking.add_similarities(best, asked, vectors, np.arange(40_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    scores = ranking.rounded(asked @ vectors.T)
    assert [sorted(best.chunks[q].tolist()) for q in range(300)] == np.sort(np.argsort(-scores, axis=1)[:, :K]).tolist()


@pytest.mark.parametrize("floors", [False, True])
def test_doubles_decide_between_near_equal_scores(floors):
    """Scores that single precision cannot tell apart, equal scores and vectors with a missing number."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(4, 32))
    vectors = np.repeat(base, 500, axis=0) + 10.0 ** rng.integers(-9, -5, size=(2000, 1)) * rng.normal(size=(2000, 32))
    vectors[::7] = vectors[0]
    vectors = unit_rows(vectors)
    vectors[5::400] = np.nan
    asked = unit_rows(np.concatenate([base, rng.normal(size=(600, 32))]))
    ids = np.array([f"{(i * 7919) % 2000}:0" for i in range(2000)], object)
    scores = ranking.rounded(asked @ vectors.T)
    known = ~np.isnan(scores[0])
    expected = [sorted(zip((-s[known]).tolist(), ids[known].tolist(), strict=True))[:K] for s in scores]
    best = ranking.BestChunks(len(asked), K, np.array([-e[-1][0] for e in expected]) if floors else None)
    for start in range(0, 2000, 900):
        ranking.add_similarities(best, asked, vectors[start : start + 900], ids[start : start + 900])
    assert best.chunks.tolist() == [[i for _, i in e] for e in expected]
    assert np.array_equal(best.scores, [[-s for s, _ in e] for e in expected])


def test_ids_are_compared_for_equal_scores_alone():
    compared = []

    class Id(str):
        def __lt__(self, other):
            compared.append((self, other))
            return str(self) < str(other)

    best = ranking.BestChunks(1, K)
    ids = np.array([Id(f"{i:03}") for i in range(300)], object)
    best.add_pairs(np.zeros(300, int), np.linspace(0, 1, 300), ids)
    assert not compared and best.chunks[0].tolist() == ["299", "298", "297", "296", "295"][:K]
    best.add_pairs(np.zeros(3, int), np.full(3, best.scores[0, K - 1]), np.array([Id("000"), Id("001"), Id("zzz")], object))
    assert best.chunks[0].tolist() == [*["299", "298", "297", "296", "295"][: K - 1], "000"]


def test_samples_of_the_vector_search_are_1_in_16():
    """Beyond FIRST_ROWS chunks, tasks pass on about VECTOR_GROWTH times k chunks of a question, not k each."""
    assert retrieval.shares(retrieval.FIRST_ROWS * 2, growth=retrieval.VECTOR_GROWTH) == [16]
    assert retrieval.shares(10**7, growth=retrieval.VECTOR_GROWTH) == [256, 16]


def test_offline_vectors_of_any_script():
    """Words are lower-case runs of letters and digits, their places the first 8 digits of their MD5."""
    import hashlib
    import re

    texts = ["Ünï_code ÀÉ²½ªµ ÿ\x85\xa0b", "ΑΣ ΑΣΑ ﬁ 中文 ٣٤", "It’s 10 o'clock", "a_b-a B", "_", "", None]
    expected = np.zeros((len(texts), 64))
    for row, text in enumerate(texts):
        for word in re.findall(r"[^\W_]+", (text or "").lower()):
            expected[row, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 64] += 1
    length = np.linalg.norm(expected, axis=1, keepdims=True)
    assert np.allclose(embedding.hashed_terms()()(texts), expected / np.where(length == 0, 1, length), atol=1e-7)


def test_places_are_right_after_more_words_than_are_remembered(monkeypatch):
    texts = [" ".join(f"w{i * j % 97}" for j in range(50)) for i in range(40)]
    expected = embedding.hashed_terms()()(texts)
    monkeypatch.setattr(embedding, "_WORDS", 5)
    assert np.array_equal(embedding.hashed_terms()()(texts), expected)
