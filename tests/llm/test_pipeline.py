"""The pipeline's stages: each stage's decisions, odd rows, and the whole against its parts."""

import pytest

import corpus_pipeline
from askgrid.llm import byte_bpe

SMALL = "/root/testdata/sf0.01"


@pytest.fixture
def folder(spark, documents, prose, tmp_path):
    """Tables with odd rows: nulls, copies, long texts, repeated ids, further columns."""
    item = prose(77, 20)
    passage = prose(78, 60)
    rows = [(i, prose(i, 40 + i % 60)) for i in range(60)] + [(100 + i, "## !! ## " * 30) for i in range(40)]
    rows += [(200, prose(3, 43)), (201, f"{prose(5, 45)} x"), (202, f"{prose(300, 40)} {passage}"), (203, f"{prose(301, 40)} {passage}")]
    rows += [(204, f"{prose(302, 40)} {item}"), (None, prose(303, 50)), (205, None), (206, ""), (7, prose(7, 47)), (207, prose(304, 30000))]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id LONG, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder, tmp_path, prose):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{number}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        kept.append(rows)
        assert number == 4 or docs.columns == columns
    ids = [{r["doc_id"] for r in rows} for rows in kept]
    assert not ids[0] & set(range(100, 140)) and set(range(60)) <= ids[0] and None in ids[0]
    assert {200, 201} <= ids[0] and not ids[1] & {200, 201}
    assert len(kept[1]) == len(ids[1]) and set(range(60)) <= ids[1]
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept[2]}
    own = prose(301, 40)
    assert texts[203] == (own, len(own)) and prose(78, 60) in texts[202][0]
    assert ids[3] == ids[2] - {204}
    assert ids[4] == ids[3] and all(r["round_trip"] for r in kept[4])
    by_id = {r["doc_id"]: r for r in kept[4]}
    encoded, _ = byte_bpe.Encoder(byte_bpe.public_vocabulary()).encode([own])
    assert by_id[203]["ids"] == encoded.tolist() and by_id[203]["n_tokens"] == len(encoded)


def test_near_copies_go_by_row_not_by_id(spark, documents, prose):
    """Several null ids, and one id on two texts: a row goes only if its own text is linked to one that stays."""
    text = {i: prose(400 + i, 60) for i in range(8)}
    copy = {i: f"{t} x" for i, t in text.items()}
    rows = [(3, text[3]), (7, text[0]), (7, copy[3]), (8, text[1]), (8, text[2]), (9, text[7]), (9, text[7])]
    rows += [(None, text[4]), (None, text[5]), (None, copy[3]), (None, text[6]), (None, text[6]), (None, copy[6])]
    rows += [(None, ""), (None, None), (10, ""), (10, "")]
    got = corpus_pipeline.ngram_jaccard_join(spark, documents(rows), "")
    got = sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str)
    of_six = [r for r in got if r in ((None, text[6]), (None, copy[6]))]
    assert len(of_six) == 1
    stay = [(3, text[3]), (7, text[0]), (8, text[1]), (8, text[2]), (9, text[7]), (10, "")]
    stay += [(None, text[4]), (None, text[5]), (None, ""), (None, None), *of_six]
    assert got == sorted(stay, key=str)


def test_run_equals_its_stages_and_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / f"s{number}"))
        docs = spark.read.parquet(str(tmp_path / f"s{number}"))
    order = lambda df: sorted([tuple(r) for r in df.collect()], key=str)
    assert order(corpus_pipeline.run(spark, SMALL)) == order(docs)
    none = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0


def test_texts_are_shuffled_once_for_the_copies(spark, documents, prose):
    rows = [(i, prose(600 + i, 60)) for i in range(20)] + [(3, prose(603, 60)), (40, f"{prose(605, 60)} x")]
    kept = corpus_pipeline.ngram_jaccard_join(spark, documents(rows), "")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20))
