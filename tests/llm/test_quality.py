"""The compression classifier: held-out accuracy and edge cases."""

import zlib

from askgrid.llm import quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in quality.op10_quality(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    right = [got[r["doc_id"]]["predicted"] == r["quality"] for r in held]
    lost = [r for r in held if r["quality"] == 1 and got[r["doc_id"]]["predicted"] == 0]
    assert sum(right) / len(right) > 0.98 and len(lost) / len(held) < 0.01


def test_held_out_labels_are_not_learnt(documents, spark, prose):
    rows = [(i, prose(i, 60) if i % 2 else "## !! ## " * 20) for i in range(400)]
    labels = [(i, i % 2) for i, _ in rows]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    scores = []
    for each in (labels, turned):
        df = spark.createDataFrame(each, "doc_id LONG, quality INT")
        scores.append({r["doc_id"]: r["score"] for r in quality.judge_documents(documents(rows), df).collect()})
    assert scores[0] == scores[1]
    assert all((scores[0][i] >= 0.5) == bool(q) for i, q in labels)


def test_nulls_repeats_long_and_missing_labels(documents, spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x"), (3, "long words " * 30000)]
    schema = "doc_id LONG, quality INT"
    for labels, score in (([], 0.5), ([(1, 1), (None, 0), (2, None)], None)):
        got = quality.judge_documents(documents(rows), spark.createDataFrame(labels, schema)).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert score is None or {r["score"] for r in got} == {score}
        assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert quality.judge_documents(documents([]), spark.createDataFrame([], schema)).count() == 0


def test_rows_of_one_labelled_id_are_one_row_to_the_fit(documents, spark, prose):
    rows = [(i, prose(i, 60) if i % 2 else "## !! ## " * 20) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id LONG, quality INT")
    once, often = (quality.fit_quality(documents(r), labels) for r in (rows, rows + rows[:9] * 40))
    assert once.good == often.good and once.bad == often.bad and abs(once.weights - often.weights).max() < 1e-9


def test_other_columns_pass(documents, spark):
    model = quality.fit_quality(documents([]), spark.createDataFrame([], "doc_id LONG, quality INT"))
    df = documents([(1, "a")])
    result = quality.score_quality(df, model)
    assert set(result.columns) == set(df.columns) | {"score"} and result.first()["score"] == 0.5
