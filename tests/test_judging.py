import os
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed
from askgrid.operators import judging

Q = "What is the capital of France?"
REFERENCE = "The capital of France is Paris."
CORRECT = "Paris is the capital of France."
WRONG_1 = "Marseille is the capital of France"
WRONG_2 = "Madrid is the capital of Spain"
CHUNK_1 = "European capitals: UK=London, France=Paris, Spain=Madrid, Germany=Berlin"
CHUNK_2 = "French cities: Marseille, Paris (capital), Lyon, Versailles"
CHUNK_3 = "Spanish cities: Barcelona, Madrid (capital), Seville"
EU, FR, ES = "european_capitals.txt", "french_cities.txt", "spanish_cities.txt"

# answer, contexts, documents, correctness, retrieval, groundedness, match
CASES = [
    (CORRECT, [CHUNK_1, CHUNK_2], [EU], 10, 10, 10, True),
    (CORRECT, [CHUNK_3], [ES], 10, 1, 1, False),
    (WRONG_1, [CHUNK_1, CHUNK_2], [EU, FR], 1, 10, 1, True),
    (WRONG_2, [CHUNK_3], [ES, EU], 1, 1, 10, False),
    (WRONG_1, [CHUNK_3], [ES, EU], 1, 1, 1, False),
]
SCHEMA = (
    "id INT, question STRING, answer STRING, true_answer STRING, file STRING, retrieved_files ARRAY<STRING>, "
    "retrieved_contents ARRAY<STRING>"
)


def answers(spark, rows):
    return spark.createDataFrame(
        [(i, Q, a, REFERENCE, EU, docs, context) for i, (a, context, docs, *_) in enumerate(rows)], SCHEMA
    )


def scripted():
    """A judge that knows the expected scores by the texts it is shown."""
    correct = {CORRECT: "10", WRONG_1: "1", WRONG_2: "1"}
    good_context = {str([CHUNK_1, CHUNK_2])}
    grounded = {(CORRECT, str([CHUNK_1, CHUNK_2])), (WRONG_2, str([CHUNK_3]))}

    def reply(pairs):
        replies = []
        for instruction, prompt in pairs:
            answer = next((a for a in correct if f"Generated answer: {a}\n" in prompt), None)
            context = next((str(c) for c in ([CHUNK_1, CHUNK_2], [CHUNK_3], []) if str(c) in prompt), None)
            if instruction == fixed.CORRECTNESS_RUBRIC:
                replies.append(correct[answer])
            elif instruction == fixed.RETRIEVAL_RUBRIC:
                replies.append(" 10\n" if context in good_context else "1")
            elif instruction == fixed.GROUNDEDNESS_RUBRIC:
                replies.append("10" if (answer, context) in grounded else "1")
            else:
                raise AssertionError(instruction)
        return replies

    return reply


def test_five_cases(spark):
    scored = judging.score_responses(answers(spark, CASES), judging.Judges.asking(scripted)).orderBy("id").collect()
    got = [(r["correctness"], r["retrieval"], r["groundedness"], r["document_match"]) for r in scored]
    assert got == [case[3:] for case in CASES]


def test_prompts(spark):
    row = answers(spark, CASES[:1]).select(
        judging.correctness_prompt(), judging.retrieval_prompt(), judging.groundedness_prompt()
    ).first()
    context = [CHUNK_1, CHUNK_2]
    assert row[0] == f"Question: {Q}\n\n    Reference answer: {REFERENCE}\n\n    Generated answer: {CORRECT}\n    "
    assert row[1].startswith(f"Question: {Q}\n\n    Retrieved context: {context}\n\n    How likely is it that")
    assert row[1].endswith("Only provide the score.\n    ")
    assert row[2].startswith(f"\n    Context/retrieved document: {context}\n\n    Generated answer: {CORRECT}\n\n    Score")
    assert row[2].endswith("(fully grounded). \n    Reply with only the score.\n    ")


def test_nothing_retrieved(spark):
    """Only correctness is judged, and the other judges are not even asked."""

    def careful():
        def reply(pairs):
            for instruction, prompt in pairs:
                if instruction != fixed.CORRECTNESS_RUBRIC:
                    assert "[]" not in prompt, "asked about an answer without retrieval"
            return ["4"] * len(pairs)

        return reply

    rows = answers(spark, [(CORRECT, [], []), (CORRECT, [CHUNK_1], [EU])])
    scored = judging.score_responses(rows, judging.Judges.asking(careful)).orderBy("id").collect()
    assert [(r["correctness"], r["retrieval"], r["groundedness"], r["document_match"]) for r in scored] == [
        (4, 0, 0, False),
        (4, 4, 4, True),
    ]
    offline = judging.score_responses(rows).orderBy("id").first()
    assert (offline["correctness"], offline["retrieval"], offline["groundedness"]) == (10, 0, 0)


def test_bad_reply(spark):
    def babbling():
        return lambda pairs: ["about 7"] * len(pairs)

    rows = answers(spark, CASES[:1])
    with pytest.raises(PySparkException, match="unexpected score: 'about 7'"):
        judging.score_responses(rows, judging.Judges.asking(babbling)).collect()
    lenient = judging.score_responses(rows, judging.Judges.asking(babbling, strict=False)).first()
    assert (lenient["correctness"], lenient["retrieval"], lenient["document_match"]) == (None, None, True)
    assert lenient["correctness_reply"] == lenient["groundedness_reply"] == "about 7"


def test_kept_replies(spark):
    """Only bad replies are kept, and each row is asked about once."""
    calls = spark.sparkContext.accumulator(0)

    def wavering():
        def reply(pairs):
            calls.add(len(pairs))
            return ["3" if CORRECT in p else "?" for _, p in pairs]

        return reply

    rows = answers(spark, [(CORRECT, [CHUNK_1], [EU]), (WRONG_1, [], [])])
    judges = judging.Judges.asking(wavering, strict=False)
    first, second = sorted(judging.score_responses(rows, judges).collect(), key=lambda r: r["id"])
    assert (first["correctness"], first["correctness_reply"], first["retrieval"]) == (3, None, None)
    assert first["retrieval_reply"] == "?"
    assert (second["correctness"], second["correctness_reply"]) == (None, "?")
    assert (second["retrieval"], second["retrieval_reply"]) == (0, None)
    assert calls.value == 4


def test_one_client_per_task(spark):
    """A client is made once per task, not once per row or batch."""
    made = spark.sparkContext.accumulator(0)

    def counted():
        made.add(1)
        return lambda pairs: ["5"] * len(pairs)

    rows = spark.range(5000).repartition(3).select(F.lit("p").alias("p"))
    rows.select(judging.ask(counted, "i", F.col("p"))).write.format("noop").mode("overwrite").save()
    assert made.value <= 3


def test_document_match(spark):
    rows = [
        (0, ["One Page Café.pdf"], " Café\n", True),
        (1, ["other.pdf", "x.pdf"], "x", False),  # only the first counts
        (2, [], "x", False),
        (3, None, "x", False),
        (4, ["X.pdf"], "x", False),
    ]
    df = spark.createDataFrame(rows, "id INT, retrieved_files ARRAY<STRING>, file STRING, expected BOOLEAN")
    for r in df.select("id", "expected", judging.document_match().alias("got")).collect():
        assert r["got"] == r["expected"], r["id"]


def overlap(df):
    for measure in ("correctness", "retrieval", "groundedness"):
        df = getattr(judging, f"OVERLAP_{measure.upper()}").add_score(df, measure)
    return df.select("correctness", "retrieval", "groundedness").first()


def test_overlap_scores(spark):
    row = overlap(answers(spark, CASES[:1]))
    assert row[0] == 10  # all six words agree
    question = {"what", "is", "the", "capital", "of", "france"}
    context = {"european", "capitals", "uk", "london", "france", "paris", "spain", "madrid", "germany", "berlin"}
    context |= {"french", "cities", "marseille", "paris", "capital", "lyon", "versailles"}
    answer = {"paris", "is", "the", "capital", "of", "france"}
    assert row[1] == 1 + int(9 * len(question & context) / 6 + 0.5)
    assert row[2] == 1 + int(9 * len(answer & context) / 6 + 0.5)
    assert tuple(overlap(spark.createDataFrame([(0, None, "", "", "f", [], [])], SCHEMA))) == (1, 1, 1)


def test_a_bad_strict_reply_loses_no_call(spark, tmp_path):
    """All replies are logged before they are read; a second run asks for the bad one alone."""
    calls, bad = spark.sparkContext.accumulator(0), str(tmp_path / "bad")
    Path(bad).touch()

    def judge():
        def replies(pairs):
            calls.add(len(pairs))
            wrong = os.path.exists(bad)
            return ["no idea" if wrong and "answer 3" in prompt else "7" for _, prompt in pairs]

        return replies

    rows = spark.createDataFrame(
        [(i, "q", f"answer {i}", "true", "f.pdf", ["f.pdf"], ["text"]) for i in range(6)],
        "row_id LONG, question STRING, answer STRING, true_answer STRING, file STRING, retrieved_files ARRAY<STRING>, "
        "retrieved_contents ARRAY<STRING>",
    )
    one = judging.ClientJudge(judge, "rubric", judging.correctness_prompt, True, str(tmp_path / "log"))
    with pytest.raises(Exception, match="no idea"):
        one.add_score(rows, "correctness").collect()
    assert calls.value == 6
    Path(bad).unlink()
    scored = one.add_score(rows, "correctness")
    assert calls.value == 7  # five good replies are kept
    assert [r["correctness"] for r in scored.collect()] == [7] * 6
    assert "correctness_reply" not in scored.columns
    one.add_score(rows, "correctness").collect()
    assert calls.value == 7
    with pytest.raises(ValueError, match="row_id"):
        one.add_score(rows.drop("row_id"), "correctness")
