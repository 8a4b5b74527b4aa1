"""Running a truth set through the system and scoring every answer."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed
from askgrid.operators import summary
from askgrid.operators.columns import drop_empty_columns, move_last
from askgrid.operators.embedding import Embedder, embed_text
from askgrid.operators.judging import Judges, score_responses
from askgrid.plans.rag import GeneratorClient, turn_answers
from askgrid.session import materialise

CONTEXT_COLUMNS = ("retrieved_files", "retrieved_contents")


def score_and_arrange(answers: DataFrame, judges: Judges | None = None) -> DataFrame:
    """Score answers and put the two wide context columns at the far right."""
    return move_last(score_responses(answers, judges), CONTEXT_COLUMNS)


def summaries(
    scored: DataFrame,
    models: Mapping[str, str],
    document_types: Sequence[str] = fixed.DOCUMENT_TYPES,
) -> DataFrame:
    """All summaries of an evaluation as rows `summary, model, question_type, document_type, measure, value`.

    `scored` is a written evaluation with `model, question_type, document_type, unambiguous`; every summary reads
    it, so nothing is judged again. `models` are the names and tags of the models that responses are counted for.
    """
    key = ["summary", "model", "question_type", "document_type"]

    def rows(name: str, summary: DataFrame, *measures: str) -> DataFrame:
        known = {c: F.col(c) if c in summary.columns else F.lit(None).cast("string") for c in key[1:]}
        values = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]
        wide = summary.select(F.lit(name).alias("summary"), *[c.alias(n) for n, c in known.items()], F.explode(F.array(*values)).alias("v"))
        return wide.select(*key, "v.*")

    parts = [
        rows("scores", summary.scores_by_document_type(scored, t).withColumn("question_type", F.lit(t)), *summary.MEASURES)
        for t in fixed.QUESTION_TYPES
    ]
    parts.append(rows("matches", summary.percentage_match(scored, document_types), "percentage_match"))
    errors = ("mean_correctness", "standard_error", "n")
    parts.append(rows("correctness by model", summary.correctness_by_model(scored), *errors))
    parts.append(rows("correctness", summary.correctness_by_facet(scored, document_types), *errors))
    counts = summary.response_counts(scored, models)
    parts.append(rows("responses", counts, *counts.columns))
    return functools.reduce(DataFrame.unionByName, parts)


def evaluate_truth_set(
    truth_set: DataFrame,
    chunks: DataFrame,
    k: int = fixed.MULTI_TURN_K,
    search: str = "hybrid",
    embedder: Callable[[], Embedder] | None = None,
    generator: Callable[[], GeneratorClient] | None = None,
    judges: Judges | None = None,
    concurrency: int | None = None,
) -> DataFrame:
    """Answer and score a truth set: `row_id, question, true_answer, file, ...` and its results.

    Columns that are empty in every row are left out. Rows are joined by `row_id`, never by
    their order. Answers are written before the judges read them, and scores before anything
    reads them, so each model is called once per row, at most `concurrency` calls at a time.
    """
    # Written, so that every later read sees the same row ids.
    truth = materialise(drop_empty_columns(truth_set), "truth")
    asked = truth.select(F.col("row_id").alias("question_id"), "question")
    asked = embed_text(asked, "question", "question_vector", embedder, concurrency)
    results = turn_answers(asked, chunks, k, search, generator, concurrency=concurrency).select(
        F.col("question_id").alias("row_id"),
        "answer",
        F.col("source_names").alias("retrieved_files"),
        F.col("source_contents").alias("retrieved_contents"),
    )
    answers = materialise(truth.join(results, "row_id"), "answered")
    if concurrency is not None:
        answers = answers.repartition(concurrency, "row_id")
    scored = score_and_arrange(answers, judges)
    return materialise(scored, "scored") if judges is not None and judges.call_clients else scored
