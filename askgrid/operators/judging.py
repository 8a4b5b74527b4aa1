"""Scoring of answers: prompts for judges, judges, and the four measures of a response.

Answers are rows with `question, answer, true_answer, file, retrieved_files,
retrieved_contents`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.functions import fixed_values as fixed
from askgrid.functions.text import (
    clean_document_name,
    fill_template,
    nfc,
    parse_score,
    parse_score_strict,
    python_list,
    strip,
    tokens,
)
from askgrid.session import work_folder

# A judge's client takes (instruction, question) pairs and gives one reply for each.
JudgeClient = Callable[[Sequence[tuple[str, str]]], Sequence[str]]


# --- prompts -------------------------------------------------------------------------------
def correctness_prompt() -> Column:
    return fill_template(
        fixed.CORRECTNESS_TEMPLATE,
        {"question": F.col("question"), "reference": F.col("true_answer"), "answer": F.col("answer")},
    )


def retrieval_prompt() -> Column:
    return fill_template(
        fixed.RETRIEVAL_TEMPLATE,
        {"question": F.col("question"), "context": python_list(F.col("retrieved_contents"))},
    )


def groundedness_prompt() -> Column:
    return fill_template(
        fixed.GROUNDEDNESS_TEMPLATE,
        {"context": python_list(F.col("retrieved_contents")), "answer": F.col("answer")},
    )


# --- offline scores ------------------------------------------------------------------------
def _words(text: Column) -> Column:
    return F.array_distinct(tokens(F.coalesce(text, F.lit(""))))


# Distinct words of the texts that are compared, as columns of their own: a text is cut into
# words once per row, however often a score refers to them.
_WORD_COLUMNS = {
    "_question_words": lambda: _words(F.col("question")),
    "_answer_words": lambda: _words(F.col("answer")),
    "_reference_words": lambda: _words(F.col("true_answer")),
    "_context_words": lambda: _words(F.array_join("retrieved_contents", "\n")),
}


def _with_words(answers: DataFrame, names: Sequence[str]) -> DataFrame:
    return answers.withColumns({n: _WORD_COLUMNS[n]() for n in names})


def _one_to_ten(share: Column) -> Column:
    return (F.lit(1) + F.floor(F.coalesce(share, F.lit(0.0)) * 9 + 0.5)).cast("int")


def _share_in(words: str, context: str) -> Column:
    """Share of some distinct words that occur in the context."""
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, context)) / F.size(words))


def _overlap_correctness() -> Column:
    """F1 of the distinct words of the answer and the reference answer, on 1 to 10."""
    total = F.size("_answer_words") + F.size("_reference_words")
    common = F.size(F.array_intersect("_answer_words", "_reference_words"))
    return _one_to_ten(F.when(total > 0, common * 2 / total))


def _overlap_retrieval() -> Column:
    return _one_to_ten(_share_in("_question_words", "_context_words"))


def _overlap_groundedness() -> Column:
    return _one_to_ten(_share_in("_answer_words", "_context_words"))


# --- judges --------------------------------------------------------------------------------
def ask(client: Callable[[], JudgeClient], instruction: str, prompt: Column) -> Column:
    """The client's raw replies. Each task makes one client and sends it Arrow batches."""

    @F.pandas_udf(T.StringType())
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = client()
        for prompts in batches:
            yield pd.Series(list(judge([(instruction, p) for p in prompts])), dtype=object)

    return reply(prompt)


@dataclass(frozen=True)
class Judge:
    """Scores one measure with built-in functions over the answer rows and some word columns."""

    score: Callable[[], Column]
    words: tuple[str, ...] = ()
    calls_client = False

    def add_score(self, answers: DataFrame, measure: str) -> DataFrame:
        return _with_words(answers, self.words).withColumn(measure, self.score()).drop(*self.words)


OVERLAP_CORRECTNESS = Judge(_overlap_correctness, ("_answer_words", "_reference_words"))
OVERLAP_RETRIEVAL = Judge(_overlap_retrieval, ("_question_words", "_context_words"))
OVERLAP_GROUNDEDNESS = Judge(_overlap_groundedness, ("_answer_words", "_context_words"))


@dataclass(frozen=True)
class ClientJudge:
    """Scores one measure by asking a model.

    Replies are written by row and measure before they are read, to the folder `log` or else to the work folder, so
    a reply that can't be read loses no call. With the same `log` a second run asks only for rows without a good
    reply there. `key` tells rows apart; rows without that column are scored as they are read.

    Strict: a bad reply fails the job, once all are written. Else its score is null and the reply is kept in
    the column `<measure>_reply`, which is null for good replies.
    """

    client: Callable[[], JudgeClient]
    instruction: str
    prompt: Callable[[], Column]
    strict: bool = True
    log: str | None = None
    key: str = "row_id"
    calls_client = True

    def _replies(self, answers: DataFrame, measure: str, reply: str) -> DataFrame:
        """One reply per row of `answers`, good if there is a good one: from the log, and asked for otherwise."""
        spark = answers.sparkSession
        path = f"{self.log or work_folder(spark)}/measure={measure}"
        schema = T.StructType([answers.schema[self.key], T.StructField("reply", T.StringType())])
        spark.createDataFrame([], schema).write.mode("append").parquet(path)  # so that the folder is there
        logged = spark.read.schema(schema).parquet(path)
        good = logged.filter(parse_score(F.col("reply")).isNotNull()).select(self.key)
        waiting = answers.join(good, self.key, "left_anti")
        replies = ask(self.client, self.instruction, self.prompt()).alias("reply")
        waiting.select(self.key, replies).write.mode("append").parquet(path)
        logged = spark.read.schema(schema).parquet(path)
        readable = F.when(parse_score(F.col("reply")).isNotNull(), F.col("reply"))
        return logged.groupBy(self.key).agg(F.coalesce(F.min(readable), F.min("reply")).alias(reply))

    def add_score(self, answers: DataFrame, measure: str) -> DataFrame:
        reply = f"{measure}_reply"
        if self.key in answers.columns:
            asked = answers.join(self._replies(answers, measure, reply), self.key, "left")
        elif self.log is None:
            asked = answers.withColumn(reply, ask(self.client, self.instruction, self.prompt()))
        else:
            raise ValueError(f"a log of replies needs the column {self.key}")
        if self.strict:
            return asked.withColumn(measure, parse_score_strict(F.col(reply))).drop(reply)
        scored = asked.withColumn(measure, parse_score(F.col(reply)))
        return scored.withColumn(reply, F.when(F.col(measure).isNull(), F.col(reply)))


@dataclass(frozen=True)
class Judges:
    """One judge per measure, by default those that need no model."""

    correctness: Judge | ClientJudge = OVERLAP_CORRECTNESS
    retrieval: Judge | ClientJudge = OVERLAP_RETRIEVAL
    groundedness: Judge | ClientJudge = OVERLAP_GROUNDEDNESS

    @staticmethod
    def asking(
        client: Callable[[], JudgeClient],
        strict: bool = True,
        correctness_rubric: str = fixed.CORRECTNESS_RUBRIC,
        retrieval_rubric: str = fixed.RETRIEVAL_RUBRIC,
        groundedness_rubric: str = fixed.GROUNDEDNESS_RUBRIC,
        log: str | None = None,
    ) -> Judges:
        return Judges(
            ClientJudge(client, correctness_rubric, correctness_prompt, strict, log),
            ClientJudge(client, retrieval_rubric, retrieval_prompt, strict, log),
            ClientJudge(client, groundedness_rubric, groundedness_prompt, strict, log),
        )

    @property
    def call_clients(self) -> bool:
        return any(j.calls_client for j in (self.correctness, self.retrieval, self.groundedness))


# --- measures ------------------------------------------------------------------------------
def cleaned_names(retrieved_files: Column) -> Column:
    return F.transform(retrieved_files, clean_document_name)


def document_match() -> Column:
    """Whether the first retrieved document is the wanted one, both in Unicode NFC."""
    first = F.get(cleaned_names(F.col("retrieved_files")), F.lit(0))
    return F.coalesce(nfc(first) == nfc(strip(F.col("file"))), F.lit(False))


def was_retrieved() -> Column:
    return F.coalesce(F.size("retrieved_files"), F.lit(0)) > 0


def score_responses(answers: DataFrame, judges: Judges | None = None) -> DataFrame:
    """Add `correctness, retrieval, groundedness, document_match`.

    Without retrieved documents the last three are 0, 0 and false and only correctness is
    judged. Judges that call a client see only the rows they have to score: the rows are split
    first and united afterwards. `answers` is read once per side, so it should be a written
    table.
    """
    judges = judges or Judges()
    zero = F.lit(0)
    if not judges.call_clients:
        words = sorted({w for j in (judges.correctness, judges.retrieval, judges.groundedness) for w in j.words})
        scores = {
            "correctness": judges.correctness.score(),
            "retrieval": F.when(was_retrieved(), judges.retrieval.score()).otherwise(zero),
            "groundedness": F.when(was_retrieved(), judges.groundedness.score()).otherwise(zero),
            "document_match": document_match(),
        }
        return _with_words(answers, words).withColumns(scores).drop(*words)
    retrieved = judges.correctness.add_score(answers.filter(was_retrieved()), "correctness")
    retrieved = judges.retrieval.add_score(retrieved, "retrieval")
    retrieved = judges.groundedness.add_score(retrieved, "groundedness")
    retrieved = retrieved.withColumn("document_match", document_match())
    others = judges.correctness.add_score(answers.filter(~was_retrieved()), "correctness").withColumns(
        {"retrieval": zero, "groundedness": zero, "document_match": F.lit(False)}
    )
    # Kept replies of judges that these rows do not meet are null.
    return retrieved.unionByName(others, allowMissingColumns=True)
