"""The k chunks most similar to each question, by cosine of their vectors. Exact.

One plan for any number of questions and chunks. Questions are cut into slices of bounded size; a slice
goes to every task, and the chunks are scanned where they lie, once for each slice. Vectors are not shuffled.

What tasks pass on is bounded by the questions, not by tasks times questions: a sample of the chunks is
searched first, and a question's k-th best score there is a floor that its best k of all chunks reach, so
tasks pass on only chunks at or above it. The sample is searched in the same way (see `shares`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from askgrid.functions import fixed_values as fixed
from askgrid.functions.ranking import BestChunks, add_similarities, identifiers, vector_matrix
from askgrid.session import materialise, materialise_measured

#: Bytes of questions in a slice.
SLICE_BYTES = 64 << 20
#: Chunks that are searched without a floor, the tasks that do it if they are a sample, and how many times more
#: chunks the next search may have. Each search passes on about that many times k rows per question.
FIRST_ROWS, FIRST_TASKS, GROWTH = 1 << 17, 8, 256
#: The same for vectors: a sample of 1 in 16 costs little next to the rows that a looser floor lets through.
VECTOR_GROWTH = 16

Share = Callable[[object], Broadcast]


def result_schema(question_id: T.DataType, chunk_id: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("question_id", question_id),
            T.StructField("chunk_id", chunk_id),
            T.StructField("score", T.DoubleType()),
        ]
    )


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])


def keep_best(scored: DataFrame, k: int) -> DataFrame:
    """Merge the tasks' best chunks: rank 1..k per question, ties by chunk id."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("question_id", "rank", "chunk_id", "score")
    )


def slices(questions: DataFrame, size: Column, slice_bytes: int) -> Iterator[DataFrame]:
    """The questions, written, in parts of about `slice_bytes` by a hash of their id. `size`: bytes of a question."""
    questions, sums = materialise_measured(questions, "questions", bytes=size.cast("long"))
    total = sums["bytes"]
    parts = max(1, -(-total // slice_bytes))
    part = F.pmod(F.xxhash64("question_id"), F.lit(parts))
    for number in range(parts if total else 0):
        yield questions if parts == 1 else questions.filter(part == number)


def each_slice(
    parts: Iterator[DataFrame], search: Callable[[DataFrame, Share], DataFrame], name: str
) -> DataFrame | None:
    """The written results of `search(slice, share)` for all slices; None if there are none.

    `share` sends a value to the tasks. What a slice has sent is let go once its result is written.
    """
    found = None
    for part in parts:
        sent: list[Broadcast] = []

        def share(value, sent=sent):
            sent.append(part.sparkSession.sparkContext.broadcast(value))
            return sent[-1]

        result = materialise(search(part, share), name)
        found = result if found is None else found.unionByName(result)
        for value in sent:
            value.unpersist()
    return found


def shares(rows: int, first_rows: int = FIRST_ROWS, growth: int = GROWTH) -> list[int]:
    """The samples to search ahead of `rows` chunks, each as one of how many chunks it has, smallest first."""
    found, share = [], growth
    while rows * growth > first_rows * share:
        found.append(share)
        share *= growth
    return found[::-1]


def search_with_floors(
    chunks: DataFrame,
    rows: int,
    ids: np.ndarray,
    k: int,
    search: Callable[[DataFrame, np.ndarray], DataFrame],
    first_rows: int = FIRST_ROWS,
    growth: int = GROWTH,
) -> DataFrame:
    """`search(chunks, floor)` over all chunks, with the floors that searches of samples have found.

    `search` gives `question_id, chunk_id, score`; `ids` are the questions of the slice and `floor` has a
    score for each of them. Only floors, one number per question of the slice, pass through the driver.
    """
    place = {q: i for i, q in enumerate(ids.tolist())}
    floor = np.full(len(ids), -np.inf)
    for number, share in enumerate(shares(rows, first_rows, growth)):
        sample = chunks.filter(F.pmod(F.xxhash64("chunk_id", F.lit("sample")), F.lit(share)) == 0)
        best = keep_best(search(sample if number else sample.repartition(FIRST_TASKS), floor), k)
        floor = floor.copy()
        for row in best.filter(F.col("rank") == k).select("question_id", "score").toArrow().to_pylist():
            floor[place[row["question_id"]]] = row["score"]
    return search(chunks, floor)


def topk_by_vector(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = fixed.MULTI_TURN_K,
    *,
    question_vector: str = "question_vector",
    chunk_vector: str = fixed.CHUNK_VECTOR_FIELD,
    slice_bytes: int = SLICE_BYTES,
    first_rows: int = FIRST_ROWS,
    growth: int = VECTOR_GROWTH,
) -> DataFrame:
    """Rows `question_id, rank, chunk_id, score`, k per question (fewer if there are fewer chunks).

    `questions` needs a unique `question_id` and `chunks` a unique `chunk_id`. Rows without a
    vector are not searched. The cosine is kept to 9 decimals; ties go to the lower chunk id.
    """
    questions = questions.select("question_id", F.col(question_vector).alias("vector")).filter("vector is not null")
    rows = chunks.select("chunk_id").count()
    chunks = chunks.select("chunk_id", F.col(chunk_vector).alias("vector")).filter("vector is not null")
    schema = result_schema(questions.schema["question_id"].dataType, chunks.schema["chunk_id"].dataType)
    out = arrow_schema(schema)

    def searched(part: DataFrame, share: Share) -> DataFrame:
        collected = part.toArrow()
        asked = share((identifiers(collected["question_id"]), vector_matrix(collected["vector"])))

        def search(chunks: DataFrame, floor: np.ndarray) -> DataFrame:
            floors = share(floor)

            def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                question_ids, question_vectors = asked.value
                best = BestChunks(len(question_ids), k, floors.value)
                for batch in batches:
                    add_similarities(best, question_vectors, vector_matrix(batch.column(1)), identifiers(batch.column(0)))
                yield best.table(question_ids, out)

            return chunks.mapInArrow(score, schema)

        return keep_best(search_with_floors(chunks, rows, asked.value[0], k, search, first_rows, growth), k)

    found = each_slice(slices(questions, 8 * F.size("vector") + 64, slice_bytes), searched, "by_vector")
    return keep_best(questions.sparkSession.createDataFrame([], schema), k) if found is None else found
