"""BM25 search of chunks, and its fusion with the vector search. Exact.

One plan for any number of questions and chunks. Questions are cut into slices of bounded size. For a slice the
chunks' texts are cut into words once, where they lie, and written as postings: of each chunk its length
and, of the slice's words alone, which it has and how often. The searches read these numbers. In a task
they are turned into lists by word, and a question meets only the chunks that its weightier words are in (see
`functions.bm25`). No chunk is shuffled, and what tasks pass on is bounded as in the vector search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.functions import fixed_values as fixed
from askgrid.functions.bm25 import Marks, Postings, QuestionTerms, best_by_text
from askgrid.functions.ranking import BestChunks, identifiers
from askgrid.functions.text import tokens
from askgrid.operators.retrieval import (
    FIRST_ROWS,
    GROWTH,
    SLICE_BYTES,
    Share,
    arrow_schema,
    each_slice,
    keep_best,
    result_schema,
    search_with_floors,
    slices,
    topk_by_vector,
)
from askgrid.session import materialise_measured

FUSION_CONSTANT = 60
#: Chunks whose words are looked up at a time.
INDEX_ROWS = 1024


def _question_words(questions: DataFrame, question: str) -> DataFrame:
    """question_id and words, of the questions that have any."""
    words = questions.select("question_id", tokens(F.col(question)).alias("words"))
    return words.filter(F.size("words") > 0)


def _size(k: int):
    """Bytes that a question takes in the tasks: its words, and k chunks with their scores."""
    return F.octet_length(F.array_join("words", " ")) + 48 * F.size("words") + 96 * k


class _TextSearch:
    """A slice of the questions with the weights of their words, and the postings of these words."""

    def __init__(self, part: DataFrame, chunks: DataFrame, text: str, share: Share):
        collected = part.toArrow()
        self.share = share
        self.ids = identifiers(collected["question_id"])
        lists = collected["words"].combine_chunks()
        words = lists.flatten().dictionary_encode()
        self.vocabulary = words.dictionary
        index = self._index(chunks, text)
        self.postings, sums = materialise_measured(index, "postings", rows=F.lit(1), length=F.col("length"))
        self.rows, self.mean_length = sums["rows"], max(sums["length"] / max(sums["rows"], 1), 1.0)
        # A row per word of the slice.
        counted = self.postings.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        frequency = np.zeros(len(self.vocabulary))
        frequency[counted["term"].to_numpy()] = counted["count"].to_numpy()
        # A term's weight is its rarity times its repeats in the question.
        rarity = np.log1p((self.rows - frequency + 0.5) / (frequency + 0.5))
        number = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        pair, repeats = np.unique(
            number * len(self.vocabulary) + words.indices.to_numpy().astype(np.int64), return_counts=True
        )
        question, term = np.divmod(pair, max(1, len(self.vocabulary)))
        self.terms = share((question, term, rarity[term] * repeats))

    def _index(self, chunks: DataFrame, text: str) -> DataFrame:
        """chunk_id, length (in words), terms (places in the vocabulary) and counts of all chunks."""
        id_type = chunks.schema["chunk_id"].dataType
        schema = T.StructType(
            [
                T.StructField("chunk_id", id_type),
                T.StructField("length", T.LongType()),
                T.StructField("terms", T.ArrayType(T.IntegerType())),
                T.StructField("counts", T.ArrayType(T.IntegerType())),
            ]
        )
        out, vocabulary = arrow_schema(schema), self.share(self.vocabulary)

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = vocabulary.value
            for batch in (b.slice(i, INDEX_ROWS) for b in batches for i in range(0, b.num_rows, INDEX_ROWS)):
                lists = batch.column(1)
                length = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(lists)), length)
                term = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy().astype(np.int64)
                pair, count = np.unique(row[term >= 0] * len(known) + term[term >= 0], return_counts=True)
                row, term = np.divmod(pair, max(1, len(known)))
                ends = pa.array(np.searchsorted(row, np.arange(len(lists) + 1)).astype(np.int32))
                columns = [batch.column(0), pa.array(length.astype(np.int64))]
                columns += [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, count)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

        words = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))
        return chunks.select("chunk_id", words.alias("words")).mapInArrow(index, schema)

    def reader(self):
        """What a task makes of a batch of postings, and of the slice's questions."""
        terms, questions = self.terms, len(self.ids)
        vocabulary, mean_length = len(self.vocabulary), self.mean_length

        def questions_() -> QuestionTerms:
            return QuestionTerms(*terms.value, questions)

        def postings(batch: pa.RecordBatch) -> Postings:
            lengths = batch.column("length").to_numpy()
            return Postings(batch.column("terms"), batch.column("counts"), lengths, vocabulary, mean_length)

        return questions_, postings

    def best(self, k: int, question_type: T.DataType, first_rows: int, growth: int) -> DataFrame:
        """The k best chunks per question that share a word, ranked."""
        schema = result_schema(question_type, self.postings.schema["chunk_id"].dataType)
        out, ids = arrow_schema(schema), self.share(self.ids)
        questions, postings = self.reader()

        def search(chunks: DataFrame, floor: np.ndarray) -> DataFrame:
            floors = self.share(floor)

            def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                asked = questions()
                best = BestChunks(len(ids.value), k, floors.value)
                for batch in batches:
                    if batch.num_rows:
                        best_by_text(best, asked, postings(batch), identifiers(batch.column("chunk_id")))
                yield best.table(ids.value, out)

            return chunks.mapInArrow(scan, schema)

        return keep_best(search_with_floors(self.postings, self.rows, self.ids, k, search, first_rows, growth), k)

    def ranks(self, pairs: DataFrame, question_type: T.DataType) -> DataFrame:
        """question_id, chunk_id and text_rank of given pairs that share a word: one more than the chunks before
        them in the list of all that share a word. At most k pairs per question pass through the driver."""
        given = pairs.toArrow()
        place = {q: i for i, q in enumerate(self.ids.tolist())}
        asked = np.array([place.get(q, -1) for q in given["question_id"].to_pylist()], np.int64)
        chunk = identifiers(given["chunk_id"])[asked >= 0]
        asked = asked[asked >= 0]
        shared = self.share((asked, chunk))
        questions, postings = self.reader()

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, known = questions(), shared.value
            for batch in batches:
                if not batch.num_rows or not len(known[0]):
                    continue
                ids = identifiers(batch.column("chunk_id"))
                by_id = np.argsort(ids)
                at = np.minimum(np.searchsorted(ids[by_id], known[1]), len(ids) - 1)
                mark = np.flatnonzero(ids[by_id[at]] == known[1])
                scores = own.of_pairs(postings(batch), known[0][mark], by_id[at[mark]])
                yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(scores)], ["mark", "score"])

        # A number per mark: at most k for each question of the slice.
        scored = self.postings.mapInArrow(score, "mark long, score double").filter("score > 0").toArrow()
        mark = scored["mark"].to_numpy()
        values = (asked[mark], chunk[mark], scored["score"].to_numpy(), len(self.ids))
        marks = self.share(values)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, counted = questions(), Marks(*marks.value)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = identifiers(batch.column("chunk_id")).astype(object)
                code = np.unique(np.concatenate([ids, counted.chunk]), return_inverse=True)[1]
                for question, row, score in own.matches(postings(batch), counted.floor):
                    counted.count(question, score, code[row], code[len(ids) :])
            number = np.flatnonzero(counted.ahead)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(counted.ahead[number])], ["mark", "ahead"])

        ahead = self.postings.mapInArrow(count, "mark long, ahead long").groupBy("mark").agg(F.sum("ahead").alias("ahead"))
        rank = np.ones(len(mark), np.int64)
        found = ahead.toArrow()
        rank[found["mark"].to_numpy()] += found["ahead"].to_numpy()
        chunk_type = self.postings.schema["chunk_id"].dataType
        fields = result_schema(question_type, chunk_type).fields[:2]
        schema = T.StructType([*fields, T.StructField("text_rank", T.LongType())])
        columns = [self.ids[values[0]], values[1], rank]
        table = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow_schema(schema))], arrow_schema(schema))
        return pairs.sparkSession.createDataFrame(table, schema)


def topk_by_text(
    questions: DataFrame,
    chunks: DataFrame,
    k: int,
    *,
    question: str = "question",
    text: str = fixed.CHUNK_CONTENT_FIELD,
    slice_bytes: int = SLICE_BYTES,
    first_rows: int = FIRST_ROWS,
    growth: int = GROWTH,
) -> DataFrame:
    """Rows `question_id, rank, chunk_id, score`: the k best chunks that share a word, by BM25."""
    question_type = questions.schema["question_id"].dataType
    words = _question_words(questions, question)

    def searched(part: DataFrame, share: Share) -> DataFrame:
        return _TextSearch(part, chunks, text, share).best(k, question_type, first_rows, growth)

    found = each_slice(slices(words, _size(k), slice_bytes), searched, "by_text")
    schema = result_schema(question_type, chunks.schema["chunk_id"].dataType)
    return keep_best(questions.sparkSession.createDataFrame([], schema), k) if found is None else found


def topk_hybrid(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = fixed.MULTI_TURN_K,
    *,
    question: str = "question",
    question_vector: str = "question_vector",
    text: str = fixed.CHUNK_CONTENT_FIELD,
    chunk_vector: str = fixed.CHUNK_VECTOR_FIELD,
    text_recall: int | None = None,
    fusion_constant: int = FUSION_CONSTANT,
    slice_bytes: int = SLICE_BYTES,
    first_rows: int = FIRST_ROWS,
    growth: int = GROWTH,
) -> DataFrame:
    """Rows `question_id, rank, chunk_id, score` by reciprocal rank fusion of vectors and text.

    A chunk scores 1 / (constant + rank) in each list that has it: the k best by vector, and all
    that share a word by BM25, or the `text_recall` best of them. A chunk found by text alone at a rank beyond k
    trails the k chunks before it, so the text list is needed only to rank k, plus the text ranks of the
    chunks found by vector, which are counted. The result is that of the two full lists.
    """
    if text_recall is not None and text_recall < k:
        raise ValueError("text_recall must be at least k")
    sizes = {"slice_bytes": slice_bytes, "first_rows": first_rows, "growth": growth}
    by_vector = topk_by_vector(questions, chunks, k, question_vector=question_vector, chunk_vector=chunk_vector, **sizes)
    by_vector = by_vector.select("question_id", "chunk_id", F.col("rank").alias("vector_rank"))
    question_type = questions.schema["question_id"].dataType
    words = _question_words(questions, question)
    key = ["question_id", "chunk_id"]

    def searched(part: DataFrame, share: Share) -> DataFrame:
        search = _TextSearch(part, chunks, text, share)
        pairs = by_vector.join(part.select("question_id"), "question_id", "left_semi").select(*key)
        best = search.best(k, question_type, first_rows, growth).select(*key, F.col("rank").cast("long").alias("text_rank"))
        return best.union(search.ranks(pairs, question_type)).groupBy(*key).agg(F.min("text_rank").alias("text_rank"))

    by_text = each_slice(slices(words, _size(k), slice_bytes), searched, "text_ranks")
    if by_text is None:
        by_text = by_vector.select(*key, F.lit(None).cast("long").alias("text_rank")).limit(0)
    if text_recall is not None:
        by_text = by_text.filter(F.col("text_rank") <= text_recall)
    share_of = lambda rank: F.coalesce(F.lit(1.0) / (fusion_constant + rank), F.lit(0.0))
    fused = by_vector.join(by_text, key, "full").select(
        *key, (share_of(F.col("vector_rank")) + share_of(F.col("text_rank"))).alias("score")
    )
    return keep_best(fused, k)
