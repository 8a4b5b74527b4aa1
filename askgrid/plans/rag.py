"""Answering a table of questions from a table of chunks, all questions in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.functions import fixed_values as fixed
from askgrid.functions.text import fill_template, tokens
from askgrid.operators import conversation, embedding
from askgrid.operators.columns import require_index_fields
from askgrid.operators.lexical import topk_hybrid
from askgrid.operators.membership import may_be_among
from askgrid.operators.retrieval import topk_by_vector
from askgrid.session import materialise

# A generator's client takes prompts, each a list of (type, text) messages, and gives the answers.
GeneratorClient = Callable[[Sequence[Sequence[tuple[str, str]]]], Sequence[str]]

# A policy's client takes conversations, each a list of (type, text) messages, and gives for each an
# answer without retrieval, or the queries to retrieve for: (answer, []) or (None, [query, ...]).
PolicyClient = Callable[[Sequence[Sequence[tuple[str, str]]]], Sequence[tuple[str | None, Sequence[str]]]]

UNKNOWN_ANSWER = "I don't know."
#: Bytes of search results (ids, ranks and scores) that are sent to all tasks at most.
FOUND_BYTES_TO_BROADCAST = 64 << 20

_MESSAGE = "array<struct<type: string, text: string>>"


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = fixed.MULTI_TURN_K,
    search: str = "vector",
    columns: Sequence[str] = ("title", "metadata", "chunk"),
) -> DataFrame:
    """The best chunks of each question with their text: `question_id, rank, chunk_id, score, ...`.

    The search result is written before its texts are fetched, so its size is known: up to
    FOUND_BYTES_TO_BROADCAST it is sent to the chunks, which are read once more but not shuffled. A larger one
    meets them in a shuffled join; then a Bloom filter of the found ids drops other chunks ahead of the exchange.
    """
    require_index_fields(chunks, fixed.CHUNK_VECTOR_FIELD, fixed.CHUNK_CONTENT_FIELD)
    if search == "hybrid":
        # Written, since both searches read it and a client may make the vectors.
        questions = materialise(questions.select("question_id", "question", "question_vector"), "questions")
    if search == "vector":
        found = topk_by_vector(questions, chunks, k)
    elif search == "hybrid":
        found = materialise(topk_hybrid(questions, chunks, k), "found")
    else:
        raise ValueError(f"search must be 'vector' or 'hybrid', not {search!r}")
    return fetch(found, chunks.select("chunk_id", *columns))


def fetch(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """A written search result with the columns of `chunks`, by chunk_id."""
    size = 24 + sum(F.octet_length(F.col(c).cast("string")) for c in ("question_id", "chunk_id"))
    total, rows = found.agg(F.sum(size), F.count(F.lit(1))).first()
    if (total or 0) <= FOUND_BYTES_TO_BROADCAST:
        return chunks.join(F.broadcast(found), "chunk_id")
    wanted = found.select("chunk_id").distinct()
    return chunks.filter(may_be_among(F.col("chunk_id"), wanted, rows)).join(found, "chunk_id")


def add_best_sentence(rows: DataFrame, texts: Column, output: str = "answer") -> DataFrame:
    """The offline generator: the sentence that shares most distinct words with the question.

    Of equally good sentences the first one, in rank order.
    """
    sentences = F.filter(
        F.transform(F.split(F.array_join(texts, "\n"), "[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != ""
    )
    rated = F.transform(
        F.col("_sentences"),
        lambda s, i: F.struct(
            F.size(F.array_intersect(tokens(s), F.col("_words"))).alias("hits"), (-i).alias("place"), s.alias("text")
        ),
    )
    # Both are columns of their own, and used twice, so that they are made once per row and not
    # once per sentence.
    best = F.when(F.size("_words") > 0, F.array_max(rated)["text"]).otherwise(F.get("_sentences", F.lit(0)))
    return (
        rows.withColumns({"_words": F.array_distinct(tokens(F.col("question"))), "_sentences": sentences})
        .withColumn(output, F.coalesce(best, F.lit(UNKNOWN_ANSWER)))
        .drop("_words", "_sentences")
    )


def generated(client: Callable[[], GeneratorClient], prompt: Column) -> Column:
    """Answers of a client to a column of message lists. One client per task, Arrow batches."""

    @F.pandas_udf(T.StringType())
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generate = client()
        for prompts in batches:
            yield pd.Series(list(generate([[(m["type"], m["text"]) for m in p] for p in prompts])), dtype=object)

    return answer(prompt)


def _message(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"))


def _answer(
    asked: DataFrame,
    chunks: DataFrame,
    k: int,
    search: str,
    generator: Callable[[], GeneratorClient] | None,
    concurrency: int | None,
    prompt: Callable[[], Column],
) -> DataFrame:
    """Retrieve for the rows whose `wants_retrieval` is true, then answer every row."""
    questions = asked.filter("wants_retrieval")
    found = conversation.contexts(retrieve(questions, chunks, k, search))
    rows = asked.join(found, "question_id", "left").withColumns(
        {
            "documents": F.coalesce(
                "documents", F.expr("cast(array() as array<struct<title: string, page_content: string>>)")
            ),
            "joined": F.coalesce("joined", F.lit("")),
        }
    )
    rows = rows.withColumn("prompt", prompt().cast(_MESSAGE))
    if generator is None:
        texts = F.transform("documents", lambda d: d["page_content"])
        return add_best_sentence(rows, texts)
    if concurrency is not None:
        rows = rows.repartition(concurrency, "question_id")
    # Whatever reads the answers later must not call the model again.
    return materialise(rows.withColumn("answer", generated(generator, F.col("prompt"))), "answers")


def _with_wish(questions: DataFrame, wants_retrieval: Column | None) -> DataFrame:
    wish = F.lit(True) if wants_retrieval is None else F.coalesce(wants_retrieval, F.lit(False))
    return questions.withColumn("wants_retrieval", wish)


def _sources() -> list[Column]:
    return [
        F.transform("documents", lambda d: d["title"]).alias("source_names"),
        F.transform("documents", lambda d: d["page_content"]).alias("source_contents"),
    ]


def answer_questions(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = fixed.SINGLE_TURN_K,
    search: str = "hybrid",
    generator: Callable[[], GeneratorClient] | None = None,
    template: str = fixed.SINGLE_TURN_TEMPLATE,
    concurrency: int | None = None,
) -> DataFrame:
    """Single-turn answers: `question_id, question, answer, source_names, source_contents, prompt`.

    `questions` has `question_id, question, question_vector`; `chunks` has `chunk_id, title,
    metadata, chunk, text_vector`. Every question is retrieved for. `concurrency` sets the
    number of partitions, and so of generator calls at a time.
    """
    asked = _with_wish(questions, None)

    def prompt() -> Column:
        text = fill_template(template, {"question": F.col("question"), "context": F.col("joined")})
        return F.array(_message("human", text))

    answered = _answer(asked, chunks, k, search, generator, concurrency, prompt)
    return answered.select("question_id", "question", "answer", *_sources(), "prompt")


def _turn_rows(
    questions: DataFrame,
    chunks: DataFrame,
    k: int,
    search: str,
    generator: Callable[[], GeneratorClient] | None,
    wants_retrieval: Column | None,
    instruction: str,
    concurrency: int | None,
) -> DataFrame:
    """Each question as a turn of its own, one wide row per question."""
    asked = _with_wish(questions, wants_retrieval)

    def prompt() -> Column:
        human = _message("human", F.col("question"))
        system = _message("system", F.concat(F.lit(instruction), F.coalesce("serialised", F.lit(""))))
        return F.when(F.col("wants_retrieval"), F.array(system, human)).otherwise(F.array(human))

    return _answer(asked, chunks, k, search, generator, concurrency, prompt)


def turn_answers(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = fixed.MULTI_TURN_K,
    search: str = "hybrid",
    generator: Callable[[], GeneratorClient] | None = None,
    wants_retrieval: Column | None = None,
    instruction: str = fixed.ANSWER_INSTRUCTION,
    concurrency: int | None = None,
) -> DataFrame:
    """As `answer_turns`, but the answer and its sources alone: `question_id, answer, source_names,
    source_contents`."""
    rows = _turn_rows(questions, chunks, k, search, generator, wants_retrieval, instruction, concurrency)
    return rows.select("question_id", "answer", *_sources())


def answer_turns(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = fixed.MULTI_TURN_K,
    search: str = "hybrid",
    generator: Callable[[], GeneratorClient] | None = None,
    wants_retrieval: Column | None = None,
    instruction: str = fixed.ANSWER_INSTRUCTION,
    concurrency: int | None = None,
) -> DataFrame:
    """Each question as the first turn of a thread of its own, as message rows.

    A turn that wants retrieval (all, unless `wants_retrieval` says otherwise) has a human
    message, an AI message with a tool call, the tool message with the serialised chunks and
    their artifact, and the answer; any other turn has the human message and the answer.
    """
    rows = _turn_rows(questions, chunks, k, search, generator, wants_retrieval, instruction, concurrency)
    no_calls = F.expr("cast(array() as array<struct<name: string, args: string>>)")
    no_documents = F.expr("cast(array() as array<struct<title: string, page_content: string>>)")

    def message(kind: str, content: Column, calls: Column = no_calls, artifact: Column = no_documents) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), content.alias("content"), calls.alias("tool_calls"), artifact.alias("artifact")
        )

    human, final = message("human", F.col("question")), message("ai", F.col("answer"))
    call = message("ai", F.lit(""), F.array(F.struct(F.lit("retrieve").alias("name"), F.col("question").alias("args"))))
    tool = message("tool", F.coalesce("serialised", F.lit("")), artifact=F.col("documents"))
    turns = F.when(F.col("wants_retrieval"), F.array(human, call, tool, final)).otherwise(F.array(human, final))
    return rows.select(
        F.col("question_id").alias("thread_id"), F.posexplode(turns).alias("turn", "message")
    ).select("thread_id", F.col("turn").cast("bigint").alias("turn"), "message.*")


_DECISION = T.StructType(
    [T.StructField("direct", T.StringType()), T.StructField("queries", T.ArrayType(T.StringType()))]
)
_NO_DOCUMENTS = "cast(array() as array<struct<title: string, page_content: string>>)"
_NO_CALLS = "cast(array() as array<struct<name: string, args: string>>)"


def decided(client: Callable[[], PolicyClient], history: Column) -> Column:
    """Whether a client answers by itself or what it retrieves for. One client per task."""

    @F.pandas_udf(_DECISION)
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        policy = client()
        for histories in batches:
            choices = policy([[(m["type"], m["text"]) for m in h] for h in histories])
            rows = [(answer, [] if answer is not None else list(queries)) for answer, queries in choices]
            yield pd.DataFrame(rows, columns=["direct", "queries"], dtype=object)

    return decide(history)


def open_threads(messages: DataFrame) -> DataFrame:
    """Threads whose last message is human: `thread_id, last_turn, question, history`.

    `history` is what a model sees: human and system messages and plain AI messages in the order of
    their turns, the question last. It is one model's prompt, so it has to be one row.
    """
    ends = messages.groupBy("thread_id").agg(
        F.max("turn").alias("last_turn"),
        F.max(F.when(F.col("type") == "human", F.col("turn"))).alias("asked_turn"),
    )
    ends = ends.filter(F.col("last_turn") == F.col("asked_turn")).select("thread_id", "last_turn")
    seen = conversation.conversation_only(messages).join(ends, "thread_id")
    message = F.struct("turn", "type", F.coalesce("content", F.lit("")).alias("text"))
    threads = seen.groupBy("thread_id", "last_turn").agg(F.sort_array(F.collect_list(message)).alias("_seen"))
    return threads.select(
        "thread_id",
        "last_turn",
        F.element_at("_seen", -1)["text"].alias("question"),
        F.transform("_seen", lambda m: F.struct(m["type"].alias("type"), m["text"].alias("text"))).alias("history"),
    )


def answer_open_threads(
    messages: DataFrame,
    chunks: DataFrame,
    k: int = fixed.MULTI_TURN_K,
    search: str = "hybrid",
    generator: Callable[[], GeneratorClient] | None = None,
    policy: Callable[[], PolicyClient] | None = None,
    embedder: Callable[[], embedding.Embedder] | None = None,
    instruction: str = fixed.ANSWER_INSTRUCTION,
) -> DataFrame:
    """The answer to each thread that waits for one, with the whole conversation in its prompt.

    `messages` are rows `thread_id, turn, type, content, tool_calls`; instead of `type` they may have
    `role` (user, assistant, others as they are). The policy answers by itself or names queries; by
    default it retrieves for the question. One row per thread: `thread_id, last_turn, question, calls,
    prompt, answer`. A call has its query, documents and serialised text.
    """
    threads = open_threads(conversation.with_type(messages))
    if policy is None:
        choice = F.struct(F.lit(None).cast("string").alias("direct"), F.array("question").alias("queries"))
        threads = threads.withColumn("choice", choice)
    else:
        # Whatever reads the queries later must not call the model again.
        threads = materialise(threads.withColumn("choice", decided(policy, F.col("history"))), "decisions")
    threads = threads.withColumns({"direct": F.col("choice.direct"), "queries": F.col("choice.queries")}).drop("choice")

    called = threads.select("thread_id", F.posexplode("queries").alias("call", "question"))
    called = called.withColumn("question_id", F.concat_ws(":", F.col("call").cast("string"), F.col("thread_id").cast("string")))
    asked = embedding.embed_text(called, "question", "question_vector", embedder)
    found = conversation.contexts(retrieve(asked.select("question_id", "question", "question_vector"), chunks, k, search))
    one = F.struct(
        "call",
        F.col("question").alias("query"),
        F.coalesce("documents", F.expr(_NO_DOCUMENTS)).alias("documents"),
        F.coalesce("serialised", F.lit("")).alias("serialised"),
    )
    calls = called.join(found, "question_id", "left").groupBy("thread_id").agg(
        F.sort_array(F.collect_list(one)).alias("calls")
    )
    rows = threads.join(calls, "thread_id", "left")
    head = instruction.removesuffix(fixed.CONTEXT_SEPARATOR)
    context = F.array_join(F.transform("calls", lambda c: c["serialised"]), fixed.CONTEXT_SEPARATOR)
    system = _message("system", F.concat(F.lit(head + fixed.CONTEXT_SEPARATOR), context))
    prompt = F.when(F.col("direct").isNull(), F.concat(F.array(system), "history")).otherwise(F.col("history"))
    rows = rows.withColumn("prompt", prompt.cast(_MESSAGE))
    if generator is None:
        texts = F.flatten(F.transform("calls", lambda c: F.transform(c["documents"], lambda d: d["page_content"])))
        rows = add_best_sentence(rows, F.coalesce(texts, F.expr("cast(array() as array<string>)")), "_made")
    else:
        waiting = rows.filter(F.col("direct").isNull()).withColumn("_made", generated(generator, F.col("prompt")))
        rest = rows.filter(F.col("direct").isNotNull()).withColumn("_made", F.lit(None).cast("string"))
        rows = materialise(waiting.unionByName(rest), "answers")
    answer = F.coalesce("direct", "_made").alias("answer")
    return rows.select("thread_id", "last_turn", "question", "calls", "prompt", answer)


def appended_messages(answered: DataFrame) -> DataFrame:
    """The messages that answered threads get: the call, one tool message per query, the answer."""

    def message(kind: str, content: Column, calls: Column, artifact: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), content.alias("content"), calls.alias("tool_calls"), artifact.alias("artifact")
        )

    no_calls, no_documents = F.expr(_NO_CALLS), F.expr(_NO_DOCUMENTS)
    queries = F.transform("calls", lambda c: F.struct(F.lit("retrieve").alias("name"), c["query"].alias("args")))
    tools = F.transform("calls", lambda c: message("tool", c["serialised"], no_calls, c["documents"]))
    call = F.array(message("ai", F.lit(""), queries, no_documents))
    final = F.array(message("ai", F.col("answer"), no_calls, no_documents))
    new = F.when(F.coalesce(F.size("calls"), F.lit(0)) > 0, F.concat(call, tools, final)).otherwise(final)
    rows = answered.select("thread_id", "last_turn", F.posexplode(new).alias("place", "message"))
    return rows.select("thread_id", (F.col("last_turn") + F.col("place") + 1).alias("turn"), "message.*")


def answer_threads(messages: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """`answer_open_threads` as the messages to append to the threads."""
    return appended_messages(answer_open_threads(messages, chunks, **options))
