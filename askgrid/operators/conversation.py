"""Conversation threads: their last answer and sources, routing, and prompts.

Messages are rows `thread_id, turn, type, content, tool_calls, artifact`. Threads are only ever
reduced by aggregates or filtered; no thread is collected, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed
from askgrid.functions.text import python_dict

THREAD = ("thread_id",)


def _is_tool() -> Column:
    return F.col("type").eqNullSafe("tool")


def with_type(messages: DataFrame) -> DataFrame:
    """Messages that name their kind by `role` instead of `type`, with the `type` of that role."""
    if "type" in messages.columns:
        return messages
    role = F.col("role")
    kind = F.when(role == "user", "human").when(role == "assistant", "ai").otherwise(role)
    messages = messages.withColumn("type", kind).drop("role")
    if "tool_calls" not in messages.columns:
        none = F.expr("cast(array() as array<struct<name: string, args: string>>)")
        messages = messages.withColumn("tool_calls", none)
    return messages


def has_tool_calls(tool_calls: Column) -> Column:
    return F.coalesce(F.size(tool_calls), F.lit(0)) > 0


def turn_state(scope: str = "thread") -> list[Column]:
    """Aggregates that hold a thread's state: number of messages, last answer, last sources.

    The sources are those of the single latest tool message. With `scope="thread"` that message
    may belong to an earlier turn than the answer; `scope="turn"` looks only behind the last
    human message.
    """
    if scope not in ("thread", "turn"):
        raise ValueError(f"scope must be 'thread' or 'turn', not {scope!r}")
    tool_turn = F.when(_is_tool(), F.col("turn"))
    artifact = F.max_by(F.when(_is_tool(), F.col("artifact")), tool_turn)
    if scope == "turn":
        human_turn = F.max(F.when(F.col("type") == "human", F.col("turn")))
        artifact = F.when(human_turn.isNull() | (F.max(tool_turn) > human_turn), artifact)
    return [
        F.count(F.lit(1)).alias("messages"),
        F.max("turn").alias("last_turn"),
        F.max_by("content", "turn").alias("answer"),
        artifact.alias("artifact"),
    ]


def with_sources(state: DataFrame) -> DataFrame:
    """The artifact as `source_names` and `source_contents`, both empty if there is none."""
    documents = F.filter(F.col("artifact"), lambda d: d.isNotNull())
    empty = F.expr("cast(array() as array<string>)")
    return state.withColumns(
        {
            "source_names": F.coalesce(F.transform(documents, lambda d: d["title"]), empty),
            "source_contents": F.coalesce(F.transform(documents, lambda d: d["page_content"]), empty),
        }
    ).drop("artifact")


def turn_results(messages: DataFrame, scope: str = "thread", key: tuple[str, ...] = THREAD) -> DataFrame:
    """One row per thread: `messages, last_turn, answer, source_names, source_contents`.

    Which messages decide is found by their turns alone; their texts are then fetched by thread and turn, so no
    aggregate holds a text. A thread's turns are distinct.
    """
    if scope not in ("thread", "turn"):
        raise ValueError(f"scope must be 'thread' or 'turn', not {scope!r}")
    turn = lambda which: F.max(F.when(which, F.col("turn")))
    tool, human = turn(_is_tool()), turn(F.col("type") == "human")
    if scope == "turn":
        tool = F.when(human.isNull() | (tool > human), tool)
    ends = messages.groupBy(*key).agg(
        F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"), tool.alias("_tool_turn")
    )
    rows = _with_message(ends, messages.withColumn("answer", F.col("content")), key, "last_turn", "answer")
    rows = _with_message(rows, messages.filter(_is_tool()), key, "_tool_turn", "artifact")
    return with_sources(rows.select(*key, "messages", "last_turn", "answer", "artifact"))


def _with_message(rows: DataFrame, messages: DataFrame, key: tuple[str, ...], turn: str, column: str) -> DataFrame:
    """Add a column of the message that a thread has at a turn; null if there is none."""
    own = [F.col(k).alias(f"_{k}") for k in key]
    found = messages.select(*own, F.col("turn").alias("_at"), column)
    same = F.col(turn) == F.col("_at")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(found, same, "left").drop("_at", *[f"_{k}" for k in key])


def _ends(messages: DataFrame) -> DataFrame:
    """Per thread the last tool turn and the last turn of any other kind."""
    return messages.groupBy(*THREAD).agg(
        F.max(F.when(_is_tool(), F.col("turn"))).alias("last_tool"),
        F.max(F.when(~_is_tool(), F.col("turn"))).alias("last_other"),
    )


def _open_run() -> Column:
    """The thread ends in tool messages."""
    return F.col("last_tool").isNotNull() & (F.col("last_other").isNull() | (F.col("last_tool") > F.col("last_other")))


def trailing_tool_run(messages: DataFrame) -> DataFrame:
    """The tool messages that end a thread; all of them if it has no other message."""
    ends = _ends(messages).filter(_open_run()).select(*THREAD, "last_other")
    in_run = F.col("last_other").isNull() | (F.col("turn") > F.col("last_other"))
    return messages.filter(_is_tool()).join(ends, list(THREAD)).filter(in_run).drop("last_other")


def conversation_only(messages: DataFrame) -> DataFrame:
    """Human and system messages, and AI messages that call no tool."""
    plain_ai = (F.col("type") == "ai") & ~has_tool_calls(F.col("tool_calls"))
    return messages.filter(F.col("type").isin("human", "system") | plain_ai)


def route_turns(messages: DataFrame) -> DataFrame:
    """`tools` for threads whose last message calls a tool, else `end`."""
    last_calls = F.max_by(has_tool_calls(F.col("tool_calls")), F.col("turn"))
    return messages.groupBy(*THREAD).agg(F.when(last_calls, "tools").otherwise("end").alias("route"))


def answer_prompt(messages: DataFrame, instruction: str = fixed.ANSWER_INSTRUCTION) -> DataFrame:
    """The prompt of each thread as rows `thread_id, place, part, type, text`.

    The system message has place -1; its parts are the instruction and one row per message of
    the trailing tool run. The conversation follows in the order of its turns. Concatenating
    the parts of a place gives the message, so no thread has to fit into one row.
    """
    separator = fixed.CONTEXT_SEPARATOR
    head = instruction.removesuffix(separator)
    tail = separator if head != instruction else ""
    system = _ends(messages).select(
        *THREAD,
        F.lit(-1).cast("bigint").alias("place"),
        F.lit(-1).cast("bigint").alias("part"),
        F.lit("system").alias("type"),
        F.when(_open_run(), F.lit(head)).otherwise(F.lit(head + tail)).alias("text"),
    )
    context = trailing_tool_run(messages).select(
        *THREAD,
        F.lit(-1).cast("bigint").alias("place"),
        F.col("turn").alias("part"),
        F.lit("system").alias("type"),
        F.concat(F.lit(separator), "content").alias("text"),
    )
    conversation = conversation_only(messages).select(
        *THREAD, F.col("turn").alias("place"), F.lit(-1).cast("bigint").alias("part"), "type", F.col("content").alias("text")
    )
    return system.unionByName(context).unionByName(conversation)


def serialised_chunk(metadata_entries: Column, text: Column) -> Column:
    """One retrieved chunk as it appears in a tool message."""
    shown = F.coalesce(python_dict(metadata_entries), F.lit("{}"))
    return F.concat(F.lit("Source: "), shown, F.lit("\nContent: "), F.coalesce(text, F.lit("")))


def contexts(found: DataFrame) -> DataFrame:
    """Retrieved chunks (`question_id, rank, title, metadata, chunk`) as one row per question.

    Gives `documents` in rank order, their `joined` texts and the `serialised` tool message. A
    question has at most the k rows of the search, which bounds what is collected. The texts are
    made after that, so a reader that uses only some of the columns pays for no other.
    """
    row = F.struct("rank", "title", "chunk", F.map_entries("metadata").alias("metadata"))
    rows = found.groupBy("question_id").agg(F.sort_array(F.collect_list(row)).alias("_rows"))

    def each(function) -> Column:
        return F.transform(F.col("_rows"), function)

    return rows.select(
        "question_id",
        each(lambda r: F.struct(r["title"].alias("title"), r["chunk"].alias("page_content"))).alias("documents"),
        F.array_join(each(lambda r: r["chunk"]), fixed.CONTEXT_SEPARATOR).alias("joined"),
        F.array_join(each(lambda r: serialised_chunk(r["metadata"], r["chunk"])), fixed.CONTEXT_SEPARATOR).alias(
            "serialised"
        ),
    )
