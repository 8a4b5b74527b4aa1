"""The messages of every conversation thread as state that a stream appends to."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from askgrid.operators.conversation import conversation_only
from askgrid.session import work_folder
from askgrid.streaming.conversation_state import SESSION_THREAD, latest_states

_HISTORY = "turns array<bigint>, kinds array<string>, texts array<string>"


def thread_histories(messages: DataFrame, key: Sequence[str] = SESSION_THREAD) -> DataFrame:
    """A streaming table per session and thread: `messages, last_turn, history`.

    The state holds what a model sees of a thread: its human and system messages and its plain AI messages, in the
    order of their turns. New ones are appended; one that comes late is put in its place. `history` is an
    array of (type, text), as a prompt is one row. Null texts count as empty; messages without a turn are left out.
    """
    schema = ", ".join(f"{k} {messages.schema[k].dataType.simpleString()}" for k in key)
    output = f"{schema}, messages bigint, last_turn bigint, {_HISTORY}"

    def append(thread: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, kinds, texts = (list(x) for x in state.get) if state.exists else ([], [], [])
        for part in parts:
            turns += part["turn"].tolist()
            kinds += part["type"].tolist()
            texts += part["content"].tolist()
        order = sorted(range(len(turns)), key=turns.__getitem__)
        turns, kinds, texts = ([x[i] for i in order] for x in (turns, kinds, texts))
        state.update((turns, kinds, texts))
        row = (*thread, len(turns), turns[-1], turns, kinds, texts)
        yield pd.DataFrame([row], columns=[*key, "messages", "last_turn", "turns", "kinds", "texts"])

    said = conversation_only(messages).filter("turn is not null").select(
        *key, F.col("turn").cast("bigint").alias("turn"), "type", F.coalesce("content", F.lit("")).alias("content")
    )
    kept = said.groupBy(*key).applyInPandasWithState(append, output, _HISTORY, "update", GroupStateTimeout.NoTimeout)
    history = F.arrays_zip(F.col("kinds").alias("type"), F.col("texts").alias("text"))
    return kept.select(*key, "messages", "last_turn", history.alias("history"))


def write_histories(histories: DataFrame, path: str) -> StreamingQuery:
    """Run over what has arrived, writing after each step the histories that it changed to `histories/step=n`."""

    def write(step: DataFrame, number: int) -> None:
        step.write.mode("overwrite").parquet(f"{path}/histories/step={number}")

    return (
        histories.writeStream.outputMode("update")
        .option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def run_to_end(messages: DataFrame, path: str | None = None, key: Sequence[str] = SESSION_THREAD) -> DataFrame:
    """Process a stream's present messages and return the latest history of each thread. A second run with the
    same `path` goes on from the state that the first one left."""
    spark = messages.sparkSession
    path = path or work_folder(spark)
    write_histories(thread_histories(messages, key), path).awaitTermination()
    return latest_states(spark.read.parquet(f"{path}/histories"), key)
