"""The state of every conversation thread, kept up to date from a stream of messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from askgrid.operators.conversation import turn_state, with_sources
from askgrid.session import work_folder

SESSION_THREAD = ("session_id", "thread_id")


def thread_states(messages: DataFrame, scope: str = "thread", key: Sequence[str] = SESSION_THREAD) -> DataFrame:
    """A streaming aggregation per session and thread: `messages, last_turn, answer, artifact`.

    The state holds a thread's last answer and last retrieved chunks, not its messages, so it
    does not grow with the length of a thread. Messages are reduced before they are shuffled.
    A new session starts with no state.
    """
    return messages.groupBy(*key).agg(*turn_state(scope))


def write_states(states: DataFrame, path: str) -> StreamingQuery:
    """Run over what has arrived, writing after each step the states that it changed.

    Each step has a folder of its own, written anew if the step is repeated after a failure.
    """

    def write(step: DataFrame, number: int) -> None:
        with_sources(step).write.mode("overwrite").parquet(f"{path}/states/step={number}")

    return (
        states.writeStream.outputMode("update")
        .option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def latest_states(steps: DataFrame, key: Sequence[str] = SESSION_THREAD) -> DataFrame:
    """The last written state per session and thread."""
    values = [c for c in steps.columns if c not in (*key, "step")]
    last = F.max_by(F.struct(*values), F.col("step")).alias("last")
    return steps.groupBy(*key).agg(last).select(*key, "last.*")


def run_to_end(messages: DataFrame, scope: str = "thread", key: Sequence[str] = SESSION_THREAD) -> DataFrame:
    """Process a stream's present messages and return every step's states, with its `step`."""
    spark = messages.sparkSession
    path = work_folder(spark)
    query = write_states(thread_states(messages, scope, key), path)
    query.awaitTermination()
    return spark.read.parquet(f"{path}/states")
