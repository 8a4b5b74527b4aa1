"""The state of conversation threads after every message, from a stream of messages in several steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from askgrid.operators.conversation import with_sources
from askgrid.session import work_folder
from askgrid.streaming.conversation_state import SESSION_THREAD

_STATE = "messages long, last_turn {turn}, answer string, tool_turn {turn}, artifact {artifact}"


def after_each_message(batch: DataFrame, before: DataFrame, key: Sequence[str] = SESSION_THREAD) -> DataFrame:
    """The rows of `batch` with the state of their thread after each: `messages, last_turn, answer, tool_turn,
    artifact`, going on from the threads' states in `before`.

    The answer is that of the greatest turn so far and the artifact that of the greatest tool turn, so a message that
    comes after later ones of its thread is counted and changes nothing else. Running windows hold one row of a
    thread at a time, however many it has.
    """
    order = Window.partitionBy(*key).orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_tool = F.col("type").eqNullSafe("tool")
    told = F.struct("turn", "artifact")
    running = batch.select(
        *key,
        "turn",
        "content",
        F.count(F.lit(1)).over(order).alias("_messages"),
        F.last(F.when(is_tool, told), ignorenulls=True).over(order).alias("_told"),
    )
    joined = running.join(before, list(key), "left")
    later = F.coalesce(F.col("last_turn") > F.col("turn"), F.lit(False))
    told_later = F.col("_told").isNull() | F.coalesce(F.col("tool_turn") > F.col("_told.turn"), F.lit(False))
    return joined.select(
        *key,
        "turn",
        (F.coalesce("messages", F.lit(0)) + F.col("_messages")).alias("messages"),
        F.when(later, F.col("last_turn")).otherwise(F.col("turn")).alias("last_turn"),
        F.when(later, F.col("answer")).otherwise(F.col("content")).alias("answer"),
        F.when(told_later, F.col("tool_turn")).otherwise(F.col("_told.turn")).alias("tool_turn"),
        F.when(told_later, F.col("artifact")).otherwise(F.col("_told.artifact")).alias("artifact"),
    )


def write_steps(messages: DataFrame, path: str, key: Sequence[str] = SESSION_THREAD) -> StreamingQuery:
    """Run over what has arrived. Each micro-batch writes its messages with the states after them to
    `steps/step=n`, and the states of all threads to `threads/step=n`, from which the next one goes on.

    Both folders are written anew if a step is repeated after a failure; the same path goes on where it ended.
    """
    spark = messages.sparkSession
    turn, artifact = (messages.schema[c].dataType.simpleString() for c in ("turn", "artifact"))
    names = ", ".join(f"{k} {messages.schema[k].dataType.simpleString()}" for k in key)
    schema = f"{names}, {_STATE.format(turn=turn, artifact=artifact)}"

    def write(batch: DataFrame, number: int) -> None:
        if number:
            before = spark.read.schema(schema).parquet(f"{path}/threads/step={number - 1}")
        else:
            before = spark.createDataFrame([], schema)
        after_each_message(batch, before, key).write.mode("overwrite").parquet(f"{path}/steps/step={number}")
        steps = spark.read.parquet(f"{path}/steps/step={number}")
        newest = Window.partitionBy(*key).orderBy(F.desc("messages"))
        changed = steps.withColumn("_place", F.row_number().over(newest)).filter("_place = 1").select(*before.columns)
        states = before.join(changed.select(*key), list(key), "left_anti").unionByName(changed)
        states.write.mode("overwrite").parquet(f"{path}/threads/step={number}")

    return (
        messages.writeStream.option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def run_to_end(messages: DataFrame, path: str | None = None, key: Sequence[str] = SESSION_THREAD) -> DataFrame:
    """Process a stream's present messages; the state after each message that has ever arrived, with its `step`."""
    spark = messages.sparkSession
    path = path or work_folder(spark)
    write_steps(messages, path, key).awaitTermination()
    return with_sources(spark.read.parquet(f"{path}/steps"))
