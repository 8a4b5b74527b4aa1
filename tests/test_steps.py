"""Conversation threads as streams in several steps: states after each message, and kept histories."""

import random

from pyspark.sql import functions as F

from askgrid.operators import conversation
from askgrid.streaming import conversation_steps, thread_history

SCHEMA = (
    "session_id STRING, thread_id STRING, turn LONG, type STRING, content STRING, "
    "tool_calls ARRAY<STRUCT<name: STRING, args: STRING>>, artifact ARRAY<STRUCT<title: STRING, page_content: STRING>>"
)


def messages(threads=5, turns=12):
    chosen = random.Random(4)
    rows = []
    for t in range(threads):
        for turn in range(turns):
            kind = chosen.choice(["human", "ai", "tool", "system"])
            calls = [("retrieve", "x")] if kind == "ai" and chosen.random() < 0.4 else []
            chunks = [(f"d{t}{turn}.pdf", f"text {turn}")] if kind == "tool" and chosen.random() < 0.8 else []
            rows.append(("s", f"t{t}", turn, kind, f"{kind} {t} {turn}", calls, chunks))
    return rows


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def arrive(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def expected_steps(rows):
    found = {}
    for _, thread, turn, *_rest in rows:
        before = sorted((r for r in rows if r[1] == thread and r[2] <= turn), key=lambda r: r[2])
        tools = [r for r in before if r[3] == "tool"]
        sources = [title for title, _ in tools[-1][6]] if tools else []
        found[thread, turn] = (len(before), turn, before[-1][4], sources)
    return found


def states(found):
    return {(r["thread_id"], r["turn"]): (r["messages"], r["last_turn"], r["answer"], r["source_names"]) for r in found.collect()}


def test_a_state_after_each_message_whatever_the_steps(spark, tmp_path):
    rows = messages()
    for low, high in ((0, 3), (3, 8), (8, 12)):
        arrive(spark, [r for r in rows if low <= r[2] < high], tmp_path / "in")
    found = conversation_steps.run_to_end(stream(spark, tmp_path / "in"), str(tmp_path / "out"))
    assert states(found) == expected_steps(rows)
    assert found.select("step").distinct().count() == 3


def test_steps_go_on_after_a_stop_and_late_messages_change_no_answer(spark, tmp_path):
    rows = messages(threads=3)
    arrive(spark, [r for r in rows if r[2] < 6 and r[2] != 2], tmp_path / "in")
    conversation_steps.run_to_end(stream(spark, tmp_path / "in"), str(tmp_path / "out"))
    arrive(spark, [r for r in rows if r[2] == 2], tmp_path / "in")
    arrive(spark, [r for r in rows if r[2] >= 6], tmp_path / "in")
    found = conversation_steps.run_to_end(stream(spark, tmp_path / "in"), str(tmp_path / "out"))
    last, expected = states(found), expected_steps(rows)
    assert len(last) == len(rows)
    for key, state in last.items():
        if key[1] >= 6:
            assert state == expected[key]
        if key[1] == 2:
            _, _, answer, sources = expected[key[0], 5]
            assert state[:3] == (6, 5, answer)
            if any(r[1] == key[0] and r[3] == "tool" and 2 < r[2] < 6 for r in rows):
                assert state[3] == sources


def test_histories_are_appended_and_outlive_a_stop(spark, tmp_path):
    rows = messages()
    arrive(spark, [r for r in rows if r[2] < 5], tmp_path / "in")
    first = thread_history.run_to_end(stream(spark, tmp_path / "in"), str(tmp_path / "out")).collect()
    assert max(r["last_turn"] for r in first) < 5
    arrive(spark, [r for r in rows if r[2] >= 7], tmp_path / "in")
    arrive(spark, [r for r in rows if 5 <= r[2] < 7], tmp_path / "in")  # late
    found = thread_history.run_to_end(stream(spark, tmp_path / "in"), str(tmp_path / "out")).collect()
    assert len(found) == 5
    for r in found:
        seen = [x for x in rows if x[1] == r["thread_id"] and (x[3] in ("human", "system") or (x[3] == "ai" and not x[5]))]
        assert [tuple(m) for m in r["history"]] == [(x[3], x[4]) for x in seen]
        assert (r["messages"], r["last_turn"]) == (len(seen), seen[-1][2])


def test_no_aggregate_holds_a_text(spark, capsys):
    df = spark.createDataFrame(messages(), SCHEMA)
    for scope in ("thread", "turn"):
        conversation.turn_results(df, scope).explain("formatted")
        plan = capsys.readouterr().out
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    null_id = df.withColumn("thread_id", F.when(F.col("thread_id") != "t0", F.col("thread_id")))
    row = conversation.turn_results(null_id).filter("thread_id is null").first()
    assert row["messages"] == 12 and row["answer"].endswith(" 0 11")
