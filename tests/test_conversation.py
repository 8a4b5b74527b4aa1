import pytest

from askgrid.operators import citations, conversation
from askgrid.functions import fixed_values as fixed

SCHEMA = (
    "thread_id STRING, turn BIGINT, type STRING, content STRING, "
    "tool_calls ARRAY<STRUCT<name: STRING, args: STRING>>, artifact ARRAY<STRUCT<title: STRING, page_content: STRING>>"
)
CALL = [("retrieve", "q")]


@pytest.fixture
def messages(spark):
    rows = [
        # no tool message
        ("plain", 0, "human", "hi", [], []),
        ("plain", 1, "ai", "hello", None, None),
        # two trailing tool messages behind an earlier one
        ("two", 0, "tool", "t0", [], [("old", "o")]),
        ("two", 1, "human", "q", [], []),
        ("two", 2, "ai", "", CALL, []),
        ("two", 3, "tool", "t3", [], [("a", "A")]),
        ("two", 4, "tool", "t4", [], [("b", "B"), ("b", "B2"), None]),
        # tool only in an earlier turn
        ("earlier", 0, "human", "q1", [], []),
        ("earlier", 1, "tool", "t", [], [("e", "E")]),
        ("earlier", 2, "ai", "a1", [], []),
        ("earlier", 3, "human", "q2", [], []),
        ("earlier", 4, "ai", "a2", [], []),
        # latest tool message without artifact
        ("empty", 0, "tool", "t0", [], [("x", "X")]),
        ("empty", 1, "human", "q", [], []),
        ("empty", 2, "tool", "t2", [], []),
        ("empty", 3, "ai", "last", [], []),
        # tools only
        ("tools", 0, "tool", "u0", [], [("u", "U")]),
        ("tools", 1, "tool", "u1", [], None),
        # ends in a call
        ("call", 0, "system", "s", [], []),
        ("call", 1, "ai", "calling", CALL, []),
    ]
    # Rows arrive in no order.
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "content")


def by_thread(df, *columns):
    return {r["thread_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_turn_results(messages):
    got = by_thread(conversation.turn_results(messages), "answer", "source_names", "source_contents", "messages")
    assert got == {
        "plain": ("hello", [], [], 2),
        "two": ("t4", ["b", "b"], ["B", "B2"], 5),
        "earlier": ("a2", ["e"], ["E"], 5),
        "empty": ("last", [], [], 4),
        "tools": ("u1", [], [], 2),
        "call": ("calling", [], [], 2),
    }


def test_sources_of_this_turn_only(messages):
    got = by_thread(conversation.turn_results(messages, scope="turn"), "source_names")
    assert got["earlier"] == ([],)
    assert got["two"] == (["b", "b"],)
    with pytest.raises(ValueError):
        conversation.turn_results(messages, scope="day")


def test_trailing_tool_run(messages):
    run = conversation.trailing_tool_run(messages).orderBy("thread_id", "turn").collect()
    assert [(r["thread_id"], r["content"]) for r in run] == [("tools", "u0"), ("tools", "u1"), ("two", "t3"), ("two", "t4")]


def test_conversation_only(messages):
    kept = {(r["thread_id"], r["turn"]) for r in conversation.conversation_only(messages).collect()}
    assert ("two", 2) not in kept and ("call", 1) not in kept
    assert {("plain", 0), ("plain", 1), ("two", 1), ("call", 0), ("empty", 3)} <= kept
    assert not any(thread == "tools" for thread, _ in kept)


def test_route(messages):
    got = by_thread(conversation.route_turns(messages), "route")
    assert got["call"] == ("tools",)
    assert {t for t, r in got.items() if r == ("end",)} == {"plain", "two", "earlier", "empty", "tools"}


def test_prompt(messages):
    prompts = {}
    for r in conversation.answer_prompt(messages).orderBy("thread_id", "place", "part").collect():
        prompts.setdefault(r["thread_id"], {}).setdefault((r["place"], r["type"]), []).append(r["text"])
    texts = {t: [(kind, "".join(parts)) for (_, kind), parts in p.items()] for t, p in prompts.items()}
    assert texts["two"] == [("system", fixed.ANSWER_INSTRUCTION + "t3\n\nt4"), ("human", "q")]
    assert texts["plain"] == [("system", fixed.ANSWER_INSTRUCTION), ("human", "hi"), ("ai", "hello")]
    assert texts["tools"] == [("system", fixed.ANSWER_INSTRUCTION + "u0\n\nu1")]
    assert texts["call"] == [("system", fixed.ANSWER_INSTRUCTION), ("system", "s")]


def test_contexts(spark):
    rows = [("q", 2, "b.pdf", {"title": "b.pdf"}, "second"), ("q", 1, "a.pdf", {"title": "a.pdf"}, "first")]
    df = spark.createDataFrame(rows, "question_id STRING, rank INT, title STRING, metadata MAP<STRING, STRING>, chunk STRING")
    row = conversation.contexts(df).first()
    assert row["joined"] == "first\n\nsecond"
    assert row["serialised"] == (
        "Source: {'title': 'a.pdf'}\nContent: first\n\nSource: {'title': 'b.pdf'}\nContent: second"
    )
    bare = df.select("question_id", "rank", "title", "chunk").selectExpr("*", "cast(null as map<string, string>) as metadata")
    assert conversation.contexts(bare).first()["serialised"].startswith("Source: {}\nContent: first")
    assert [tuple(d) for d in row["documents"]] == [("a.pdf", "first"), ("b.pdf", "second")]


def test_format_sources(spark):
    urls = spark.createDataFrame(
        [("a", "http://later", 9), ("a", "http://first", 1), ("b", "http://b", 3), ("c", None, 4)],
        "file_name STRING, file_url STRING, row_no BIGINT",
    )
    answers = spark.createDataFrame(
        [
            (1, ["a"]),
            (2, ["unknown", "b", "unknown", "a", "b"]),
            (3, []),
            (4, None),
            (5, ["c", "x"]),
        ],
        "id INT, source_names ARRAY<STRING>",
    )
    got = {r["id"]: r["sources"] for r in citations.format_sources(answers, urls, ["id"]).collect()}
    assert got == {
        1: "**Most Relevant Document:**\n- [a](http://first)",
        2: "**Most Relevant Document:**\n- unknown\n\n**Other Related Documents:**\n- [b](http://b)\n- [a](http://first)",
        3: None,
        4: None,
        5: "**Most Relevant Document:**\n- [c](nan)\n\n**Other Related Documents:**\n- x",
    }
