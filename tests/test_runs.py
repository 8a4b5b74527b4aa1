"""Whole runs, files and streams."""

import io

import pandas as pd
import pytest
from pyspark.sql import functions as F

from askgrid.functions import fixed_values as fixed
from askgrid.operators import conversation, judging, summary
from askgrid.operators.citations import first_urls
from askgrid.operators.embedding import embed_text, hashed_terms
from askgrid.plans import evaluation, index, rag, views
from askgrid.session import spread, work_folder
from askgrid.sources import files
from askgrid.streaming import conversation_state, new_documents

CAPITALS = [("France", "Paris"), ("Spain", "Madrid"), ("Germany", "Berlin"), ("Italy", "Rome"), ("Greece", "Athens")]
EMBEDDER = hashed_terms(2048)  # wide enough that these words do not share a place


@pytest.fixture
def chunks(spark):
    rows = [
        (i, f"One Page {country}.pdf", f"{country} is a country. The capital of {country} is {city}. It has {i} rivers!")
        for i, (country, city) in enumerate(CAPITALS)
    ]
    documents = spark.createDataFrame(rows, "doc_id INT, title STRING, text STRING")
    return index.chunk_table(documents, size=200, overlap=20, embedder=EMBEDDER)


@pytest.fixture
def questions(spark):
    rows = [(i, f"What is the capital of {country}?") for i, (country, _) in enumerate(CAPITALS)]
    asked = spark.createDataFrame(rows, "question_id BIGINT, question STRING")
    return embed_text(asked, "question", "question_vector", EMBEDDER)


@pytest.mark.parametrize("search", ["vector", "hybrid"])
def test_single_turn(chunks, questions, search):
    got = {r["question_id"]: r for r in rag.answer_questions(questions, chunks, k=2, search=search).collect()}
    assert len(got) == len(CAPITALS)
    for i, (country, city) in enumerate(CAPITALS):
        assert got[i]["answer"] == f"The capital of {country} is {city}"
        assert got[i]["source_names"][0] == f"One Page {country}.pdf" and len(got[i]["source_names"]) == 2
        prompt = got[i]["prompt"][0]["text"]
        assert got[i]["prompt"][0]["type"] == "human"
        assert "Context: " + "\n\n".join(got[i]["source_contents"]) + " \nAnswer:" in prompt


def test_multi_turn(chunks, questions):
    turns = rag.answer_turns(questions, chunks, k=2, wants_retrieval=F.col("question_id") != 3)
    kinds = {}
    for r in turns.orderBy("thread_id", "turn").collect():
        kinds.setdefault(r["thread_id"], []).append(r["type"])
    assert kinds[3] == ["human", "ai"] and kinds[0] == ["human", "ai", "tool", "ai"]
    results = {r["thread_id"]: r for r in conversation.turn_results(turns).collect()}
    assert results[3]["answer"] == rag.UNKNOWN_ANSWER and results[3]["source_names"] == []
    assert results[0]["answer"] == "The capital of France is Paris"
    tool = turns.filter("thread_id = 0 and type = 'tool'").first()
    assert tool["content"].startswith("Source: {'title': 'One Page France.pdf'}\nContent: France is a country.")


def echo():
    """A generator that answers with the number and kinds of its messages."""
    return lambda prompts: ["/".join(f"{kind}:{len(text)}" for kind, text in p) for p in prompts]


def test_generator_gets_the_prompt(chunks, questions):
    turns = rag.answer_turns(questions, chunks, k=1, generator=echo, wants_retrieval=F.col("question_id") == 0)
    answers = {r["thread_id"]: r["answer"] for r in conversation.turn_results(turns).collect()}
    shown = "Source: {'title': 'One Page France.pdf'}\nContent: " + (
        "France is a country. The capital of France is Paris. It has 0 rivers!"
    )
    assert answers[0] == f"system:{len(fixed.ANSWER_INSTRUCTION + shown)}/human:30"
    assert answers[1] == "human:29"


def test_generator_runs_once_per_question(spark, chunks, questions):
    calls = spark.sparkContext.accumulator(0)

    def counting():
        def generate(prompts):
            calls.add(len(prompts))
            return ["x"] * len(prompts)

        return generate

    answers = rag.answer_questions(questions, chunks, k=1, search="vector", generator=counting)
    answers.collect(), answers.count(), answers.filter("answer = 'x'").count()
    assert calls.value == len(CAPITALS)


def ten(instruction="10"):
    return lambda pairs: ["10"] * len(pairs)


def truth(spark):
    rows = [
        (i, f"What is the capital of {country}?", f"The capital of {country} is {city}.", f" {country}\n", "Fact Sheet", "Positive", "Yes", None)
        for i, (country, city) in enumerate(CAPITALS)
    ]
    return spark.createDataFrame(
        rows,
        "row_id BIGINT, question STRING, true_answer STRING, file STRING, document_type STRING, question_type STRING, "
        "unambiguous STRING, blank STRING",
    )


@pytest.mark.parametrize("judges", [None, judging.Judges.asking(ten)])
def test_evaluate_truth_set(spark, chunks, judges):
    scored = evaluation.evaluate_truth_set(truth(spark), chunks, k=2, embedder=EMBEDDER, judges=judges, concurrency=3)
    assert "blank" not in scored.columns
    assert scored.columns[-2:] == ["retrieved_files", "retrieved_contents"]
    got = scored.collect()
    assert len(got) == len(CAPITALS) and all(r["document_match"] and r["correctness"] == 10 for r in got)
    means = summary.scores_by_document_type(scored, "Positive").first()
    assert means["correctness"] == 10.0


def test_from_truth_file_to_summary(spark, chunks, tmp_path):
    lines = ["Question,True Answer,File,Question Type,Document Type,Unambiguous"]
    for country, city in CAPITALS:
        lines.append(f"What is the capital of {country}?,The capital of {country} is {city}., {country}, Positive ,Fact Sheet ,Yes")
    (tmp_path / "truth.csv").write_text("\n".join(lines))
    truth_set = files.prepare_truth_set(files.read_truth_set(spark, str(tmp_path / "truth.csv")))
    scored = evaluation.evaluate_truth_set(truth_set, chunks, k=2, embedder=EMBEDDER).drop("row_id")
    files.export_results(files.with_headings(scored), str(tmp_path / "results"))
    (part, *_) = (tmp_path / "results").glob("*.csv")
    assert part.read_text().split("\n")[0] == (
        "Question,True Answer,File,Question Type,Document Type,Unambiguous,Answer,Correctness,Retrieval,Groundedness,"
        "Document Match,Retrieved Files,Retrieved Contents"
    )
    results = files.plain_names(files.read_results(spark, str(tmp_path / "results")))
    assert results.count() == len(CAPITALS)
    means = summary.scores_by_document_type(results, "Positive").first()
    assert (means["document_type"], means["correctness"]) == ("Fact Sheet", 10.0)
    share = summary.percentage_match(summary.tag_model(results, "m")).first()
    assert (share["percentage_match"], share["label"]) == (100.0, "100.0%")


def test_files(spark, tmp_path):
    folder = tmp_path / "raw docs"
    (folder / "inner").mkdir(parents=True)
    for name in ("a.pdf", "b c.txt", "_b.pdf", ".c.pdf"):
        (folder / name).write_text("content")
    (folder / "inner" / "deep.pdf").write_text("content")
    names = sorted(r["file_name"] for r in files.stored_files(spark, str(folder)).collect())
    assert names == [".c.pdf", "_b.pdf", "a.pdf", "b c.txt"]
    assert files.stored_files(spark, str(tmp_path / "missing")).collect() == []
    assert files.stored_files(spark, str(folder / "a.pdf")).collect() == []
    (tmp_path / "a" / "a").mkdir(parents=True)
    (tmp_path / "a" / "a" / "a").write_text("content")
    assert [r["file_name"] for r in files.stored_files(spark, str(tmp_path / "a" / "a")).collect()] == ["a"]
    (tmp_path / "none").mkdir()
    assert files.stored_files(spark, str(tmp_path / "none")).collect() == []


def test_stored_files_reads_no_content(spark, tmp_path, capsys):
    (tmp_path / "a.pdf").write_text("content")
    files.stored_files(spark, str(tmp_path)).explain()
    assert "content" not in capsys.readouterr().out.split("ReadSchema")[-1]


def test_url_table(spark, tmp_path):
    for folder in ("first", "second"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.pdf").write_text("x")
    (tmp_path / "second" / "b.pdf").write_text("x")
    out = str(tmp_path / "table")
    table = files.build_url_table(spark, [str(tmp_path / "first"), str(tmp_path / "second")])
    assert table.columns == ["Folder Name", "Folder ID", "File Name", "File URL"]
    files.write_url_table(table.limit(1), out)
    files.write_url_table(table, out)  # in place of the first
    got = files.read_url_table(spark, out)
    assert sorted(r["file_name"] for r in got.collect()) == ["b.pdf", "same.pdf", "same.pdf"]
    assert got.select("row_no").distinct().count() == 3


def test_url_table_keeps_the_order_of_the_file(spark, tmp_path):
    lines = ["Folder Name,Folder ID,File Name,File URL"] + [f"f,1,n.pdf,http://{i}" for i in range(500)]
    (tmp_path / "urls.csv").write_text("\n".join(lines))
    assert first_urls(files.read_url_table(spark, str(tmp_path / "urls.csv"))).first()["file_url"] == "http://0"


def test_results_round_trip(spark, tmp_path):
    rows = [(1, 'say "x",\nnew line', ["a", 'b "q"'], True, " pad "), (2, None, [], False, "")]
    df = spark.createDataFrame(rows, "id INT, answer STRING, files ARRAY<STRING>, match BOOLEAN, note STRING")
    files.export_results(df, str(tmp_path / "csv"))
    back = files.read_results(spark, str(tmp_path / "csv"), "id INT, answer STRING, files STRING, match BOOLEAN, note STRING", ["files"])
    got = {r["id"]: tuple(r)[1:] for r in back.collect()}
    assert got[1] == ('say "x",\nnew line', ["a", 'b "q"'], True, " pad ")
    assert got[2][:3] == (None, [], False)
    files.write_results(df, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    with pytest.raises(Exception, match="already exists"):
        files.write_results(df, str(tmp_path / "parquet"))


def test_truth_set_and_summary_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "Question,True Answer,File,Question Type,Document Type,Unambiguous\n"
        '"Two\nlines?","He said ""yes""",F, Positive ,Fact Sheet,Yes\n'
    )
    row = files.read_truth_set(spark, str(tmp_path / "t.csv")).first()
    assert row["Question"] == "Two\nlines?" and row["True Answer"] == 'He said "yes"' and row["Question Type"] == " Positive "
    means = spark.createDataFrame([(2.5, "b"), (1.0, "a")], "correctness DOUBLE, document_type STRING")
    files.write_summary(means, str(tmp_path / "means"), ["document_type"])
    (part,) = (tmp_path / "means").glob("*.csv")
    assert part.read_text() == "document_type,correctness\na,1.0\nb,2.5\n"


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Extra,Correctness,Question,Document Match\nx,7.0,Why?,True\ny,,How?,False\n")
    got = files.read_results(spark, str(tmp_path / "r.csv")).collect()
    assert [(r["Question"], r["Correctness"], r["Document Match"], r["Extra"], r["Answer"]) for r in got] == [
        ("Why?", 7, True, "x", None),
        ("How?", None, False, "y", None),
    ]
    (tmp_path / "u.csv").write_text("File URL,File Name\nhttp://a,a.pdf\n")
    row = files.read_url_table(spark, str(tmp_path / "u.csv")).first()
    assert (row["file_name"], row["file_url"]) == ("a.pdf", "http://a")


def comma_sheet(content, sheet):
    """Stands for a workbook reader: the first line names the sheet, the rest is CSV."""
    first, rest = content.decode().split("\n", 1)
    assert first == sheet
    return pd.read_csv(io.StringIO(rest), dtype=str)


def test_truth_workbook(spark, tmp_path):
    (tmp_path / "truth.xlsx").write_text("Questions\nFile,Question,Extra\nf.pdf,Why?,1\n,How?,2\n")
    got = files.read_truth_workbook(spark, str(tmp_path / "truth.xlsx"), reader=comma_sheet).collect()
    assert [(r["Question"], r["File"], r["True Answer"]) for r in got] == [("Why?", "f.pdf", None), ("How?", None, None)]


def test_prompts(spark, tmp_path):
    (tmp_path / "one.txt").write_text("first\nline")
    (tmp_path / "two.txt").write_text("second")
    assert files.read_prompts(spark, str(tmp_path)) == {"one": "first\nline", "two": "second"}


def test_chunk_table_file(spark, chunks, tmp_path):
    files.write_chunk_table(chunks, str(tmp_path / "chunks"))
    assert files.read_chunk_table(spark, str(tmp_path / "chunks")).count() == len(CAPITALS)
    with pytest.raises(ValueError):
        files.read_chunk_table(spark, str(tmp_path / "chunks"), "content_vector", "content")


MESSAGES = (
    "session_id STRING, thread_id STRING, turn BIGINT, type STRING, content STRING, "
    "tool_calls ARRAY<STRUCT<name: STRING, args: STRING>>, artifact ARRAY<STRUCT<title: STRING, page_content: STRING>>"
)


@pytest.mark.parametrize("scope", ["thread", "turn"])
def test_conversation_stream_equals_batch(spark, tmp_path, scope):
    rows = []
    for session in ("s1", "s2"):
        for thread in range(6):
            for turn in range(thread + 1):
                kind = ("human", "tool", "ai")[turn % 3]
                artifact = [(f"d{turn}", f"{session}{thread}")] if kind == "tool" else []
                rows.append((session, f"t{thread}", turn, kind, f"c{turn}", [], artifact))
    source = tmp_path / "messages"
    # Later turns in later files, so that threads go on over several steps.
    for low, high in ((0, 2), (2, 4), (4, 9)):
        part = [r for r in rows if low <= r[2] < high]
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(str(source))
    steps = conversation_state.run_to_end(stream, scope)
    assert steps.select("step").distinct().count() == 3
    # A step holds only the threads that it changed.
    assert steps.count() < 3 * 12
    key = ("session_id", "thread_id")
    got = conversation_state.latest_states(steps)
    batch = conversation.turn_results(spark.createDataFrame(rows, MESSAGES), scope, key).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_conversation_stream_goes_on_after_a_restart(spark, tmp_path):
    source, path = str(tmp_path / "messages"), str(tmp_path / "state")
    def run():
        stream = spark.readStream.schema(MESSAGES).parquet(source)
        conversation_state.write_states(conversation_state.thread_states(stream), path).awaitTermination()

    spark.createDataFrame([("s", "t", 0, "human", "q", [], []), ("s", "t", 1, "tool", "x", [], [("d", "p")])], MESSAGES).coalesce(1).write.parquet(source)
    run()
    spark.createDataFrame([("s", "t", 2, "ai", "a", [], [])], MESSAGES).coalesce(1).write.mode("append").parquet(source)
    run()
    last = conversation_state.latest_states(spark.read.parquet(f"{path}/states")).first()
    assert (last["messages"], last["answer"], last["source_names"]) == (3, "a", ["d"])


def test_new_documents_stream(spark, tmp_path):
    source, stored = str(tmp_path / "listing"), str(tmp_path / "stored")
    schema = "name STRING, url STRING"
    spark.createDataFrame([("Old.pdf",)], "file_name STRING").write.parquet(stored)
    for rows in ([("Old", "/o.pdf"), ("New", "/n.pdf")], [("Newer", "/m.docx"), ("CCS x", "/c.pdf")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    plans = new_documents.run_to_end(stream, lambda: spark.read.parquet(stored))
    got = sorted((r["name"], r["target"]) for r in plans.collect())
    assert got == [("New", "raw_docs/New.pdf"), ("Newer", "raw_docs/Newer.docx")]


def test_spread_leaves_partitioned_tables_alone(spark):
    few, many = spark.range(100, numPartitions=2), spark.range(100, numPartitions=50)
    assert spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(many, "id") is many


def test_work_folders_differ(spark):
    assert work_folder(spark) != work_folder(spark)


def _thread(spark, rows, kind="type"):
    calls = "array<struct<name: string, args: string>>"
    schema = f"thread_id STRING, turn LONG, {kind} STRING, content STRING, tool_calls {calls}"
    return spark.createDataFrame([(*r, []) if len(r) == 4 else r for r in rows], schema)


def _small_chunks(spark):
    documents = spark.createDataFrame(
        [(1, "a.pdf", "Cats purr at night. Dogs bark."), (2, "b.pdf", "The moon is made of rock.")],
        "doc_id LONG, title STRING, text STRING",
    )
    return index.chunk_table(documents, metadata=("title",))


class _TwoQueries:
    """Answers greetings itself, asks two queries for anything else."""

    def __call__(self, histories):
        return [
            ("Hello!", []) if h[-1][1] == "hi" else (None, ["moon rock", f"cats {len(h)}"]) for h in histories
        ]


class _Counting:
    def __call__(self, prompts):
        return [f"{len(p)} messages, {p[0][0]} first, {p[-1][1]} last" for p in prompts]


def test_threads_are_answered_with_their_history(spark):
    messages = _thread(
        spark,
        [
            ("t1", 0, "human", "What do cats do?"),
            ("t1", 1, "ai", "", [("retrieve", "cats")]),
            ("t1", 2, "tool", "context"),
            ("t1", 3, "ai", "They purr."),
            ("t1", 4, "human", "And the moon?"),
            ("t2", 0, "human", "hi"),
            ("t3", 0, "human", "answered"),
            ("t3", 1, "ai", "yes"),
        ],
    )
    chunks = _small_chunks(spark)
    default = {r["thread_id"]: r for r in rag.answer_open_threads(messages, chunks, search="vector").collect()}
    assert set(default) == {"t1", "t2"}
    prompt = [(m["type"], m["text"]) for m in default["t1"]["prompt"]]
    assert [p[0] for p in prompt] == ["system", "human", "ai", "human"]
    assert [p[1] for p in prompt[1:]] == ["What do cats do?", "They purr.", "And the moon?"]
    assert "made of rock" in prompt[0][1] and "made of rock" in default["t1"]["answer"]

    rows = rag.answer_threads(messages, chunks, search="vector", policy=_TwoQueries, generator=_Counting).collect()
    got = sorted([(r["thread_id"], r["turn"], r["type"], r["content"]) for r in rows])
    assert got[-1] == ("t2", 1, "ai", "Hello!")
    first = [g[1:3] for g in got if g[0] == "t1"]
    assert first == [(5, "ai"), (6, "tool"), (7, "tool"), (8, "ai")]
    assert got[3][3] == "4 messages, system first, And the moon? last"
    call = next(r for r in rows if r["thread_id"] == "t1" and r["turn"] == 5)
    assert [c["args"] for c in call["tool_calls"]] == ["moon rock", "cats 3"]


def test_threads_with_role_instead_of_type(spark):
    messages = _thread(spark, [("t", 0, "system", "Be kind."), ("t", 1, "user", "Dogs?")], kind="role").drop("tool_calls")
    row = rag.answer_open_threads(messages, _small_chunks(spark), search="vector").first()
    assert [m["type"] for m in row["prompt"]] == ["system", "system", "human"] and row["answer"] == "Dogs bark"


def test_views_keep_their_rows(spark):
    folder = "/root/testdata/sf0.01"
    conversations = views.table(spark, folder, "conversations")
    assert views.answered_questions(spark, folder).count() == conversations.filter("role = 'user'").count()
    assert views.truth_set(spark, folder).count() == views.table(spark, folder, "benchmark").count()
    assert views.evaluation_results(spark, folder).count() == views.table(spark, folder, "documents").count()
