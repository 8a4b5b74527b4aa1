"""The registered queries: name -> function of (spark, folder of the given tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.functions import text
from askgrid.operators import (
    citations,
    columns,
    conversation,
    docsync,
    embedding,
    judging,
    lexical,
    retrieval,
    summary,
)
from askgrid.plans import evaluation, index, rag, views
from askgrid.session import materialise, work_folder
from askgrid.sources import files
from askgrid.sources import listing as listing_source
from askgrid.streaming import conversation_state, conversation_steps, new_documents, thread_history

Query = Callable[[SparkSession, str], DataFrame]

_DOCUMENT_TYPES = ("en", "de", "es", "fr")
_FACETS = {"Positive": _DOCUMENT_TYPES, "Negative": _DOCUMENT_TYPES}


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Six decimals for the comparison of doubles between engines."""
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- summaries -----------------------------------------------------------------------------
def pos_scores_by_doctype(spark, folder):
    return summary.scores_by_document_type(views.evaluation_results(spark, folder), "Positive")


def neg_scores_by_doctype(spark, folder):
    return summary.scores_by_document_type(views.evaluation_results(spark, folder), "Negative")


def pct_match(spark, folder):
    return summary.percentage_match(views.evaluation_results(spark, folder), _DOCUMENT_TYPES)


def response_counts(spark, folder):
    models = {"model_a": "model_a", "model_b": "model_b"}
    return summary.response_counts(views.evaluation_results(spark, folder), models)


def correctness_se_by_model(spark, folder):
    means = summary.correctness_by_model(views.evaluation_results(spark, folder))
    return _rounded(means, "mean_correctness", "standard_error")


def correctness_se_by_facet(spark, folder):
    means = summary.correctness_by_facet(views.evaluation_results(spark, folder), _DOCUMENT_TYPES)
    return _rounded(means, "mean_correctness", "standard_error")


def correctness_hist(spark, folder):
    bins = summary.correctness_histogram(views.evaluation_results(spark, folder), _FACETS)
    return _rounded(bins, "bin_start", "percent")


def docmatch_hist(spark, folder):
    return _rounded(summary.match_histogram(views.evaluation_results(spark, folder), _FACETS), "percent")


def model_union(spark, folder):
    """Two models' results, one of which has no groundedness column."""
    results = views.evaluation_results(spark, folder)
    runs = {m: results.filter(F.col("model") == m).drop("model") for m in ("model_a", "model_b")}
    runs["model_a"] = runs["model_a"].drop("groundedness")
    return summary.combine_models(runs).select("row_id", "model", "correctness", "groundedness")


# --- documents -----------------------------------------------------------------------------
def _kept(spark, folder):
    return docsync.exclude_documents(views.listing(spark, folder))


def listing_parse(spark, folder):
    return listing_source.parse_listing(views.listing_responses(spark, folder), strict=False)


def listing_rejects(spark, folder):
    rejects = listing_source.rejected_responses(views.listing_responses(spark, folder))
    return rejects.select("doc_id", "status", "status_text", "reason")


def doc_exclusion_filter(spark, folder):
    return _kept(spark, folder).select("doc_id", "name", "url")


def doc_exclusion_count(spark, folder):
    return _kept(spark, folder).agg(F.count(F.lit(1)).alias("documents"))


def new_docs(spark, folder):
    return docsync.new_document_names(_kept(spark, folder), views.stored(spark, folder))


def new_docs_by_target(spark, folder):
    return docsync.new_document_names(_kept(spark, folder), views.stored(spark, folder), match_on="target")


def download_plan(spark, folder):
    plan = docsync.download_plan(_kept(spark, folder), views.stored(spark, folder))
    return plan.select("doc_id", "name", "url", "target")


def orphan_docs(spark, folder):
    return docsync.orphaned_files(_kept(spark, folder), views.stored(spark, folder))


def drop_empty_columns(spark, folder):
    documents = views.table(spark, folder, "documents").select(
        "doc_id",
        F.lit(None).cast("string").alias("blank"),
        "lang",
        F.when(F.col("doc_id") < 0, F.col("n_chars")).alias("never"),
        F.when(F.col("doc_id") == 0, "x").alias("rare"),
        "text",
    )
    return columns.drop_empty_columns(documents)


def schema_contract(spark, folder):
    documents = columns.index_field_report(views.table(spark, folder, "documents"), "embedding", "text")
    vectors = columns.index_field_report(views.table(spark, folder, "embeddings"), "embedding", "label")
    return documents.select(F.lit("documents").alias("table_name"), "*").unionByName(
        vectors.select(F.lit("embeddings").alias("table_name"), "*")
    )


# --- retrieval -----------------------------------------------------------------------------
def _chunks(spark, folder):
    return index.chunk_table(views.source_documents(spark, folder), metadata=("title", "lang"))


def _kept_chunks(spark, folder):
    """The chunk table as it is kept: written once, then read by all passes of a search."""
    path = f"{work_folder(spark)}/chunk_table"
    files.write_chunk_table(_chunks(spark, folder), path)
    return files.read_chunk_table(spark, path)


def _questions(spark, folder):
    return embedding.embed_text(views.questions(spark, folder), "question", "question_vector")


def build_chunks(spark, folder):
    chunks = _chunks(spark, folder).drop("text_vector")
    return chunks.select("chunk_id", "doc_id", "title", F.col("metadata")["lang"].alias("lang"), "chunk_no", "chunk")


def embed_text(spark, folder):
    """The questions' vectors as one row per place that is not zero."""
    placed = _questions(spark, folder).select("question_id", F.posexplode("question_vector").alias("place", "weight"))
    return placed.filter(F.col("weight") != 0)


def retrieve_topk(spark, folder):
    """All vectors as questions over all vectors as chunks."""
    vectors = views.table(spark, folder, "embeddings")
    questions = vectors.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("question_vector"))
    chunks = vectors.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("text_vector"))
    return retrieval.topk_by_vector(questions, chunks)


def retrieve_chunks(spark, folder):
    """The benchmark's texts as questions over all chunks of all documents, with the chunks' text."""
    return rag.retrieve(_questions(spark, folder), _kept_chunks(spark, folder), columns=("title", "chunk"))


def retrieve_text(spark, folder):
    return lexical.topk_by_text(views.questions(spark, folder), _chunks(spark, folder), k=5)


def retrieve_hybrid(spark, folder):
    found = lexical.topk_hybrid(_questions(spark, folder), _kept_chunks(spark, folder))
    return _scores_to_nine(found)


def _scores_to_nine(df):
    return df.withColumn("score", F.rint(F.col("score") * 1e9) / 1e9)


# --- conversations -------------------------------------------------------------------------
def _joined(*names):
    return {n: F.array_join(n, "|") for n in names}


def context_serialize(spark, folder):
    found = rag.retrieve(_questions(spark, folder), _kept_chunks(spark, folder))
    return conversation.contexts(found).select("question_id", "joined", "serialised")


def prompt_build(spark, folder):
    return conversation.answer_prompt(views.messages(spark, folder))


def conversation_filter(spark, folder):
    kept = conversation.conversation_only(views.messages(spark, folder))
    return kept.select("thread_id", "turn", "type", "content")


def turn_routing(spark, folder):
    return conversation.route_turns(views.messages(spark, folder))


def trailing_tool_run(spark, folder):
    return conversation.trailing_tool_run(views.messages(spark, folder)).select("thread_id", "turn", "content")


def last_answer(spark, folder):
    return conversation.turn_results(views.messages(spark, folder)).select("thread_id", "messages", "answer")


def last_turn_sources(spark, folder):
    results = conversation.turn_results(views.messages(spark, folder))
    return results.select("thread_id", "source_names", "source_contents").withColumns(
        _joined("source_names", "source_contents")
    )


def last_turn_sources_in_turn(spark, folder):
    results = conversation.turn_results(views.messages(spark, folder), scope="turn")
    return results.select("thread_id", "source_names", "source_contents").withColumns(
        _joined("source_names", "source_contents")
    )


def format_sources(spark, folder):
    """The sources of every tool message as links."""
    answers = views.messages(spark, folder).select(
        "thread_id", "turn", F.transform("artifact", lambda d: d["title"]).alias("source_names")
    )
    return citations.format_sources(answers, views.url_table(spark, folder), ["thread_id", "turn"])


def format_sources_csv(spark, folder):
    """The same with the table of URLs kept as a CSV file."""
    path = f"{work_folder(spark)}/urls"
    urls = views.url_table(spark, folder).orderBy("row_no").select(F.col("file_name").alias("File Name"), F.col("file_url").alias("File URL"))
    files.write_url_table(urls, path)
    answers = views.messages(spark, folder).select(
        "thread_id", "turn", F.transform("artifact", lambda d: d["title"]).alias("source_names")
    )
    return citations.format_sources(answers, files.read_url_table(spark, path), ["thread_id", "turn"])


def conversation_state_stream(spark, folder):
    messages = views.messages_of(views.table_stream(spark, folder, "conversations"))
    states = conversation_state.latest_states(conversation_state.run_to_end(messages))
    return states.withColumns(_joined("source_names", "source_contents"))


def conversation_steps_stream(spark, folder):
    """The state of a thread after each of its messages, which arrive in several steps."""
    messages = views.messages_of(views.arriving(spark, folder, "conversations", "turn"))
    steps = conversation_steps.run_to_end(messages)
    columns = ["session_id", "thread_id", "turn", "messages", "last_turn", "answer", "source_names", "source_contents"]
    return steps.select(*columns).withColumns(_joined("source_names", "source_contents"))


def thread_history_stream(spark, folder):
    """What a model sees of each thread, appended as messages arrive in several steps."""
    messages = views.messages_of(views.arriving(spark, folder, "conversations", "turn"))
    shown = F.transform("history", lambda m: F.concat(m["type"], F.lit(": "), m["text"]))
    return thread_history.run_to_end(messages).withColumn("history", F.array_join(shown, "\n"))


def new_docs_stream(spark, folder):
    listing = views.listing_of(views.table_stream(spark, folder, "documents"))
    plans = new_documents.run_to_end(listing, lambda: views.stored(spark, folder))
    return plans.select("doc_id", "name", "url")


# --- scores --------------------------------------------------------------------------------
def docname_cleanup(spark, folder):
    answers = views.answered_questions(spark, folder)
    names = judging.cleaned_names(F.col("retrieved_files"))
    return answers.select("conv_id", "turn", F.array_join(names, "|").alias("names"))


def doc_match(spark, folder):
    answers = views.answered_questions(spark, folder)
    return answers.select("conv_id", "turn", judging.document_match().alias("document_match"))


def score_parse(spark, folder):
    return views.judge_replies(spark, folder).select("doc_id", text.parse_score(F.col("reply")).alias("score"))


def judge_prompt_build(spark, folder):
    return views.answered_questions(spark, folder).select(
        "conv_id",
        "turn",
        judging.correctness_prompt().alias("correctness_prompt"),
        judging.retrieval_prompt().alias("retrieval_prompt"),
        judging.groundedness_prompt().alias("groundedness_prompt"),
    )


def judge_correctness(spark, folder):
    scored = judging.OVERLAP_CORRECTNESS.add_score(views.answered_questions(spark, folder), "correctness")
    return scored.select("conv_id", "turn", "correctness")


def judge_retrieval(spark, folder):
    scored = judging.OVERLAP_RETRIEVAL.add_score(views.answered_questions(spark, folder), "retrieval")
    return scored.select("conv_id", "turn", "retrieval")


def judge_groundedness(spark, folder):
    scored = judging.OVERLAP_GROUNDEDNESS.add_score(views.answered_questions(spark, folder), "groundedness")
    return scored.select("conv_id", "turn", "groundedness")


_MEASURES = ("correctness", "retrieval", "groundedness", "document_match")


def eval_scores(spark, folder):
    scored = judging.score_responses(views.answered_questions(spark, folder))
    return scored.select("conv_id", "turn", *_MEASURES)


def eval_no_retrieval_defaults(spark, folder):
    """Scores by whether anything was retrieved."""
    scored = judging.score_responses(views.answered_questions(spark, folder))
    return scored.groupBy(judging.was_retrieved().alias("retrieved")).agg(
        F.count(F.lit(1)).alias("answers"),
        F.sum("correctness").alias("correctness"),
        F.sum("retrieval").alias("retrieval"),
        F.sum("groundedness").alias("groundedness"),
        F.count_if("document_match").alias("matches"),
    )


def eval_export(spark, folder):
    """Scores written as CSV, arrays as JSON, and read back; an empty answer comes back as null."""
    scored = evaluation.score_and_arrange(views.answered_questions(spark, folder))
    chosen = scored.select("conv_id", "turn", "question", "answer", *_MEASURES, *evaluation.CONTEXT_COLUMNS)
    path = f"{work_folder(spark)}/results"
    files.export_results(chosen, path)
    schema = ", ".join(f"{c} {'string' if k.startswith('array') else k}" for c, k in chosen.dtypes)
    read = files.read_results(spark, path, schema, evaluation.CONTEXT_COLUMNS)
    return read.withColumns(_joined(*evaluation.CONTEXT_COLUMNS))


# --- whole runs ----------------------------------------------------------------------------
def batch_rag(spark, folder):
    """Single-turn answers of the benchmark's texts over all chunks of all documents."""
    answers = rag.answer_questions(_questions(spark, folder), _kept_chunks(spark, folder), k=5, search="vector")
    return answers.select(
        "question_id", "answer", "source_names", F.col("prompt")[0]["text"].alias("prompt")
    ).withColumns(_joined("source_names"))


def batch_rag_default(spark, folder):
    """Single-turn answers as they are made if nothing else is said: both searches fused, four chunks."""
    answers = rag.answer_questions(_questions(spark, folder), _kept_chunks(spark, folder))
    return answers.select(
        "question_id", "answer", "source_names", F.col("prompt")[0]["text"].alias("prompt")
    ).withColumns(_joined("source_names"))


def multiturn_rag(spark, folder):
    """Multi-turn answers as message rows, reduced to each thread's answer and sources."""
    turns = rag.answer_turns(_questions(spark, folder), _kept_chunks(spark, folder), search="vector")
    turns = materialise(turns, "turns")
    results = conversation.turn_results(turns)
    return results.select("thread_id", "messages", "answer", "source_names").withColumns(_joined("source_names"))


def thread_rag(spark, folder):
    """Every conversation that waits for an answer, answered with its history in the prompt."""
    answered = rag.answer_open_threads(views.messages(spark, folder), _kept_chunks(spark, folder), search="vector")
    names = F.flatten(F.transform("calls", lambda c: F.transform(c["documents"], lambda d: d["title"])))
    shown = F.transform("prompt", lambda m: F.concat(m["type"], F.lit(": "), m["text"]))
    return answered.select(
        "thread_id",
        "last_turn",
        "question",
        "answer",
        F.array_join(names, "|").alias("source_names"),
        F.array_join(shown, "\n").alias("prompt"),
    )


def _by_length():
    """A policy by the number of messages: it answers itself, asks the question, or asks the first message, too."""

    def choose(histories):
        choices = []
        for history in histories:
            question, first = history[-1][1], history[0][1]
            kind = len(history) % 3
            choices.append((f"You asked: {question}", []) if kind == 0 else (None, [question, first][:kind]))
        return choices

    return choose


def thread_rag_policy(spark, folder):
    """As `thread_rag`, but a policy decides for each conversation on none, one or two queries."""
    answered = rag.answer_open_threads(
        views.messages(spark, folder), _kept_chunks(spark, folder), search="vector", policy=_by_length
    )
    names = F.flatten(F.transform("calls", lambda c: F.transform(c["documents"], lambda d: d["title"])))
    shown = F.transform("prompt", lambda m: F.concat(m["type"], F.lit(": "), m["text"]))
    return answered.select(
        "thread_id",
        "last_turn",
        "question",
        F.coalesce(F.size("calls"), F.lit(0)).cast("long").alias("queries"),
        "answer",
        F.coalesce(F.array_join(names, "|"), F.lit("")).alias("source_names"),
        F.array_join(shown, "\n").alias("prompt"),
    )


def eval_run(spark, folder):
    """A truth set answered and scored end to end."""
    scored = evaluation.evaluate_truth_set(
        views.truth_set(spark, folder), _kept_chunks(spark, folder), search="vector"
    )
    return scored.drop("retrieved_contents").withColumns(_joined("retrieved_files"))


def eval_run_default(spark, folder):
    """The same with both searches fused, as if nothing else is said."""
    scored = evaluation.evaluate_truth_set(views.truth_set(spark, folder), _kept_chunks(spark, folder))
    return scored.drop("retrieved_contents").withColumns(_joined("retrieved_files"))


def eval_summary_run(spark, folder):
    """A truth set answered, scored and written, and all summaries of it, in one run."""
    truth = views.truth_set(spark, folder).withColumns(
        {
            "question_type": F.when(F.col("row_id") % 2 == 0, "Positive").otherwise(" Negative "),
            "unambiguous": F.when(F.col("row_id") % 5 == 0, "No").otherwise("Yes"),
        }
    )
    scored = evaluation.evaluate_truth_set(truth, _kept_chunks(spark, folder), search="vector")
    scored = summary.tag_model(materialise(scored.drop(*evaluation.CONTEXT_COLUMNS), "scored"), "offline")
    found = evaluation.summaries(scored, {"offline": "offline"}, _DOCUMENT_TYPES)
    return found.withColumn("value", F.rint(F.col("value") * 1e6) / 1e6)


# --- files ---------------------------------------------------------------------------------
def summary_export(spark, folder):
    """A summary written as one CSV file and read back."""
    means = neg_scores_by_doctype(spark, folder)
    path = f"{work_folder(spark)}/means"
    files.write_summary(means, path, ["document_type"])
    return spark.read.option("header", True).schema(means.schema).csv(path)


def truth_set_read(spark, folder):
    """The truth set as a CSV file with line breaks in its cells, read with its schema."""
    truth = views.truth_set(spark, folder).select(
        F.col("question").alias("Question"),
        F.col("true_answer").alias("True Answer"),
        F.col("file").alias("File"),
        F.col("document_type").alias("Document Type"),
    )
    path = f"{work_folder(spark)}/truth"
    files.export_results(truth, path)
    return files.read_truth_set(spark, path, ", ".join(f"`{c}` STRING" for c in truth.columns))


_QUERIES: list[Query] = [
    pos_scores_by_doctype,
    neg_scores_by_doctype,
    pct_match,
    response_counts,
    correctness_se_by_model,
    correctness_se_by_facet,
    correctness_hist,
    docmatch_hist,
    model_union,
    listing_parse,
    listing_rejects,
    doc_exclusion_filter,
    doc_exclusion_count,
    new_docs,
    new_docs_by_target,
    download_plan,
    orphan_docs,
    drop_empty_columns,
    schema_contract,
    build_chunks,
    embed_text,
    retrieve_topk,
    retrieve_chunks,
    retrieve_text,
    retrieve_hybrid,
    context_serialize,
    prompt_build,
    conversation_filter,
    turn_routing,
    trailing_tool_run,
    last_answer,
    last_turn_sources,
    last_turn_sources_in_turn,
    format_sources,
    format_sources_csv,
    conversation_state_stream,
    conversation_steps_stream,
    thread_history_stream,
    new_docs_stream,
    docname_cleanup,
    doc_match,
    score_parse,
    judge_prompt_build,
    judge_correctness,
    judge_retrieval,
    judge_groundedness,
    eval_scores,
    eval_no_retrieval_defaults,
    eval_export,
    batch_rag,
    batch_rag_default,
    multiturn_rag,
    thread_rag,
    thread_rag_policy,
    eval_run,
    eval_run_default,
    eval_summary_run,
    summary_export,
    truth_set_read,
]


def all_queries() -> dict[str, Query]:
    return {q.__name__: q for q in _QUERIES}
