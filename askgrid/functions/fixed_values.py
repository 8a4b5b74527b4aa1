"""Texts, names and constants that must be exactly these for results to agree.

They are stated here once, as plain values; the functions that use them take them as
parameter defaults, so a caller may replace any of them.
"""

# --- fixed values: document listing -------------------------------------------------------
ACCEPTED_STATUS = 9001
LISTING_FIELDS = ("name", "getfileurl", "modifydate")
LISTING_MAX_ROWS = 1000
EXCLUDED_NAME_PREFIX = "CCS"
EXCLUDED_NAME_PARTS = ("Market Strategy", "Market Summary")
STORED_SUFFIX = ".pdf"
STORED_FOLDER = "raw_docs"

# --- fixed values: URL table --------------------------------------------------------------
URL_TABLE_COLUMNS = ("Folder Name", "Folder ID", "File Name", "File URL")

# --- fixed values: chunk table ------------------------------------------------------------
INDEX_VECTOR_FIELD = "content_vector"
INDEX_CONTENT_FIELD = "content"
CHUNK_VECTOR_FIELD = "text_vector"
CHUNK_CONTENT_FIELD = "chunk"
MULTI_TURN_K = 5
SINGLE_TURN_K = 4  # the usual store client's k where the caller names none

# --- fixed values: document names ---------------------------------------------------------
NAME_SUFFIX_PATTERN = "(?id).pdf$"
NAME_NOISE = "One Page "

# --- fixed values: scores -----------------------------------------------------------------
SCORE_MIN = 1
SCORE_MAX = 10
SCORE_ERROR = "Model returned unexpected score: '"

# --- fixed values: truth set --------------------------------------------------------------
TRUTH_SHEET = "Questions"

# --- fixed values: summaries --------------------------------------------------------------
DOCUMENT_TYPES = ("Fact Sheet", "Market Report", "Doc Search")
QUESTION_TYPES = ("Positive", "Negative")
HISTOGRAM_FACETS = {
    "Positive": ("Doc Search", "Fact Sheet", "Market Report"),
    "Negative": ("Fact Sheet", "Market Report"),
}
UNAMBIGUOUS = "Yes"
MATCH_CATEGORIES = ("True", "False")

# --- fixed values: answer prompt ----------------------------------------------------------
# The sentences run together without a space in places; that is how the text is.
ANSWER_INSTRUCTION = (
    "You are an assistant for question-answering tasks.Use the following pieces of retrieved "
    "context to answerthe question. If you don't know the answer, say that youdon't know. Use "
    "three sentences maximum and keep theanswer concise.\n\n"
)
CONTEXT_SEPARATOR = "\n\n"

# --- fixed values: source block -----------------------------------------------------------
FIRST_SOURCE_HEADING = "**Most Relevant Document:**\n- "
OTHER_SOURCES_HEADING = "\n\n**Other Related Documents:**\n"

# --- fixed values: judge instructions -----------------------------------------------------
CORRECTNESS_RUBRIC = """You are an expert evaluator for question-answering systems. For each input, you are given:
- The original question
- The generated answer from a system to be evaluated
- The reference (correct) answer

Your task is to compare the generated answer to the reference answer and assign a score from 1 to 10, where:
10 means the generated answer matches the reference answer perfectly in content, completeness, and factual accuracy;
1 means the generated answer is completely incorrect or irrelevant;
Intermediate numbers reflect partial or incomplete matches.

Provide ONLY the integer score, and nothing else."""

RETRIEVAL_RUBRIC = """You are an expert evaluator for question-answering systems. For each input, you are given:
- The original question
- The retrieved context/document that the system would use for answering

Your task is to assess whether the retrieved context is likely to contain the information needed to answer the question correctly. 

Assign a score from 1 to 10:
10 means the context contains all the information required to answer the question;
1 means it contains none of the required information.
Intermediate numbers reflect partial coverage or relevance.

Provide ONLY the integer score, and nothing else."""

GROUNDEDNESS_RUBRIC = """You are an expert evaluator for question-answering systems. For each input, you are given:
- The original question
- The context/retrieved document provided to the system
- The generated answer from the system

Your task is to determine how well the generated answer is supported by information from the context. The answer should not introduce facts not present in the context. 

Assign a score from 1 to 10:
10 means the answer is fully supported by the context and contains no extra or hallucinated content;
1 means the answer is completely unsupported or fabricated, or uses information that does not appear in the context.
Intermediate numbers reflect partial groundedness.

Provide ONLY the integer score, and nothing else."""

# --- fixed values: judge questions ({name} marks a column) --------------------------------
CORRECTNESS_TEMPLATE = (
    "Question: {question}\n\n"
    "    Reference answer: {reference}\n\n"
    "    Generated answer: {answer}\n"
    "    "
)
RETRIEVAL_TEMPLATE = (
    "Question: {question}\n\n"
    "    Retrieved context: {context}\n\n"
    "    How likely is it that the retrieved context contains the necessary information to answer the question?\n"
    "    Reply with a score from 1 (not at all) to 10 (completely covered). Only provide the score.\n"
    "    "
)
GROUNDEDNESS_TEMPLATE = (
    "\n    Context/retrieved document: {context}\n\n"
    "    Generated answer: {answer}\n\n"
    "    Score the groundedness of the generated answer in the context from 1 (not grounded) to 10 (fully grounded). \n"
    "    Reply with only the score.\n"
    "    "
)

# --- fixed values: single-turn prompt -----------------------------------------------------
SINGLE_TURN_TEMPLATE = (
    "You are an assistant for question-answering tasks. Use the following pieces of retrieved context "
    "to answer the question. If you don't know the answer, just say that you don't know. Use three "
    "sentences maximum and keep the answer concise.\n"
    "Question: {question} \n"
    "Context: {context} \n"
    "Answer:"
)
