import pytest

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
#: Names that operators use inside.
EXTRA = "id node block size key hash word count score label row part kept ids n_words"


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text) pairs, with further columns of names that may clash."""

    def make(pairs):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(rows, SCHEMA)
        for name in EXTRA.split():
            df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Deterministic words: prose(seed, n) has n of them."""
    import random

    def make(seed, n):
        chosen = random.Random(seed)
        return " ".join("".join(chosen.choice("abcdefgh") for _ in range(chosen.randint(2, 7))) for _ in range(n))

    return make
