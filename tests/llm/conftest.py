import pytest

#: clashing names of every operator's own columns, besides the two that are read
EXTRA = ["bits", "run", "digest", "row_id", "row_number", "key", "leaks", "score", "kept", "text_sha256", "n", "word"]
LONG = "alpha beta gamma delta " * 5000


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, long and repeated texts; null and repeated ids."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (6, "One small text."),
            (6, "One small text."), (None, "One small text."), (None, None), (7, "Ünï cödé 🙂 x")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with further columns of clashing names."""
    return spark.createDataFrame([(i, t, *["x"] * len(EXTRA)) for i, t in odd_rows],
                                 "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
