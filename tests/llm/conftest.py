import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, bytes string, score double, `row` int, `rank` int, n_tokens string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    rnd = random.Random(3)
    long = " ".join(rnd.choice(["alpha", "beta", "Gamma", "δέλτα", "x1"]) for _ in range(30_000))
    texts = [(1, "One two three four five six seven"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, "One two three four five six seven"), (1, "One two three four five six seven"), (None, "no id at all here"), (7, "a <|endoftext|> b\u00a0c"), (8, "short")]
    return [(i, t, None if i == 3 else "en", None if i == 4 else "s", len(t or ""), 9, "clash", 0.5, 1, 2, "n") for i, t in texts]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(sf):
    import pyarrow.dataset as ds

    return [(r["doc_id"], r["text"]) for r in ds.dataset(f"{sf}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()]
