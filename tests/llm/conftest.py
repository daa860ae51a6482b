import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, _id string, node long, rep long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 40) for _ in range(300))
    texts = [(1, "a b c"), (2, None), (3, ""), (4, " \t\n "), (5, long), (6, long), (None, prose(rng, 60)), (7, prose(rng, 60)), (7, prose(rng, 60)), (8, "é ü 漢字 🙂 <|endoftext|> x"), (8, "é ü 漢字 🙂 <|endoftext|> x"), (9, "same line of text here\n" * 8)]
    rows = [(i, t, None if i == 1 else "en", None if i == 2 else f"s{(i or 0) % 3}", None if i == 3 else len(t or ""), None, "x", 1, None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
