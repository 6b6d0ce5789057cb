import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n: int, seed: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(f"{r.choice(WORDS)}{r.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and
    extra columns whose names clash with results."""
    long = prose(30_000, 1)
    rows = [
        (1, "Alpha beta gamma", "en", "a", 16, "x", True),
        (2, "alpha BETA gamma", "en", "a", 16, "x", False),
        (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "y", True),
        (5, " \t\n ", None, "b", 4, "y", True),
        (6, long, "en", "c", len(long), "z", False),
        (7, long, "en", "c", len(long), "z", False),
        (7, long, "en", "c", len(long), "z", False),
        (None, "a row without id", "en", None, 16, None, None),
        (8, "ÄÖÜ straße 123 😀 é", "de", "c", 20, "q", True),
        (9, "123 456 !!!", "de", "", 11, "q", True),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept boolean")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
