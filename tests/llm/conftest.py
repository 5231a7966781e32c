import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "light", "winter", "garden", "paper", "signal"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    a, long_ = text(60), text(30_000)
    rows = [(1, a), (2, a), (2, a), (3, None), (4, ""), (5, " \t\n "), (6, "one two"), (7, "one two"), (None, a), (None, None), (8, long_), (9, long_ + " end"), (10, "... !!! 123")]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, kept string, sig string, u long, held_out string, host string"
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, None, None, 0.5, "x", "y", "z", 3, "no", "h") for i, t in rows], names)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
