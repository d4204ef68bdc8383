import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, score double"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, repeated rows, and clashing extra columns."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta", "épsilon", "zeta", "eta", "theta", "日本", "x1"]
    long_text = " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(6000))
    base = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(120))
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (0, base, "en", "a"), (1, base, "en", "b"), (2, near, "en", None), (3, None, None, None), (4, "", "en", "a"), (5, " \t\n", "de", "b"), (6, long_text, "fr", "a"),
        (7, "x " * 300, "en", "c"), (8, "one two", "es", "c"), (8, "one two", "es", "c"), (9, "One TWO", "es", "a"), (None, base, None, "a"), (10, long_text + " tail", "fr", "b"), (11, "1234 ...", "en", "a"),
        (12, base.upper(), "en", "d"), (13, "shared line\n" + base[:200], "en", "a"), (14, "shared line\nother", "en", "b"), (15, " shared line ", "en", "c"),
    ]
    return spark.createDataFrame([(*r, 1, 7, 7, 7.0) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]
