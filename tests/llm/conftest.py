import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, ids that repeat."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "ETA", "theta", "iota", "kappa"]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(30_000))
    plain = " ".join(words * 6)
    rows = [(1, plain, "en", "a", 9), (1, plain, "en", "a", 9), (2, None, "en", "a", None), (3, "", None, None, 0),
            (None, "lonely text of a row without id", "en", "a", 1), (4, " \t\n\x0b ", "fr", "a", 1), (5, long, "fr", "b", 1),
            (6, plain, "en", "b", 1), (7, plain + " end", "de", "b", 1), (8, "x" * 50_000, "en", "b", 1),
            (1, "another text under the id one", "en", "c", 1), (9, "12345 @ !!! \U0001F600", None, None, None),
            (10, "a\nb\na\nb", "en", "a", 7), (11, "mail a.b@c.de and +1 (743) 555-3824", "en", "a", 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def clash(df):
    """``df`` with further columns named like the operators' own columns."""
    names = ["id", "h", "row", "rank", "part", "local", "shard", "slot", "kept", "n_words", "piece", "length", "bits",
             "label", "spans", "lang_pred", "n_tokens", "text_hash", "loss", "lp", "_id", "g", "conv", "parts", "turns"]
    return df.select("*", *[df["source"].alias(n) for n in names])
