import random

import pytest

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, odd characters, and columns whose names clash with the operators' own."""
    long = prose(1, 30_000)
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "   \n\n ", "en", "a", 5), (4, long, "en", "a", 1), (5, long, "en", "b", 1), (5, long, "en", "b", 1), (None, "some text without an id here now", "en", "a", 3), (6, "one two", "en", "a", 3), (7, "é" * 5000, "fr", "a", 3), (8, "日本語 テキスト <|endoftext|> 'S ΑΣ é \x00  x", None, "a", 3), (9, "?!... ---", "en", "a", 9)]
    clash = "digest string, d1 string, member string, root string, text_crc32 string, label string, `first` string, low string, toxic string, kept string"
    return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], f"{DOC}, {clash}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
