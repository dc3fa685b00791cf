import pandas as pd
import pytest

# Nulls, empty and blank texts, ties, repeated rows, one long text, and columns named like results.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the old barn", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs away from the old barn", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the old barn", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, "  \n\t ", "fr", "b"),
    (6, "one two three", "en", "a"),
    (7, "one two three", None, "a"),
    (8, "... 123 !!!", "en", None),
    (None, "a row without id but with words enough to be a shingle", "en", "a"),
    (9, "long " * 40_000 + "tail", "en", "b"),
    (10, "é ÉÉ ü ñ 漢字 words of several scripts in one text", "fr", "b"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, lang, src, len(t or ""), "x", 0.5, 7) for i, t, lang, src in ROWS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score string, copy double, shard int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def docs_frame(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")
