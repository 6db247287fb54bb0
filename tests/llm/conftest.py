"""Small documents with the awkward cases every operator must take."""

import pytest

#: nulls in every column, empty and long texts, ties and repeated rows, clashing names
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog again and again today.\nSecond line of this text here it is.", "en", "a", 5, "x"),
    (2, "The quick brown fox jumps over the lazy dog again and again today.\nAnother line that nobody else has got.", "en", "a", 5, "x"),
    (2, "The quick brown fox jumps over the lazy dog again and again today.\nAnother line that nobody else has got.", "en", "a", 5, "x"),
    (3, "", None, None, None, None),
    (4, None, None, None, None, None),
    (5, "word " * 40000, "en", "b", 200000, "y"),
    (6, "é▁🙂 \u0000 tab\tand\r\nline", "fr", "c", 9, "z"),
    (None, "A text without an id, which is nobody's copy at all, one may say.", "en", "d", 1, "w"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def tokenizer():
    from catalune.llm.queries import tokenizer_file

    return tokenizer_file
