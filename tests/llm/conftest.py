import pytest

LONG = "lorem ipsum dolor sit amet " * 4000
#: Null and empty texts, ties, repeated rows, a very long text, columns whose names clash with results.
ROWS = [
    (1, "the cat sat on the mat and looked at the dog near the door of the old house", "en", "a"),
    (2, "the cat sat on the mat and looked at the dog near the door of the old house", "en", "a"),
    (3, "the cat sat on the mat and looked at the dog near the door of the old home", "en", "b"),
    (4, None, "en", "a"),
    (5, "", None, "a"),
    (6, " \t\n", "de", None),
    (7, LONG, "la", "a"),
    (8, "Der Hund und die Katze sind im Haus", "de", "a"),
    (8, "Der Hund und die Katze sind im Haus", "de", "a"),
    (None, "eins zwei", "de", "a"),
    (10, "12345 !!", "en", "a"),
    (11, "Ünïcödé 日本語 😀 text", None, "a"),
    (12, "a\\b <|im_start|> [INST] <|endoftext|> end", "en", "a"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(*r, 0, False, "x", 1.0) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, kept boolean, lang_pred string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
