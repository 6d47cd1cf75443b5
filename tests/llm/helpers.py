"""Edge tables that every operator must take."""

import pytest

LONG = "lorem ipsum dolor " * 20000
EDGE = [
    (1, None, "en", "s"), (2, "", "en", "s"), (3, "   \n\t", None, None), (4, "word", "en", "s"), (5, "two words", "en", "s"), (6, "a b c d e f g h i j k l m n o p", "en", "s"),
    (7, "a b c d e f g h i j k l m n o p", "en", "s"), (7, "a b c d e f g h i j k l m n o p", "en", "s"), (8, LONG, "xx", "s"), (9, "x" * 50000, "en", None), (10, "▁ lower ▁▁ eighth block", "en", "s"),
    (11, "\U0001f600\U0001f600 emoji ٣ 中文字", None, "s"), (12, "!!! ??? 123 456", "en", "s"), (13, "tab\tand\x00control\x7f\r\nline\x0bvertical", "en", "s"), (None, "no id at all here", "en", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
