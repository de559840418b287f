import os

import pytest

from acreline.llm.queries import ship

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """NULLs, empty and blank texts, a very long one, repeated rows, clashing columns."""
    long_text = "lorem ipsum dolor sit amet " * 40_000 + "4111 1111 1111 1111 x " * 50
    texts = [None, "", " \n\t", "one", "One two three four five six seven", long_text,
             "mail a.b@mail.example.com now", "mail a.b@mail.example.com now", "naïve ½ 日本 <|endoftext|>"]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", None, "x", 1.5, 7)
            for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id", None, None, None, "x", 0.0, 0)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long,"
              " size string, score double, h int")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
