from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (None, "Some words without an id.", "en", None, 25), (3, "x", "en", "b", 1),
        (4, "the same row twice, mail a.b@c.example.org", "en", "b", 41), (4, "the same row twice, mail a.b@c.example.org", "en", "b", 41),
        (4, "the same id with another text", "de", "b", 29), (5, "long " * 30_000, "en", "c", 150_000), (6, " \n\t ", "fr", "c", 4), (7, "日本語のテキスト <|im_end|> % %25", None, "c", 20),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.selectExpr("*", "'k' AS key", "1 AS score", "'z' AS d", "2 AS row", "3 AS text_key", "4 AS id", "5 AS terms", "6 AS lang_pred")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
