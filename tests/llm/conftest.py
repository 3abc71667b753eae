import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def piece_model():
    return str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="session")
def word_model():
    return str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    rows = [
        (1, None, "en", "a", "x"), (2, "", None, None, None), (3, "   \n ", "en", "a", "x"), (None, "The loner of the lake.", "en", "b", "y"), (4, "Plain words of a text.", "en", "b", "y"),
        (4, "Plain words of a text.", "en", "b", "y"), (5, "word " * 30_000, "en", "c", "z"), (6, "日本語 テスト 😀 \0 ▁x  y", None, "c", "z"), (7, "Plain words of a text.", None, "b", "y"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
