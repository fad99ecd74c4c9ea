import pytest
from pyspark.sql import Row  # noqa: F401


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def model_path():
    return __import__("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def bpe_path():
    return __import__("public_tokenizers").path("byte_bpe_50k.json")


def documents(spark, texts, lang=None, source=None, ids=None):
    """A documents table with columns whose names clash with result columns."""
    n = len(texts)
    rows = [((ids or list(range(n)))[i], texts[i], (lang or ["en"] * n)[i], (source or ["s"] * n)[i], "clash", 7)
            for i in range(n)]
    return spark.createDataFrame(
        rows, "doc_id LONG, text STRING, lang STRING, source STRING, score STRING, size INT")
