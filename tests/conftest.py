import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lectern.session import get_spark
    s = get_spark("local[4]", app="lectern-tests", shuffle_partitions=8)
    yield s
    s.stop()


def lines_df(spark, text: str, file: str = "upanishads-test.txt"):
    """A line table from an in-memory text, split like a text file."""
    import re
    parts = re.split(r"\r\n|\r|\n", text)
    if parts and parts[-1] == "":
        parts = parts[:-1]
    rows = [(file, i + 1, p) for i, p in enumerate(parts)]
    return spark.createDataFrame(rows, "file STRING, line_no INT, raw STRING")
