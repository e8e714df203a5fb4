import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_helpers import corpus  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and extra columns whose names operators use inside."""
    rows = [(None, "a b c d e f", 1, "x", None), (5, None, 2, "y", "s"), (5, None, 2, "y", "s"), (6, "a b c d e f", None, "z", "s"), (6, "a b c d e f", None, "z", "s")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, block int, row string, source string")
