import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from auditloom.llm.store import shared_folder
from edge_rows import CLASHES, EDGE_ROWS, SCHEMA  # noqa: E402

@pytest.fixture(scope="session")
def edge(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and further columns with clashing names."""
    shared_folder(spark)
    df = spark.createDataFrame(EDGE_ROWS, SCHEMA)
    for k, name in enumerate(CLASHES):
        df = df.selectExpr("*", f"{k} AS {name}")
    return df


@pytest.fixture(scope="session")
def no_rows(spark):
    shared_folder(spark)
    return spark.createDataFrame([], SCHEMA)
