import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from polysem.session import get_spark

    session = get_spark("polysem-tests", cores=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines(spark):
    """Nine sentences of ten tokens over five letters."""
    rows = []
    for s in range(9):
        letters = ["abcde"[(s * s + 3 * p * p + s * p) % 5] for p in range(10)]
        rows.append((s, 0, " ".join(letters)))
    return spark.createDataFrame(rows, "doc_id bigint, line int, text string")
