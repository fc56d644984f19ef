import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import SCHEMA, odd_rows, prose, with_clashes  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 120)), "en", f"src{i % 3}", 0) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "src0", 0) for i in range(4)]
    return with_clashes(spark.createDataFrame(rows + odd_rows(rng), SCHEMA)).persist()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
