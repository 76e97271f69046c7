import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def docs(spark):
    from helpers import SCHEMA, awkward

    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    from helpers import SCHEMA

    return spark.createDataFrame([], SCHEMA)
