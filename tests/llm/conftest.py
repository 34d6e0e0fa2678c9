from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(spark):
    from boreline.session import attach

    return attach(spark)


@pytest.fixture(scope="session")
def rows():
    import corpus

    return corpus.documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    import corpus

    return corpus.frame(spark, rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    import corpus

    return spark.createDataFrame([], corpus.SCHEMA)
