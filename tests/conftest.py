from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from boreline.session import local_session

    return local_session(4, shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def stations(spark, sf):
    """Stations of all wells as pandas, in order."""
    from boreline.sources import derived

    return derived.stations(spark, sf).toPandas().sort_values(["bore_id", "seq"]).reset_index(drop=True)


def make_stations(spark, md, inc, az, bore_id=1, start=(0.0, 0.0, 0.0)):
    """A completed survey from plain lists."""
    import pandas as pd

    from boreline.operators import survey

    n = len(md)
    first = [None] * (n - 1)
    frame = pd.DataFrame({
        "bore_id": bore_id, "seq": range(n), "md": md, "inc": inc, "az": az,
        "north": [start[0], *first], "east": [start[1], *first], "tvd": [start[2], *first],
    })
    schema = "bore_id long, seq long, md double, inc double, az double, north double, east double, tvd double"
    return survey.complete_survey(spark.createDataFrame(frame.astype(object).where(frame.notna(), None), schema))
