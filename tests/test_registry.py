"""Every registered query has a sound entry; a sample of them is compared with DuckDB on the small tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

SAMPLE = [
    "min_curvature", "complete_survey_bt", "tie_in", "sections_materialize", "interpolate_grid", "md_at_tvd", "as_of_sample",
    "sf_profile_distance", "closest_approach", "interval_stats", "wolff_dewardt", "station_ellipses", "octree_overlap",
    "relevant_md_ranges", "fill_hole_radius", "reference_offsets", "unique_name", "import_steps", "usage_daily",
]


@pytest.fixture(scope="module")
def duck(sf):
    import check
    import duckdb

    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_oracles_belong_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1000


@pytest.mark.parametrize("name", SAMPLE)
def test_against_duckdb(spark, sf, duck, name):
    import __spark_entry__ as entry
    import check

    mine = entry.queries()[name](spark, sf).toPandas()
    theirs = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert check.differences(mine, theirs) is None
