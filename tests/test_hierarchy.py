from __future__ import annotations

from boreline.operators import catalog, hierarchy, holes


def _bores(spark, rows):
    return spark.createDataFrame(rows, "bore_id long, name string, well_id long, is_sidetrack boolean, parent_bore_id long, tie_in_md double, rig_id long")


def test_chains_and_cycles(spark):
    rows = [(i, f"B{i}", 1, i > 0, i - 1 if i else None, 10.0, None) for i in range(40)]
    rows += [(100, "X", 1, True, 101, 1.0, None), (101, "Y", 1, True, 100, 1.0, None), (102, "Z", 1, True, 100, 1.0, None)]
    rows += [(200, "Lost", 1, True, 999, 1.0, None), (201, "Plain", 1, False, 200, 1.0, None)]
    bores = _bores(spark, rows)
    root = {r["bore_id"]: r["root_bore_id"] for r in hierarchy.root_wellbore(bores).collect()}
    assert all(root[i] == 0 for i in range(40))
    assert root[100] == 100 and root[101] == 101 and root[200] == 200 and root[201] == 201
    # climbing from outside the cycle ends at the last bore seen before a repeat
    assert root[102] == 101
    path = {r["bore_id"]: (r["depth"], r["path"]) for r in hierarchy.wellbore_depth_path(bores).collect()}
    assert path[3] == (3, "B0/B1/B2/B3") and path[39][0] == 39
    assert path[100] == (2, "Y/X") and path[200] == (1, "999/Lost") and path[201] == (2, "999/Lost/Plain")


def test_sidetrack_pairs_mirror(spark):
    bores = _bores(spark, [(1, "a", 1, False, None, None, None), (2, "b", 1, True, 1, 50.0, None), (3, "c", 1, True, 1, 5.0, None)])
    ranges = spark.createDataFrame([(1, 0.0, 100.0), (2, 40.0, 90.0), (3, 10.0, 80.0)], "bore_id long, start_md double, end_md double")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (2, 3)], "ref_id long, cmp_id long")
    got = {(r[0], r[1]): (r[2], r[3]) for r in hierarchy.sidetrack_pairs(pairs, bores, ranges).collect()}
    assert got == {(1, 2): (50.0, 50.0), (2, 1): (50.0, 50.0), (3, 1): (10.0, 5.0), (2, 3): (None, None)}


def test_similar_names(spark):
    rows = [(1, 1, "34/10-A 5"), (2, 2, "34/10 A5 MIA"), (3, 3, "other"), (4, 4, "extrapolated_34/10-a5")]
    paths = spark.createDataFrame(rows, "traj_id long, bore_id long, name string")
    have = spark.createDataFrame([(1,)], "bore_id long")
    got = {r["traj_id"]: (r["architecture_bore_id"], r["borrowed_from"]) for r in holes.radius_by_similar_name(paths, have).collect()}
    assert got == {1: (1, None), 2: (1, 1), 3: (None, None), 4: (1, 1)}


def test_hole_intervals_rules(spark):
    schema = "bore_id long, section int, kind string, pos int, top_md double, length double, diameter double"
    rows = [
        (1, None, "surface", 0, None, 10.0, 1.0), (1, None, "surface", 1, None, 0.0, 1.0), (1, None, "surface", 2, None, 20.0, None),
        (1, 0, "casing", 0, 30.0, 500.0, None), (1, 0, "size", 0, None, None, 0.5),
        (1, 0, "open", 0, None, 100.0, 0.3), (1, 0, "open", 1, None, None, 0.2), (1, 0, "open", 2, None, 50.0, 0.2),
        (2, 0, "casing", 0, None, 500.0, None), (2, 0, "size", 0, None, 10.0, 0.5),
    ]
    heads = spark.createDataFrame([(1, 25.0)], "bore_id long, wellhead_md double")
    got = holes.hole_intervals(spark.createDataFrame(rows, schema), heads).collect()
    found = sorted((r["bore_id"], r["kind"], r["start_md"], r["end_md"], r["radius"]) for r in got)
    assert found == [(1, "open", 530.0, 630.0, 0.15), (1, "open", 630.0, 680.0, 0.1), (1, "size", 30.0, 530.0, 0.25),
                     (1, "surface", -5.0, 5.0, 0.5)]
    stations = spark.createDataFrame([(1, i, md) for i, md in enumerate((0.0, 5.0000005, 6.0, 530.0, 700.0))], "bore_id long, seq long, md double")
    filled = {r["md"]: r["hole_radius"] for r in holes.fill_hole_radius(stations, holes.hole_intervals(spark.createDataFrame(rows, schema), heads)).collect()}
    assert filled == {0.0: 0.5, 5.0000005: 0.5, 6.0: None, 530.0: 0.25, 700.0: None}


def test_unique_names(spark):
    wanted = spark.createDataFrame([("Alpha",), ("beta",), ("New",)], "base string")
    taken = spark.createDataFrame([("ALPHA",), ("alpha (2)",), ("alpha (4)",), ("alpha (3) x",), ("Beta",), ("beta (1)",)], "name string")
    got = {r["base"]: r["name"] for r in catalog.unique_name(wanted, taken).collect()}
    assert got == {"Alpha": "Alpha (3)", "beta": "beta (2)", "New": "New"}


def test_restrict_and_status(spark):
    rows = spark.createDataFrame([(1,), (2,)], "bore_id long")
    none = spark.createDataFrame([], "bore_id long")
    assert catalog.restrict_to_requested(rows, none, "bore_id").count() == 2
    assert catalog.restrict_to_requested(rows, rows.limit(1), "bore_id").count() == 1
    assert catalog.scan_by_id(rows, "bore_id", None).count() == 0
