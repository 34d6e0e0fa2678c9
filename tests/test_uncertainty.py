from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from boreline.functions import arcs, touch
from boreline.functions import blocks as B
from boreline.functions.chisq import chi_square_3d
from boreline.operators import octree, separation, uncertainty
from boreline.plans import uncertainty as plans
from boreline.sources import derived

COV = list(uncertainty.COVARIANCE)


def matrices(frame):
    return frame[COV].to_numpy(dtype=float)[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)


@pytest.fixture(scope="module")
def covered(spark, sf):
    return plans.covered_stations(spark, sf)


def test_chi_square():
    assert chi_square_3d(0.95) == pytest.approx(7.8147, abs=1e-3)
    assert chi_square_3d(0.999) == pytest.approx(16.266, abs=1e-3)
    with pytest.raises(ValueError):
        chi_square_3d(1.0)


@pytest.mark.parametrize("model", ["simple", "rich"])
def test_covariance_is_definite_and_grows(spark, sf, covered, model):
    if model == "simple":
        df = covered
    else:
        s = derived.stations(spark, sf).withColumn("tool_id", F.lit(2).cast("bigint"))
        df = uncertainty.covariance_iscwsa(s, derived.instruments(spark, sf), derived.error_sources(spark, sf))
    for _, g in df.toPandas().sort_values("seq").groupby("bore_id"):
        m = matrices(g)
        assert np.linalg.eigvalsh(m).min() > -1e-8
        assert np.trace(m[-1]) > np.trace(m[len(m) // 2]) > np.trace(m[0]) >= 0


def test_iscwsa_against_direct_sums(spark, sf):
    """Systematic azimuth and random depth sources by explicit vectors."""
    s = derived.stations(spark, sf).filter("bore_id = 3").withColumn("tool_id", F.lit(2).cast("bigint"))
    src = spark.createDataFrame([(2, "XYM2", 0.01, True, False, False), (2, "DRFR", 0.4, False, True, False)],
                                "tool_id long, code string, magnitude double, systematic boolean, random boolean, global boolean")
    got = uncertainty.covariance_iscwsa(s, derived.instruments(spark, sf), src).orderBy("seq").toPandas()
    md, inc, az = got.md.to_numpy(), got.inc.to_numpy(), got.az.to_numpy()
    t = arcs.tangent(inc, az)
    side = np.stack([-np.sin(inc) * np.sin(az), np.sin(inc) * np.cos(az), 0 * az], axis=1)
    want = []
    for k in range(len(md)):
        v, w = np.zeros(3), np.zeros((3, 3))
        for i in range(k + 1):
            up = md[i] - md[i - 1] if i else 0.0
            down = md[i + 1] - md[i] if i < k else 0.0
            v += -0.01 * 0.5 * (up + down) * side[i]
            d = (0.5 * (t[i - 1] + t[i]) if i else 0) - (0.5 * (t[i] + t[i + 1]) if i < k else 0)
            d = 0.4 * np.asarray(d) * np.ones(3)
            w += np.outer(d, d)
        want.append(np.outer(v, v) + w)
    assert np.allclose(matrices(got), np.array(want), atol=1e-9)


def test_ellipses_are_projections(covered):
    got = uncertainty.station_ellipses(covered, 0.95).toPandas().merge(
        covered.select("bore_id", "seq", "inc", "az", *COV).toPandas(), on=["bore_id", "seq"])
    k = chi_square_3d(0.95) ** 0.5
    for r, m in list(zip(got.itertuples(), matrices(got)))[::23]:
        high, right = arcs.frame(r.inc, r.az)
        for plane, p in (((np.eye(3)[0], np.eye(3)[1]), "h"), ((high, right), "p")):
            e = np.array([[u @ m @ v for v in plane] for u in plane])
            lam = np.linalg.eigvalsh(e)
            assert getattr(r, p + "_major") == pytest.approx(k * np.sqrt(max(lam[1], 0)), abs=1e-6)
            assert getattr(r, p + "_minor") == pytest.approx(k * np.sqrt(max(lam[0], 0)), abs=1e-5)


def test_extreme_paths_chain_by_arcs(spark, sf, covered, monkeypatch):
    got = uncertainty.extreme_tvd_paths(covered, 0.95).toPandas().sort_values(["bore_id", "side", "seq"])
    for _, g in list(got.groupby(["bore_id", "side"]))[:6]:
        p = g[["north", "east", "tvd"]].to_numpy()
        t, md = arcs.tangent(g.inc.iat[0], g.az.iat[0]), g.md.iat[0]
        for i in range(1, len(p)):
            t, length = arcs.arc_to_point(p[i - 1], t, p[i])
            md += float(length)
            assert np.allclose(t, arcs.tangent(g.inc.iat[i], g.az.iat[i]), atol=1e-6)
            assert g.md.iat[i] == pytest.approx(md, abs=1e-4)
    low, high = (got[got.side == v].set_index(["bore_id", "seq"]).tvd for v in (-1, 1))
    assert (high - low).min() >= -1e-9
    cut = covered.withColumn(B.BLOCK, F.floor(F.col("seq") / 9).cast("bigint"))
    again = uncertainty.extreme_tvd_paths(cut, 0.95).toPandas().sort_values(["bore_id", "side", "seq"])
    for c in ("md", "inc", "az", "tvd"):
        assert np.allclose(got[c], again[c], atol=1e-6)


def test_cell_index_equals_halving():
    """The closed form agrees with halving the interval level by level, boundaries included."""
    rng = np.random.default_rng(1)
    low, high = octree.BOUNDS["z"]
    values = np.concatenate([rng.uniform(low, high, 2000), [low, high, (low + high) / 2, low + (high - low) / 8]])
    for v in values:
        a, b, code = low, high, 0
        for _ in range(23):
            mid = (a + b) / 2
            code <<= 1
            if v > mid:
                code, a = code | 1, mid
            else:
                b = mid
        assert code == max(0, int(np.ceil((v - low) / (high - low) * 2**23)) - 1)


def test_codes_interleave(spark):
    rows = [(5, 2**23 - 1, 123456), (0, 0, 0), (2**23 - 1, 2**23 - 1, 2**23 - 1), (1, 2, 4)]
    got = octree.with_codes(spark.createDataFrame(rows, "ix long, iy long, iz long")).collect()
    for r in got:
        code = 0
        for level in range(22, -1, -1):
            code = code * 8 + ((r.ix >> level) & 1) + 2 * ((r.iy >> level) & 1) + 4 * ((r.iz >> level) & 1)
        assert (r.key21 << 6) + r.detail == code


def test_compaction_keeps_the_volume(spark):
    rows = [(1, 23, x, y, z) for x in range(8) for y in range(4) for z in range(4)] + [(1, 23, 100, 100, 100)]
    got = octree.compact_cells(spark.createDataFrame(rows, "bore_id long, depth int, ix long, iy long, iz long"), ["bore_id"]).collect()
    assert sorted((r.depth, r.ix, r.iy, r.iz) for r in got) == [(21, 0, 0, 0), (21, 1, 0, 0), (23, 100, 100, 100)]
    assert sum(8 ** (23 - r.depth) for r in got) == len(rows)


def test_overlap_is_symmetric_and_excludes_self(spark):
    rows = [(1, 10, 3), (2, 10, 3), (3, 10, 4), (4, 11, 3), (5, 10, 3)]
    cells = spark.createDataFrame([(*r, False, r[0] != 5, True) for r in rows], "bore_id long, key21 long, detail int, is_planned boolean, is_measured boolean, is_definitive boolean")
    ask = spark.createDataFrame([(i,) for i in range(1, 6)], "bore_id long")
    assert sorted(map(tuple, octree.octree_overlap(ask, cells).collect())) == [(1, 2), (2, 1), (5, 1), (5, 2)]


@pytest.mark.parametrize("heavy", [0, 2, 1000])
def test_overlap_of_crowded_cells(spark, heavy, monkeypatch):
    """Light and heavy cells give the same pairs, those of more than 64 paths in a block's bucket too."""
    monkeypatch.setattr(octree, "HEAVY", heavy)
    monkeypatch.setattr(octree, "_BUCKETS", 2)
    rng = np.random.default_rng(6)
    rows = {(b, 7, int(rng.integers(0, 4))) for b in range(300)} | {(int(rng.integers(0, 300)), int(k), int(rng.integers(0, 64))) for k in rng.integers(8, 40, 900)}
    flags = {b: (bool(b % 5), bool(b % 7)) for b in range(300)}
    cells = spark.createDataFrame([(*r, False, *flags[r[0]]) for r in rows], "bore_id long, key21 long, detail int, is_planned boolean, is_measured boolean, is_definitive boolean")
    asked = list(range(0, 300, 3))
    held = {}
    for b, k, d in rows:
        held.setdefault((k, d), set()).add(b)
    want = {(a, b) for group in held.values() for a in group for b in group if a != b and a % 3 == 0 and all(flags[b])}
    got = [tuple(r) for r in octree.octree_overlap(spark.createDataFrame([(b,) for b in asked], "bore_id long"), cells).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_wide_envelopes_lose_no_cell(spark):
    """Vertices around an ellipse of 100 m lie no farther apart than the spacing."""
    slices = spark.createDataFrame([(1, 0.0, 100.0, 20.0), (2, 0.0, 5.0, 5.0)], "bore_id long, r0 double, a double, b double")
    got = {r.bore_id: r.sectors for r in uncertainty.sector_count(slices, octree.target_spacing(), octree.LEAST_SECTORS, 1 << 30).collect()}
    assert 2 * np.pi * 100 / got[1] <= octree.target_spacing() and got[1] > 240 and got[2] >= octree.LEAST_SECTORS


def straight_pair(spark, gap, sigma=1.0, radius=0.1, tilt=0.0):
    """Two straight vertical wells at a distance, with round uncertainty."""
    rows = []
    for b, x, inc in ((1, 0.0, 0.0), (2, gap, tilt)):
        for i in range(6):
            rows.append((b, i, 30.0 * i, inc, 0.0, float(x + 30.0 * i * np.sin(inc)), 0.0, float(30.0 * i * np.cos(inc)), sigma**2, 0.0, 0.0, sigma**2, 0.0, 0.01, radius))
    schema = "bore_id long, seq long, md double, inc double, az double, north double, east double, tvd double, " + ", ".join(
        c + " double" for c in COV) + ", hole_radius double"
    return spark.createDataFrame(rows, schema)


def test_separation_of_parallel_wells(spark):
    """Round envelopes of radius r + s k sigma touch when twice that is the distance (up to the polygon's corners)."""
    s = straight_pair(spark, 20.0)
    pairs = spark.createDataFrame([(1, 2)], "ref_id long, cmp_id long")
    got = separation.separation_factor(pairs, s, 0.95).toPandas()
    k = chi_square_3d(0.95) ** 0.5
    want = (20.0 / 2 - 0.1) / k
    body = got[(got.ref_md > 10) & (got.ref_md < 140)]
    assert len(body) >= 10 and np.abs(body.sf - want).max() < 0.05
    assert np.abs(body.ref_md - body.cmp_md).max() < 15
    far = separation.separation_factor(pairs, straight_pair(spark, 200.0), 0.95).toPandas()
    assert (far.sf == 5.0).all() and (far.cmp_md == -1.0).all()
    near = separation.separation_factor(pairs, straight_pair(spark, 0.1), 0.95).toPandas()
    assert (near.sf == 0.01).all()
    wide = separation.separation_factor(pairs, s, 0.999).toPandas()
    assert wide.sf.min() <= got.sf.min()


def test_separation_limits_and_symmetry(spark):
    s = straight_pair(spark, 20.0, tilt=0.05)
    pairs = spark.createDataFrame([(1, 2, 70.0, 70.0)], "ref_id long, cmp_id long, ref_min_md double, cmp_min_md double")
    got = separation.separation_factor(pairs, s, 0.95).toPandas()
    assert got.ref_md.min() >= 70.0 - 1e-9 and got[got.sf < 5].cmp_md.min() >= 70.0 - 1e-9
    assert 70.0 in got.ref_md.round(6).tolist()
    both = spark.createDataFrame([(1, 2), (2, 1)], "ref_id long, cmp_id long")
    d = separation.separation_factor(both, s, 0.95)
    sym = separation.symmetric_profile(d.filter("ref_id = 1"), d.filter("ref_id = 2")).toPandas()
    assert len(sym) == d.count() and set(sym.ref_id) == {1}


def test_runs_do_not_change_the_answer(spark, monkeypatch):
    s = straight_pair(spark, 20.0, tilt=0.08)
    pairs = spark.createDataFrame([(1, 2)], "ref_id long, cmp_id long")
    a = separation.separation_factor(pairs, s, 0.95).orderBy("slice").toPandas()
    monkeypatch.setattr(separation, "REFERENCE_RUN", 4)
    monkeypatch.setattr(separation, "COMPARISON_RUN", 5)
    b = separation.separation_factor(pairs, s, 0.95).orderBy("slice").toPandas()
    assert np.allclose(a.sf, b.sf, atol=0.0101) and len(a) == len(b)


def test_slab_contact_against_sampling():
    """Edges meet a convex slab exactly when some point of them lies inside."""
    rng = np.random.default_rng(5)
    ang = np.arange(24) * 2 * np.pi / 24
    ring = np.stack([3 * np.cos(ang), 2 * np.sin(ang), 0 * ang], axis=1)
    n, d = touch.slab_planes(ring[None], (ring * 1.2 + [0.3, 0, 4.0])[None])
    start, end = rng.uniform(-6, 6, (400, 3)), rng.uniform(-6, 6, (400, 3))
    got = np.array([touch.edges_meet(n, d, a[None, None], b[None, None])[1][0] for a, b in zip(start, end)])
    u = np.linspace(0, 1, 2001)[:, None]
    inside = np.array([((a + u * (b - a)) @ n[0].T <= d[0] + 1e-9).all(axis=1).any() for a, b in zip(start, end)])
    assert got.sum() > 30 and (got | ~inside).all() and (got != inside).mean() < 0.01


def test_boxes_of_all_sizes_meet_once(spark):
    """Boxes from centimetres to hundreds of metres: every overlapping pair meets, on one grid, and wide boxes leave the
    narrow ones in narrow cells."""
    rng = np.random.default_rng(11)

    def boxes(key, n):
        low = rng.uniform(-15, 15, (n, 3))
        size = 10.0 ** rng.uniform(-2, 1.2, (n, 1)) * rng.uniform(0.2, 1.0, (n, 3))
        size[:2] = [[300.0, 250.0, 1.0], [90.0, 400.0, 400.0]]
        high = low + size
        rows = [(1, i, *(float(x) for pair in zip(low[i], high[i], strict=True) for x in pair)) for i in range(n)]
        schema = f"{key} long, box long, n_lo double, n_hi double, e_lo double, e_hi double, t_lo double, t_hi double"
        return spark.createDataFrame(rows, schema), low, high

    ref, rl, rh = boxes("ref_id", 400)
    cmp, cl, ch = boxes("cmp_id", 300)
    pairs = spark.createDataFrame([(1, 1)], "ref_id long, cmp_id long")
    left = separation._on_grids(pairs, ref, "ref_id", cmp, "cmp_id")
    right = separation._on_grids(pairs, cmp, "cmp_id", ref, "ref_id")
    narrow = left.filter("level = _own").withColumn("side", separation._longest_side())
    assert narrow.filter("side > cell OR cell > 2 * side").filter("side > 1e-3").count() == 0
    renamed = right.select("ref_id", "cmp_id", *separation.CELL, F.col("box").alias("other"), F.col("_own").alias("o_own"),
                           *[F.col(c).alias("o_" + c) for c in separation._box_columns()])
    met = left.join(renamed, ["ref_id", "cmp_id", *separation.CELL]).filter(separation._on_their_grid() & separation._overlap_own())
    got = {(r.box, r.other) for r in met.select("box", "other").distinct().collect()}
    want = {(i, j) for i in range(400) for j in range(300) if (rl[i] <= ch[j]).all() and (rh[i] >= cl[j]).all()}
    assert got == want and len(want) > 200


def test_tie_in_station_is_inserted_once(spark):
    s = straight_pair(spark, 10.0)
    minimum = spark.createDataFrame([(1, 45.0), (2, 60.0)], "bore_id long, md double")
    got = separation.insert_tie_in_slice(s, minimum).toPandas()
    assert sorted(got[got.bore_id == 1].md) == [0, 30, 45, 60, 90, 120, 150] and (got.bore_id == 2).sum() == 6


def test_envelopes_of_split_wells(spark, covered):
    """Slices, ranges and factors are the same when the stations come in blocks."""
    cut = covered.withColumn(B.BLOCK, F.floor(F.col("seq") / 9).cast("bigint"))
    order = ["bore_id", "slice"]
    a = uncertainty.envelope_slices(covered, 0.999).toPandas().sort_values(order).reset_index(drop=True)
    b = uncertainty.envelope_slices(cut, 0.999).toPandas().sort_values(order).reset_index(drop=True)
    assert np.allclose(a[["md", "north", "a", "b", "r0"]], b[["md", "north", "a", "b", "r0"]]) and (a.slice == b.slice).all()
    pairs = spark.createDataFrame([(1, 2, 50.0, 60.0), (3, 4, None, None)], "ref_id long, cmp_id long, ref_min_md double, cmp_min_md double")
    x, y = (separation.separation_factor(pairs, s, 0.999).toPandas().sort_values(["ref_id", "slice"]) for s in (covered, cut))
    assert len(x) == len(y) and np.allclose(x[["ref_md", "cmp_md", "sf"]], y[["ref_md", "cmp_md", "sf"]])
    p, q = (separation.relevant_md_ranges(pairs, s).toPandas().sort_values("ref_id") for s in (covered, cut))
    assert np.allclose(p, q)


def _gyro_case(spark, inc, sources, block=None, **tool):
    """One straight-north well (azimuth 1 everywhere) of legs of 30 m with the inclinations given."""
    rows = [(1, i, 7, 30.0 * i, float(v), 1.0, 0.0) for i, v in enumerate(inc)]
    s = spark.createDataFrame(rows, "bore_id long, seq long, tool_id long, md double, inc double, az double, tvd double")
    s = s.withColumns({c: F.lit(None).cast("double") for c in COV})
    if block:
        s = s.withColumn(B.BLOCK, F.floor(F.col("seq") / block).cast("bigint"))
    values = {"latitude": 1.0, "running_speed": 0.5} | tool
    i = spark.createDataFrame([(7, 1.2, 0.0, 9.8, 50000.0)], "tool_id long, dip double, declination double, gravity double, bfield double")
    i = i.withColumns({k: F.lit(v).cast("double") for k, v in values.items()})
    src = spark.createDataFrame([(7, c, m, True, False, False, a, b) for c, m, a, b in sources],
                                "tool_id long, code string, magnitude double, systematic boolean, random boolean, global boolean,"
                                " start_inc double, end_inc double")
    return uncertainty.covariance_iscwsa(s, i, src).orderBy("seq").toPandas()


@pytest.mark.parametrize("block", [None, 2])
def test_gyro_azimuth_is_held_and_drift_restarts(spark, block):
    inc = [0.1, 0.3, 0.5, 0.7, 0.3, 0.6, 0.8, 0.9]
    rest = ("GXY_SF", 0.01, 0.0, 0.4)
    run = ("GXYZ_GD", 1e-5, 0.4, 2.0)
    walk = ("GXY_RW", 1e-4, 0.4, 2.0)
    taken = [np.sin(1.0) * np.tan(v) * np.tan(1.0) for v in inc]
    held = np.array([taken[0], taken[1], taken[1], taken[1], taken[4], taken[4], taken[4], taken[4]])
    hours = np.array([0, 0, 0, 60, 0, 0, 60, 120])
    walked = np.zeros(8)
    walked[3] = 60 / np.sin(0.6) ** 2
    walked[6] = 60 / np.sin(0.7) ** 2
    walked[7] = walked[6] + 60 / np.sin(0.85) ** 2
    inc = np.array(inc)
    for source, azimuth in ((rest, 0.01 * held), (run, 1e-5 * hours), (walk, 1e-4 * np.sqrt(walked))):
        got = _gyro_case(spark, inc, [source], block)
        side = np.stack([-np.sin(inc) * np.sin(1.0), np.sin(inc) * np.cos(1.0), 0 * inc], axis=1) * azimuth[:, None]
        up = np.r_[0.0, np.full(7, 30.0)]
        for k in range(8):
            down = np.r_[np.full(k, 30.0), 0.0]
            v = (0.5 * (up[:k + 1] + down)[:, None] * side[:k + 1]).sum(axis=0)
            assert np.allclose(matrices(got)[k], np.outer(v, v), atol=1e-12)


def test_gyro_without_latitude_or_speed_is_no_covariance(spark):
    rest, run = ("GXY_B1", 1e-6, None, None), ("GZ_GD", 1e-6, None, None)
    assert _gyro_case(spark, [0.1, 0.2], [rest], latitude=None).c00.isna().all()
    assert _gyro_case(spark, [0.1, 0.2], [run], running_speed=None).c00.isna().all()
    assert _gyro_case(spark, [0.1, 0.2], [run], running_speed=0.0).c00.isna().all()
    assert _gyro_case(spark, [0.1, 0.2], [rest, run]).c00.notna().all()
    # along its singular direction a weight stays finite
    assert np.isfinite(_gyro_case(spark, [np.pi / 2, 0.0, np.pi / 2], [rest, run, ("EXT_MIS", 1e-3, None, None)])[list(COV)]).all().all()


def test_wells_share_calls_and_sources_come_to_wells(spark, sf):
    """No Python call for each well's arcs; rows per error source are not shuffled by their code."""
    s = derived.with_tools(derived.stations(spark, sf), spark, sf)
    chained = uncertainty.chain_arcs(s.withColumn("side", F.lit(1)), ["bore_id", "side"])
    assert "FlatMapGroups" not in chained._jdf.queryExecution().optimizedPlan().toString()
    got = uncertainty.covariance_iscwsa(s, derived.gyro_instruments(spark, sf), derived.gyro_sources(spark, sf))
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert dealt and not [line for line in dealt if "code" in line.split("hashpartitioning", 1)[1]]


def test_sources_of_tools_are_not_broadcast(spark, sf):
    """A list of sources is many times what the planner knows of it, so no join sends it to the driver."""
    known = uncertainty._known_sources(derived.gyro_instruments(spark, sf), derived.gyro_sources(spark, sf))
    stations = derived.with_tools(derived.stations(spark, sf), spark, sf).select("bore_id", "seq", "tool_id")
    met = uncertainty._with_sources(stations, known, "bore_id")
    for df in (known, met, uncertainty._with_sources(stations.withColumn(B.BLOCK, F.lit(0)), known, "bore_id")):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
