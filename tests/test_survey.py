"""Survey completion against published listings, edge rows, and independence of the split of large wells."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boreline.functions import blocks as B
from boreline.operators import interp, survey
from boreline.sources import derived, text
from tests.conftest import make_stations

# Two listings of a reference calculator (md, inc, az, tvd, north, east, dls, bur, tr, vs; degrees,
# metres, degrees per 30 m).
LISTING_A = """\
0.000 0.000 0.000 0.000 -13.250 10.870 -999.250 -999.250 -999.250 -999.250
50.000 1.710 169.950 49.990 -13.980 11.000 1.030 1.030 101.970 0.746
100.000 4.410 169.430 99.920 -16.610 11.480 1.620 1.620 -0.310 3.415
150.000 7.150 165.950 149.660 -21.520 12.590 1.660 1.640 -2.090 8.448
200.000 8.350 166.210 199.200 -28.060 14.210 0.720 0.720 0.160 15.190
250.000 8.750 166.970 248.640 -35.290 15.940 0.250 0.240 0.460 22.624
300.000 8.740 168.220 298.060 -42.720 17.570 0.110 -0.010 0.750 30.225
350.000 10.680 168.210 347.340 -50.970 19.290 1.160 1.160 -0.010 38.658
400.000 15.770 170.540 396.000 -62.220 21.360 3.070 3.050 1.400 50.090
450.000 20.320 169.070 443.530 -77.450 24.120 2.740 2.730 -0.880 65.573
500.000 22.900 166.500 490.010 -95.440 28.040 1.650 1.550 -1.540 83.982
550.000 22.190 168.200 536.190 -114.140 32.240 0.580 -0.430 1.020 103.150
600.000 21.950 170.030 582.530 -132.590 35.790 0.440 -0.140 1.100 121.935
"""
LISTING_B = """\
0.000 0.000 0.000 0.000 -4.640 3.810 -999.250 -999.250 -999.250 -999.250
63.500 1.490 178.370 63.490 -5.470 3.830 0.700 0.700 84.270 0.826
76.390 2.460 193.930 76.380 -5.900 3.770 2.560 2.260 36.210 1.266
80.370 3.310 199.720 80.350 -6.090 3.710 6.770 6.410 43.640 1.466
87.630 4.170 202.210 87.590 -6.530 3.540 3.620 3.550 10.290 1.940
97.240 5.630 206.630 97.170 -7.280 3.200 4.700 4.560 13.800 2.760
105.470 6.730 209.900 105.350 -8.060 2.780 4.210 4.010 11.920 3.645
111.110 5.420 230.000 110.960 -8.520 2.410 13.180 -6.970 106.910 4.233
120.000 5.400 230.000 119.810 -9.050 1.770 0.070 -0.070 0.000 5.071
130.000 5.700 230.000 129.760 -9.680 1.030 0.900 0.900 0.000 6.039
"""


@pytest.mark.parametrize("listing", [LISTING_A, LISTING_B])
def test_listing_positions_and_rates(spark, tmp_path, listing):
    rows = [line.split() for line in listing.strip().splitlines() if not line.endswith(" 0 0 0")]
    file = tmp_path / "well.txt"
    file.write_text("\n".join("\t".join(r) for r in rows))
    want = text.read_well_listing(spark, str(file)).orderBy("md").toPandas()
    assert want["dls"].isna().sum() == 1
    got = make_stations(
        spark, want.md.tolist(), want.inc.tolist(), want.az.tolist(), start=(want.north[0], want.east[0], want.tvd[0])
    ).orderBy("seq").toPandas()
    for c in ("north", "east", "tvd"):
        assert np.abs(got[c] - want[c]).max() < 0.011
    assert np.abs(got.vsect - want.vsect)[1:].max() < 0.011
    per_30 = 30.0 * 180.0 / math.pi
    assert np.abs((got.dls - want.dls) * per_30)[1:].max() < 0.006
    assert np.abs((got.bur - want.bur) * per_30)[1:].max() < 0.006


def test_decimal_comma_angles(spark, tmp_path):
    file = tmp_path / "iscwsa.txt"
    file.write_text("2900\t18\t2\t2885,27\n3000\t20\t2\t2979,82\n3100\t22\t2\t3073,17\n")
    got = text.read_angle_table(spark, str(file), 0.3048).orderBy("md").toPandas()
    made = make_stations(spark, got.md.tolist(), got.inc.tolist(), got.az.tolist(), start=(0, 0, got.tvd[0]))
    done = made.orderBy("seq").toPandas()
    assert np.abs(done.tvd - got.tvd).max() < 0.05
    assert abs(got.md[0] - 2900 * 0.3048) < 1e-9


def test_vertical_and_wrapping_steps(spark):
    d = math.radians
    got = make_stations(spark, [0, 100, 200, 300], [0, 0, d(10), d(100)], [0, 0, d(359), d(1)]).orderBy("seq").toPandas()
    assert got.tvd[1] == 100.0 and got.north[1] == 0.0
    assert abs(got.tur[3] - d(2) / 100) < 1e-7
    assert np.isfinite(got[["north", "east", "tvd"]].to_numpy()).all()


@pytest.mark.parametrize("method", [survey.BUILD_AND_TURN, survey.CURVATURE_AND_TOOLFACE])
def test_other_methods_agree_on_short_steps(spark, sf, method):
    m = derived.measurements(spark, sf).drop("event_id")
    a = survey.complete_survey(m).select("bore_id", "seq", "north", "east", "tvd", "md")
    b = survey.complete_survey(m, method).select("bore_id", "seq", *[F.col(c).alias("o_" + c) for c in ("north", "east", "tvd")])
    d = a.join(b, ["bore_id", "seq"]).toPandas()
    gap = np.sqrt(sum((d[c] - d["o_" + c]) ** 2 for c in ("north", "east", "tvd")))
    assert (gap <= 0.01 * d.md + 1e-6).all() and gap.max() > 0


def _frame(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)[sorted(c for c in df.columns if c != B.BLOCK)]


def test_results_do_not_depend_on_the_split(spark, sf, monkeypatch):
    whole = derived.measurements(spark, sf)
    assert not B.is_split(whole)
    monkeypatch.setattr(B, "ROWS_PER_BLOCK", 7)
    cut = derived.measurements(spark, sf)
    assert B.is_split(cut) and cut.select(B.BLOCK).distinct().count() > 5
    pd.testing.assert_frame_equal(_frame(whole, "bore_id", "seq"), _frame(cut, "bore_id", "seq"))
    a, b = survey.complete_survey(whole), survey.complete_survey(cut)
    pd.testing.assert_frame_equal(_frame(a, "bore_id", "seq"), _frame(b, "bore_id", "seq"))
    pd.testing.assert_frame_equal(_frame(survey.segments(a), "bore_id", "seq"), _frame(survey.segments(b), "bore_id", "seq"))
    x, y = survey.ewma(a, ["tvd", "dls"]), survey.ewma(b, ["tvd", "dls"])
    pd.testing.assert_frame_equal(_frame(x, "bore_id", "seq"), _frame(y, "bore_id", "seq"), rtol=1e-12)
    points = a.select("bore_id", (F.col("md") + 3.3).alias("md"))
    split_points = b.select("bore_id", (F.col("md") + 3.3).alias("md"))
    pd.testing.assert_frame_equal(
        _frame(interp.interpolate_station(points, a), "bore_id", "md"),
        _frame(interp.interpolate_station(split_points, b), "bore_id", "md"),
    )
    assert _frame(interp.evenly_spaced_sample(a, ["bore_id"], ["seq"], 9), "bore_id", "seq").equals(
        _frame(interp.evenly_spaced_sample(b, ["bore_id"], ["seq"], 9), "bore_id", "seq")
    )


def test_running_max_and_positions_split(spark):
    rows = [(w, i, (i * 7919 + w) % 101 * 1.0) for w in range(3) for i in range(50)]
    plain = spark.createDataFrame(rows, "w long, i long, v double")
    cut = plain.withColumn(B.BLOCK, F.floor(F.col("i") / 6).cast("bigint"))
    for f in (
        lambda d: B.with_running_max_before(d, ["w"], ["i"], "v", "top"),
        lambda d: B.with_position(d.filter("v > 20"), ["w"], ["i"], "p", "n"),
        lambda d: B.with_running_sum(d, ["w"], ["i"], {"s": "v"}),
        lambda d: B.with_next(d, ["w"], ["i"], ["v"]),
    ):
        pd.testing.assert_frame_equal(_frame(f(plain), "w", "i"), _frame(f(cut), "w", "i"))


def test_tie_in_rules(spark):
    m = spark.createDataFrame(
        [(w, i, 10.0 * i, 0.1, 0.2, None, None, None) for w in range(4) for i in range(5)],
        "bore_id long, seq long, md double, inc double, az double, north double, east double, tvd double",
    )
    tie = spark.createDataFrame(
        [(0, 20.0, 0.5, 0.6, 1.0, 2.0, 3.0), (1, 25.0, 0.5, 0.6, 1.0, 2.0, 3.0), (2, 99.0, 0.5, 0.6, 1.0, 2.0, 3.0)],
        "bore_id long, md double, inc double, az double, north double, east double, tvd double",
    )
    got = survey.apply_tie_in(m, tie).toPandas().sort_values(["bore_id", "md"])
    by = {k: g.md.tolist() for k, g in got.groupby("bore_id")}
    assert by[0] == [20.0, 30.0, 40.0] and by[1] == [25.0, 30.0, 40.0] and 2 not in by and len(by[3]) == 5
    assert got[(got.bore_id == 0) & (got.md == 20)].inc.iat[0] == 0.5
    run = survey.apply_tie_in(m, tie, keep_when_nothing_below=True).toPandas()
    assert (run.bore_id == 2).sum() == 5


def test_parent_tie_in_gap(spark):
    s = make_stations(spark, [0, 100, 200], [0, 0.1, 0.2], [0, 0, 0])
    bores = spark.createDataFrame(
        [(2, True, 1, 150.0), (3, True, 1, 209.0), (4, True, 1, 211.0), (5, False, None, None)],
        "bore_id long, is_sidetrack boolean, parent_bore_id long, tie_in_md double",
    )
    got = interp.parent_tie_in(bores, s).toPandas().set_index("bore_id")
    assert sorted(got.index) == [2, 3]
    end = s.filter("seq = 2").toPandas().iloc[0]
    assert abs(got.loc[3].tvd - end.tvd) < 1e-5 and got.loc[3].md == 209.0


def test_validation(spark):
    rows = [(1, 0, 0.0, 0.1, 0.1), (1, 1, 10.0, 0.1, 0.1), (2, 0, 0.0, 0.1, 0.1), (2, 1, 0.0, 0.1, 0.1),
            (3, 0, 0.0, None, 0.1), (4, 0, 5.0, 0.1, float("nan"))]
    got = survey.validate_measurements(spark.createDataFrame(rows, "bore_id long, seq long, md double, inc double, az double"))
    reason = {r["bore_id"]: r["reason"] for r in got.collect()}
    assert reason == {1: None, 2: "depth not increasing", 3: "undefined value", 4: "undefined value"}


def test_md_at_tvd_round_trip(spark, sf):
    s = derived.stations(spark, sf)
    goal = s.groupBy("bore_id").agg((F.max("tvd") * 0.61).alias("target_tvd"))
    md = interp.md_at_tvd(goal, s)
    back = interp.interpolate_station(md.select("bore_id", "md", "target_tvd"), s)
    assert back.select(F.max(F.abs(F.col("tvd") - F.col("target_tvd")))).first()[0] < 1e-6


def test_densified_chords_stay_close(spark):
    s = make_stations(spark, [0, 300, 600], [0, 0.6, 1.2], [0, 0.3, 0.9])
    dense = interp.densify_chord_arc(s, 0.05).orderBy("md").toPandas()
    assert len(dense) > 10
    mids = [((a + b) / 2) for a, b in zip(dense.md, dense.md[1:])]
    at = interp.interpolate_station(spark.createDataFrame([(1, m) for m in mids], "bore_id long, md double"), s)
    at = at.orderBy("md").toPandas()
    xyz = ["north", "east", "tvd"]
    chord = (dense[xyz].to_numpy()[1:] + dense[xyz].to_numpy()[:-1]) / 2
    assert np.linalg.norm(at[xyz].to_numpy() - chord, axis=1).max() <= 0.05 + 1e-6
    assert interp.densify_chord_arc(s, None).count() == 3


@pytest.mark.parametrize("method", ["minimum_curvature", "build_and_turn"])
def test_depths_are_halved_in_batches(spark, capsys, method):
    """One pass over a batch per halving: no expression that is nested in itself for every row."""
    method = {"minimum_curvature": survey.MINIMUM_CURVATURE, "build_and_turn": survey.BUILD_AND_TURN}[method]
    s = make_stations(spark, [0.0, 100.0, 200.0], [0.0, 0.4, 0.4], [0.0, 0.5, 0.5])
    deep = s.toPandas().sort_values("seq")["tvd"].tolist()
    goal = spark.createDataFrame([(1, 0.5 * deep[1]), (1, deep[1] + 10.0), (1, 1e4)], "bore_id long, target_tvd double")
    got = interp.md_at_tvd(goal, s, method=method)
    rows = {round(r["target_tvd"], 6): r["md"] for r in got.collect()}
    assert len(rows) == 2 and abs(rows[round(deep[1] + 10.0, 6)] - 100.0 - 10.0 / math.cos(0.4)) < 1e-6
    got.explain()
    assert "lambdafunction" not in capsys.readouterr().out
