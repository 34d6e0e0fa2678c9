from __future__ import annotations

import itertools
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boreline.functions import arcs
from boreline.functions import blocks as B
from boreline.functions import envelope
from boreline.functions.moments import Moments
from boreline.operators import fitting, sequence, survey
from boreline.plans import uncertainty as uncertainty_plans
from boreline.sources import derived
from tests.conftest import make_stations


def slow_coarsening(g, tolerance):
    """Plain loops over one well."""
    p = g[["north", "east", "tvd"]].to_numpy()
    md, t = g.md.to_numpy(), arcs.tangent(g.inc, g.az)

    def fits(a, b):
        at = arcs.minimum_curvature_points(p[a], t[a], t[b], md[b] - md[a], (md[a + 1 : b] - md[a]) / (md[b] - md[a]))
        return all(np.linalg.norm(x - y) <= tolerance for x, y in zip(at, p[a + 1 : b]))

    kept, start = [0], 0
    while start < len(md) - 1:
        end = start + 1
        for c in range(start + 2, len(md)):
            if not fits(start, c):
                break
            end = c
        kept.append(end)
        start = end
    return g.seq.iloc[kept].tolist()


def plain_walk(path, n):
    """Every end tried with all stations between."""
    kept, start = [0], 0
    while start < n - 1:
        end = start + 1
        for c in range(start + 2, n):
            if not path.accepts(start, c, np.arange(start + 1, c)):
                break
            end = c
        kept.append(end)
        start = end
    return kept


@pytest.mark.parametrize("kind", [envelope.ByDepth, envelope.ByPlace])
def test_envelope_equals_looking_at_all(kind, monkeypatch):
    """Noise of many sizes, long arcs, depths that repeat or fall, positions off the path, and whole turns."""
    rng = np.random.default_rng(8)
    looked = []
    for case in range(60):
        n = int(rng.integers(1, 130))
        md = np.cumsum(rng.choice([1.0, 10.0, 30.0]) * np.ones(n))
        if case % 7 == 3 and n > 20:
            md[n // 2 :] -= rng.choice([md[1] - md[0], 40.0])
        turn = np.repeat(rng.choice([0.0, 1e-3, 0.3 if case % 5 == 0 else 1e-4], n), 20)[:n]
        inc, az = 0.8 + np.cumsum(turn) + rng.normal(0, rng.choice([0, 1e-6, 1e-4, 1e-2]), n), 1.0 + 0.5 * np.cumsum(turn)
        t = arcs.tangent(inc, az)
        p = np.cumsum(np.vstack([np.zeros(3), 0.5 * (t[1:] + t[:-1]) * np.diff(md)[:, None]]), axis=0) + rng.normal(0, rng.choice([0, 0.03, 0.2]), (n, 3))
        path = kind(md, inc, az, *p.T, rng.choice([0.05, 0.1, 1.0]))
        want = plain_walk(path, n)
        counted = path.accepts
        monkeypatch.setattr(path, "accepts", lambda a, b, inner: looked.append(len(inner)) or counted(a, b, inner), raising=False)
        kept, start = [0], 0
        while start < n - 1:
            start, _ = envelope.farthest(path, start, n)
            kept.append(start)
        assert kept == want
    assert looked


@pytest.mark.parametrize("kind", [envelope.ByDepth, envelope.ByPlace])
@pytest.mark.parametrize("turn", [0.0, 2e-7])
def test_long_run_in_linear_time(kind, turn):
    """One run of half a million stations, straight or on one arc."""
    n = 500_000
    md, inc = np.arange(n, dtype=float), 0.5 + turn * np.arange(n)
    north, tvd = (n * 0.0 + np.sin(0.5) * md, np.cos(0.5) * md) if not turn else ((np.cos(0.5) - np.cos(inc)) / turn, (np.sin(inc) - np.sin(0.5)) / turn)
    path = kind(md, inc, np.zeros(n), north, np.zeros(n), tvd, 0.1)
    started = time.perf_counter()
    assert envelope.farthest(path, 0, n) == (n - 1, False)
    assert time.perf_counter() - started < 20


def test_coarsening_against_loops(spark, sf, stations):
    got = sequence.coarsen_minimum_curvature(derived.stations(spark, sf), 0.1).toPandas().sort_values("seq")
    for b, g in stations.groupby("bore_id"):
        assert got[got.bore_id == b].seq.tolist() == slow_coarsening(g, 0.1)
    everything = sequence.coarsen_minimum_curvature(derived.stations(spark, sf), 0.0)
    assert everything.count() == len(stations)


@pytest.mark.parametrize("coarsen", [sequence.coarsen_minimum_curvature, sequence.coarsen_circular])
def test_coarsening_of_split_wells(spark, sf, coarsen):
    s = derived.stations(spark, sf)
    want = coarsen(s, 0.2).select("bore_id", "seq").toPandas().sort_values(["bore_id", "seq"]).reset_index(drop=True)
    cut = s.withColumn(B.BLOCK, F.floor(F.col("seq") / 11).cast("bigint"))
    got = coarsen(cut, 0.2).select("bore_id", "seq").toPandas().sort_values(["bore_id", "seq"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(want, got)


def test_circular_arc_through_points():
    arc = arcs.CircularArc([1.0, 2.0, 3.0], 0.4, 0.7, 0.01, 1.1)
    again = arcs.CircularArc.through(arc.p, arc.t, arc.at(120.0))
    pts = arc.at(np.linspace(0, 120, 30))
    assert again.distance(120.0, pts).max() < 1e-9
    curves = arcs.Curves(["CircularArc"], [[1.0, 2.0, 3.0]], [0.4], [0.7], [0.01], [1.1])
    _, d, _ = curves.closest(np.zeros(30, int), np.full(30, 120.0), pts + [0.0, 0.5, 0.0])
    assert np.allclose(d, arc.distance(120.0, pts + [0.0, 0.5, 0.0]), atol=1e-6)


def random_sections(rng, n):
    kind = rng.choice(list(arcs.SECTION), n)
    first = np.where(kind == "ConstantBuildAndTurn", rng.normal(0, 2e-3, n), rng.choice([0.0, 1e-3, 5e-3], n))
    return kind, rng.normal(0, 100, (n, 3)), rng.uniform(0.05, 2.5, n), rng.uniform(0, 6, n), first, rng.choice([0.0, 1e-3, 0.7, 3.1], n)


def test_curves_equal_single_sections():
    rng = np.random.default_rng(3)
    parts = random_sections(rng, 60)
    curves, s = arcs.Curves(*parts), rng.uniform(0, 400, 60)
    at, (inc, az) = curves.at(np.arange(60), s), curves.direction(np.arange(60), s)
    middle, radius = curves.balls(s)
    for k in range(60):
        one = arcs.SECTION[parts[0][k]](parts[1][k], *(x[k] for x in parts[2:]))
        assert np.allclose(one.at(s[k]), at[k], atol=1e-9)
        i, a = one.direction(s[k])
        assert np.allclose(arcs.tangent(i, a), arcs.tangent(inc[k], az[k]), atol=1e-9)
        assert (np.linalg.norm(one.at(np.linspace(0, s[k], 40)) - middle[k], axis=1) <= radius[k] + 1e-9).all()


def slow_periods(x, spread):
    out, start = [], 0
    while start < len(x) - 1:
        for end in range(len(x) - 1, start, -1):
            part = x[start : end + 1]
            if np.mean((part - part.mean()) ** 2) < spread**2:
                out.append((start, end, part.mean()))
                start = end
                break
        else:
            start += 1
    return out


def test_periods_and_labels():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x = np.repeat(rng.normal(0, 3, 5), 8) + rng.normal(0, 0.1, 40)
        got, want = fitting.constant_periods(x, 0.5), slow_periods(x, 0.5)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([m for *_, m in got], [m for *_, m in want])
    assert fitting.equivalence_labels([(1, 3, 0.0), (3, 5, 0.0)], 7).tolist() == [0, 1, 1, 1, 2, 2, 3]


def cheapest_paths(keep):
    """The cost of every sequence of types over all steps."""
    n = len(keep[0])
    return {
        path: sum(keep[v][i] if v == path[i - 1] else 1 for i, v in enumerate(path) if i)
        for path in itertools.product(range(3), repeat=n)
    }


def test_least_switches_against_all_sequences():
    """The first of the cheapest sequences, compared from the last step on by cost so far, then by type."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 7):
        for _ in range(40):
            keep = [[int(x) for x in rng.integers(0, 2, n)] for _ in range(3)]
            costs = cheapest_paths(keep)
            so_far = {p: [sum(keep[v][i] if v == p[i - 1] else 1 for i, v in enumerate(p[:k]) if i) for k in range(n, 0, -1)] for p in costs}
            want = min(costs, key=lambda p: [x for pair in zip(so_far[p], p[::-1]) for x in pair])
            assert tuple(fitting.least_switches(keep)) == want


@pytest.mark.parametrize("cuts", [[3], [1, 2, 9], [5, 10, 15, 20], list(range(1, 30))])
def test_blocks_of_steps_compose(cuts):
    rng = np.random.default_rng(len(cuts))
    for _ in range(30):
        flags = rng.integers(0, 8, 30).tolist()
        whole = fitting.least_switches([[f >> v & 1 for f in flags] for v in range(3)])
        parts = [flags[a:b] for a, b in zip([0, *cuts], [*cuts, 30])]
        states, state = [], fitting.OPENING
        for k, part in enumerate(parts):
            states.append(state)
            state, _, _ = fitting.cross_block(part, state, k == 0)
        last, got = fitting.best_type(state), []
        for k in reversed(range(len(parts))):
            _, inner, enter = fitting.cross_block(parts[k], states[k], k == 0)
            types = fitting.types_in_block(parts[k], states[k], k == 0, last)
            assert types[0] == fitting.MAPS[inner][last]
            got, last = types + got, fitting.MAPS[enter][types[0]]
        assert got == whole


def test_last_ends_against_a_scan():
    """From every start, in several series at once, with far values, ties and runs that become valid late."""
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 17, 64, 150):
        x = np.repeat(rng.normal(0, 2, (3, n)), 4, axis=1)[:, :n] + rng.normal(0, 0.4, (3, n))
        x[0, rng.integers(0, n, 2)] += 1e9
        x[2] = 5.0
        bound = np.array([0.3, 0.2, 1e-9])
        tree = Moments(np.ones_like(x), x, np.zeros_like(x))
        ends, means, _ = tree.last_ends(bound, np.repeat(np.arange(3), n), np.tile(np.arange(n), 3))
        for k, (row, start) in enumerate((r, s) for r in range(3) for s in range(n)):
            good = [e for e in range(start + 1, n) if np.var(x[row, start : e + 1]) < bound[row]]
            assert ends[k] == (good[-1] if good else -1)
            if good:
                assert abs(means[k] - x[row, start : good[-1] + 1].mean()) < 1e-9 * max(1, abs(means[k]))


def test_time_of_periods_grows_with_the_path():
    """Eight times the steps take less than sixteen times as long, where every start looks at the whole rest."""
    def spent(n):
        x = np.random.default_rng(1).normal(0, 1, n)
        started = time.perf_counter()
        fitting.constant_periods(x, 0.9)
        return time.perf_counter() - started

    spent(1000)
    assert spent(64_000) < 16 * max(spent(8_000), 0.02)


def test_sections_of_simple_wells(spark):
    straight = make_stations(spark, [0.0, 30.0, 60.0, 90.0], [0.3] * 4, [1.0] * 4)
    got = sequence.fit_sections(straight).collect()
    assert len(got) == 1 and got[0].start_md == 0.0 and got[0].end_md == 90.0 and abs(got[0].first) < 1e-12
    md = [30.0 * i for i in range(20)]
    bend = make_stations(spark, md, [0.02 * i for i in range(20)], [0.5] * 20)
    sections = sequence.fit_sections(bend)
    points = sequence.section_points(sections, 30.0).toPandas().set_index("md")
    want = bend.toPandas().set_index("md")
    assert np.abs(points.loc[md, "tvd"].to_numpy() - want.loc[md, "tvd"].to_numpy()).max() < 0.5


def test_section_chain_is_continuous(spark, sf):
    s = derived.stations(spark, sf)
    sections = B.durable(sequence.fit_sections(s))
    assert sequence.section_chain(sections).select(F.max("gap")).first()[0] < 1e-6
    g = sections.toPandas().sort_values(["bore_id", "section_index"])
    for b, w in g.groupby("bore_id"):
        assert (w.end_md.to_numpy()[:-1] == w.start_md.to_numpy()[1:]).all()
    far = sequence.section_distance(sequence.coarsen_circular(s, 0.1), sections).toPandas()
    assert far.distance.notna().all() and (far.section_u.between(0, 1)).all()


def noisy_wells(spark):
    """Wells of constant stretches, noise, straight parts, a single step, one station, and one whose depth falls."""
    rng = np.random.default_rng(12)
    wells = []
    for b, n in enumerate((150, 90, 40, 2, 1, 30)):
        rates = np.repeat(rng.choice([0.0, 0.0, 1e-3, -5e-4], n), 9)[:n]
        inc = 0.6 + np.cumsum(rates * 10) + rng.normal(0, [1e-4, 2e-2, 0.0, 0, 0, 1e-3][b], n)
        az = 1.0 + (np.cumsum(np.repeat(rng.choice([0.0, 2e-3], n), 15)[:n] * 5) if b != 2 else 0.0) + 0.0 * inc
        md = 10.0 * np.arange(n)
        if b == 5:
            md[20] = md[18]
        wells.append(make_stations(spark, md.tolist(), inc.tolist(), az.tolist(), bore_id=b))
    out = wells[0]
    for w in wells[1:]:
        out = out.unionByName(w)
    return B.durable(out)


@pytest.mark.parametrize("rows", [7, 20, 1 << 20])
def test_sections_of_split_wells(spark, rows):
    s = noisy_wells(spark)
    order = ["bore_id", "section_index"]
    want = sequence.fit_sections(s).toPandas().sort_values(order).reset_index(drop=True)
    cut = s.withColumn(B.BLOCK, F.floor(F.col("seq") / rows).cast("bigint"))
    got = sequence.fit_sections(cut).toPandas().sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(want, got[want.columns])


def test_periods_of_split_wells(spark):
    s = noisy_wells(spark).withColumn(B.BLOCK, F.floor(F.col("seq") / 9).cast("bigint"))
    spread = 3e-4
    got = fitting.constant_periods_of(s, "dls", spread).toPandas().sort_values(["bore_id", "start"]).reset_index(drop=True)
    plain = s.toPandas().sort_values(["bore_id", "seq"])
    want = {b: slow_periods(g.dls.fillna(0.0).to_numpy(), spread) for b, g in plain.groupby("bore_id")}
    for b, periods in want.items():
        own = got[got.bore_id == b]
        assert list(zip(own.start, own.end)) == [p[:2] for p in periods]
        assert own.shared.tolist() == [k > 0 and periods[k - 1][1] == p[0] for k, p in enumerate(periods)]
    for repeat in (False, True):
        labelled = fitting.label_periods(s, "dls", spread, repeat_shared=repeat).toPandas().sort_values(["bore_id", "seq"])
        assert labelled.columns.tolist() == [*s.columns, "label", "mean"]
        for b, g in labelled.groupby("bore_id"):
            label, expected, at = 0, [], 0
            for start, end, _ in want[b]:
                first = start if repeat else max(start, at)
                expected += range(label, label + max(0, start - at))
                label += max(0, start - at)
                expected += [label] * (end + 1 - first)
                label, at = label + 1, end + 1
            n = len(g)
            expected += range(label, label + max(0, n - at))
            assert g.label.tolist() == expected[:n]


def test_nearest_sections_equal_looking_at_all(spark):
    s = noisy_wells(spark)
    sections = B.durable(fitting.fit_sections(s, eps_length=20.0, eps_curvature=1e-5))
    every = sections.toPandas().sort_values(["bore_id", "section_index"])
    assert every.section_index.max() > sequence.FAN
    got = sequence.section_distance(s, sections).toPandas()
    assert len(got) == s.count()
    for b, g in got.groupby("bore_id"):
        own = every[every.bore_id == b].reset_index(drop=True)
        points = s.filter(F.col("bore_id") == b).toPandas().set_index("seq").loc[g.seq, ["north", "east", "tvd"]].to_numpy()
        curves, length = sequence._curves(own), (own.end_md - own.start_md).to_numpy()
        i = np.tile(np.arange(len(own)), len(points))
        _, d, _ = curves.closest(i, length[i], np.repeat(points, len(own), axis=0))
        d = d.reshape(len(points), len(own))
        assert np.allclose(g.distance, d.min(axis=1), atol=1e-9)
        assert (g.section_index.to_numpy() == own.section_index.to_numpy()[d.argmin(axis=1)]).mean() > 0.99


def test_chain_over_blocks_of_sections(spark, sf, monkeypatch):
    s = derived.stations(spark, sf).withColumn(B.BLOCK, F.floor(F.col("seq") / 20).cast("bigint"))
    order = ["bore_id", "section_index"]
    want = sequence.fit_sections(s).toPandas().sort_values(order).reset_index(drop=True)
    monkeypatch.setattr(B, "ROWS_PER_BLOCK", 2)
    got = sequence.fit_sections(s).toPandas().sort_values(order).reset_index(drop=True)
    assert want.section_index.max() > 4
    pd.testing.assert_frame_equal(want, got)


def test_realizations(spark, sf):
    s = uncertainty_plans.covered_stations(spark, sf)
    cases = spark.createDataFrame([(1, 1, 60, 0.1, 7), (2, 2, 3, 0.0, 7), (3, 3, 0, 0.1, 7), (4, 999, 5, 0.1, 7)],
                                  "case_id long, bore_id long, realizations int, coarsening double, seed long")
    reasons = {r.case_id: r.reason for r in sequence.validate_realization_inputs(cases, s).collect()}
    assert reasons[1] is None and reasons[3] and reasons[4]
    a = sequence.realize(cases, s).toPandas().sort_values(["case_id", "realization", "seq"]).reset_index(drop=True)
    refused = a[a.status == "refused"].set_index("case_id")
    assert sorted(a.case_id.unique()) == [1, 2, 3, 4] and refused.reason.to_dict() == {3: reasons[3], 4: reasons[4]}
    a = a[a.status != "refused"].reset_index(drop=True)
    assert (a.status == "ok").all() and a.reason.isna().all()
    assert a[a.case_id == 1].realization.nunique() == 60
    b = sequence.realize(cases, s.repartition(7)).toPandas().sort_values(["case_id", "realization", "seq"]).reset_index(drop=True)
    b = b[b.status != "refused"].reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
    # the spread of the end points follows the covariance of the last station
    well = s.filter("bore_id = 1").toPandas().sort_values("seq")
    last = a[a.case_id == 1].groupby("realization").tail(1)
    want = np.sqrt(well[["c00", "c11", "c22"]].iloc[-1].sum())
    miss = last[["north", "east", "tvd"]].to_numpy() - well[["north", "east", "tvd"]].iloc[-1].to_numpy(dtype=float)
    rms = np.sqrt((miss**2).sum(axis=1).mean())
    assert 0.5 * want < rms < 1.6 * want


def test_bias_moves_what_is_drawn(spark, sf):
    """Without covariance every realization is the path itself, moved by the bias of its stations."""
    s = uncertainty_plans.covered_stations(spark, sf).filter("bore_id = 1").withColumns({c: F.lit(0.0) for c in sequence.COVARIANCE})
    cases = spark.createDataFrame([(1, 1, 2, 0.0, 7)], "case_id long, bore_id long, realizations int, coarsening double, seed long")
    well = s.toPandas().sort_values("seq")[["north", "east", "tvd"]].to_numpy(dtype=float)
    for bias in (0.0, 2.5):
        moved = s.withColumns({"bias_n": F.lit(bias), "bias_e": F.lit(None).cast("double"), "bias_t": F.lit(-bias)})
        got = sequence.realize(cases, moved if bias else s).toPandas().sort_values(["realization", "seq"])
        assert set(got.status) == {"ok"} and len(got) == 2 * len(well)
        for _, g in got.groupby("realization"):
            assert np.abs(g[["north", "east", "tvd"]].to_numpy(dtype=float) - well - [bias, 0.0, -bias]).max() < 1e-3


def test_points_of_realizations_are_not_kept(spark, sf, monkeypatch):
    """Points go straight to the output, whole or in groups; a case fails as a whole, and positions are those of a survey."""
    s = uncertainty_plans.covered_stations(spark, sf).filter("bore_id IN (1, 2)")
    # the second station of well 9 lies straight behind the first, so no arc reaches it
    back = [(9, k, 10.0 * k, 0.0, 0.0, 0.0, 0.0, -10.0 * k, *[0.0] * 6) for k in range(3)]
    fields = ["bore_id", "seq", *sequence.STATION, *sequence.COVARIANCE]
    s = s.select(*fields).unionByName(spark.createDataFrame(back, s.select(*fields).schema)).cache()
    cases = spark.createDataFrame([(1, 1, 30, 0.1, 7), (2, 9, 30, 0.0, 7), (3, 2, 26, 0.0, 9)],
                                  "case_id long, bore_id long, realizations int, coarsening double, seed long")
    kept, durable = [], B.durable

    def watched(df):
        kept.append(set(df.columns))
        return durable(df)

    monkeypatch.setattr(B, "durable", watched)
    order = ["case_id", "realization", "seq"]
    whole = sequence.realize(cases, s).toPandas().sort_values(order).reset_index(drop=True)
    assert not [c for c in kept if c & {"realization", "north"}]
    assert whole[whole.case_id == 2].status.tolist() == ["failed"] and whole[whole.case_id == 2][fields[2:8]].isna().all().all()
    assert whole[whole.case_id != 2].groupby("case_id").realization.nunique().to_dict() == {1: 30, 3: 26}
    monkeypatch.setattr(sequence, "POINTS_TOGETHER", 100)
    parts = sequence.realize(cases, s).toPandas().sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, parts)
    assert not [c for c in kept if c & {"realization", "north"}]
    ok = spark.createDataFrame(whole[whole.status == "ok"].drop(columns=["status", "reason"])).withColumn("path", F.struct("case_id", "realization"))
    again = survey.complete_survey(ok.withColumns({c: F.when(F.col("seq") == 0, F.col(c)) for c in ("north", "east", "tvd")}), key="path")
    again = again.toPandas().sort_values(order).reset_index(drop=True)
    for c in ("north", "east", "tvd"):
        assert np.abs(again[c] - whole[whole.status == "ok"][c].to_numpy(dtype=float)).max() < 2e-6


def test_aggregation_case_isolates_failures(spark, sf):
    s = derived.stations(spark, sf)
    cases = spark.createDataFrame([(1, 1), (1, 777)], "case_id long, bore_id long")
    got = {r.bore_id: r for r in sequence.aggregation_case(cases, s).collect()}
    assert got[1].ok and got[1].n_sections >= 1 and not got[777].ok


@pytest.mark.parametrize("kind", [envelope.ByDepth, envelope.ByPlace])
def test_many_paths_walk_in_step(kind, monkeypatch):
    """Paths of 1 to 130 stations in one call keep what each keeps alone, long runs too."""
    monkeypatch.setattr(envelope, "_IN_STEP", 12)
    rng, paths, want, begins = np.random.default_rng(5), [], [], [0]
    for case in range(40):
        n = int(rng.integers(1, 130))
        md = np.cumsum(rng.choice([1.0, 10.0, 30.0]) * np.ones(n))
        turn = np.repeat(rng.choice([0.0, 1e-3, 1e-4], n), 20)[:n]
        inc, az = 0.8 + np.cumsum(turn) + rng.normal(0, rng.choice([0, 1e-6, 1e-2]), n), 1.0 + 0.5 * np.cumsum(turn)
        t = arcs.tangent(inc, az)
        p = np.cumsum(np.vstack([np.zeros(3), 0.5 * (t[1:] + t[:-1]) * np.diff(md)[:, None]]), axis=0) + rng.normal(0, rng.choice([0, 0.2]), (n, 3))
        paths.append(np.vstack([md, inc, az, *p.T]))
        tolerance = 0.0 if case % 9 == 4 else 0.1
        want += [begins[-1] + k for k in (plain_walk(kind(md, inc, az, *p.T, 0.1), n) if tolerance else range(n))]
        begins.append(begins[-1] + n)
    tolerances = np.array([0.0 if case % 9 == 4 else 0.1 for case in range(40)])
    got = envelope.kept_in_step(kind, list(np.hstack(paths)), np.array(begins), tolerances)
    assert np.flatnonzero(got).tolist() == want


def test_periods_of_many_paths_at_once():
    rng, sizes = np.random.default_rng(3), [1, 2, 3, 9, 40, 64, 65, 100, 2]
    values = [np.round(rng.normal(0, 1, n), 1) * (k % 3) for k, n in enumerate(sizes)]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    ends, means = fitting.last_ends_of_many(np.concatenate(values)[None, :], begins, np.array([0.25]))
    for low, high, x in zip(begins[:-1], begins[1:], values):
        got, _, _ = fitting.walk_periods(ends[0, low:high].tolist(), means[0, low:high].tolist(), 0, high - low - 1)
        assert got == fitting._periods_of_values(x, 0.5)


def test_paths_share_calls(spark, sf):
    """No Python call for each path: the plans hold no function that is called group by group."""
    s = derived.stations(spark, sf)
    for made in (sequence.coarsen_circular(s, 0.1), fitting.constant_periods_of(s, "dls", 0.001), survey.ewma(s.select("bore_id", "seq", "dls"), ["dls"])):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan
