"""Stations between stations: along the arc, linear samples, depth grids and lists, sidetrack cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreline.functions import blocks as B
from boreline.functions import geometry as G
from boreline.functions.joins import bracket
from boreline.operators import survey

DEPTH_TOLERANCE = 1e-6
TIE_IN_MARK = "Sidetrack tie-in"
PLACE = ("north", "east", "tvd", "inc", "az")


def on_arc(df: DataFrame, md="md", linear: tuple[str, ...] = ()) -> DataFrame:
    """Fill north, east, tvd, inc, az (and linear columns) at ``md`` on the segment a_*, b_* of each row."""
    *stages, last = G.arc_steps(md)
    last |= {c: G.lerp_or_either("a_" + c, "b_" + c, "_u") for c in linear}
    return G.apply_steps(df, [*stages, last]).drop(*G.ARC_HELPERS)


def on_path(df: DataFrame, md="md", linear: tuple[str, ...] = (), method: str = survey.MINIMUM_CURVATURE) -> DataFrame:
    """The same on a path completed by ``method``: its angles at the depth, and its own step from a_* to there."""
    if method == survey.MINIMUM_CURVATURE:
        return on_arc(df, md, linear)
    span, turn = F.col("b_md") - F.col("a_md"), G.wrap_signed(F.col("b_az") - F.col("a_az"))
    df = df.withColumn("_u", F.when(span > 0, (G.col(md) - F.col("a_md")) / span).otherwise(F.lit(0.0)))
    df = df.withColumn("_inc", G.lerp("a_inc", "b_inc", F.col("_u")))
    share = F.col("_u")
    if method == survey.CURVATURE_AND_TOOLFACE:
        share = survey.toolface_share(F.col("a_inc"), F.col("b_inc"), F.col("_inc"), share)
    df = df.withColumn("_az", F.col("a_az") + turn * share)
    step = survey.method_step(method, F.col("a_inc"), F.col("a_az"), F.col("_inc"), F.col("_az"), F.col("_u") * span)
    place = {axis: F.col("a_" + axis) + move for axis, move in zip(("north", "east", "tvd"), step)}
    place |= {"inc": F.col("_inc"), "az": G.wrap_positive(F.col("_az"))}
    place |= {c: G.lerp_or_either("a_" + c, "b_" + c, "_u") for c in linear}
    return df.withColumns(place).drop("_u", "_inc", "_az")


def interpolate_station(
    points: DataFrame, stations: DataFrame, key: str = "bore_id", linear: tuple[str, ...] = (),
    method: str = survey.MINIMUM_CURVATURE,
) -> DataFrame:
    """Station at each requested depth (key, md, ...) on its well; depths outside the survey give no row.

    ``method`` is the one the stations were completed by, so the samples lie on the path itself.
    """
    segs = survey.segments(stations, key, linear).drop("seq")
    found = bracket(points, segs, [key])
    inside = found.filter(F.col("md") <= F.col("b_md") + DEPTH_TOLERANCE)
    out = on_path(inside, F.least("md", "b_md"), linear, method)
    return out.select(*points.columns, *PLACE, *linear)


def parent_tie_in(
    bores: DataFrame, stations: DataFrame, max_gap: float = 10.0, method: str = survey.MINIMUM_CURVATURE
) -> DataFrame:
    """Tie-in station of every sidetrack, read off its parent's path, which ``method`` completed.

    At most ``max_gap`` past the parent's end the parent's last station serves.  The station carries the start depth
    of the sidetrack's own run (column run_start_md where ``bores`` has it, else the tie-in depth).
    """
    label = "run_start_md" if "run_start_md" in bores.columns else "tie_in_md"
    want = bores.filter("is_sidetrack AND parent_bore_id IS NOT NULL AND tie_in_md IS NOT NULL").select(
        F.col("bore_id").alias("child"),
        F.col("parent_bore_id").alias("bore_id"),
        F.col("tie_in_md").alias("md"),
        F.col(label).alias("label_md"),
    )
    found = bracket(want, survey.segments(stations).drop("seq"), ["bore_id"])
    found = found.filter(F.col("md") <= F.col("b_md") + max_gap)
    placed = on_path(found, F.least("md", "b_md"), method=method)
    return placed.select(F.col("child").alias("bore_id"), F.col("label_md").alias("md"), "inc", "az", "north", "east", "tvd")


def interpolate_grid(
    cases: DataFrame, stations: DataFrame, depths: DataFrame | None = None, method: str = survey.MINIMUM_CURVATURE
) -> DataFrame:
    """Stations of each interpolation case on a regular grid and at its listed depths.

    ``cases``: case_id, bore_id, step, reference_depth (null = first station).  Grid depths are the reference plus
    whole steps inside the survey; each segment makes its own part of the grid, so a long well spreads over its
    segments.  A step that is null or not positive makes no grid; a case that asks nothing is empty.
    ``depths``: case_id, bore_id, md, annotation (see ``merge_depths``).
    """
    first = stations.groupBy("bore_id").agg(F.min("md").alias("_first"), F.max("md").alias("_last"))
    grid = cases.filter(G.is_defined("step") & (F.col("step") > 0)).join(first, "bore_id")
    origin = F.coalesce("reference_depth", "_first")
    grid = grid.select("case_id", "bore_id", "step", origin.alias("_origin"), "_last")
    segs = survey.segments(stations).drop("seq", "n_lo", "n_hi", "e_lo", "e_hi", "t_lo", "t_hi")
    cut = segs.join(grid, "bore_id")
    low = F.ceil((F.col("a_md") - F.col("_origin")) / F.col("step") - DEPTH_TOLERANCE)
    high = F.floor((F.col("b_md") - F.col("_origin")) / F.col("step") + DEPTH_TOLERANCE)
    cut = cut.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high")
    cut = cut.withColumn("_k", F.explode(F.sequence("_low", "_high")))
    at = F.col("_origin") + F.col("_k") * F.col("step")
    cut = cut.withColumn("md", F.least(F.greatest(at, "a_md"), "b_md"))
    # a grid depth on a station belongs to the segment below it, except at the end of the well
    owned = (F.col("md") < F.col("b_md") - DEPTH_TOLERANCE) | (F.col("b_md") >= F.col("_last"))
    regular = on_path(cut.filter(owned), method=method).select(
        "case_id", "bore_id", "md", F.lit(None).cast("string").alias("annotation"), *PLACE
    )
    if depths is None:
        return regular
    listed = interpolate_station(depths.select("case_id", "bore_id", "md", "annotation"), stations, method=method)
    quantum = F.round(F.col("md") / DEPTH_TOLERANCE)
    both = B.stack(["case_id", "bore_id"], regular, listed).groupBy("case_id", "bore_id", quantum.alias("_q")).agg(
        F.min_by(F.struct("md", *PLACE), F.struct(F.col("annotation").isNull(), "md")).alias("_row"),
        F.max("annotation").alias("annotation"),
    )
    return both.select("case_id", "bore_id", "_row.md", "annotation", *["_row." + c for c in PLACE])


def merge_depths(lists: DataFrame) -> DataFrame:
    """One row per distinct depth of each case.

    ``lists``: case_id, bore_id, source (0 = user, 1 = internal), pos, md, annotation.  Depths equal to 1e-6 are one;
    the first in list order gives the depth, the first non-blank annotation the text.
    """
    rank = F.struct("source", "pos")
    text = F.when(F.trim("annotation") != "", F.col("annotation"))
    return (
        lists.filter(G.is_defined("md"))
        .groupBy("case_id", "bore_id", F.round(F.col("md") / DEPTH_TOLERANCE).alias("_q"))
        .agg(
            F.min_by("md", rank).alias("md"),
            F.coalesce(F.min_by(text, F.when(text.isNotNull(), rank)), F.lit("")).alias("annotation"),
        )
        .drop("_q")
    )


def _depth_finder(on_arc: bool):
    """Fraction of a segment where it reaches a vertical depth: 64 halvings, of all rows of a batch at once."""

    def find(target: pd.Series, a_inc: pd.Series, b_inc: pd.Series, a_tvd: pd.Series, ds: pd.Series, dl: pd.Series) -> pd.Series:
        import numpy as np

        target, i1, i2, top, ds, dl = (np.asarray(c, "float64") for c in (target, a_inc, b_inc, a_tvd, ds, dl))

        def arc(u):
            bend, t = dl < 1e-9, u * dl
            w1 = np.where(bend, 1.0 - u, np.sin((1.0 - u) * dl) / np.sin(dl))
            w2 = np.where(bend, u, np.sin(t) / np.sin(dl))
            length = np.where(bend, 1.0, np.sqrt(w1 * w1 + w2 * w2 + 2.0 * w1 * w2 * np.cos(dl)))
            q = t * t
            series = 1.0 + q / 12.0 * (1.0 + q / 10.0 * (1.0 + q / 168.0 * (1.0 + 31.0 * q / 18.0)))
            ratio = np.where(t < 0.02, series, 2.0 / t * np.tan(t / 2.0))
            return top + 0.5 * u * ds * ratio * (np.cos(i1) + (w1 * np.cos(i1) + w2 * np.cos(i2)) / length)

        def level(u):
            """The same where the inclination is linear in depth."""
            turn = i2 - i1
            flat = np.abs(turn) < 1e-9
            return top + ds * np.where(flat, u * np.cos(i1), (np.sin(i1 + u * turn) - np.sin(i1)) / np.where(flat, 1.0, turn))

        low, high, low_tvd = np.zeros(len(target)), np.ones(len(target)), top
        with np.errstate(all="ignore"):
            for _ in range(64):
                mid = 0.5 * (low + high)
                tvd = arc(mid) if on_arc else level(mid)
                above = (target >= np.fmin(low_tvd, tvd)) & (target <= np.fmax(low_tvd, tvd))
                low, high, low_tvd = np.where(above, low, mid), np.where(above, mid, high), np.where(above, low_tvd, tvd)
        return pd.Series(0.5 * (low + high))

    import pandas as pd

    find.__annotations__ = {n: pd.Series for n in find.__annotations__}
    return F.pandas_udf(find, "double")


def md_at_tvd(targets: DataFrame, stations: DataFrame, depth_bin: float = 100.0, method: str = survey.MINIMUM_CURVATURE) -> DataFrame:
    """Depth where each well first reaches a vertical depth: bore_id, target_tvd -> md (no row if never reached).

    The first segment whose end depths bracket the target is bisected along the path that ``method`` completed it by: its
    arc, or the curve whose inclination is linear in depth, as it is by both other methods.
    """
    if method not in (survey.MINIMUM_CURVATURE, survey.BUILD_AND_TURN, survey.CURVATURE_AND_TOOLFACE):
        raise ValueError(f"unknown survey method {method}")
    segs = survey.segments(stations)
    low, high = F.least("a_tvd", "b_tvd"), F.greatest("a_tvd", "b_tvd")
    spread = segs.withColumn(
        "_bin", F.explode(F.sequence(F.floor(low / depth_bin), F.floor(high / depth_bin)))
    )
    asked = targets.withColumn("_bin", F.floor(F.col("target_tvd") / depth_bin))
    hit = asked.join(spread, ["bore_id", "_bin"]).filter(
        (F.col("target_tvd") >= low) & (F.col("target_tvd") <= high)
    )
    columns = ["a_md", "b_md", "a_inc", "a_az", "b_inc", "b_az", "a_tvd", "b_tvd"]
    first = hit.groupBy("bore_id", "target_tvd").agg(F.min_by(F.struct(*columns), "seq").alias("_s"))
    df = first.select("bore_id", "target_tvd", "_s.*")
    df = df.withColumn("_ds", F.col("b_md") - F.col("a_md")).withColumn(
        "_dl", G.dogleg("a_inc", "a_az", "b_inc", "b_az")
    )
    found = _depth_finder(method == survey.MINIMUM_CURVATURE)("target_tvd", "a_inc", "b_inc", "a_tvd", "_ds", "_dl")
    return df.select("bore_id", "target_tvd", (F.col("a_md") + found * F.col("_ds")).alias("md"))


def _spans(stations: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Every station with its successor (null for the last), as a_*, b_*."""
    block = [B.BLOCK] if B.is_split(stations) else []
    df = B.with_next(stations.select(key, "seq", *block, *fields), [key], ["seq"], fields)
    return df.select(
        key, *block, *[F.col(c).alias("a_" + c) for c in fields], *[F.col("next_" + c).alias("b_" + c) for c in fields]
    )


def as_of_sample(points: DataFrame, stations: DataFrame, key: str = "bore_id", md: str = "md") -> DataFrame:
    """Linear sample of position at a depth, with the hole radius; nulls outside the survey.

    Within 1e-6 of a station its own values count; between stations the radius is the larger of both ends.  Adds
    north, east, tvd, hole_radius.
    """
    fields = ["md", "north", "east", "tvd", "hole_radius"]
    probed = points.withColumn("_probe", F.col(md) + DEPTH_TOLERANCE)
    df = bracket(probed, _spans(stations, key, fields), [key], "_probe")
    near_a = F.abs(F.col(md) - F.col("a_md")) <= DEPTH_TOLERANCE
    near_b = F.coalesce(F.abs(F.col(md) - F.col("b_md")) <= DEPTH_TOLERANCE, F.lit(False))
    u = (F.col(md) - F.col("a_md")) / (F.col("b_md") - F.col("a_md"))

    def value(c: str, between: Column) -> Column:
        return F.when(near_a, F.col("a_" + c)).when(near_b, F.col("b_" + c)).otherwise(between)

    found = [value(c, G.lerp("a_" + c, "b_" + c, G.clamp(u, 0.0, 1.0))).alias(c) for c in ("north", "east", "tvd")]
    radius = F.when(F.col("b_md").isNotNull(), F.greatest("a_hole_radius", "b_hole_radius"))
    return df.select(*points.columns, *found, value("hole_radius", radius).alias("hole_radius"))


def nearest_station(points: DataFrame, stations: DataFrame, key: str = "bore_id") -> DataFrame:
    """Station with the least depth difference to each point; the shallower of two equals."""
    fields = ["seq", "md"]
    block = [B.BLOCK] if B.is_split(stations) else []
    base = stations.select(key, "seq", "md", *block)
    span = B.with_next(base, [key], ["seq"], fields)
    first = base.groupBy(key).agg(F.min_by(F.struct(*fields), "seq").alias("_f"))
    low = F.lit(float("-inf"))
    opening = first.select(
        key, F.lit(None).cast("bigint").alias("a_seq"), low.alias("a_md"),
        F.col("_f.seq").alias("b_seq"), F.col("_f.md").alias("b_md"),
    )
    spans = span.select(
        key, F.col("seq").alias("a_seq"), F.col("md").alias("a_md"),
        F.col("next_seq").alias("b_seq"), F.col("next_md").alias("b_md"),
    )
    spans = B.stack([key], spans, opening)
    df = bracket(points, spans, [key])
    to_a = F.when(F.col("a_seq").isNotNull(), F.abs(F.col("md") - F.col("a_md")))
    to_b = F.abs(F.col("md") - F.col("b_md"))
    use_a = F.col("b_seq").isNull() | (F.col("a_seq").isNotNull() & (to_a <= to_b))
    return df.select(
        *points.columns,
        F.when(use_a, F.col("a_seq")).otherwise(F.col("b_seq")).alias("seq"),
        F.when(use_a, F.col("a_md")).otherwise(F.col("b_md")).alias("station_md"),
    )


def evenly_spaced_sample(rows: DataFrame, keys: list[str], order: list[str], count: int) -> DataFrame:
    """At most ``count`` rows per well at evenly spaced positions, first and last included (a display sample).

    Position i*(N-1)/(count-1) is rounded half to even.
    """
    n = max(1, count)
    df = B.with_position(rows, keys, order, "_pos", "_total")
    pos, last = F.col("_pos"), F.col("_total") - 1
    if n == 1:
        chosen = pos == 0
    else:
        i = pos * (n - 1) / last
        chosen = F.lit(False)
        for k in (F.floor(i), F.ceil(i)):
            chosen = chosen | (F.bround(k * last / (n - 1)) == pos)
    return df.filter((F.col("_total") <= n) | chosen | (pos == last)).drop("_pos", "_total")


def densify_chord_arc(
    stations: DataFrame, limit: float | None, key: str = "bore_id", method: str = survey.MINIMUM_CURVATURE
) -> DataFrame:
    """Add stations so that no chord is farther than ``limit`` from its arc; unchanged without a positive limit.

    Each bent segment is cut into the least number of equal parts that keep the sagitta within the limit.  Rows are
    numbered anew, a hole radius is interpolated, and blocks are kept, so the result can be cut into segments.
    """
    extra = ("hole_radius",) if "hole_radius" in stations.columns else ()
    block = B.block_column(stations)
    columns = [key, *block, "md", *PLACE, *extra]
    if limit is None or not limit > 0:
        return stations.select(key, "seq", *columns[1:])
    segs = survey.segments(stations, key, extra).drop("seq").withColumn("_bend", G.dogleg("a_inc", "a_az", "b_inc", "b_az"))
    radius = (F.col("b_md") - F.col("a_md")) / F.col("_bend")
    widest = 2.0 * F.acos(G.clamp(1.0 - limit / radius, -1.0, 1.0))
    parts = F.when(F.col("_bend") > 1e-9, F.greatest(F.lit(1), F.ceil(F.col("_bend") / widest).cast("int"))).otherwise(1)
    cut = segs.withColumn("_n", parts).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    cut = cut.withColumn("md", F.col("a_md") + F.col("_k") * (F.col("b_md") - F.col("a_md")) / F.col("_n"))
    inner = on_path(cut.filter("_k > 0"), linear=extra, method=method).select(*columns)
    return B.with_position(B.stack([key], stations.select(*columns), inner), [key], ["md"], "seq")


def _cut_at_tie_in(measured: DataFrame, bores: DataFrame, rebase: bool) -> DataFrame:
    columns = ["bore_id", "seq", "md", "inc", "az", "annotation"]
    if "annotation" not in measured.columns:
        measured = measured.withColumn("annotation", F.lit(None).cast("string"))
    tie = bores.filter("is_sidetrack AND tie_in_md IS NOT NULL").select("bore_id", "tie_in_md")
    reach = measured.groupBy("bore_id").agg(F.min("md").alias("_lo"), F.max("md").alias("_hi"))
    inside = (F.col("_lo") < F.col("tie_in_md")) & (F.col("_hi") > F.col("tie_in_md"))
    cut = tie.join(reach, "bore_id").filter(inside)
    if rebase:
        done = measured.filter((F.col("seq") == 0) & (F.col("md") == 0.0) & (F.col("annotation") == TIE_IN_MARK))
        cut = cut.join(done.select("bore_id"), "bore_id", "left_anti")
    block = [B.BLOCK] if B.is_split(measured) else []
    df = B.with_previous(measured.select(*columns, *block), ["bore_id"], ["seq"], ["md", "inc", "az"])
    df = df.join(cut.select("bore_id", "tie_in_md"), "bore_id", "left")
    tie_md = F.col("tie_in_md")
    df = df.filter(tie_md.isNull() | (F.col("md") > tie_md))
    u = (tie_md - F.col("prev_md")) / (F.col("md") - F.col("prev_md"))
    base = F.coalesce(tie_md, F.lit(0.0)) if rebase else F.lit(0.0)
    start = F.struct(
        (F.col("seq") - 1).alias("seq"),
        (tie_md - base).alias("md"),
        G.lerp("prev_inc", "inc", u).alias("inc"),
        G.lerp("prev_az", "az", u).alias("az"),
        F.lit(TIE_IN_MARK).alias("annotation"),
    )
    row = F.struct("seq", (F.col("md") - base).alias("md"), "inc", "az", "annotation")
    opening = tie_md.isNotNull() & (F.col("prev_md") <= tie_md)
    rows = F.when(opening, F.array(start, row)).otherwise(F.array(row))
    return df.select("bore_id", F.inline(rows))


def normalize_sidetrack_import(measured: DataFrame, bores: DataFrame) -> DataFrame:
    """Cut each imported sidetrack above its tie-in depth and start it with an interpolated row there."""
    return _cut_at_tie_in(measured, bores, rebase=False)


def normalize_sidetrack_run(measured: DataFrame, bores: DataFrame) -> DataFrame:
    """The same for a stored run, with depth counted from the tie-in; runs already cut stay as they are."""
    return _cut_at_tie_in(measured, bores, rebase=True)


def sf_profile_distance(points: DataFrame, stations: DataFrame) -> DataFrame:
    """Centre and clearance distance of every separation-factor point; nulls where no comparison depth was found.

    ``points``: ref_id, cmp_id, seq, ref_md, cmp_md, sf.  ``stations``: bore_id, seq, md, north, east, tvd, hole_radius.
    """
    sample = ["north", "east", "tvd", "hole_radius"]
    side = points.withColumnRenamed("ref_id", "bore_id")
    side = as_of_sample(side, stations, md="ref_md").withColumnsRenamed({c: "r_" + c for c in sample})
    side = side.withColumnRenamed("bore_id", "ref_id").withColumnRenamed("cmp_id", "bore_id")
    side = as_of_sample(side, stations, md="cmp_md").withColumnRenamed("bore_id", "cmp_id")
    missing = (F.abs(F.col("cmp_md") + 1.0) <= 1e-9) & (F.abs(F.col("sf") - 5.0) <= 1e-9)
    distance = F.when(~missing, G.distance3(["r_north", "r_east", "r_tvd"], ["north", "east", "tvd"]))
    return side.select(
        *points.columns,
        distance.alias("centre_distance"),
        (distance - F.col("r_hole_radius") - F.col("hole_radius")).alias("clearance"),
    )
