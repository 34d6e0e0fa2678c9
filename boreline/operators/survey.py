"""Survey completion: steps between stations, cumulative positions, rates, tie-in, sections.

Every operator works on a long table keyed by ``(bore_id, seq)``; the first row of a well may carry a known position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreline.functions import blocks as B
from boreline.functions import geometry as G

MINIMUM_CURVATURE = "MinimumCurvatureMethod"
BUILD_AND_TURN = "ConstantBuildAndTurnMethod"
CURVATURE_AND_TOOLFACE = "ConstantCurvatureAndToolfaceMethod"
DEPTH_TOLERANCE = 1e-6
STEP_TYPE = "decimal(18,6)"

# Abscissas and weights of 16-point Gauss-Legendre quadrature on [-1, 1] (positive half).
GAUSS_16 = (
    (0.0950125098376374, 0.1894506104550685),
    (0.2816035507792589, 0.1826034150449236),
    (0.4580167776572274, 0.1691565193950025),
    (0.6178762444026438, 0.1495959888165767),
    (0.7554044083550030, 0.1246289712555339),
    (0.8656312023878318, 0.0951585116824928),
    (0.9445750230732326, 0.0622535239386479),
    (0.9894009349916499, 0.0271524594117541),
)


def _sinc_like(x: Column, numerator: Column, limit: Column) -> Column:
    return F.when(F.abs(x) < 1e-9, limit).otherwise(numerator / x)


def build_and_turn_step(i1, a1, i2, a2, ds) -> tuple[Column, Column, Column]:
    """Inclination and azimuth linear in depth; product-to-sum integrals with frequencies build -/+ turn."""
    turn = G.wrap_signed(a2 - a1)
    build = i2 - i1
    plus, minus = build + turn, build - turn
    s0, s1 = i1 + a1, i2 + a1 + turn
    d0, d1 = i1 - a1, i2 - a1 - turn
    sin_sum = _sinc_like(plus, F.cos(s0) - F.cos(s1), F.sin(s0))
    sin_diff = _sinc_like(minus, F.cos(d0) - F.cos(d1), F.sin(d0))
    cos_sum = _sinc_like(plus, F.sin(s1) - F.sin(s0), F.cos(s0))
    cos_diff = _sinc_like(minus, F.sin(d1) - F.sin(d0), F.cos(d0))
    down = _sinc_like(build, F.sin(i2) - F.sin(i1), F.cos(i1))
    return 0.5 * ds * (sin_sum + sin_diff), 0.5 * ds * (cos_diff - cos_sum), ds * down


def curvature_and_toolface_step(i1, a1, i2, a2, ds) -> tuple[Column, Column, Column]:
    """Inclination linear in depth, azimuth by constant toolface; Gauss quadrature of the tangent."""
    turn, build = G.wrap_signed(a2 - a1), i2 - i1
    log1, log2 = F.log(F.tan(i1 / 2.0)), F.log(F.tan(i2 / 2.0))
    safe = (i1 > 1e-9) & (i2 > 1e-9) & (F.abs(build) > 1e-9)
    north = east = down = F.lit(0.0)
    for x, w in GAUSS_16:
        for u in (0.5 * (1.0 + x), 0.5 * (1.0 - x)):
            inc = i1 + build * u
            share = F.when(safe, (F.log(F.tan(inc / 2.0)) - log1) / (log2 - log1)).otherwise(F.lit(u))
            az = a1 + turn * share
            north = north + 0.5 * w * F.sin(inc) * F.cos(az)
            east = east + 0.5 * w * F.sin(inc) * F.sin(az)
            down = down + 0.5 * w * F.cos(inc)
    return ds * north, ds * east, ds * down


def toolface_share(i1, i2, inc, otherwise: Column) -> Column:
    """Share of the turn reached at ``inc`` on a step of constant toolface; ``otherwise`` where it has no build."""
    safe = (i1 > 1e-9) & (i2 > 1e-9) & (F.abs(i2 - i1) > 1e-9)
    log1, log2 = F.log(F.tan(i1 / 2.0)), F.log(F.tan(i2 / 2.0))
    return F.when(safe, (F.log(F.tan(inc / 2.0)) - log1) / (log2 - log1)).otherwise(otherwise)


def method_step(method: str, i1, a1, i2, a2, ds) -> tuple[Column, Column, Column]:
    """Displacement of a step of one of the two methods whose angles follow a rule of their own."""
    steps = {BUILD_AND_TURN: build_and_turn_step, CURVATURE_AND_TOOLFACE: curvature_and_toolface_step}
    if method not in steps:
        raise ValueError(f"unknown survey method {method}")
    return steps[method](i1, a1, i2, a2, ds)


def _angle_steps(df: DataFrame, method: str) -> DataFrame:
    """Add ``_ds, _dl`` and the displacement ``_dn, _de, _dt`` of each step from prev_md, prev_inc, prev_az.

    Intermediate values are columns of their own, so each is evaluated once.
    """
    i1, a1, i2, a2, ds = map(F.col, ("prev_inc", "prev_az", "inc", "az", "_ds"))
    df = df.withColumns({"_ds": F.col("md") - F.col("prev_md"), "_dl": G.dogleg(i1, a1, i2, a2)})
    if method == MINIMUM_CURVATURE:
        df = df.withColumn("_half", 0.5 * ds * G.ratio_factor("_dl"))
        move = [F.col("_half") * (x + y) for x, y in zip(G.tangent(i1, a1), G.tangent(i2, a2))]
    else:
        move = method_step(method, i1, a1, i2, a2, ds)
    return df.withColumns(dict(zip(("_dn", "_de", "_dt"), move))).drop("_half")


def exact(step: Column) -> Column:
    """Quantise a step to a micrometre, so that distributed running sums do not depend on their order."""
    return F.round(step, 6).cast(STEP_TYPE)


def with_steps(measured: DataFrame, method: str = MINIMUM_CURVATURE, key: str = "bore_id") -> DataFrame:
    """Add the previous row's md, inc, az and the displacement of each step (null on the first row)."""
    return _angle_steps(B.with_previous(measured, [key], ["seq"], ["md", "inc", "az"]), method)


def complete_survey(measured: DataFrame, method: str = MINIMUM_CURVATURE, key: str = "bore_id") -> DataFrame:
    """Positions, vertical section and rates for every station.

    The position of the first row of a well (columns north, east, tvd, vsect where present) is the start of the path.
    """
    df = with_steps(measured, method, key)
    known = {c: F.coalesce(F.col(c), F.lit(0.0)) if c in measured.columns else F.lit(0.0) for c in POSITION}
    first = F.col("prev_md").isNull()
    across = G.norm("_dn", "_de")
    step = dict(zip(POSITION, (F.col("_dn"), F.col("_de"), F.col("_dt"), across)))
    df = df.withColumns({"_" + c: exact(F.when(first, known[c]).otherwise(step[c])) for c in POSITION})
    df = df.drop("_dn", "_de", "_dt", *[c for c in POSITION if c in measured.columns])
    df = B.with_running_sum(df, [key], ["seq"], {c: "_" + c for c in POSITION})
    df = df.withColumns({c: F.col(c).cast("double") for c in POSITION})
    return with_rates(df).drop("_north", "_east", "_tvd", "_vsect", "_ds", "_dl", "prev_md", "prev_inc", "prev_az")


POSITION = ("north", "east", "tvd", "vsect")


def with_rates(df: DataFrame, wrap: bool = True) -> DataFrame:
    """Dogleg severity, build and turn rate per metre, from columns prev_*, _ds and _dl.

    ``wrap=False`` gives the plain azimuth difference of well listings.
    """
    turn = F.col("az") - F.col("prev_az")
    turn = G.wrap_signed(turn) if wrap else turn
    ds = F.when(F.col("_ds") > 0, F.col("_ds"))
    build = F.col("inc") - F.col("prev_inc")
    return df.withColumns({"dls": F.round(F.col("_dl") / ds, 8), "bur": F.round(build / ds, 8), "tur": F.round(turn / ds, 8)})


def osculating_centre(stations: DataFrame, key: str = "bore_id") -> DataFrame:
    """Centre of the circle through each step: chord midpoint plus unit(t2 - t1) / dls; null when straight."""
    df = B.with_previous(stations, [key], ["seq"], ["md", "inc", "az", "north", "east", "tvd"])
    t1, t2 = G.tangent("prev_inc", "prev_az"), G.tangent("inc", "az")
    diff = [b - a for a, b in zip(t1, t2)]
    df = df.withColumn("_len", G.norm(*diff)).withColumn(
        "_kappa", G.dogleg("prev_inc", "prev_az", "inc", "az") / (F.col("md") - F.col("prev_md"))
    )
    bent = (F.col("_kappa") > 1e-12) & (F.col("_len") > 1e-12)
    for name, axis, d in zip(("xc", "yc", "zc"), ("north", "east", "tvd"), diff):
        mid = 0.5 * (F.col(axis) + F.col("prev_" + axis))
        df = df.withColumn(name, F.when(bent, mid + d / F.col("_len") / F.col("_kappa")))
    return df.drop("_len", "_kappa", *["prev_" + c for c in ("md", "inc", "az", "north", "east", "tvd")])


def ewma(df: DataFrame, columns: list[str], alpha: float = 0.9, key: str = "bore_id") -> DataFrame:
    """Exponential smoothing s = alpha x + (1 - alpha) s' along each well from s = x, null counting as zero.

    A linear recurrence composes over blocks: a block is smoothed on its own, then the smoothed value before it is
    added with the decay of the distance.  Adds ``s_<column>``.
    """
    keep = 1.0 - alpha
    smoothed = ["s_" + c for c in columns]
    split = B.is_split(df)
    rows = df.select(key, "seq", *([B.BLOCK] if split else []), *columns)
    if split:
        first = rows.groupBy(key).agg(F.min(B.BLOCK).alias("_first"))
        rows = rows.join(first, key).withColumn("_opening", F.col(B.BLOCK) == F.col("_first")).drop("_first")
    head = [key, *([B.BLOCK] if split else []), "seq"]

    def within_block(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("seq")
        opening = bool(pdf["_opening"].iat[0])
        for c in columns:
            x = pdf[c].fillna(0.0).to_numpy(dtype=float)
            start = x if opening else np.concatenate([[0.0], x])
            s = pd.Series(start).ewm(alpha=alpha, adjust=False).mean().to_numpy()
            pdf["s_" + c] = s if opening else s[1:]
        pdf["_decay"] = keep ** np.arange(1, len(pdf) + 1)
        return pdf[[*head, *smoothed, "_decay"]]

    def across_blocks(pdf):
        pdf = pdf.sort_values(B.BLOCK)
        decay = pdf["_decay"].to_numpy()
        for c in smoothed:
            value, carry, carries = pdf[c].to_numpy(), 0.0, []
            for i in range(len(pdf)):
                carries.append(carry)
                carry = value[i] + decay[i] * carry
            pdf["_in_" + c] = carries
        return pdf[[key, B.BLOCK, *["_in_" + c for c in smoothed]]]

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in head)
    doubles = ", ".join(c + " double" for c in smoothed)
    if not split:
        def whole(pdf, begins):
            made = pdf[columns].fillna(0.0).astype(float).groupby(pdf["_group"].to_numpy()).ewm(alpha=alpha, adjust=False).mean()
            return pdf[["_group", "seq"]].assign(**{"s_" + c: made[c].to_numpy() for c in columns})

        result = B.in_whole_groups(rows, [key], ["seq", *columns], whole, f"seq {rows.schema['seq'].dataType.simpleString()}, {doubles}")
        return df.join(result, [key, "seq"]).select(*df.columns, *smoothed)
    local = rows.groupBy(key, B.BLOCK).applyInPandas(within_block, f"{types}, {doubles}, _decay double")
    ends = local.groupBy(key, B.BLOCK).agg(
        *[F.max_by(c, "seq").alias(c) for c in smoothed], F.min("_decay").alias("_decay")
    )
    key_type = rows.schema[key].dataType.simpleString()
    carried = ends.groupBy(key).applyInPandas(
        across_blocks, f"{key} {key_type}, {B.BLOCK} bigint, " + ", ".join(f"_in_{c} double" for c in smoothed)
    )
    value = [(F.col(c) + F.col("_decay") * F.col("_in_" + c)).alias(c) for c in smoothed]
    result = local.join(carried, [key, B.BLOCK]).select(key, "seq", *value)
    return df.join(result, [key, "seq"]).select(*df.columns, *smoothed)


def apply_tie_in(
    measured: DataFrame, tie_in: DataFrame, key: str = "bore_id", keep_when_nothing_below: bool = False
) -> DataFrame:
    """Start each path at its tie-in station.

    Rows above the tie-in depth go; the row at that depth is replaced by the tie-in station, or the station is put in
    front.  Wells without tie-in are unchanged.  A path with nothing at or below the tie-in becomes empty, a survey
    run keeps its rows (``keep_when_nothing_below``).  ``tie_in`` has one row per well: key, md, inc, az, north,
    east, tvd.
    """
    block = B.block_column(measured)
    columns = [key, "seq", *block, "md", "inc", "az", "north", "east", "tvd"]
    at = tie_in.select(key, F.col("md").alias("_tie_md"))
    # the new first row goes to the first block of its well
    top = [F.min(c).alias(c) for c in block]
    deepest = measured.groupBy(key).agg(F.max("md").alias("_deep"), *top)
    reach = at.join(deepest, key).withColumn("_has", F.col("_deep") >= F.col("_tie_md") - DEPTH_TOLERANCE)
    df = measured.select(*columns).join(reach.select(key, "_tie_md", "_has"), key, "left")
    below = F.col("md") > F.col("_tie_md") + DEPTH_TOLERANCE
    keep = F.col("_tie_md").isNull() | (F.col("_has") & below)
    if keep_when_nothing_below:
        keep = keep | ~F.col("_has")
    rest = df.filter(keep).withColumn("seq", F.when(F.col("_has"), F.col("seq") + 1).otherwise(F.col("seq")))
    rest = rest.select(*columns)
    start = tie_in.join(reach.filter("_has").select(key, *block), key).withColumn("seq", F.lit(0).cast("bigint"))
    return B.stack([key], rest, start.select(*columns))


def tie_in_relabel(bores: DataFrame, measured: DataFrame) -> DataFrame:
    """Tie-in depth of each sidetrack: its first measured depth where that is less than the stored tie-in depth."""
    first = measured.groupBy("bore_id").agg(F.min("md").alias("first_md"))
    above = F.col("first_md") < F.col("tie_in_md") - DEPTH_TOLERANCE
    return (
        bores.filter("is_sidetrack")
        .join(first, "bore_id", "left")
        .withColumn("tie_in_md", F.when(above, F.col("first_md")).otherwise(F.col("tie_in_md")))
        .select("bore_id", "parent_bore_id", "first_md", "tie_in_md")
    )


def validate_measurements(measured: DataFrame, key: str = "bore_id") -> DataFrame:
    """One row per well: is every value defined, is depth strictly increasing, and why not."""
    defined = G.is_defined("md") & G.is_defined("inc") & G.is_defined("az")
    df = B.with_previous(measured, [key], ["seq"], ["md"])
    rising = F.col("prev_md").isNull() | (F.col("md") > F.col("prev_md") + DEPTH_TOLERANCE)
    checked = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_and(F.coalesce(defined, F.lit(False))), F.lit(True)).alias("all_defined"),
        F.coalesce(F.bool_and(F.coalesce(rising, F.lit(False))), F.lit(True)).alias("increasing"),
    )
    reason = (
        F.when(~F.col("all_defined"), F.lit("undefined value"))
        .when(~F.col("increasing"), F.lit("depth not increasing"))
        .otherwise(F.lit(None).cast("string"))
    )
    return checked.withColumn("reason", reason)


def validate_run_metadata(runs: DataFrame) -> DataFrame:
    """Add ``reason``: which of run, wellbore and instrument id is missing (null when the row is good)."""
    empty = "00000000-0000-0000-0000-000000000000"

    def missing(c):
        return F.col(c).isNull() | (F.col(c).cast("string") == "") | (F.col(c).cast("string") == empty)

    reason = (
        F.when(missing("run_id"), F.lit("missing run id"))
        .when(missing("bore_id"), F.lit("missing wellbore id"))
        .when(missing("instrument_id"), F.lit("missing instrument id"))
    )
    return runs.withColumn("reason", reason)


def materialize_sections(sections: DataFrame, run_stations: DataFrame) -> DataFrame:
    """Stations of a path assembled from survey runs.

    Run ``i`` contributes its stations from its start depth up to the next start (the last one is open ended), on the
    same wellbore only.  A station repeating the previous depth at a seam is dropped.
    ``sections``: traj_id, idx, run_id, bore_id, start_md.  ``run_stations``: run_id, bore_id, seq, md, inc, az.
    """
    bounded = B.with_next(sections, ["traj_id"], ["idx"], ["start_md"])
    inside = (F.col("md") >= F.col("start_md") - DEPTH_TOLERANCE) & (
        F.col("next_start_md").isNull() | (F.col("md") < F.col("next_start_md") - DEPTH_TOLERANCE)
    )
    picked = run_stations.join(bounded, ["run_id", "bore_id"]).filter(inside)
    if B.is_split(picked):  # sections come before stations in the order, so they also do in the block
        picked = picked.withColumn(B.BLOCK, F.struct("idx", B.BLOCK))
    chained = B.with_previous(picked, ["traj_id"], ["idx", "seq"], ["md"])
    fresh = F.col("prev_md").isNull() | (F.abs(F.col("md") - F.col("prev_md")) > DEPTH_TOLERANCE)
    return chained.filter(fresh).select("traj_id", "bore_id", "run_id", "idx", "seq", "md", "inc", "az")


def validate_sections(sections: DataFrame, materialized: DataFrame | None = None) -> DataFrame:
    """Per path: run ids set, start depths defined and strictly increasing, at least three stations."""
    df = B.with_previous(sections, ["traj_id"], ["idx"], ["start_md"])
    good = (
        F.col("run_id").isNotNull()
        & F.coalesce(G.is_defined("start_md"), F.lit(False))
        & (F.col("prev_start_md").isNull() | (F.col("start_md") > F.col("prev_start_md")))
    )
    out = df.groupBy("traj_id").agg(
        F.count(F.lit(1)).alias("n_sections"), F.bool_and(F.coalesce(good, F.lit(False))).alias("sections_ok")
    )
    if materialized is None:
        return out
    counts = materialized.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n_stations"))
    return out.join(counts, "traj_id", "left").select(
        "traj_id",
        "n_sections",
        F.coalesce("n_stations", F.lit(0)).alias("n_stations"),
        (F.col("sections_ok") & (F.coalesce("n_stations", F.lit(0)) >= 3)).alias("ok"),
    )


def survey_md_range(stations: DataFrame, key: str = "bore_id") -> DataFrame:
    return stations.groupBy(key).agg(F.min("md").alias("start_md"), F.max("md").alias("end_md"))


def md_spacing(stations: DataFrame, key: str = "bore_id") -> DataFrame:
    """Number of stations and the least and greatest depth step per well."""
    df = B.with_previous(stations, [key], ["seq"], ["md"])
    delta = F.col("md") - F.col("prev_md")
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_stations"), F.min(delta).alias("min_spacing"), F.max(delta).alias("max_spacing")
    )


def estimate_md_step(stations: DataFrame, key: str = "bore_id", default: float = 10.0) -> DataFrame:
    """The first positive depth step of each well."""
    df = B.with_previous(stations, [key], ["seq"], ["md"])
    delta = F.col("md") - F.col("prev_md")
    first = F.min_by(F.when(delta > 0, delta), F.when(delta > 0, F.col("seq")))
    return df.groupBy(key).agg(F.coalesce(first, F.lit(default)).alias("md_step"))


def usable_stations(stations: DataFrame) -> DataFrame:
    """Stations with finite depth and position."""
    test = F.lit(True)
    for c in ("md", "north", "east", "tvd"):
        test = test & F.coalesce(G.is_defined(c), F.lit(False))
    return stations.filter(test)


def usable_source_points(stations: DataFrame) -> DataFrame:
    """Usable stations that also have both angles."""
    angles = G.is_defined("inc") & G.is_defined("az")
    return usable_stations(stations).filter(F.coalesce(angles, F.lit(False)))


def segments(stations: DataFrame, key: str = "bore_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of consecutive stations with growing depth: columns a_*, b_* and the bounding box n/e/t_lo/hi."""
    fields = ["md", "inc", "az", "north", "east", "tvd", *extra]
    block = [B.BLOCK] if B.is_split(stations) else []
    df = B.with_next(stations.select(key, "seq", *block, *fields), [key], ["seq"], fields)
    df = df.filter(F.col("next_md") > F.col("md"))
    boxes = []
    for axis, short in (("north", "n"), ("east", "e"), ("tvd", "t")):
        boxes.append(F.least(F.col(axis), F.col("next_" + axis)).alias(short + "_lo"))
        boxes.append(F.greatest(F.col(axis), F.col("next_" + axis)).alias(short + "_hi"))
    return df.select(
        key,
        "seq",
        *[F.col(c).alias("a_" + c) for c in fields],
        *[F.col("next_" + c).alias("b_" + c) for c in fields],
        *boxes,
    )
