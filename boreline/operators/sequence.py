"""Operators that walk each path in order: coarsening, section fitting, realizations.

The walk of one path is sequential by definition, but many paths walk in step in one call.  A path is
bounded: a source with a path of more than ``blocks.ROWS_PER_BLOCK`` stations marks its rows with ``_block``, and
``walk`` then hands one block at a time, with the open end of the block before, to the same function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boreline.functions import blocks as B
from boreline.operators import survey
from boreline.operators.fitting import SECTIONS_SCHEMA, fit_sections

STATION = ["md", "inc", "az", "north", "east", "tvd"]

# Fixed default values of the aggregation and realization cases.
SECTION_STEP = 10.0
COARSENING = 0.1
MAXIMUM_REALIZATIONS = 1000
MAXIMUM_ATTEMPTS = 5
REALIZATIONS_PER_TASK = 25
#: Stations whose realizations are drawn at a time.
PATHS_AT_ONCE = 1 << 9
#: A case of up to so many points is drawn as a whole, a larger one in groups of REALIZATIONS_PER_TASK.
POINTS_TOGETHER = 1 << 17


def walk(df: DataFrame, keys: list[str], kind: str, columns: list[str]) -> DataFrame:
    """Rows kept by a greedy walk along each path, by the arcs of ``kind`` and the path's own ``tolerance`` (a column).

    Whole paths walk many at a time.  Of a split table ``step(pdf, at_end)`` gets rows in order, the first of them a kept
    one, and returns the positions it keeps and the position from which the walk is still open.  Rows from there on come
    again in front of the next block.
    """
    columns = [*columns, "tolerance"]
    rows = df.select(*keys, "seq", *([B.BLOCK] if B.is_split(df) else []), *columns)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def whole(pdf, begins):
        from boreline.functions import envelope

        tolerance = pdf["tolerance"].to_numpy(dtype=float)[begins[:-1]]
        kept = envelope.kept_in_step(getattr(envelope, kind), [pdf[c].to_numpy(dtype=float) for c in STATION], begins, tolerance)
        return pdf[kept]

    if not B.is_split(df):
        plain = ", ".join(f"{c} {types[c]}" for c in ["seq", *columns])
        return B.in_whole_groups(rows, keys, ["seq", *columns], whole, plain).drop("tolerance")

    step = _greedy(kind)
    last = rows.groupBy(*keys).agg(F.max(B.BLOCK).alias("_end"))
    count = last.agg(F.max("_end")).first()[0]
    rows = B.durable(rows.join(last, keys))
    names = [*keys, "seq", *columns, "_end"]

    def part(number: int):
        def run(pdf):
            import pandas as pd

            pdf = pdf.sort_values("seq").reset_index(drop=True)
            at_end = bool(pdf["_end"].iat[0] <= number)
            if not len(pdf):
                return pd.DataFrame(columns=[*names, "_open"])
            kept, open_at = step(pdf, at_end)
            # the first row was already given out by the block before
            out = pdf.iloc[[k for k in kept if k > 0 or not pdf["_again"].iat[0]]].assign(_open=False)
            rest = pdf.iloc[open_at:].assign(_open=True) if not at_end else pdf.iloc[:0].assign(_open=True)
            return pd.concat([out, rest])[[*names, "_open"]]

        return run

    schema = ", ".join(f"{c} {types.get(c, 'bigint')}" for c in names) + ", _open boolean"
    done = carry = None
    for number in range(count + 1):
        now = rows.filter(F.col(B.BLOCK) == number).select(*names, F.lit(False).alias("_again"))
        if carry is not None:
            now = now.unionByName(carry.select(*names, F.lit(True).alias("_again")))
        out = B.durable(B.spread(now, keys).groupBy(*keys).applyInPandas(part(number), schema))
        carry = out.filter("_open")
        kept = out.filter("NOT _open").select(*keys, "seq", *columns)
        done = kept if done is None else done.unionByName(kept)
    return done.drop("tolerance")


def _greedy(kind: str):
    """Walk that keeps, from each kept row, the farthest end reached before the first end that fails."""

    def step(pdf, at_end):
        from boreline.functions import envelope

        tolerance = float(pdf["tolerance"].iat[0])
        if not tolerance > 0:
            return list(range(len(pdf))), len(pdf) - 1
        path = getattr(envelope, kind)(*[pdf[c].to_numpy(dtype=float) for c in STATION], tolerance)
        n, start, kept = len(pdf), 0, [0]
        while start < n - 1:
            end, failed = envelope.farthest(path, start, n)
            if not failed and not at_end:
                break  # the next block decides
            kept.append(end)
            start = end
        return kept, start

    return step


def coarsen_minimum_curvature(stations: DataFrame, tolerance: float, key: str = "bore_id") -> DataFrame:
    """Drop stations that the minimum-curvature arc between kept ones passes within ``tolerance``.

    A tolerance of zero or less keeps every station.
    """
    if not tolerance > 0:
        return stations.select(key, "seq", *STATION)
    return walk(stations.withColumn("tolerance", F.lit(float(tolerance))), [key], "ByDepth", STATION)


def coarsen_circular(stations: DataFrame, tolerance: float, key: str = "bore_id") -> DataFrame:
    """The same with the circular arc that leaves the start along its direction and passes through the end point."""
    if not tolerance > 0:
        return stations.select(key, "seq", *STATION)
    return walk(stations.withColumn("tolerance", F.lit(float(tolerance))), [key], "ByPlace", STATION)


# --- sections ----------------------------------------------------------------------------------------------------


def section_chain(sections: DataFrame, key: str = "bore_id") -> DataFrame:
    """Gap between each section's end pose and the next one's start, per section (zero in a sound chain)."""
    ends = section_points(sections, None, key)
    nxt = sections.select(key, (F.col("section_index") - 1).alias("section_index"),
                          *[F.col(c).alias("n_" + c) for c in ("north", "east", "tvd")])
    joined = ends.join(nxt, [key, "section_index"])
    from boreline.functions import geometry as G

    gap = G.distance3(["north", "east", "tvd"], ["n_north", "n_east", "n_tvd"])
    return joined.select(key, "section_index", gap.alias("gap"))


def section_points(sections: DataFrame, step: float | None = SECTION_STEP, key: str = "bore_id") -> DataFrame:
    """Points every ``step`` metres of each section and at its end (only the ends without a step).

    The start of a later section is the end of the one before and does not come twice.  Sections are independent
    here: each knows its start pose.
    """
    if step:
        inner = F.floor((F.col("end_md") - F.col("start_md")) / step - 1e-9).cast("int")
        marks = F.transform(F.sequence(F.lit(0), inner), lambda k: F.col("start_md") + k * step)
        marks = F.filter(marks, lambda m: ((F.col("section_index") == 0) | (m > F.col("start_md"))) & (
            m < F.col("end_md") - 1e-6))
        marks = F.concat(marks, F.array("end_md"))
    else:
        marks = F.array("end_md")
    cut = sections.withColumn("md", F.explode(marks))
    key_type = sections.schema[key].dataType.simpleString()

    def place(batches):
        import numpy as np

        for pdf in batches:
            curves, s, own = _curves(pdf), (pdf["md"] - pdf["start_md"]).to_numpy(), np.arange(len(pdf))
            at = curves.at(own, s)
            inc, az = curves.direction(own, s)
            yield pdf[[key, "section_index", "md"]].assign(north=at[:, 0], east=at[:, 1], tvd=at[:, 2], inc=inc, az=az)

    return cut.mapInPandas(
        place, f"{key} {key_type}, section_index int, md double, north double, east double, tvd double, inc double, az double"
    )


def _curves(pdf):
    from boreline.functions import arcs

    return arcs.Curves(pdf["type"].to_numpy(), pdf[["north", "east", "tvd"]].to_numpy(), *(pdf[c].to_numpy() for c in ("inc", "az", "first", "second")))


#: Points in a run, and sections or nodes under a node.
RUN, FAN = 256, 16


def _nodes(sections: DataFrame, key: str) -> list[DataFrame]:
    """Balls around sections (level 0) and around ``FAN`` nodes of the level below, until no path has more than ``FAN``.

    node, up (its parent), the ball's centre, a place on the path, and its radius.  A section's ball is around its
    middle.
    """
    key_type = sections.schema[key].dataType.simpleString()

    def balls(batches):
        for pdf in batches:
            at, radius = _curves(pdf).balls(pdf["end_md"] - pdf["start_md"])
            yield pdf[[key]].assign(node=pdf["section_index"], up=pdf["section_index"] // FAN, cn=at[:, 0], ce=at[:, 1], ct=at[:, 2], radius=radius)

    schema = f"{key} {key_type}, node bigint, up bigint, cn double, ce double, ct double, radius double"
    levels = [B.durable(sections.mapInPandas(balls, schema))]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) >= FAN:
        members = F.array_sort(F.collect_list(F.struct("node", "cn", "ce", "ct", "radius")))
        up = levels[-1].groupBy(key, F.col("up").alias("node")).agg(members.alias("m"))
        first = F.element_at("m", 1)
        out = F.array_max(F.transform("m", lambda x: x["radius"] + F.sqrt(sum((x[c] - first[c]) * (x[c] - first[c]) for c in ("cn", "ce", "ct")))))
        levels.append(B.durable(up.select(key, "node", F.floor(F.col("node") / FAN).alias("up"), *[first[c].alias(c) for c in ("cn", "ce", "ct")], out.alias("radius"))))
    return levels


def section_distance(points: DataFrame, sections: DataFrame, key: str = "bore_id") -> DataFrame:
    """Nearest section place of every reference point, by golden-section search on the sections that can hold it.

    Runs of points descend a hierarchy of balls over the sections of their path: a node stays while it may be nearer than
    the nearest one must be.  Of the sections left to its run each point searches the one of the least bound first, and
    others only while their bound is below the distance found.  Of equally near sections the first counts.
    """
    from_columns = [c.split()[0] for c in SECTIONS_SCHEMA.split(", ")]
    sections = B.durable(sections.select(key, *from_columns))
    ref = points.select(key, "seq", F.col("md").alias("ref_md"), *[F.col(c).alias("p" + c[0]) for c in ("north", "east", "tvd")])
    run = ref.groupBy(key, F.floor(F.col("seq") / RUN).alias("run")).agg(
        F.collect_list(F.struct("seq", "ref_md", "pn", "pe", "pt")).alias("points"), *[F.avg("p" + c).alias("r" + c) for c in "net"])
    wide = F.array_max(F.transform("points", lambda x: F.sqrt(sum((x["p" + c] - F.col("r" + c)) * (x["p" + c] - F.col("r" + c)) for c in "net"))))
    run = B.durable(run.withColumn("wide", wide))

    levels = _nodes(sections, key)
    balls = run.select(key, "run", "rn", "re", "rt", "wide")
    near = levels[-1].join(balls, key)
    apart = F.sqrt(sum((F.col("c" + c) - F.col("r" + c)) ** 2 for c in "net"))
    for depth, level in enumerate(reversed(levels)):
        if depth:
            near = near.select(key, "run", "rn", "re", "rt", "wide", F.col("node").alias("up")).join(level, [key, "up"])
        near = near.withColumn("apart", apart)
        # Some place of the run's path is no farther than this from any of its points.
        most = F.min(F.col("apart") + F.col("wide")).over(Window.partitionBy(key, "run"))
        near = near.withColumn("most", most).filter(F.col("apart") - F.col("wide") - F.col("radius") <= F.col("most") + 1e-6)
    near = near.select(key, "run", F.col("node").cast("int").alias("section_index"), "cn", "ce", "ct", "radius")
    member = F.struct(*from_columns, "cn", "ce", "ct", "radius")
    chosen = near.join(sections, [key, "section_index"]).groupBy(key, "run").agg(F.collect_list(member).alias("sections"))
    both = run.select(key, "run", "points").join(chosen, [key, "run"]).select(key, "points", "sections")
    key_type = points.schema[key].dataType.simpleString()
    schema = (
        f"{key} {key_type}, seq bigint, ref_md double, section_index int, type string, md double, north double, "
        "east double, tvd double, distance double, section_u double"
    )

    def nearest(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                yield pa.RecordBatch.from_pandas(_nearest(batch.slice(at, 16), key), preserve_index=False)

    return B.spread(both, [key]).mapInArrow(nearest, schema)


def _nearest(batch, key: str):
    """The nearest section of the points of a few runs, best first."""
    import numpy as np
    import pandas as pd

    def table(column):
        return column.flatten().to_pandas().pipe(lambda s: pd.DataFrame(s.tolist())), np.diff(column.offsets.to_numpy())

    points, n_points = table(batch.column(1))
    sections, n_sections = table(batch.column(2))
    curves, xyz = _curves(sections), points[["pn", "pe", "pt"]].to_numpy(dtype=float)
    length = (sections["end_md"] - sections["start_md"]).to_numpy()
    # Every point with every section of its run.
    row = np.repeat(np.arange(batch.num_rows), n_points)
    many = n_sections[row]
    point = np.repeat(np.arange(len(points)), many)
    first = np.concatenate([[0], np.cumsum(n_sections)[:-1]])
    own = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[row][point]
    bound = np.linalg.norm(sections[["cn", "ce", "ct"]].to_numpy()[own] - xyz[point], axis=1) - sections["radius"].to_numpy()[own]
    index = sections["section_index"].to_numpy()
    order = np.lexsort((index[own], bound, point))
    point, own, bound = point[order], own[order], bound[order]
    turn = np.arange(len(point)) - np.repeat(np.cumsum(many) - many, many)
    best, held = np.full(len(points), np.inf), np.full(len(points), -1)
    s, place = np.zeros(len(points)), np.zeros((len(points), 3))
    for t in range(int(many.max(initial=0))):
        now = np.flatnonzero(turn == t)
        now = now[bound[now] <= best[point[now]] + 1e-9]
        if not len(now):
            break
        q, i = point[now], own[now]
        along, distance, at = curves.closest(i, length[i], xyz[q])
        better = (distance < best[q]) | ((distance == best[q]) & (index[i] < index[held[q]]))
        q, i = q[better], i[better]
        best[q], held[q], s[q], place[q] = distance[better], i, along[better], at[better]
    return pd.DataFrame({
        key: np.asarray(batch.column(0).to_pylist(), dtype=object)[row], "seq": points["seq"], "ref_md": points["ref_md"], "section_index": index[held].astype(np.int32),
        "type": sections["type"].to_numpy()[held], "md": sections["start_md"].to_numpy()[held] + s, "north": place[:, 0], "east": place[:, 1],
        "tvd": place[:, 2], "distance": best, "section_u": s / length[held],
    }).infer_objects()


def aggregation_case(
    cases: DataFrame, stations: DataFrame, threshold: float = COARSENING, step: float = SECTION_STEP
) -> DataFrame:
    """Status and summary of the section fit of every path of every case.

    ``cases``: case_id, bore_id.  A path without two usable stations fails on its own; the others go on.
    """
    wanted = stations.join(cases.select("bore_id").distinct(), "bore_id", "left_semi")
    sections = B.durable(fit_sections(wanted))
    coarse = coarsen_circular(survey.usable_source_points(wanted), threshold)
    far = section_distance(coarse, sections).groupBy("bore_id").agg(
        F.count(F.lit(1)).alias("n_reference"), F.max("distance").alias("worst_distance"), F.avg("distance").alias("mean_distance")
    )
    made = sections.groupBy("bore_id").agg(F.count(F.lit(1)).alias("n_sections"))
    points = section_points(sections, step).groupBy("bore_id").agg(F.count(F.lit(1)).alias("n_points"))
    usable = survey.usable_source_points(wanted).groupBy("bore_id").agg(F.count(F.lit(1)).alias("n_usable"))
    df = cases.join(usable, "bore_id", "left").join(made, "bore_id", "left").join(points, "bore_id", "left").join(far, "bore_id", "left")
    ok = F.coalesce("n_usable", F.lit(0)) >= 2
    return df.withColumn("ok", ok & F.col("n_sections").isNotNull()).select(
        "case_id", "bore_id", "ok", "n_sections", "n_points", "n_reference", "worst_distance", "mean_distance"
    )


# --- realizations ------------------------------------------------------------------------------------------------

# Fixed order of the sign variants of the offset along the three principal axes.
SIGNS = ((1, 1, 1), (-1, 1, 1), (1, -1, 1), (1, 1, -1), (-1, -1, 1), (-1, 1, -1), (1, -1, -1), (-1, -1, -1))
COVARIANCE = ("c00", "c01", "c02", "c11", "c12", "c22")
BIAS = ("bias_n", "bias_e", "bias_t")


def validate_realization_inputs(cases: DataFrame, stations: DataFrame) -> DataFrame:
    """Add ``reason`` to cases that cannot be realized: their count, their stations or an indefinite covariance."""
    from boreline.functions import geometry as G

    defined = G.is_defined("md") & G.is_defined("inc") & G.is_defined("az")
    for c in ("north", "east", "tvd", *COVARIANCE):
        defined = defined & F.coalesce(G.is_defined(c), F.lit(False))
    c00, c01, c02, c11, c12, c22 = (F.col(c) for c in COVARIANCE)
    # a symmetric matrix has no negative eigenvalue when all principal minors are non-negative
    slack = -1e-9 * (1.0 + F.abs(c00) + F.abs(c11) + F.abs(c22))
    det = c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c12 * c02) + c02 * (c01 * c12 - c11 * c02)
    definite = (
        (c00 >= slack) & (c11 >= slack) & (c22 >= slack) & (c00 * c11 - c01 * c01 >= slack)
        & (c00 * c22 - c02 * c02 >= slack) & (c11 * c22 - c12 * c12 >= slack) & (det >= slack)
    )
    wells = stations.groupBy("bore_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and(F.coalesce(defined, F.lit(False))).alias("_defined"),
        F.bool_and(F.coalesce(definite, F.lit(True))).alias("_definite"),
    )
    df = cases.join(wells, "bore_id", "left")
    count_ok = (F.col("realizations") >= 1) & (F.col("realizations") <= MAXIMUM_REALIZATIONS)
    reason = (
        F.when(~F.coalesce(count_ok, F.lit(False)), F.lit("realization count must be between 1 and 1000"))
        .when(F.coalesce("_n", F.lit(0)) < 2, F.lit("fewer than two stations"))
        .when(~F.col("_defined"), F.lit("undefined position, angle or covariance"))
        .when(~F.col("_definite"), F.lit("covariance with a negative eigenvalue"))
    )
    return df.withColumn("reason", reason).select(*cases.columns, "reason")


def realize(cases: DataFrame, stations: DataFrame) -> DataFrame:
    """Monte-Carlo paths drawn from the position covariance.

    ``cases``: case_id, bore_id, realizations, coarsening, seed.  ``stations`` carry covariance, and may carry a bias
    (bias_n, bias_e, bias_t, null as zero), which moves the middle that a station's points are drawn around.  One draw of three
    normal numbers moves a whole path along the principal axes of each station's covariance, in eight sign variants;
    from the selected point before, the variant whose arc arrives closest to the reference direction is taken.  The
    positions are then recomputed by minimum curvature.  Returns case_id, realization, seq, md, inc, az, north, east,
    tvd, status, reason; a case with a path that fails five attempts has status ``failed`` and no points, a case that
    cannot be realized has status ``refused`` and the reason.  A first station without covariance has none to draw: it
    stays in place.

    Draws are keyed by (seed, realization, attempt), so they do not depend on the partitioning.
    """
    start = stations.groupBy("bore_id").agg(F.min("seq").alias("_start"))
    fixed = (F.col("seq") == F.col("_start")) & F.coalesce(*COVARIANCE).isNull()
    stations = stations.join(start, "bore_id").withColumns({c: F.when(fixed, 0.0).otherwise(F.col(c)) for c in COVARIANCE}).drop("_start")
    stations = stations.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in stations.columns else F.lit(0.0) for c in BIAS})
    checked = B.durable(validate_realization_inputs(cases, stations))
    good = checked.filter("reason IS NULL").drop("reason")
    levels = good.select("bore_id", "coarsening").distinct()
    columns = [*STATION, *COVARIANCE, *BIAS]
    keyed = stations.join(levels, "bore_id").select(
        F.struct("bore_id", "coarsening").alias("path"), "seq", *([B.BLOCK] if B.is_split(stations) else []), *columns
    )
    coarse = _coarsen_each(keyed, columns)
    size = stations.groupBy("bore_id").agg(F.count(F.lit(1)).alias("_n"))
    whole = F.col("realizations") * F.col("_n") <= POINTS_TOGETHER
    good = good.join(size, "bore_id").withColumn("together", F.when(whole, F.col("realizations")).otherwise(F.lit(REALIZATIONS_PER_TASK)).cast("int"))
    jobs = good.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("realizations") - 1, F.col("together")))).withColumn(
        "path", F.struct("bore_id", "coarsening"))
    large = jobs.filter("together < realizations")
    failed = None
    if not large.isEmpty():
        # a case in several groups is known to fail before any of its points are made, so none of them has to be kept
        failed = B.durable(_drawn(large, coarse, columns, _failing_groups).filter("NOT ok").select("case_id").distinct())
        jobs = jobs.join(failed, "case_id", "left_anti")
    drawn = _drawn(jobs, coarse, columns, _realize_groups)
    fields = ["realization", "seq", "md", "inc", "az", "north", "east", "tvd"]
    why = F.lit("no path in five attempts")
    out = drawn.select(
        "case_id", *[F.when(F.col("ok"), F.col(c)).alias(c) for c in fields], F.when(F.col("ok"), F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        F.when(~F.col("ok"), why).alias("reason"))
    bad = checked.filter("reason IS NOT NULL").select("case_id", F.lit("refused").alias("status"), "reason")
    if failed is not None:
        bad = bad.unionByName(failed.select("case_id", F.lit("failed").alias("status"), why.alias("reason")))
    bad = bad.withColumns({c: F.lit(None).cast(out.schema[c].dataType) for c in fields})
    return out.unionByName(bad.select(*out.columns))


def _drawn(jobs: DataFrame, coarse: DataFrame, columns: list[str], work) -> DataFrame:
    """What ``work`` makes of each job (a case and its realizations from ``first`` on) and the stations of its path."""
    rows = jobs.select("case_id", F.col("first").alias("_first"), "path", "first", "realizations", "together", "seed").join(coarse, "path")
    schema = (
        "realization int, seq bigint, md double, inc double, az double, north double, east double, tvd double, ok boolean"
    )
    asked = ["first", "realizations", "together", "seed"]
    return B.in_whole_groups(rows, ["case_id", "_first"], ["seq", *asked, *columns], work, schema, PATHS_AT_ONCE).drop("_first")


def _coarsen_each(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """Coarsen every (bore, tolerance) path; sequence numbers become dense."""
    kept = walk(keyed.withColumn("tolerance", F.col("path.coarsening")), ["path"], "ByDepth", columns)
    return B.with_position(kept, ["path"], ["md"], "seq")


def _draw(rows, begins):
    """Realizations of many groups (a case and its next realizations): each one's group and number, points, and success."""
    import numpy as np

    lead, sizes = rows.iloc[begins[:-1]], np.diff(begins)
    first, total, together = (lead[c].to_numpy() for c in ("first", "realizations", "together"))
    many = np.minimum(total - first, together)
    group = np.repeat(np.arange(len(sizes)), many)
    number = np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many) + first[group]
    seed = lead["seed"].to_numpy()[group]
    stations = _Stations(rows)
    found = np.full((len(group), int(sizes.max(initial=0)), 6), np.nan)
    todo = np.arange(len(group))
    for attempt in range(MAXIMUM_ATTEMPTS):
        if not len(todo):
            break
        draws = np.stack([
            np.random.Generator(np.random.Philox(key=[int(k) % 2**64, int(r) * 8 + attempt])).standard_normal(3)
            for k, r in zip(seed[todo], number[todo], strict=True)
        ])
        found[todo], alive = _paths(stations, begins[group[todo]], sizes[group[todo]], draws, found.shape[1])
        todo = todo[~alive]
    ok = np.ones(len(group), bool)
    ok[todo] = False
    return group, number, found, ok


def _failures(group, ok, count: int):
    """One row ``not ok`` for each of ``count`` groups with a path that was not found."""
    import numpy as np
    import pandas as pd

    failed = np.flatnonzero(np.bincount(group[~ok], minlength=count))
    blank = {c: np.full(len(failed), np.nan) for c in STATION}
    return pd.DataFrame({"_group": failed, "realization": 0, "seq": 0, **blank, "ok": False})


def _failing_groups(rows, begins):
    """The groups that fail, without any points."""
    group, _, _, ok = _draw(rows, begins)
    return _failures(group, ok, len(begins) - 1)


def _realize_groups(rows, begins):
    """Realizations of many groups at a time; a group with a path that was not found is one row, not ``ok``."""
    import numpy as np
    import pandas as pd

    from boreline.functions import arcs

    group, number, found, ok = _draw(rows, begins)
    bad = _failures(group, ok, len(begins) - 1)
    kept = np.flatnonzero(~np.isin(group, bad["_group"].to_numpy()))
    if not len(kept):
        return bad
    sizes = np.diff(begins)[group[kept]]
    path = np.repeat(kept, sizes)
    place = np.arange(len(path)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = found[path, place]
    values[:, 3:] = arcs.completed(*values[:, :3].T, values[place == 0, 3:], place == 0)
    seq = rows["seq"].to_numpy()[begins[group[path]] + place]
    out = pd.DataFrame({"_group": group[path], "realization": number[path], "seq": seq, **{c: values[:, i] for i, c in enumerate(STATION)}, "ok": True})
    return pd.concat([out, bad], ignore_index=True) if len(bad) else out


class _Stations:
    """Angles, middles and principal axes of stations, one after the other."""

    def __init__(self, rows):
        from boreline.functions import arcs

        self.md, self.inc, self.az = (rows[c].to_numpy(dtype=float) for c in ("md", "inc", "az"))
        self.centre = rows[["north", "east", "tvd"]].to_numpy(dtype=float) + rows[list(BIAS)].to_numpy(dtype=float)
        self.values, self.vectors = principal_axes(rows)
        self.reference = arcs.tangent(self.inc, self.az)


def principal_axes(pdf):
    """Eigenvalues and eigenvectors of each covariance; the largest component of every vector is positive."""
    import numpy as np

    c = pdf[list(COVARIANCE)].to_numpy(dtype=float)
    m = c[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
    values, vectors = np.linalg.eigh(m)
    big = np.abs(vectors).argmax(axis=1)
    sign = np.sign(np.take_along_axis(vectors, big[:, None, :], axis=1))
    return np.maximum(values, 0.0), vectors * np.where(sign == 0, 1.0, sign)


def _paths(stations, begin, size, draws, width: int):
    """One path (md, inc, az, north, east, tvd per station) per draw, and whether its stations were all reached.

    Path m runs over ``size[m]`` stations from ``begin[m]`` on; all of them go on by one station at a time.
    """
    import numpy as np

    from boreline.functions import arcs

    order = np.argsort(-size, kind="stable")
    begin, size, draws = begin[order], size[order], draws[order]
    m = len(draws)
    signs = np.array(SIGNS, dtype=float)
    out = np.full((m, width, 6), np.nan)
    offset = np.sqrt(stations.values[begin]) * draws
    p = stations.centre[begin] + np.einsum("mj,mij->mi", offset, stations.vectors[begin])
    t = arcs.tangent(stations.inc[begin], stations.az[begin])
    depth = stations.md[begin].copy()
    out[:, 0] = np.column_stack([depth, stations.inc[begin], stations.az[begin], p])
    alive = np.ones(m, dtype=bool)
    for i in range(1, int(size.max(initial=0))):
        m = int(np.searchsorted(-size, -i, side="left"))  # longer paths come first
        at, p, t, depth = begin[:m] + i, p[:m], t[:m], depth[:m]
        local = np.sqrt(stations.values[at]) * draws[:m]
        targets = stations.centre[at][:, None, :] + np.einsum("vj,mj,mij->mvi", signs, local, stations.vectors[at])
        end, length = arcs.arc_to_point(p[:, None, :], t[:, None, :], targets)
        i2, a2 = arcs.angles(end)
        good = np.isfinite(length) & _round_trips(p[:, None, :], t[:, None, :], i2, a2, length, targets)
        score = 1.0 - np.clip(np.einsum("mvk,mk->mv", end, stations.reference[at]), -1.0, 1.0)
        bend = 2.0 * np.arcsin(np.minimum(1.0, 0.5 * np.linalg.norm(end - t[:, None, :], axis=2)))
        i1, a1 = arcs.angles(t)
        with np.errstate(divide="ignore", invalid="ignore"):
            rough = (
                bend + np.abs(i2 - i1[:, None]) + np.abs(arcs.wrap_signed(a2 - a1[:, None]))
            ) / length + 1e-9 * np.linalg.norm(targets - p[:, None, :], axis=2)
        score = np.where(good, score, np.inf)
        # scores equal to a millionth are ties, decided by roughness
        tie = score <= score.min(axis=1, keepdims=True) + 1e-6
        pick = np.where(tie & good, rough, np.inf).argmin(axis=1)
        alive[:m] &= good.any(axis=1)
        row = np.arange(m)
        p, t = targets[row, pick], end[row, pick]
        depth = depth + np.where(np.isfinite(length[row, pick]), length[row, pick], 0.0)
        out[:m, i] = np.column_stack([depth, i2[row, pick], a2[row, pick], p])
    back = np.argsort(order)
    return out[back], alive[back]


def _round_trips(p, t, i2, a2, length, target):
    """Whether minimum curvature from the angles leads back to the target."""
    import numpy as np

    from boreline.functions import arcs

    t2 = arcs.tangent(i2, a2)
    dl = 2.0 * np.arcsin(np.minimum(1.0, 0.5 * np.linalg.norm(t2 - t, axis=-1)))
    with np.errstate(invalid="ignore"):
        back = p + 0.5 * (length * arcs.half_angle_factor(dl))[..., None] * (t + t2)
        error = np.linalg.norm(back - target, axis=-1)
    chord = np.linalg.norm(target - p, axis=-1)
    return error <= np.maximum(1e-4, 1e-8 * np.maximum(1.0, chord))
