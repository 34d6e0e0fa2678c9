"""Sections of constant parameters fitted to paths, whole or block by block.

Six smoothed series of a path (curvature, build and turn rate, centre of curvature) are each cut into periods of almost
constant value; a curve type is chosen for every step, so that sections change as seldom as possible; steps of one type
and the same values become a section.  Every part composes over blocks, so a path of any length is fitted with no group
of more than a block, and its sections do not depend on the blocks:

* ``Moments`` finds the last end of a period from any start.  A block knows the moments of the later blocks, and asks
  those of them in which a period may end.
* Periods follow each other from the first step on.  Each block tells where the walk leaves it from every step, pointer
  doubling over these jumps finds where the walk enters each block, and every block lists the periods that start in it.
* The search for types is a shortest path over three states.  Costs differ by one at most, so a block is a map over the
  seven vectors of relative costs, and one row per block and vector is enough to compose them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boreline.functions import arcs
from boreline.functions import blocks as B
from boreline.functions.moments import Moments
from boreline.operators import survey

EPSILON_LENGTH = 250.0
EPSILON_CURVATURE = 0.00037815466446505184  # 0.65 degrees per 30 m
ALPHA = 0.9

SERIES = ("dls", "bur", "tr", "x", "y", "z")
#: The series whose labels must stay for each curve type to go on without a new section.
TYPES = (("CircularArc", ("dls", "x", "y", "z")), ("ConstantBuildAndTurn", ("bur", "tr")), ("ConstantCurvatureAndToolface", ("dls", "bur")))

SECTIONS_SCHEMA = (
    "section_index int, type string, start_md double, end_md double, first double, second double, "
    "inc double, az double, north double, east double, tvd double"
)


# --- kernels -------------------------------------------------------------------------------------------------------


def bounds(eps_length: float, eps_curvature: float) -> np.ndarray:
    spread = np.array([eps_curvature] * 3 + [eps_length] * 3)
    return np.where(spread < 0, 0.0, spread * spread)


def series_of_steps(md, inc, az, md1, inc1, az1):
    """Curvature, rates, displacement and offset of the centre from the middle (nan where straight) of each step."""
    ds = md1 - md
    t0, t1 = arcs.tangent(inc, az), arcs.tangent(inc1, az1)
    turn = t1 - t0
    size = np.linalg.norm(turn, axis=1)
    bend = 2.0 * np.arcsin(np.minimum(1.0, 0.5 * size))
    step = 0.5 * (ds * arcs.half_angle_factor(bend))[:, None] * (t0 + t1)
    with np.errstate(divide="ignore", invalid="ignore"):
        dls = bend / ds
        bent = (size > 1e-12) & (dls > 1e-12)
        offset = np.where(bent[:, None], turn / size[:, None] / dls[:, None], np.nan)
        return dls, (inc1 - inc) / ds, arcs.wrap_signed(az1 - az) / ds, step, offset


def walk_periods(following, mean, start: int, stop: int, shared: bool = False):
    """Periods (start, end, mean, shared) of the walk from ``start``, and where it leaves the places before ``stop``.

    ``following[i]`` is the end of the period from place i, or -1.  A period is ``shared`` if the one before ends where
    it starts.  A start without period moves on by one.
    """
    periods = []
    while start < stop:
        end = following[start]
        if end < 0:
            start, shared = start + 1, False
        else:
            periods.append((start, end, mean[start], shared))
            start, shared = end, True
    return periods, start, shared


def _periods_of_values(values, spread: float):
    x = np.asarray(values, dtype=float)[None, :]
    n = x.shape[1]
    if n < 2 or spread < 0:
        return []
    tree = Moments(np.ones_like(x), x, np.zeros_like(x))
    ends, means, _ = tree.last_ends(np.array([spread * spread]), np.zeros(n, np.int64), np.arange(n))
    return walk_periods(ends.tolist(), means.tolist(), 0, n - 1)[0]


def last_ends_of_many(values, begins, bound: np.ndarray):
    """Per place the last end of a period, or -1, and its mean, for many paths one after the other.

    ``values`` has a row for each series, ``bound`` the variance that its periods stay below.  Path i has the places
    from ``begins[i]`` on; ends are counted from there.  Paths of about one length are searched in one index.
    """
    sizes = np.diff(begins)
    ends, means = np.full(values.shape, -1, np.int64), np.full(values.shape, np.nan)
    bits = np.frompyfunc(int.bit_length, 1, 1)(np.maximum(sizes - 1, 0)).astype(int)
    for level in np.unique(bits[sizes > 1]):
        paths = np.flatnonzero((bits == level) & (sizes > 1))
        size, width = sizes[paths], int(sizes[paths].max())
        path = np.repeat(np.arange(len(paths)), size)
        place = np.arange(len(path)) - np.repeat(np.cumsum(size) - size, size)
        at = begins[paths][path] + place
        shape = (len(values) * len(paths), width)
        count, x = np.zeros(shape), np.zeros(shape)
        series = (np.arange(len(values))[:, None] * len(paths) + path).ravel()
        start = np.tile(place, len(values))
        count[series, start], x[series, start] = 1.0, values[:, at].ravel()
        # what a path is filled up with counts nothing, so an end beyond the path's own is its last
        end, mean, _ = Moments(count, x, np.zeros(shape)).last_ends(np.repeat(bound, len(paths)), series, start)
        last = np.tile(size[path] - 1, len(values))
        ends[:, at] = np.minimum(end, last).reshape(len(values), -1)
        means[:, at] = mean.reshape(len(values), -1)
    return ends, means


def constant_periods(values, spread: float):
    """Periods (start, end, mean) of almost constant value: from each start the longest one with a variance below
    ``spread`` squared.  The next period starts at the last index of the one before."""
    return [p[:3] for p in _periods_of_values(values, spread)]


def equivalence_labels(periods, n: int):
    """One label per index; an index shared by two periods belongs to the earlier one."""
    labels = np.full(n, -1, dtype=np.int64)
    at = 0
    label = 0
    for start, end, _ in periods:
        while at < start:
            labels[at] = label
            label, at = label + 1, at + 1
        if at <= end:
            labels[at : end + 1] = label
            label, at = label + 1, end + 1
    while at < n:
        labels[at] = label
        label, at = label + 1, at + 1
    return labels


def mark_periods(periods, low: int, n: int):
    """For the ``n`` places from ``low`` on: whether the label changes there, and the mean, nan outside of periods.

    An index shared by two periods has the label of the earlier and the mean of the later one.
    """
    changed, means = np.ones(n, bool), np.full(n, np.nan)
    for start, end, mean, shared in periods:
        changed[max(0, start + shared + 1 - low) : max(0, end + 1 - low)] = False
        means[max(0, start - low) : max(0, end + 1 - low)] = mean
    if low == 0 and n:
        changed[0] = False
    return changed, means


def flags_of(changed: dict) -> np.ndarray:
    """Three bits per place: where going on with a type costs a new section."""
    out = np.zeros(len(changed["dls"]), np.int64)
    for bit, (_, names) in enumerate(TYPES):
        out |= np.any([changed[name] for name in names], axis=0).astype(np.int64) << bit
    return out


#: Costs of the three types over the least of them; no two differ by more than the price of a switch.
STATES = [c for c in itertools.product((0, 1), repeat=3) if min(c) == 0]
OPENING = STATES.index((0, 0, 0))


def _step(cost, flags: int):
    """The next costs, and for each type the one it is best reached from: least cost, then least cost so far, then the
    lower type."""
    found = [min((cost[u] + ((flags >> v & 1) if u == v else 1), cost[u], u) for u in range(3)) for v in range(3)]
    least = min(f[0] for f in found)
    return STATES.index(tuple(f[0] - least for f in found)), tuple(f[2] for f in found)


STEPS = [[_step(cost, flags) for flags in range(8)] for cost in STATES]
#: Maps from a type to an earlier one, and what two of them give one after the other.
MAPS = list(itertools.product(range(3), repeat=3))
AFTER = [[MAPS.index(tuple(earlier[later[v]] for v in range(3))) for later in MAPS] for earlier in MAPS]
_MAP_STEPS = [[(state, MAPS.index(back)) for state, back in row] for row in STEPS]
SAME = MAPS.index((0, 1, 2))


def cross_block(flags: list, state: int, opening: bool):
    """Through a block from the costs before it: the costs behind it, the type at its first place by the one at its
    last, and the type before it by the one at its first place."""
    enter = SAME
    if not opening:
        state, enter = _MAP_STEPS[state][flags[0]]
    inner = SAME
    for flag in flags[1:]:
        state, back = _MAP_STEPS[state][flag]
        inner = AFTER[inner][back]
    return state, inner, enter


def best_type(state: int) -> int:
    return STATES[state].index(0)


def types_in_block(flags: list, state: int, opening: bool, last: int) -> list:
    """The type at each place, given the costs before the block and the type at its last place."""
    backs = []
    if not opening:
        state = STEPS[state][flags[0]][0]
    for flag in flags[1:]:
        state, back = STEPS[state][flag]
        backs.append(back)
    types = [last]
    for back in reversed(backs):
        types.append(back[types[-1]])
    return types[::-1]


def least_switches(keep) -> list:
    """Curve type per step with the fewest changes; ``keep[type][i]`` is 1 where staying with it costs a section."""
    flags = [int(keep[0][i]) | int(keep[1][i]) << 1 | int(keep[2][i]) << 2 for i in range(len(keep[0]))]
    end, _, _ = cross_block(flags, OPENING, True)
    return types_in_block(flags, OPENING, True, best_type(end))


def values_of_steps(kind, means: dict, az, prev_az):
    """The parameters of each step by its type, nan where a period is missing.  ``prev_az`` is nan on the first step."""
    values = np.zeros((len(kind), 4))
    arc, turn, face = (kind == k for k in range(3))
    for c, name in enumerate(("dls", "x", "y", "z")):
        values[arc, c] = means[name][arc]
    for c, name in enumerate(("bur", "tr")):
        values[turn, c] = means[name][turn]
    k, b = means["dls"], means["bur"]
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.where(np.abs(k) >= 1e-12, np.arccos(np.clip(b / k, -1.0, 1.0)), 0.0)
        down = (np.abs(k) >= 1e-12) & (np.abs(az - prev_az) < 1e-12) & (b < 0.0)
    angle = np.where(np.isnan(k + b), np.where(np.isnan(b), np.nan, 0.0), np.where(down, np.pi, angle))
    values[face, 0], values[face, 1] = k[face], angle[face]
    return values


def second_of_arcs(kind, values, inc, az, inc1, az1):
    """The second parameter of a section: an arc's toolface comes from its first step."""
    bent = (kind == 0) & (np.abs(values[:, 0]) >= 1e-12)
    return np.where(kind == 0, np.where(bent, arcs.toolface(inc, az, inc1, az1), 0.0), values[:, 1])


def fit_path(md, inc, az, eps_length: float, eps_curvature: float, alpha: float):
    """Sections (type, start, end, first, second) that describe a whole path by constant parameters."""
    straight = [("CircularArc", float(md[0]), float(md[-1]), 0.0, 0.0)]
    n = len(md) - 1
    if n < 1 or not (np.diff(md) > 0).all():
        return straight
    dls, bur, tr, step, offset = series_of_steps(md[:-1], inc[:-1], az[:-1], md[1:], inc[1:], az[1:])
    middle = np.cumsum(step, axis=0) + np.array([0.0, 0.0, md[0]]) - 0.5 * step
    centre = np.where(np.isnan(offset), 0.0, middle + offset)
    raw = pd.DataFrame(np.column_stack([dls, bur, tr, centre]))
    smooth = np.ascontiguousarray(raw.ewm(alpha=alpha, adjust=False).mean().to_numpy().T)
    tree = Moments(np.ones_like(smooth), smooth, np.zeros_like(smooth))
    ends, found, _ = tree.last_ends(bounds(eps_length, eps_curvature), np.repeat(np.arange(6), n), np.tile(np.arange(n), 6))
    changed, means = {}, {}
    for name, end, mean in zip(SERIES, ends.reshape(6, n).tolist(), found.reshape(6, n).tolist(), strict=True):
        changed[name], means[name] = mark_periods(walk_periods(end, mean, 0, n - 1)[0], 0, n)
    flags = flags_of(changed).tolist()
    end, _, _ = cross_block(flags, OPENING, True)
    types = np.array(types_in_block(flags, OPENING, True, best_type(end)))
    kind = np.append(types[1:], types[-1])
    values = values_of_steps(kind, means, az[:-1], np.append(np.nan, az[:-2]))
    sound = np.flatnonzero(~np.isnan(values).any(axis=1))
    new = np.ones(len(sound), bool)
    new[1:] = (kind[sound[1:]] != kind[sound[:-1]]) | (np.abs(values[sound[1:]] - values[sound[:-1]]) > 1e-9).any(axis=1)
    at = sound[new]
    if not len(at):
        return straight
    second = second_of_arcs(kind[at], values[at], inc[at], az[at], inc[at + 1], az[at + 1])
    stops = np.append(md[at[1:]], md[-1])
    return [(TYPES[k][0], float(a), float(b), float(v), float(w)) for k, a, b, v, w in zip(kind[at], md[at], stops, values[at, 0], second, strict=True)]


def chain_poses(sections, pose, inc, az):
    """The sections with the pose at the start of each, and the pose behind the last."""
    out = []
    for name, start, stop, first, second in sections:
        out.append((name, start, stop, first, second, inc, az, *pose))
        curve = arcs.SECTION[name](pose, inc, az, first, second)
        pose = [float(x) for x in curve.at(stop - start)]
        inc, az = (float(x) for x in curve.direction(stop - start))
    return out, (*pose, inc, az)


# --- operators -----------------------------------------------------------------------------------------------------


def constant_periods_of(rows: DataFrame, column: str, spread: float, key: str = "bore_id") -> DataFrame:
    """The periods of almost constant ``column`` along each path: start and end (places from 0), mean, and whether the
    period before ends where it starts (shared).

    From each start the longest period with a variance below ``spread`` squared counts; the next one starts at its last
    place, or one place on where there is none.  A null counts as zero.  Blocks of a split table are worked on apart.
    """
    x = F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("x")
    columns = [key, "start", "end", "mean", "shared"]
    if B.is_split(rows):
        long = B.with_position(rows.select(key, "seq", B.BLOCK, x), [key], ["seq"], "i", "n")
        long = B.durable(long.select(key, F.lit(0).alias("series"), B.BLOCK, "i", "n", "x"))
        return _periods(long, np.array([max(spread, 0.0) ** 2]), key).select(*columns)

    def find(pdf, begins):
        made = []
        if spread >= 0:
            ends, means = last_ends_of_many(pdf["x"].to_numpy(dtype=float)[None, :], begins, np.array([spread * spread]))
            ends, means = ends[0].tolist(), means[0].tolist()
            for i, (low, high) in enumerate(itertools.pairwise(begins.tolist())):
                periods, _, _ = walk_periods(ends[low:high], means[low:high], 0, high - low - 1)
                made += [(i, *p) for p in periods]
        return pd.DataFrame(made, columns=["_group", *columns[1:]])

    return B.in_whole_groups(rows.select(key, "seq", x), [key], ["seq", "x"], find, "start bigint, end bigint, mean double, shared boolean")


def label_periods(rows: DataFrame, column: str, spread: float, key: str = "bore_id", repeat_shared: bool = False) -> DataFrame:
    """``rows`` with ``label``, one number for all places of a period and one for each place outside, and ``mean``.

    A place shared by two periods has the label of the earlier and the mean of the later one.  With ``repeat_shared`` it
    has both labels, one after the other, and the labels of all later places move on by one; those moved past the end of
    the path go.
    """
    placed = B.with_position(rows, [key], ["seq"], "_at", "_of")
    periods = B.durable(constant_periods_of(rows, column, spread, key))
    inside = periods.select(key, F.explode(F.sequence("start", "end")).alias("_at"), "start", "end", "mean", "shared")
    # Of two periods at a shared place the later one gives the mean, the earlier one the label.
    found = inside.groupBy(key, "_at").agg(
        F.max_by("mean", "start").alias("mean"), F.count("*").alias("_periods"),
        F.max(F.col("_at") - F.col("start") - F.col("shared").cast("bigint")).alias("_since"))
    df = placed.join(found, [key, "_at"], "left")
    # A new label begins outside of periods, and at a period's first place that the one before has not.
    new = F.col("_since").isNull() | (F.col("_since") <= 0)
    df = df.withColumns({"_new": (new & (F.col("_at") > 0)).cast("bigint"), "_twice": (F.coalesce("_periods", F.lit(0)) > 1).cast("bigint")})
    df = B.with_running_sum(df, [key], ["seq"], {"label": "_new", "_moved": "_twice"})
    if repeat_shared:
        moved = df.select(key, F.explode(F.when(F.col("_twice") == 1, F.array(
            F.struct((F.col("_at") + F.col("_moved") - 1).alias("at"), F.col("label").alias("l")),
            F.struct((F.col("_at") + F.col("_moved")).alias("at"), (F.col("label") + 1).alias("l")))).otherwise(F.array(
                F.struct((F.col("_at") + F.col("_moved")).alias("at"), F.col("label").alias("l"))))).alias("_e"))
        moved = moved.select(key, F.col("_e.at").alias("_at"), F.col("_e.l").alias("label"))
        df = df.drop("label").join(moved, [key, "_at"])
    return df.select(*rows.columns, "label", "mean")


def fit_sections(
    stations: DataFrame,
    eps_length: float = EPSILON_LENGTH,
    eps_curvature: float = EPSILON_CURVATURE,
    alpha: float = ALPHA,
    key: str = "bore_id",
) -> DataFrame:
    """Sections of constant parameters for every path, chained from its first station.

    Each row has the section's type, depth range and two parameters (curvature and toolface, or build and turn rate)
    and the pose at its start; a section starts where the one before ends.  Paths of a block at most are fitted in one
    group each; where a source found larger ones (column ``_block``) all are fitted block by block, with equal results.
    """
    usable = survey.usable_source_points(stations)
    kept = [key, "seq", *B.block_column(stations), "md", "inc", "az", "north", "east", "tvd"]
    if B.is_split(stations):
        return _fit_blocks(usable.select(*kept), eps_length, eps_curvature, alpha, key)
    key_type = stations.schema[key].dataType.simpleString()

    def fit(pdf):
        pdf = pdf.sort_values("seq")
        md, inc, az = (pdf[c].to_numpy(dtype=float) for c in ("md", "inc", "az"))
        pose = [float(pdf[c].iat[0]) for c in ("north", "east", "tvd")]
        rows, _ = chain_poses(fit_path(md, inc, az, eps_length, eps_curvature, alpha), pose, float(inc[0]), float(az[0]))
        return pd.DataFrame([(pdf[key].iat[0], i, *r) for i, r in enumerate(rows)], columns=[key, *_names(SECTIONS_SCHEMA)])

    return B.spread(usable.select(*kept), [key]).groupBy(key).applyInPandas(fit, f"{key} {key_type}, {SECTIONS_SCHEMA}")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _fit_blocks(usable: DataFrame, eps_length, eps_curvature, alpha, key) -> DataFrame:
    steps = B.durable(_steps(usable, alpha, key))
    chosen = _types(B.durable(_marked(steps, bounds(eps_length, eps_curvature), key)), key)
    # Steps without a value are passed over; a section starts where type or values change.
    sound = B.with_previous(chosen.filter("sound"), [key], ["seq"], ["kind", "v0", "v1", "v2", "v3"])
    new = F.col("prev_kind").isNull() | (F.col("prev_kind") != F.col("kind"))
    for c in ("v0", "v1", "v2", "v3"):
        new = new | (F.abs(F.col(c) - F.col("prev_" + c)) > 1e-9)
    starts = B.with_position(sound.filter(new).select(key, "seq", B.BLOCK, "kind", "md", "v0", "second"), [key], ["seq"], "section_index")
    starts = B.with_next(starts, [key], ["seq"], ["md"])
    ends = usable.groupBy(key).agg(
        F.max_by("md", "seq").alias("_last"), F.min_by(F.struct("md", "inc", "az", "north", "east", "tvd"), "seq").alias("_pose"))
    ends = B.durable(ends)
    name = F.element_at(F.array(*[F.lit(n) for n, _ in TYPES]), F.col("kind") + 1)
    found = starts.join(ends.select(key, "_last"), key).select(
        key, F.col("section_index").cast("int").alias("section_index"), name.alias("type"), F.col("md").alias("start_md"),
        F.coalesce("next_md", "_last").alias("end_md"), F.col("v0").alias("first"), "second")
    found = B.durable(found)
    straight = ends.join(found.select(key).distinct(), key, "left_anti").select(
        key, F.lit(0).alias("section_index"), F.lit("CircularArc").alias("type"), F.col("_pose.md").alias("start_md"),
        F.col("_last").alias("end_md"), F.lit(0.0).alias("first"), F.lit(0.0).alias("second"))
    return _chained(found.unionByName(straight), ends, key)


def _chained(sections: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Poses section after section, blocks of sections after each other: they are far fewer than stations."""
    key_type = sections.schema[key].dataType.simpleString()
    names = _names(SECTIONS_SCHEMA)
    poses = ends.select(key, *[F.col("_pose." + c).alias(c) for c in ("inc", "az", "north", "east", "tvd")])
    sections = B.durable(sections.withColumn("_part", F.floor(F.col("section_index") / B.ROWS_PER_BLOCK)))
    parts = sections.agg(F.max("_part")).first()[0] or 0
    done = None

    def place(pdf):
        pdf = pdf.sort_values("section_index")
        pose = [float(pdf[c].iat[0]) for c in ("north", "east", "tvd")]
        rows, end = chain_poses(list(pdf[["type", "start_md", "end_md", "first", "second"]].itertuples(index=False)), pose, float(pdf["inc"].iat[0]), float(pdf["az"].iat[0]))
        out = pd.DataFrame([(pdf[key].iat[0], i, *r) for i, r in zip(pdf["section_index"], rows, strict=True)], columns=[key, *names])
        return out.assign(**{"_" + c: v for c, v in zip(("north", "east", "tvd", "inc", "az"), end, strict=True)})

    for part in range(parts + 1):
        group = sections.filter(F.col("_part") == part).drop("_part").join(poses, key)
        out = B.durable(group.groupBy(key).applyInPandas(
            place, f"{key} {key_type}, {SECTIONS_SCHEMA}, _north double, _east double, _tvd double, _inc double, _az double"))
        poses = out.groupBy(key).agg(*[F.first("_" + c).alias(c) for c in ("inc", "az", "north", "east", "tvd")])
        out = out.select(key, *names)
        done = out if done is None else done.unionByName(out)
    return done


def _steps(usable: DataFrame, alpha: float, key: str) -> DataFrame:
    """The steps of all paths whose depth grows throughout, numbered by ``i`` of ``n``, with their smoothed series."""
    df = B.with_next(usable.select(key, "seq", B.BLOCK, "md", "inc", "az"), [key], ["seq"], ["md", "inc", "az"])
    df = B.with_previous(df, [key], ["seq"], ["az"]).filter("next_md IS NOT NULL")
    df = df.join(df.filter("next_md <= md").select(key).distinct(), key, "left_anti")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def local(batches):
        for pdf in batches:
            dls, bur, tr, step, offset = series_of_steps(*(pdf[c].to_numpy(dtype=float) for c in ("md", "inc", "az", "next_md", "next_inc", "next_az")))
            bent = ~np.isnan(offset[:, 0])
            made = {"dls": dls, "bur": bur, "tr": tr, "bent": bent}
            for k, axis in enumerate("xyz"):
                made["step_" + axis], made["off_" + axis] = step[:, k], np.where(bent, offset[:, k], 0.0)
            yield pdf.assign(**made)

    schema = ", ".join(f"{c} {t}" for c, t in types.items()) + ", dls double, bur double, tr double, bent boolean"
    schema += "".join(f", step_{axis} double, off_{axis} double" for axis in "xyz")
    df = B.with_position(df.mapInPandas(local, schema), [key], ["seq"], "i", "n")
    opening = F.when(F.col("i") == 0, F.col("md")).otherwise(0.0)
    df = B.with_running_sum(df, [key], ["seq"], {"to_x": "step_x", "to_y": "step_y", "to_z": F.col("step_z") + opening})
    df = df.withColumns({axis: F.when(F.col("bent"), F.col("to_" + axis) - 0.5 * F.col("step_" + axis) + F.col("off_" + axis)).otherwise(0.0) for axis in "xyz"})
    kept = [key, "seq", B.BLOCK, "i", "n", "md", "inc", "az", "next_inc", "next_az", "prev_az"]
    return survey.ewma(df.select(*kept, *SERIES), list(SERIES), alpha, key).select(*kept, *["s_" + c for c in SERIES])


def _periods(long: DataFrame, bound: np.ndarray, key: str) -> DataFrame:
    """The periods of every series (key, series, _block, i, n, x): start, end, mean, shared, and the blocks of both ends."""
    key_type = long.schema[key].dataType.simpleString()
    by = [key, "series", B.BLOCK]
    layout = f"{key} {key_type}, series int, {B.BLOCK} bigint"
    one = F.struct(F.min("i").alias("low"), F.col(B.BLOCK).alias("block"), F.max("i").alias("high"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"))
    summary = long.groupBy(*by).agg(one.alias("own"), F.first("n").alias("n"))
    all_blocks = summary.groupBy(key, "series").agg(F.array_sort(F.collect_list("own")).alias("blocks"))
    plan = B.durable(summary.join(all_blocks, [key, "series"]).select(*by, "own", "n", F.filter("blocks", lambda b: b["low"] > F.col("own.low")).alias("later")))

    def search(rows, plans):
        """Where the longest period from each step ends, as far as the moments of later blocks tell, and what to ask."""
        rows, p = rows.sort_values("i"), plans.iloc[0]
        x, later = rows["x"].to_numpy(), list(p["later"])
        low, series = int(rows["i"].iat[0]), int(p["series"])
        counts = np.concatenate([np.ones(len(x)), [b["high"] - b["low"] + 1 for b in later]])[None, :]
        mean = np.concatenate([x, [b["mean"] for b in later]])[None, :]
        m2 = np.concatenate([np.zeros(len(x)), [b["m2"] for b in later]])[None, :]
        end, to_mean, (q, leaf, n, mu, s) = Moments(counts, mean, m2).last_ends(bound[series : series + 1], np.zeros(len(x), np.int64), np.arange(len(x)))
        place = np.concatenate([np.arange(len(x)) + low, [b["high"] for b in later]]).astype(np.int64)
        block = np.concatenate([np.full(len(x), p[B.BLOCK]), [b["block"] for b in later]]).astype(np.int64)
        # A later block of a single step is no open leaf: its end tells all.
        found = pd.DataFrame({"s": np.arange(len(x)) + low, "t": np.where(end < 0, -1, place[end]), "t_block": block[end], "mean": to_mean, "ask": -1, "an": 0.0, "am": 0.0, "as": 0.0})
        asks = pd.DataFrame({"s": q + low, "t": -1, "t_block": -1, "mean": np.nan, "ask": block[leaf], "an": n, "am": mu, "as": s})
        out = pd.concat([found, asks[asks["ask"] >= 0]])
        return out.assign(**{key: p[key], "series": series, B.BLOCK: p[B.BLOCK]})[[key, "series", B.BLOCK, "s", "t", "t_block", "mean", "ask", "an", "am", "as"]]

    found = long.groupBy(*by).cogroup(plan.groupBy(*by)).applyInPandas(
        search, layout + ", s bigint, t bigint, t_block bigint, mean double, ask bigint, an double, am double, as double")
    found = B.durable(found)

    def answer(asks, rows):
        if not len(asks) or not len(rows):
            return pd.DataFrame(columns=[key, "series", B.BLOCK, "s", "t", "t_block", "mean"])
        rows = rows.sort_values("i")
        x, series = rows["x"].to_numpy()[None, :], int(asks["series"].iat[0])
        zero = np.zeros(len(asks), np.int64)
        end, mean, _ = Moments(np.ones_like(x), x, np.zeros_like(x)).last_ends(
            bound[series : series + 1], zero, zero, tuple(asks[c].to_numpy() for c in ("an", "am", "as")))
        low = int(rows["i"].iat[0])
        return asks.assign(t=np.where(end < 0, -1, end + low), t_block=asks["ask"], mean=mean)[[key, "series", B.BLOCK, "s", "t", "t_block", "mean"]]

    # Asking and asked block meet in a group of their own, so no group holds more than a block's steps on either side.
    asks = found.filter("ask >= 0")
    pairs = B.durable(asks.select(key, "series", "ask", B.BLOCK).distinct())
    asked = long.withColumnRenamed(B.BLOCK, "ask").join(pairs, [key, "series", "ask"])
    pair = [key, "series", "ask", B.BLOCK]
    answers = asks.groupBy(*pair).cogroup(asked.select(*pair, "i", "x").groupBy(*pair)).applyInPandas(answer, layout + ", s bigint, t bigint, t_block bigint, mean double")
    own = ["s", "t", "t_block", "mean"]
    nexts = found.filter("ask < 0").select(*by, *own).unionByName(answers)
    nexts = B.durable(nexts.groupBy(*by, "s").agg(F.max(F.struct("t", "t_block", "mean")).alias("to")).select(*by, "s", "to.*"))

    def jump(rows, plans):
        """Where the walk leaves the block from every step."""
        rows, p = rows.sort_values("s"), plans.iloc[0]
        low, stop = int(p["own"]["low"]), min(int(p["own"]["high"]) + 1, int(p["n"]) - 1)
        after = int(p["later"][0]["block"]) if len(p["later"]) else -1
        ends, blocks = rows["t"].tolist(), rows["t_block"].tolist()
        out = [(stop, -1, False)] * len(rows)
        for k in range(stop - low - 1, -1, -1):
            at = low + k
            to, block, arc = (ends[k], blocks[k], True) if ends[k] >= 0 else (at + 1, after if at + 1 > p["own"]["high"] else p[B.BLOCK], False)
            out[k] = (to, block, arc) if to >= stop else out[to - low]
        out = pd.DataFrame(out, columns=["t", "t_block", "shared"]).iloc[: max(0, stop - low)]
        out.loc[out["t"] >= int(p["n"]) - 1, "t_block"] = -1
        return out.assign(**{key: p[key], "series": p["series"], B.BLOCK: p[B.BLOCK], "s": np.arange(len(out)) + low})[[key, "series", B.BLOCK, "s", "t", "t_block", "shared"]]

    jumps = nexts.groupBy(*by).cogroup(plan.groupBy(*by)).applyInPandas(jump, layout + ", s bigint, t bigint, t_block bigint, shared boolean")
    entries = _entries(B.durable(jumps), key)

    def follow(rows, entry):
        """The periods that start in the block, from where the walk enters it."""
        columns = [key, "series", B.BLOCK, "start", "end", "end_block", "mean", "shared"]
        if not len(entry) or not len(rows):
            return pd.DataFrame(columns=columns)
        rows = rows.sort_values("s")
        low = int(rows["s"].iat[0])
        # One step more than the walk may start from stands at the path's end.
        stop = min(len(rows), int(entry["n"].iat[0]) - 1 - low)
        ends = np.where(rows["t"] < 0, -1, rows["t"] - low).tolist()
        made, _, _ = walk_periods(ends, rows["mean"].tolist(), int(entry["s"].iat[0]) - low, stop, bool(entry["shared"].iat[0]))
        out = pd.DataFrame(made, columns=["start", "end", "mean", "shared"])
        out = out.assign(end_block=rows["t_block"].to_numpy()[out["start"].to_numpy(dtype=int)], start=out["start"] + low, end=out["end"] + low)
        return out.assign(**{key: entry[key].iat[0], "series": entry["series"].iat[0], B.BLOCK: entry[B.BLOCK].iat[0]})[columns]

    entries = entries.join(plan.select(*by, "n"), by)
    periods = B.durable(nexts.groupBy(*by).cogroup(entries.groupBy(*by)).applyInPandas(
        follow, layout + ", start bigint, end bigint, end_block bigint, mean double, shared boolean"))
    return periods


def _by_block(periods: DataFrame, key: str) -> DataFrame:
    """Each period in every block that it touches."""
    return periods.select(key, "series", F.explode(F.sequence(B.BLOCK, "end_block")).alias(B.BLOCK), "start", "end", "mean", "shared")


def _marked(steps: DataFrame, bound: np.ndarray, key: str) -> DataFrame:
    """The steps with three ``flags`` of changing labels and the mean of each series' period (``m_``)."""
    values = F.posexplode(F.array(*["s_" + c for c in SERIES])).alias("series", "x")
    periods = _periods(B.durable(steps.select(key, B.BLOCK, "i", "n", values)), bound, key)
    over = _by_block(periods, key)
    types = {f.name: f.dataType.simpleString() for f in steps.schema.fields}
    kept = [c for c in steps.columns if not c.startswith("s_")]

    def mark(rows, covers):
        rows = rows.sort_values("i")
        if not len(rows):
            return pd.DataFrame(columns=[*kept, "flags", *["m_" + c for c in SERIES]])
        low, changed, means = int(rows["i"].iat[0]), {}, {}
        covers = covers.sort_values("start")
        for k, name in enumerate(SERIES):
            own = covers[covers["series"] == k]
            changed[name], means["m_" + name] = mark_periods(list(zip(own["start"], own["end"], own["mean"], own["shared"], strict=True)), low, len(rows))
        return rows[kept].assign(flags=flags_of(changed), **means)

    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", flags bigint" + "".join(f", m_{c} double" for c in SERIES)
    return steps.select(*kept).groupBy(key, B.BLOCK).cogroup(over.groupBy(key, B.BLOCK)).applyInPandas(mark, schema)


def _entries(jumps: DataFrame, key: str) -> DataFrame:
    """The one step at which the walk from the first step enters each block it enters (s), and whether a period ends
    there (shared)."""
    on = [key, "series"]
    targets = jumps.filter("t_block >= 0").select(*on, F.col("t_block").alias(B.BLOCK), F.col("t").alias("s")).distinct()
    opening = jumps.filter("s = 0")
    edges = B.durable(jumps.join(targets, [*on, B.BLOCK, "s"], "left_semi").unionByName(opening).distinct())
    ways = [edges.filter("t_block >= 0").select(*on, "s", F.col("t_block").alias("block"), "t", "shared")]
    while True:
        way = ways[-1]
        ahead = way.select(*on, F.col("s").alias("t"), F.col("t").alias("_t"), F.col("block").alias("_block"), F.col("shared").alias("_shared"))
        longer = way.drop("block", "shared").join(ahead, [*on, "t"]).select(*on, "s", F.col("_block").alias("block"), F.col("_t").alias("t"), F.col("_shared").alias("shared"))
        longer = B.durable(longer)
        if not longer.limit(1).count():
            break
        ways.append(longer)
    reached = opening.select(*on, F.col(B.BLOCK).alias("block"), "s", F.lit(False).alias("shared"))
    for way in reversed(ways):
        further = reached.select(*on, "s").join(way, [*on, "s"]).select(*on, "block", F.col("t").alias("s"), "shared")
        reached = B.durable(reached.unionByName(further).distinct())
    return reached.select(*on, F.col("block").alias(B.BLOCK), "s", "shared")


def _types(marked: DataFrame, key: str) -> DataFrame:
    """The kind and values (v0 to v3, second) of every step; ``sound`` where it has them."""
    key_type = marked.schema[key].dataType.simpleString()

    def cross(pdf):
        pdf = pdf.sort_values("i")
        flags, opening = pdf["flags"].tolist(), int(pdf["i"].iat[0]) == 0
        rows = [(pdf[key].iat[0], pdf[B.BLOCK].iat[0], state, *cross_block(flags, state, opening)) for state in ([OPENING] if opening else range(len(STATES)))]
        return pd.DataFrame(rows, columns=[key, B.BLOCK, "state", "behind", "inner", "enter"])

    def compose(pdf):
        """Of one row per block and state, those that the path goes through."""
        table, blocks = {}, sorted(pdf[B.BLOCK].unique())
        for r in pdf.itertuples(index=False):
            table[getattr(r, "block"), r.state] = (r.behind, MAPS[r.inner], MAPS[r.enter])
        state, states = OPENING, []
        for block in blocks:
            states.append(state)
            state = table[block, state][0]
        last, follow, rows = best_type(state), None, []
        for block, state in zip(reversed(blocks), reversed(states), strict=True):
            _, inner, enter = table[block, state]
            rows.append((pdf[key].iat[0], block, state, last, last if follow is None else follow))
            follow = inner[last]
            last = enter[follow]
        return pd.DataFrame(rows, columns=[key, "block", "state", "last", "follow"])

    crossed = marked.select(key, B.BLOCK, "i", "flags").groupBy(key, B.BLOCK).applyInPandas(
        cross, f"{key} {key_type}, {B.BLOCK} bigint, state int, behind int, inner int, enter int")
    chosen = crossed.withColumnRenamed(B.BLOCK, "block").groupBy(key).applyInPandas(
        lambda pdf: compose(pdf.rename(columns={"block": B.BLOCK}).assign(block=pdf["block"])), f"{key} {key_type}, block bigint, state int, last int, follow int")
    chosen = chosen.withColumnRenamed("block", B.BLOCK)

    def label(pdf):
        pdf = pdf.sort_values("i")
        types = types_in_block(pdf["flags"].tolist(), int(pdf["state"].iat[0]), int(pdf["i"].iat[0]) == 0, int(pdf["last"].iat[0]))
        kind = np.array([*types[1:], int(pdf["follow"].iat[0])])
        values = values_of_steps(kind, {c: pdf["m_" + c].to_numpy() for c in SERIES}, pdf["az"].to_numpy(), pdf["prev_az"].to_numpy(dtype=float))
        second = second_of_arcs(kind, values, *(pdf[c].to_numpy() for c in ("inc", "az", "next_inc", "next_az")))
        sound = ~np.isnan(values).any(axis=1)
        made = {f"v{c}": values[:, c] for c in range(4)}
        return pdf[[key, "seq", B.BLOCK, "md"]].assign(kind=kind, second=second, sound=sound, **made)[[key, "seq", B.BLOCK, "md", "kind", "v0", "v1", "v2", "v3", "second", "sound"]]

    seq_type = marked.schema["seq"].dataType.simpleString()
    return B.durable(marked.join(chosen, [key, B.BLOCK]).groupBy(key, B.BLOCK).applyInPandas(
        label, f"{key} {key_type}, seq {seq_type}, {B.BLOCK} bigint, md double, kind int, v0 double, v1 double, v2 double, v3 double, second double, sound boolean"))
