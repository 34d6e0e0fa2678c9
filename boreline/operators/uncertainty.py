"""Position uncertainty: covariance along the path, ellipses, envelope slices and extreme depths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreline.functions import blocks as B
from boreline.functions import geometry as G
from boreline.functions.chisq import chi_square_3d
from boreline.operators import survey
from boreline.operators.interp import on_arc

COVARIANCE = ("c00", "c01", "c02", "c11", "c12", "c22")
ENVELOPE_CONFIDENCE = 0.999
MAXIMUM_SCALE = 5.0
SLICES_PER_STATION = 3
DEFAULT_SECTORS = 32
WOLFF_DEWARDT = ("MWD_WolffDeWardt", "Gyro_WolffDeWardt")
ISCWSA = ("MWD_ISCWSA", "Gyro_ISCWSA")


def _outer(vectors: list[tuple[str | None, str | None, str | None]]) -> dict[str, Column]:
    """Sum of v v' over vectors given by column names (None = zero component)."""
    places = {"c00": (0, 0), "c01": (0, 1), "c02": (0, 2), "c11": (1, 1), "c12": (1, 2), "c22": (2, 2)}
    out = {}
    for name, (i, j) in places.items():
        terms = [F.col(v[i]) * F.col(v[j]) for v in vectors if v[i] and v[j]]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        out[name] = total
    return out


def covariance_wolff_dewardt(stations: DataFrame, instruments: DataFrame, key: str = "bore_id") -> DataFrame:
    """Covariance by the systematic error model of Wolff and de Wardt.

    Every source has one error vector that grows along the path, the covariance is the sum of their outer products;
    the vectors are running sums of trapezoidal legs, all in one window.  ``instruments``: tool_id and per source a
    magnitude, null or zero where the source is not used: rel_depth (per metre), misalignment, true_inc, reference,
    magnetisation, gyro (radians).
    """
    magnitudes = ["rel_depth", "misalignment", "true_inc", "reference", "magnetisation", "gyro"]
    tools = instruments.select("tool_id", *[F.coalesce(m, F.lit(0.0)).alias("_" + m) for m in magnitudes])
    df = stations.drop(*COVARIANCE).join(tools, "tool_id")
    si, ci, sa, ca = F.sin("inc"), F.cos("inc"), F.sin("az"), F.cos("az")
    steep = F.when(F.abs(ci) > 1e-6, si / ci).otherwise(F.lit(0.0))
    # sources by direction: a change of inclination acts along (ci ca, ci sa, -si), a lateral one along (-sa, ca, 0)
    df = df.withColumns({
        "_in": ci * ca, "_ie": ci * sa, "_it": -si, "_an": -sa, "_ae": ca,
        "_wt": si, "_wr": si, "_wm": si * si * sa, "_wg": steep,
    })
    shapes = {
        "mi_n": F.col("_in"), "mi_e": F.col("_ie"), "mi_t": F.col("_it"),
        "ma_n": F.col("_an"), "ma_e": F.col("_ae"),
        "ti_n": F.col("_wt") * F.col("_in"), "ti_e": F.col("_wt") * F.col("_ie"), "ti_t": F.col("_wt") * F.col("_it"),
        "re_n": F.col("_wr") * F.col("_an"), "re_e": F.col("_wr") * F.col("_ae"),
        "mg_n": F.col("_wm") * F.col("_an"), "mg_e": F.col("_wm") * F.col("_ae"),
        "gy_n": F.col("_wg") * F.col("_an"), "gy_e": F.col("_wg") * F.col("_ae"),
    }
    magnitude = {"mi": "_misalignment", "ma": "_misalignment", "ti": "_true_inc", "re": "_reference",
                 "mg": "_magnetisation", "gy": "_gyro"}
    df = df.withColumns({"_f_" + k: v for k, v in shapes.items()})
    df = df.drop("_in", "_ie", "_it", "_an", "_ae", "_wt", "_wr", "_wm", "_wg")
    before = ["md", "north", "east", "tvd", *["_f_" + k for k in shapes]]
    df = B.with_previous(df, [key], ["seq"], before, "_p_")
    half = 0.5 * (F.col("md") - F.col("_p_md"))
    legs = {
        k: F.coalesce(half * F.col(magnitude[k[:2]]) * (F.col("_f_" + k) + F.col("_p__f_" + k)), F.lit(0.0)) for k in shapes
    }
    for axis, x in (("north", "n"), ("east", "e"), ("tvd", "t")):
        legs["dr_" + x] = F.coalesce(F.col("_rel_depth") * (F.col(axis) - F.col("_p_" + axis)), F.lit(0.0))
    df = df.withColumns({"_l_" + k: v for k, v in legs.items()})
    df = B.with_running_sum(df, [key], ["seq"], {"_e_" + k: "_l_" + k for k in legs})
    vectors = []
    for source in ("dr", "mi", "ma", "ti", "re", "mg", "gy"):
        vectors.append(tuple(f"_e_{source}_{x}" if f"{source}_{x}" in legs else None for x in "net"))
    kept = [c for c in stations.columns if c not in COVARIANCE]
    return df.select(*kept, *[c.alias(n) for n, c in _outer(vectors).items()])


# Error codes whose weighting functions are built, by the published MWD error model.
ISCWSA_CODES = (
    "DRFR", "DRFS", "DSFS", "DSTG", "SAG", "XYM1", "XYM2", "XYM3", "XYM4", "ABZ", "ABXY_TI1S", "ABXY_TI2S", "ASZ",
    "ASXY_TI1S", "ASXY_TI2S", "ASXY_TI3S", "MBZ", "MBXY_TI1", "MBXY_TI2", "MSZ", "MSXY_TI1", "MSXY_TI2", "MSXY_TI3",
    "AMID", "DEC_U", "DEC_OS", "DEC_OH", "DEC_OI", "DECR", "DBH_U", "DBH_OS", "DBH_OH", "DBH_OI", "DBHR",
)
# Error codes of gyro tools, by the published gyro error model: the accelerometers beside the gyros, gyros
# that take the azimuth at rest and external references, and gyros that carry it along while running.
GYRO_ACCELEROMETERS = (
    "AXYZ_XYB", "AXYZ_ZB", "AXYZ_SF", "AXYZ_MIS", "AXY_B", "AXY_SF", "AXY_MS", "AXY_GB",
)
GYRO_STATIONARY = (
    "GXYZ_XYB1", "GXYZ_XYB2", "GXYZ_XYRN", "GXYZ_XYG1", "GXYZ_XYG2", "GXYZ_XYG3", "GXYZ_XYG4", "GXYZ_ZB", "GXYZ_ZRN",
    "GXYZ_ZG1", "GXYZ_ZG2", "GXYZ_SF", "GXYZ_MIS", "GXY_B1", "GXY_B2", "GXY_RN", "GXY_G1", "GXY_G2", "GXY_G3", "GXY_G4",
    "GXY_SF", "GXY_MIS", "EXT_REF", "EXT_TIE", "EXT_MIS",
)
GYRO_CONTINUOUS = ("GXYZ_GD", "GXYZ_RW", "GXY_GD", "GXY_RW", "GZ_GD", "GZ_RW")
KNOWN_CODES = (*ISCWSA_CODES, *GYRO_ACCELEROMETERS, *GYRO_STATIONARY, *GYRO_CONTINUOUS)
EARTH_RATE = 7.292115e-5  # radians per second


def _pick(table: dict, default: Column) -> Column:
    """The value beside the row's ``code``; keys hold one or more codes."""
    out = None
    for codes, value in table.items():
        here = F.col("code").isin(*codes.split())
        out = F.when(here, value) if out is None else out.when(here, value)
    return out.otherwise(default)


def _iscwsa_weights() -> tuple[Column, Column, Column]:
    """Weights of depth, inclination and lateral (azimuth times sin inclination) for the row's ``code``."""
    si, ci = F.sin("inc"), F.cos("inc")
    magnetic = F.col("az") - F.col("declination")
    sm, cm, sa, ca = F.sin(magnetic), F.cos(magnetic), F.sin("az"), F.cos("az")
    g, field, tan_dip = F.col("gravity"), F.col("bfield") * F.cos("dip"), F.tan("dip")
    zero, one = F.lit(0.0), F.lit(1.0)
    root2 = 1.4142135623730951

    depth = _pick({"DRFR DRFS": one, "DSFS": F.col("md"), "DSTG": F.col("md") * F.col("tvd")}, zero)
    inclination = _pick(
        {
            "SAG": si, "XYM1": F.abs(si), "XYM3": F.abs(ci) * ca, "XYM4": F.abs(ci) * sa, "ABZ": -si / g,
            "ABXY_TI1S": -ci / g, "ASZ": -si * ci, "ASXY_TI1S": si * ci / root2, "ASXY_TI2S": si * ci / 2.0,
        } | _gyro_inclination(),
        zero,
    )
    azimuth = {
        "ABZ": tan_dip * si * sm / g, "ABXY_TI1S": tan_dip * ci * sm / g, "ASZ": tan_dip * si * ci * sm,
        "ASXY_TI1S": -tan_dip * si * ci * sm / root2, "ASXY_TI2S": -tan_dip * si * ci * sm / 2.0,
        "ASXY_TI3S": (tan_dip * si * cm - ci) / 2.0, "MBZ": -si * sm / field, "MBXY_TI1": -ci * sm / field,
        "MBXY_TI2": cm / field, "MSZ": -(si * cm + tan_dip * ci) * si * sm,
        "MSXY_TI1": si * sm * (tan_dip * ci + si * cm) / root2,
        "MSXY_TI2": sm * (tan_dip * si * ci - ci * ci * cm - cm) / 2.0,
        "MSXY_TI3": (ci * cm * cm - ci * sm * sm - tan_dip * si * cm) / 2.0, "AMID": si * sm,
        "DEC_U DEC_OS DEC_OH DEC_OI DECR": one, "DBH_U DBH_OS DBH_OH DBH_OI DBHR": 1.0 / field,
    }
    lateral = {k: si * v for k, v in azimuth.items()}
    lateral |= {"XYM2": -si, "XYM3": -F.abs(ci) * sa, "XYM4": F.abs(ci) * ca,
                "ABXY_TI2S": (ci - tan_dip * cm * si) / g}
    return depth, inclination, _pick(lateral, zero)


def _away_from_zero(c: Column) -> Column:
    """A divisor that does not vanish where a tool lies along its singular direction."""
    return F.when(F.abs(c) > 1e-6, c).otherwise(F.lit(1e-6))


def _gyro_inclination() -> dict[str, Column]:
    """Inclination weights of the accelerometers of gyro tools; beyond ``switching`` the canted ones are read."""
    si, ci, g = F.sin("inc"), F.cos("inc"), F.col("gravity")
    canted = F.col("inc") - F.when(F.col("inc") >= F.col("switching"), F.col("cant")).otherwise(F.lit(0.0))
    along = _away_from_zero(F.cos(canted))
    return {"AXYZ_XYB": ci / g, "AXYZ_ZB": si / g, "AXYZ_SF": si * ci, "AXYZ_MIS AXY_MS": F.lit(1.0),
            "AXY_B": 1.0 / (g * along), "AXY_SF": F.sin(canted) / along, "AXY_GB": F.sin(canted) / (g * along)}


def _gyro_azimuth() -> Column:
    """Azimuth weight of a gyro at rest for the row's ``code``, null for other codes."""
    si, ci, sa, ca = F.sin("inc"), F.cos("inc"), F.sin("az"), F.cos("az")
    upright, tan_lat, noise = _away_from_zero(ci), F.tan("latitude"), F.col("noise_reduction")
    # by the horizontal part of the earth's rotation
    turned = {
        "GXYZ_XYB1": sa * ci, "GXYZ_XYB2": ca, "GXYZ_XYRN": noise * F.sqrt(1.0 - sa * sa * si * si),
        "GXYZ_XYG1": ca * si, "GXYZ_XYG2": ca * ci, "GXYZ_XYG3": sa * ci * ci, "GXYZ_XYG4": sa * si * ci,
        "GXYZ_ZB": sa * si, "GXYZ_ZRN": noise * sa * si, "GXYZ_ZG1": sa * si * si, "GXYZ_ZG2": sa * si * ci,
        "GXY_B1": sa / upright, "GXY_B2": ca, "GXY_RN": noise * F.sqrt(1.0 - ca * ca * si * si) / upright,
        "GXY_G1": ca * si, "GXY_G2": ca * ci, "GXY_G3": sa, "GXY_G4": sa * si / upright,
    }
    horizontal = F.col("earth_rate") * F.cos("latitude")
    plain = {
        "GXYZ_SF": tan_lat * sa * si * ci, "GXYZ_MIS": 1.0 / F.cos("latitude"), "GXY_SF": tan_lat * sa * si / upright,
        "GXY_MIS": 1.0 / (F.cos("latitude") * upright), "EXT_REF EXT_TIE": F.lit(1.0), "EXT_MIS": 1.0 / _away_from_zero(si),
    }
    return _pick({k: v / horizontal for k, v in turned.items()} | plain, F.lit(None).cast("double"))


def _with_gyro_azimuth(df: DataFrame, key: str) -> DataFrame:
    """Add ``_wa``, the azimuth weight of gyro sources at every station.

    Stationary sources act where the inclination is within their interval; elsewhere the last azimuth taken stands and
    its error with it (none before the first).  Continuous sources begin at zero wherever the path enters their
    interval: drift grows with the running time, a random walk with its root.
    """
    ids, code = [key, "code"], F.col("code")

    def within(c: str) -> Column:
        return (F.col(c) >= F.coalesce("start_inc", F.lit(0.0))) & (F.col(c) <= F.coalesce("end_inc", F.lit(4.0)))

    inside, before = within("inc"), F.coalesce(within("prev_inc"), F.lit(False))
    middle = 0.5 * (F.col("inc") + F.col("prev_inc"))
    slow = _pick({"GXY_GD GXY_RW": 1.0 / _away_from_zero(F.sin(middle)), "GZ_GD GZ_RW": 1.0 / _away_from_zero(F.cos(middle))}, F.lit(1.0))
    rate = F.when(code.endswith("_RW"), slow * slow).otherwise(F.abs(slow))
    leg = F.when(code.isin(*GYRO_CONTINUOUS) & inside & before, rate * (F.col("md") - F.col("prev_md")) / F.nullif("running_speed", F.lit(0.0)))
    df = df.withColumns({"_in": inside, "_starts": inside & ~before, "_leg": F.coalesce(leg, F.lit(0.0)),
                         "_taken": F.when(inside, _gyro_azimuth())})
    df = B.with_running_sum(df, ids, ["seq"], {"_time": "_leg"})
    start = F.when(F.col("_starts"), F.col("_time"))
    df = B.with_running_max_before(df, ids, ["seq"], start, "_zero")
    taken = F.when(F.col("_taken").isNotNull(), F.struct("seq", "_taken"))
    df = B.with_running_max_before(df, ids, ["seq"], taken, "_held")
    ran = F.greatest(F.lit(0.0), F.col("_time") - F.coalesce(start, "_zero", F.lit(0.0)))
    ran = F.when(F.col("_in"), F.when(code.endswith("_RW"), F.sqrt(ran)).otherwise(ran)).otherwise(F.lit(0.0))
    azimuth = F.when(code.isin(*GYRO_CONTINUOUS), ran).otherwise(F.coalesce("_taken", F.col("_held")["_taken"]))
    return df.withColumn("_wa", azimuth).drop("_starts", "_leg", "_taken", "_time", "_zero", "_held")


def _tool_geometry(instruments: DataFrame) -> DataFrame:
    """What weights need of a tool; columns of gyro tools may be missing or null."""
    given = {"latitude": None, "running_speed": None, "switching": None, "cant": 0.0, "earth_rate": EARTH_RATE, "noise_reduction": 1.0}
    extra = []
    for name, default in given.items():
        value = F.col(name).cast("double") if name in instruments.columns else F.lit(None).cast("double")
        extra.append(F.coalesce(value, F.lit(default).cast("double")).alias(name))
    return instruments.select("tool_id", "dip", "declination", "gravity", "bfield", *extra)


def _known_sources(instruments: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources with a weighting function beside their tool, ``_lacks`` where the tool misses what its gyros need."""
    ends = [F.col(c).cast("double") if c in sources.columns else F.lit(None).cast("double").alias(c) for c in ("start_inc", "end_inc")]
    known = sources.filter(F.col("code").isin(*KNOWN_CODES)).select(
        "tool_id", "code", "magnitude", *ends,
        (F.col("random") & ~F.col("systematic") & ~F.col("global")).alias("_random"))
    turned = F.col("code").isin(*[c for c in GYRO_STATIONARY if not c.startswith("EXT")])
    lacks = (turned & F.col("latitude").isNull()) | (
        F.col("code").isin(*GYRO_CONTINUOUS) & ~F.coalesce(F.col("running_speed") > 0, F.lit(False)))
    # sources may be listed from an array, which sizes known to the planner do not show; so they are never broadcast
    return known.hint("merge").join(_tool_geometry(instruments), "tool_id").withColumn("_lacks", lacks)


def _with_sources(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Each station with each source of its tool.

    The sources come to the wells that use them, so stations stay where the windows along a well put them, and rows for
    each source are made there and are not sent on.  Blocks of a split table meet their sources by the tool.
    """
    known = known.hint("merge")
    if B.is_split(df):
        return df.join(known, "tool_id")
    fields = [c for c in known.columns if c != "tool_id"]
    uses = df.select(key, "tool_id").distinct().join(known, "tool_id")
    lists = uses.groupBy(key).agg(F.collect_list(F.struct("tool_id", *fields)).alias("_sources"))
    own = F.filter("_sources", lambda s: s["tool_id"] == F.col("tool_id"))
    return df.join(lists.hint("merge"), key).withColumn("_source", F.explode(own)).select(*df.columns, *["_source." + c for c in fields])


def covariance_iscwsa(stations: DataFrame, instruments: DataFrame, sources: DataFrame, key: str = "bore_id") -> DataFrame:
    """Covariance by the ISCWSA error model, of magnetic and gyro tools.

    Every station meets the error sources of its tool; a source's vector at a station uses half of the legs on both
    sides.  Systematic and global sources add as vectors along the path, random ones as covariances.
    ``instruments``: tool_id, dip, declination, gravity, bfield, and for gyros where they apply latitude, running_speed
    (metres per second), cant, switching (angles), earth_rate, noise_reduction.  ``sources``: tool_id, code, magnitude,
    systematic, random, global, and start_inc, end_inc where a source acts between inclinations only (see
    ``_with_gyro_azimuth``).  Codes without weighting function are left out here and listed by
    ``unknown_error_codes``.  A tool that has no others, or gyros without latitude or running speed, gives null.
    """
    base = stations.drop(*COVARIANCE)
    block = [B.BLOCK] if B.is_split(stations) else []
    df = B.spread(base.select(key, "seq", *block, "tool_id", "md", "inc", "az", "tvd"), [key, *block])
    df = B.with_previous(df, [key], ["seq"], ["md", "inc", "az"])
    df = B.with_next(df, [key], ["seq"], ["md", "inc", "az"])
    df = _with_gyro_azimuth(_with_sources(df, _known_sources(instruments, sources), key), key)
    depth, inclination, lateral = _iscwsa_weights()
    gyro = F.col("code").isin(*GYRO_STATIONARY, *GYRO_CONTINUOUS)
    weights = {"_wd": depth, "_wi": inclination, "_wl": F.when(gyro, F.sin("inc") * F.col("_wa")).otherwise(lateral)}
    acts = gyro | F.col("_in")
    df = df.withColumns({k: F.coalesce(F.when(acts, F.col("magnitude") * w), F.lit(0.0)) for k, w in weights.items()})
    here, above, below = G.tangent("inc", "az"), G.tangent("prev_inc", "prev_az"), G.tangent("next_inc", "next_az")
    si, ci, sa, ca = F.sin("inc"), F.cos("inc"), F.sin("az"), F.cos("az")
    by_inc, by_side = (ci * ca, ci * sa, -si), (-sa, ca, F.lit(0.0))
    up = F.coalesce(F.col("md") - F.col("prev_md"), F.lit(0.0))
    down = F.coalesce(F.col("next_md") - F.col("md"), F.lit(0.0))
    last, inner = {}, {}
    for x, h, a, b, i, s in zip("net", here, above, below, by_inc, by_side):
        turn = F.col("_wi") * i + F.col("_wl") * s
        above_part = F.coalesce(0.5 * (a + h), F.lit(0.0)) * F.col("_wd") + 0.5 * up * turn
        last["_s_" + x] = above_part
        inner["_v_" + x] = above_part - F.coalesce(0.5 * (h + b), F.lit(0.0)) * F.col("_wd") + 0.5 * down * turn
    df = df.withColumns({**last, **inner})
    ids = [key, "code"]
    sums: dict[str, Column] = {"_t_" + x: F.col("_v_" + x) for x in "net"}
    pairs = [("c00", "n", "n"), ("c01", "n", "e"), ("c02", "n", "t"), ("c11", "e", "e"), ("c12", "e", "t"), ("c22", "t", "t")]
    sums |= {"_r_" + c: F.col("_v_" + i) * F.col("_v_" + j) for c, i, j in pairs}
    df = B.with_running_sum(df, ids, ["seq"], sums)
    total = {}
    for c, i, j in pairs:
        star_i, star_j = F.col("_s_" + i), F.col("_s_" + j)
        sum_i, sum_j = F.col("_t_" + i) - F.col("_v_" + i) + star_i, F.col("_t_" + j) - F.col("_v_" + j) + star_j
        scatter = F.col("_r_" + c) - F.col("_v_" + i) * F.col("_v_" + j) + star_i * star_j
        total[c] = F.when(F.col("_random"), scatter).otherwise(sum_i * sum_j)
    lacking = F.bool_or("_lacks")
    summed = df.groupBy(key, "seq").agg(
        *[F.when(~lacking, F.sum(v)).alias(c) for c, v in total.items()])
    return base.join(summed, [key, "seq"], "left").select(*base.columns, *COVARIANCE)


def unknown_error_codes(sources: DataFrame) -> DataFrame:
    """Error sources whose code has no weighting function here."""
    return sources.filter(~F.col("code").isin(*KNOWN_CODES)).groupBy("tool_id", "code").agg(F.count(F.lit(1)).alias("n"))


def infer_error_model(stations: DataFrame, instruments: DataFrame, key: str = "bore_id") -> DataFrame:
    """Error model of each well: that of its first station with a known tool model, by default Wolff-de Wardt."""
    df = stations.select(key, "seq", "tool_id").join(instruments.select("tool_id", "model"), "tool_id", "left")
    kind = F.when(F.col("model").isin(*ISCWSA), F.lit("ISCWSA")).when(
        F.col("model").isin(*WOLFF_DEWARDT), F.lit("WolffDeWardt")
    )
    first = F.min_by(kind, F.when(kind.isNotNull(), F.col("seq")))
    return df.groupBy(key).agg(F.coalesce(first, F.lit("WolffDeWardt")).alias("error_model"))


def _modelled_tools(stations: DataFrame, wells: DataFrame, key: str) -> DataFrame:
    """The tools (``_uses``) of the wells that the ISCWSA model has to compute."""
    asked = wells.filter(~F.col("_given") & F.col("_model").isin(*ISCWSA)).select(key, "_tool")
    return stations.select(key, "tool_id").join(asked, key).select(key, F.coalesce("tool_id", "_tool").alias("_uses")).distinct()


def ensure_covariance(
    stations: DataFrame, instruments: DataFrame, sources: DataFrame, key: str = "bore_id"
) -> tuple[DataFrame, DataFrame]:
    """Stations with covariance, and the wells that cannot have one.

    A well with any given matrix keeps its matrices.  Otherwise stations without tool take the first tool of the well
    and the model of that first tool computes the whole well.  A well is rejected if the ISCWSA model lacks the error
    sources of one of its tools, a weighting function for one of them, or the latitude or running speed its gyros need.
    Returns (stations, rejects with reason).
    """
    given = F.coalesce("c00", "c11", "c22").isNotNull()
    wells = stations.groupBy(key).agg(
        F.bool_or(given).alias("_given"), F.min_by("tool_id", F.when(F.col("tool_id").isNotNull(), F.col("seq"))).alias("_tool")
    ).join(instruments.select(F.col("tool_id").alias("_tool"), F.col("model").alias("_model")), "_tool", "left")
    reason = F.when(~F.col("_given") & F.col("_tool").isNull(), F.lit("no covariance and no survey instrument")).when(
        ~F.col("_given") & ~F.coalesce(F.col("_model").isin(*WOLFF_DEWARDT, *ISCWSA), F.lit(False)),
        F.lit("unknown survey instrument model"),
    )
    # a code that is left out would make the covariance too small, or nothing at all
    tools = _modelled_tools(stations, wells, key)
    coded = sources.select(F.col("tool_id").alias("_uses"), (~F.col("code").isin(*KNOWN_CODES)).alias("_unknown"))
    coded = coded.groupBy("_uses").agg(F.bool_or("_unknown").alias("_unknown"))
    blind = _known_sources(instruments, sources).filter("_lacks").select(F.col("tool_id").alias("_uses"), F.lit(True).alias("_blind"))
    lacking = tools.join(coded, "_uses", "left").join(blind.distinct(), "_uses", "left").groupBy(key).agg(
        F.bool_or(F.col("_unknown").isNull()).alias("_none"), F.bool_or(F.coalesce("_unknown", F.lit(False))).alias("_some"),
        F.bool_or(F.coalesce("_blind", F.lit(False))).alias("_blind"))
    wells = wells.join(lacking, key, "left")
    reason = reason.when(F.col("_none"), F.lit("survey instrument without error sources")).when(
        F.col("_some"), F.lit("survey instrument with an unknown error source")).when(
        F.col("_blind"), F.lit("gyro without latitude or running speed"))
    wells = wells.withColumn("reason", reason)
    rejects = wells.filter("reason IS NOT NULL").select(key, "reason")
    df = stations.join(wells.filter("reason IS NULL").select(key, "_given", "_tool", "_model"), key)
    columns = stations.columns
    kept = df.filter("_given").select(*columns)
    todo = df.filter("NOT _given").withColumn("tool_id", F.coalesce("tool_id", "_tool"))
    simple = covariance_wolff_dewardt(todo.filter(F.col("_model").isin(*WOLFF_DEWARDT)).select(*columns), instruments, key)
    rich = covariance_iscwsa(todo.filter(F.col("_model").isin(*ISCWSA)).select(*columns), instruments, sources, key)
    return B.stack([key], kept, simple.select(*columns), rich.select(*columns)), rejects


def first_station_covariance(stations: DataFrame, wellhead: DataFrame, key: str = "bore_id") -> DataFrame:
    """Fill a missing matrix of each well's first station: the slot's where known, zero where other stations have one."""
    w = wellhead.select(key, *[F.col(c).alias("_w_" + c) for c in ("c00", "c11", "c22")])
    wells = stations.groupBy(key).agg(
        F.min("seq").alias("_first"), F.bool_or(F.coalesce("c00", "c11", "c22").isNotNull()).alias("_any")
    )
    df = stations.join(wells.join(w, key, "left"), key)
    missing = (F.col("seq") == F.col("_first")) & F.coalesce("c00", "c11", "c22").isNull()
    fill = {}
    for c in COVARIANCE:
        slot = F.col("_w_" + c) if c in ("c00", "c11", "c22") else F.when(F.col("_w_c00").isNotNull(), F.lit(0.0))
        fill[c] = F.when(missing, F.coalesce(slot, F.when(F.col("_any"), F.lit(0.0)))).otherwise(F.col(c))
    return df.withColumns(fill).select(*stations.columns)


# --- ellipses ----------------------------------------------------------------------------------------------------


def _frame() -> dict[str, Column]:
    """Unit vectors normal to the path: high side ``_h`` and right ``_r``."""
    si, ci, sa, ca = F.sin("inc"), F.cos("inc"), F.sin("az"), F.cos("az")
    return {"_hn": ci * ca, "_he": ci * sa, "_ht": -si, "_rn": -sa, "_re": ca}


def _perpendicular(scale: float) -> dict[str, tuple[Column, Column, Column]]:
    high, right = ["_hn", "_he", "_ht"], [F.col("_rn"), F.col("_re"), F.lit(0.0)]
    c = list(COVARIANCE)
    return G.ellipse_2x2(G.quad_form(high, c), G.bilinear(high, right, c), G.quad_form(right, c), scale)


def station_ellipses(stations: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Semi-axes and orientation of the horizontal, vertical and perpendicular ellipse of every station.

    Prefixes h_, v_, p_; the angle is that of the major axis from north, from the horizontal along the azimuth, and
    from high side.  Stations without matrix get nulls.
    """
    k = chi_square_3d(confidence) ** 0.5
    along = [F.cos("az"), F.sin("az"), F.lit(0.0)]
    down = [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    c = list(COVARIANCE)
    df = stations.withColumns(_frame())
    planes = {
        "h": G.ellipse_2x2("c00", "c01", "c11", k),
        "v": G.ellipse_2x2(G.quad_form(along, c), G.bilinear(along, down, c), F.col("c22"), k),
        "p": _perpendicular(k),
    }
    out = []
    for name, (major, minor, angle) in planes.items():
        out += [major.alias(name + "_major"), minor.alias(name + "_minor"), angle.alias(name + "_angle")]
    return df.select("bore_id", "seq", "md", *out)


def extreme_tvd_points(stations: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Points of the ellipsoid with the greatest (side 1) and least (side -1) vertical depth; the first station as is."""
    k = chi_square_3d(confidence) ** 0.5
    first = F.col("seq") == 0
    reach = F.when(first | (F.col("c22") <= 0), F.lit(0.0)).otherwise(F.col("side") * k / F.sqrt("c22"))
    both = stations.filter(first | F.col("c22").isNotNull()).withColumn(
        "side", F.explode(F.array(F.lit(1), F.lit(-1)))
    )
    both = both.withColumn("_reach", reach)
    return both.select(
        "bore_id", "side", "seq", *([B.BLOCK] if B.is_split(stations) else []), "md", "inc", "az",
        (F.col("north") + F.coalesce(F.col("_reach") * F.col("c02"), F.lit(0.0))).alias("north"),
        (F.col("east") + F.coalesce(F.col("_reach") * F.col("c12"), F.lit(0.0))).alias("east"),
        (F.col("tvd") + F.coalesce(F.col("_reach") * F.col("c22"), F.lit(0.0))).alias("tvd"),
    )


def _half_turn_scan(unit, place):
    """Running products of half-turn rotations about unit vectors, as quaternions (w, x, y, z), in log2(n) steps.

    ``place`` counts the rows of each product from 0; a negative one takes no part.
    """
    import numpy as np

    q = np.concatenate([np.zeros((len(unit), 1)), unit], axis=1)
    q[place < 0] = [1.0, 0.0, 0.0, 0.0]
    shift = 1
    while shift <= place.max(initial=0):
        rows = np.flatnonzero(place >= shift)
        q[rows] = _quaternion_product(q[rows], q[rows - shift])
        shift *= 2
    return q


def _quaternion_product(a, b):
    import numpy as np

    aw, ax, ay, az = a.T
    bw, bx, by, bz = b.T
    return np.stack(
        [
            aw * bw - ax * bx - ay * by - az * bz,
            aw * bx + ax * bw + ay * bz - az * by,
            aw * by - ax * bz + ay * bw + az * bx,
            aw * bz + ax * by - ay * bx + az * bw,
        ],
        axis=1,
    )


def _rotate(q, v):
    import numpy as np

    w, u = q[:, :1], q[:, 1:]
    return v + 2.0 * np.cross(u, np.cross(u, v) + w * v)


def chain_arcs(points: DataFrame, keys: list[str]) -> DataFrame:
    """Direction and depth of points joined by circular arcs, each tangent to the one before.

    The tangent at the end of an arc is the start tangent turned by half a turn about the chord, so the tangents are a
    running product of rotations: computed per block, carried over the blocks, then applied.  ``points``: keys, seq,
    md, inc, az (used of the first point only), north, east, tvd.  Points that repeat the place before are dropped.
    """
    xyz = ["north", "east", "tvd"]
    df = B.with_previous(points, keys, ["seq"], xyz)
    df = df.withColumn("_chord", G.distance3(xyz, ["prev_" + c for c in xyz]))
    df = df.filter(F.col("_chord").isNull() | (F.col("_chord") > 0))
    first = F.col("_chord").isNull()
    # the first point carries its own tangent, later ones the unit chord that leads to them
    unit = {f"_u{i}": F.when(first, t).otherwise((F.col(c) - F.col("prev_" + c)) / F.col("_chord"))
            for i, (c, t) in enumerate(zip(xyz, G.tangent("inc", "az")))}
    split = B.is_split(points)
    block = [B.BLOCK] if split else []
    df = df.withColumns(unit).select(*keys, *block, "seq", "md", *xyz, "_chord", "_u0", "_u1", "_u2")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns = ["seq", "md", *xyz, "_chord", "_u0", "_u1", "_u2"]

    def turn(rows, begins):
        import numpy as np

        opening = np.isnan(rows["_chord"].to_numpy(dtype=float)[begins[:-1]])
        place = np.arange(len(rows)) - np.repeat(begins[:-1] + opening, np.diff(begins))
        q = _half_turn_scan(rows[["_u0", "_u1", "_u2"]].to_numpy(dtype=float), place)
        return rows.assign(**{f"_q{i}": q[:, i] for i in range(4)})

    fields = ", ".join(f"{n} {types[n]}" for n in columns)
    quaternion = ", ".join(f"_q{i} double" for i in range(4))
    turned = B.in_whole_groups(df, [*keys, *block], columns, turn, f"{fields}, {quaternion}")
    start = df.filter("_chord IS NULL").select(*keys, *[F.col(f"_u{i}").alias(f"_t{i}") for i in range(3)],
                                              F.col("md").alias("_start_md"))
    turned = turned.join(start, keys)
    if split:
        ends = turned.groupBy(*keys, B.BLOCK).agg(*[F.max_by(f"_q{i}", "seq").alias(f"_q{i}") for i in range(4)])
        key_fields = ", ".join(f"{k} {types[k]}" for k in keys)

        def carry(pdf):
            import numpy as np

            pdf = pdf.sort_values(B.BLOCK)
            q = pdf[[f"_q{i}" for i in range(4)]].to_numpy(dtype=float)
            into, out = np.array([[1.0, 0.0, 0.0, 0.0]]), []
            for i in range(len(q)):
                out.append(into[0])
                into = _quaternion_product(q[i : i + 1], into)
            for i in range(4):
                pdf[f"_c{i}"] = np.array(out)[:, i]
            return pdf[[*keys, B.BLOCK, "_c0", "_c1", "_c2", "_c3"]]

        carried = ends.groupBy(*keys).applyInPandas(
            carry, f"{key_fields}, {B.BLOCK} bigint, _c0 double, _c1 double, _c2 double, _c3 double"
        )
        turned = turned.join(carried, [*keys, B.BLOCK])
    else:
        turned = turned.withColumns({f"_c{i}": F.lit(1.0 if i == 0 else 0.0) for i in range(4)})
    v = _rotated([F.col(f"_c{i}") for i in range(4)], [F.col(f"_t{i}") for i in range(3)])
    turned = turned.withColumns({f"_m{i}": x for i, x in enumerate(v)})
    v = _rotated([F.col(f"_q{i}") for i in range(4)], [F.col(f"_m{i}") for i in range(3)])
    turned = turned.withColumns({f"_d{i}": x for i, x in enumerate(v)})
    cosine = G.clamp(F.col("_u0") * F.col("_d0") + F.col("_u1") * F.col("_d1") + F.col("_u2") * F.col("_d2"), -1.0, 1.0)
    half = F.acos(cosine)
    # the half angle lies between tangent and chord at the end of the arc as at its start
    length = F.when(F.col("_chord").isNull(), F.col("_start_md")).otherwise(
        F.col("_chord") * F.when(half < 1e-9, F.lit(1.0)).otherwise(half / F.sin(half))
    )
    turned = turned.withColumn("_length", survey.exact(length))
    turned = B.with_running_sum(turned, keys, ["seq"], {"_md": "_length"})
    return turned.select(
        *keys, "seq", F.col("_md").cast("double").alias("md"), *xyz,
        F.acos(G.clamp("_d2", -1.0, 1.0)).alias("inc"), G.wrap_positive(F.atan2("_d1", "_d0")).alias("az"),
    )


def _rotated(q: list[Column], v: list[Column]) -> list[Column]:
    """v turned by the unit quaternion q."""
    w, x, y, z = q
    a = [y * v[2] - z * v[1] + w * v[0], z * v[0] - x * v[2] + w * v[1], x * v[1] - y * v[0] + w * v[2]]
    return [v[0] + 2.0 * (y * a[2] - z * a[1]), v[1] + 2.0 * (z * a[0] - x * a[2]), v[2] + 2.0 * (x * a[1] - y * a[0])]


def extreme_tvd_paths(stations: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Paths through the deepest (side 1) and shallowest (side -1) points of the station ellipsoids."""
    return chain_arcs(extreme_tvd_points(stations, confidence), ["bore_id", "side"])


# --- envelope ----------------------------------------------------------------------------------------------------

SLICE = ("md", "north", "east", "tvd", "inc", "az", *COVARIANCE, "hole_radius")


def envelope_slices(
    stations: DataFrame, confidence: float, length: str | float | None = None, key: str = "bore_id"
) -> DataFrame:
    """Perpendicular ellipses along each path, numbered from 0, with the rounded end below the last station.

    Without ``length`` every segment gets three slices (the reference mesh); with it, slices at most that far apart
    (a number, or a column of ``stations``).  A slice has its centre, its frame (high side, right), the hole radius
    r0 and the statistical semi-axes a, b at unit scale with the orientation from high side: at scale s the
    semi-axes are r0 + s a and r0 + s b.  Three more slices close the end as half an ellipsoid.
    """
    fields = ["md", "north", "east", "tvd", "inc", "az", *COVARIANCE, "hole_radius"]
    extra = tuple(c for c in (*COVARIANCE, "hole_radius"))
    by_column = isinstance(length, str)
    segs = survey.segments(stations, key, (*extra, *([length] if by_column else [])))
    ds = F.col("b_md") - F.col("a_md")
    if length is None:
        parts = F.lit(SLICES_PER_STATION)
    else:
        mesh = F.col("a_" + length) if by_column else F.lit(float(length))
        parts = F.greatest(F.lit(1), F.ceil(ds / mesh - 1e-9).cast("int"))
    cut = segs.withColumn("_parts", parts).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    cut = cut.withColumn("md", F.col("a_md") + F.col("_k") * (F.col("b_md") - F.col("a_md")) / F.col("_parts"))
    inner = on_arc(cut.filter("_k > 0"), linear=extra).select(key, "seq", F.col("_k").alias("part"), *fields)
    own = stations.select(key, "seq", F.lit(0).alias("part"), *fields)  # blocks are set afresh below
    df = B.stack([key], own, inner).filter("c00 IS NOT NULL").withColumn("hole_radius", F.coalesce("hole_radius", F.lit(0.0)))
    df = _shaped(df, confidence)
    last = stations.groupBy(key).agg(F.max("seq").alias("_last"))
    ends = df.filter("part = 0").join(last, key).filter("seq = _last").drop("_last")
    every = B.stack([key], df.withColumn("cap", F.lit(0)), terminal_cap(ends))
    order = ["seq", "part", "cap"]
    if B.is_split(stations):
        every = every.withColumn(B.BLOCK, F.shiftright("seq", 16))
    numbered = B.with_position(every, [key], order, "slice")
    return numbered.select(
        key, "slice", *B.block_column(numbered), "seq", "part", "cap", "md", "north", "east", "tvd", "inc", "az",
        "_hn", "_he", "_ht", "_rn", "_re", "a", "b", "theta", F.col("hole_radius").alias("r0"), "tangent_axis",
    )


def _shaped(df: DataFrame, confidence: float) -> DataFrame:
    """Add the frame and the statistical semi-axes at unit scale to stations with covariance."""
    k = chi_square_3d(confidence) ** 0.5
    df = df.withColumns(_frame())
    major, minor, angle = _perpendicular(k)
    tangent = G.quad_form(list(G.tangent("inc", "az")), list(COVARIANCE))
    return df.withColumns({"a": major, "b": minor, "theta": angle,
                           "tangent_axis": k * F.sqrt(F.greatest(tangent, F.lit(0.0)))})


LINK_FIELDS = ["md", "north", "east", "tvd", "inc", "az", *COVARIANCE, "hole_radius"]


def envelope_links(stations: DataFrame, length: str | None, key: str = "bore_id", numbered: bool = False) -> DataFrame:
    """The slices of ``envelope_slices`` as one row per pair of neighbouring stations: key, link, a_*, b_*, parts, is_cap.

    Link a -> b stands for the slices 0 (station a) to ``parts`` (station b), numbered along the well.  The last station
    has one more link, to the last slice of its cap.  A well's rows are as many as its stations, however fine its mesh is.
    Without ``length`` every segment has three parts.  ``numbered`` adds the number of the first slice (``slice``), of
    how many the next is farther (``step``), whether the first is one of a plain link too (``in_plain``) and the seq of both
    ends, and a well of one slice has a link of no parts.
    """
    block = B.block_column(stations)
    df = B.with_next(stations.select(key, "seq", *block, *LINK_FIELDS, *([length] if length else [])), [key], ["seq"], LINK_FIELDS, "b_")
    grows, here, there = F.coalesce(F.col("b_md") > F.col("md"), F.lit(False)), F.col("c00").isNotNull(), F.col("b_c00").isNotNull()
    asked = F.lit(SLICES_PER_STATION)
    if length:
        asked = F.greatest(F.lit(1), F.ceil((F.col("b_md") - F.col("md")) / F.col(length) - 1e-9).cast("int"))
    df = df.withColumn("_parts", F.when(grows, asked).otherwise(F.lit(1)))
    own = df.filter(here).select(key, "seq", *block, F.lit(0).alias("part"), *LINK_FIELDS, (grows & there).alias("_joined"), "_parts")
    # between a station with covariance and one without there are slices, but the latter is none: they are links of their own
    one = df.filter(grows & (here != there)).withColumnsRenamed({c: "a_" + c for c in LINK_FIELDS})
    one = one.withColumn("part", F.explode(F.expr("IF(_parts > 1, sequence(1, _parts - 1), array())")))
    one = one.withColumn("md", F.col("a_md") + F.col("part") * (F.col("b_md") - F.col("a_md")) / F.col("_parts"))
    one = on_arc(one, linear=(*COVARIANCE, "hole_radius"))
    df = B.stack([key], own, one.select(key, "seq", *block, "part", *LINK_FIELDS, F.lit(False).alias("_joined"), "_parts"))
    df = B.with_position(df, [key], ["seq", "part"], "link")
    df = B.with_next(df.withColumn("_mark", F.lit(1)), [key], ["link"], ["_mark", "seq", *LINK_FIELDS], "_b_")
    df = df.join(stations.groupBy(key).agg(F.max("seq").alias("_last")), key)
    parts = F.when(F.col("_joined"), F.col("_parts")).otherwise(F.lit(1))
    plain = F.when(F.col("_b__mark").isNotNull(), F.struct(parts.alias("parts"), F.lit(False).alias("is_cap")))
    caps = F.when((F.col("seq") == F.col("_last")) & (F.col("part") == 0), F.struct(F.lit(SLICES_PER_STATION).alias("parts"), F.lit(True).alias("is_cap")))
    alone = F.when((F.col("link") == 0) & plain.isNull() & caps.isNull(), F.struct(F.lit(0).alias("parts"), F.lit(False).alias("is_cap")))
    kinds = F.filter(F.array(plain, caps, *([alone] if numbered else [])), lambda x: x.isNotNull())
    df = df.withColumn("_kind", F.explode(kinds)).withColumn("_plain_parts", parts.cast("bigint"))
    number = []
    if numbered:
        # cap slices follow all stations; where stations repeat the last seq, each slice of one cap those of the others
        more = F.when(F.col("_kind.is_cap"), F.lit(0)).otherwise(F.col("_kind.parts")).cast("bigint")
        df = B.with_running_sum(df.withColumn("_more", more), [key], ["link", "_kind.is_cap"], {"_end": "_more"})
        ends = stations.groupBy(key, "seq").agg(F.count("c00").alias("_n")).groupBy(key).agg(F.max_by("_n", "seq").alias("_ends"))
        df = df.join(ends, key)
        plain_too = F.col("_kind.is_cap") & F.col("_b__mark").isNotNull()
        number = [
            (F.col("_end") - F.when(plain_too, F.col("_plain_parts")).otherwise(F.col("_more"))).alias("slice"),
            F.when(F.col("_kind.is_cap"), F.col("_ends")).otherwise(F.lit(1)).cast("bigint").alias("step"), plain_too.alias("in_plain"),
            F.col("seq").alias("a_seq"), F.col("_b_seq").alias("b_seq")]
    return df.select(
        key, (F.col("link") * 2 + F.col("_kind.is_cap").cast("bigint")).alias("link"), "_kind.*", *number,
        *[F.col(c).alias("a_" + c) for c in LINK_FIELDS], *[F.col("_b_" + c).alias("b_" + c) for c in LINK_FIELDS],
    )


def slices_of_links(links: DataFrame, confidence: float) -> DataFrame:
    """Slices ``part`` = 0 to ``parts`` of every link, as ``envelope_slices`` has them; no row leaves its task."""
    df = links.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts"))))
    df = df.withColumn("md", F.col("a_md") + F.col("part") * (F.col("b_md") - F.col("a_md")) / F.col("parts"))
    df = on_arc(df, linear=(*COVARIANCE, "hole_radius"))
    first = (F.col("part") == 0) | F.col("is_cap")
    df = df.withColumns({
        c: F.when(first, F.col("a_" + c)).when(F.col("part") == F.col("parts"), F.col("b_" + c)).otherwise(F.col(c))
        for c in LINK_FIELDS
    }).drop(*[p + c for p in ("a_", "b_") for c in LINK_FIELDS])
    df = df.withColumn("hole_radius", F.coalesce("hole_radius", F.lit(0.0)))
    df = _shaped(df, confidence).withColumn("cap", F.when(F.col("is_cap"), F.col("part")).otherwise(F.lit(0)))
    return _onto_cap(df, SLICES_PER_STATION).withColumn("r0", F.col("hole_radius"))


def deviations(confidence: float) -> float:
    """Standard deviations that the unit scale of an envelope stands for."""
    return chi_square_3d(confidence) ** 0.5


def widest_slices(links: DataFrame, confidence: float, key: str = "bore_id") -> DataFrame:
    """``max_semi_axis`` of all slices of the links of each path; slices are made in numpy and stay in their task."""
    k = deviations(confidence)

    def run(batches):
        import pyarrow as pa

        from boreline.functions import slices

        for batch in batches:
            at = batch.schema.get_field_index(key)
            wide = pa.array(slices.widest(slices.Links(batch), k), from_pandas=True)
            yield pa.RecordBatch.from_arrays([batch.column(at), wide], [key, "_wide"])

    kind = links.schema[key].dataType.simpleString()
    return links.mapInArrow(run, f"{key} {kind}, _wide double").groupBy(key).agg(F.max("_wide").alias("max_semi_axis"))


def terminal_cap(ends: DataFrame, slices: int = SLICES_PER_STATION) -> DataFrame:
    """Half-ellipsoid below the last slice of each path.

    Cap slice i lies u = i/n of the tangent semi-axis below, its radii shrink by sqrt(1 - u^2).  At scale s the offset
    is s times the one at unit scale, which goes into the slice's own position for scale 1; ``cap`` keeps i.
    """
    return _onto_cap(ends.withColumn("cap", F.explode(F.sequence(F.lit(1), F.lit(max(2, slices))))), max(2, slices))


def _onto_cap(df: DataFrame, slices: int) -> DataFrame:
    """Move each row to its slice ``cap`` of the half-ellipsoid; 0 is the last slice of the path."""
    u = F.col("cap") / float(slices)
    shrink = F.sqrt(F.greatest(F.lit(0.0), 1.0 - u * u))
    t = G.tangent("inc", "az")
    off = u * F.col("tangent_axis")
    return df.withColumns({
        "_off": off, "_shrink": shrink,
    }).withColumns({
        "north": F.col("north") + F.col("_off") * t[0],
        "east": F.col("east") + F.col("_off") * t[1],
        "tvd": F.col("tvd") + F.col("_off") * t[2],
        "md": F.col("md") + F.col("_off"),
        "a": F.col("a") * F.col("_shrink"),
        "b": F.col("b") * F.col("_shrink"),
        "hole_radius": F.col("hole_radius") * F.col("_shrink"),
    }).drop("_off", "_shrink")


def scale_envelope(slices: DataFrame, scale: str | float) -> DataFrame:
    """Slices at a scale: every value is v0 + s (v1 - v0) between scale 0 and 1.

    Centre, depth and hole radius of ordinary slices do not depend on the scale; cap slices move down the tangent by
    s times their offset at unit scale.
    """
    s = F.col(scale) if isinstance(scale, str) else F.lit(float(scale))
    u = F.col("cap") / float(SLICES_PER_STATION)
    move = (s - 1.0) * u * F.col("tangent_axis")
    t = G.tangent("inc", "az")
    return slices.withColumns({
        "md": F.col("md") + move,
        "north": F.col("north") + move * t[0],
        "east": F.col("east") + move * t[1],
        "tvd": F.col("tvd") + move * t[2],
        "major": F.col("r0") + s * F.col("a"),
        "minor": F.col("r0") + s * F.col("b"),
    })


def with_box(scaled: DataFrame) -> DataFrame:
    """Bounding box of each scaled ellipse: columns n/e/t_lo/hi."""
    ct, st = F.cos("theta"), F.sin("theta")
    axes = {"n": ("north", "_hn", "_rn"), "e": ("east", "_he", "_re"), "t": ("tvd", "_ht", None)}
    df = scaled
    for x, (centre, h, r) in axes.items():
        right = F.col(r) if r else F.lit(0.0)
        p, q = ct * F.col(h) + st * right, ct * right - st * F.col(h)
        half = G.norm(F.col("major") * p, F.col("minor") * q)
        df = df.withColumn("_half", half).withColumns({
            f"{x}_lo": F.col(centre) - F.col("_half"), f"{x}_hi": F.col(centre) + F.col("_half")
        })
    return df.drop("_half")


def sector_count(slices: DataFrame, spacing: float, least: int = 36, most: int = 240, key: str = "bore_id") -> DataFrame:
    """Vertices per ellipse so that neighbours are at most ``spacing`` apart on the widest ellipse of the path."""
    widest = F.max(F.greatest(F.col("r0") + F.col("a"), F.col("r0") + F.col("b"))).alias("max_semi_axis")
    return sectors_of_axis(slices.groupBy(key).agg(widest), spacing, least, most)


def sectors_of_axis(widest: DataFrame, spacing: float, least: int, most: int) -> DataFrame:
    """Add ``sectors`` to the widest semi-axis of each path (``max_semi_axis``)."""
    df = widest
    asked = F.ceil(F.lit(2.0) * F.pi() * F.col("max_semi_axis") / spacing)
    return df.withColumn("sectors", F.least(F.greatest(asked, F.lit(least)), F.lit(most)).cast("int"))


def ellipse_vertices(scaled: DataFrame, sectors: str | int = DEFAULT_SECTORS) -> DataFrame:
    """Vertices of each scaled ellipse, counted by angle from high side (column ``vertex``)."""
    n = F.col(sectors) if isinstance(sectors, str) else F.lit(sectors)
    df = scaled.withColumns({"_n": n, "_ct": F.cos("theta"), "_st": F.sin("theta")})
    df = df.withColumn("vertex", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    psi = F.col("vertex") * (2.0 * F.pi()) / F.col("_n") - F.col("theta")
    df = df.withColumns({"_x": F.col("major") * F.cos(psi), "_y": F.col("minor") * F.sin(psi)})
    ct, st = F.col("_ct"), F.col("_st")
    df = df.withColumns({"_up": F.col("_x") * ct - F.col("_y") * st, "_side": F.col("_x") * st + F.col("_y") * ct})
    return df.withColumns({
        "v_north": F.col("north") + F.col("_up") * F.col("_hn") + F.col("_side") * F.col("_rn"),
        "v_east": F.col("east") + F.col("_up") * F.col("_he") + F.col("_side") * F.col("_re"),
        "v_tvd": F.col("tvd") + F.col("_up") * F.col("_ht"),
    }).drop("_n", "_ct", "_st", "_x", "_y", "_up", "_side")
