"""Covariance, ellipses and envelope slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from boreline.functions import blocks as B
from boreline.functions import geometry as G
from boreline.functions.chisq import chi_square_3d
from boreline.operators import hierarchy, holes, uncertainty
from boreline.plans import sql
from boreline.plans.catalog import FILLED, HEAD, HOLE
from boreline.sources import derived as D

COV = uncertainty.COVARIANCE


def _round(df, digits, columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def covered_stations(spark, sf):
    """Stations with Wolff-de Wardt covariance and hole radius, written once as a station table is."""
    s = B.durable(uncertainty.covariance_wolff_dewardt(D.with_tools(D.stations(spark, sf), spark, sf), D.instruments(spark, sf)))
    intervals = holes.hole_intervals(D.hole_sections(spark, sf), D.wellheads(spark, sf))
    return B.durable(holes.fill_hole_radius(s, intervals))


def _covered(spark, sf):
    return uncertainty.covariance_wolff_dewardt(D.with_tools(D.stations(spark, sf), spark, sf), D.instruments(spark, sf))


def wolff_dewardt(spark, sf):
    return _round(_covered(spark, sf), 6, COV).select("bore_id", "seq", *COV)


def iscwsa(spark, sf):
    s = D.with_tools(D.stations(spark, sf), spark, sf).withColumn("tool_id", F.col("tool_id") - F.col("tool_id") % 5 + 2)
    got = uncertainty.covariance_iscwsa(s, D.instruments(spark, sf), D.error_sources(spark, sf))
    return got.select("bore_id", "seq", *[F.round(c, 4).alias(c) for c in COV])


def iscwsa_gyro(spark, sf):
    """Covariance with gyro tools that rest, run and rest again."""
    s = D.with_tools(D.stations(spark, sf), spark, sf)
    got = uncertainty.covariance_iscwsa(s, D.gyro_instruments(spark, sf), D.gyro_sources(spark, sf))
    return got.select("bore_id", "seq", *[F.round(c, 4).alias(c) for c in COV])


def unknown_error_codes(spark, sf):
    return uncertainty.unknown_error_codes(D.error_sources(spark, sf))


def infer_error_model(spark, sf):
    s = D.with_tools(D.stations(spark, sf), spark, sf)
    return uncertainty.infer_error_model(
        s.withColumn("tool_id", F.when(F.col("seq") >= F.col("bore_id") % 3, F.col("tool_id"))), D.instruments(spark, sf)
    )


def ensure_covariance(spark, sf):
    """Some wells come with matrices, some stations and wells without tool."""
    s = D.with_tools(D.stations(spark, sf), spark, sf)
    given = F.col("bore_id") % 6 == 0
    s = s.withColumns({c: F.when(given, F.lit(v)).cast("double") for c, v in zip(COV, (2.0, 0.1, 0.2, 3.0, 0.3, 1.0))})
    s = s.withColumn("tool_id", F.when((F.col("seq") % 3 == 1) & (F.col("bore_id") % 13 != 5), F.col("tool_id")))
    done, rejects = uncertainty.ensure_covariance(s, D.instruments(spark, sf), D.error_sources(spark, sf))
    ok = done.groupBy("bore_id").agg(
        F.lit("ok").alias("status"), F.count(F.lit(1)).alias("n"), F.count("c00").alias("filled"),
    )
    bad = rejects.select("bore_id", F.col("reason").alias("status"), F.lit(0).cast("bigint").alias("n"),
                         F.lit(0).cast("bigint").alias("filled"))
    return ok.unionByName(bad)


def first_station_covariance(spark, sf):
    s = _covered(spark, sf)
    s = s.withColumns({c: F.when((F.col("seq") > 0) & (F.col("bore_id") % 4 != 1), F.col(c)) for c in COV})
    ref = hierarchy.wellhead_reference(D.wellbores(spark, sf), D.wells(spark, sf), D.clusters(spark, sf))
    done = uncertainty.first_station_covariance(s, hierarchy.wellhead_covariance(ref))
    return _round(done, 4, COV).select("bore_id", "seq", *COV)


def station_ellipses(spark, sf):
    got = uncertainty.station_ellipses(_covered(spark, sf), 0.95)
    axes = [c for c in got.columns if c.endswith(("major", "minor"))]
    # an angle is only defined up to half a turn, and not at all on a circle
    shape = {f"{p}_angle": F.round(F.sin(2.0 * F.col(p + "_angle")) * (F.col(p + "_major") - F.col(p + "_minor")), 5)
             for p in ("h", "v", "p")}
    return _round(got.withColumns(shape), 5, axes)


def quad_form(spark, sf):
    s = _covered(spark, sf)
    return s.select("bore_id", "seq", F.round(G.quad_form(list(G.tangent("inc", "az")), list(COV)), 6).alias("variance"))


def extreme_tvd_paths(spark, sf):
    got = uncertainty.extreme_tvd_paths(_covered(spark, sf), 0.95)
    return _round(got, 4, ("md", "north", "east", "tvd", "inc", "az"))


def extreme_tvd_points(spark, sf):
    got = uncertainty.extreme_tvd_points(_covered(spark, sf), 0.95)
    return _round(got, 5, ("north", "east", "tvd")).select("bore_id", "side", "seq", "north", "east", "tvd")


def _slices(spark, sf):
    return uncertainty.envelope_slices(covered_stations(spark, sf), 0.999)


SLICE_OUT = ("md", "north", "east", "tvd", "a", "b", "r0")


def envelope_slices(spark, sf):
    return _round(_slices(spark, sf), 6, SLICE_OUT).select("bore_id", "slice", "seq", "part", "cap", *SLICE_OUT)


def terminal_cap(spark, sf):
    got = _slices(spark, sf).filter("cap > 0")
    return _round(got, 6, SLICE_OUT).select("bore_id", "cap", *SLICE_OUT)


def scale_envelope(spark, sf):
    """Boxes of the envelope at scale 5."""
    got = uncertainty.with_box(uncertainty.scale_envelope(_slices(spark, sf), 5.0))
    out = ["md", "major", "minor", *[f"{x}_{e}" for x in "net" for e in ("lo", "hi")]]
    return _round(got, 3, out).select("bore_id", "seq", "part", "cap", *out)


def sector_count(spark, sf):
    return _round(uncertainty.sector_count(_slices(spark, sf), 0.5), 4, ("max_semi_axis",))


def ellipse_vertices(spark, sf):
    scaled = uncertainty.scale_envelope(_slices(spark, sf), 1.0)
    v = uncertainty.ellipse_vertices(scaled, 36)
    far = G.distance3(["v_north", "v_east", "v_tvd"], ["north", "east", "tvd"])
    return v.groupBy("bore_id", "slice").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("v_north"), 6).alias("centre_north"),
        F.round(F.avg("v_tvd"), 6).alias("centre_tvd"), F.round(F.sqrt(F.avg(far * far)), 4).alias("rms_radius"),
    )


K95, K999 = chi_square_3d(0.95) ** 0.5, chi_square_3d(0.999) ** 0.5


def _axes(c: str, s: str) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in zip(("a0", "b0", "th"), sql.ellipse(
        sql.quad(*sql.HIGH), sql.bilinear(sql.HIGH, sql.RIGHT), sql.quad(*sql.RIGHT), f"{K999!r}::DOUBLE")))


_C6 = ("c00", "c01", "c02", "c11", "c12", "c22")
_LIN = ", ".join(f"a_{c}+u*(b_{c}-a_{c}) AS {c}" for c in _C6)

SLICES = ",".join([
    sql.STN, sql.BORES, sql.HOLES, HOLE, FILLED, sql.TOOLS, sql.WOLFF,
    "covr AS (SELECT cov.*, f.hole_radius FROM cov JOIN filled f USING (bore_id, seq))",
    sql.seg("cseg", "covr", (*_C6, "hole_radius")),
    "inner_s AS (SELECT cseg.*, k AS part, a_md+k*(b_md-a_md)/3 AS at_md FROM cseg, (VALUES (1),(2)) v(k))",
    sql.arc("inner_s", "at_md", f"bore_id, seq, part, at_md AS md, {_LIN}, coalesce(a_hole_radius+u*(b_hole_radius-a_hole_radius),"
            " a_hole_radius, b_hole_radius) AS hole_radius", "sarc"),
    f"""
plain AS (SELECT bore_id, seq, 0 AS part, md, north, east, tvd, inc, az, {', '.join(_C6)}, coalesce(hole_radius,0.0) AS r0 FROM covr
  UNION ALL SELECT bore_id, seq, part, md, north, east, tvd, inc, az, {', '.join(_C6)}, coalesce(hole_radius,0.0) FROM sarc),
shaped_s AS (SELECT *, {_axes('', '')}, {K999!r}::DOUBLE*sqrt(greatest({sql.quad(*sql.TANGENT)},0.0)) AS tax FROM plain),
lasts AS (SELECT bore_id, max(seq) AS seq FROM covr GROUP BY 1),
caps AS (SELECT s.*, cap, cap/3.0::DOUBLE AS u, sqrt(greatest(0.0,1-(cap/3.0::DOUBLE)*(cap/3.0::DOUBLE))) AS sh
  FROM shaped_s s JOIN lasts USING (bore_id, seq), (VALUES (1),(2),(3)) v(cap)),
slices AS (SELECT bore_id, seq, part, 0 AS cap, md, north, east, tvd, inc, az, a0 AS a, b0 AS b, th, r0, tax FROM shaped_s
  UNION ALL SELECT bore_id, seq, part, cap, md+u*tax, north+u*tax*sin(inc)*cos(az), east+u*tax*sin(inc)*sin(az), tvd+u*tax*cos(inc),
    inc, az, a0*sh, b0*sh, th, r0*sh, tax FROM caps),
numbered AS (SELECT *, row_number() OVER (PARTITION BY bore_id ORDER BY seq, part, cap)-1 AS slice FROM slices)""",
])


def _box_sql(scale: str) -> str:
    out = []
    for x, c, h, r in (("n", "north", sql.HIGH[0], sql.RIGHT[0]), ("e", "east", sql.HIGH[1], sql.RIGHT[1]),
                       ("t", "tvd", sql.HIGH[2], "0.0")):
        p, q = f"(cos(th)*{h}+sin(th)*{r})", f"(cos(th)*{r}-sin(th)*{h})"
        half = f"sqrt(pow(major*{p},2)+pow(minor*{q},2))"
        out.append(f"{c}2-{half} AS {x}_lo, {c}2+{half} AS {x}_hi")
    return f"""
scaled AS (SELECT *, ({scale}-1)*cap/3.0::DOUBLE*tax AS mv FROM numbered),
moved_s AS (SELECT *, md+mv AS md2, north+mv*sin(inc)*cos(az) AS north2, east+mv*sin(inc)*sin(az) AS east2, tvd+mv*cos(inc) AS tvd2,
  r0+{scale}*a AS major, r0+{scale}*b AS minor FROM scaled),
boxed AS (SELECT *, {', '.join(out)} FROM moved_s)"""


_OUT4 = ", ".join(f"round({c},6) AS {c}" for c in SLICE_OUT)
_WOLFF = (sql.STN, sql.TOOLS, sql.WOLFF)

QUERIES = {
    "wolff_dewardt": wolff_dewardt,
    "iscwsa": iscwsa,
    "iscwsa_gyro": iscwsa_gyro,
    "unknown_error_codes": unknown_error_codes,
    "infer_error_model": infer_error_model,
    "ensure_covariance": ensure_covariance,
    "first_station_covariance": first_station_covariance,
    "station_ellipses": station_ellipses,
    "quad_form": quad_form,
    "extreme_tvd_points": extreme_tvd_points,
    "extreme_tvd_paths": extreme_tvd_paths,
    "envelope_slices": envelope_slices,
    "terminal_cap": terminal_cap,
    "scale_envelope": scale_envelope,
    "sector_count": sector_count,
    "ellipse_vertices": ellipse_vertices,
}


def _ellipse_sql() -> str:
    along = ("cos(az)", "sin(az)", "0.0")
    k = f"{K95!r}::DOUBLE"
    planes = {
        "h": sql.ellipse("c00", "c01", "c11", k),
        "v": sql.ellipse(sql.quad(*along), f"({along[0]}*c02+{along[1]}*c12)", "c22", k),
        "p": sql.ellipse(sql.quad(*sql.HIGH), sql.bilinear(sql.HIGH, sql.RIGHT), sql.quad(*sql.RIGHT), k),
    }
    raw = ", ".join(f"{e[0]} AS {p}1, {e[1]} AS {p}2, {e[2]} AS {p}3" for p, e in planes.items())
    out = ", ".join(f"round({p}1,5) AS {p}_major, round({p}2,5) AS {p}_minor, round(sin(2*{p}3)*({p}1-{p}2),5) AS {p}_angle"
                    for p in planes)
    return f"SELECT bore_id, seq, md, {out} FROM (SELECT *, {raw} FROM cov)"


def _source_sums() -> tuple[str, str]:
    """From weights per station and source: vectors over half of the legs on both sides, sums per source, the total."""
    axes = (("n", "sin({i})*cos({a})", "cos(inc)*cos(az)", "-sin(az)"), ("e", "sin({i})*sin({a})", "cos(inc)*sin(az)", "cos(az)"),
            ("t", "cos({i})", "-sin(inc)", "0.0"))
    parts, sums, totals = [], [], []
    for x, t, by_inc, by_side in axes:
        here, above, below = (t.format(i=i, a=a) for i, a in (("inc", "az"), ("pinc", "paz"), ("ninc", "naz")))
        star = f"coalesce(0.5*({above}+{here}),0.0)*wd+0.5*up*(wi*({by_inc})+wl*({by_side}))"
        parts += [f"{star} AS s_{x}", f"{star}-coalesce(0.5*({here}+{below}),0.0)*wd+0.5*down*(wi*({by_inc})+wl*({by_side})) AS v_{x}"]
        sums.append(f"coalesce(sum(v_{x}) OVER b,0.0) AS t_{x}")
    for name, i, j in zip(_C6, "nnneet", "netett"):
        sums.append(f"coalesce(sum(v_{i}*v_{j}) OVER b,0.0) AS r_{name}")
        totals.append(f"round(sum(CASE WHEN is_random THEN r_{name}+s_{i}*s_{j} ELSE (t_{i}+s_{i})*(t_{j}+s_{j}) END),4) AS {name}")
    return (f"""
vectors AS (SELECT bore_id, seq, code, is_random, {', '.join(parts)} FROM weighted),
summed AS (SELECT *, {', '.join(sums)} FROM vectors WINDOW b AS (PARTITION BY bore_id, code ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
            f"SELECT bore_id, seq, {', '.join(totals)} FROM summed GROUP BY bore_id, seq")


def _iscwsa_sql() -> str:
    """Weights per source as published."""
    sources = {
        "DRFR": (0.35, True, "1.0", "0.0", "0.0"), "DSFS": (0.00056, False, "md", "0.0", "0.0"), "DSTG": (2.5e-7, False, "md*tvd", "0.0", "0.0"),
        "SAG": (0.0035, False, "0.0", "sin(inc)", "0.0"), "XYM1": (0.001, False, "0.0", "abs(sin(inc))", "0.0"),
        "XYM2": (0.001, False, "0.0", "0.0", "-sin(inc)"), "XYM3": (0.001, False, "0.0", "abs(cos(inc))*cos(az)", "-abs(cos(inc))*sin(az)"),
        "XYM4": (0.001, False, "0.0", "abs(cos(inc))*sin(az)", "abs(cos(inc))*cos(az)"), "DEC_U": (0.0063, False, "0.0", "0.0", "sin(inc)"),
        "DBH_U": (3000.0 * 0.0174533, False, "0.0", "0.0", "sin(inc)/(bfield*cos(dip))"),
        "AMID": (0.0061, False, "0.0", "0.0", "sin(inc)*sin(inc)*sin(az-declination)"),
        "ABZ": (0.004, False, "0.0", "-sin(inc)/9.80665", "sin(inc)*tan(dip)*sin(inc)*sin(az-declination)/9.80665"),
        "MBZ": (70.0, False, "0.0", "0.0", "-sin(inc)*sin(inc)*sin(az-declination)/(bfield*cos(dip))"),
    }
    weighted = " UNION ALL ".join(
        f"SELECT *, '{c}' AS code, {r} AS is_random, {m!r}::DOUBLE*({d}) AS wd, {m!r}::DOUBLE*({i}) AS wi, {m!r}::DOUBLE*({a}) AS wl FROM legs"
        for c, (m, r, d, i, a) in sources.items())
    vectors, totals = _source_sums()
    return sql.query(sql.STN, f"""
placed AS (SELECT stn.*, 1.2::DOUBLE+s_nationkey*0.002::DOUBLE AS dip, s_nationkey*0.004::DOUBLE-0.05::DOUBLE AS declination,
  48000.0::DOUBLE+s_nationkey*100.0::DOUBLE AS bfield FROM stn, (SELECT count(*) AS n FROM supplier) c
  LEFT JOIN supplier ON s_suppkey=bore_id%n-(bore_id%n)%5+2),
legs AS (SELECT *, coalesce(md-lag(md) OVER w,0.0) AS up, coalesce(lead(md) OVER w-md,0.0) AS down, lag(inc) OVER w AS pinc, lag(az) OVER w AS paz,
  lead(inc) OVER w AS ninc, lead(az) OVER w AS naz FROM placed {sql.WIN}),
weighted AS ({weighted})""", vectors, select=totals)


def _gyro_sql() -> str:
    """Weights of gyro tools; an interval's visits are numbered, running time is summed within a visit."""
    rate, rest, run = "(7.292115e-5*cos(lat))", (0.0, 0.35), (0.3, 1.5)
    canted = "(inc-CASE WHEN inc>=0.9 THEN 0.3 ELSE 0.0 END)"
    drift = "4.8e-7"
    sources = {  # magnitude, random, interval, depth, inclination, azimuth at rest, growth while running
        "DRFR": ("0.35", True, None, "1.0", "0.0", "0.0", "0.0"),
        "AXYZ_XYB": ("0.005", False, None, "0.0", "cos(inc)/9.80665", "0.0", "0.0"),
        "AXYZ_SF": ("0.0005", False, None, "0.0", "sin(inc)*cos(inc)", "0.0", "0.0"),
        "AXY_B": ("0.004", False, rest, "0.0", f"1/(9.80665*cos({canted}))", "0.0", "0.0"),
        "AXY_SF": ("0.0005", False, (0.0, 1.2), "0.0", f"tan({canted})", "0.0", "0.0"),
        "GXYZ_XYB1": (drift, False, rest, "0.0", "0.0", f"sin(az)*cos(inc)/{rate}", "0.0"),
        "GXYZ_XYRN": (drift, True, rest, "0.0", "0.0", f"0.8*sqrt(1-pow(sin(az)*sin(inc),2))/{rate}", "0.0"),
        "GXYZ_XYG4": (drift, False, rest, "0.0", "0.0", f"sin(az)*sin(inc)*cos(inc)/{rate}", "0.0"),
        "GXYZ_ZB": (drift, False, rest, "0.0", "0.0", f"sin(az)*sin(inc)/{rate}", "0.0"),
        "GXY_B1": (drift, False, rest, "0.0", "0.0", f"sin(az)/(cos(inc)*{rate})", "0.0"),
        "GXY_G2": (drift, False, rest, "0.0", "0.0", f"cos(az)*cos(inc)/{rate}", "0.0"),
        "GXY_SF": ("0.001", False, rest, "0.0", "0.0", "sin(az)*tan(inc)*tan(lat)", "0.0"),
        "GXY_MIS": ("0.0009", False, rest, "0.0", "0.0", "1/(cos(lat)*cos(inc))", "0.0"),
        "EXT_REF": ("0.0087", False, None, "0.0", "0.0", "1.0", "0.0"),
        "EXT_MIS": ("0.001", False, None, "0.0", "0.0", "1/CASE WHEN abs(sin(inc))>1e-6 THEN sin(inc) ELSE 1e-6 END", "0.0"),
        "GXYZ_GD": ("2.4e-6", False, run, "0.0", "0.0", "NULL", "1.0"),
        "GXYZ_RW": ("1.5e-5", False, run, "0.0", "0.0", "NULL", "1.0"),
        "GXY_GD": ("2.4e-6", False, run, "0.0", "0.0", "NULL", "1/sin((inc+pinc)/2)"),
        "GXY_RW": ("1.5e-5", False, run, "0.0", "0.0", "NULL", "1/pow(sin((inc+pinc)/2),2)"),
        "GZ_RW": ("1.5e-5", False, (0.0, 0.8), "0.0", "0.0", "NULL", "1/pow(cos((inc+pinc)/2),2)"),
    }
    rows = " UNION ALL ".join(
        f"SELECT *, '{c}' AS code, {r} AS is_random, {m}::DOUBLE AS mag, {d}::DOUBLE AS dep, {i}::DOUBLE AS incl, {a}::DOUBLE AS azi, "
        f"{g}::DOUBLE AS growth, {a == 'NULL'} AS runs, inc BETWEEN {(ends or (0, 4))[0]} AND {(ends or (0, 4))[1]} AS inside, "
        f"coalesce(pinc BETWEEN {(ends or (0, 4))[0]} AND {(ends or (0, 4))[1]}, false) AS was FROM legs"
        for c, (m, r, ends, d, i, a, g) in sources.items())
    vectors, totals = _source_sums()
    return sql.query(sql.STN, f"""
placed AS (SELECT stn.*, 0.9::DOUBLE+s_nationkey*0.001::DOUBLE AS lat, 0.5::DOUBLE+(s_suppkey%4)*0.1::DOUBLE AS speed
  FROM stn JOIN supplier ON s_suppkey=bore_id%(SELECT count(*) FROM supplier)),
legs AS (SELECT *, coalesce(md-lag(md) OVER w,0.0) AS up, coalesce(lead(md) OVER w-md,0.0) AS down, lag(inc) OVER w AS pinc, lag(az) OVER w AS paz,
  lead(inc) OVER w AS ninc, lead(az) OVER w AS naz FROM placed {sql.WIN}),
met AS ({rows}),
visits AS (SELECT *, sum(CASE WHEN inside AND NOT was THEN 1 ELSE 0 END) OVER w AS visit,
  last_value(CASE WHEN inside THEN azi END IGNORE NULLS) OVER w AS held FROM met WINDOW w AS (PARTITION BY bore_id, code ORDER BY seq)),
timed AS (SELECT *, sum(CASE WHEN inside AND was THEN growth*up/speed ELSE 0.0 END) OVER (PARTITION BY bore_id, code, visit ORDER BY seq) AS ran
  FROM visits),
weighted AS (SELECT *, CASE WHEN inside THEN mag*dep ELSE 0.0 END AS wd, CASE WHEN inside THEN mag*incl ELSE 0.0 END AS wi,
  mag*sin(inc)*coalesce(CASE WHEN NOT runs THEN held WHEN NOT inside THEN 0.0 WHEN code LIKE '%RW' THEN sqrt(ran) ELSE ran END,0.0) AS wl FROM timed)""",
                     vectors, select=totals)


ORACLES = {
    "iscwsa": _iscwsa_sql(),
    "iscwsa_gyro": _gyro_sql(),
    "wolff_dewardt": sql.query(*_WOLFF, select=f"SELECT bore_id, seq, {', '.join(f'round({c},6) AS {c}' for c in _C6)} FROM cov"),
    "unknown_error_codes": """
SELECT s_suppkey AS tool_id, 'XCLA' AS code, 1::BIGINT AS n FROM supplier WHERE s_suppkey%10=2""",
    "infer_error_model": sql.query(sql.MEAS, sql.TOOLS, select="""
SELECT bore_id, coalesce(arg_min(kind, seq), 'WolffDeWardt') AS error_model FROM (SELECT bore_id, seq,
  CASE WHEN model LIKE '%ISCWSA' THEN 'ISCWSA' WHEN model LIKE '%WolffDeWardt' THEN 'WolffDeWardt' END AS kind
  FROM meas LEFT JOIN tools ON tool_id=bore_id%(SELECT count(*) FROM supplier) AND seq>=bore_id%3) GROUP BY 1"""),
    "ensure_covariance": sql.query(sql.MEAS, sql.TOOLS, select="""
SELECT bore_id, status, CASE WHEN status='ok' THEN n ELSE 0 END AS n, CASE WHEN status='ok' THEN n ELSE 0 END AS filled FROM (
  SELECT bore_id, count(*) AS n, CASE WHEN bore_id%6=0 THEN 'ok' WHEN bore_id%13=5 THEN 'no covariance and no survey instrument'
    WHEN bool_and(model='Other') THEN 'unknown survey instrument model'
    WHEN bool_and(tool_id%10=2) THEN 'survey instrument with an unknown error source' ELSE 'ok' END AS status
  FROM meas LEFT JOIN tools ON tool_id=bore_id%(SELECT count(*) FROM supplier) GROUP BY 1)"""),
    "first_station_covariance": sql.query(*_WOLFF, sql.BORES, sql.WELLS, sql.CLUSTERS, HEAD, f"""
slotcov AS (SELECT bore_id, pow({sql.north_of('lat+lat_std')}-{sql.north_of('lat')},2) AS w00,
  pow({sql.east_of('lat', 'lon+lon_std')}-{sql.east_of('lat', 'lon')},2) AS w11, ref_std*ref_std AS w22 FROM head WHERE reason IS NULL)""",
                                        select="SELECT bore_id, seq, " + ", ".join(
        f"round(CASE WHEN seq=0 THEN coalesce({'w' + c[1:] if c in ('c00', 'c11', 'c22') else 'CASE WHEN w00 IS NOT NULL THEN 0.0 END'},"
        f" CASE WHEN bore_id%4<>1 THEN 0.0 END) WHEN bore_id%4<>1 THEN {c} END,4) AS {c}" for c in _C6)
        + " FROM cov LEFT JOIN slotcov USING (bore_id)"),
    "station_ellipses": sql.query(*_WOLFF, select=_ellipse_sql()),
    "quad_form": sql.query(*_WOLFF, select=f"SELECT bore_id, seq, round({sql.quad(*sql.TANGENT)},6) AS variance FROM cov"),
    "extreme_tvd_points": sql.query(*_WOLFF, select=f"""
SELECT bore_id, side, seq, round(north+r*c02,5) AS north, round(east+r*c12,5) AS east, round(tvd+r*c22,5) AS tvd FROM (
  SELECT *, CASE WHEN seq=0 OR c22<=0 THEN 0.0 ELSE side*{K95!r}::DOUBLE/sqrt(c22) END AS r FROM cov, (VALUES (1),(-1)) v(side))"""),
    "envelope_slices": sql.query(SLICES, select=f"SELECT bore_id, slice, seq, part, cap, {_OUT4} FROM numbered"),
    "terminal_cap": sql.query(SLICES, select=f"SELECT bore_id, cap, {_OUT4} FROM numbered WHERE cap>0"),
    "scale_envelope": sql.query(SLICES, _box_sql("5.0::DOUBLE"), select="""
SELECT bore_id, seq, part, cap, round(md2,3) AS md, round(major,3) AS major, round(minor,3) AS minor, round(n_lo,3) AS n_lo,
  round(n_hi,3) AS n_hi, round(e_lo,3) AS e_lo, round(e_hi,3) AS e_hi, round(t_lo,3) AS t_lo, round(t_hi,3) AS t_hi FROM boxed"""),
    "sector_count": sql.query(SLICES, select="""
SELECT bore_id, round(m,4) AS max_semi_axis, CAST(least(greatest(ceil(2*pi()*m/0.5),36),240) AS INTEGER) AS sectors
FROM (SELECT bore_id, max(greatest(r0+a,r0+b)) AS m FROM numbered GROUP BY 1)"""),
    "ellipse_vertices": sql.query(SLICES, select="""
SELECT bore_id, slice, 36::BIGINT AS n, round(north,6) AS centre_north, round(tvd,6) AS centre_tvd,
  round(sqrt(((r0+a)*(r0+a)+(r0+b)*(r0+b))/2),4) AS rms_radius FROM numbered"""),
}
