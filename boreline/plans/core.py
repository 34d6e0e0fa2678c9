"""Survey core: completion, rates, validation, tie-in, sections, spacing."""

from __future__ import annotations

from pyspark.sql import functions as F

from boreline.operators import interp, survey
from boreline.plans import sql
from boreline.sources import derived as D


def min_curvature(spark, sf):
    return D.stations(spark, sf).select("bore_id", "seq", "md", "inc", "az", "north", "east", "tvd")


def rates(spark, sf):
    return D.stations(spark, sf).select("bore_id", "seq", "dls", "bur", "tur")


def vertical_section(spark, sf):
    return D.stations(spark, sf).select("bore_id", "seq", "vsect")


def min_curvature_large(spark, sf):
    return D.large_stations(spark, sf).select("bore_id", "seq", "md", "north", "east", "tvd", "dls")


def _by_method(method):
    def run(spark, sf):
        done = survey.complete_survey(D.measurements(spark, sf).drop("event_id"), method)
        return done.select("bore_id", "seq", "north", "east", "tvd", "vsect")

    return run


def _faulty(spark, sf):
    """Measurements with faults: some depths repeat the previous one, some inclinations are missing."""
    m = D.measurements(spark, sf)
    # inc and az are functions of the unchanged depth, so only the reported depth is faulty
    bad_md = F.when(F.col("event_id") % 97 == 0, F.col("md") - 100.0).otherwise(F.col("md"))
    bad_inc = F.when(F.col("event_id") % 89 == 0, F.lit(float("nan"))).otherwise(F.col("inc"))
    return m.withColumn("md", bad_md).withColumn("inc", bad_inc)


FAULTY = """
faulty AS (SELECT bore_id, event_id, seq, CASE WHEN event_id%97=0 THEN md-100.0 ELSE md END AS md,
  CASE WHEN event_id%89=0 THEN NULL ELSE inc END AS inc, az FROM meas)"""


def validate_measurements(spark, sf):
    return survey.validate_measurements(_faulty(spark, sf))


def usable_source_points(spark, sf):
    faulty = _faulty(spark, sf).select("bore_id", "seq", "md", "inc", "az")
    places = D.stations(spark, sf).select("bore_id", "seq", "north", "east", "tvd")
    joined = faulty.join(places, ["bore_id", "seq"])
    return survey.usable_source_points(joined).select("bore_id", "seq", "md", "inc")


def usable_stations(spark, sf):
    """Stations left when some positions are not numbers and some depths infinite."""
    s = D.stations(spark, sf)
    s = s.withColumns({
        "north": F.when(F.col("seq") % 13 == 5, F.lit(float("nan"))).otherwise(F.col("north")),
        "md": F.when(F.col("seq") % 17 == 5, F.lit(float("inf"))).otherwise(F.col("md")),
    })
    return survey.usable_stations(s).select("bore_id", "seq", "md", "north")


def survey_md_range(spark, sf):
    return survey.survey_md_range(D.measurements(spark, sf))


def md_spacing(spark, sf):
    return survey.md_spacing(_faulty(spark, sf)).select(
        "bore_id", "n_stations", F.round("min_spacing", 4).alias("min_spacing"), F.round("max_spacing", 4).alias("max_spacing")
    )


def estimate_md_step(spark, sf):
    step = survey.estimate_md_step(_faulty(spark, sf))
    return step.select("bore_id", F.round("md_step", 4).alias("md_step"))


def _parent_tie_in(spark, sf):
    return interp.parent_tie_in(D.wellbores(spark, sf), D.stations(spark, sf))


def parent_tie_in(spark, sf):
    return _parent_tie_in(spark, sf).select(
        "bore_id", "md", *[F.round(c, 6).alias(c) for c in ("inc", "az", "north", "east", "tvd")]
    )


PARENT_TIE = ",".join([
    sql.STN, sql.BORES, sql.seg(),
    """
spans AS (SELECT bore_id, min(md) lo, max(md) hi, count(*) n FROM stn GROUP BY 1),
sides AS (SELECT b.bore_id AS child, b.parent_bore_id AS bore_id, b.tie_in_md AS tmd, lo, hi FROM bores b
  JOIN spans s ON s.bore_id=b.parent_bore_id WHERE is_sidetrack AND n>=2),
held AS (SELECT sides.*, least(tmd,hi) AS target_md, seg.* EXCLUDE (bore_id, seq) FROM sides JOIN seg
  ON seg.bore_id=sides.bore_id AND ((tmd>=a_md AND tmd<b_md) OR (tmd>=hi AND b_md=hi))
  WHERE tmd>=lo-1e-6 AND tmd<=hi+10.0)""",
    sql.arc("held", "target_md", "child, tmd", "tie"),
])


def tie_in(spark, sf):
    done = survey.complete_survey(
        survey.apply_tie_in(D.measurements(spark, sf), _tie_rounded(spark, sf))
    )
    return done.select("bore_id", "seq", "md", "north", "east", "tvd")


def _tie_rounded(spark, sf):
    t = _parent_tie_in(spark, sf)
    return t.select("bore_id", "md", *[F.round(c, 6).alias(c) for c in ("inc", "az", "north", "east", "tvd")])


TIED = ",".join([
    PARENT_TIE,
    """
tr AS (SELECT child AS bore_id, tmd AS md, round(inc,6) inc, round(az,6) az, round(north,6) north, round(east,6) east,
  round(tvd,6) tvd FROM tie),
joined AS (SELECT m.*, tr.md AS tie_md, max(m.md) OVER (PARTITION BY m.bore_id)>=tr.md-1e-6 AS has
  FROM meas m LEFT JOIN tr USING (bore_id)),
cut AS (SELECT bore_id, CASE WHEN has THEN seq+1 ELSE seq END AS seq, md, inc, az, north0, east0,
    CASE WHEN seq=0 THEN 0.0::DOUBLE END AS tvd0 FROM joined WHERE tie_md IS NULL OR (has AND md>tie_md+1e-6)
  UNION ALL SELECT bore_id, 0, md, inc, az, north, east, tvd FROM tr WHERE bore_id IN (SELECT bore_id FROM joined WHERE has))""",
    sql.STEPS.replace("FROM meas ", "FROM cut ").replace("lagged", "lagged2").replace("angled", "angled2")
    .replace("stepped", "stepped2").replace("moved", "moved2"),
    sql.PLACED.replace("FROM moved", "FROM moved2").replace("stn AS", "tied AS")
    .replace("CASE WHEN pmd IS NULL THEN 0 ELSE dt END", "CASE WHEN pmd IS NULL THEN coalesce(tvd0,0) ELSE dt END"),
])


def tie_in_relabel(spark, sf):
    return survey.tie_in_relabel(D.wellbores(spark, sf), _deep_start(spark, sf))


def _deep_start(spark, sf):
    """Measurements whose depth starts 100 m deeper, so that some bores start above and some below their tie-in."""
    m = D.measurements(spark, sf)
    return m.withColumn("md", m.md + (m.bore_id % 4) * 100.0)


def _sections(spark, sf):
    """Each path has the lower, middle and upper part of its own wellbore's run, and one run of another wellbore."""
    bores = D.wellbores(spark, sf)
    parts = F.array(*[
        F.struct(F.lit(i).alias("idx"), (F.col("bore_id") + (1 if i == 2 else 0)).alias("run_id"),
                 F.lit(start).alias("start_md"))
        for i, start in enumerate((0.0, 600.0, 1200.0, 1500.0))
    ])
    return bores.select(F.col("bore_id").alias("traj_id"), "bore_id", F.inline(parts))


SECTIONS = """
sections AS (SELECT bore_id AS traj_id, bore_id, i AS idx, bore_id+(CASE WHEN i=2 THEN 1 ELSE 0 END) AS run_id, s AS start_md
  FROM bores, (VALUES (0,0.0::DOUBLE),(1,600.0::DOUBLE),(2,1200.0::DOUBLE),(3,1500.0::DOUBLE)) v(i,s)),
bounded AS (SELECT *, lead(start_md) OVER (PARTITION BY traj_id ORDER BY idx) AS stop_md FROM sections),
picked AS (SELECT s.traj_id, s.bore_id, s.run_id, s.idx, m.seq, m.md, m.inc, m.az FROM bounded s JOIN meas m
  ON m.bore_id=s.bore_id AND m.bore_id=s.run_id WHERE m.md>=start_md-1e-6 AND (stop_md IS NULL OR m.md<stop_md-1e-6)),
joined AS (SELECT *, lag(md) OVER (PARTITION BY traj_id ORDER BY idx, seq) AS pmd FROM picked),
materialized AS (SELECT * EXCLUDE (pmd) FROM joined WHERE pmd IS NULL OR abs(md-pmd)>1e-6)"""


def _run_stations(spark, sf):
    return D.measurements(spark, sf).withColumn("run_id", F.col("bore_id"))


def sections_materialize(spark, sf):
    return survey.materialize_sections(_sections(spark, sf), _run_stations(spark, sf))


def validate_sections(spark, sf):
    sections = _sections(spark, sf).withColumn(
        "start_md", F.when((F.col("idx") == 3) & (F.col("bore_id") % 7 == 0), F.lit(1000.0)).otherwise(F.col("start_md"))
    )
    made = survey.materialize_sections(_sections(spark, sf), _run_stations(spark, sf))
    return survey.validate_sections(sections, made)


def osculating_centre(spark, sf):
    centred = survey.osculating_centre(D.stations(spark, sf))
    return centred.select("bore_id", "seq", *[F.round(c, 3).alias(c) for c in ("xc", "yc", "zc")])


def ewma(spark, sf):
    rows = D.stations(spark, sf).select(
        "bore_id", "seq", F.cos("inc").alias("down"), (F.col("dls") * F.pi()).alias("bend")
    )
    s = survey.ewma(rows, ["down", "bend"], 0.9)
    return s.select("bore_id", "seq", F.round("s_down", 9).alias("s_down"), F.round("s_bend", 12).alias("s_bend"))


def segments(spark, sf):
    seg = survey.segments(D.stations(spark, sf))
    return seg.select("bore_id", "seq", "a_md", "b_md", "n_lo", "n_hi", "e_lo", "e_hi", "t_lo", "t_hi")


def bt_displacement() -> str:
    """Steps of ``lagged`` (pmd, pinc, paz, md, inc, az) with angles linear in depth, in a table ``bt``."""
    turn = sql.wrap_signed("az-paz")
    return f"""
bt0 AS (SELECT *, md-pmd AS ds, inc-pinc AS build, {turn} AS turn FROM lagged),
bt1 AS (SELECT *, build+turn AS p, build-turn AS m, pinc+paz AS s0, inc+paz+turn AS s1, pinc-paz AS d0, inc-paz-turn AS d1 FROM bt0),
bt2 AS (SELECT *, CASE WHEN abs(p)<1e-9 THEN sin(s0) ELSE (cos(s0)-cos(s1))/p END AS ss,
  CASE WHEN abs(m)<1e-9 THEN sin(d0) ELSE (cos(d0)-cos(d1))/m END AS sd,
  CASE WHEN abs(p)<1e-9 THEN cos(s0) ELSE (sin(s1)-sin(s0))/p END AS cs,
  CASE WHEN abs(m)<1e-9 THEN cos(d0) ELSE (sin(d1)-sin(d0))/m END AS cd,
  CASE WHEN abs(build)<1e-9 THEN cos(pinc) ELSE (sin(inc)-sin(pinc))/build END AS dn0 FROM bt1),
bt AS (SELECT *, 0.0 AS dl, 0.5*ds*(ss+sd) AS dn, 0.5*ds*(cd-cs) AS de, ds*dn0 AS dt FROM bt2)"""


def _ct_displacement() -> str:
    north, east, down = [], [], []
    for x, w in survey.GAUSS_16:
        for u in (0.5 * (1.0 + x), 0.5 * (1.0 - x)):
            i = f"(pinc+build*{u!r}::DOUBLE)"
            share = (f"(CASE WHEN pinc>1e-9 AND inc>1e-9 AND abs(build)>1e-9 THEN (ln(tan({i}/2.0))-l1)/(l2-l1) "
                     f"ELSE {u!r}::DOUBLE END)")
            weight = f"{0.5 * w!r}::DOUBLE"
            north.append(f"{weight}*sin({i})*cos(paz+turn*{share})")
            east.append(f"{weight}*sin({i})*sin(paz+turn*{share})")
            down.append(f"{weight}*cos({i})")
    return f"""
ct0 AS (SELECT *, md-pmd AS ds, inc-pinc AS build, {sql.wrap_signed('az-paz')} AS turn, ln(tan(pinc/2.0)) AS l1,
  ln(tan(inc/2.0)) AS l2 FROM lagged),
ct AS (SELECT *, 0.0 AS dl, ds*({'+'.join(north)}) AS dn, ds*({'+'.join(east)}) AS de, ds*({'+'.join(down)}) AS dt FROM ct0)"""


def method_stations(displacement: str, name: str) -> tuple[str, ...]:
    """Stations ``stn`` by the steps of ``name``."""
    lagged = sql.STEPS.split(",\nangled")[0]
    return sql.MEAS, lagged, displacement, sql.PLACED.replace("FROM moved", f"FROM {name}")


def _method_sql(displacement: str, name: str) -> str:
    return sql.query(*method_stations(displacement, name), select="SELECT bore_id, seq, north, east, tvd, vsect FROM stn")


EWMA_SQL = sql.query(
    sql.STN,
    select="""SELECT bore_id, seq, round(s1,9) AS s_down, round(s2,12) AS s_bend FROM walk""",
).replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "\nSELECT bore_id, seq, round(s1",
    """,
walk AS (SELECT bore_id, seq, cos(inc) AS s1, coalesce(dls*pi(),0.0)::DOUBLE AS s2 FROM stn WHERE seq=0
  UNION ALL SELECT t.bore_id, t.seq, 0.9::DOUBLE*cos(t.inc)+(1.0::DOUBLE-0.9::DOUBLE)*w.s1,
    0.9::DOUBLE*t.dls*pi()+(1.0::DOUBLE-0.9::DOUBLE)*w.s2 FROM walk w JOIN stn t ON t.bore_id=w.bore_id AND t.seq=w.seq+1)
SELECT bore_id, seq, round(s1""",
)

CENTRE = f"""
pv AS (SELECT *, lag(md) OVER w AS pmd, lag(inc) OVER w AS i0, lag(az) OVER w AS a0, lag(north) OVER w AS n0,
  lag(east) OVER w AS e0, lag(tvd) OVER w AS t0 FROM stn {sql.WIN}),
dif AS (SELECT *, {sql.dogleg('i0', 'a0', 'inc', 'az')}/(md-pmd) AS kappa, sin(inc)*cos(az)-sin(i0)*cos(a0) AS dx,
  sin(inc)*sin(az)-sin(i0)*sin(a0) AS dy, cos(inc)-cos(i0) AS dz FROM pv),
len AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS l FROM dif)"""

QUERIES = {
    "min_curvature": min_curvature,
    "min_curvature_large": min_curvature_large,
    "complete_survey_bt": _by_method(survey.BUILD_AND_TURN),
    "complete_survey_ct": _by_method(survey.CURVATURE_AND_TOOLFACE),
    "rates": rates,
    "vertical_section": vertical_section,
    "osculating_centre": osculating_centre,
    "ewma": ewma,
    "segments": segments,
    "validate_measurements": validate_measurements,
    "usable_source_points": usable_source_points,
    "usable_stations": usable_stations,
    "survey_md_range": survey_md_range,
    "md_spacing": md_spacing,
    "estimate_md_step": estimate_md_step,
    "parent_tie_in": parent_tie_in,
    "tie_in": tie_in,
    "tie_in_relabel": tie_in_relabel,
    "sections_materialize": sections_materialize,
    "validate_sections": validate_sections,
}

ORACLES = {
    "min_curvature": sql.query(sql.STN, select="SELECT bore_id, seq, md, inc, az, north, east, tvd FROM stn"),
    "min_curvature_large": sql.query(sql.LARGE_STN, select="SELECT bore_id, seq, md, north, east, tvd, dls FROM stn"),
    "complete_survey_bt": _method_sql(bt_displacement(), "bt"),
    "complete_survey_ct": _method_sql(_ct_displacement(), "ct"),
    "rates": sql.query(sql.STN, select="SELECT bore_id, seq, dls, bur, tur FROM stn"),
    "vertical_section": sql.query(sql.STN, select="SELECT bore_id, seq, vsect FROM stn"),
    "osculating_centre": sql.query(sql.STN, CENTRE, select="""
SELECT bore_id, seq, CASE WHEN kappa>1e-12 AND l>1e-12 THEN round(0.5*(north+n0)+dx/l/kappa,3) END AS xc,
  CASE WHEN kappa>1e-12 AND l>1e-12 THEN round(0.5*(east+e0)+dy/l/kappa,3) END AS yc,
  CASE WHEN kappa>1e-12 AND l>1e-12 THEN round(0.5*(tvd+t0)+dz/l/kappa,3) END AS zc FROM len"""),
    "ewma": EWMA_SQL,
    "segments": sql.query(sql.STN, sql.seg(), select="""
SELECT bore_id, seq, a_md, b_md, least(a_north,b_north) n_lo, greatest(a_north,b_north) n_hi, least(a_east,b_east) e_lo,
  greatest(a_east,b_east) e_hi, least(a_tvd,b_tvd) t_lo, greatest(a_tvd,b_tvd) t_hi FROM seg"""),
    "validate_measurements": sql.query(sql.MEAS, FAULTY, select=f"""
SELECT bore_id, n, all_defined, increasing, CASE WHEN NOT all_defined THEN 'undefined value'
  WHEN NOT increasing THEN 'depth not increasing' END AS reason FROM (
  SELECT bore_id, count(*) AS n, bool_and(inc IS NOT NULL) AS all_defined, bool_and(pmd IS NULL OR md>pmd+1e-6) AS increasing
  FROM (SELECT *, lag(md) OVER w AS pmd FROM faulty {sql.WIN}) GROUP BY bore_id)"""),
    "usable_source_points": sql.query(sql.MEAS, FAULTY,
                                      select="SELECT bore_id, seq, md, inc FROM faulty WHERE inc IS NOT NULL"),
    "usable_stations": sql.query(sql.STN, select="SELECT bore_id, seq, md, north FROM stn WHERE seq%13<>5 AND seq%17<>5"),
    "survey_md_range": sql.query(sql.MEAS, select="SELECT bore_id, min(md) start_md, max(md) end_md FROM meas GROUP BY 1"),
    "md_spacing": sql.query(sql.MEAS, FAULTY, select=f"""
SELECT bore_id, count(*) n_stations, round(min(d),4) min_spacing, round(max(d),4) max_spacing
FROM (SELECT bore_id, md-lag(md) OVER w AS d FROM faulty {sql.WIN}) GROUP BY 1"""),
    "estimate_md_step": sql.query(sql.MEAS, FAULTY, select=f"""
SELECT bore_id, round(coalesce(arg_min(d,seq) FILTER (d>0),10.0),4) AS md_step
FROM (SELECT bore_id, seq, md-lag(md) OVER w AS d FROM faulty {sql.WIN}) GROUP BY 1"""),
    "parent_tie_in": sql.query(PARENT_TIE, select="""
SELECT child AS bore_id, tmd AS md, round(inc,6) inc, round(az,6) az, round(north,6) north, round(east,6) east,
  round(tvd,6) tvd FROM tie"""),
    "tie_in": sql.query(TIED, select="SELECT bore_id, seq, md, north, east, tvd FROM tied"),
    "tie_in_relabel": sql.query(sql.MEAS, sql.BORES, select="""
SELECT b.bore_id, parent_bore_id, first_md, CASE WHEN first_md<tie_in_md-1e-6 THEN first_md ELSE tie_in_md END AS tie_in_md
FROM bores b LEFT JOIN (SELECT bore_id, min(md+(bore_id%4)*100.0) AS first_md FROM meas GROUP BY 1) USING (bore_id)
WHERE is_sidetrack"""),
    "sections_materialize": sql.query(sql.MEAS, sql.BORES, SECTIONS, select="SELECT * FROM materialized"),
    "validate_sections": sql.query(sql.MEAS, sql.BORES, SECTIONS, select="""
SELECT traj_id, n_sections, coalesce(n,0) AS n_stations, good AND coalesce(n,0)>=3 AS ok FROM (
  SELECT traj_id, count(*) AS n_sections, bool_and(p IS NULL OR s>p) AS good FROM (
    SELECT *, lag(s) OVER (PARTITION BY traj_id ORDER BY idx) AS p FROM (
      SELECT *, CASE WHEN idx=3 AND bore_id%7=0 THEN 1000.0::DOUBLE ELSE start_md END AS s FROM sections)) GROUP BY 1)
LEFT JOIN (SELECT traj_id, count(*) AS n FROM materialized GROUP BY 1) USING (traj_id)"""),
}
