"""Interpolation, depth lists, samples and sidetrack cuts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from boreline.operators import holes, interp, survey
from boreline.plans import sql
from boreline.plans.core import bt_displacement, method_stations
from boreline.plans.catalog import FILLED, HOLE, INTERNAL
from boreline.sources import derived as D

PLACE = ("north", "east", "tvd", "inc", "az")
ROUNDED = ", ".join(f"round({c},6) AS {c}" for c in PLACE)


def _round(df, digits=6, columns=PLACE):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _probe_depths(spark, sf):
    """Depths every 37 m down each well, some of them past its end."""
    spans = D.measurements(spark, sf).groupBy("bore_id").agg(F.max("md").alias("deep"))
    return spans.select(
        "bore_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("deep") / 37).cast("int") + 2)).alias("k")
    ).select("bore_id", "k", (F.col("k") * 37.0137 + (F.col("bore_id") % 5) * 0.917).alias("md"))


PROBES = """
deeps AS (SELECT bore_id, max(md) deep FROM meas GROUP BY 1),
probes AS (SELECT bore_id, k, k*37.0137::DOUBLE+(bore_id%5)*0.917::DOUBLE AS md FROM (
  SELECT bore_id, unnest(range(0, CAST(floor(deep/37) AS INTEGER)+3)) AS k FROM deeps))"""


def interpolate_station(spark, sf):
    return _round(interp.interpolate_station(_probe_depths(spark, sf), D.stations(spark, sf)))


def interpolate_station_bt(spark, sf):
    """Samples of paths of constant build and turn rates."""
    measured = D.measurements(spark, sf).drop("event_id")
    stations = survey.complete_survey(measured, survey.BUILD_AND_TURN)
    return _round(interp.interpolate_station(_probe_depths(spark, sf), stations, method=survey.BUILD_AND_TURN), 5)


def interpolate_station_ct(spark, sf):
    """Stations read back at their own depths: paths of constant curvature and toolface go through them."""
    measured = D.measurements(spark, sf).drop("event_id")
    stations = survey.complete_survey(measured, survey.CURVATURE_AND_TOOLFACE)
    asked = stations.select("bore_id", "md", "seq", *[F.col(c).alias("own_" + c) for c in PLACE])
    found = interp.interpolate_station(asked, stations, method=survey.CURVATURE_AND_TOOLFACE)
    return found.select("bore_id", "seq", *[F.round(F.abs(F.col(c) - F.col("own_" + c)), 4).alias(c) for c in ("north", "east", "tvd", "inc")])


HELD = """
ends AS (SELECT bore_id, max(md) AS last_md FROM stn GROUP BY 1),
held AS (SELECT p.*, seg.* EXCLUDE (bore_id, seq) FROM probes p JOIN seg USING (bore_id) JOIN ends USING (bore_id)
  WHERE md>=a_md AND (md<b_md OR (b_md=last_md AND md<=b_md+1e-6)))"""


def _cases(spark, sf):
    """One interpolation case per wellbore; a few have no step, or a step of zero."""
    bore = F.col("bore_id")
    step = F.when(bore % 7 == 0, F.lit(None)).when(bore % 7 == 1, F.lit(0.0)).otherwise(10.0 + bore % 4)
    return D.wellbores(spark, sf).select(
        bore.alias("case_id"), "bore_id", step.cast("double").alias("step"),
        F.when(bore % 2 == 0, F.lit(5.5)).alias("reference_depth"),
    )


def _depth_lists(spark, sf):
    spans = D.measurements(spark, sf).groupBy("bore_id").agg(F.min("md").alias("start_md"), F.max("md").alias("end_md"))
    internal = holes.internal_depths(D.hole_sections(spark, sf), D.wellheads(spark, sf), spans)
    user = spans.select(
        "bore_id",
        F.inline(F.array(
            F.struct(F.lit(0).alias("pos"), F.lit(100.25).alias("md"), F.lit("marker").alias("annotation")),
            F.struct(F.lit(1).alias("pos"), F.col("end_md").alias("md"), F.lit("").alias("annotation")),
            F.struct(F.lit(2).alias("pos"), F.lit(100.25).alias("md"), F.lit("again").alias("annotation")),
            F.struct(F.lit(3).alias("pos"), (990.0 + F.col("bore_id") % 4).alias("md"), F.lit(" ").alias("annotation")),
        )),
    )
    user = user.select(F.col("bore_id").alias("case_id"), "bore_id", F.lit(0).alias("source"), "pos", "md", "annotation")
    more = internal.select(
        F.col("bore_id").alias("case_id"), "bore_id", F.lit(1).alias("source"), F.lit(0).alias("pos"),
        F.col("depth").alias("md"), "annotation",
    )
    return user.unionByName(more)


def merge_depths(spark, sf):
    return interp.merge_depths(_depth_lists(spark, sf))


LISTS = """
lists AS (
  SELECT bore_id, 0 AS source, 0 AS pos, 100.25::DOUBLE AS md, 'marker' AS annotation FROM spans
  UNION ALL SELECT bore_id, 0, 1, hi, '' FROM spans UNION ALL SELECT bore_id, 0, 2, 100.25, 'again' FROM spans
  UNION ALL SELECT bore_id, 0, 3, 990.0::DOUBLE+bore_id%4, ' ' FROM spans
  UNION ALL SELECT bore_id, 1, 0, depth, annotation FROM grouped),
merged AS (SELECT bore_id, arg_min(md, source*10+pos) AS md,
  coalesce(arg_min(annotation, source*10+pos) FILTER (trim(annotation)<>''), '') AS annotation
  FROM lists GROUP BY bore_id, round(md/1e-6))"""


def interpolate_grid(spark, sf):
    got = interp.interpolate_grid(_cases(spark, sf), D.stations(spark, sf), merged_depths(spark, sf))
    return _round(got, 6, ("md", *PLACE)).select("case_id", "bore_id", "md", "annotation", *PLACE)


def merged_depths(spark, sf):
    return interp.merge_depths(_depth_lists(spark, sf))


GRID = """
cases AS (SELECT bore_id, CASE WHEN bore_id%7>=2 THEN 10.0::DOUBLE+bore_id%4 END AS step,
  CASE WHEN bore_id%2=0 THEN 5.5::DOUBLE ELSE lo END AS origin, lo, hi FROM bores JOIN spans USING (bore_id)),
grid AS (SELECT bore_id, origin+k*step AS md, NULL AS annotation FROM (SELECT *, unnest(range(
  CAST(ceil((lo-origin)/step-1e-6) AS BIGINT), CAST(floor((hi-origin)/step+1e-6) AS BIGINT)+1)) AS k FROM cases WHERE step>0)),
wanted AS (SELECT bore_id, arg_min(md, CASE WHEN annotation IS NULL THEN 1 ELSE 0 END) AS md, max(annotation) AS annotation
  FROM (SELECT * FROM grid UNION ALL SELECT bore_id, md, annotation FROM merged JOIN spans USING (bore_id)
    WHERE md BETWEEN lo AND hi) GROUP BY bore_id, round(md/1e-6)),
ends AS (SELECT bore_id, max(md) AS last_md FROM stn GROUP BY 1),
held AS (SELECT p.*, seg.* EXCLUDE (bore_id, seq) FROM wanted p JOIN seg USING (bore_id) JOIN ends USING (bore_id)
  WHERE md>=a_md AND (md<b_md OR (b_md=last_md AND md<=b_md)))"""


def _goals(s):
    """Every 90 m of vertical depth of each well, down to its own deepest."""
    return s.groupBy("bore_id").agg(F.max("tvd").alias("deep")).select(
        "bore_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("deep") / 90).cast("int") + 1)).alias("k")
    ).select("bore_id", (F.col("k") * 90.0 + 1.0).alias("target_tvd"))


def _md_at_tvd_by(method):
    def query(spark, sf):
        s = survey.complete_survey(D.measurements(spark, sf).drop("event_id"), method)
        return interp.md_at_tvd(_goals(s), s, method=method).withColumn("md", F.round("md", 4))

    return query


def parent_tie_in_bt(spark, sf):
    """Tie-in stations on parents whose angles are linear in depth."""
    s = survey.complete_survey(D.measurements(spark, sf).drop("event_id"), survey.BUILD_AND_TURN)
    got = interp.parent_tie_in(D.wellbores(spark, sf), s, method=survey.BUILD_AND_TURN)
    return _round(got, 5, PLACE).select("bore_id", "md", *PLACE)


def md_at_tvd(spark, sf):
    """Depths where every well passes each 90 m of vertical depth down to its own deepest."""
    s = D.stations(spark, sf)
    goals = s.groupBy("bore_id").agg(F.max("tvd").alias("deep")).select(
        "bore_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("deep") / 90).cast("int") + 1)).alias("k")
    ).select("bore_id", (F.col("k") * 90.0 + 1.0).alias("target_tvd"))
    return interp.md_at_tvd(goals, s).withColumn("md", F.round("md", 4))


ROUND_TRIP = """
goals AS (SELECT bore_id, k*90.0::DOUBLE+1.0 AS target_tvd FROM (SELECT bore_id,
  unnest(range(0, CAST(floor(max(tvd)/90) AS INTEGER)+2)) AS k FROM stn GROUP BY 1)),
hit AS (SELECT g.*, seg.* EXCLUDE (bore_id) FROM goals g JOIN seg USING (bore_id)
  WHERE target_tvd BETWEEN least(a_tvd,b_tvd) AND greatest(a_tvd,b_tvd)
  QUALIFY row_number() OVER (PARTITION BY bore_id, target_tvd ORDER BY seq)=1),
arcs AS (SELECT *, {dl} AS dl, b_md-a_md AS ds FROM hit),
pq AS (SELECT *, cos(a_inc)*cos(dl)-cos(b_inc) AS p, cos(a_inc)*sin(dl) AS q, (target_tvd-a_tvd)*dl/ds*sin(dl) AS k FROM arcs),
sol AS (SELECT *, atan2(q,p) AS phi, acos(greatest(-1.0,least(1.0,(k+p)/sqrt(p*p+q*q)))) AS w FROM pq),
cand AS (SELECT *, phi-w-2*pi()*round((phi-w-dl/2)/(2*pi())) AS x1, phi+w-2*pi()*round((phi+w-dl/2)/(2*pi())) AS x2 FROM sol)
""".replace("{dl}", sql.dogleg("a_inc", "a_az", "b_inc", "b_az"))


def _with_radius(spark, sf):
    s = D.stations(spark, sf)
    return holes.fill_hole_radius(s, holes.hole_intervals(D.hole_sections(spark, sf), D.wellheads(spark, sf)))


def as_of_sample(spark, sf):
    got = interp.as_of_sample(_probe_depths(spark, sf), _with_radius(spark, sf))
    return _round(got, 6, ("north", "east", "tvd", "hole_radius"))


SAMPLED = """
stnr AS (SELECT s.*, f.hole_radius FROM stn s JOIN filled f USING (bore_id, seq)),
spn AS (SELECT bore_id, md AS a_md, north AS a_n, east AS a_e, tvd AS a_t, hole_radius AS a_r, lead(md) OVER w AS b_md,
  lead(north) OVER w AS b_n, lead(east) OVER w AS b_e, lead(tvd) OVER w AS b_t, lead(hole_radius) OVER w AS b_r
  FROM stnr WINDOW w AS (PARTITION BY bore_id ORDER BY seq))"""


def _sample_sql(points: str, md: str, keys: str, name: str) -> str:
    def value(c: str, mid: str) -> str:
        return f"CASE WHEN abs({md}-a_md)<=1e-6 THEN a_{c} WHEN abs({md}-b_md)<=1e-6 THEN b_{c} ELSE {mid} END"

    def lerp(c: str) -> str:
        return value(c, f"a_{c}+greatest(0,least(1,({md}-a_md)/(b_md-a_md)))*(b_{c}-a_{c})")

    radius = value("r", "CASE WHEN b_md IS NOT NULL THEN greatest(a_r,b_r) END")
    return f"""
{name} AS (SELECT p.*, {lerp('n')} AS north, {lerp('e')} AS east, {lerp('t')} AS tvd, {radius} AS hole_radius
  FROM {points} p LEFT JOIN spn s ON s.bore_id=p.{keys} AND s.a_md<={md}+1e-6 AND ({md}+1e-6<s.b_md OR s.b_md IS NULL))"""


def nearest_station(spark, sf):
    return interp.nearest_station(_probe_depths(spark, sf), D.stations(spark, sf))


def evenly_spaced(spark, sf):
    return interp.evenly_spaced_sample(D.stations(spark, sf), ["bore_id"], ["seq"], 12).select("bore_id", "seq", "md")


def densify_chord_arc(spark, sf):
    got = interp.densify_chord_arc(D.stations(spark, sf), 0.05)
    return _round(got.drop("seq").withColumn("md", F.round("md", 6)))


DENSE = f"""
bent AS (SELECT *, {sql.dogleg('a_inc', 'a_az', 'b_inc', 'b_az')} AS bend FROM seg),
cut AS (SELECT *, CASE WHEN bend>1e-9 THEN greatest(1, ceil(bend/(2*acos(greatest(-1.0,least(1.0,1-0.05/((b_md-a_md)/bend)))))))
  ELSE 1 END AS n FROM bent),
parts AS (SELECT *, a_md+k*(b_md-a_md)/n AS md FROM (SELECT *, unnest(range(1, CAST(n AS BIGINT))) AS k FROM cut))"""


def normalize_sidetrack_import(spark, sf):
    got = interp.normalize_sidetrack_import(D.measurements(spark, sf), D.wellbores(spark, sf))
    return _round(got, 8, ("inc", "az"))


def normalize_sidetrack_run(spark, sf):
    got = interp.normalize_sidetrack_run(D.measurements(spark, sf), D.wellbores(spark, sf))
    return _round(got, 8, ("inc", "az")).withColumn("md", F.round("md", 4))


NORMAL = f"""
prv AS (SELECT *, lag(md) OVER w AS pmd, lag(inc) OVER w AS pinc, lag(az) OVER w AS paz FROM meas {sql.WIN}),
reach AS (SELECT b.bore_id, tie_in_md AS tie FROM bores b JOIN (SELECT bore_id, min(md) lo, max(md) hi FROM meas GROUP BY 1)
  USING (bore_id) WHERE is_sidetrack AND lo<tie_in_md AND hi>tie_in_md),
kept AS (SELECT prv.*, tie FROM prv LEFT JOIN reach USING (bore_id) WHERE tie IS NULL OR md>tie),
normal AS (SELECT bore_id, seq, md, inc, az, NULL::VARCHAR AS annotation, tie FROM kept
  UNION ALL SELECT bore_id, seq-1, tie, pinc+(tie-pmd)/(md-pmd)*(inc-pinc), paz+(tie-pmd)/(md-pmd)*(az-paz),
    'Sidetrack tie-in', tie FROM kept WHERE pmd<=tie)"""


def _sf_points(spark, sf):
    """Profile points per pair: a reference depth every 111 m, some without a comparison depth."""
    spans = D.measurements(spark, sf).groupBy("bore_id").agg(F.max("md").alias("deep"))
    pairs = D.comparison_pairs(spark, sf).filter("ref_id <> cmp_id")
    pts = pairs.join(spans.withColumnRenamed("bore_id", "ref_id"), "ref_id").select(
        "ref_id", "cmp_id", F.explode(F.sequence(F.lit(1), F.floor(F.col("deep") / 111).cast("int"))).alias("seq")
    )
    gone = (F.col("seq") + F.col("cmp_id")) % 5 == 0
    return pts.select(
        "ref_id", "cmp_id", "seq", (F.col("seq") * 111.0137).alias("ref_md"),
        F.when(gone, -1.0).otherwise(F.col("seq") * 107.5173).alias("cmp_md"),
        F.when(gone, 5.0).otherwise(1.0 + F.col("seq") % 7 * 0.25).alias("sf"),
    )


PROFILE = """
deeps AS (SELECT bore_id, max(md) deep FROM meas GROUP BY 1),
sfp AS (SELECT ref_id, cmp_id, seq, seq*111.0137::DOUBLE AS ref_md, CASE WHEN (seq+cmp_id)%5=0 THEN -1.0 ELSE seq*107.5173::DOUBLE END::DOUBLE AS cmp_md,
  CASE WHEN (seq+cmp_id)%5=0 THEN 5.0 ELSE 1.0+seq%7*0.25 END::DOUBLE AS sf FROM (SELECT ref_id, cmp_id,
  unnest(range(1, CAST(floor(deep/111) AS INTEGER)+1)) AS seq FROM pairs JOIN deeps ON deeps.bore_id=ref_id WHERE ref_id<>cmp_id))"""


def sf_profile_distance(spark, sf):
    return _round(interp.sf_profile_distance(_sf_points(spark, sf), _with_radius(spark, sf)), 6,
                  ("centre_distance", "clearance"))


SUB_STEP = f"""
part AS (SELECT *, CASE WHEN b_md>a_md THEN (least(md,b_md)-a_md)/(b_md-a_md) ELSE 0.0 END AS share FROM held),
sublag AS (SELECT bore_id, k, md AS at_md, a_north, a_east, a_tvd, a_md AS pmd, a_inc AS pinc, a_az AS paz, least(md,b_md) AS md,
  a_inc+share*(b_inc-a_inc) AS inc, a_az+share*{sql.wrap_signed('b_az-a_az')} AS az FROM part)"""


def _renamed(steps: str) -> str:
    """The same steps for ``sublag``, in tables of other names."""
    return re.sub(r"\bbt(\d?)\b", r"sub\1", steps).replace("FROM lagged", "FROM sublag")


QUERIES = {
    "interpolate_station": interpolate_station,
    "interpolate_station_bt": interpolate_station_bt,
    "interpolate_station_ct": interpolate_station_ct,
    "merge_depths": merge_depths,
    "interpolate_grid": interpolate_grid,
    "md_at_tvd": md_at_tvd,
    "md_at_tvd_bt": _md_at_tvd_by(survey.BUILD_AND_TURN),
    "md_at_tvd_ct": _md_at_tvd_by(survey.CURVATURE_AND_TOOLFACE),
    "parent_tie_in_bt": parent_tie_in_bt,
    "as_of_sample": as_of_sample,
    "nearest_station": nearest_station,
    "evenly_spaced": evenly_spaced,
    "densify_chord_arc": densify_chord_arc,
    "normalize_sidetrack_import": normalize_sidetrack_import,
    "normalize_sidetrack_run": normalize_sidetrack_run,
    "sf_profile_distance": sf_profile_distance,
}

_ARCH = (sql.BORES, sql.HOLES)

#: Vertical depth is the integral of the cosine of an inclination linear in depth, by both methods.
LEVEL_TRIP = """
goals AS (SELECT bore_id, k*90.0::DOUBLE+1.0 AS target_tvd FROM (SELECT bore_id,
  unnest(range(0, CAST(floor(max(tvd)/90) AS INTEGER)+2)) AS k FROM stn GROUP BY 1)),
hit AS (SELECT g.*, seg.* EXCLUDE (bore_id), b_md-a_md AS ds, b_inc-a_inc AS turn FROM goals g JOIN seg USING (bore_id)
  WHERE target_tvd BETWEEN least(a_tvd,b_tvd) AND greatest(a_tvd,b_tvd)
  QUALIFY row_number() OVER (PARTITION BY bore_id, target_tvd ORDER BY seq)=1),
solved AS (SELECT *, asin(greatest(-1.0,least(1.0,sin(a_inc)+(target_tvd-a_tvd)*turn/ds))) AS up FROM hit),
cand AS (SELECT *, (up-a_inc)/turn AS u1, (pi()-up-a_inc)/turn AS u2 FROM solved)"""

LEVEL_MD = """SELECT bore_id, target_tvd, round(a_md+ds*(CASE WHEN abs(turn)<1e-9 THEN (target_tvd-a_tvd)/(ds*cos(a_inc))
  WHEN u1>=-1e-6 AND u1<=1+1e-6 AND NOT (u2>=-1e-6 AND u2<=1+1e-6 AND u2<u1) THEN u1 ELSE u2 END),4) AS md FROM cand"""

BT_STATIONS = method_stations(bt_displacement(), "bt")

ORACLES = {
    "md_at_tvd_bt": sql.query(*BT_STATIONS, sql.seg(), LEVEL_TRIP, select=LEVEL_MD),
    "md_at_tvd_ct": sql.query(*BT_STATIONS, sql.seg(), LEVEL_TRIP, select=LEVEL_MD),
    "parent_tie_in_bt": sql.query(
        *BT_STATIONS, sql.BORES, sql.seg(), """
ends AS (SELECT bore_id, max(b_md) AS last_md FROM seg GROUP BY 1),
want AS (SELECT b.bore_id AS child, b.tie_in_md, s.*, least(b.tie_in_md, s.b_md) AS at_md FROM bores b
  JOIN seg s ON s.bore_id=b.parent_bore_id JOIN ends e ON e.bore_id=s.bore_id
  WHERE is_sidetrack AND tie_in_md>=a_md AND (tie_in_md<b_md OR (b_md=last_md AND tie_in_md<=b_md+10.0))),
sublag AS (SELECT *, a_md AS pmd, a_inc AS pinc, a_az AS paz, at_md AS md, a_inc+(b_inc-a_inc)*(at_md-a_md)/(b_md-a_md) AS inc,
  a_az+{turn}*(at_md-a_md)/(b_md-a_md) AS az FROM want)""".replace("{turn}", sql.wrap_signed("b_az-a_az")),
        _renamed(bt_displacement()), select=f"""
SELECT child AS bore_id, tie_in_md AS md, round(inc,5) AS inc, round({sql.wrap('az')},5) AS az, round(a_north+dn,5) AS north,
  round(a_east+de,5) AS east, round(a_tvd+dt,5) AS tvd FROM sub"""),
    "interpolate_station": sql.query(
        sql.STN, PROBES, sql.seg(), HELD, sql.arc("held", "least(md,b_md)", "bore_id, k, md"),
        select=f"SELECT bore_id, k, md, {ROUNDED} FROM arc"),
    "interpolate_station_bt": sql.query(
        *method_stations(bt_displacement(), "bt"), PROBES, sql.seg(), HELD, SUB_STEP, _renamed(bt_displacement()),
        select=f"""
SELECT bore_id, k, at_md AS md, round(a_north+dn,5) AS north, round(a_east+de,5) AS east, round(a_tvd+dt,5) AS tvd,
  round(inc,5) AS inc, round({sql.wrap('az')},5) AS az FROM sub"""),
    "interpolate_station_ct": sql.query(sql.MEAS, select="""
SELECT bore_id, seq, 0.0::DOUBLE AS north, 0.0::DOUBLE AS east, 0.0::DOUBLE AS tvd, 0.0::DOUBLE AS inc FROM meas"""),
    "merge_depths": sql.query(sql.MEAS, *_ARCH, INTERNAL, LISTS,
                              select="SELECT bore_id AS case_id, bore_id, md, annotation FROM merged"),
    "interpolate_grid": sql.query(
        sql.STN, *_ARCH, INTERNAL, LISTS, sql.seg(), GRID, sql.arc("held", "md", "bore_id, md, annotation"),
        select=f"SELECT bore_id AS case_id, bore_id, round(md,6) AS md, annotation, {ROUNDED} FROM arc"),
    "md_at_tvd": sql.query(sql.STN, sql.seg(), ROUND_TRIP, select="""
SELECT bore_id, target_tvd, round(a_md+ds/dl*(CASE WHEN x1>=-1e-7 AND x1<=dl+1e-7 AND NOT (x2>=-1e-7 AND x2<=dl+1e-7 AND x2<x1)
  THEN x1 ELSE x2 END),4) AS md FROM cand"""),
    "as_of_sample": sql.query(
        sql.STN, *_ARCH, HOLE, FILLED, PROBES, SAMPLED, _sample_sql("probes", "md", "bore_id", "got"), select="""
SELECT bore_id, k, md, round(north,6) AS north, round(east,6) AS east, round(tvd,6) AS tvd, round(hole_radius,6) AS hole_radius
FROM got"""),
    "nearest_station": sql.query(sql.STN, PROBES, select="""
SELECT p.bore_id, p.k, p.md, s.seq, s.md AS station_md FROM probes p JOIN stn s USING (bore_id)
QUALIFY row_number() OVER (PARTITION BY p.bore_id, p.k ORDER BY abs(s.md-p.md), s.seq)=1"""),
    "evenly_spaced": sql.query(sql.STN, """
counted AS (SELECT *, count(*) OVER (PARTITION BY bore_id) AS n FROM stn),
wanted AS (SELECT DISTINCT bore_id, CAST(round_even(i*(n-1)/11.0::DOUBLE,0) AS BIGINT) AS seq
  FROM (SELECT DISTINCT bore_id, n FROM counted), range(12) r(i))""", select="""
SELECT bore_id, seq, md FROM counted WHERE n<=12 OR seq=n-1 OR (bore_id, seq) IN (SELECT bore_id, seq FROM wanted)"""),
    "densify_chord_arc": sql.query(
        sql.STN, sql.seg(), DENSE, sql.arc("parts", "md", "bore_id, md"), select=f"""
SELECT bore_id, round(md,6) AS md, {ROUNDED} FROM (SELECT bore_id, md, north, east, tvd, inc, az FROM stn
UNION ALL SELECT bore_id, md, north, east, tvd, inc, az FROM arc)"""),
    "normalize_sidetrack_import": sql.query(sql.MEAS, sql.BORES, NORMAL, select="""
SELECT bore_id, seq, md, round(inc,8) AS inc, round(az,8) AS az, annotation FROM normal"""),
    "normalize_sidetrack_run": sql.query(sql.MEAS, sql.BORES, NORMAL, select="""
SELECT bore_id, seq, round(md-coalesce(tie,0.0),4) AS md, round(inc,8) AS inc, round(az,8) AS az, annotation FROM normal"""),
    "sf_profile_distance": sql.query(
        sql.STN, *_ARCH, sql.PAIRS, HOLE, FILLED, SAMPLED, PROFILE,
        _sample_sql("sfp", "ref_md", "ref_id", "rs"), _sample_sql("sfp", "cmp_md", "cmp_id", "cs"), select="""
SELECT ref_id, cmp_id, seq, ref_md, cmp_md, sf, CASE WHEN sf<5 OR cmp_md<>-1 THEN round(d,6) END AS centre_distance,
  CASE WHEN sf<5 OR cmp_md<>-1 THEN round(d-rr-cr,6) END AS clearance FROM (
  SELECT rs.ref_id, rs.cmp_id, rs.seq, rs.ref_md, rs.cmp_md, rs.sf, rs.hole_radius AS rr, cs.hole_radius AS cr,
  sqrt((rs.north-cs.north)*(rs.north-cs.north)+(rs.east-cs.east)*(rs.east-cs.east)+(rs.tvd-cs.tvd)*(rs.tvd-cs.tvd)) AS d
  FROM rs JOIN cs USING (ref_id, cmp_id, seq))"""),
}
