"""Coarsening, section fitting and realizations."""

from __future__ import annotations

from pyspark.sql import functions as F

from boreline.functions import blocks as B
from boreline.operators import fitting, sequence, survey
from boreline.plans import sql
from boreline.plans.uncertainty import covered_stations
from boreline.sources import derived as D


def _out(df, digits=5):
    return df.withColumns({c: F.round(c, digits) for c in ("north", "east", "tvd") if c in df.columns})


def coarsen_minimum_curvature(spark, sf):
    return sequence.coarsen_minimum_curvature(D.stations(spark, sf), 0.1).select("bore_id", "seq", "md")


def coarsen_circular(spark, sf):
    return sequence.coarsen_circular(D.stations(spark, sf), 0.1).select("bore_id", "seq", "md")


#: Standard deviation, in radians per metre, that curvature may have within a period.
SPREAD = 0.0002


def _smoothed(spark, sf):
    return survey.ewma(D.stations(spark, sf).select("bore_id", "seq", "dls"), ["dls"]).select("bore_id", "seq", "s_dls")


def constant_periods(spark, sf):
    got = fitting.constant_periods_of(_smoothed(spark, sf), "s_dls", SPREAD)
    return got.select("bore_id", "start", "end", F.round(F.col("mean") * F.pi(), 9).alias("mean"), "shared")


def equivalence_labels(spark, sf):
    got = fitting.label_periods(_smoothed(spark, sf), "s_dls", SPREAD)
    return got.select("bore_id", "seq", "label", F.round(F.col("mean") * F.pi(), 9).alias("mean"))


def repeated_labels(spark, sf):
    return fitting.label_periods(_smoothed(spark, sf), "s_dls", SPREAD, repeat_shared=True).select("bore_id", "seq", "label")


def fit_sections(spark, sf):
    got = sequence.fit_sections(D.stations(spark, sf))
    return got.select("bore_id", "section_index", "type", "start_md", "end_md", F.round("first", 9).alias("first"),
                      F.round("second", 6).alias("second"))


def section_chain(spark, sf):
    got = sequence.section_chain(B.durable(sequence.fit_sections(D.stations(spark, sf))))
    return got.select("bore_id", "section_index", F.round("gap", 6).alias("gap"))


def section_points(spark, sf):
    got = sequence.section_points(sequence.fit_sections(D.stations(spark, sf)))
    return _out(got).select("bore_id", "section_index", F.round("md", 4).alias("md"), "north", "east", "tvd")


def section_distance(spark, sf):
    s = B.durable(D.stations(spark, sf))
    got = sequence.section_distance(sequence.coarsen_circular(s, 0.1), sequence.fit_sections(s))
    return got.select("bore_id", "seq", "section_index", "type", F.round("distance", 4).alias("distance"))


def aggregation_case(spark, sf):
    cases = D.wellbores(spark, sf).select((F.col("bore_id") % 7).alias("case_id"), "bore_id")
    got = sequence.aggregation_case(cases, B.durable(D.stations(spark, sf)))
    return got.withColumns({c: F.round(c, 4) for c in ("worst_distance", "mean_distance")})


def _cases(spark, sf):
    return D.wellbores(spark, sf).select(
        F.col("bore_id").alias("case_id"), "bore_id", F.when(F.col("bore_id") % 50 == 49, 0).otherwise(100).alias("realizations"),
        F.lit(0.1).alias("coarsening"), (F.col("bore_id") * 17 + 5).alias("seed"),
    )


def validate_realization_inputs(spark, sf):
    s = covered_stations(spark, sf).withColumn("c00", F.when(F.col("bore_id") % 20 == 7, -1.0).otherwise(F.col("c00")))
    return sequence.validate_realization_inputs(_cases(spark, sf), s).select("case_id", "bore_id", "reason")


def realize(spark, sf):
    got = sequence.realize(_cases(spark, sf), covered_stations(spark, sf))
    return _out(got, 4).select("case_id", "realization", "seq", F.round("md", 4).alias("md"), "north", "east", "tvd", "status", "reason")


def _coarsening_sql(far: str) -> str:
    """Greedy walks by a table ``far`` of the stations (i) too far from the arc from s to e: every end is tried."""
    return sql.query(sql.STN, f"""
st AS (SELECT *, sin(inc)*cos(az) AS tn, sin(inc)*sin(az) AS te, cos(inc) AS tt FROM stn),
ends AS (SELECT a.bore_id, a.seq AS s, b.seq AS e, b.md-a.md AS len, a.md AS md0, a.north AS n0, a.east AS e0, a.tvd AS t0,
  a.tn AS xn, a.te AS xe, a.tt AS xt, b.tn AS yn, b.te AS ye, b.tt AS yt, b.north-a.north AS cn, b.east-a.east AS ce, b.tvd-a.tvd AS ct
  FROM st a JOIN st b ON b.bore_id=a.bore_id AND b.seq>a.seq+1),
{far},
failing AS (SELECT bore_id, s, min(e) AS e FROM far WHERE off>0.1 GROUP BY 1, 2),
lasts AS (SELECT bore_id, max(seq) AS last FROM st GROUP BY 1),
following AS MATERIALIZED (SELECT st.bore_id, st.seq AS s, coalesce(f.e-1, last) AS t FROM st JOIN lasts USING (bore_id)
  LEFT JOIN failing f ON f.bore_id=st.bore_id AND f.s=st.seq WHERE st.seq<last),
kept AS (SELECT DISTINCT bore_id, 0::BIGINT AS seq FROM st
  UNION ALL SELECT k.bore_id, f.t FROM kept k JOIN following f ON f.bore_id=k.bore_id AND f.s=k.seq)""",
                     select="SELECT bore_id, seq, md FROM kept JOIN st USING (bore_id, seq)").replace("WITH ", "WITH RECURSIVE ", 1)


FAR_BY_DEPTH = f"""
bent AS (SELECT *, 2*asin(least(1.0,0.5*sqrt(pow(yn-xn,2)+pow(ye-xe,2)+pow(yt-xt,2)))) AS dl FROM ends),
inner1 AS (SELECT b.*, (i.md-md0)/len AS u, i.north-n0 AS dn, i.east-e0 AS de, i.tvd-t0 AS dt
  FROM bent b JOIN st i ON i.bore_id=b.bore_id AND i.seq>s AND i.seq<e),
inner2 AS (SELECT *, CASE WHEN dl<1e-9 THEN 1-u ELSE sin((1-u)*dl)/sin(dl) END AS w1, CASE WHEN dl<1e-9 THEN u ELSE sin(u*dl)/sin(dl) END AS w2,
  u*dl AS udl FROM inner1),
inner3 AS (SELECT *, w1*xn+w2*yn AS zn, w1*xe+w2*ye AS ze, w1*xt+w2*yt AS zt, 0.5*u*len*{sql.ratio('udl')} AS half FROM inner2),
inner4 AS (SELECT *, sqrt(zn*zn+ze*ze+zt*zt) AS z FROM inner3),
far AS (SELECT bore_id, s, e, sqrt(pow(half*(xn+zn/z)-dn,2)+pow(half*(xe+ze/z)-de,2)+pow(half*(xt+zt/z)-dt,2)) AS off FROM inner4)"""

FAR_BY_PLACE = """
chord AS (SELECT *, cn*xn+ce*xe+ct*xt AS along, cn*cn+ce*ce+ct*ct AS size2 FROM ends),
side AS (SELECT *, cn-along*xn AS sn, ce-along*xe AS se, ct-along*xt AS st FROM chord),
bent AS (SELECT *, sqrt(sn*sn+se*se+st*st) AS away, 2*sqrt(sn*sn+se*se+st*st)/size2 AS k FROM side),
inner1 AS (SELECT b.*, i.north-n0 AS dn, i.east-e0 AS de, i.tvd-t0 AS dt FROM bent b JOIN st i ON i.bore_id=b.bore_id AND i.seq>s AND i.seq<e),
inner2 AS (SELECT *, dn*xn+de*xe+dt*xt AS x, (dn*sn+de*se+dt*st)/away AS y FROM inner1),
inner3 AS (SELECT *, atan2(x*k,1-y*k)/k AS foot, sqrt(greatest(dn*dn+de*de+dt*dt-x*x-y*y,0.0)) AS off_plane,
  sqrt(pow(sin(len*k)/k-x,2)+pow((1-cos(len*k))/k-y,2)+greatest(dn*dn+de*de+dt*dt-x*x-y*y,0.0)) AS from_end FROM inner2),
inner4 AS (SELECT *, CASE WHEN foot>=0 AND foot<=len THEN foot WHEN from_end<sqrt(dn*dn+de*de+dt*dt) THEN len ELSE 0.0 END AS place FROM inner3),
far AS (SELECT bore_id, s, e, sqrt(pow(sin(place*k)/k-x,2)+pow((1-cos(place*k))/k-y,2)+off_plane*off_plane) AS off FROM inner4)"""

PERIODS = sql.query(sql.STN, f"""
smooth AS (SELECT bore_id, seq, 0.0::DOUBLE AS x FROM stn WHERE seq=0
  UNION ALL SELECT t.bore_id, t.seq, 0.9::DOUBLE*t.dls+(1.0::DOUBLE-0.9::DOUBLE)*w.x FROM smooth w JOIN stn t ON t.bore_id=w.bore_id AND t.seq=w.seq+1),
runs AS (SELECT a.bore_id, a.seq AS s, b.seq AS e, var_pop(b.x) OVER v AS var, avg(b.x) OVER v AS mean
  FROM smooth a JOIN smooth b ON b.bore_id=a.bore_id AND b.seq>=a.seq WINDOW v AS (PARTITION BY a.bore_id, a.seq ORDER BY b.seq)),
longest AS (SELECT bore_id, s, max(e) AS e, arg_max(mean, e) AS mean FROM runs WHERE e>s AND var<{SPREAD * SPREAD!r}::DOUBLE GROUP BY 1, 2),
following AS MATERIALIZED (SELECT m.bore_id, m.seq AS s, coalesce(l.e, m.seq+1) AS t, l.e IS NOT NULL AS is_period, l.mean
  FROM smooth m LEFT JOIN longest l ON l.bore_id=m.bore_id AND l.s=m.seq),
visited AS (SELECT DISTINCT bore_id, 0::BIGINT AS s, false AS shared FROM smooth
  UNION ALL SELECT v.bore_id, f.t, f.is_period FROM visited v JOIN following f ON f.bore_id=v.bore_id AND f.s=v.s),
periods AS (SELECT f.bore_id, f.s AS start, f.t AS stop, f.mean, v.shared FROM visited v JOIN following f ON f.bore_id=v.bore_id AND f.s=v.s WHERE is_period),
covered AS (SELECT m.bore_id, m.seq, count(p.start) AS n, arg_max(p.mean, p.start) AS mean,
  coalesce(max(m.seq-p.start-CASE WHEN p.shared THEN 1 ELSE 0 END), 0) AS since
  FROM smooth m LEFT JOIN periods p ON p.bore_id=m.bore_id AND m.seq BETWEEN p.start AND p.stop GROUP BY 1, 2),
labels AS (SELECT bore_id, seq, n, mean, CAST(sum(CASE WHEN since<=0 AND seq>0 THEN 1 ELSE 0 END) {sql.RUN} AS BIGINT) AS label FROM covered),
doubled AS (SELECT bore_id, row_number() OVER (PARTITION BY bore_id ORDER BY seq, again)-1 AS seq, label+again AS label
  FROM labels JOIN (VALUES (0), (1)) r(again) ON again=0 OR n>1)""", select="").replace("WITH ", "WITH RECURSIVE ", 1)

QUERIES = {
    "constant_periods": constant_periods,
    "equivalence_labels": equivalence_labels,
    "repeated_labels": repeated_labels,
    "coarsen_minimum_curvature": coarsen_minimum_curvature,
    "coarsen_circular": coarsen_circular,
    "fit_sections": fit_sections,
    "section_chain": section_chain,
    "section_points": section_points,
    "section_distance": section_distance,
    "aggregation_case": aggregation_case,
    "validate_realization_inputs": validate_realization_inputs,
    "realize": realize,
}

ORACLES = {
    "constant_periods": PERIODS + 'SELECT bore_id, start, stop AS "end", round(mean*pi(),9) AS mean, shared FROM periods',
    "equivalence_labels": PERIODS + "SELECT bore_id, seq, label, round(mean*pi(),9) AS mean FROM labels",
    "repeated_labels": PERIODS + "SELECT d.bore_id, d.seq, d.label FROM doubled d JOIN smooth USING (bore_id, seq)",
    "coarsen_minimum_curvature": _coarsening_sql(FAR_BY_DEPTH),
    "coarsen_circular": _coarsening_sql(FAR_BY_PLACE),
    "validate_realization_inputs": """
SELECT DISTINCT user_id AS case_id, user_id AS bore_id, CASE WHEN user_id%50=49 THEN 'realization count must be between 1 and 1000'
  WHEN user_id%20=7 THEN 'covariance with a negative eigenvalue' END AS reason FROM events""",
}
