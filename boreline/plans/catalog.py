"""Catalogue, hierarchy, architecture and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from boreline.operators import catalog, hierarchy, holes, survey
from boreline.plans import sql
from boreline.sources import derived as D


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- hierarchy ---------------------------------------------------------------------------------------------------


def root_wellbore(spark, sf):
    return hierarchy.root_wellbore(D.wellbores(spark, sf))


def wellbore_depth_path(spark, sf):
    return hierarchy.wellbore_depth_path(D.wellbores(spark, sf))


CLIMB = """
RECURSIVE_PLACEHOLDER up(bore_id, at_id, depth, path) AS (
  SELECT bore_id, bore_id, 0, name FROM bores
  UNION ALL SELECT u.bore_id, p.bore_id, u.depth+1, p.name||'/'||u.path FROM up u JOIN bores c ON c.bore_id=u.at_id
  JOIN bores p ON p.bore_id=c.parent_bore_id)"""


def _recursive(*parts: str, select: str) -> str:
    text = sql.query(*parts, select=select)
    return text.replace("RECURSIVE_PLACEHOLDER ", "").replace("WITH ", "WITH RECURSIVE ", 1)


def wellhead_reference(spark, sf):
    return hierarchy.wellhead_reference(D.wellbores(spark, sf), D.wells(spark, sf), D.clusters(spark, sf))


HEAD = """
chain AS (SELECT b.bore_id, b.well_id, w.well_id AS has_well, w.cluster_id, w.slot_id, c.cluster_id AS has_cluster, c.field_id,
  c.ref_mean, c.ref_std, s.slot_id AS has_slot, s.lat, s.lon, s.lat_std, s.lon_std
  FROM bores b LEFT JOIN wells w USING (well_id) LEFT JOIN clusters c ON c.cluster_id=w.cluster_id
  LEFT JOIN slots s ON s.cluster_id=w.cluster_id AND s.slot_id=w.slot_id),
head AS (SELECT *, CASE WHEN has_well IS NULL OR cluster_id IS NULL THEN 'well missing or without cluster or slot'
  WHEN has_cluster IS NULL OR has_slot IS NULL THEN 'cluster missing or without the slot' END AS reason FROM chain)"""


def wellhead_covariance(spark, sf):
    ref = hierarchy.wellhead_reference(D.wellbores(spark, sf), D.wells(spark, sf), D.clusters(spark, sf))
    return _rounded(hierarchy.wellhead_covariance(ref), 4, "c00", "c11", "c22")


def slot_lookup(spark, sf):
    return hierarchy.slot_lookup(D.wells(spark, sf), D.clusters(spark, sf))


def reference_location(spark, sf):
    return hierarchy.reference_location(D.wellbores(spark, sf), D.wells(spark, sf), D.clusters(spark, sf))


def reference_offsets(spark, sf):
    got = hierarchy.reference_offsets(
        D.wellbores(spark, sf), D.wells(spark, sf), D.clusters(spark, sf), D.rigs(spark, sf)
    )
    return _rounded(got, 3, "wellhead_north", "wellhead_east", "cluster_north", "cluster_east")


def resolve_depth_offset(spark, sf):
    bores = D.wellbores(spark, sf)
    names = F.array(*[F.lit(n) for n in ("Ground/Mud line", "MSL", "Sea water level", "Rotary table")])
    asked = bores.select(
        "bore_id", F.explode(names).alias("depth_reference"), (F.col("bore_id") * 0.5).alias("sea_level_offset")
    )
    got = hierarchy.resolve_depth_offset(asked, bores, D.wells(spark, sf), D.clusters(spark, sf), D.rigs(spark, sf))
    return got.select("bore_id", "depth_reference", "offset")


def sidetrack_pairs(spark, sf):
    pairs = catalog.select_comparisons(D.comparison_pairs(spark, sf))
    m = D.measurements(spark, sf)
    ranges = m.groupBy("bore_id").agg(F.min("md").alias("start_md"), F.max("md").alias("end_md"))
    return hierarchy.sidetrack_pairs(pairs, D.wellbores(spark, sf), ranges)


def select_comparisons(spark, sf):
    pairs = D.comparison_pairs(spark, sf)
    return catalog.select_comparisons(pairs.unionByName(pairs))


def parent_run_candidates(spark, sf):
    m = D.measurements(spark, sf)
    spans = m.groupBy("bore_id").agg(F.min("md").alias("first_md"), F.max("md").alias("last_md"))
    rows = spans.select(F.col("bore_id").alias("row_id"), "bore_id", "first_md")
    half = F.struct(F.lit(0).alias("part"), F.col("first_md").alias("lo"), (F.col("last_md") / 2).alias("hi"))
    rest = F.struct(F.lit(1).alias("part"), (F.col("last_md") / 2).alias("lo"), F.col("last_md").alias("hi"))
    runs = spans.select("bore_id", F.inline(F.array(half, rest))).select(
        (F.col("bore_id") * 2 + F.col("part")).alias("run_id"), "bore_id", F.col("lo").alias("first_md"),
        F.col("hi").alias("last_md"),
    )
    return hierarchy.parent_run_candidates(rows, D.wellbores(spark, sf), runs)


# --- architecture ------------------------------------------------------------------------------------------------


def _intervals(spark, sf):
    return holes.hole_intervals(D.hole_sections(spark, sf), D.wellheads(spark, sf))


def hole_intervals(spark, sf):
    return _rounded(_intervals(spark, sf), 6, "radius").select("bore_id", "kind", "start_md", "end_md", "radius")


HOLE = """
surf AS (SELECT bore_id, kind, wellhead_md-sum(length) OVER (PARTITION BY bore_id)
    +sum(length) OVER (PARTITION BY bore_id ORDER BY pos) AS end_md, length, diameter FROM holes JOIN heads USING (bore_id)
  WHERE kind='surface'),
cas AS (SELECT bore_id, section, top_md, length AS clen FROM holes WHERE kind='casing'),
siz AS (SELECT bore_id, kind, c.top_md+sum(length) OVER (PARTITION BY bore_id, section ORDER BY pos) AS end_md, length, diameter
  FROM holes h JOIN cas c USING (bore_id, section) WHERE kind='size'),
el AS (SELECT bore_id, section, sum(length) AS elen FROM holes WHERE kind='element' GROUP BY 1,2),
opn AS (SELECT bore_id, kind, c.top_md+elen+sum(length) OVER (PARTITION BY bore_id, section ORDER BY pos) AS end_md, length, diameter
  FROM holes h JOIN cas c USING (bore_id, section) JOIN el USING (bore_id, section) WHERE kind='open'),
ivl AS (SELECT bore_id, kind, end_md-length AS start_md, end_md, diameter*0.5::DOUBLE AS radius FROM (
  SELECT * FROM surf UNION ALL SELECT * FROM siz UNION ALL SELECT * FROM opn))"""

FILLED = """
filled AS (SELECT m.bore_id, m.seq, max(radius) AS hole_radius FROM meas m LEFT JOIN ivl i ON i.bore_id=m.bore_id
  AND m.md>=start_md-1e-6 AND m.md<=end_md+1e-6 GROUP BY 1,2)"""


def fill_hole_radius(spark, sf):
    m = D.measurements(spark, sf).select("bore_id", "seq", "md")
    return _rounded(holes.fill_hole_radius(m, _intervals(spark, sf)), 6, "hole_radius")


def hole_radius_coverage(spark, sf):
    m = D.measurements(spark, sf).select("bore_id", "seq", "md")
    return holes.hole_radius_coverage(holes.fill_hole_radius(m, _intervals(spark, sf)))


def radius_by_similar_name(spark, sf):
    paths = D.table(spark, sf, "part").select(
        F.col("p_partkey").alias("traj_id"), F.col("p_partkey").alias("bore_id"),
        F.concat(F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, F.lit(" MIA")).otherwise(F.lit("_extrapolated")))
        .alias("name"),
    )
    owned = paths.filter(F.col("bore_id") % 3 == 0).select("bore_id")
    return holes.radius_by_similar_name(paths, owned)


def internal_depths(spark, sf):
    spans = D.measurements(spark, sf).groupBy("bore_id").agg(F.min("md").alias("start_md"), F.max("md").alias("end_md"))
    return holes.internal_depths(D.hole_sections(spark, sf), D.wellheads(spark, sf), spans)


INTERNAL = """
spans AS (SELECT bore_id, min(md) lo, max(md) hi FROM meas GROUP BY 1),
raw_depths AS (
  SELECT bore_id, lo AS depth, NULL::VARCHAR AS annotation, 0 AS rank FROM spans
  UNION ALL SELECT bore_id, hi, NULL, 1 FROM spans
  UNION ALL SELECT bore_id, top_md+length, 'Casing shoe 13.375 in', 2 FROM holes WHERE kind='casing'
  UNION ALL SELECT bore_id, hanger_md, 'Casing hanger 13.375 in', 3 FROM heads WHERE hanger_md IS NOT NULL
  UNION ALL SELECT bore_id, top_md+700, 'Casing size 13.375 in x 9.625 in', 4 FROM holes WHERE kind='casing'),
grouped AS (SELECT bore_id, round(depth/1e-6) q, arg_min(depth, rank) AS depth, arg_min(annotation, rank) AS annotation
  FROM raw_depths GROUP BY 1,2)"""


# --- catalogue ---------------------------------------------------------------------------------------------------


def single_definitive(spark, sf):
    done = catalog.enforce_single_definitive(D.trajectories(spark, sf))
    return done.select("traj_id", "bore_id", "type", "is_definitive")


def filter_catalog(spark, sf):
    return catalog.filter_catalog(
        D.trajectories(spark, sf), type="Measured", is_definitive=True, field_id=None, well_id=catalog.NO_ID
    ).select("traj_id", "bore_id", "type", "name")


def filter_and_sort_by_name(spark, sf):
    return catalog.filter_and_sort_by_name(D.trajectories(spark, sf), type="Planned").select("traj_id", "name", "type")


def _runs(spark, sf):
    """One survey run per order, some with empty or missing ids."""
    o = D.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.when(k % 53 != 0, k.cast("string")).alias("run_id"), F.col("o_custkey").alias("bore_id"),
        F.when(k % 47 == 0, catalog.NO_ID).otherwise((k % 10).cast("string")).alias("instrument_id"),
        F.when(k % 2 == 0, "Actual").otherwise("Planned").alias("run_type"), k.alias("k"),
    )


def filter_survey_runs(spark, sf):
    got = catalog.filter_survey_runs(_runs(spark, sf), instrument_id="3", run_type="Planned", bore_id=None)
    return got.select("k", "bore_id", "instrument_id", "run_type")


def validate_run_metadata(spark, sf):
    return survey.validate_run_metadata(_runs(spark, sf)).select("k", "reason")


def search_text(spark, sf):
    named = catalog.enrich_names(
        D.trajectories(spark, sf),
        D.table(spark, sf, "customer").select(F.col("c_custkey").alias("bore_id"), F.col("c_name").alias("name")),
        "bore_id", "bore_name",
    )
    return catalog.search_text(named, "uRgENT", ["name", "description", "bore_name", "type"]).select(
        "traj_id", "name", "bore_name"
    )


def project_light(spark, sf):
    return catalog.project_light(D.trajectories(spark, sf), ["traj_id", "name", "type", "is_definitive", "modified"])


def list_ids(spark, sf):
    return catalog.list_ids(D.trajectories(spark, sf), "traj_id")


def scan_by_ids(spark, sf):
    """Paths asked for by line item, in order of line item; some of the ids do not exist."""
    asked = D.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("pos"), (F.col("l_orderkey") * 2).alias("traj_id")
    ).distinct()
    return catalog.scan_by_ids(D.trajectories(spark, sf), asked, "traj_id").select("pos", "traj_id", "bore_id", "type")


def scan_by_wellbore(spark, sf):
    return catalog.scan_by_wellbore(D.trajectories(spark, sf)).select("bore_id", "traj_id", "type", "is_definitive")


def restrict_to_requested(spark, sf):
    asked = D.table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("bore_id")
    )
    return catalog.restrict_to_requested(D.trajectories(spark, sf), asked, "bore_id").select("traj_id", "bore_id")


def stale_ids(spark, sf):
    return catalog.stale_ids(
        D.table(spark, sf, "customer").select(F.col("c_custkey").alias("bore_id")),
        catalog.filter_catalog(D.trajectories(spark, sf), is_definitive=True), "bore_id",
    )


def unique_name(spark, sf):
    wanted = D.table(spark, sf, "part").select(F.col("p_type").alias("base")).union(
        D.table(spark, sf, "part").select(F.upper("p_type"))).union(D.table(spark, sf, "nation").select("n_name"))
    return catalog.unique_name(wanted, _taken_names(spark, sf))


def _taken_names(spark, sf):
    p = D.table(spark, sf, "part")
    number = F.concat(F.lit(" ("), ((F.col("p_size") % 9) + F.col("p_partkey") % 2).cast("string"), F.lit(")"))
    return p.select(F.col("p_type").alias("name")).union(p.select(F.concat(F.lower("p_type"), number))).distinct()


UNIQUE = r"""
wanted AS (SELECT DISTINCT base FROM (SELECT p_type AS base FROM part UNION ALL SELECT upper(p_type) FROM part
  UNION ALL SELECT n_name FROM nation)),
taken AS (SELECT DISTINCT lower(name) AS name FROM (SELECT p_type AS name FROM part
  UNION ALL SELECT lower(p_type)||' ('||((p_size%9)+p_partkey%2)||')' FROM part)),
free AS (SELECT base, min(n) AS n FROM wanted, range(2,200) r(n)
  WHERE lower(base)||' ('||n||')' NOT IN (SELECT name FROM taken) GROUP BY 1)"""


def page_index(spark, sf):
    m = D.large_measurements(spark, sf)
    return catalog.page_index(m, ["bore_id"], ["seq"], 100).select("bore_id", "seq", "page")


def _pages(spark, sf):
    return catalog.page_index(D.large_measurements(spark, sf), ["bore_id"], ["seq"], 100)


def chunk_metadata(spark, sf):
    return catalog.chunk_metadata(_pages(spark, sf), "bore_id")


def chunk_count(spark, sf):
    return catalog.chunk_count(_pages(spark, sf), "bore_id")


def chunk_lookup(spark, sf):
    return catalog.chunk_lookup(_pages(spark, sf), 1).select("bore_id", "seq", "md")


def read_chunks(spark, sf):
    """Pages collected into arrays, then opened again: pages are bounded, so are the arrays."""
    item = F.struct("seq", "md", "inc", "az")
    chunks = _pages(spark, sf).groupBy("bore_id", F.col("page").alias("chunk_index")).agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    return catalog.read_chunks(chunks, "bore_id").select("bore_id", "chunk_index", "pos", "seq", "md")


def _versions(spark, sf):
    return D.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("traj_id"),
        (F.col("l_linenumber") * 1e6 + F.col("l_partkey") + F.col("l_suppkey") * 1e-4).alias("version"),
        F.col("l_quantity").alias("value"),
    )


def upsert_table(spark, sf):
    stored = D.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("traj_id"), F.lit(0.0).alias("version"), F.col("o_totalprice").alias("value")
    )
    return catalog.upsert_table(stored, _versions(spark, sf), "traj_id").select("traj_id", "version")


def delete_by_owner(spark, sf):
    owners = D.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("bore_id"))
    return catalog.delete_by_owner(D.trajectories(spark, sf), owners, "bore_id").select("traj_id", "bore_id")


def expire_old(spark, sf):
    """Rows older than 90 days before the newest one go, undated rows stay."""
    t = D.trajectories(spark, sf).withColumn(
        "modified", F.when(F.col("traj_id") % 10 != 0, F.col("modified")))
    newest = t.agg(F.max("modified").alias("_now"))
    dated = t.crossJoin(F.broadcast(newest))  # one row
    kept = catalog.expire_older_than(dated, "modified", F.col("_now") - F.expr("INTERVAL 90 DAYS"))
    return kept.select("traj_id", "modified")


def usage_totals(spark, sf):
    e = D.table(spark, sf, "events")
    daily = e.groupBy(F.col("event_type").alias("operation"), F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return catalog.usage_totals(daily)


def case_status_rollup(spark, sf):
    parts = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_tax") < 0.08).alias("ok"))
    return catalog.case_status_rollup(parts)


QUERIES = {
    "root_wellbore": root_wellbore,
    "wellbore_depth_path": wellbore_depth_path,
    "wellhead_reference": wellhead_reference,
    "wellhead_covariance": wellhead_covariance,
    "slot_lookup": slot_lookup,
    "reference_location": reference_location,
    "reference_offsets": reference_offsets,
    "resolve_depth_offset": resolve_depth_offset,
    "sidetrack_pairs": sidetrack_pairs,
    "select_comparisons": select_comparisons,
    "parent_run_candidates": parent_run_candidates,
    "hole_intervals": hole_intervals,
    "fill_hole_radius": fill_hole_radius,
    "hole_radius_coverage": hole_radius_coverage,
    "radius_by_similar_name": radius_by_similar_name,
    "internal_depths": internal_depths,
    "single_definitive": single_definitive,
    "filter_catalog": filter_catalog,
    "filter_and_sort_by_name": filter_and_sort_by_name,
    "search_text": search_text,
    "filter_survey_runs": filter_survey_runs,
    "validate_run_metadata": validate_run_metadata,
    "project_light": project_light,
    "list_ids": list_ids,
    "scan_by_ids": scan_by_ids,
    "scan_by_wellbore": scan_by_wellbore,
    "restrict_to_requested": restrict_to_requested,
    "stale_ids": stale_ids,
    "unique_name": unique_name,
    "page_index": page_index,
    "chunk_metadata": chunk_metadata,
    "chunk_count": chunk_count,
    "chunk_lookup": chunk_lookup,
    "read_chunks": read_chunks,
    "upsert_table": upsert_table,
    "delete_by_owner": delete_by_owner,
    "expire_old": expire_old,
    "usage_totals": usage_totals,
    "case_status_rollup": case_status_rollup,
}

PAGED = ("paged AS (SELECT *, CAST(floor(seq/100) AS BIGINT) AS page FROM meas)")

ORACLES = {
    "root_wellbore": _recursive(sql.BORES, CLIMB, select="""
SELECT u.bore_id, u.at_id AS root_bore_id FROM up u JOIN bores b ON b.bore_id=u.at_id
WHERE NOT b.is_sidetrack OR b.parent_bore_id NOT IN (SELECT bore_id FROM bores)"""),
    "wellbore_depth_path": _recursive(sql.BORES, CLIMB, select="""
SELECT bore_id, max(depth) AS depth, arg_max(path, depth) AS path FROM up GROUP BY 1"""),
    "wellhead_reference": sql.query(sql.BORES, sql.WELLS, sql.CLUSTERS, HEAD, select="""
SELECT bore_id, CASE WHEN reason IS NULL THEN lat END AS lat, CASE WHEN reason IS NULL THEN lon END AS lon,
  CASE WHEN reason IS NULL THEN lat_std END AS lat_std, CASE WHEN reason IS NULL THEN lon_std END AS lon_std,
  CASE WHEN reason IS NULL THEN ref_mean END AS md, CASE WHEN reason IS NULL THEN ref_mean END AS tvd,
  CASE WHEN reason IS NULL THEN ref_std END AS tvd_std, CASE WHEN reason IS NULL THEN 0.0::DOUBLE END AS inc,
  CASE WHEN reason IS NULL THEN 0.0::DOUBLE END AS az, reason FROM head"""),
    "wellhead_covariance": sql.query(sql.BORES, sql.WELLS, sql.CLUSTERS, HEAD, select=f"""
SELECT bore_id, round(pow({sql.north_of('lat+lat_std')}-{sql.north_of('lat')},2),4) AS c00,
  round(pow({sql.east_of('lat', 'lon+lon_std')}-{sql.east_of('lat', 'lon')},2),4) AS c11, round(ref_std*ref_std,4) AS c22
FROM head WHERE reason IS NULL"""),
    "slot_lookup": sql.query(sql.WELLS, sql.CLUSTERS, select="""
SELECT w.well_id, w.slot_id, CASE WHEN w.cluster_id IS NOT NULL THEN w.cluster_id ELSE a.cluster_id END AS cluster_id,
  CASE WHEN w.cluster_id IS NOT NULL THEN s.lat ELSE a.lat END AS lat,
  CASE WHEN w.cluster_id IS NOT NULL THEN s.lon ELSE a.lon END AS lon
FROM wells w LEFT JOIN slots s USING (cluster_id, slot_id)
LEFT JOIN (SELECT slot_id, min(cluster_id) cluster_id, arg_min(lat, cluster_id) lat, arg_min(lon, cluster_id) lon
  FROM slots GROUP BY 1) a ON a.slot_id=w.slot_id"""),
    "reference_location": _recursive(sql.BORES, sql.WELLS, sql.CLUSTERS, CLIMB, """
roots AS (SELECT u.bore_id, u.at_id FROM up u JOIN bores b ON b.bore_id=u.at_id
  WHERE NOT b.is_sidetrack OR b.parent_bore_id NOT IN (SELECT bore_id FROM bores)),
firsts AS (SELECT slot_id, arg_min(lat, cluster_id) lat, arg_min(lon, cluster_id) lon FROM slots GROUP BY 1)""", select="""
SELECT * FROM (SELECT r.bore_id,
  coalesce(CASE WHEN w.cluster_id IS NOT NULL THEN s.lat ELSE f.lat END, c.lat) AS lat,
  coalesce(CASE WHEN w.cluster_id IS NOT NULL THEN s.lon ELSE f.lon END, c.lon) AS lon,
  coalesce(c.ref_mean, 0.0) AS ref_depth, c.field_id
FROM roots r JOIN bores b ON b.bore_id=r.at_id LEFT JOIN wells w ON w.well_id=b.well_id
LEFT JOIN slots s ON s.cluster_id=w.cluster_id AND s.slot_id=w.slot_id LEFT JOIN firsts f ON f.slot_id=w.slot_id
LEFT JOIN clusters c ON c.cluster_id=w.cluster_id) WHERE lat IS NOT NULL AND lon IS NOT NULL"""),
    "reference_offsets": sql.query(sql.BORES, sql.WELLS, sql.CLUSTERS, sql.RIGS, select=f"""
SELECT b.bore_id, coalesce(-c.ground_depth,0.0) AS ground_offset, coalesce(-c.sea_depth,0.0) AS sea_offset,
  coalesce(-(CASE WHEN r1.rig_id IS NOT NULL THEN r1.drill_floor ELSE r2.drill_floor END),0.0) AS rotary_offset,
  round(coalesce(-{sql.north_of('s.lat')},0.0),3) AS wellhead_north,
  round(coalesce(-{sql.east_of('s.lat', 's.lon')},0.0),3) AS wellhead_east,
  round(coalesce(-{sql.north_of('c.lat')},0.0),3) AS cluster_north,
  round(coalesce(-{sql.east_of('c.lat', 'c.lon')},0.0),3) AS cluster_east
FROM bores b LEFT JOIN wells w USING (well_id) LEFT JOIN clusters c ON c.cluster_id=w.cluster_id
LEFT JOIN slots s ON s.cluster_id=w.cluster_id AND s.slot_id=w.slot_id
LEFT JOIN rigs r1 ON r1.rig_id=b.rig_id LEFT JOIN rigs r2 ON r2.rig_id=c.rig_id AND c.is_fixed"""),
    "resolve_depth_offset": sql.query(sql.BORES, sql.WELLS, sql.CLUSTERS, sql.RIGS, select="""
SELECT b.bore_id, d AS depth_reference, CASE d WHEN 'Ground/Mud line' THEN coalesce(-c.ground_depth,0.0)
  WHEN 'MSL' THEN b.bore_id*0.5::DOUBLE WHEN 'Sea water level' THEN coalesce(-c.sea_depth,0.0)
  ELSE coalesce(-r.drill_floor,0.0) END AS offset
FROM bores b LEFT JOIN wells w USING (well_id) LEFT JOIN clusters c ON c.cluster_id=w.cluster_id
LEFT JOIN rigs r ON r.rig_id=coalesce(b.rig_id,c.rig_id),
  (VALUES ('Ground/Mud line'),('MSL'),('Sea water level'),('Rotary table')) v(d)"""),
    "sidetrack_pairs": sql.query(sql.MEAS, sql.BORES, sql.PAIRS, """
spans AS (SELECT bore_id, min(md) lo, max(md) hi FROM meas GROUP BY 1),
mins AS (SELECT b.*, CASE WHEN lo IS NULL OR (tie_in_md>=lo AND tie_in_md<=hi) THEN tie_in_md ELSE lo END AS own
  FROM bores b LEFT JOIN spans USING (bore_id))""", select="""
SELECT ref_id, cmp_id,
  CASE WHEN r.is_sidetrack AND r.parent_bore_id=cmp_id THEN r.own
       WHEN c.is_sidetrack AND c.parent_bore_id=ref_id THEN c.tie_in_md END AS ref_min_md,
  CASE WHEN r.is_sidetrack AND r.parent_bore_id=cmp_id THEN r.tie_in_md
       WHEN c.is_sidetrack AND c.parent_bore_id=ref_id THEN c.own END AS cmp_min_md
FROM pairs JOIN mins r ON r.bore_id=ref_id JOIN mins c ON c.bore_id=cmp_id WHERE ref_id<>cmp_id"""),
    "select_comparisons": sql.query(sql.BORES, sql.PAIRS, select="SELECT * FROM pairs WHERE ref_id<>cmp_id"),
    "parent_run_candidates": sql.query(sql.MEAS, sql.BORES, """
spans AS (SELECT bore_id, min(md) lo, max(md) hi FROM meas GROUP BY 1),
runs AS (SELECT bore_id*2 AS run_id, bore_id, lo, hi/2 AS hi FROM spans UNION ALL SELECT bore_id*2+1, bore_id, hi/2, hi FROM spans),
want AS (SELECT b.bore_id AS row_id, CASE WHEN is_sidetrack THEN parent_bore_id ELSE b.bore_id END AS on_bore,
  CASE WHEN is_sidetrack THEN coalesce(tie_in_md, lo) ELSE lo END AS tie FROM bores b JOIN spans USING (bore_id))""", select="""
SELECT row_id, run_id, tie AS tie_in_md FROM want JOIN runs ON runs.bore_id=on_bore
WHERE (lo<=tie AND tie<=hi) OR (hi<=tie AND tie-hi<=10.0)"""),
    "hole_intervals": sql.query(sql.BORES, sql.HOLES, HOLE, select="""
SELECT bore_id, kind, start_md, end_md, round(radius,6) AS radius FROM ivl"""),
    "fill_hole_radius": sql.query(sql.MEAS, sql.BORES, sql.HOLES, HOLE, FILLED, select="""
SELECT f.bore_id, f.seq, md, round(hole_radius,6) AS hole_radius FROM filled f JOIN meas USING (bore_id, seq)"""),
    "hole_radius_coverage": sql.query(sql.MEAS, sql.BORES, sql.HOLES, HOLE, FILLED, select="""
SELECT bore_id, count(hole_radius) AS filled, count(*) AS total FROM filled GROUP BY 1"""),
    "radius_by_similar_name": """
WITH paths AS (SELECT p_partkey AS id, upper(replace(replace(p_brand,' ',''),'-','')) AS k FROM part),
donors AS (SELECT k, min(id) AS donor FROM paths WHERE id%3=0 GROUP BY 1)
SELECT id AS traj_id, id AS bore_id, CASE WHEN id%3=0 THEN id ELSE donor END AS architecture_bore_id,
  CASE WHEN id%3<>0 THEN donor END AS borrowed_from FROM paths LEFT JOIN donors USING (k)""",
    "internal_depths": sql.query(sql.MEAS, sql.BORES, sql.HOLES, INTERNAL,
                                 select="SELECT bore_id, depth, annotation FROM grouped"),
    "single_definitive": sql.query(sql.TRAJ, select="""
SELECT traj_id, bore_id, type, is_definitive AND traj_id=first_value(traj_id) OVER (
  PARTITION BY bore_id, type ORDER BY is_definitive DESC, modified DESC, traj_id DESC) AS is_definitive FROM traj"""),
    "filter_catalog": sql.query(sql.TRAJ, select="""
SELECT traj_id, bore_id, type, name FROM traj WHERE type='Measured' AND is_definitive"""),
    "filter_and_sort_by_name": sql.query(sql.TRAJ, select="""
SELECT traj_id, name, type FROM traj WHERE type='Planned' ORDER BY name"""),
    "search_text": sql.query(sql.TRAJ, select="""
SELECT traj_id, name, c_name AS bore_name FROM traj LEFT JOIN customer ON c_custkey=bore_id
WHERE name ILIKE '%urgent%' OR description ILIKE '%urgent%' OR c_name ILIKE '%urgent%' OR type ILIKE '%urgent%'"""),
    "filter_survey_runs": """
SELECT o_orderkey AS k, o_custkey AS bore_id, '3' AS instrument_id, 'Planned' AS run_type FROM orders
WHERE o_orderkey%10=3 AND o_orderkey%47<>0 AND o_orderkey%2<>0""",
    "validate_run_metadata": """
SELECT o_orderkey AS k, CASE WHEN o_orderkey%53=0 THEN 'missing run id' WHEN o_orderkey%47=0 THEN 'missing instrument id' END AS reason
FROM orders""",
    "project_light": sql.query(sql.TRAJ, select="SELECT traj_id, name, type, is_definitive, modified FROM traj"),
    "list_ids": "SELECT o_orderkey AS traj_id FROM orders",
    "scan_by_ids": sql.query(sql.TRAJ, select="""
SELECT pos, traj_id, bore_id, type FROM (SELECT DISTINCT l_orderkey*1000+l_linenumber AS pos, l_orderkey*2 AS traj_id
  FROM lineitem) JOIN traj USING (traj_id)"""),
    "scan_by_wellbore": sql.query(sql.TRAJ, select="""
SELECT bore_id, traj_id, type, is_definitive FROM traj QUALIFY row_number() OVER (PARTITION BY bore_id
  ORDER BY is_definitive DESC, modified DESC, traj_id)=1"""),
    "restrict_to_requested": sql.query(sql.TRAJ, select="""
SELECT traj_id, bore_id FROM traj WHERE bore_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING')"""),
    "stale_ids": "SELECT c_custkey AS bore_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F')",
    "unique_name": sql.query(UNIQUE, select="""
SELECT base, CASE WHEN lower(base) IN (SELECT name FROM taken) THEN base||' ('||n||')' ELSE base END AS name
FROM wanted JOIN free USING (base)"""),
    "page_index": sql.query(sql.LARGE, PAGED, select="SELECT bore_id, seq, page FROM paged"),
    "chunk_metadata": sql.query(sql.LARGE, PAGED, select="""
SELECT bore_id, page, count(*) AS n_rows, arg_min(md,seq) AS start_md, arg_max(md,seq) AS end_md FROM paged GROUP BY 1,2"""),
    "chunk_count": sql.query(sql.LARGE, PAGED, select="SELECT bore_id, max(page)+1 AS n_pages FROM paged GROUP BY 1"),
    "chunk_lookup": sql.query(sql.LARGE, PAGED, select="SELECT bore_id, seq, md FROM paged WHERE page=1"),
    "read_chunks": sql.query(sql.LARGE, PAGED, select="""
SELECT bore_id, page AS chunk_index, seq-page*100 AS pos, seq, md FROM paged"""),
    "upsert_table": """
SELECT traj_id, max(version) AS version FROM (SELECT o_orderkey AS traj_id, 0.0::DOUBLE AS version FROM orders
  UNION ALL SELECT l_orderkey, l_linenumber*1e6::DOUBLE+l_partkey+l_suppkey*1e-4::DOUBLE FROM lineitem) GROUP BY 1""",
    "delete_by_owner": sql.query(sql.TRAJ, select="""
SELECT traj_id, bore_id FROM traj WHERE bore_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal<0)"""),
    "expire_old": sql.query(sql.TRAJ, select="""
SELECT traj_id, m AS modified FROM (SELECT traj_id, CASE WHEN traj_id%10<>0 THEN modified END AS m FROM traj)
WHERE m IS NULL OR m>=(SELECT max(CASE WHEN traj_id%10<>0 THEN modified END) FROM traj)-INTERVAL 90 DAY"""),
    "usage_totals": "SELECT event_type AS operation, count(*) AS total FROM events GROUP BY 1",
    "case_status_rollup": """
SELECT l_orderkey AS case_id, bool_and(l_tax<0.08) AS complete, count(*) FILTER (NOT l_tax<0.08) AS failed
FROM lineitem GROUP BY 1""",
}
