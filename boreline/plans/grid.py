"""Spatial cells, overlap, depth ranges and separation factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from boreline.functions import blocks as B
from boreline.functions.chisq import chi_square_3d
from boreline.operators import catalog, hierarchy, octree, separation, survey, uncertainty
from boreline.plans import sql
from boreline.plans.uncertainty import SLICES, _box_sql, _slices, covered_stations
from boreline.sources import derived as D

LAT0, LON0 = 1.02, 0.1


def _origins(spark, sf):
    return D.wellbores(spark, sf).select("bore_id", F.lit(LAT0).alias("lat"), F.lit(LON0).alias("lon"))


def _cells(spark, sf):
    return octree.octree_cells(covered_stations(spark, sf), _origins(spark, sf))


def octree_cells(spark, sf):
    """Number of cells of each path, how many coarse cells they fill, and the sum and extremes of the codes."""
    c = _cells(spark, sf)
    return c.groupBy("bore_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("key21").alias("n_coarse"), F.min("key21").alias("least"),
        F.max("key21").alias("greatest"), F.sum("detail").alias("details"),
    )


def station_cells(spark, sf):
    """Cell code of every station, and the coarser codes it lies in."""
    s = D.stations(spark, sf)
    cells = s.select(
        "bore_id", "seq",
        octree.cell_index(LAT0 + F.col("north") * 1.5625e-7, "x").alias("ix"),
        octree.cell_index(LON0 + F.col("east") * 3.0e-7, "y").alias("iy"),
        octree.cell_index(F.col("tvd"), "z").alias("iz"),
    )
    return octree.with_codes(cells).select(
        "bore_id", "seq", "key21", "detail", octree.truncate_cell(F.col("key21"), 2).alias("key19"),
        octree.truncate_cell(F.col("key21"), 11).alias("key10"),
    )


def cells_per_parent(spark, sf):
    return octree.cells_per_parent(_station_neighbourhood(spark, sf))


def _station_neighbourhood(spark, sf):
    """Cells of the stations, grown by one."""
    s = D.stations(spark, sf)
    cells = s.select(
        "bore_id", octree.cell_index(LAT0 + F.col("north") * 1.5625e-7, "x").alias("ix"),
        octree.cell_index(LON0 + F.col("east") * 3.0e-7, "y").alias("iy"), octree.cell_index(F.col("tvd"), "z").alias("iz"),
    )
    return octree.with_codes(octree.grow_cells(cells.distinct()))


def group_codes_by_key(spark, sf):
    g = octree.group_codes_by_key(_station_neighbourhood(spark, sf))
    return g.select("bore_id", "key21", "n", F.array_min("details").alias("least"), F.array_max("details").alias("greatest"))


def compact_cells(spark, sf):
    cells = _station_neighbourhood(spark, sf).select("bore_id", F.lit(23).alias("depth"), "ix", "iy", "iz")
    done = octree.compact_cells(cells, ["bore_id"])
    return done.groupBy("bore_id", "depth").agg(F.count(F.lit(1)).alias("n"), F.sum("ix").alias("sum_x"))


def _registered(spark, sf):
    cells = _station_neighbourhood(spark, sf).select("bore_id", "key21", "detail")
    measured, definitive = F.col("bore_id") % 4 != 3, F.col("bore_id") % 3 != 2
    return cells.select(
        "bore_id", "key21", "detail", F.lit(False).alias("is_planned"), measured.alias("is_measured"),
        definitive.alias("is_definitive"),
    )


def octree_overlap(spark, sf):
    return octree.octree_overlap(D.wellbores(spark, sf).select("bore_id"), B.durable(_registered(spark, sf)))


def register_cells(spark, sf):
    """New cells replace those of sidetracks; the others keep what is stored."""
    stored = _registered(spark, sf)
    sides = D.wellbores(spark, sf).filter("is_sidetrack").select("bore_id")
    fresh = _station_neighbourhood(spark, sf).join(sides, "bore_id", "left_semi")
    done = octree.register_cells(stored, fresh)
    return done.groupBy("bore_id", "is_measured", "is_definitive").agg(F.count(F.lit(1)).alias("n"))


def pair_mesh_length(spark, sf):
    pairs = catalog.select_comparisons(D.comparison_pairs(spark, sf))
    got = separation.pair_mesh_length(pairs, survey.md_spacing(D.measurements(spark, sf)))
    return got.select("ref_id", "cmp_id", F.round("mesh_length", 6).alias("mesh_length"))


def _pairs(spark, sf):
    """Every bore against the other bores of its well."""
    return D.comparison_pairs(spark, sf).filter("cmp_id <> ref_id")


def relevant_md_ranges(spark, sf):
    got = separation.relevant_md_ranges(_pairs(spark, sf), covered_stations(spark, sf), 0.999)
    return got.select("ref_id", "cmp_id", *[F.round(c, 4).alias(c) for c in ("ref_start", "ref_end", "cmp_start", "cmp_end")])


def sf_candidates(spark, sf):
    """Candidates between the reference meshes of the bores of a well, counted per reference slice."""
    slices = B.durable(_slices(spark, sf))
    got = separation.sf_candidates(_pairs(spark, sf), slices, slices)
    return got.groupBy("ref_id", "cmp_id", "ref_slice").agg(
        F.count(F.lit(1)).alias("n"), F.min("cmp_slice").alias("first"), F.max("cmp_slice").alias("last")
    )


def insert_tie_in_slice(spark, sf):
    s = D.stations(spark, sf)
    ties = D.wellbores(spark, sf).filter("is_sidetrack").select("bore_id", F.col("tie_in_md").alias("md"))
    got = separation.insert_tie_in_slice(s, ties)
    return got.select("bore_id", "seq", "md", *[F.round(c, 6).alias(c) for c in ("inc", "az", "north", "east", "tvd")])


def _constraints(spark, sf, pairs):
    m = D.measurements(spark, sf)
    ranges = m.groupBy("bore_id").agg(F.min("md").alias("start_md"), F.max("md").alias("end_md"))
    return hierarchy.sidetrack_pairs(pairs, D.wellbores(spark, sf), ranges)


def separation_factor(spark, sf):
    pairs = _pairs(spark, sf)
    got = separation.separation_factor(_constraints(spark, sf, pairs), covered_stations(spark, sf), 0.999)
    return got.select("ref_id", "cmp_id", "slice", *[F.round(c, 4).alias(c) for c in ("ref_md", "cmp_md", "sf")])


def symmetric_profile(spark, sf):
    jobs = _constraints(spark, sf, _pairs(spark, sf))
    points = B.durable(separation.separation_factor(jobs, covered_stations(spark, sf), 0.999))
    got = separation.symmetric_profile(points.filter("ref_id < cmp_id"), points.filter("ref_id > cmp_id"))
    return got.select("ref_id", "cmp_id", *[F.round(c, 4).alias(c) for c in ("ref_md", "cmp_md", "sf")])


def anti_collision_report(spark, sf):
    """Candidates by shared cells, cut to the requested pairs, then ranges, constraints and profiles."""
    s = covered_stations(spark, sf)
    pairs = _pairs(spark, sf)
    bores = D.wellbores(spark, sf).select("bore_id")
    near = octree.octree_overlap(bores, B.durable(_near_cells(spark, sf)))
    found = near.withColumnsRenamed({"bore_id": "ref_id", "overlaps": "cmp_id"}).join(pairs, ["ref_id", "cmp_id"], "left_semi")
    found = B.durable(found)
    got = separation.anti_collision_report(found, s, _constraints(spark, sf, found), 0.999)
    return got.select("ref_id", "cmp_id", "n", *[F.round(c, 3).alias(c) for c in (
        "ref_start", "ref_end", "cmp_start", "cmp_end", "ref_md", "cmp_md", "sf")])


def _near_cells(spark, sf):
    """Registered cells of the whole envelopes."""
    return octree.register_cells(_registered(spark, sf).filter("false"), _cells(spark, sf))


_INDEX = """
idx AS (SELECT bore_id, seq, CAST(ceil((1.02::DOUBLE+north*1.5625e-7::DOUBLE+1.5707963267948966::DOUBLE)/3.141592653589793::DOUBLE*8388608)-1 AS BIGINT) AS ix,
  CAST(ceil((0.1::DOUBLE+east*3.0e-7::DOUBLE+3.141592653589793::DOUBLE)/6.283185307179586::DOUBLE*8388608)-1 AS BIGINT) AS iy,
  CAST(ceil((tvd+6000000.0::DOUBLE)/40000000.0::DOUBLE*8388608)-1 AS BIGINT) AS iz FROM stn)"""

_CODES = """
coded AS (SELECT *, CAST(list_sum([(((ix>>2)>>b)&1)*CAST(pow(8,b) AS HUGEINT)+(((iy>>2)>>b)&1)*2*CAST(pow(8,b) AS HUGEINT)
    +(((iz>>2)>>b)&1)*4*CAST(pow(8,b) AS HUGEINT) for b in range(21)]) AS BIGINT) AS key21,
  CAST((ix&1)+2*(iy&1)+4*(iz&1)+8*((ix>>1)&1)+16*((iy>>1)&1)+32*((iz>>1)&1) AS INTEGER) AS detail FROM {source})"""

_GROWN = """
grown AS (SELECT DISTINCT bore_id, ix+dx AS ix, iy+dy AS iy, iz+dz AS iz FROM (SELECT DISTINCT bore_id, ix, iy, iz FROM idx),
  (VALUES (-1),(0),(1)) a(dx), (VALUES (-1),(0),(1)) b(dy), (VALUES (-1),(0),(1)) c(dz))"""

_NEAR = (sql.STN, _INDEX, _GROWN, _CODES.replace("{source}", "grown"))


def _range_sql() -> str:
    """Boxes of neighbouring slices of the dense mesh, all against all per pair."""
    mesh = """
gaps AS (SELECT bore_id, min(d)/3 AS mesh FROM (SELECT bore_id, md-lag(md) OVER (PARTITION BY bore_id ORDER BY seq) AS d FROM meas) GROUP BY 1),
inner_s AS (SELECT * FROM (SELECT cseg.*, unnest(range(1, greatest(1, CAST(ceil((b_md-a_md)/mesh-1e-9) AS BIGINT)))) AS part,
  greatest(1, CAST(ceil((b_md-a_md)/mesh-1e-9) AS BIGINT)) AS parts FROM cseg JOIN gaps USING (bore_id)))"""
    sliced = SLICES.replace(
        "inner_s AS (SELECT cseg.*, k AS part, a_md+k*(b_md-a_md)/3 AS at_md FROM cseg, (VALUES (1),(2)) v(k))",
        mesh.strip() + ",\ninner_t AS (SELECT *, a_md+part*(b_md-a_md)/parts AS at_md FROM inner_s)",
    ).replace("FROM inner_s),\nsarc2", "FROM inner_t),\nsarc2")
    return sliced


RANGE_SEGMENTS = """
sbox AS (SELECT bore_id, slice, md2 AS start_md, lead(md2) OVER w AS end_md, least(n_lo,lead(n_lo) OVER w) AS n_lo,
  greatest(n_hi,lead(n_hi) OVER w) AS n_hi, least(e_lo,lead(e_lo) OVER w) AS e_lo, greatest(e_hi,lead(e_hi) OVER w) AS e_hi,
  least(t_lo,lead(t_lo) OVER w) AS t_lo, greatest(t_hi,lead(t_hi) OVER w) AS t_hi FROM boxed
  WINDOW w AS (PARTITION BY bore_id ORDER BY slice)),
segbox AS (SELECT * FROM sbox WHERE end_md IS NOT NULL)"""

OVERLAP = "r.n_lo<=c.n_hi AND r.n_hi>=c.n_lo AND r.e_lo<=c.e_hi AND r.e_hi>=c.e_lo AND r.t_lo<=c.t_hi AND r.t_hi>=c.t_lo"

NEIGHBOURS = """
hood AS (SELECT *, min(n_lo) OVER w AS hn_lo, max(n_hi) OVER w AS hn_hi, min(e_lo) OVER w AS he_lo, max(e_hi) OVER w AS he_hi,
  min(t_lo) OVER w AS ht_lo, max(t_hi) OVER w AS ht_hi, max(slice) OVER (PARTITION BY bore_id) AS last FROM boxed
  WINDOW w AS (PARTITION BY bore_id ORDER BY slice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
near AS (SELECT h.bore_id, h.slice, m.hn_lo AS n_lo, m.hn_hi AS n_hi, m.he_lo AS e_lo, m.he_hi AS e_hi, m.ht_lo AS t_lo, m.ht_hi AS t_hi
  FROM hood h JOIN hood m ON m.bore_id=h.bore_id AND m.slice=greatest(1,least(h.last-1,h.slice)))"""

TIE_ROWS = """
want AS (SELECT b.bore_id, tie_in_md AS tie FROM bores b WHERE is_sidetrack AND NOT EXISTS (
  SELECT 1 FROM stn s WHERE s.bore_id=b.bore_id AND abs(s.md-b.tie_in_md)<=1e-9)),
held AS (SELECT w.tie, seg.* FROM want w JOIN seg USING (bore_id) WHERE tie>=a_md AND tie<b_md)"""

QUERIES = {
    "station_cells": station_cells,
    "octree_cells": octree_cells,
    "cells_per_parent": cells_per_parent,
    "group_codes_by_key": group_codes_by_key,
    "compact_cells": compact_cells,
    "register_cells": register_cells,
    "octree_overlap": octree_overlap,
    "pair_mesh_length": pair_mesh_length,
    "relevant_md_ranges": relevant_md_ranges,
    "sf_candidates": sf_candidates,
    "insert_tie_in_slice": insert_tie_in_slice,
    "separation_factor": separation_factor,
    "symmetric_profile": symmetric_profile,
    "anti_collision_report": anti_collision_report,
}

_REG = """
reg AS (SELECT bore_id, key21, detail, bore_id%4<>3 AS is_measured, bore_id%3<>2 AS is_definitive FROM coded)"""

def _compaction_sql(levels: int = 4) -> str:
    """Cells of a level whose parent has all eight children go up; the others stay.  More levels than any path fills."""
    parts = ["l0 AS MATERIALIZED (SELECT bore_id, ix, iy, iz FROM grown)"]
    for k in range(levels):
        parts.append(f"l{k + 1} AS MATERIALIZED (SELECT bore_id, ix>>1 AS ix, iy>>1 AS iy, iz>>1 AS iz FROM l{k} GROUP BY 1,2,3,4 HAVING count(*)=8)")
    stays = " UNION ALL ".join(
        f"SELECT c.bore_id, {23 - k} AS depth, c.ix FROM l{k} c LEFT JOIN l{k + 1} p ON p.bore_id=c.bore_id AND p.ix=c.ix>>1 AND p.iy=c.iy>>1 AND p.iz=c.iz>>1"
        " WHERE p.bore_id IS NULL" for k in range(levels))
    return sql.query(sql.STN, _INDEX, _GROWN, *parts, select=f"""
SELECT bore_id, depth, count(*) AS n, CAST(sum(ix) AS BIGINT) AS sum_x FROM ({stays}) GROUP BY 1, 2""")


ORACLES = {
    "compact_cells": _compaction_sql(),
    "station_cells": sql.query(sql.STN, _INDEX, _CODES.replace("{source}", "idx"), select="""
SELECT bore_id, seq, key21, detail, key21>>6 AS key19, key21>>33 AS key10 FROM coded"""),
    "cells_per_parent": sql.query(*_NEAR, select="""
SELECT bore_id, key21, detail>>3 AS parent, bit_or(1<<(detail&7)) AS mask, count(DISTINCT detail&7) AS children,
  bit_or(1<<(detail&7))=255 AS "full" FROM coded GROUP BY 1,2,3"""),
    "group_codes_by_key": sql.query(*_NEAR, select="""
SELECT bore_id, key21, count(DISTINCT detail) AS n, min(detail) AS least, max(detail) AS greatest FROM coded GROUP BY 1,2"""),
    "register_cells": sql.query(*_NEAR, sql.BORES, _REG, select="""
SELECT bore_id, is_measured, is_definitive, count(*) AS n FROM (
  SELECT bore_id, is_measured, is_definitive FROM reg WHERE bore_id NOT IN (SELECT bore_id FROM bores WHERE is_sidetrack)
  UNION ALL SELECT bore_id, true, true FROM coded WHERE bore_id IN (SELECT bore_id FROM bores WHERE is_sidetrack))
GROUP BY 1,2,3"""),
    "octree_overlap": sql.query(*_NEAR, _REG, select="""
SELECT DISTINCT a.bore_id, b.bore_id AS overlaps FROM coded a JOIN reg b USING (key21, detail)
WHERE a.bore_id<>b.bore_id AND is_measured AND is_definitive"""),
    "pair_mesh_length": sql.query(sql.MEAS, sql.BORES, sql.PAIRS, """
gap AS (SELECT bore_id, count(*) AS n, min(d) AS g FROM (SELECT bore_id, md-lag(md) OVER (PARTITION BY bore_id ORDER BY seq) AS d
  FROM meas) GROUP BY 1)""", select="""
SELECT ref_id, cmp_id, round(CASE WHEN r.n>=75 OR c.n>=75 OR greatest(r.g,c.g)/3<3 THEN greatest(greatest(r.g,c.g)/3,3.0)
  ELSE greatest(r.g,c.g)/3 END,6) AS mesh_length
FROM pairs JOIN gap r ON r.bore_id=ref_id JOIN gap c ON c.bore_id=cmp_id WHERE ref_id<>cmp_id"""),
    "relevant_md_ranges": sql.query(_range_sql(), _box_sql("5.0::DOUBLE"), sql.PAIRS, RANGE_SEGMENTS, select=f"""
SELECT ref_id, cmp_id, round(greatest(rs.lo,min(r.start_md)),4) AS ref_start, round(least(rs.hi,max(r.end_md)),4) AS ref_end,
  round(greatest(cs.lo,min(c.start_md)),4) AS cmp_start, round(least(cs.hi,max(c.end_md)),4) AS cmp_end
FROM pairs JOIN segbox r ON r.bore_id=ref_id JOIN segbox c ON c.bore_id=cmp_id AND {OVERLAP}
JOIN (SELECT bore_id, min(md) lo, max(md) hi FROM meas GROUP BY 1) rs ON rs.bore_id=ref_id
JOIN (SELECT bore_id, min(md) lo, max(md) hi FROM meas GROUP BY 1) cs ON cs.bore_id=cmp_id
WHERE cmp_id<>ref_id GROUP BY ref_id, cmp_id, rs.lo, rs.hi, cs.lo, cs.hi"""),
    "sf_candidates": sql.query(SLICES, _box_sql("5.0::DOUBLE"), sql.PAIRS, NEIGHBOURS, select=f"""
SELECT ref_id, cmp_id, r.slice AS ref_slice, count(*) AS n, min(c.slice) AS first, max(c.slice) AS last
FROM pairs JOIN near r ON r.bore_id=ref_id JOIN boxed c ON c.bore_id=cmp_id AND {OVERLAP} WHERE cmp_id<>ref_id GROUP BY 1,2,3"""),
    "insert_tie_in_slice": sql.query(sql.STN, sql.BORES, sql.seg(), TIE_ROWS, sql.arc("held", "tie", "bore_id, seq*2+1 AS seq, tie"),
                                     select="""
SELECT bore_id, seq*2 AS seq, md, round(inc,6) inc, round(az,6) az, round(north,6) north, round(east,6) east, round(tvd,6) tvd FROM stn
UNION ALL SELECT bore_id, seq, tie, round(inc,6), round(az,6), round(north,6), round(east,6), round(tvd,6) FROM arc"""),
}
