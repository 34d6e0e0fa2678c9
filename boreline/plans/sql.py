"""SQL fragments of the derived tables, for the comparison engine."""

from __future__ import annotations

TWO_PI = "(2*pi())"


def wrap(x: str) -> str:
    return f"(({x})-{TWO_PI}*floor(({x})/{TWO_PI}))"


def wrap_signed(x: str) -> str:
    return f"(({x})-{TWO_PI}*ceil((({x})-pi())/{TWO_PI}))"


def dogleg(i1, a1, i2, a2) -> str:
    return (
        f"(2*asin(least(1.0,sqrt(pow(sin((({i2})-({i1}))/2),2)"
        f"+sin({i1})*sin({i2})*pow(sin((({a2})-({a1}))/2),2)))))"
    )


def ratio(d) -> str:
    q = f"(({d})*({d}))"
    return (
        f"(CASE WHEN {d}<0.02 THEN 1+{q}/12.0*(1+{q}/10.0*(1+{q}/168.0*(1+31.0*{q}/18.0)))"
        f" ELSE 2.0/({d})*tan(({d})/2.0) END)"
    )


def dec(x: str) -> str:
    return f"CAST(ROUND({x},6) AS DECIMAL(18,6))"


WIN = "WINDOW w AS (PARTITION BY bore_id ORDER BY seq)"
RUN = "OVER (PARTITION BY bore_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"


def _measurements(source: str, key: str, step: str, order: str, extra: str = "") -> str:
    return f"""
raw AS (SELECT {key} AS bore_id {extra}, row_number() OVER o - 1 AS seq,
  CAST(SUM(CAST({step} AS DECIMAL(12,2))) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS md
  FROM {source} WINDOW o AS (PARTITION BY {key} ORDER BY {order})),
meas AS (SELECT *, ROUND(0.6+0.5*sin(md/400.0+bore_id),6) AS inc,
  ROUND({wrap('bore_id*0.37::DOUBLE+0.3*sin(md/700.0)')},6) AS az,
  CASE WHEN seq=0 THEN (bore_id%15)*8.0 END AS north0, CASE WHEN seq=0 THEN floor(bore_id/15)*8.0 END AS east0
  FROM raw)"""


MEAS = _measurements("events", "user_id", "5+value", "event_id", ", event_id")
LARGE = _measurements("lineitem", "l_suppkey", "5+l_quantity", "l_orderkey,l_linenumber,l_partkey,l_suppkey")

STEPS = f"""
lagged AS (SELECT *, lag(md) OVER w AS pmd, lag(inc) OVER w AS pinc, lag(az) OVER w AS paz FROM meas {WIN}),
angled AS (SELECT *, md-pmd AS ds, {dogleg('pinc','paz','inc','az')} AS dl FROM lagged),
stepped AS (SELECT *, 0.5*ds*{ratio('dl')} AS half FROM angled),
moved AS (SELECT *, half*(sin(pinc)*cos(paz)+sin(inc)*cos(az)) AS dn,
  half*(sin(pinc)*sin(paz)+sin(inc)*sin(az)) AS de, half*(cos(pinc)+cos(inc)) AS dt FROM stepped)"""

PLACED = f"""
stn AS (SELECT bore_id, seq, md, inc, az,
  CAST(SUM({dec("CASE WHEN pmd IS NULL THEN coalesce(north0,0) ELSE dn END")}) {RUN} AS DOUBLE) AS north,
  CAST(SUM({dec("CASE WHEN pmd IS NULL THEN coalesce(east0,0) ELSE de END")}) {RUN} AS DOUBLE) AS east,
  CAST(SUM({dec("CASE WHEN pmd IS NULL THEN 0 ELSE dt END")}) {RUN} AS DOUBLE) AS tvd,
  CAST(SUM({dec("CASE WHEN pmd IS NULL THEN 0 ELSE sqrt(dn*dn+de*de) END")}) {RUN} AS DOUBLE) AS vsect,
  ROUND(CASE WHEN ds>0 THEN dl/ds END,8) AS dls, ROUND(CASE WHEN ds>0 THEN (inc-pinc)/ds END,8) AS bur,
  ROUND(CASE WHEN ds>0 THEN {wrap_signed('az-paz')}/ds END,8) AS tur FROM moved)"""

STN = MEAS + "," + STEPS + "," + PLACED
LARGE_STN = LARGE + "," + STEPS + "," + PLACED

BORES = """
bores AS (SELECT DISTINCT user_id AS bore_id, 'Bore '||user_id AS name, user_id-user_id%5 AS well_id,
  user_id%5>=2 AS is_sidetrack, CASE WHEN user_id%5>=2 THEN user_id-1 END AS parent_bore_id,
  CASE WHEN user_id%5>=2 THEN 150.0::DOUBLE+(user_id%7)*25.0::DOUBLE END AS tie_in_md,
  CASE WHEN user_id%5<>3 THEN user_id%10 END AS rig_id FROM events)"""

WELLS = """
wells AS (SELECT c_custkey AS well_id, c_name AS name, CASE WHEN c_custkey%11<>3 THEN c_nationkey END AS cluster_id,
  'S'||(c_custkey%7) AS slot_id FROM customer)"""

CLUSTERS = """
clusters AS (SELECT n_nationkey AS cluster_id, n_name AS name, n_regionkey AS field_id,
  n_nationkey*1.5::DOUBLE-20.0::DOUBLE AS ref_mean, 0.5::DOUBLE AS ref_std, 0.9::DOUBLE+n_nationkey*0.001::DOUBLE AS lat,
  0.05::DOUBLE+n_nationkey*0.002::DOUBLE AS lon, n_nationkey%2=0 AS is_fixed, CAST(n_nationkey AS BIGINT) AS rig_id,
  n_nationkey*2.0::DOUBLE AS ground_depth, n_nationkey*0.5::DOUBLE AS sea_depth FROM nation),
slots AS (SELECT cluster_id, 'S'||k AS slot_id, 0.9::DOUBLE+cluster_id*0.001::DOUBLE+k*1e-6::DOUBLE AS lat,
  0.05::DOUBLE+cluster_id*0.002::DOUBLE+k*2e-6::DOUBLE AS lon, 1e-7::DOUBLE AS lat_std, 2e-7::DOUBLE AS lon_std
  FROM clusters, range(6) r(k))"""

RIGS = "rigs AS (SELECT s_suppkey AS rig_id, 20.0::DOUBLE+s_nationkey*0.25::DOUBLE AS drill_floor FROM supplier)"

TRAJ = """
traj AS (SELECT o_orderkey AS traj_id, o_custkey AS bore_id, CASE WHEN o_orderkey%2=0 THEN 'Planned' ELSE 'Measured' END AS type,
  o_orderstatus='F' AS is_definitive, o_orderdate AS modified, 'Path '||o_orderpriority AS name,
  o_orderpriority||' order' AS description FROM orders)"""



def _part(kind, section, pos, top, length, diameter) -> str:
    cell = lambda v: "NULL::DOUBLE" if v is None else f"({v})::DOUBLE"
    return (
        f"{{'section':{'NULL' if section is None else section}::INTEGER,'kind':'{kind}','pos':{pos},"
        f"'top_md':{cell(top)},'length':{cell(length)},'diameter':{cell(diameter)}}}"
    )


HOLES = f"""
holes AS (SELECT bore_id, unnest([
  {_part('surface', None, 0, None, '10.0+bore_id%5', 0.9)}, {_part('surface', None, 1, None, '20.0+bore_id%3', 0.75)},
  {_part('casing', 0, 0, '40.0+(bore_id%4)*1.0', 950, None)}, {_part('size', 0, 0, None, 500, 0.5)},
  {_part('size', 0, 1, None, 450, '0.3::DOUBLE+(bore_id%6)*0.01::DOUBLE')}, {_part('element', 0, 0, None, 300, 0.339725)},
  {_part('element', 0, 1, None, 400, 0.339725)}, {_part('element', 0, 2, None, '250.0+bore_id%3', 0.244475)},
  {_part('open', 0, 0, None, 1500, 0.2159)}, {_part('open', 0, 1, None, 1500, 0.1524)}], recursive:=true) FROM bores),
heads AS (SELECT bore_id, (30.0+bore_id%9)::DOUBLE AS wellhead_md,
  CASE WHEN bore_id%3<>0 THEN (42.0+bore_id%2)::DOUBLE END AS hanger_md FROM bores)"""

INTERVALS = """
intervals AS (SELECT i AS interval_id, 'interval '||i AS name, i*250.0::DOUBLE AS start_md, (i+1)*250.0::DOUBLE AS end_md
  FROM (SELECT unnest(range(0, CAST(floor(max(md)/250.0) AS INTEGER)+1)) AS i FROM meas))"""

PAIRS = """
pairs AS (SELECT a.bore_id AS ref_id, b.bore_id AS cmp_id FROM bores a JOIN bores b ON a.well_id=b.well_id)"""


def seg(name: str = "seg", source: str = "stn", extra: tuple[str, ...] = ()) -> str:
    fields = ("md", "inc", "az", "north", "east", "tvd", *extra)
    a = ", ".join(f"{c} AS a_{c}" for c in fields)
    b = ", ".join(f"lead({c}) OVER w AS b_{c}" for c in fields)
    return f"""
{name} AS (SELECT * FROM (SELECT bore_id, seq, {a}, {b} FROM {source} {WIN}) WHERE b_md>a_md)"""


def arc(source: str, md: str, keep: str, name: str = "arc") -> str:
    """Stations at ``md`` on the arcs of ``source`` (columns a_*, b_*), in successive CTEs ending in ``name``."""
    return f"""
{name}1 AS (SELECT *, CASE WHEN b_md>a_md THEN ({md}-a_md)/(b_md-a_md) ELSE 0.0 END AS u,
  {dogleg('a_inc','a_az','b_inc','b_az')} AS dl FROM {source}),
{name}2 AS (SELECT *, CASE WHEN dl<1e-9 THEN 1-u ELSE sin((1-u)*dl)/sin(dl) END AS w1,
  CASE WHEN dl<1e-9 THEN u ELSE sin(u*dl)/sin(dl) END AS w2, u*dl AS udl FROM {name}1),
{name}3 AS (SELECT *, w1*(sin(a_inc)*cos(a_az))+w2*(sin(b_inc)*cos(b_az)) AS tn0,
  w1*(sin(a_inc)*sin(a_az))+w2*(sin(b_inc)*sin(b_az)) AS te0, w1*cos(a_inc)+w2*cos(b_inc) AS tt0 FROM {name}2),
{name}4 AS (SELECT *, sqrt(tn0*tn0+te0*te0+tt0*tt0) AS tl, 0.5*u*(b_md-a_md)*{ratio('udl')} AS half FROM {name}3),
{name} AS (SELECT {keep}, a_north+half*(sin(a_inc)*cos(a_az)+tn0/tl) AS north,
  a_east+half*(sin(a_inc)*sin(a_az)+te0/tl) AS east, a_tvd+half*(cos(a_inc)+tt0/tl) AS tvd,
  acos(greatest(-1.0,least(1.0,tt0/tl))) AS inc, {wrap('atan2(te0/tl,tn0/tl)')} AS az FROM {name}4)"""


def north_of(lat: str) -> str:
    """Meridian arc of the ellipsoid, the same published series as on the Spark side."""
    a, e2 = 6378137.0, 0.00669437999014
    e4, e6 = e2 * e2, e2 * e2 * e2
    c0, c2 = 1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256, 3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024
    c4, c6 = 15 * e4 / 256 + 45 * e6 / 1024, 35 * e6 / 3072
    f = f"({lat})"
    return (
        f"({a}::DOUBLE*({c0!r}::DOUBLE*{f}-{c2!r}::DOUBLE*sin(2*{f})+{c4!r}::DOUBLE*sin(4*{f})"
        f"-{c6!r}::DOUBLE*sin(6*{f})))"
    )


def east_of(lat: str, lon: str) -> str:
    f = f"({lat})"
    return f"(6378137.0::DOUBLE*cos({f})/sqrt(1-0.00669437999014::DOUBLE*sin({f})*sin({f}))*({lon}))"


def query(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select

TOOLS = """
tools AS (SELECT s_suppkey AS tool_id, ['MWD_WolffDeWardt','Gyro_WolffDeWardt','MWD_ISCWSA','Gyro_WolffDeWardt','Other'][s_suppkey%5+1] AS model,
  0.0005::DOUBLE AS rel_depth, 0.0004::DOUBLE+(s_suppkey%3)*0.0001::DOUBLE AS misalignment,
  CASE WHEN s_suppkey%5<>1 THEN 0.001::DOUBLE ELSE 0.0 END AS true_inc, 0.0012::DOUBLE+(s_suppkey%4)*0.0002::DOUBLE AS reference,
  CASE WHEN s_suppkey%5<>1 THEN 0.0005::DOUBLE ELSE 0.0 END AS magnetisation,
  CASE WHEN s_suppkey%5=1 THEN 0.0006::DOUBLE ELSE 0.0 END AS gyro FROM supplier)"""


def _wolff() -> str:
    shapes = {
        "mi_n": "cos(inc)*cos(az)", "mi_e": "cos(inc)*sin(az)", "mi_t": "-sin(inc)", "ma_n": "-sin(az)", "ma_e": "cos(az)",
        "ti_n": "sin(inc)*cos(inc)*cos(az)", "ti_e": "sin(inc)*cos(inc)*sin(az)", "ti_t": "-sin(inc)*sin(inc)",
        "re_n": "-sin(inc)*sin(az)", "re_e": "sin(inc)*cos(az)",
        "mg_n": "-sin(inc)*sin(inc)*sin(az)*sin(az)", "mg_e": "sin(inc)*sin(inc)*sin(az)*cos(az)",
        "gy_n": "-tan(inc)*sin(az)", "gy_e": "tan(inc)*cos(az)",
    }
    size = {"mi": "misalignment", "ma": "misalignment", "ti": "true_inc", "re": "reference", "mg": "magnetisation", "gy": "gyro"}
    f = ", ".join(f"{v} AS f_{k}" for k, v in shapes.items())
    legs = ", ".join(
        f"coalesce(0.5*(md-lag(md) OVER w)*{size[k[:2]]}*(f_{k}+lag(f_{k}) OVER w),0.0) AS l_{k}" for k in shapes
    )
    for axis, x in (("north", "n"), ("east", "e"), ("tvd", "t")):
        legs += f", coalesce(rel_depth*({axis}-lag({axis}) OVER w),0.0) AS l_dr_{x}"
    names = [*shapes, "dr_n", "dr_e", "dr_t"]
    sums = ", ".join(f"SUM(l_{k}) {RUN} AS e_{k}" for k in names)

    def entry(i: str, j: str) -> str:
        terms = [f"e_{p}_{i}*e_{p}_{j}" for p in ("dr", "mi", "ma", "ti", "re", "mg", "gy")
                 if f"{p}_{i}" in names and f"{p}_{j}" in names]
        return "+".join(terms)

    cov = ", ".join(f"{entry(i, j)} AS c{a}{b}" for a, b, i, j in (
        (0, 0, "n", "n"), (0, 1, "n", "e"), (0, 2, "n", "t"), (1, 1, "e", "e"), (1, 2, "e", "t"), (2, 2, "t", "t")))
    return f"""
shaped AS (SELECT stn.*, tools.*, {f} FROM stn JOIN tools ON tools.tool_id=stn.bore_id%(SELECT count(*) FROM supplier)),
legged AS (SELECT *, {legs} FROM shaped {WIN}),
summed AS (SELECT *, {sums} FROM legged),
cov AS (SELECT bore_id, seq, md, inc, az, north, east, tvd, {cov} FROM summed)"""


WOLFF = _wolff()


def ellipse(a: str, b: str, c: str, k: str) -> tuple[str, str, str]:
    mean, spread = f"(({a})+({c}))/2", f"sqrt(pow((({a})-({c}))/2,2)+({b})*({b}))"
    return (f"{k}*sqrt(greatest({mean}+{spread},0.0))", f"{k}*sqrt(greatest({mean}-{spread},0.0))",
            f"0.5*atan2(2*({b}),({a})-({c}))")


def quad(x: str, y: str, z: str) -> str:
    return f"({x}*{x}*c00+{y}*{y}*c11+{z}*{z}*c22+2*({x}*{y}*c01+{x}*{z}*c02+{y}*{z}*c12))"


def bilinear(u: tuple[str, str, str], v: tuple[str, str, str]) -> str:
    rows = (("c00", "c01", "c02"), ("c01", "c11", "c12"), ("c02", "c12", "c22"))
    return "(" + "+".join(f"{u[i]}*({'+'.join(f'{rows[i][j]}*{v[j]}' for j in range(3))})" for i in range(3)) + ")"


HIGH = ("(cos(inc)*cos(az))", "(cos(inc)*sin(az))", "(-sin(inc))")
RIGHT = ("(-sin(az))", "cos(az)", "0.0")
TANGENT = ("(sin(inc)*cos(az))", "(sin(inc)*sin(az))", "cos(inc)")
