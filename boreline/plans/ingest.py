"""Imports, exports and streams over survey text made from the measurements."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from boreline.functions import blocks as B
from boreline.operators import catalog, exports, importing
from boreline.plans import sql
from boreline.plans.uncertainty import covered_stations
from boreline.sources import derived as D
from boreline.sources import documents, text
from boreline.streaming import jobs


def _folder(spark) -> str:
    """A fresh shared folder for the tables a query writes."""
    return f"{B.shared_folder(spark)}/boreline-run-{uuid.uuid4().hex}"


def _lines(spark, sf, keep_block: bool = True):
    """A text line per measurement, in degrees, with faults: repeated depths, junk, other separators and marks."""
    m = D.measurements(spark, sf)
    e = F.col("event_id")
    md = F.when(e % 97 == 0, F.col("md") - 100.0).otherwise(F.col("md"))
    degrees = [F.round(F.degrees(c), 5) for c in ("inc", "az")]
    parts = [F.format_string("%.5f", v) for v in (md, *degrees)]
    plain = F.concat_ws(";", *parts)
    line = (
        F.when(e % 89 == 0, F.replace(plain, F.lit("."), F.lit(",")))
        .when(e % 83 == 0, F.lit("# no survey"))
        .when(e % 79 == 0, F.concat_ws("\t", *parts))
        .when(e % 73 == 0, F.concat(F.lit("  "), F.concat_ws("   ", *parts)))
        .otherwise(plain)
    )
    block = [B.BLOCK] if B.is_split(m) and keep_block else []
    return m.select("bore_id", "seq", *block, line.alias("line"))


def import_steps(spark, sf):
    measured = text.measure_lines(_lines(spark, sf), ["bore_id"], ["seq"])
    done = text.accepted_measurements(measured.withColumnRenamed("seq", "line_no"), ["bore_id"], ["line_no"])
    return done.select("bore_id", "seq", F.round("md", 4).alias("md"), F.round("inc", 7).alias("inc"), F.round("az", 7).alias("az"))


def skipped_lines(spark, sf):
    return text.skipped_lines(text.measure_lines(_lines(spark, sf), ["bore_id"], ["seq"]), ["bore_id"])


def fixed_width(spark, sf):
    """Fixed-width lines in feet and gradians; short lines lose their azimuth."""
    m = D.measurements(spark, sf)
    fields = [F.format_string("%.5f", v) for v in (
        F.col("md") / 0.3048, F.col("inc") / text.UNITS["gradian"], F.col("az") / text.UNITS["gradian"])]
    line = F.concat(*[F.lpad(f, 14, " ") for f in fields])
    line = F.when(F.col("event_id") % 61 == 0, F.substring(line, 1, 28)).otherwise(line)
    settings = {"format": "Fixed width", "decimal": "Dot (.)", "md_unit": "foot", "inc_unit": "gradian", "az_unit": "gradian",
                "md_start": 1, "md_width": 14, "inc_start": 15, "inc_width": 14, "az_start": 29, "az_width": 14}
    measured = text.measure_lines(m.select("bore_id", "seq", line.alias("line")), ["bore_id"], ["seq"], settings)
    return measured.filter("accepted").select(
        "bore_id", "seq", F.round("md", 4).alias("md"), F.round("inc", 6).alias("inc"), F.round("az", 6).alias("az"))


FILE_ROWS = 40


def manifest(spark, sf):
    """Manifest rows: the lines of every wellbore in files of 40, some rows without instrument, bore or content."""
    lines = _lines(spark, sf, keep_block=False).withColumn("part", F.floor(F.col("seq") / FILE_ROWS))
    files = lines.groupBy("bore_id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("_l"))
    content = F.array_join(F.col("_l.line"), "\n")
    content = F.when(F.col("part") == 0, F.concat(F.lit("-100.0;0.0;0.0\n"), content)).otherwise(content)
    row = F.col("bore_id") * 1000 + F.col("part")
    setting = {c: F.lit(text.SETTINGS[c]) for c in documents.SETTING_FIELDS}
    return files.select(
        F.lit("batch").alias("manifest"), row.alias("row_index"), (F.col("bore_id") % 9 == 4).alias("replace_all"),
        F.lit(True).alias("replace_same_name"), *[v.alias(c) for c, v in setting.items()],
        F.concat(F.lit("r"), row.cast("string")).alias("row_id"), F.col("bore_id"),
        F.when(F.col("bore_id") % 17 != 5, F.lit("tool")).alias("instrument_id"),
        F.lit(None).cast("string").alias("parent_run_id"),
        F.when(F.col("bore_id") % 2 == 0, "Ground/Mud line").otherwise("Rotary table").alias("depth_reference"),
        F.concat(F.lit("Survey "), (F.col("bore_id") % 3).cast("string"), F.lit(".txt")).alias("file_name"),
        F.when(F.col("bore_id") % 23 != 7, content).alias("content"),
    )


def _import(spark, sf):
    bores = D.wellbores(spark, sf)
    old_runs = bores.filter("bore_id % 5 = 1").select(
        F.concat(F.lit("old"), F.col("bore_id").cast("string")).alias("run_id"), "bore_id", F.lit("Survey 1").alias("name"),
        F.lit(0.0).alias("first_md"), F.lit(400.0).alias("last_md"))
    old_paths = bores.filter("bore_id % 4 = 0").select(
        F.concat(F.lit("t"), F.col("bore_id").cast("string")).alias("traj_id"), "bore_id", F.lit("survey 0").alias("name"))
    return importing.import_batch(
        manifest(spark, sf), bores, D.wells(spark, sf), D.clusters(spark, sf), D.rigs(spark, sf), old_runs, old_paths)


MANIFESTS = 16


def read_manifest(spark, sf):
    """The rows of ``manifest`` as files of one JSON object each, over many lines, read back."""
    rows = manifest(spark, sf).withColumn("part", F.col("row_index") % MANIFESTS)
    entry = F.to_json(F.struct(
        F.col("row_id").alias("RowId"), F.col("bore_id").cast("string").alias("WellBoreId"),
        F.coalesce("instrument_id", F.lit(documents.NO_ID)).alias("SurveyInstrumentId"),
        F.col("depth_reference").alias("DepthReferenceName"), F.concat("file_name", F.lit(' {"}')).alias("FileName"),
        F.base64(F.encode("content", "UTF-8")).alias("FileContentBase64")))
    starts = rows.groupBy("part").agg(F.min("row_index").alias("start"))
    comma = F.when(F.col("row_index") > F.col("start"), F.lit(",")).otherwise(F.lit(""))
    lines = rows.join(starts, "part").select("part", F.col("row_index").cast("bigint").alias("at"), F.concat(comma, entry).alias("value"))
    top = F.format_string('{"ReplaceExistingTrajectories": %s, "Settings": {"SelectedSurveyImportDecimalMarker": ","},\n"Rows": [',
                          (F.col("part") % 2 == 0).cast("string"))
    lines = lines.unionByName(starts.select("part", F.lit(-1).cast("bigint").alias("at"), top.alias("value")))
    lines = lines.unionByName(starts.select("part", F.lit(2**62).alias("at"), F.lit('], "ReplaceTrajectoriesWithSameName": true}').alias("value")))
    folder = _folder(spark)
    lines.repartition("part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(folder)
    got = documents.read_batch_manifest(spark, folder)
    return got.select(
        F.regexp_extract("manifest", "part=([0-9]+)", 1).cast("bigint").alias("part"), "row_index", "row_id", "bore_id", "instrument_id",
        "file_name", "depth_reference", "replace_all", "replace_same_name", "decimal",
        F.when(F.col("content").isNotNull(), F.size(F.split("content", "\n"))).cast("bigint").alias("n_lines"))


def import_batch(spark, sf):
    done = _import(spark, sf)
    runs = done.runs.select("row_id", "parent_run_id", F.col("name").alias("run_name"))
    paths = done.trajectories.select(F.substring("run_id", 5, 100).alias("row_id"), F.col("name").alias("path_name"), "replaced",
                                     F.round("md_step", 4).alias("md_step"), "start_md")
    return done.status.join(runs, "row_id", "left").join(paths, "row_id", "left")


def import_measurements(spark, sf):
    got = _import(spark, sf).measurements
    return got.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("md"), 4).alias("first_md"),
                                     F.round(F.max("md"), 4).alias("last_md"), F.count("annotation").alias("n_marks"))


def load_documents(spark, sf):
    """Stored documents as JSON text, some with empty ids or broken text, read back as rows."""
    t = D.trajectories(spark, sf)
    key = F.when(F.col("traj_id") % 101 == 0, documents.NO_ID).otherwise(F.col("traj_id").cast("string"))
    document = F.to_json(F.struct(
        F.struct(key.alias("ID")).alias("MetaInfo"), F.col("name").alias("Name"), F.col("description").alias("Description"),
        F.when(F.col("traj_id") % 3 == 0, documents.NO_ID).otherwise("field").alias("FieldID"),
        F.col("bore_id").cast("string").alias("WellBoreID"), F.col("type").alias("TrajectoryType"),
        F.col("is_definitive").alias("IsDefinitive"), F.lit(10.0).alias("MDStep"),
        F.date_format(F.col("modified").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("LastModificationDate"),
    ))
    broken = F.when(F.col("traj_id") % 103 == 0, F.substring(document, 1, 20)).otherwise(document)
    rows, _ = documents.load_documents(t.select(broken.alias("document")))
    return rows.select("traj_id", "name", "field_id", "bore_id", "type", "is_definitive", "md_step",
                       F.col("modified").cast("timestamp_ntz").alias("modified"))


def load_depth_lists(spark, sf):
    """Saved depth lists of every order: numbers and objects mixed."""
    line = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    item = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("string")).otherwise(
        F.concat(F.lit('{"Abscissa":'), F.col("l_quantity").cast("string"), F.lit(',"Annotation":"part '),
                 F.col("l_partkey").cast("string"), F.lit('"}')))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", item.alias("item"))
    lists = line.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.array_sort(F.collect_list(order)).alias("_i"))
    lists = lists.select("case_id", F.concat(F.lit("["), F.array_join("_i.item", ","), F.lit("]")).alias("depths"))
    return documents.load_depth_lists(lists)


def load_sf_profiles(spark, sf):
    """One saved profile per event, in four notations and one that is malformed."""
    e = D.table(spark, sf, "events").select("event_id", "user_id", "value")
    v, i = F.col("value").cast("string"), F.col("event_id").cast("string")

    def obj(a, b, c):
        return F.concat(F.lit(f'{{"{a}":'), i, F.lit(f',"{b}":'), v, F.lit(f',"{c}":2.5}}'))

    kinds = [obj("ReferenceMD", "ComparisonMD", "SeparationFactor"), obj("Left", "Middle", "Right"), obj("Item1", "Item2", "Item3"),
             F.concat(F.lit("["), i, F.lit(","), v, F.lit(",2.5]")), F.concat(F.lit("["), i, F.lit(","), v, F.lit("]"))]
    item = F.element_at(F.array(*kinds), (F.col("event_id") % 5 + 1).cast("int"))
    rows, bad = documents.load_sf_profiles(e.select("event_id", F.concat(F.lit("["), item, F.lit("]")).alias("profile")))
    return rows.select("event_id", "ref_md", "cmp_md", "sf").unionByName(
        bad.select("event_id", *[F.lit(None).cast("double").alias(c) for c in ("ref_md", "cmp_md", "sf")]))


def export_station_table(spark, sf):
    got = exports.export_station_table(D.stations(spark, sf), 0.3048)
    return got.select("bore_id", "seq", *[F.round(c, 6).alias(c) for c in ("md", "inc", "az", "tvd", "north", "dls", "bur")])


def export_wide(spark, sf):
    """The five bores of each well side by side."""
    s = D.stations(spark, sf).select(
        (F.col("bore_id") - F.col("bore_id") % 5).alias("case_id"), (F.col("bore_id") % 5).alias("realization"), "seq", "md", "tvd")
    return exports.export_realizations_wide(s, [0, 1, 2, 3, 4], ("md", "tvd"))


def export_long(spark, sf):
    """All bores of each well stacked in files, read back."""
    path = _folder(spark) + "/long"
    s = D.stations(spark, sf).select(
        (F.col("bore_id") - F.col("bore_id") % 5).alias("case_id"), (F.col("bore_id") % 5).alias("realization"), "seq", "md", "tvd")
    exports.export_realizations_long(s, path)
    return spark.read.csv(path, sep="\t", header=True, schema="realization bigint, seq bigint, md double, tvd double, case_id bigint")


def export_covariance(spark, sf):
    """Covariance files written and read back: their rows and totals per wellbore."""
    path = _folder(spark) + "/covariance"
    exports.export_covariance(covered_stations(spark, sf), path)
    back = spark.read.csv(path, sep=";", header=True, schema="md double, c00 double, c11 double, c22 double, c01 double, c02 double, c12 double, bore_id bigint")
    return back.groupBy("bore_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("md"), 4).alias("md"), F.round(F.max("c00"), 6).alias("c00"))


def write_station_table(spark, sf):
    """Station listings of all wellbores written and read back: rows, depths and the order of each file."""
    path = _folder(spark) + "/stations"
    exports.write_station_table(D.stations(spark, sf).withColumn("vsect", F.lit(0.0)), path, depth_factor=0.3048)
    names = ["seq", "md", "inc", "az", "tvd", "north", "east", "vsect", "dls", "bur", "tur"]
    schema = ", ".join(f"{n} {'bigint' if n == 'seq' else 'double'}" for n in names) + ", bore_id bigint"
    back = spark.read.csv(path, sep="\t", header=True, schema=schema)
    return back.groupBy("bore_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"), F.round(F.max("md"), 4).alias("md"), F.round(F.sum("inc"), 3).alias("inc"))


def write_pages(spark, sf):
    """Pages of all wells written, those of some wells replaced, then read back."""
    path = _folder(spark) + "/pages"
    rows = D.measurements(spark, sf).select("bore_id", "seq", "md")
    exports.write_pages(rows, path, "bore_id")
    exports.write_pages(rows.filter("bore_id % 3 = 0").withColumn("md", F.col("md") + 1.0), path, "bore_id")
    return catalog.chunk_metadata(spark.read.parquet(path), "bore_id")


def expire_sf_results(spark, sf):
    """Results of the last hour before the newest one."""
    e = D.table(spark, sf, "events").select("event_id", "ts")
    newest = e.agg(F.max("ts").alias("_now"))
    dated = e.crossJoin(F.broadcast(newest))  # one row
    return catalog.expire_older_than(dated, "ts", F.col("_now") - F.expr("INTERVAL 3600 SECONDS")).select("event_id")


def usage_daily(spark, sf):
    """Daily counters kept by the stream over the event table, read back after it has caught up."""
    folder = _folder(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("operation"))
    jobs.usage_daily(stream, folder + "/usage", folder + "/checkpoint").awaitTermination()
    counts = jobs.read_usage(spark, folder + "/usage")
    return counts.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


CHUNK_ROWS = 20


def commit_runs(spark, sf):
    """Chunks of every well uploaded through one stream, every run committed through another."""
    folder = _folder(spark)
    m = D.measurements(spark, sf).withColumn("chunk_index", F.floor(F.col("seq") / CHUNK_ROWS))
    item = F.struct("seq", "md", "inc", "az")
    uploads = m.groupBy(F.col("bore_id").alias("run_id"), "chunk_index").agg(F.array_sort(F.collect_list(item)).alias("_i"))
    uploads = uploads.select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("chunk_index")).alias("ts"),
        F.concat_ws("-", F.col("run_id").cast("string"), F.col("chunk_index").cast("string")).alias("upload_id"),
        "run_id", "chunk_index",
        F.transform("_i", lambda r: F.struct(r["md"].alias("md"), r["inc"].alias("inc"), r["az"].alias("az"))).alias("items"))
    uploads.unionByName(uploads.filter("chunk_index = 0")).write.parquet(folder + "/uploads")
    stream = spark.readStream.schema(uploads.schema).parquet(folder + "/uploads")
    jobs.ingest_chunks(stream, folder + "/chunks", folder + "/c1").awaitTermination()
    commits = uploads.select("ts", "run_id").groupBy("run_id").agg(F.max("ts").alias("ts"))
    commits.write.parquet(folder + "/commits")
    marks = spark.readStream.schema(commits.schema).parquet(folder + "/commits")
    jobs.commit_runs(marks, folder + "/chunks", folder + "/stations", folder + "/c2").awaitTermination()
    done = jobs.read_latest(spark, folder + "/stations", ["run_id", "seq"])
    return done.select(F.col("run_id").alias("bore_id"), "seq", "md", *[F.round(c, 6).alias(c) for c in ("north", "east", "tvd")])


TEXT = f"""
parsed AS (SELECT bore_id, event_id, seq, round(CASE WHEN event_id%97=0 THEN md-100.0 ELSE md END,5) AS md,
  radians(round(degrees(inc),5)) AS inc, radians(round(degrees(az),5)) AS az, event_id%89<>0 AND event_id%83=0 AS junk FROM meas),
marked AS (SELECT *, max(CASE WHEN NOT junk THEN md END) OVER (PARTITION BY bore_id ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deepest FROM parsed),
judged AS (SELECT *, NOT junk AND (deepest IS NULL OR md>deepest) AS accepted FROM marked)"""

QUERIES = {
    "import_steps": import_steps,
    "skipped_lines": skipped_lines,
    "fixed_width": fixed_width,
    "read_manifest": read_manifest,
    "import_batch": import_batch,
    "import_measurements": import_measurements,
    "load_documents": load_documents,
    "load_depth_lists": load_depth_lists,
    "load_sf_profiles": load_sf_profiles,
    "export_station_table": export_station_table,
    "export_wide": export_wide,
    "export_long": export_long,
    "export_covariance": export_covariance,
    "write_station_table": write_station_table,
    "write_pages": write_pages,
    "expire_sf_results": expire_sf_results,
    "usage_daily": usage_daily,
    "commit_runs": commit_runs,
}

ORACLES = {
    "import_steps": sql.query(sql.MEAS, TEXT, select="""
SELECT bore_id, row_number() OVER (PARTITION BY bore_id ORDER BY seq)-1 AS seq, round(md,4) AS md, round(inc,7) AS inc,
  round(az,7) AS az FROM judged WHERE accepted"""),
    "skipped_lines": sql.query(sql.MEAS, TEXT, select="""
SELECT bore_id, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (NOT accepted) AS n_skipped FROM judged GROUP BY 1"""),
    "read_manifest": sql.query(sql.MEAS, f"""
files AS (SELECT bore_id, CAST(floor(seq/{FILE_ROWS}) AS BIGINT) AS f, count(*) AS n FROM meas GROUP BY 1, 2),
placed AS (SELECT *, bore_id*1000+f AS k FROM files)""", select=f"""
SELECT k%{MANIFESTS} AS part, CAST(row_number() OVER (PARTITION BY k%{MANIFESTS} ORDER BY k)-1 AS INTEGER) AS row_index, 'r'||k AS row_id,
  CAST(bore_id AS VARCHAR) AS bore_id, CASE WHEN bore_id%17<>5 THEN 'tool' END AS instrument_id, 'Survey '||(bore_id%3)||'.txt {{"}}' AS file_name,
  CASE WHEN bore_id%2=0 THEN 'Ground/Mud line' ELSE 'Rotary table' END AS depth_reference, (k%{MANIFESTS})%2=0 AS replace_all,
  true AS replace_same_name, ',' AS "decimal", CASE WHEN bore_id%23<>7 THEN n+CASE WHEN f=0 THEN 1 ELSE 0 END END AS n_lines FROM placed"""),
    "fixed_width": sql.query(sql.MEAS, select="""
SELECT bore_id, seq, round(md,4) AS md, round(inc,6) AS inc, round(az,6) AS az FROM meas WHERE event_id%61<>0"""),
    "load_documents": sql.query(sql.TRAJ, select="""
SELECT CAST(traj_id AS VARCHAR) AS traj_id, name, CASE WHEN traj_id%3<>0 THEN 'field' END AS field_id,
  CAST(bore_id AS VARCHAR) AS bore_id, type, is_definitive, 10.0::DOUBLE AS md_step, modified
FROM traj WHERE traj_id%101<>0 AND traj_id%103<>0"""),
    "load_depth_lists": """
SELECT l_orderkey AS case_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)-1
  AS INTEGER) AS pos, l_quantity AS md, CASE WHEN l_linenumber%2<>0 THEN 'part '||l_partkey END AS annotation FROM lineitem""",
    "load_sf_profiles": """
SELECT event_id, CASE WHEN event_id%5<4 THEN CAST(event_id AS DOUBLE) END AS ref_md, CASE WHEN event_id%5<4 THEN value END AS cmp_md,
  CASE WHEN event_id%5<4 THEN 2.5::DOUBLE END AS sf FROM events""",
    "export_station_table": sql.query(sql.STN, select="""
SELECT bore_id, seq, round(md/0.3048::DOUBLE,6) AS md, round(degrees(inc),6) AS inc, round(degrees(az),6) AS az,
  round(tvd/0.3048::DOUBLE,6) AS tvd, round(north/0.3048::DOUBLE,6) AS north, round(degrees(dls)*30,6) AS dls,
  round(degrees(bur)*30,6) AS bur FROM stn"""),
    "export_wide": sql.query(sql.STN, select="SELECT bore_id-bore_id%5 AS case_id, seq, " + ", ".join(
        f'max(CASE WHEN bore_id%5={r} THEN {c} END) AS "{r}_{c}"' for r in range(5) for c in ("md", "tvd")) + " FROM stn GROUP BY 1,2"),
    "export_long": sql.query(sql.STN, select="SELECT bore_id-bore_id%5 AS case_id, bore_id%5 AS realization, seq, md, tvd FROM stn"),
    "export_covariance": sql.query(sql.STN, sql.TOOLS, sql.WOLFF, select="""
SELECT bore_id, count(*) AS n, round(sum(md),4) AS md, round(max(c00),6) AS c00 FROM cov GROUP BY 1"""),
    "write_station_table": sql.query(sql.MEAS, select="""
SELECT bore_id, count(*) AS n, max(seq) AS last, round(max(md)/0.3048,4) AS md, round(sum(degrees(inc)),3) AS inc FROM meas GROUP BY 1"""),
    "write_pages": sql.query(sql.MEAS, select="""
SELECT bore_id, CAST(floor(seq/1000) AS BIGINT) AS page, count(*) AS n_rows, min(md)+CASE WHEN bore_id%3=0 THEN 1.0 ELSE 0.0 END AS start_md,
  max(md)+CASE WHEN bore_id%3=0 THEN 1.0 ELSE 0.0 END AS end_md FROM meas GROUP BY bore_id, page"""),
    "expire_sf_results": "SELECT event_id FROM events WHERE ts>=(SELECT max(ts) FROM events)-INTERVAL 3600 SECOND",
    "usage_daily": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS operation, count(*) AS count FROM events GROUP BY 1,2",
    "commit_runs": sql.query(sql.STN.replace("END AS north0", "END*0 AS north0").replace("END AS east0", "END*0 AS east0"),
                             select="SELECT bore_id, seq, md, round(north,6) AS north, round(east,6) AS east, round(tvd,6) AS tvd FROM stn"),
}
