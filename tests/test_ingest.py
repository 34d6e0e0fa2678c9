from __future__ import annotations

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from boreline.functions import blocks as B
from boreline.operators import exports, importing
from boreline.sources import documents, text
from boreline.streaming import jobs


@pytest.mark.parametrize(
    "token, marker, want",
    [
        ("1,234.5", "Auto", 1234.5), ("1.234,5", "Auto", 1234.5), ("12,5", "Auto", 12.5), ("1,234,5", "Auto", None),
        ("1,234.5", "Dot (.)", 1234.5), ("1.234,5", "Comma (,)", 1234.5), (" -3e2 ", "Auto", -300.0), ("1d", "Auto", None),
        ("abc", "Auto", None), ("", "Auto", None), ("NaN", "Auto", None), ("+7.", "Auto", 7.0),
    ],
)
def test_numbers(spark, token, marker, want):
    df = spark.createDataFrame([(token, marker)], "t string, m string")
    assert df.select(text.parse_number(F.col("t"), F.col("m"))).first()[0] == want


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("MD;Inc;Az\r\n0;0;0\r\n10;1,5;90\r\n5;1;1\r\n\r\n20\t3\t180\n")
    (tmp_path / "b.txt").write_text("1 2 3\n2 3 4\n")
    got = text.read_surveys(spark, str(tmp_path)).withColumn("f", F.element_at(F.split("file", "/"), -1)).orderBy("f", "seq").collect()
    assert [(r.f, r.seq, r.md) for r in got] == [("a.txt", 0, 0.0), ("a.txt", 1, 10.0), ("a.txt", 2, 20.0), ("b.txt", 0, 1.0), ("b.txt", 1, 2.0)]
    assert got[1].inc == pytest.approx(0.02617993878) and got[1].az == pytest.approx(1.57079632679)


def test_split_files_keep_their_order(spark, tmp_path):
    """A file read in many splits gives the same rows as one read whole."""
    lines = [f"{i if i % 50 else i - 30};{i % 90};{i % 360}" for i in range(3000)]
    (tmp_path / "big.txt").write_text("\n".join(lines))
    want = text.read_surveys(spark, str(tmp_path)).orderBy("seq").toPandas()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert B.is_split(text.read_lines(spark, str(tmp_path)))
        got = text.read_surveys(spark, str(tmp_path)).orderBy("seq").toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got.md.tolist() == want.md.tolist() and len(got) == len(want) > 2900


def _manifest(spark, tmp_path, rows, **top):
    rows = [{**r, "FileContentBase64": base64.b64encode(r.pop("text").encode()).decode()} if "text" in r else r for r in rows]
    (tmp_path / "batch.json").write_text(json.dumps({"Rows": rows, **top}))
    return documents.read_batch_manifest(spark, str(tmp_path / "batch.json"))


def test_import_batch(spark, tmp_path):
    main = "0;0;0\n100;10;20\n200;20;20\nbad line\n300;30;20"
    side = "100;10;20\n180;18;20\n260;40;30\n340;50;30"
    rows = [
        {"RowId": "s", "WellBoreId": "2", "SurveyInstrumentId": "t", "FileName": "Side.txt", "text": side},
        {"RowId": "m", "WellBoreId": "1", "SurveyInstrumentId": "t", "FileName": "Main.v1.txt", "text": main},
        {"RowId": "x", "WellBoreId": "1", "FileName": "NoTool.txt", "text": main},
        {"RowId": "y", "WellBoreId": "1", "SurveyInstrumentId": "t", "FileName": "Short.txt", "text": "0;0;0\n1;1;1"},
        {"RowId": "z", "WellBoreId": "1", "SurveyInstrumentId": "t", "FileName": "Empty.txt"},
        {"RowId": "w", "WellBoreId": documents.NO_ID, "SurveyInstrumentId": "t", "FileName": "NoBore.txt", "text": main},
        {"RowId": "v", "WellBoreId": "77", "SurveyInstrumentId": "t", "FileName": "Strange.txt", "text": main},
    ]
    manifest = _manifest(spark, tmp_path, rows, Settings={"SelectedSurveyImportSeparator": "Semicolon (;)"})
    bores = spark.createDataFrame([("1", "A", 1, False, None, None, None), ("2", "A T2", 1, True, "1", 150.0, None)],
                                  "bore_id string, name string, well_id long, is_sidetrack boolean, parent_bore_id string, tie_in_md double, rig_id long")
    wells = spark.createDataFrame([(1, 5)], "well_id long, cluster_id long")
    clusters = spark.createDataFrame([(5, 9, (0.0, 1.0), 0.0, 0.0, None)], "cluster_id long, field_id long, ref_depth struct<mean: double, std: double>, ground_depth double, sea_depth double, rig_id long")
    rigs = spark.createDataFrame([], "rig_id long, drill_floor double")
    runs = spark.createDataFrame([("o", "1", "main.v1", 0.0, 50.0)], "run_id string, bore_id string, name string, first_md double, last_md double")
    paths = spark.createDataFrame([("p", "2", "SIDE")], "traj_id string, bore_id string, name string")
    done = importing.import_batch(manifest, bores, wells, clusters, rigs, runs, paths)
    status = {r.row_id: r for r in done.status.collect()}
    assert status["m"].reason is None and status["m"].n_stations == 4 and status["m"].n_skipped == 1
    assert status["s"].reason is None and status["s"].n_stations == 4 and status["s"].n_skipped == 1
    assert {k: status[k].reason for k in "xyzwv"} == {
        "x": "no survey instrument", "y": "fewer than three stations", "z": "no file", "w": "no wellbore", "v": "no wellbore"}
    got = {r.row_id: r for r in done.runs.collect()}
    assert got["m"].name == "Main.v1 (2)" and got["m"].parent_run_id is None
    assert got["s"].parent_run_id == "run-m" and got["s"].name == "Side"
    names = {r.run_id: (r.traj_id, r.name, r.replaced, r.md_step) for r in done.trajectories.collect()}
    assert names["run-s"] == ("path-s", "Side (2)", False, 30.0) and names["run-m"][1] == "Main.v1"
    first = done.measurements.filter("run_id = 'run-s'").orderBy("seq").first()
    assert first.md == 150.0 and first.annotation == "Sidetrack tie-in"


def test_manifest_is_read_in_pieces(spark, tmp_path):
    """The same rows as by a reader of whole files, however the text is cut."""
    tops = [
        {"CommonDepthReference": 'a{"b}[', "Settings": {"SelectedSurveyImportMDUnit": "}ft{", "SurveyImportMDColumn": 3}},
        {"Other": [{"RowId": "no"}, {"RowId": "no", "deep": {"x": [{}]}}], "ReplaceExistingTrajectories": True}, {},
    ]
    for i, top in enumerate(tops):
        rows = [{"RowId": f"r{k}", "WellBoreId": f"b\\{{{k}", "FileName": 'x}\\"{ é\\', "Extra": {"a": {"b": "}"}},
                 "FileContentBase64": base64.b64encode(("1;2;3\n" * (k * 7 % 50)).encode()).decode()} for k in range(60 if i < 2 else 0)]
        rows = rows + [{}] if i == 0 else rows
        body = {**top, "Rows": rows, "SelectedWellId": "w", "ReplaceTrajectoriesWithSameName": i == 0}
        (tmp_path / f"m{i}.json").write_text(json.dumps(body, indent=[None, 2, 1][i], ensure_ascii=i == 1))
    whole = spark.read.schema(documents.MANIFEST_SCHEMA).json(str(tmp_path), multiLine=True)
    whole = documents.manifest_rows(whole.withColumn("manifest", F.col("_metadata.file_path")))
    want = sorted(map(tuple, whole.collect()), key=str)
    assert len(want) == 121
    for size in ("128MB", "1000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1" if size == "1000" else "4MB")
        try:
            got = documents.read_batch_manifest(spark, str(tmp_path)).select(whole.columns)
            assert sorted(map(tuple, got.collect()), key=str) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_parents_of_all_rows_at_once(spark):
    """Chains, named parents, ambiguous and rejected candidates against rows taken one after the other."""
    rng = random.Random(5)
    bores, rows, runs = [], [], []
    for bore in range(60):
        parent = rng.randrange(bore) if bore and rng.random() < 0.6 else None
        bores.append((bore, parent is not None, parent, rng.choice([None, 50.0, 120.0]) if parent is not None else None))
        if rng.random() < 0.4:
            low = rng.choice([0.0, 100.0])
            runs.append((f"old{bore}", bore, low, low + rng.choice([30.0, 100.0])))
    level = {}
    for bore, _, parent, _ in bores:
        level[bore] = 0 if parent is None else level[parent] + 1
    for bore in range(60):
        low = rng.choice([0.0, 60.0, 120.0])
        for turn in range(rng.choice([1, 2, 5, 12])):
            named = rng.choice([None] * 6 + [f"run-{bore}-{turn - 1}", "old3", f"old{bore}"])
            rows.append((f"{bore}-{turn}", f"run-{bore}-{turn}", bore, level[bore], turn, None if rng.random() < 0.9 else "bad",
                         turn > 0 or rng.random() < 0.4, named, low, low + 40.0))
            low += rng.choice([20.0, 40.0, 45.0, 60.0])
    # one long chain, every file from the end of the one before
    bores.append((99, False, None, None))
    rows += [(f"c{i}", f"run-c{i}", 99, 0, i, None, i > 0, None, 100.0 * i, 100.0 * i + 95.0) for i in range(70)]
    info = {b[0]: b[1:] for b in bores}
    # runs of the same level and turn do not see each other: take them step by step
    pool = list(runs)
    done = {}
    for step in sorted({(r[3], r[4]) for r in rows}):
        fresh = []
        for row, run, bore, depth, turn, reason, needs, named, low, high in rows:
            if (depth, turn) != step:
                continue
            side, parent, tie = info[bore]
            where, at = (parent, low if tie is None else tie) if side else (bore, low)
            fit = [q for q, b, lo, hi in pool if b == where and (lo <= at <= hi or (hi <= at and at - hi <= 10.0))]
            got = (named if named in fit else None) if named else (fit[0] if len(fit) == 1 else None)
            lost = reason or ("no parent survey run" if needs and got is None else None)
            done[row] = (lost, got if needs and not reason else None)
            if lost is None:
                fresh.append((run, bore, low, high))
        pool += fresh
    table = spark.createDataFrame(rows, "row_id string, run_id string, bore_id long, depth int, turn int, reason string, needs_parent boolean,"
                                        " parent_run_id string, first_md double, last_md double")
    wells = spark.createDataFrame(bores, "bore_id long, is_sidetrack boolean, parent_bore_id long, tie_in_md double")
    old = spark.createDataFrame(runs, "run_id string, bore_id long, first_md double, last_md double")
    got = {r.row_id: (r.reason, r.parent_id) for r in importing._with_parents(table, wells, old).collect()}
    assert got == done
    assert done["c69"] == (None, "run-c68") and sum(v[0] == "no parent survey run" for v in done.values()) > 30


def test_replace_modes(spark, tmp_path):
    body = "0;0;0\n100;10;20\n200;20;20"
    bores = spark.createDataFrame([("1", "A", 1, False, None, None, None)], "bore_id string, name string, well_id long, is_sidetrack boolean, parent_bore_id string, tie_in_md double, rig_id long")
    wells = spark.createDataFrame([(1, 5)], "well_id long, cluster_id long")
    clusters = spark.createDataFrame([(5, 9, (0.0, 1.0), 0.0, 0.0, None)], "cluster_id long, field_id long, ref_depth struct<mean: double, std: double>, ground_depth double, sea_depth double, rig_id long")
    rigs = spark.createDataFrame([], "rig_id long, drill_floor double")
    runs = spark.createDataFrame([], "run_id string, bore_id string, name string, first_md double, last_md double")
    paths = spark.createDataFrame([("p", "1", "MAIN")], "traj_id string, bore_id string, name string")
    rows = [{"RowId": "m", "WellBoreId": "1", "SurveyInstrumentId": "t", "FileName": "Main.txt", "text": body}]
    want = {(True, False): ("path-m", "Main"), (False, True): ("p", "Main"), (False, False): ("path-m", "Main (2)")}
    for (all_, same), answer in want.items():
        m = _manifest(spark, tmp_path, [dict(r) for r in rows], ReplaceExistingTrajectories=all_, ReplaceTrajectoriesWithSameName=same)
        got = importing.import_batch(m, bores, wells, clusters, rigs, runs, paths).trajectories.collect()
        assert [(r.traj_id, r.name) for r in got] == [answer]


def test_profiles_and_lists(spark):
    text_ = '[{"ReferenceMD":1,"ComparisonMD":-1,"SeparationFactor":5},{"Left":1,"Middle":2,"Right":3},[1,2],[4,5,6],{"Item1":1,"Item2":2}]'
    rows, bad = documents.load_sf_profiles(spark.createDataFrame([(7, text_)], "id long, profile string"))
    assert sorted((r.seq, r.ref_md, r.cmp_md, r.sf) for r in rows.collect()) == [(0, 1, -1, 5), (1, 1, 2, 3), (3, 4, 5, 6)]
    assert sorted(r.seq for r in bad.collect()) == [2, 4]
    lists = documents.load_depth_lists(spark.createDataFrame([(1, '[1.5, {"Abscissa": 2, "Annotation": "x"}, {"Annotation": "y"}]')], "id long, depths string"))
    assert [(r.pos, r.md, r.annotation) for r in lists.orderBy("pos").collect()] == [(0, 1.5, None), (1, 2.0, "x")]


def test_chunk_stream_is_idempotent(spark, tmp_path):
    schema = "ts timestamp, upload_id string, run_id long, chunk_index long, items array<struct<md: double, inc: double, az: double>>"
    rows = [
        ("2024-01-01 00:00:00", "a", 1, 0, [(0.0, 0.0, 0.0), (10.0, 0.1, 0.0)]),
        ("2024-01-01 00:00:00", "a", 1, 0, [(0.0, 0.0, 0.0), (10.0, 0.1, 0.0)]),
        ("2024-01-01 00:01:00", "b", 1, 1, [(20.0, 0.2, 0.0)]),
        ("2024-01-01 00:02:00", "c", 1, 1, [(25.0, 0.2, 0.0), (30.0, 0.2, 0.1)]),
        ("2024-01-01 00:02:00", "d", 2, 0, []),
        ("2024-01-01 00:02:00", "e", 2, 1, [(5.0, 0.0, 0.0), (4.0, 0.0, 0.0)]),
    ]
    df = spark.createDataFrame(rows, schema.replace("timestamp", "string", 1)).withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "chunks")
    for _ in range(2):
        jobs.ingest_chunks(stream, out, str(tmp_path / "c")).awaitTermination()
    stored = jobs.read_latest(spark, out, ["run_id", "chunk_index"], "ts")
    got = jobs.run_measurements(stored).orderBy("seq").collect()
    assert [(r.seq, r.md) for r in got] == [(0, 0.0), (1, 10.0), (2, 25.0), (3, 30.0)]
    assert sorted(r.reason for r in spark.read.parquet(out + "_rejects").collect()) == ["depth not increasing", "empty chunk"]


def test_pages_replace_only_their_owner(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = spark.createDataFrame([(w, i, float(i)) for w in (1, 2) for i in range(1500)], "bore_id long, seq long, md double")
    exports.write_pages(rows, path, "bore_id")
    exports.write_pages(rows.filter("bore_id = 1 AND seq < 10"), path, "bore_id")
    back = spark.read.parquet(path)
    assert {r.bore_id: r["count"] for r in back.groupBy("bore_id").count().collect()} == {1: 10, 2: 1500}
    assert back.filter("bore_id = 2").agg(F.max("page")).first()[0] == 1


def test_sanitize(spark):
    df = spark.createDataFrame([("a\tb\r\nc ",)], "t string")
    assert df.select(exports.sanitize_field(F.col("t"))).first()[0] == "a b  c"


def test_late_events_count(spark, tmp_path):
    """Events of a day that was counted long before are added to it, and repeated batches are not counted twice."""
    folder = tmp_path / "in"
    schema = "ts timestamp, operation string"

    def upload(*stamps):
        rows = [(s, "open") for s in stamps]
        spark.createDataFrame(rows, "ts string, operation string").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(str(folder))

    for stamps in (["2024-03-01 10:00:00", "2024-03-01 11:00:00"], ["2024-05-01 10:00:00"], ["2024-03-01 23:59:59"]):
        upload(*stamps)
        stream = spark.readStream.schema(schema).parquet(str(folder))
        jobs.usage_daily(stream, str(tmp_path / "usage"), str(tmp_path / "c")).awaitTermination()
    counts = jobs.read_usage(spark, str(tmp_path / "usage")).collect()
    assert {str(r["day"]): r["count"] for r in counts} == {"2024-03-01": 3, "2024-05-01": 1}


def test_a_commit_reads_its_own_folders(spark, tmp_path):
    item = [(0.0, 0.0, 0.0), (10.0, 0.1, 0.0)]
    schema = "ts timestamp, upload_id string, run_id long, chunk_index long, items array<struct<md: double, inc: double, az: double>>"
    rows = [("2024-01-01 00:00:00", f"u{k}", k, 0, item) for k in range(40)]
    df = spark.createDataFrame(rows, schema.replace("timestamp", "string", 1)).withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.ingest_chunks(stream, str(tmp_path / "chunks"), str(tmp_path / "c")).awaitTermination()
    one = jobs.committed_chunks(spark.createDataFrame([(7,)], "run_id long"), str(tmp_path / "chunks"))
    assert [r["run_id"] for r in one.collect()] == [7]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_late_chunks_are_stored_and_listed(spark, tmp_path):
    """A chunk two days late, and a retry of it, after its run was committed."""
    schema = "ts string, upload_id string, run_id long, chunk_index long, items array<struct<md: double, inc: double, az: double>>"
    out, checkpoint, folder = str(tmp_path / "chunks"), str(tmp_path / "c"), str(tmp_path / "in")

    def upload(*rows):
        df = spark.createDataFrame([(*r, [(100.0 * r[3] + 1.0, 0.0, 0.0), (100.0 * r[3] + 9.0, 0.1, 0.0)]) for r in rows], schema).withColumn("ts", F.to_timestamp("ts"))
        df.write.mode("append").parquet(folder)
        jobs.ingest_chunks(spark.readStream.schema(df.schema).parquet(folder), out, checkpoint).awaitTermination()

    upload(("2024-01-09 00:00:00", "a", 1, 0), ("2024-01-09 00:00:01", "b", 2, 0))
    upload(("2024-01-07 00:00:00", "c", 1, 1), ("2024-01-10 00:00:00", "d", 2, 1))
    upload(("2024-01-07 00:00:00", "c", 1, 1))
    commits = spark.createDataFrame([("2024-01-09 12:00:00", 1), ("2024-01-09 12:00:00", 2)], "ts string, run_id long").withColumn("ts", F.to_timestamp("ts"))
    stored = jobs.committed_chunks(commits, out)
    assert sorted((r.run_id, r.chunk_index) for r in stored.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert [(r.run_id, r.chunk_index) for r in jobs.chunks_after_commit(commits, out).collect()] == [(2, 1)]


def test_unlisted_realizations_are_an_error(spark):
    points = spark.createDataFrame([(1, r, 0, 1.0, 2.0, 3.0, 4.0) for r in range(3)], "case_id long, realization int, seq long, md double, north double, east double, tvd double")
    assert exports.export_realizations_wide(points, [0, 1, 2]).count() == 1
    with pytest.raises(Exception, match="realization not listed: 2"):
        exports.export_realizations_wide(points, [0, 1]).collect()


def test_exported_files_are_in_order(spark, tmp_path):
    rows = [(b, k, float(k), 1.0, 1.0, 1.0, 0.0, 0.0, 0.0) for b in (1, 2) for k in range(500)]
    names = "bore_id long, seq long, md double, c00 double, c11 double, c22 double, c01 double, c02 double, c12 double"
    exports.export_covariance(spark.createDataFrame(rows, names).repartition(9), str(tmp_path / "cov"))
    for folder in (tmp_path / "cov").glob("bore_id=*"):
        depths = [float(line.split(";")[0]) for f in sorted(folder.glob("part-*")) for line in f.read_text().splitlines() if line[0] != "m"]
        assert depths == [float(k) for k in range(500)]
