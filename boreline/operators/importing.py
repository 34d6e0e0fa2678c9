"""Import of a batch of survey files as one job: parse, datum, sidetrack cut, parents, names, records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreline.functions import blocks as B
from boreline.operators import hierarchy, interp, survey
from boreline.sources import documents, text


@dataclass
class ImportResult:
    runs: DataFrame
    measurements: DataFrame
    trajectories: DataFrame
    status: DataFrame


def import_batch(
    rows: DataFrame,
    bores: DataFrame,
    wells: DataFrame,
    clusters: DataFrame,
    rigs: DataFrame,
    existing_runs: DataFrame,
    existing_paths: DataFrame,
    sea_level: DataFrame | None = None,
) -> ImportResult:
    """Import manifest rows (see ``documents.manifest_rows``).

    All files are parsed at once, and all parent runs are found at once (see ``_with_parents``): a sidetrack may have its
    parent in the same batch.  A row fails with a reason when its wellbore is missing or unknown, it lacks file or
    instrument, has fewer than three stations, or needs a parent run and has none.  Every good row yields a run, its measurements and a path
    with one section that starts at the wellhead.

    ``existing_runs``: run_id, bore_id, name, first_md, last_md.  ``existing_paths``: traj_id, bore_id, name.
    """
    place = hierarchy.wellbore_depth_path(bores)
    rows = rows.join(place, "bore_id", "left")
    rows = rows.join(bores.select("bore_id", "well_id", "is_sidetrack", "parent_bore_id", "tie_in_md", "rig_id"), "bore_id", "left")
    rows = rows.join(wells.select("well_id", "cluster_id"), "well_id", "left")
    rows = rows.join(clusters.select(
        "cluster_id", "field_id", F.col("ref_depth.mean").alias("wellhead_md"), "ground_depth", "sea_depth",
        F.col("rig_id").alias("_cluster_rig"),
    ), "cluster_id", "left")
    rows = rows.withColumn("_rig", F.coalesce("rig_id", "_cluster_rig"))
    rows = rows.join(rigs.select(F.col("rig_id").alias("_rig"), "drill_floor"), "_rig", "left")
    if sea_level is not None:
        rows = rows.join(sea_level.select("bore_id", "sea_level_offset"), "bore_id", "left")
    else:
        rows = rows.withColumn("sea_level_offset", F.lit(None).cast("double"))

    def negative(c: str) -> Column:
        return F.coalesce(-F.col(c), F.lit(0.0))

    rows = rows.withColumn("offset", hierarchy.depth_offset(
        F.col("depth_reference"), negative("ground_depth"), F.coalesce("sea_level_offset", F.lit(0.0)),
        negative("sea_depth"), negative("drill_floor")))
    rows = B.durable(rows.drop("_rig", "_cluster_rig", "rig_id", "ground_depth", "sea_depth", "drill_floor"))

    key = ["row_id"]
    lines = documents.manifest_lines(rows).join(rows.select("row_id", "offset"), "row_id")
    measured = B.durable(text.measure_lines(lines, key, ["line_no"]))
    raw = text.accepted_measurements(measured, key, ["line_no"])
    as_bore = rows.filter("is_sidetrack").select(F.col("row_id").alias("bore_id"), "is_sidetrack", "tie_in_md")
    cut = interp.normalize_sidetrack_import(raw.withColumnRenamed("row_id", "bore_id"), as_bore)
    cut = B.durable(cut.withColumnRenamed("bore_id", "row_id"))

    step = B.with_previous(cut, key, ["seq"], ["md"])
    delta = F.col("md") - F.col("prev_md")
    facts = step.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n_stations"), F.min("md").alias("first_md"), F.max("md").alias("last_md"),
        F.coalesce(F.min_by(F.when(delta > 0, delta), F.when(delta > 0, F.col("seq"))), F.lit(10.0)).alias("md_step"),
    )
    counts = text.skipped_lines(measured, key)
    rows = rows.join(facts, "row_id", "left").join(counts, "row_id", "left").drop("content")
    reason = (
        F.when(F.col("depth").isNull(), F.lit("no wellbore"))
        .when(F.col("n_accepted").isNull(), F.lit("no file"))
        .when(F.col("instrument_id").isNull(), F.lit("no survey instrument"))
        .when(F.coalesce("n_stations", F.lit(0)) < 3, F.lit("fewer than three stations"))
    )
    needs = F.coalesce("is_sidetrack", F.lit(False)) | F.coalesce(F.col("first_md") > F.col("wellhead_md"), F.lit(False))
    base = F.regexp_replace(F.coalesce("file_name", F.lit("survey-run")), r"\.[^.]*$", "")
    # rows without wellbore have no turn; by themselves they are no group
    spot = F.struct("bore_id", F.when(F.col("bore_id").isNull(), F.col("row_id")))
    turn = F.row_number().over(Window.partitionBy(spot).orderBy("manifest", "row_index")) - 1
    rows = rows.withColumns({"reason": reason, "needs_parent": needs, "base": base, "turn": turn,
                             "run_id": F.concat(F.lit("run-"), "row_id")})
    rows = B.durable(rows)

    placed = _with_parents(rows, bores, existing_runs)
    good = B.durable(placed.filter("reason IS NULL"))
    named = _names(good, existing_runs, existing_paths)
    runs = named.select(
        "run_id", "row_id", "bore_id", "well_id", "cluster_id", "field_id", "instrument_id",
        F.col("parent_id").alias("parent_run_id"), F.col("run_name").alias("name"), "n_stations", "first_md", "last_md",
        F.lit(survey.MINIMUM_CURVATURE).alias("method"),
    )
    trajectories = named.select(
        F.coalesce("replaced_traj_id", F.concat(F.lit("path-"), "row_id")).alias("traj_id"), "bore_id", "run_id",
        F.col("path_name").alias("name"), F.concat(F.lit("Imported from "), F.coalesce("file_name", F.lit("survey run file")))
        .alias("description"), F.lit("Actual").alias("type"), F.lit(False).alias("is_definitive"), "md_step",
        F.coalesce("wellhead_md", "first_md", F.lit(0.0)).alias("start_md"),
        F.col("replaced_traj_id").isNotNull().alias("replaced"),
    )
    measurements = cut.join(good.select("row_id", "run_id"), "row_id").select("run_id", "seq", "md", "inc", "az", "annotation")
    status = placed.select(
        "row_id", "bore_id", "reason", F.coalesce("n_stations", F.lit(0)).alias("n_stations"),
        (F.coalesce("n_skipped", F.lit(0)) + F.coalesce(F.greatest(F.lit(0), _truncated()), F.lit(0))).alias("n_skipped"),
    )
    return ImportResult(runs, measurements, trajectories, status)


def _truncated() -> Column:
    """Stations cut above the tie-in depth: those accepted and no longer there, not counting the inserted one."""
    return F.when(F.col("is_sidetrack") & (F.col("first_md") == F.col("tie_in_md")), F.col("n_accepted") + 1 - F.col("n_stations"))


def _with_parents(rows: DataFrame, bores: DataFrame, existing_runs: DataFrame) -> DataFrame:
    """Resolve parent runs of all rows at once; rows that need one and have none fail.

    Only depth ranges of runs take part, one row per file.  Candidates of a row are the existing runs and the rows that
    come before it (by wellbore depth, then by turn on the wellbore) and are imported themselves.
    """
    good = rows.filter("reason IS NULL")
    old = existing_runs.select(F.col("run_id").cast("string").alias("run"), "bore_id", "first_md", "last_md",
                               F.lit(None).cast("string").alias("row"), F.lit(-1).alias("depth"), F.lit(-1).alias("turn"))
    new = good.select(F.col("run_id").alias("run"), "bore_id", "first_md", "last_md", F.col("row_id").cast("string").alias("row"), "depth", "turn")
    pool = B.stack(["bore_id"], old, new).select(F.struct("run", "row", "depth", "turn").alias("run_id"), "bore_id", "first_md", "last_md")
    asked = good.filter("needs_parent").select("row_id", "bore_id", "first_md")
    found = hierarchy.parent_run_candidates(asked, bores, pool).select("row_id", F.col("run_id").alias("_of"))
    own = good.select("row_id", F.struct("depth", "turn").alias("_place"), F.col("parent_run_id").alias("_given"))
    earlier = F.col("_of.row").isNull() | (F.struct("_of.depth", "_of.turn") < F.col("_place"))
    edges = found.join(own, "row_id").filter(earlier).select(
        F.col("row_id").cast("string").alias("row"), F.col("_of.run").alias("run"), F.col("_of.row").alias("of"),
        F.col("_given").isNotNull().alias("asks"), F.coalesce(F.col("_given") == F.col("_of.run"), F.lit(False)).alias("given"))
    edges = B.durable(edges)
    free = good.filter("NOT needs_parent").select(F.col("row_id").cast("string").alias("row"), F.lit(True).alias("taken"))
    alone = asked.select(F.col("row_id").cast("string").alias("row")).join(edges.select("row"), "row", "left_anti")
    decided = _accepted(edges, free.unionByName(alone.withColumn("taken", F.lit(False))))
    able = edges.join(decided.filter("taken").select(F.col("row").alias("of")), "of", "left_semi").select("row", "run", "asks", "given")
    able = able.unionByName(edges.filter("of IS NULL").select("row", "run", "asks", "given")).filter("given OR NOT asks")
    parents = able.groupBy(F.col("row").alias("_row")).agg(F.min("run").alias("parent_id"), F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    placed = rows.withColumn("_row", F.when(F.col("reason").isNull() & F.col("needs_parent"), F.col("row_id").cast("string")))
    placed = placed.join(parents.drop("_n"), "_row", "left")
    lacks = F.col("_row").isNotNull() & F.col("parent_id").isNull()
    return B.durable(placed.withColumn("reason", F.when(lacks, F.lit("no parent survey run")).otherwise(F.col("reason"))).drop("_row"))


def _accepted(edges: DataFrame, decided: DataFrame) -> DataFrame:
    """Which rows are imported: ``row``, ``taken``.

    ``edges``: row, candidate ``run``, its row ``of`` (null: an existing run), ``asks`` (a parent is named), ``given``
    (this is the one).  A row is taken if the candidate it names is, or if exactly one candidate is when it names none.
    Once a single candidate is open the answer equals that candidate's, or is its opposite, so chains of such rows
    are shortened by pointer doubling; rounds grow with how deeply open choices of several candidates nest, and the
    steps of a round with the logarithm of the files on a wellbore.
    """
    decided = B.durable(decided)
    while True:
        left = edges.join(decided.select("row"), "row", "left_anti")
        seen = left.join(decided.select(F.col("row").alias("of"), "taken"), "of", "left")
        yes = F.col("of").isNull() | F.coalesce("taken", F.lit(False))
        still = F.col("of").isNotNull() & F.col("taken").isNull()
        counts = seen.groupBy("row").agg(
            F.first("asks").alias("asks"), F.count_if(yes).alias("n"), F.count_if(still).alias("open"),
            F.bool_or(F.col("given") & yes).alias("sure"), F.max(F.when(still, F.col("of"))).alias("any"),
            F.max(F.when(F.col("given") & still, F.col("of"))).alias("named"))
        answer = F.when(F.col("asks"), F.when(F.col("sure"), True).when(F.col("named").isNull(), False)).otherwise(
            F.when(F.col("n") > 1, False).when(F.col("open") == 0, F.col("n") == 1))
        follows = F.when(F.col("asks"), F.col("named")).when(F.col("open") == 1, F.col("any"))
        counts = counts.select("row", answer.alias("taken"), F.when(answer.isNull(), follows).alias("to"),
                               (~F.col("asks") & (F.col("n") == 1)).alias("flip"))
        counts = B.durable(counts)
        if counts.isEmpty():
            return decided
        settled = B.durable(decided.unionByName(counts.filter("taken IS NOT NULL").select("row", "taken")))
        links = counts.filter("to IS NOT NULL").select("row", "to", "flip")
        while True:
            after = links.select(F.col("row").alias("to"), F.col("to").alias("_to"), F.col("flip").alias("_flip"))
            longer = links.join(after, "to", "left")
            links = B.durable(longer.select(
                "row", F.coalesce("_to", "to").alias("to"), (F.col("flip") != F.coalesce("_flip", F.lit(False))).alias("flip"),
                F.col("_to").isNotNull().alias("moved")))
            if links.filter("moved").isEmpty():
                break
            links = links.drop("moved")
        ends = settled.select(F.col("row").alias("to"), "taken")
        followed = links.join(ends, "to").select("row", (F.col("taken") != F.col("flip")).alias("taken"))
        decided = B.durable(settled.unionByName(followed))


def _names(good: DataFrame, existing_runs: DataFrame, existing_paths: DataFrame) -> DataFrame:
    """Run and path names free on their wellbore, and the existing path a row replaces."""
    runs = _free_names(good, existing_runs.select("bore_id", "name"), "run_name")
    first = existing_paths.select("bore_id", F.lower("name").alias("_same"), F.col("traj_id").cast("string").alias("traj_id"))
    first = first.groupBy("bore_id", "_same").agg(F.min("traj_id").alias("_old"))
    df = runs.withColumn("_same", F.lower("base")).join(first, ["bore_id", "_same"], "left")
    replaced = F.when(~F.col("replace_all") & F.col("replace_same_name"), F.col("_old"))
    df = B.durable(df.withColumn("replaced_traj_id", replaced).drop("_same", "_old"))
    # replacing everything on a wellbore frees its names
    cleared = df.filter("replace_all").select("bore_id").distinct()
    taken = existing_paths.select("bore_id", "name").join(cleared, "bore_id", "left_anti")
    kept = df.filter("replaced_traj_id IS NOT NULL").withColumn("path_name", F.col("base"))
    fresh = _free_names(df.filter("replaced_traj_id IS NULL"), taken, "path_name")
    return B.stack(["bore_id"], fresh, kept.select(*fresh.columns))


def _free_names(rows: DataFrame, taken: DataFrame, name: str) -> DataFrame:
    """The k-th row of a base name on a wellbore gets the k-th free name of base, base (2), base (3), ..."""
    key = ["bore_id", "_base"]
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("manifest", "row_index"))
    asked = rows.withColumn("_base", F.lower("base")).withColumn("_k", turn)
    pattern = r"^(.*) \(([1-9][0-9]{0,8})\)$"
    low = F.lower("name")
    used = taken.select("bore_id", F.explode(F.array(
        F.struct(low.alias("_base"), F.lit(1).alias("_n")),
        F.struct(F.regexp_extract(low, pattern, 1).alias("_base"), F.regexp_extract(low, pattern, 2).try_cast("int").alias("_n")),
    )).alias("_u")).select("bore_id", "_u.*").filter("_n IS NOT NULL AND _base <> ''").distinct()
    groups = asked.groupBy(*key).agg(F.max("_k").alias("_m"))
    mine = used.join(groups, key, "left_semi").groupBy(*key).agg(F.collect_set("_n").alias("_used"))
    slots = groups.join(mine, key, "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<int>")))
    free = F.array_except(F.sequence(F.lit(1), F.col("_m") + F.size("_used") + 1), F.col("_used"))
    numbers = slots.select(*key, F.posexplode(F.array_sort(free)).alias("_p", "_n")).withColumn("_k", F.col("_p") + 1)
    joined = asked.join(numbers.select(*key, "_k", "_n"), [*key, "_k"])
    full = F.when(F.col("_n") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), F.col("_n").cast("string"), F.lit(")")))
    return joined.withColumn(name, full).select(*rows.columns, name)
