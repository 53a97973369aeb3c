"""The normalized tables on shared storage.

Each load writes its rows under its own load id and becomes visible with commit rows written
last, so readers see all three tables of a year or none, also when a job dies half way.
A commit that replaces, compacts or deletes names the load ids it supersedes. What is named
stays dead, what is not named stays live: neither clocks nor the order of commits matter, an append
that lands during a compaction is kept, and a repeated load id changes nothing.

Two commits that replace the same year at once can't name each other. Readers then all choose the same one:
a replacement before a compaction, and of several the one with the largest load id. The others count as
never committed, so what only they have named is live again if it is an append.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from casemill import spec
from casemill.operators import quality, rates, reshape
from casemill.session import scratch_path, without_shuffles
from casemill.sources import files
from casemill.sources.wide_csv import read_wide_csv, stage_wide

TABLES = ("households", "household_members", "qc_errors")
# What ``sources.rollups`` keeps for each load.
PARTIALS = ("state_error_rates", "error_element_rollup", "demographic_profile", "orphans")
_COMMIT = (
    "fiscal_year INT, load_id STRING, action STRING, supersedes ARRAY<STRING>, committed_at BIGINT,"
    " households BIGINT, household_members BIGINT, qc_errors BIGINT"
)
_REFRESH = "aggregate STRING, fiscal_year INT, refresh_id STRING, version BIGINT"
_DELETED = "table_name STRING, fiscal_year INT, rows_deleted BIGINT"
_HISTORY = (
    "load_id STRING, fiscal_year INT, total_rows_in_file BIGINT, rows_loaded BIGINT, rows_skipped BIGINT,"
    " households_created BIGINT, members_created BIGINT, errors_created BIGINT, percent_complete INT,"
    " load_status STRING, error_message STRING, recorded_at BIGINT"
)


def _append(spark: SparkSession, path: str, rows: list[tuple], schema: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def _read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def commits(spark: SparkSession, root: str) -> DataFrame:
    return _read_log(spark, f"{root}/commits", _COMMIT)


def load_states(spark: SparkSession, root: str) -> DataFrame:
    """Per fiscal year, the ids of committed loads: ``standing`` (nobody has superseded them), ``lost`` and ``live``.

    One pass over the log, which has a row for each load and year.
    """
    entry = F.struct("load_id", "action", "supersedes")
    years = commits(spark, root).groupBy("fiscal_year").agg(F.collect_list(entry).alias("log"))

    def ids(entries):
        return F.transform(entries, lambda e: e["load_id"])

    def named(entries):
        return F.flatten(F.transform(entries, lambda e: e["supersedes"]))

    def of(*actions):
        return F.filter("log", lambda e: e["action"].isin(*actions))

    years = years.withColumn("standing", F.array_except(ids(of("replace", "compact", "append")), named(F.col("log"))))
    replaced = F.array_sort(F.array_intersect("standing", ids(of("replace"))))
    compacted = F.array_sort(F.array_intersect("standing", ids(of("compact"))))
    years = years.withColumns({"first": F.coalesce(F.try_element_at(replaced, F.lit(-1)), F.try_element_at(compacted, F.lit(-1))), "claims": F.concat(replaced, compacted)})
    years = years.withColumn("lost", F.filter("claims", lambda load: load != F.col("first")))
    valid = F.filter("log", lambda e: ~F.array_contains("lost", e["load_id"]))
    back = F.array_except(ids(of("append")), named(valid))
    return years.select("fiscal_year", "standing", "lost", F.array_union(F.array_except("standing", "lost"), back).alias("live"))


def live_loads(spark: SparkSession, root: str) -> DataFrame:
    """``(fiscal_year, load_id)`` readers may see; of replacements that met, one for each year."""
    return load_states(spark, root).select("fiscal_year", F.explode("live").alias("load_id"))


def lost_loads(spark: SparkSession, root: str) -> DataFrame:
    """Replacements and compactions that stand beside another one of their year, which readers prefer."""
    return load_states(spark, root).select("fiscal_year", F.explode("lost").alias("load_id"))


def superseded_loads(spark: SparkSession, root: str) -> DataFrame:
    return commits(spark, root).select("fiscal_year", F.explode("supersedes").alias("load_id")).distinct()


def _commit(
    spark: SparkSession, root: str, years: Iterable[int], load_id: str, action: str, dead: DataFrame | None, written: Mapping[str, int]
) -> None:
    """One row per year, written in one file; ``dead`` has the loads it supersedes."""
    counts = [written.get(table, 0) for table in TABLES]
    rows = spark.createDataFrame(
        [(int(year), load_id, action, time.time_ns(), *counts) for year in years],
        "fiscal_year INT, load_id STRING, action STRING, committed_at BIGINT, households BIGINT, household_members BIGINT, qc_errors BIGINT",
    )
    if dead is None:
        rows = rows.withColumn("supersedes", F.array().cast("array<string>"))
    else:
        named = dead.filter(F.col("load_id") != load_id).groupBy("fiscal_year").agg(F.collect_set("load_id").alias("supersedes"))
        rows = rows.join(named, "fiscal_year", "left").withColumn("supersedes", F.coalesce("supersedes", F.array().cast("array<string>")))
    rows.coalesce(1).write.mode("append").json(f"{root}/commits")


def loaded_years(spark: SparkSession, root: str) -> DataFrame:
    return live_loads(spark, root).select("fiscal_year").distinct()


def years_to_load(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming fiscal years that are not loaded yet."""
    return incoming.select("fiscal_year").distinct().join(existing.select("fiscal_year"), "fiscal_year", "left_anti")


def write_table(
    df: DataFrame, root: str, table: str, load_id: str, observation: Observation | None = None
) -> None:
    """One table of one load, by year; a load that starts over replaces its own files only."""
    out = df.withColumn("load_id", F.lit(load_id))
    if observation is not None:
        out = out.observe(observation, F.count(F.lit(1)).alias("rows"))
    with without_shuffles(df.sparkSession):
        (
            out.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd")
            .partitionBy("fiscal_year", "load_id")
            .parquet(f"{root}/{table}")
        )


def _years_of(spark: SparkSession, root: str, load_id: str) -> set[int]:
    """Years a load has written, by its folders."""
    found = set()
    for table in TABLES:
        for path in files.matching(spark, f"{root}/{table}/fiscal_year=*/load_id={load_id}"):
            found.add(path.rstrip("/").split("/")[-2].removeprefix("fiscal_year="))
    if any(not year.lstrip("-").isdigit() for year in found):
        raise ValueError(f"load {load_id} has rows without a fiscal year; nothing was committed")
    return {int(year) for year in found}


def committed_load(spark: SparkSession, root: str, load_id: str) -> dict[str, int] | None:
    """Rows per table of a load that has been committed, whether it is live or not; None otherwise."""
    row = commits(spark, root).filter(F.col("load_id") == load_id).select(*TABLES).first()
    return None if row is None else row.asDict()


def write_all(
    spark: SparkSession,
    root: str,
    households: DataFrame,
    members: DataFrame,
    errors: DataFrame,
    years: Iterable[int] | None = None,
    load_id: str | None = None,
    action: str = "replace",
    before_commit: Callable[[], None] | None = None,
    claimed: DataFrame | None = None,
) -> dict[str, int]:
    """Write the three tables and make them visible together; returns rows written per table.

    ``years`` are the years the load stands for, also those it has no rows of; None takes them from the
    data. Rows of a year that is not among them fail the load before anything is visible. A load id that
    was committed before, live or superseded since, is left as it is. What ``before_commit`` raises keeps the
    written rows invisible. A replacement names the ``claimed`` loads, or those that stand when its rows are written;
    what lands later stays beside it, but for another replacement of the year.
    """
    load_id = load_id or uuid.uuid4().hex
    known = committed_load(spark, root, load_id)
    if known is not None:
        return known
    return _write_and_commit(spark, root, (households, members, errors), years, load_id, action, claimed, before_commit)


def _write_and_commit(
    spark, root, frames, years, load_id, action, dead: DataFrame | None = None, before_commit: Callable[[], None] | None = None
) -> dict[str, int]:
    written = {}
    for table, df in zip(TABLES, frames, strict=True):
        seen = Observation(f"{table}-{load_id}")
        write_table(df, root, table, load_id, seen)
        written[table] = seen.get["rows"]
    found = _years_of(spark, root, load_id)
    stated = found if years is None else {int(year) for year in years}
    if found - stated:
        raise ValueError(f"load {load_id} has rows of years that were not stated: {sorted(found - stated)}; nothing was committed")
    if before_commit is not None:
        before_commit()
    if action == "replace":
        dead = claimed_loads(spark, root) if dead is None else dead
    _commit(spark, root, sorted(stated), load_id, action, dead, written)
    return written


def claimed_loads(spark: SparkSession, root: str) -> DataFrame:
    """What a replacement that begins now has to name: all that is live, and lost replacements, which would come back."""
    found = load_states(spark, root).select("fiscal_year", F.explode(F.array_union("live", "standing")).alias("load_id"))
    path = scratch_path(spark, "claimed")
    found.coalesce(1).write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Committed rows; the join with the live loads prunes partitions, so dead loads are not read."""
    return rows_of_loads(spark, root, table, live_loads(spark, root))


def rows_of_loads(spark: SparkSession, root: str, table: str, loads: DataFrame) -> DataFrame:
    rows = spark.read.parquet(f"{root}/{table}")
    return rows.join(loads, ["fiscal_year", "load_id"], "left_semi").select(*[c for c in rows.columns if c != "load_id"])


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {table: read_table(spark, root, table) for table in TABLES}


def compact_years(spark: SparkSession, root: str, years: Iterable[int]) -> dict[str, int]:
    """Rewrite years collected from many small loads as one load with evenly sized files.

    The commit names the loads that were read; one that lands meanwhile stays beside the new one.
    """
    chosen = [int(year) for year in years]
    live = live_loads(spark, root).filter(F.col("fiscal_year").isin(chosen))
    path = scratch_path(spark, "compacted")
    live.coalesce(1).write.parquet(path)
    read = spark.read.schema(live.schema).parquet(path)
    frames = [rows_of_loads(spark, root, table, read).hint("rebalance", "fiscal_year") for table in TABLES]
    dead = read.unionByName(lost_loads(spark, root).filter(F.col("fiscal_year").isin(chosen))).distinct()
    return _write_and_commit(spark, root, frames, chosen, uuid.uuid4().hex, "compact", dead)


def delete_years(spark: SparkSession, root: str, years: Iterable[int] | None = None) -> DataFrame:
    """Delete years (all when None) from the three tables at once; returns the rows removed per table and year.

    The counts are of the loads that the commit row names and so hides. ``purge`` frees their files.
    """
    live = live_loads(spark, root)
    if years is not None:
        live = live.filter(F.col("fiscal_year").isin([int(year) for year in years]))
    path = scratch_path(spark, "deleted")
    live.coalesce(1).write.parquet(path)
    dead = spark.read.schema(live.schema).parquet(path)
    named = dead.unionByName(lost_loads(spark, root)).distinct()
    chosen = [r.fiscal_year for r in dead.select("fiscal_year").distinct().collect()]
    if not chosen:
        return spark.createDataFrame([], _DELETED)
    counts = None
    for table in TABLES:
        part = rows_of_loads(spark, root, table, dead).groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("rows_deleted"))
        part = part.select(F.lit(table).alias("table_name"), "fiscal_year", "rows_deleted")
        counts = part if counts is None else counts.unionByName(part)
    removed = counts.collect()  # three rows a year
    _commit(spark, root, chosen, uuid.uuid4().hex, "delete", named, {})
    return spark.createDataFrame(removed, _DELETED)


def withdraw(spark: SparkSession, root: str, load_id: str) -> None:
    """Take a committed load back, in all its years."""
    dead = live_loads(spark, root).filter(F.col("load_id") == load_id)
    years = [r.fiscal_year for r in dead.collect()]
    if years:
        _commit(spark, root, years, uuid.uuid4().hex, "delete", dead, {})


def purge(spark: SparkSession, root: str) -> int:
    """Remove the files of superseded loads and of replaced aggregates; returns the folders removed.

    Loads without a commit are left alone: one may be under way. Readers that began before a load was
    superseded must have ended.
    """
    removed = 0
    gone = superseded_loads(spark, root).join(live_loads(spark, root), ["fiscal_year", "load_id"], "left_anti")
    for row in gone.toLocalIterator():
        for place in (*TABLES, *(f"keys/{table}" for table in TABLES), *(f"partials/{name}" for name in PARTIALS)):
            removed += files.delete(spark, f"{root}/{place}/fiscal_year={row.fiscal_year}/load_id={row.load_id}")
    log = _read_log(spark, f"{root}/refreshes", _REFRESH)
    old = log.join(_live_refreshes(spark, root), ["aggregate", "fiscal_year", "refresh_id"], "left_anti")
    for row in old.toLocalIterator():
        removed += files.delete(spark, f"{root}/aggregates/{row.aggregate}/fiscal_year={row.fiscal_year}/refresh_id={row.refresh_id}")
    return removed


def load_file(
    spark: SparkSession,
    root: str,
    path: str,
    fiscal_year: int,
    stage: str,
    strict: bool = False,
    references: Mapping[str, DataFrame] | None = None,
) -> dict[str, int]:
    """Wide file to the committed tables of one year; returns rows written per table.

    The audit log gets a row when the load starts, when the source is read and when it
    ends. Strict mode validates first, and ``references`` must not be empty, so a failing
    load writes nothing.
    """
    load_id = uuid.uuid4().hex
    total = 0
    record_load(spark, root, audit_row(load_id, fiscal_year, 0, {}, "in_progress", None))
    try:
        if references is not None:
            quality.require_references(references)
        wide = reshape.with_case_key(read_wide_csv(spark, path, required=spec.REQUIRED_SOURCE_COLUMNS[1:], clean=False))
        seen = Observation(f"source-{load_id}")
        staged = stage_wide(wide, str(fiscal_year), stage, seen)
        total = seen.get["rows"]
        record_load(spark, root, audit_row(load_id, fiscal_year, total, {}, "in_progress", None))
        frames = staged_tables(staged)
        if strict:
            quality.require_valid(quality.validate(*frames, strict=True))
        written = write_all(spark, root, *frames, years=[fiscal_year], load_id=load_id)
    except Exception as problem:
        row = audit_row(load_id, fiscal_year, total, {}, "failed", str(problem))
        record_load(spark, root, row)
        raise
    record_load(spark, root, audit_row(load_id, fiscal_year, total, written, "completed", None))
    return written


def staged_tables(staged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of a staged load; each reads only its own Parquet columns."""
    flat = staged.withColumnRenamed("fiscal_year", "_year").drop("members", "errors")
    households = reshape.households(flat, F.col("_year"))
    long_members = staged.selectExpr("HHLDNO AS case_id", "fiscal_year", "inline(members)")
    long_errors = staged.selectExpr("HHLDNO AS case_id", "fiscal_year", "inline(errors)")
    return (
        households,
        reshape.type_slots(long_members, spec.PERSON_VARIABLES, "member_number"),
        reshape.type_slots(long_errors, spec.ERROR_VARIABLES, "error_number"),
    )


def audit_row(
    load_id: str, year: int | None, total: int, written: Mapping[str, int], status: str, message: str | None
) -> tuple:
    loaded = written.get("households", 0)
    percent = int(loaded / total * 100) if total else 0
    skipped = 0 if status == "in_progress" else total - loaded
    return (
        load_id, year, total, loaded, skipped, loaded, written.get("household_members", 0),
        written.get("qc_errors", 0), percent, status, message, time.time_ns(),
    )


def load_history(spark: SparkSession, root: str) -> DataFrame:
    """All audit rows, several per load."""
    return _read_log(spark, f"{root}/load_history", _HISTORY)


def load_status(spark: SparkSession, root: str) -> DataFrame:
    """The newest audit row of every load."""
    newest = load_history(spark, root).groupBy("load_id").agg(F.max_by(F.struct("*"), "recorded_at").alias("row"))
    return newest.select("row.*")


def record_load(spark: SparkSession, root: str, row: tuple) -> None:
    _append(spark, f"{root}/load_history", [row], _HISTORY)


def refresh_aggregates(
    spark: SparkSession,
    root: str,
    refs: Mapping[str, DataFrame],
    thresholds: DataFrame,
    years: Iterable[int] | None = None,
) -> None:
    """Recompute the three stored aggregates of the given years (None: all that are or were loaded).

    The rows of a refresh have its id, and one commit row per aggregate and year makes them the current
    ones, also where a year has no rows any more.
    """
    tables = read_tables(spark, root)
    known = _read_log(spark, f"{root}/refreshes", _REFRESH)
    if years is not None:
        chosen = sorted({int(year) for year in years})
        tables = {name: df.filter(F.col("fiscal_year").isin(chosen)) for name, df in tables.items()}
    else:
        every = loaded_years(spark, root).union(known.select("fiscal_year")).distinct()
        chosen = sorted(r.fiscal_year for r in every.collect())
    households, refresh_id = tables["households"], uuid.uuid4().hex
    results = {
        "state_error_rates": rates.state_error_rates(households, thresholds),
        "error_element_rollup": rates.error_element_rollup(tables["qc_errors"], households, refs),
        "demographic_profile": rates.demographic_profile(tables["household_members"], households, refs),
    }
    # A few aggregates and years.
    last = {(r.aggregate, r.fiscal_year): r.v for r in known.groupBy("aggregate", "fiscal_year").agg(F.max("version").alias("v")).collect()}
    rows = []
    for name, df in results.items():
        marked = df.withColumn("refresh_id", F.lit(refresh_id))
        marked.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{root}/aggregates/{name}-schema")
        marked.write.mode("append").partitionBy("fiscal_year", "refresh_id").parquet(f"{root}/aggregates/{name}")
        rows += [(name, year, refresh_id, last.get((name, year), 0) + 1) for year in chosen]
    if rows:
        _append(spark, f"{root}/refreshes", rows, _REFRESH)


def _live_refreshes(spark: SparkSession, root: str) -> DataFrame:
    newest = F.max(F.struct("version", "refresh_id")).alias("newest")
    log = _read_log(spark, f"{root}/refreshes", _REFRESH).groupBy("aggregate", "fiscal_year").agg(newest)
    return log.select("aggregate", "fiscal_year", F.col("newest.refresh_id").alias("refresh_id"))


def read_aggregate(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored aggregate as its years' newest refreshes left it, without years that have been deleted since."""
    schema = spark.read.parquet(f"{root}/aggregates/{name}-schema").schema
    current = _live_refreshes(spark, root).filter(F.col("aggregate") == name).join(loaded_years(spark, root), "fiscal_year", "left_semi")
    rows = spark.read.schema(schema).parquet(f"{root}/aggregates/{name}")
    kept = rows.join(current.select("fiscal_year", "refresh_id"), ["fiscal_year", "refresh_id"], "left_semi")
    return kept.select(*[c for c in schema.names if c != "refresh_id"])


def save_bucketed(df: DataFrame, name: str, buckets: int) -> None:
    """A catalog table bucketed on the household key, so joins between such tables need no shuffle.

    For tables whose keys are known to be spread (see ``quality.duplicate_keys``): a
    bucket is one task, and a hot key cannot be split there.
    """
    keys = ["case_id", "fiscal_year"]
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
