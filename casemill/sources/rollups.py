"""Aggregates kept up to date by what changed.

Each load has partial sums of its own: for error rates, for the roll-up of errors and for the profile of members,
grouped by codes, so that changed descriptions need no new sums. A refresh reads the loads that have no sums yet
and nothing else; a read adds up the sums of the loads that are live, so a replaced or deleted load drops out
by itself. Sums are exact decimals, divided once, after they have been added up.

Errors and members whose household is not in their own load can't be summed with it. Their narrow rows are
kept beside the sums and meet all live households when an aggregate is read; whole loads have none.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from casemill.operators import classify, rates
from casemill.operators.enrich import KEY, describe, with_threshold
from casemill.sources import files, tables

_LOG = "load_id STRING, fiscal_year INT, threshold STRING, households BIGINT, household_members BIGINT, qc_errors BIGINT"
_LOAD = ["fiscal_year", "load_id"]
# What the three aggregates need of a child row, and what they group by.
_ERROR_CODES = ("element_code", "error_finding", "responsible_agency")
_MEMBER_CODES = ("age_group", "race_ethnicity", "citizenship_status", "years_education", "working_status", "disability_status")
_MONEY, _WEIGHTED = "decimal(38,2)", "decimal(38,10)"


def _error_rows(errors: DataFrame) -> DataFrame:
    return errors.select(*_LOAD, "case_id", *_ERROR_CODES, "error_amount")


def _member_rows(members: DataFrame) -> DataFrame:
    """Eligible members with what the profile groups by; codes stay codes."""
    return members.filter(F.col("snap_affiliation_code").isin(1, 2)).select(
        *_LOAD, "case_id", classify.age_group(F.col("age")).alias("age_group"), "race_ethnicity", "citizenship_status", "years_education",
        classify.indicator(F.col("working_indicator"), "Working").alias("working_status"),
        classify.indicator(F.col("disability_indicator"), "Disabled").alias("disability_status"),
    )


def _parents(households: DataFrame) -> DataFrame:
    return households.select("fiscal_year", "load_id", "case_id", "case_classification", "state_name", "household_weight")


def _error_sums(joined: DataFrame, keys: list[str]) -> DataFrame:
    amount = F.col("error_amount")
    return joined.filter("case_classification = 1").groupBy(*keys, "state_name", *_ERROR_CODES).agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount * F.col("household_weight")).cast(_WEIGHTED).alias("weighted"),
        F.sum(amount).cast(_MONEY).alias("amount"), F.count(amount).alias("amounts"),
    )


def _member_sums(joined: DataFrame, keys: list[str]) -> DataFrame:
    weight = F.sum("household_weight").cast(_WEIGHTED)
    return joined.groupBy(*keys, "state_name", *_MEMBER_CODES).agg(F.count(F.lit(1)).alias("n"), weight.alias("weight"))


def _write(df: DataFrame, root: str, name: str) -> None:
    out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(*_LOAD).parquet(f"{root}/partials/{name}")
    # Readers need the columns also when no load has rows.
    schema = f"{root}/partials/{name}-schema"
    if not files.exists(df.sparkSession, schema):
        df.limit(0).coalesce(1).write.mode("overwrite").parquet(schema)


def _read(spark: SparkSession, root: str, name: str, live: DataFrame) -> DataFrame:
    schema = spark.read.parquet(f"{root}/partials/{name}-schema").schema
    return spark.read.schema(schema).parquet(f"{root}/partials/{name}").join(live, _LOAD, "left_semi")


def refresh_log(spark: SparkSession, root: str) -> DataFrame:
    """What refreshes have read: a row for each load and year, with the rows of each table."""
    path = f"{root}/partials/log"
    return spark.read.schema(_LOG).json(path) if files.exists(spark, path) else spark.createDataFrame([], _LOG)


def _thresholds(thresholds: DataFrame) -> DataFrame:
    """The threshold of each year as text; sums made under another one are made again."""
    return thresholds.groupBy("fiscal_year").agg(F.max("threshold_amount").cast("string").alias("threshold"))


def pending(spark: SparkSession, root: str, thresholds: DataFrame) -> DataFrame:
    """``(fiscal_year, load_id, threshold)`` of live loads without sums under the present thresholds."""
    live = tables.live_loads(spark, root).join(_thresholds(thresholds), "fiscal_year", "left")
    live = live.withColumn("threshold", F.coalesce("threshold", F.lit("none")))
    newest = refresh_log(spark, root).select("fiscal_year", "load_id", "threshold").distinct()
    return live.join(newest, ["fiscal_year", "load_id", "threshold"], "left_anti")


def refresh(spark: SparkSession, root: str, thresholds: DataFrame) -> dict[str, int]:
    """Sums for the loads that have none; returns the rows read of each table.

    The log row that says so is written last, so a refresh that died is made again. Two at once write the same sums.
    """
    todo = pending(spark, root, thresholds).collect()  # a row for each new load and year
    if not todo:
        return dict.fromkeys(tables.TABLES, 0)
    loads = spark.createDataFrame([(r.fiscal_year, r.load_id) for r in todo], "fiscal_year int, load_id string")
    seen = {table: Observation(f"{table}-{todo[0].load_id}") for table in tables.TABLES}

    def rows(table: str) -> DataFrame:
        # The years and ids prune folders before any file is opened.
        chosen = F.col("load_id").isin(sorted({r.load_id for r in todo})) & F.col("fiscal_year").isin(sorted({r.fiscal_year for r in todo}))
        return spark.read.parquet(f"{root}/{table}").filter(chosen).join(loads, _LOAD, "left_semi")

    households = rows("households")
    counted = households.observe(seen["households"], F.count(F.lit(1)).alias("rows")).filter("case_classification = 1")
    _write(rates.state_error_sums(with_threshold(counted, thresholds), ["load_id"]), root, "state_error_rates")
    orphans = []
    for table, narrow, sums, name in (
        ("qc_errors", _error_rows, _error_sums, "error_element_rollup"),
        ("household_members", _member_rows, _member_sums, "demographic_profile"),
    ):
        children = narrow(rows(table).observe(seen[table], F.count(F.lit(1)).alias("rows")))
        joined = children.join(_parents(households), [*_LOAD, "case_id"])
        _write(sums(joined, _LOAD), root, name)
        alone = narrow(rows(table)).join(households.select(*_LOAD, "case_id"), [*_LOAD, "case_id"], "left_anti")
        orphans.append(alone.select(*_LOAD, F.lit(table).alias("table_name"), "case_id", *_columns(alone)))
    _write(orphans[0].unionByName(orphans[1], allowMissingColumns=True), root, "orphans")
    read = {table: seen[table].get["rows"] for table in tables.TABLES}
    log = spark.createDataFrame([(r.load_id, r.fiscal_year, r.threshold, *read.values()) for r in todo], _LOG)
    log.coalesce(1).write.mode("append").json(f"{root}/partials/log")
    return read


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*_LOAD, "case_id")]


def _lone(spark: SparkSession, root: str, table: str, live: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Children whose household came with another load, beside it."""
    lone = _read(spark, root, "orphans", live).filter(F.col("table_name") == table).select(*KEY, *columns)
    parents = _parents(spark.read.parquet(f"{root}/households").join(live, _LOAD, "left_semi")).drop("load_id")
    return lone.join(parents, KEY)


def state_error_rates(spark: SparkSession, root: str) -> DataFrame:
    """As ``rates.state_error_rates`` over all live rows, from the sums of their loads."""
    sums = _read(spark, root, "state_error_rates", tables.live_loads(spark, root))
    group = ["fiscal_year", "state_name", "state_code", "tolerance_threshold"]
    added = [F.sum(c).alias(c) for c in sums.columns if c not in (*group, "load_id")]
    return rates.state_error_rates_of(sums.groupBy(*group).agg(*added))


def error_element_rollup(spark: SparkSession, root: str, refs: Mapping[str, DataFrame]) -> DataFrame:
    """As ``rates.error_element_rollup`` over all live rows, from the sums of their loads; keys are unique over loads."""
    live = tables.live_loads(spark, root)
    sums = _read(spark, root, "error_element_rollup", live).drop("load_id")
    late = _error_sums(_lone(spark, root, "qc_errors", live, (*_ERROR_CODES, "error_amount")), ["fiscal_year"])
    facts = sums.unionByName(late).join(refs["ref_element"].select(F.col("code").alias("element_code")), "element_code", "left_semi")
    facts = describe(facts, "error_finding", refs["ref_error_finding"], description="finding_type")
    facts = describe(facts, "responsible_agency", refs["ref_agency_responsibility"], responsibility_type="responsibility_type")
    rolled = facts.groupBy("fiscal_year", "state_name", "element_code", "finding_type", "responsibility_type").agg(
        F.sum("n").alias("sample_error_count"), F.sum("weighted").alias("weighted_error_dollars"),
        F.try_divide(F.sum("amount").cast("double"), F.sum("amounts").cast("double")).alias("avg_sample_error_amount"),
    )
    return describe(rolled, "element_code", refs["ref_element"], description="element_description", category="element_category")


def demographic_profile(spark: SparkSession, root: str, refs: Mapping[str, DataFrame]) -> DataFrame:
    """As ``rates.demographic_profile`` over all live rows, from the sums of their loads; keys are unique over loads."""
    live = tables.live_loads(spark, root)
    late = _member_sums(_lone(spark, root, "household_members", live, _MEMBER_CODES), ["fiscal_year"])
    sums = _read(spark, root, "demographic_profile", live).drop("load_id").unionByName(late)
    sums = sums.withColumnsRenamed({"race_ethnicity": "_race", "citizenship_status": "_citizenship", "years_education": "_education"})
    named = describe(sums, "_race", refs["ref_race_ethnicity"], description="race_ethnicity")
    named = describe(named, "_citizenship", refs["ref_citizenship_status"], description="citizenship_status")
    named = describe(named, "_education", refs["ref_education_level"], description="education_level")
    groups = ["fiscal_year", "state_name", "age_group", "race_ethnicity", "citizenship_status", "education_level", "working_status", "disability_status"]
    return named.groupBy(*groups).agg(F.sum("n").alias("sample_member_count"), F.sum("weight").alias("estimated_member_count"))
