"""Reshape, scans, sinks, lookups and dictionary queries."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill import spec
from casemill.functions import text
from casemill.functions.dates import fiscal_year
from casemill.functions.money import round_for_summary
from casemill.operators import enrich, reshape
from casemill.plans import fixtures as fx
from casemill.plans.registry import query, rounded_sql
from casemill.session import scratch_path
from casemill.sources import catalog, export, keys, lookups, rollups, tables, wide_csv
from casemill.streaming.loads import start_file_loads


def _token(column: str) -> str:
    return f"CASE WHEN {column} IN ('', 'NA', 'N/A', 'NULL') THEN NULL ELSE {column} END"


def _int(column: str) -> str:
    return f"CAST(TRY_CAST({_token(column)} AS DOUBLE) AS INT)"


def _dollars(column: str) -> str:
    return f"coalesce(TRY_CAST({_token(column)} AS DECIMAL(10,2)), 0)"


def _slot_sql(variables: dict, rules: dict[str, str], slots: int, gate: str, number: str) -> str:
    """All variables of the filled slots, typed as the reshape types them."""
    typed = {"int": _int, "string": _token}
    columns = [f"{typed.get(kind, _dollars)(source)} AS {target}" for source, (target, kind) in variables.items()]
    return f"""SELECT case_id, fiscal_year, n AS {number}, {", ".join(columns)}
 FROM ({fx.duck_slots(rules, slots)}) AS s WHERE {_token(gate)} IS NOT NULL"""


def _slot_columns(variables: dict, number: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    names = tuple(target for target, _ in variables.values())
    return ("case_id", "fiscal_year", number, *names), tuple(t for t, kind in variables.values() if kind.startswith("decimal"))


_MEMBERS = _slot_sql(spec.PERSON_VARIABLES, fx.WIDE_PERSON_RULES, spec.MEMBER_SLOTS, "FSAFIL", "member_number")
_ERRORS = _slot_sql(spec.ERROR_VARIABLES, fx.WIDE_ERROR_RULES, spec.ERROR_SLOTS, "ELEMENT", "error_number")
_MEMBER_COLUMNS, _MEMBER_MONEY = _slot_columns(spec.PERSON_VARIABLES, "member_number")
_ERROR_COLUMNS, _ERROR_MONEY = _slot_columns(spec.ERROR_VARIABLES, "error_number")
_HOUSEHOLD_COLUMNS = (
    "case_id", "fiscal_year", "case_classification", "state_code", "state_name", "year_month", "status",
    "certified_household_size", "gross_income", "net_income", "snap_benefit", "working_poor_indicator",
    "tanf_indicator", "amount_error", "household_weight",
)
_HOUSEHOLD_MONEY = ("gross_income", "net_income", "snap_benefit", "amount_error", "household_weight")


@query("wide_to_members", "R1 P4", _MEMBERS, money=_MEMBER_MONEY)
def _wide_to_members(spark: SparkSession, d: str) -> DataFrame:
    return reshape.members(fx.wide(spark, d), F.col("source_year")).select(*_MEMBER_COLUMNS)


@query("wide_to_errors", "R2 P4", _ERRORS, money=_ERROR_MONEY)
def _wide_to_errors(spark: SparkSession, d: str) -> DataFrame:
    return reshape.errors(fx.wide(spark, d), F.col("source_year")).select(*_ERROR_COLUMNS)


@query(
    "wide_to_households",
    "P1 P3 P5",
    f"SELECT {', '.join(_HOUSEHOLD_COLUMNS)} FROM households",
    money=_HOUSEHOLD_MONEY,
)
def _wide_to_households(spark: SparkSession, d: str) -> DataFrame:
    return reshape.households(fx.wide(spark, d), F.col("source_year")).select(*_HOUSEHOLD_COLUMNS)


@query(
    "row_number_key",
    "P2",
    """SELECT CAST(row_number() OVER () AS VARCHAR) AS case_id, CAST(2017 + o_orderkey % 7 AS INT) AS fiscal_year,
       CAST(o_custkey % 25 AS VARCHAR) AS state_code FROM orders""",
)
def _row_number_key(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "orders").selectExpr(
        "CAST(o_custkey % 25 AS STRING) AS STATE", "2017 + o_orderkey % 7 AS source_year"
    )
    keyed = reshape.with_case_key(rows)
    return reshape.households(keyed, F.col("source_year")).select("case_id", "fiscal_year", "state_code")


@query(
    "wide_csv_scan",
    "S1 S4",
    """SELECT '"' || state_name || '", QC' AS state_name, count(*) AS rows_read, sum(snap_benefit) AS total_benefits,
       count(snap_benefit) AS filled FROM households GROUP BY 1""",
    money=("total_benefits",),
)
def _wide_csv_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "wide")
    # Quoted commas and doubled quotes in the names; the second folder has the columns in another order.
    def quoted(df: DataFrame) -> DataFrame:
        return df.withColumn("STATENAME", F.concat(F.lit('"'), "STATENAME", F.lit('", QC')))

    fx.write_wide_csv(spark, d, f"{path}/early.csv", "source_year < 2020", quoted)
    fx.write_wide_csv(spark, d, f"{path}/late.csv", "source_year >= 2020", lambda df: quoted(df).select(*reversed(df.columns)))
    rows = wide_csv.read_wide_csv(spark, f"{path}/*.csv")
    return rows.groupBy(F.col("STATENAME").alias("state_name")).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.sum(F.col("FSBEN").try_cast("decimal(10,2)")).alias("total_benefits"),
        F.count("FSBEN").alias("filled"),
    )


@query("wide_row_count", "S1", "SELECT count(*) AS row_count FROM orders")
def _wide_row_count(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "wide")
    fx.write_wide_csv(spark, d, path)
    return wide_csv.row_count(spark, path)


@query(
    "file_catalog",
    "S5",
    """SELECT 'qc_pub_fy' || fiscal_year || '.csv' AS filename, fiscal_year, fiscal_year IN (2018, 2021) AS loaded,
       true AS has_bytes FROM (SELECT DISTINCT fiscal_year FROM households) AS y""",
)
def _file_catalog(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch_path(spark, "drops")
    fx.write_wide_files(spark, d, folder)
    loaded = fx.households(spark, d).filter("fiscal_year IN (2018, 2021)").select("fiscal_year")
    files = wide_csv.file_catalog(spark, folder, loaded)
    return files.select("filename", "fiscal_year", "loaded", (F.col("size_bytes") > 0).alias("has_bytes"))


@query(
    "load_several_years",
    "S9",
    """SELECT fiscal_year AS source_year, count(*) AS rows_read FROM households
       WHERE fiscal_year IN (2018, 2020, 2023) GROUP BY 1""",
)
def _load_several_years(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch_path(spark, "drops")
    fx.write_wide_files(spark, d, folder)
    rows = wide_csv.read_years(spark, folder, (2018, 2020, 2023, 2031))
    return rows.groupBy("source_year").agg(F.count(F.lit(1)).alias("rows_read"))


@query(
    "years_to_load",
    "S8",
    """SELECT DISTINCT CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS INT) AS fiscal_year
       FROM orders WHERE year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END NOT IN
       (SELECT year(l_shipdate) - 2 FROM lineitem)""",
)
def _years_to_load(spark: SparkSession, d: str) -> DataFrame:
    shipped = fx.table(spark, d, "lineitem")
    return tables.years_to_load(
        fx.table(spark, d, "orders").select(fiscal_year(F.col("o_orderdate")).alias("fiscal_year")),
        shipped.select((F.year("l_shipdate") - 2).alias("fiscal_year")).distinct(),
    )


def _counts(found: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in found.items():
        part = df.groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("row_count"))
        part = part.select(F.lit(name).alias("table_name"), "fiscal_year", "row_count")
        out = part if out is None else out.unionByName(part)
    return out


def _count_sql(where: str, error: str = "errors", member: str = "members") -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, fiscal_year, count(*) AS row_count FROM {table} WHERE {where} GROUP BY 2"
        for name, table in (("households", "households"), ("household_members", member), ("qc_errors", error))
    )


def _store(spark: SparkSession, d: str, root: str) -> None:
    """The derived tables of every year in one committed load."""
    tables.write_all(spark, root, fx.households(spark, d), fx.members(spark, d), fx.errors(spark, d))


@query("committed_tables", "S6 S7", _count_sql("true"))
def _committed_tables(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "store")
    _store(spark, d, root)
    # Files of a load that never committed stay invisible.
    tables.write_table(fx.errors(spark, d), root, "qc_errors", "unfinished")
    return _counts(tables.read_tables(spark, root))


@query("delete_years", "S10", _count_sql("fiscal_year NOT IN (2019, 2022)"))
def _delete_years(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "store")
    _store(spark, d, root)
    tables.delete_years(spark, root, (2019, 2022))
    return _counts(tables.read_tables(spark, root))


@query(
    "deleted_rows",
    "S10",
    _count_sql("fiscal_year IN (2019, 2022)").replace("AS row_count", "AS rows_deleted"),
)
def _deleted_rows(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "store")
    _store(spark, d, root)
    return tables.delete_years(spark, root, (2019, 2022))


@query(
    "load_audit",
    "S11 S6 P2",
    f"""SELECT 2020 AS fiscal_year, count(*) AS total_rows_in_file, count(*) AS rows_loaded, CAST(0 AS BIGINT) AS rows_skipped,
        count(*) AS households_created, (SELECT count(*) FROM ({_MEMBERS}) AS m WHERE fiscal_year = 2020) AS members_created,
        (SELECT count(*) FROM ({_ERRORS}) AS e WHERE fiscal_year = 2020) AS errors_created, 100 AS percent_complete,
        'completed' AS load_status FROM households WHERE fiscal_year = 2020""",
)
def _load_audit(spark: SparkSession, d: str) -> DataFrame:
    folder, root, stage = (scratch_path(spark, name) for name in ("drops", "store", "stage"))
    fx.write_wide_files(spark, d, folder)
    tables.load_file(spark, root, f"{folder}/file=qc_pub_fy2020.csv", 2020, stage)
    return tables.load_status(spark, root).drop("load_id", "error_message", "recorded_at")


@query(
    "streamed_file_loads",
    "X1 S6",
    _count_sql("true", error=f"({_ERRORS}) AS e", member=f"({_MEMBERS}) AS m"),
)
def _streamed_file_loads(spark: SparkSession, d: str) -> DataFrame:
    folder, root, stage, mark = (scratch_path(spark, name) for name in ("drops", "store", "stage", "mark"))
    fx.write_wide_files(spark, d, folder)
    start_file_loads(spark, folder, root, mark, stage).awaitTermination()
    return _counts(tables.read_tables(spark, root))


@query("two_streams", "X1 S6", _count_sql("true", error=f"({_ERRORS}) AS e", member=f"({_MEMBERS}) AS m"))
def _two_streams(spark: SparkSession, d: str) -> DataFrame:
    """Two streams on one store, each with its own checkpoint; the second replayed with a new one for its later years."""
    root, stage = scratch_path(spark, "store"), scratch_path(spark, "stage")
    for early in (True, False):
        folder, mark = scratch_path(spark, "drops"), scratch_path(spark, "mark")
        fx.write_wide_files(spark, d, folder, "source_year < 2020" if early else "source_year >= 2020")
        start_file_loads(spark, folder, root, mark, stage).awaitTermination()
        start_file_loads(spark, folder, root, mark, stage).awaitTermination()
    return _counts(tables.read_tables(spark, root))


@query("replayed_batch", "S6 S10", _count_sql("fiscal_year <> 2021"))
def _replayed_batch(spark: SparkSession, d: str) -> DataFrame:
    """A load that is replayed after its years were compacted and one of them deleted."""
    root, frames = scratch_path(spark, "store"), (fx.households(spark, d), fx.members(spark, d), fx.errors(spark, d))
    tables.write_all(spark, root, *frames, load_id="batch-0", action="append")
    tables.compact_years(spark, root, (2018, 2020, 2021))
    tables.delete_years(spark, root, (2021,))
    tables.write_all(spark, root, *frames, load_id="batch-0", action="append")
    return _counts(tables.read_tables(spark, root))


_INCOMING = "CASE WHEN CAST(case_id AS BIGINT) % 3 = 0 THEN case_id WHEN CAST(case_id AS BIGINT) % 3 = 1 THEN 'hot' ELSE 'new' || case_id END"


def _clash_sql(name: str, table: str, number: str) -> str:
    keys = f"fiscal_year, case_id{number}"
    return f"""SELECT '{name}' AS table_name, i.fiscal_year, count(*) FILTER (WHERE i.n > 1) AS repeated_keys,
        count(*) FILTER (WHERE s.n IS NOT NULL) AS taken_keys, CAST(sum(i.n) AS BIGINT) AS rows_in_load
        FROM (SELECT {keys}, count(*) AS n FROM (SELECT * REPLACE ({_INCOMING} AS case_id) FROM {table}) AS r GROUP BY ALL) AS i
        LEFT JOIN (SELECT {keys}, count(*) AS n FROM {table} GROUP BY ALL) AS s USING ({keys})
        WHERE i.n > 1 OR s.n IS NOT NULL GROUP BY 2"""


@query(
    "keys_over_loads",
    "V6 S6",
    " UNION ALL ".join(
        _clash_sql(*x)
        for x in (("households", "households", ""), ("household_members", "members", ", member_number"), ("qc_errors", "errors", ", error_number"))
    ),
)
def _keys_over_loads(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a second load: a third are taken, a third of its rows share one case, the rest are new."""
    root = scratch_path(spark, "store")
    _store(spark, d, root)
    for name, df in zip(tables.TABLES, (fx.households(spark, d), fx.members(spark, d), fx.errors(spark, d)), strict=True):
        tables.write_table(df.withColumn("case_id", F.expr(_INCOMING)), root, name, "second")
    return keys.report(spark, root, "second")


@query(
    "unique_appends",
    "V6 S6 S10",
    _count_sql(
        "true",
        "(SELECT DISTINCT fiscal_year, case_id, error_number FROM errors) AS e",
        "(SELECT DISTINCT fiscal_year, case_id, member_number FROM members) AS m",
    ),
)
def _unique_appends(spark: SparkSession, d: str) -> DataFrame:
    """Appends with new keys stay; those that bring a key again are refused as a whole."""
    root = scratch_path(spark, "store")
    frames = fx.households(spark, d, unique=True), fx.members(spark, d, unique=True), fx.errors(spark, d, unique=True)
    for part in (0, 1, 0):
        with contextlib.suppress(keys.KeyClash):
            keys.append_unique(spark, root, *(df.filter(F.col("case_id").cast("bigint") % 2 == part) for df in frames))
    return _counts(tables.read_tables(spark, root))


@query("replaced_at_once", "S6", _count_sql("fiscal_year <> 2020 OR CAST(case_id AS BIGINT) % 2 = 1"))
def _replaced_at_once(spark: SparkSession, d: str) -> DataFrame:
    """Two replacements of one year that do not see each other: one of them is read, in all three tables."""
    root = scratch_path(spark, "store")
    _store(spark, d, root)
    year = [df.filter("fiscal_year = 2020") for df in (fx.households(spark, d), fx.members(spark, d), fx.errors(spark, d))]

    def other() -> None:
        part = [df.filter("CAST(case_id AS BIGINT) % 2 = 0") for df in year]
        tables.write_all(spark, root, *part, years=[2020], load_id="replacement-a")

    seen = tables.claimed_loads(spark, root)
    other()
    part = [df.filter("CAST(case_id AS BIGINT) % 2 = 1") for df in year]
    tables.write_all(spark, root, *part, years=[2020], load_id="replacement-b", claimed=seen)
    return _counts(tables.read_tables(spark, root))


@query(
    "refreshed_after_reload",
    "S20 A2",
    """SELECT e.fiscal_year, count(*) AS cases FROM errors e JOIN households h ON e.case_id = h.case_id AND e.fiscal_year = h.fiscal_year
       JOIN ref_element ON element_code = code WHERE case_classification = 1 AND e.fiscal_year <> 2019 GROUP BY 1""",
)
def _refreshed_after_reload(spark: SparkSession, d: str) -> DataFrame:
    """A year that is loaded again without errors keeps no stored row of them."""
    root, refs, thresholds = scratch_path(spark, "store"), fx.refs(spark), enrich.threshold_table(spark)
    _store(spark, d, root)
    tables.refresh_aggregates(spark, root, refs, thresholds)
    again = [df.filter("fiscal_year = 2019") for df in (fx.households(spark, d), fx.members(spark, d))]
    tables.write_all(spark, root, *again, fx.errors(spark, d).filter("false"), years=[2019])
    tables.refresh_aggregates(spark, root, refs, thresholds, (2019,))
    stored = tables.read_aggregate(spark, root, "error_element_rollup")
    return stored.groupBy("fiscal_year").agg(F.sum("sample_error_count").alias("cases"))


@query(
    "refresh_after_small_load",
    "S20",
    _count_sql("fiscal_year = 2021").replace("fiscal_year, count(*) AS row_count", "count(*) AS rows_read").replace("GROUP BY 2", ""),
)
def _refresh_after_small_load(spark: SparkSession, d: str) -> DataFrame:
    """What the refresh after one more load reads: the rows of that load."""
    root, thresholds = scratch_path(spark, "store"), enrich.threshold_table(spark)
    frames = fx.households(spark, d), fx.members(spark, d), fx.errors(spark, d)
    tables.write_all(spark, root, *(df.filter("fiscal_year <> 2021") for df in frames), action="append")
    rollups.refresh(spark, root, thresholds)
    tables.write_all(spark, root, *(df.filter("fiscal_year = 2021") for df in frames), action="append")
    read = rollups.refresh(spark, root, thresholds)
    return spark.createDataFrame(list(read.items()), "table_name string, rows_read long")


def merged_store(spark: SparkSession, d: str) -> str:
    """A store of several loads with their sums: one that was replaced, and one without some of its households."""
    root, thresholds = scratch_path(spark, "store"), enrich.threshold_table(spark)
    frames = fx.households(spark, d), fx.members(spark, d), fx.errors(spark, d)
    split, late = "CAST(case_id AS BIGINT) % 2 = 0", "fiscal_year = 2022 AND CAST(case_id AS BIGINT) % 7 = 1"
    tables.write_all(spark, root, *(df.filter(f"{split} OR fiscal_year = 2019") for df in frames), action="append")
    tables.write_all(spark, root, frames[0].filter(f"NOT {split} AND {late}"), *(df.filter("false") for df in frames[1:]), action="append")
    rollups.refresh(spark, root, thresholds)
    rest = f"NOT {split} AND fiscal_year <> 2019"
    tables.write_all(spark, root, frames[0].filter(f"{rest} AND NOT ({late})"), *(df.filter(rest) for df in frames[1:]), action="append")
    tables.write_all(spark, root, *(df.filter("fiscal_year = 2019") for df in frames), years=[2019])
    rollups.refresh(spark, root, thresholds)
    return root


@query(
    "streamed_load_audit",
    "X1 S11",
    """SELECT 'completed' AS load_status, CAST(NULL AS INT) AS fiscal_year, count(*) AS rows_loaded, false AS has_reason FROM households
       UNION ALL SELECT 'rejected', NULL, 0, true UNION ALL SELECT 'rejected', 2030, 0, true""",
)
def _streamed_load_audit(spark: SparkSession, d: str) -> DataFrame:
    """Good files, one without a year in its name and one without the required columns."""
    folder, root, stage, mark = (scratch_path(spark, name) for name in ("drops", "store", "stage", "mark"))
    fx.write_wide_files(spark, d, folder)
    nations = fx.table(spark, d, "nation").coalesce(1)
    nations.selectExpr("CAST(n_nationkey AS STRING) AS HHLDNO", "'6' AS STATE", "'202301' AS YRMONTH", "'1' AS FSBEN").write.option(
        "header", True
    ).csv(f"{folder}/file=no_such_label.csv")
    nations.write.option("header", True).csv(f"{folder}/file=qc_pub_fy2030.csv")
    start_file_loads(spark, folder, root, mark, stage).awaitTermination()
    log = tables.load_status(spark, root)
    return log.select("load_status", "fiscal_year", "rows_loaded", F.col("error_message").isNotNull().alias("has_reason"))


@query(
    "refreshed_aggregates",
    "S20 A1 A2 A3",
    """SELECT 'state_error_rates' AS aggregate, fiscal_year, sum(n) AS cases FROM (SELECT fiscal_year, 1 AS n FROM households
         WHERE case_classification = 1 AND fiscal_year <> 2018) AS a GROUP BY 2
       UNION ALL SELECT 'error_element_rollup', e.fiscal_year, count(*) FROM errors e JOIN households h
         ON e.case_id = h.case_id AND e.fiscal_year = h.fiscal_year JOIN ref_element ON element_code = code
         WHERE case_classification = 1 AND e.fiscal_year <> 2018 GROUP BY 2
       UNION ALL SELECT 'demographic_profile', m.fiscal_year, count(*) FROM members m JOIN households h
         ON m.case_id = h.case_id AND m.fiscal_year = h.fiscal_year WHERE snap_affiliation_code IN (1, 2) AND m.fiscal_year <> 2018 GROUP BY 2""".replace(
        "sum(n) AS cases", "CAST(sum(n) AS BIGINT) AS cases"
    ),
)
def _refreshed_aggregates(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "store")
    _store(spark, d, root)
    refs, thresholds = fx.refs(spark), enrich.threshold_table(spark)
    tables.refresh_aggregates(spark, root, refs, thresholds)
    tables.refresh_aggregates(spark, root, refs, thresholds, (2021,))
    tables.delete_years(spark, root, (2018,))
    out = None
    for name, count in (
        ("state_error_rates", "total_sample_cases"),
        ("error_element_rollup", "sample_error_count"),
        ("demographic_profile", "sample_member_count"),
    ):
        stored = tables.read_aggregate(spark, root, name)
        part = stored.groupBy("fiscal_year").agg(F.sum(count).alias("cases"))
        part = part.select(F.lit(name).alias("aggregate"), "fiscal_year", "cases")
        out = part if out is None else out.unionByName(part)
    return out


def _lookup_json(spark: SparkSession, d: str) -> DataFrame:
    """One lookup document per part and nation, with metadata keys and a code that is no number."""
    parts = fx.table(spark, d, "part").select(
        F.to_json(
            F.struct(
                F.create_map(
                    F.lit("part_codes"),
                    F.create_map(
                        F.lit("source_field"), F.lit("P"), F.col("p_partkey").cast("string"), F.col("p_name"),
                        F.concat(F.lit("x"), F.col("p_partkey").cast("string")), F.col("p_type"),
                    ),
                ).alias("code_lookups")
            )
        ).alias("value")
    )
    states = fx.table(spark, d, "nation").select(
        F.format_string(
            '{"code_lookups": {"state_codes": {"description": "states", "%d": {"name": "%s", "abbr": "%s"}}}}',
            "n_nationkey", "n_name", F.substring("n_name", 1, 2),
        ).alias("value")
    )
    return parts.unionByName(states)


@query(
    "lookup_tables",
    "S12",
    """SELECT 'part_codes' AS lookup, CAST(p_partkey AS INT) AS code, p_name AS description, CAST(NULL AS VARCHAR) AS abbreviation
       FROM part UNION ALL SELECT 'state_codes', n_nationkey, n_name, substr(n_name, 1, 2) FROM nation""",
)
def _lookup_tables(spark: SparkSession, d: str) -> DataFrame:
    return lookups.lookup_rows(_lookup_json(spark, d))


@query(
    "lookup_upsert",
    "S12",
    """SELECT CAST(p_partkey AS INT) AS code, CASE WHEN p_size > 20 THEN upper(p_name) ELSE p_name END AS description FROM part""",
)
def _lookup_upsert(spark: SparkSession, d: str) -> DataFrame:
    part = fx.table(spark, d, "part").selectExpr("CAST(p_partkey AS INT) AS code", "p_name AS description", "p_size")
    # Every incoming code comes twice; the later version counts.
    changed = part.filter("p_size > 20")
    incoming = changed.select("code", F.upper("description").alias("description"), F.lit(2).alias("version")).union(
        changed.select("code", F.lit("old"), F.lit(1))
    )
    return lookups.upsert(part.filter("p_size <= 30").drop("p_size"), incoming, ["code"], ["version"])


_DOCUMENT_NAME = "concat('doc_', CAST(doc_id AS STRING), CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.TXT' ELSE '.pdf' END)"


@query(
    "accepted_documents",
    "S14",
    f"""SELECT doc_id, {_DOCUMENT_NAME} AS filename, length(text) AS char_count FROM documents
        WHERE doc_id % 4 <> 3 AND octet_length(encode(text)) <= 10485760 AND regexp_matches(text, '\\S')""",
)
def _accepted_documents(spark: SparkSession, d: str) -> DataFrame:
    documents = fx.table(spark, d, "documents").selectExpr("doc_id", "text", f"{_DOCUMENT_NAME} AS filename")
    return lookups.accepted_documents(documents).select(
        "doc_id", "filename", F.length("text").cast("bigint").alias("char_count")
    )


def pair_json(spark: SparkSession, d: str) -> DataFrame:
    """One example document per benchmark text; some without SQL, some without the examples key."""
    item = F.col("item_id")
    pair = F.struct(
        F.col("text").alias("question"),
        F.when(item % 5 != 0, F.concat(F.lit("SELECT "), item.cast("string"))).otherwise("").alias("sql"),
        F.when(item % 2 == 0, F.lit("note")).alias("explanation"),
    )
    wrapped = F.to_json(F.struct(F.array(pair).alias("example_queries")))
    empty = F.to_json(F.struct(F.array(pair).alias("other")))
    return fx.table(spark, d, "benchmark").select(F.when(item % 7 != 0, wrapped).otherwise(empty).alias("value"))


@query(
    "example_pairs",
    "S15",
    """SELECT CASE WHEN item_id % 2 = 0 THEN text || ' (note)' ELSE text END AS question, 'SELECT ' || item_id AS sql
       FROM benchmark WHERE item_id % 5 <> 0 AND item_id % 7 <> 0""",
)
def _example_pairs(spark: SparkSession, d: str) -> DataFrame:
    return lookups.example_pairs(pair_json(spark, d))


@query(
    "data_dictionary",
    "S19 A15",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,"
        f" {description} AS description FROM {t}"
        for t, c, description in (
            *[("orders", c, "'Total price'" if c == "o_totalprice" else "CAST(NULL AS VARCHAR)") for c in
              ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")],
            *[("households", c, "'Status of the case'" if c == "status" else "CAST(NULL AS VARCHAR)") for c in fx.HOUSEHOLD_RULES],
        )
    ),
)
def _data_dictionary(spark: SparkSession, d: str) -> DataFrame:
    notes = spark.sql(
        "SELECT * FROM VALUES ('orders', 'o_totalprice', 'Total price'), ('households', 'status', 'Status of the case'),"
        " ('households', 'gone', 'No longer there') AS t(table_name, column_name, description)"
    )
    found = {"orders": fx.table(spark, d, "orders"), "households": fx.households(spark, d)}
    out = catalog.data_dictionary(found, notes)
    return out.select("table_name", "column_name", "row_count", "null_count", "description")


@query(
    "sorted_codes",
    "S19",
    "SELECT 'p' AS lookup, CASE WHEN p_partkey % 10 = 0 THEN p_type ELSE CAST(p_partkey AS VARCHAR) END AS code, p_name AS description FROM part",
)
def _sorted_codes(spark: SparkSession, d: str) -> DataFrame:
    codes = fx.table(spark, d, "part").selectExpr(
        "'p' AS lookup", "IF(p_partkey % 10 = 0, p_type, CAST(p_partkey AS STRING)) AS code", "p_name AS description"
    )
    return catalog.sorted_codes(codes)


@query(
    "sample_codes",
    "T3",
    "SELECT p_partkey AS code, p_name AS description FROM part ORDER BY p_partkey LIMIT 15",
)
def _sample_codes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.sample_codes(fx.table(spark, d, "part").selectExpr("p_partkey AS code", "p_name AS description"))


@query(
    "result_columns_cut",
    "S18",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem",
)
def _result_columns_cut(spark: SparkSession, d: str) -> DataFrame:
    return export.first_columns(fx.table(spark, d, "lineitem"), 4)


@query(
    "csv_export",
    "S18",
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name || ', \"' || p_brand || '\"' END AS label FROM part",
)
def _csv_export(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "export")
    label = F.when(F.col("p_size") % 5 != 0, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')))
    export.write_csv(fx.table(spark, d, "part").select("p_partkey", label.alias("label")), path)
    return spark.read.option("header", True).option("escape", '"').schema("p_partkey BIGINT, label STRING").csv(path)


@query(
    "markdown_export",
    "S18",
    """SELECT 0 AS line_number, '| p_partkey | p_name | p_size |' AS line UNION ALL SELECT 1, '| --- | --- | --- |'
       UNION ALL SELECT CAST(row_number() OVER (ORDER BY p_partkey) + 1 AS INT),
       '| ' || p_partkey || ' | ' || p_name || ' | ' || p_size || ' |'
       FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 100) AS p""",
)
def _markdown_export(spark: SparkSession, d: str) -> DataFrame:
    part = fx.table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return export.markdown_lines(part, ["p_partkey"])


@query(
    "display_values",
    "P17",
    """SELECT c_custkey, CAST(1900 + c_custkey % 200 AS VARCHAR) AS as_year, CAST(c_custkey AS VARCHAR) AS as_rawint,
       format('{:,}', c_custkey * 1000) AS as_integer,
       CASE WHEN c_acctbal - 5000 < 0 THEN '-$' ELSE '$' END || format('{:,.2f}', abs(round(c_acctbal - 5000, 2))) AS as_currency,
       format('{:,.4f}', c_acctbal) AS as_weight, format('{:,.2f}', c_acctbal) AS as_decimal,
       CASE c_custkey % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' ELSE '2' END AS as_boolean FROM customer""",
)
def _display_values(spark: SparkSession, d: str) -> DataFrame:
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    return fx.table(spark, d, "customer").select(
        key,
        text.display_value((1900 + key % 200).cast("double"), "year").alias("as_year"),
        text.display_value(key, "rawint").alias("as_rawint"),
        text.display_value(key * 1000, "integer").alias("as_integer"),
        text.display_value(F.round(balance - 5000, 2), "currency").alias("as_currency"),
        text.display_value(balance, "weight").alias("as_weight"),
        text.display_value(balance, "decimal").alias("as_decimal"),
        text.display_value((key % 3).cast("string"), "boolean").alias("as_boolean"),
    )


@query(
    "display_dates",
    "P17",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS as_datetime FROM orders",
)
def _display_dates(spark: SparkSession, d: str) -> DataFrame:
    orders = fx.table(spark, d, "orders")
    return orders.select("o_orderkey", text.display_value(F.col("o_orderdate"), "datetime").alias("as_datetime"))


@query(
    "rounded_values",
    "P18",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {rounded_sql("l_extendedprice / 7", 2)} AS price_share,
       CASE WHEN l_partkey % 2 = 0 THEN {rounded_sql("l_tax * 0.37", 2)} END AS tax_text FROM lineitem""",
)
def _rounded_values(spark: SparkSession, d: str) -> DataFrame:
    lines = fx.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_extendedprice") / 7).alias("price_share"),
        F.when(F.col("l_partkey") % 2 == 0, (F.col("l_tax") * 0.37).cast("string")).otherwise("n/a").alias("tax_text"),
    )
    rounded = round_for_summary(lines, ["price_share", "tax_text"])
    return rounded.withColumn("tax_text", F.col("tax_text").try_cast("double"))
