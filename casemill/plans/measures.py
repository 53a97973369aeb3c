"""Error rates, roll-ups, trends, statistics and quality reports over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill import spec
from casemill.operators import enrich, quality, rates, stats
from casemill.plans import fixtures as fx
from casemill.plans.loads import merged_store
from casemill.plans.registry import percent_sql, query, rounded_sql
from casemill.plans.rules import PROFILE, RATES, ROLLUP, STATE_RATES
from casemill.sources import rollups

_RATE_MONEY = (
    "tolerance_threshold", "estimated_total_households", "total_weighted_benefits", "avg_weighted_benefit",
    "avg_weighted_gross_income", "total_weighted_error_dollars", "weighted_overpayment_dollars",
    "weighted_underpayment_dollars",
)


def state_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates.state_error_rates(fx.households(spark, d), enrich.threshold_table(spark))


def rollup(spark: SparkSession, d: str) -> DataFrame:
    return rates.error_element_rollup(fx.errors(spark, d), fx.households(spark, d), fx.refs(spark))


query("state_error_rates", "A1 J6", STATE_RATES, money=_RATE_MONEY)(state_rates)
query("error_element_rollup", "A2", ROLLUP, money=("weighted_error_dollars", "avg_sample_error_amount"))(rollup)


@query("merged_error_rollup", "S20 A2", ROLLUP, money=("weighted_error_dollars", "avg_sample_error_amount"))
def _merged_error_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The roll-up from sums of several loads, one replaced since, one without the households of some of its errors."""
    return rollups.error_element_rollup(spark, merged_store(spark, d), fx.refs(spark))


@query(
    "demographic_profile",
    "A3 P6 P7",
    PROFILE,
    money=("estimated_member_count",),
)
def _demographic_profile(spark: SparkSession, d: str) -> DataFrame:
    return rates.demographic_profile(fx.members(spark, d), fx.households(spark, d), fx.refs(spark))


@query(
    "error_summary_by_type",
    "A4",
    """SELECT fiscal_year, category AS error_category, description AS error_type, count(*) AS error_count,
       sum(error_amount) AS total_error_amount,
       CAST(sum(error_amount) AS DOUBLE) / count(error_amount) AS avg_error_amount
       FROM errors LEFT JOIN ref_element ON element_code = code GROUP BY 1, 2, 3""",
    money=("total_error_amount", "avg_error_amount"),
)
def _error_summary_by_type(spark: SparkSession, d: str) -> DataFrame:
    return rates.error_summary_by_type(fx.errors(spark, d), fx.refs(spark))


@query(
    "error_summary_by_responsibility",
    "A5",
    """SELECT e.fiscal_year, state_name, responsibility_type, description AS responsibility_detail,
       count(*) AS error_count, sum(error_amount) AS total_error_amount
       FROM errors e LEFT JOIN ref_agency_responsibility ON responsible_agency = code
       LEFT JOIN households h ON e.case_id = h.case_id AND e.fiscal_year = h.fiscal_year GROUP BY 1, 2, 3, 4""",
    money=("total_error_amount",),
)
def _error_summary_by_responsibility(spark: SparkSession, d: str) -> DataFrame:
    return rates.error_summary_by_responsibility(fx.errors(spark, d), fx.households(spark, d), fx.refs(spark))


_AVG = "CAST(sum({0}) AS DOUBLE) / count({0})"


@query(
    "overview",
    "A6",
    f"""SELECT count(*) AS total_households, sum(snap_benefit) AS total_benefits,
        {_AVG.format("snap_benefit")} AS avg_benefit, {_AVG.format("certified_household_size")} AS avg_household_size,
        count(*) FILTER (WHERE num_elderly > 0) AS households_with_elderly,
        count(*) FILTER (WHERE num_children > 0) AS households_with_children,
        count(*) FILTER (WHERE num_disabled > 0) AS households_with_disabled,
        (SELECT count(*) FROM members m WHERE m.fiscal_year IN (2021, 2022, 2023) AND EXISTS (SELECT 1 FROM households p
          WHERE p.case_id = m.case_id AND p.fiscal_year = m.fiscal_year AND p.state_code IN ('1', '7', '12', '24')))
        AS total_members
        FROM households WHERE fiscal_year IN (2021, 2022, 2023) AND state_code IN ('1', '7', '12', '24')""",
    money=("total_benefits", "avg_benefit", "avg_household_size"),
)
def _overview(spark: SparkSession, d: str) -> DataFrame:
    return stats.overview(
        fx.households(spark, d), fx.members(spark, d), (2021, 2022, 2023), ("1", "7", "12", "24")
    )


@query(
    "statistics_by_state",
    "A7 T1",
    f"""SELECT state_code, state_name, count(*) AS household_count, sum(snap_benefit) AS total_benefits,
        {_AVG.format("snap_benefit")} AS avg_benefit, {_AVG.format("certified_household_size")} AS avg_household_size
        FROM households GROUP BY 1, 2""",
    money=("total_benefits", "avg_benefit", "avg_household_size"),
)
def _by_state(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_state(fx.households(spark, d))


@query(
    "top_states",
    "T5 A7",
    """SELECT state_name, sum(snap_benefit) AS total_benefits FROM households GROUP BY 1
       ORDER BY total_benefits DESC, state_name LIMIT 10""",
    money=("total_benefits",),
)
def _top_states(spark: SparkSession, d: str) -> DataFrame:
    totals = fx.households(spark, d).groupBy("state_name").agg(F.sum("snap_benefit").alias("total_benefits"))
    return totals.orderBy(F.desc("total_benefits"), "state_name").limit(10)


_PART_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS income_source, sum({n}) AS total, count(*) FILTER (WHERE {n} > 0) AS recipients FROM base"
    for n in spec.INCOME_SOURCES
)


@query(
    "income_by_source",
    "A8",
    f"""WITH base AS (SELECT m.* FROM members m WHERE EXISTS (SELECT 1 FROM households h
          WHERE h.case_id = m.case_id AND h.fiscal_year = m.fiscal_year)), s AS ({_PART_SQL})
        SELECT income_source, total, recipients, CAST(total AS DOUBLE) / recipients AS average_per_recipient,
        CAST(total AS DOUBLE) / (SELECT CAST(sum(total) AS DOUBLE) FROM s) * 100 AS percent_of_total FROM s""",
    money=("total", "average_per_recipient", "percent_of_total"),
)
def _income_by_source(spark: SparkSession, d: str) -> DataFrame:
    return stats.income_by_source(fx.members(spark, d), fx.households(spark, d))


@query(
    "demographics",
    "A9 J4",
    """SELECT count(*) AS total_members, count(*) FILTER (WHERE age BETWEEN 0 AND 17) AS children,
       count(*) FILTER (WHERE age BETWEEN 18 AND 64) AS adults, count(*) FILTER (WHERE age >= 65) AS elderly,
       count(*) FILTER (WHERE sex = 1) AS male, count(*) FILTER (WHERE sex = 2) AS female,
       count(*) FILTER (WHERE disability_indicator = 1) AS with_disability,
       count(*) FILTER (WHERE working_indicator = 1) AS working,
       count(*) - count(*) FILTER (WHERE disability_indicator = 1) AS without_disability,
       count(*) - count(*) FILTER (WHERE working_indicator = 1) AS not_working
       FROM members m WHERE fiscal_year = 2023 AND EXISTS (SELECT 1 FROM households h
       WHERE h.case_id = m.case_id AND h.fiscal_year = m.fiscal_year)""",
)
def _demographics(spark: SparkSession, d: str) -> DataFrame:
    return stats.demographics(fx.members(spark, d), fx.households(spark, d), 2023)


@query(
    "benefit_summary",
    "A10",
    f"""SELECT sum(snap_benefit) AS total_benefits, {_AVG.format("snap_benefit")} AS avg_benefit,
        min(snap_benefit) AS min_benefit, max(snap_benefit) AS max_benefit, count(*) AS households_receiving
        FROM households WHERE fiscal_year = 2022""",
    money=("total_benefits", "avg_benefit", "min_benefit", "max_benefit"),
)
def _benefit_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.benefit_summary(fx.households(spark, d), 2022)


@query(
    "benefit_histogram",
    "A11",
    " UNION ALL ".join(
        f"SELECT '{low}{'+' if high is None else f'-{high}'}' AS benefit_range,"
        f" count(*) FILTER (WHERE snap_benefit {f'>= {low}' if high is None else f'BETWEEN {low} AND {high}'})"
        f" AS households FROM households"
        for low, high in spec.BENEFIT_RANGES
    ).replace("AS households FROM households", "AS cases FROM households"),
)
def _benefit_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.benefit_histogram(fx.households(spark, d)).withColumnRenamed("households", "cases")


@query(
    "benefit_by_size",
    "A12",
    f"""SELECT certified_household_size AS household_size, count(*) AS cases,
        {_AVG.format("snap_benefit")} AS avg_benefit, sum(snap_benefit) AS total_benefits FROM households
        WHERE certified_household_size IS NOT NULL AND certified_household_size <> 0 GROUP BY 1""",
    money=("avg_benefit", "total_benefits"),
)
def _benefit_by_size(spark: SparkSession, d: str) -> DataFrame:
    return stats.benefit_by_size(fx.households(spark, d)).withColumnRenamed("households", "cases")


_ERR_BASE = """SELECT e.* FROM errors e WHERE e.fiscal_year = 2021 AND EXISTS (SELECT 1 FROM households h
 WHERE h.case_id = e.case_id AND h.fiscal_year = e.fiscal_year)"""


@query(
    "error_statistics",
    "A13 J4",
    f"""WITH b AS ({_ERR_BASE}), n AS (SELECT count(*) AS total_households FROM households WHERE fiscal_year = 2021)
        SELECT (SELECT count(*) FROM b) AS total_errors, (SELECT count(DISTINCT case_id) FROM b) AS households_with_errors,
        (SELECT sum(error_amount) FROM b) AS total_error_amount,
        (SELECT CAST(sum(error_amount) AS DOUBLE) / count(error_amount) FROM b) AS average_error_amount,
        total_households,
        CAST((SELECT count(DISTINCT case_id) FROM b) AS DOUBLE) / total_households * 100 AS error_rate_percent FROM n""",
    money=("total_error_amount", "average_error_amount", "error_rate_percent"),
)
def _error_statistics(spark: SparkSession, d: str) -> DataFrame:
    return stats.error_statistics(fx.errors(spark, d), fx.households(spark, d), 2021)


@query(
    "errors_by_element",
    "A13",
    f"""WITH b AS ({_ERR_BASE}) SELECT element_code, count(*) AS error_count, sum(error_amount) AS total_amount,
        CAST(sum(error_amount) AS DOUBLE) / count(error_amount) AS average_amount FROM b GROUP BY 1""",
    money=("total_amount", "average_amount"),
)
def _errors_by_element(spark: SparkSession, d: str) -> DataFrame:
    return stats.errors_by_element(fx.errors(spark, d), fx.households(spark, d), 2021)


@query(
    "store_totals",
    "A14",
    """WITH e AS (SELECT count(*) AS n FROM (SELECT DISTINCT case_id, fiscal_year FROM errors))
       SELECT (SELECT count(*) FROM households) AS total_households,
       (SELECT count(*) FROM members) AS total_household_members, (SELECT count(*) FROM errors) AS total_qc_errors,
       n AS households_with_errors, (SELECT count(*) FROM households) - n AS households_without_errors FROM e""",
)
def _store_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.store_totals(fx.households(spark, d), fx.members(spark, d), fx.errors(spark, d))


@query("rows_by_year", "A14", "SELECT fiscal_year, count(*) AS row_count FROM households GROUP BY 1")
def _rows_by_year(spark: SparkSession, d: str) -> DataFrame:
    return stats.rows_by_year(fx.households(spark, d))


@query(
    "table_counts",
    "A15",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count, count(*) = 0 AS is_empty FROM {t}" for t in fx.TABLES),
)
def _table_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.table_counts(fx.tables(spark, d))


@query(
    "filter_options",
    "A16",
    "SELECT DISTINCT state_name FROM households WHERE state_name IS NOT NULL",
)
def _filter_options(spark: SparkSession, d: str) -> DataFrame:
    return stats.filter_options(fx.households(spark, d), "state_name")


@query(
    "weighted_estimates",
    "A17",
    """SELECT fiscal_year, state_name, sum(snap_benefit * household_weight) AS weighted_total,
       CAST(sum(snap_benefit * household_weight) AS DOUBLE) / CAST(sum(household_weight) AS DOUBLE) AS weighted_mean,
       sum(household_weight) AS estimated_population FROM households GROUP BY 1, 2""",
    money=("weighted_total", "weighted_mean", "estimated_population"),
)
def _weighted_estimates(spark: SparkSession, d: str) -> DataFrame:
    return rates.weighted_estimates(fx.households(spark, d), "snap_benefit", ["fiscal_year", "state_name"])


@query(
    "rolling_two_year_rates",
    "A18",
    f"""WITH r AS ({RATES}) SELECT a.fiscal_year, a.state_name,
        sum(b.total_weighted_error_dollars) AS rolling_error_dollars, sum(b.total_weighted_benefits) AS rolling_benefits,
        {percent_sql("sum(b.total_weighted_error_dollars)", "sum(b.total_weighted_benefits)")}
        AS rolling_error_rate
        FROM r a JOIN r b ON a.state_code = b.state_code AND b.fiscal_year IN (a.fiscal_year, a.fiscal_year - 1)
        GROUP BY 1, 2""",
    money=("rolling_error_dollars", "rolling_benefits"),
)
def _rolling(spark: SparkSession, d: str) -> DataFrame:
    return rates.rolling_two_year_rates(state_rates(spark, d))


@query(
    "expedited_late_rate",
    "A19",
    f"""SELECT fiscal_year, state_name, count(*) FILTER (WHERE expedited_service = 2) AS late_cases,
       count(*) FILTER (WHERE expedited_service IN (1, 2)) AS entitled_cases,
       {percent_sql("count(*) FILTER (WHERE expedited_service = 2)", "count(*) FILTER (WHERE expedited_service IN (1, 2))")} AS late_rate
       FROM households GROUP BY 1, 2""",
)
def _late_rate(spark: SparkSession, d: str) -> DataFrame:
    return rates.expedited_late_rate(fx.households(spark, d), ["fiscal_year", "state_name"])


_NATIONAL = f"""SELECT fiscal_year, sum(total_weighted_error_dollars) AS national_error_dollars,
 sum(total_weighted_benefits) AS national_benefits,
 {percent_sql("sum(total_weighted_error_dollars)", "sum(total_weighted_benefits)")}
 AS national_rate FROM ({RATES}) AS r GROUP BY 1"""


@query("national_rates", "A20", _NATIONAL, money=("national_error_dollars", "national_benefits"))
def _national(spark: SparkSession, d: str) -> DataFrame:
    return rates.national_rates(state_rates(spark, d))


@query(
    "states_above_national",
    "J11",
    f"""WITH s AS ({STATE_RATES}), n AS ({_NATIONAL}) SELECT s.fiscal_year, s.state_name, payment_error_rate, national_rate
        FROM s JOIN n ON s.fiscal_year = n.fiscal_year WHERE payment_error_rate > national_rate""",
)
def _above_national(spark: SparkSession, d: str) -> DataFrame:
    return rates.states_above_national(state_rates(spark, d))


@query(
    "ranked_elements",
    "W1",
    f"""WITH t AS (SELECT fiscal_year, element_code, element_description, sum(weighted_error_dollars) AS weighted_error_dollars
          FROM ({ROLLUP}) AS r GROUP BY 1, 2, 3)
        SELECT fiscal_year, element_code, element_description, weighted_error_dollars,
        CAST(rank() OVER (PARTITION BY fiscal_year ORDER BY weighted_error_dollars DESC) AS INT) AS dollar_rank,
        {percent_sql("weighted_error_dollars", "sum(weighted_error_dollars) OVER (PARTITION BY fiscal_year)")} AS percent_of_total,
        {percent_sql("sum(weighted_error_dollars) OVER (PARTITION BY fiscal_year ORDER BY weighted_error_dollars DESC, element_code ROWS UNBOUNDED PRECEDING)", "sum(weighted_error_dollars) OVER (PARTITION BY fiscal_year)")} AS cumulative_percent FROM t""",
    money=("weighted_error_dollars",),
)
def _ranked_elements(spark: SparkSession, d: str) -> DataFrame:
    return rates.ranked_elements(rollup(spark, d))


@query(
    "rate_changes",
    "W2",
    f"""WITH s AS ({STATE_RATES}) SELECT a.fiscal_year, a.state_name, a.payment_error_rate,
        b.payment_error_rate AS previous_rate, {rounded_sql("a.payment_error_rate - b.payment_error_rate", 4)} AS rate_change,
        {rounded_sql("a.payment_error_rate - b.payment_error_rate", 4)} < 0 AS improved
        FROM s a JOIN s b ON a.state_code = b.state_code AND b.fiscal_year = a.fiscal_year - 1
        WHERE b.payment_error_rate IS NOT NULL""",
)
def _rate_changes(spark: SparkSession, d: str) -> DataFrame:
    return rates.rate_changes(state_rates(spark, d))


@query(
    "top_elements",
    "T5 A2",
    f"""SELECT element_code, element_description, sum(weighted_error_dollars) AS weighted_error_dollars
        FROM ({ROLLUP}) AS r GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 3""",
    money=("weighted_error_dollars",),
)
def _top_elements(spark: SparkSession, d: str) -> DataFrame:
    return rates.top_elements(rollup(spark, d))


def _rule_sql(table: str, number: str, rules: list[tuple[str, str, str, str]]) -> str:
    parts = [
        f"SELECT '{table_name(table)}' AS table_name, case_id, fiscal_year, {number} AS slot_number, '{rule}' AS rule,"
        f" '{severity}' AS severity, CAST({value} AS VARCHAR) AS value FROM {table} WHERE {test}"
        for rule, severity, test, value in rules
    ]
    return " UNION ALL ".join(parts)


def table_name(fixture: str) -> str:
    return {"members": "household_members", "errors": "qc_errors"}.get(fixture, fixture)


_V1 = _rule_sql(
    "households",
    "CAST(NULL AS INT)",
    [
        ("negative_benefit", "error", "snap_benefit < 0", "snap_benefit"),
        ("invalid_household_size", "error", "certified_household_size < 1 AND certified_household_size <> 0", "certified_household_size"),
        ("large_household", "warning", "certified_household_size > 20", "certified_household_size"),
        ("gross_below_net", "error", "gross_income < net_income", "gross_income"),
        *[(f"negative_{c}", "error", f"{c} < 0", c) for c in ("gross_income", "net_income", "earned_income", "unearned_income")],
    ],
)
_V2 = _rule_sql(
    "members",
    "member_number",
    [
        ("invalid_age", "error", "age NOT BETWEEN 0 AND 120", "age"),
        ("high_age", "warning", "age > 110", "age"),
        *[(f"negative_{c}", "error", f"{c} < 0", c) for c in spec.NON_NEGATIVE_MEMBER_FIELDS],
    ],
)
_V3 = _rule_sql(
    "errors",
    "error_number",
    [
        ("negative_error_amount", "warning", "error_amount < 0", "error_amount"),
        ("large_error_amount", "warning", "error_amount > 100000", "error_amount"),
    ],
)


@query("household_violations", "V1", _V1)
def _household_violations(spark: SparkSession, d: str) -> DataFrame:
    return quality.household_violations(fx.households(spark, d))


@query("member_violations", "V2", _V2)
def _member_violations(spark: SparkSession, d: str) -> DataFrame:
    return quality.member_violations(fx.members(spark, d))


@query("error_violations", "V3", _V3)
def _error_violations(spark: SparkSession, d: str) -> DataFrame:
    return quality.error_violations(fx.errors(spark, d))


_ALL_V = " UNION ALL ".join((_V1, _V2, _V3))


def _validated(spark: SparkSession, d: str, strict: bool) -> DataFrame:
    found = quality.validate(fx.households(spark, d), fx.members(spark, d), fx.errors(spark, d), strict)
    return quality.report(found)


@query(
    "validation_report",
    "A21 V4",
    f"SELECT table_name, rule, severity, count(*) AS violations FROM ({_ALL_V}) AS v GROUP BY 1, 2, 3",
)
def _validation_report(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d, False)


@query(
    "strict_validation_report",
    "V5",
    f"SELECT table_name, rule, 'error' AS severity, count(*) AS violations FROM ({_ALL_V}) AS v GROUP BY 1, 2, 3",
)
def _strict_report(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d, True)


@query(
    "duplicate_keys",
    "V6",
    """SELECT case_id, fiscal_year, member_number, count(*) AS row_count FROM members
       GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def _duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(fx.members(spark, d), ["case_id", "fiscal_year", "member_number"])


@query("age_check", "V7", "SELECT count(*) AS violations FROM members WHERE age < 0 OR age > 120")
def _age_check(spark: SparkSession, d: str) -> DataFrame:
    return quality.out_of_range(fx.members(spark, d), "age", 0, 120)


_FK_CODES = {
    "households": {"status": "ref_status", "case_classification": "ref_case_classification",
                   "categorical_eligibility": "ref_categorical_eligibility", "expedited_service": "ref_expedited_service"},
    "household_members": {"sex": "ref_sex", "snap_affiliation_code": "ref_snap_affiliation"},
    "qc_errors": {"element_code": "ref_element", "nature_code": "ref_nature", "responsible_agency": "ref_agency_responsibility",
                  "discovery_method": "ref_discovery", "error_finding": "ref_error_finding"},
}
_FIXTURE_OF = {"households": "households", "household_members": "members", "qc_errors": "errors"}


def _fk_sql() -> str:
    parts = []
    for name, codes in _FK_CODES.items():
        table = _FIXTURE_OF[name]
        if name != "households":
            parts.append(
                f"SELECT '{name}' AS table_name, 'case_id,fiscal_year' AS foreign_key, count(*) AS orphan_keys,"
                f" CAST(coalesce(sum(n), 0) AS BIGINT) AS orphan_rows FROM (SELECT case_id, fiscal_year, count(*) AS n"
                f" FROM {table} GROUP BY 1, 2) c WHERE NOT EXISTS (SELECT 1 FROM households h"
                f" WHERE h.case_id = c.case_id AND h.fiscal_year = c.fiscal_year)"
            )
        for column, ref in codes.items():
            parts.append(
                f"SELECT '{name}' AS table_name, '{column}' AS foreign_key, count(*) AS orphan_keys,"
                f" CAST(coalesce(sum(n), 0) AS BIGINT) AS orphan_rows FROM (SELECT {column} AS k, count(*) AS n"
                f" FROM {table} WHERE {column} IS NOT NULL GROUP BY 1) c WHERE NOT EXISTS"
                f" (SELECT 1 FROM {ref} r WHERE r.code = c.k)"
            )
    return " UNION ALL ".join(parts)


@query("referential_report", "J5 V8", _fk_sql())
def _referential_report(spark: SparkSession, d: str) -> DataFrame:
    found = {
        "households": fx.households(spark, d),
        "household_members": fx.members(spark, d),
        "qc_errors": fx.errors(spark, d),
    }
    return quality.referential_report(found, fx.refs(spark), _FK_CODES)


@query(
    "references_ready",
    "V9 A15",
    """SELECT 'ref_state' AS table_name, count(*) AS row_count, count(*) > 0 AS ready FROM nation
       UNION ALL SELECT 'ref_region', count(*), count(*) > 0 FROM region
       UNION ALL SELECT 'ref_part', count(*), count(*) > 0 FROM part
       UNION ALL SELECT 'ref_unused', count(*), count(*) > 0 FROM part WHERE p_size < 0""",
)
def _references_ready(spark: SparkSession, d: str) -> DataFrame:
    part = fx.table(spark, d, "part")
    found = {
        "ref_state": fx.table(spark, d, "nation"),
        "ref_region": fx.table(spark, d, "region"),
        "ref_part": part,
        "ref_unused": part.filter("p_size < 0"),
    }
    return quality.references_ready(found)
