"""Views, classifications, joins and filters over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill import spec
from casemill.functions import dates
from casemill.operators import classify, enrich, filters, rates
from casemill.plans import fixtures as fx
from casemill.plans import rules
from casemill.plans.registry import query, rounded_sql
from casemill.plans.rules import described

_HH_MONEY = (
    "snap_benefit", "raw_benefit", "amount_error", "gross_income", "net_income", "earned_income", "unearned_income",
)

_STATES = ("NATION-d", "NATION-bc", "NATION-h")
_YEARS = (2021, 2023)
_STATE_LIST = ", ".join(f"'{s}'" for s in _STATES)


@query(
    "households_enriched",
    "J1",
    f"""SELECT case_id, fiscal_year, state_name, status, categorical_eligibility, expedited_service,
        {described("status", "ref_status")} AS status_description,
        {described("categorical_eligibility", "ref_categorical_eligibility")} AS categorical_eligibility_description,
        {described("expedited_service", "ref_expedited_service")} AS expedited_service_description FROM households""",
)
def _households_enriched(spark: SparkSession, d: str) -> DataFrame:
    out = enrich.households_enriched(fx.households(spark, d), fx.refs(spark))
    return out.select(
        "case_id", "fiscal_year", "state_name", "status", "status_description", "categorical_eligibility",
        "categorical_eligibility_description", "expedited_service", "expedited_service_description",
    )


@query(
    "errors_enriched",
    "J2",
    f"""SELECT case_id, fiscal_year, error_number, element_code, nature_code, responsible_agency, error_finding, error_amount,
        state_name, state_code, household_status, {described("element_code", "ref_element")} AS element_description,
        {described("element_code", "ref_element", "category")} AS element_category,
        {described("nature_code", "ref_nature")} AS nature_description, {described("nature_code", "ref_nature", "category")} AS nature_category,
        {described("responsible_agency", "ref_agency_responsibility")} AS agency_description,
        {described("responsible_agency", "ref_agency_responsibility", "responsibility_type")} AS responsibility_type,
        {described("error_finding", "ref_error_finding")} AS finding_description
        FROM errors JOIN (SELECT case_id, fiscal_year, state_name, state_code, status AS household_status FROM households) AS homes
        USING (case_id, fiscal_year)""",
    money=("error_amount",),
)
def _errors_enriched(spark: SparkSession, d: str) -> DataFrame:
    out = enrich.errors_enriched(fx.errors(spark, d), fx.households(spark, d), fx.refs(spark))
    return out.drop("discovery_method", "verification_status", "occurrence_date", "time_period")


@query(
    "members_enriched",
    "J3",
    f"""SELECT case_id, fiscal_year, member_number, age, sex, snap_affiliation_code, wages, state_name,
        {described("sex", "ref_sex")} AS sex_description,
        {described("snap_affiliation_code", "ref_snap_affiliation")} AS affiliation_description
        FROM members LEFT JOIN (SELECT case_id, fiscal_year, state_name FROM households) AS homes USING (case_id, fiscal_year)""",
    money=("wages",),
)
def _members_enriched(spark: SparkSession, d: str) -> DataFrame:
    out = enrich.members_enriched(fx.members(spark, d), fx.households(spark, d), fx.refs(spark))
    return out.select(
        "case_id", "fiscal_year", "member_number", "age", "sex", "snap_affiliation_code", "wages", "state_name",
        "sex_description", "affiliation_description",
    )


@query(
    "household_summary",
    "P8 P9 P10 P11 J6",
    f"""SELECT case_id, fiscal_year, state_name, status, {described("status", "ref_status")} AS status_description, snap_benefit,
        amount_error, {rules.HOUSEHOLD_TYPE} AS household_type, {rules.INCOME_KIND} AS income_category,
        {rules.finding("households.fiscal_year")} AS error_classification FROM households""",
    money=("snap_benefit", "amount_error"),
)
def _household_summary(spark: SparkSession, d: str) -> DataFrame:
    out = enrich.household_summary(fx.households(spark, d), fx.refs(spark), enrich.threshold_table(spark))
    return out.select(
        "case_id", "fiscal_year", "state_name", "status", "status_description", "snap_benefit", "amount_error",
        "household_type", "income_category", "error_classification",
    )


@query(
    "household_segments",
    "P8 P9 P10 A17",
    f"""SELECT household_type, income_category, error_classification, count(*) AS sample_cases, sum(household_weight) AS estimated_households
        FROM (SELECT {rules.HOUSEHOLD_TYPE} AS household_type, {rules.INCOME_KIND} AS income_category,
        {rules.finding("households.fiscal_year")} AS error_classification, household_weight FROM households) AS each_case GROUP BY ALL""",
    money=("estimated_households",),
)
def _household_segments(spark: SparkSession, d: str) -> DataFrame:
    out = enrich.household_summary(fx.households(spark, d), fx.refs(spark), enrich.threshold_table(spark))
    return out.groupBy("household_type", "income_category", "error_classification").agg(
        F.count(F.lit(1)).alias("sample_cases"), F.sum("household_weight").alias("estimated_households")
    )


@query(
    "tolerance_thresholds",
    "J6",
    f"""SELECT fiscal_year, CAST({rules.tolerance("households.fiscal_year")} AS DOUBLE) AS tolerance_threshold, count(*) AS cases
        FROM households GROUP BY ALL""",
)
def _tolerance_thresholds(spark: SparkSession, d: str) -> DataFrame:
    out = enrich.with_threshold(fx.households(spark, d), enrich.threshold_table(spark))
    return out.groupBy("fiscal_year", F.col("tolerance_threshold").cast("double").alias("tolerance_threshold")).agg(
        F.count(F.lit(1)).alias("cases")
    )


@query(
    "member_classes",
    "P6 P7",
    f"""SELECT age_group, working_status, disability_status, count(*) AS members_counted
        FROM (SELECT {rules.AGE_BAND} AS age_group, {rules.flag("working_indicator", "Working")} AS working_status,
        {rules.flag("disability_indicator", "Disabled")} AS disability_status FROM members) AS each_person GROUP BY ALL""",
)
def _member_classes(spark: SparkSession, d: str) -> DataFrame:
    return (
        fx.members(spark, d)
        .groupBy(
            classify.age_group(F.col("age")).alias("age_group"),
            classify.indicator(F.col("working_indicator"), "Working").alias("working_status"),
            classify.indicator(F.col("disability_indicator"), "Disabled").alias("disability_status"),
        )
        .agg(F.count(F.lit(1)).alias("members_counted"))
    )


@query(
    "set_categories",
    "P12",
    """SELECT p_partkey, p_size, CASE WHEN p_size IN (1, 2, 3, 5, 8, 13, 21, 34) THEN 'zeta'
       WHEN p_size IN (4, 6, 9, 10, 14, 15) THEN 'alpha' END AS category FROM part""",
)
def _set_categories(spark: SparkSession, d: str) -> DataFrame:
    sets = spark.sql(
        "SELECT * FROM VALUES ('zeta', array(1, 2, 3, 5, 8, 13, 21, 34), 0), ('alpha', array(4, 6, 9, 10, 14, 15, 21), 1)"
        " AS t(category, codes, set_order)"
    )
    parts = fx.table(spark, d, "part").select("p_partkey", "p_size")
    return classify.with_set_category(parts, "p_size", sets)


@query(
    "keyword_categories",
    "P13",
    f"""SELECT lang, {fx.duck_keyword_case("text")} AS category, count(*) AS documents_counted
        FROM documents GROUP BY 1, 2""",
)
def _keyword_categories(spark: SparkSession, d: str) -> DataFrame:
    return (
        fx.table(spark, d, "documents")
        .groupBy("lang", classify.keyword_category(F.col("text")).alias("category"))
        .agg(F.count(F.lit(1)).alias("documents_counted"))
    )


@query(
    "filtered_households",
    "P14",
    f"""SELECT case_id, fiscal_year, state_name FROM households
        WHERE state_name IN ({_STATE_LIST}) AND fiscal_year IN (2021, 2023)""",
)
def _filtered_households(spark: SparkSession, d: str) -> DataFrame:
    chosen = filters.GlobalFilter(_STATES, _YEARS)
    return filters.apply_filter(fx.households(spark, d), chosen).select("case_id", "fiscal_year", "state_name")


@query(
    "filtered_members",
    "J4",
    f"""SELECT m.case_id, m.fiscal_year, m.member_number, m.age FROM members m
        WHERE m.fiscal_year IN (2021, 2023) AND EXISTS (SELECT 1 FROM households h WHERE h.case_id = m.case_id
        AND h.fiscal_year = m.fiscal_year AND h.state_name IN ({_STATE_LIST}))""",
)
def _filtered_members(spark: SparkSession, d: str) -> DataFrame:
    chosen = filters.GlobalFilter(_STATES, _YEARS)
    kept = filters.apply_filter(fx.members(spark, d), chosen, fx.households(spark, d))
    return kept.select("case_id", "fiscal_year", "member_number", "age")


@query(
    "text_match",
    "P19",
    """SELECT p_brand, count(*) AS parts_counted FROM part
       WHERE p_name ILIKE '%RED%' OR p_type ILIKE 'econ%' GROUP BY 1""",
)
def _text_match(spark: SparkSession, d: str) -> DataFrame:
    hit = F.col("p_name").ilike("%RED%") | F.col("p_type").ilike("econ%")
    return fx.table(spark, d, "part").filter(hit).groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts_counted"))


@query(
    "fiscal_calendar",
    "P1 S8",
    """SELECT CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS INT) AS fiscal_year,
       strftime(o_orderdate, '%Y%m') AS year_month, count(*) AS cases FROM orders GROUP BY 1, 2""",
)
def _fiscal_calendar(spark: SparkSession, d: str) -> DataFrame:
    date = F.col("o_orderdate")
    keys = (dates.fiscal_year(date).alias("fiscal_year"), dates.year_month(date).alias("year_month"))
    return fx.table(spark, d, "orders").groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"))


def _desc_sql(code: str, ref: str, extra: str = "") -> str:
    more = f", {ref}.{extra} AS {ref.removeprefix('ref_')}_{extra}" if extra else ""
    return f"{code}, {ref}.description AS {code}_desc{more}"


@query(
    "described_errors",
    "J7",
    f"""SELECT case_id, fiscal_year, error_number, {_desc_sql("element_code", "ref_element", "category")},
        {_desc_sql("nature_code", "ref_nature", "category")},
        {_desc_sql("responsible_agency", "ref_agency_responsibility", "responsibility_type")},
        {_desc_sql("discovery_method", "ref_discovery")}, {_desc_sql("error_finding", "ref_error_finding")}
        FROM errors LEFT JOIN ref_element ON element_code = ref_element.code
        LEFT JOIN ref_nature ON nature_code = ref_nature.code
        LEFT JOIN ref_agency_responsibility ON responsible_agency = ref_agency_responsibility.code
        LEFT JOIN ref_discovery ON discovery_method = ref_discovery.code
        LEFT JOIN ref_error_finding ON error_finding = ref_error_finding.code""",
)
def _described_errors(spark: SparkSession, d: str) -> DataFrame:
    out = enrich.with_descriptions(fx.errors(spark, d), fx.refs(spark))
    return out.drop("error_amount", "verification_status", "occurrence_date", "time_period")


_PRESENT = (("status", "ref_status"), ("categorical_eligibility", "ref_categorical_eligibility"), ("expedited_service", "ref_expedited_service"))


@query(
    "codes_in_result",
    "J8",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(x.{c} AS VARCHAR) AS code,"
        f" coalesce(r.description, 'Unknown code ' || x.{c}) AS description"
        f" FROM (SELECT DISTINCT {c} FROM households WHERE {c} IS NOT NULL) x LEFT JOIN {r} r ON x.{c} = r.code"
        for c, r in _PRESENT
    ),
)
def _codes_in_result(spark: SparkSession, d: str) -> DataFrame:
    result = fx.households(spark, d).select("case_id", *[c for c, _ in _PRESENT])
    return enrich.codes_in_result(result, fx.refs(spark))


@query(
    "computed_vs_official",
    "J10",
    f"""WITH r AS (SELECT fiscal_year, state_name, payment_error_rate AS computed_rate FROM ({rules.STATE_RATES}) AS rated),
       o AS (SELECT CAST(2017 + c_custkey % 9 AS INT) AS fiscal_year,
         translate(n_name, '_0123456789', '-abcdefghij') AS state_name,
         CAST(max(c_custkey % 900) AS DOUBLE) / 100 AS official_rate
         FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
       SELECT coalesce(r.fiscal_year, o.fiscal_year) AS fiscal_year, coalesce(r.state_name, o.state_name) AS state_name,
       computed_rate, official_rate, {rounded_sql("computed_rate - official_rate", 4)} AS difference
       FROM r FULL JOIN o ON r.fiscal_year = o.fiscal_year AND r.state_name = o.state_name""",
    money=("computed_rate", "official_rate", "difference"),
)
def _computed_vs_official(spark: SparkSession, d: str) -> DataFrame:
    computed = rates.state_error_rates(fx.households(spark, d), enrich.threshold_table(spark))
    nation = fx.table(spark, d, "nation").selectExpr(
        "n_nationkey AS c_nationkey", "translate(n_name, '_0123456789', '-abcdefghij') AS state_name"
    )
    official = (
        fx.table(spark, d, "customer")
        .join(nation, "c_nationkey")
        .groupBy(F.expr("CAST(2017 + c_custkey % 9 AS INT)").alias("fiscal_year"), "state_name")
        .agg((F.max(F.expr("c_custkey % 900")).cast("double") / 100).alias("payment_error_rate"))
    )
    return enrich.computed_vs_official(computed, official)


@query(
    "default_row_cap",
    "T2 T1",
    f"""SELECT case_id, fiscal_year, snap_benefit FROM households
        ORDER BY case_id, fiscal_year LIMIT {spec.LISTING_ROW_CAP}""",
    money=("snap_benefit",),
)
def _default_row_cap(spark: SparkSession, d: str) -> DataFrame:
    from casemill.sources.export import capped

    return capped(
        fx.households(spark, d).select("case_id", "fiscal_year", "snap_benefit"),
        spec.LISTING_ROW_CAP,
        ["case_id", "fiscal_year"],
    )


@query(
    "household_export",
    "S16 J7 T1",
    f"""SELECT case_id, fiscal_year, state_code, state_name, year_month, status, {described("status", "ref_status")} AS status_desc,
        {", ".join(_HH_MONEY)}, certified_household_size, num_elderly, num_children, num_disabled, categorical_eligibility,
        {described("categorical_eligibility", "ref_categorical_eligibility")} AS categorical_eligibility_desc, expedited_service,
        {described("expedited_service", "ref_expedited_service")} AS expedited_service_desc, working_poor_indicator, tanf_indicator
        FROM households WHERE fiscal_year = 2023""",
    money=_HH_MONEY,
)
def _household_export(spark: SparkSession, d: str) -> DataFrame:
    from casemill.sources.export import described_export

    chosen = filters.GlobalFilter(fiscal_years=(2023,))
    return described_export("households", fx.households(spark, d), fx.refs(spark), chosen)


@query(
    "member_export",
    "S16 J7 T1",
    f"""SELECT case_id, fiscal_year, state_name, member_number, age, sex, {described("sex", "ref_sex")} AS sex_desc, race_ethnicity,
        {described("race_ethnicity", "ref_race_ethnicity")} AS race_ethnicity_desc, citizenship_status,
        {described("citizenship_status", "ref_citizenship_status")} AS citizenship_status_desc, snap_affiliation_code,
        {described("snap_affiliation_code", "ref_snap_affiliation")} AS snap_affiliation_code_desc, wages, ssi
        FROM members JOIN (SELECT case_id, fiscal_year, state_name FROM households WHERE state_name IN ({_STATE_LIST})) AS homes
        USING (case_id, fiscal_year)""",
    money=("wages", "ssi"),
)
def _member_export(spark: SparkSession, d: str) -> DataFrame:
    from casemill.sources.export import described_export

    out = described_export(
        "household_members",
        fx.members(spark, d),
        fx.refs(spark),
        filters.GlobalFilter(states=_STATES),
        parent=fx.households(spark, d),
    )
    return out.select(
        "case_id", "fiscal_year", "state_name", "member_number", "age", "sex", "sex_desc", "race_ethnicity",
        "race_ethnicity_desc", "citizenship_status", "citizenship_status_desc", "snap_affiliation_code",
        "snap_affiliation_code_desc", "wages", "ssi",
    )


@query(
    "error_export",
    "S16 J7 T1",
    f"""SELECT e.case_id, e.fiscal_year, state_name, error_number,
       {_desc_sql("element_code", "ref_element", "category")}, {_desc_sql("nature_code", "ref_nature", "category")},
       {_desc_sql("responsible_agency", "ref_agency_responsibility", "responsibility_type")}, error_amount,
       {_desc_sql("discovery_method", "ref_discovery")}, verification_status, occurrence_date, time_period,
       {_desc_sql("error_finding", "ref_error_finding")}
       FROM errors e JOIN households h ON e.case_id = h.case_id AND e.fiscal_year = h.fiscal_year
       LEFT JOIN ref_element ON element_code = ref_element.code LEFT JOIN ref_nature ON nature_code = ref_nature.code
       LEFT JOIN ref_agency_responsibility ON responsible_agency = ref_agency_responsibility.code
       LEFT JOIN ref_discovery ON discovery_method = ref_discovery.code
       LEFT JOIN ref_error_finding ON error_finding = ref_error_finding.code""",
    money=("error_amount",),
)
def _error_export(spark: SparkSession, d: str) -> DataFrame:
    from casemill.sources.export import described_export

    return described_export(
        "qc_errors", fx.errors(spark, d), fx.refs(spark), filters.GlobalFilter(), parent=fx.households(spark, d)
    )


@query(
    "table_export",
    "S17",
    """SELECT case_id, fiscal_year, state_name, status, snap_benefit, household_weight FROM households
       WHERE fiscal_year = 2022 AND state_name = 'NATION-bc'""",
    money=("snap_benefit", "household_weight"),
)
def _table_export(spark: SparkSession, d: str) -> DataFrame:
    from casemill.sources.export import table_export

    known = {"households": fx.households(spark, d), "qc_errors": fx.errors(spark, d)}
    out = table_export(known, "households", filters.GlobalFilter(("NATION-bc",), (2022,)))
    return out.select("case_id", "fiscal_year", "state_name", "status", "snap_benefit", "household_weight")
