"""SQL of the checks for bands, classes and rates: rules as tables of values, looked up row by row.

The checks do not share their shape with the operators: classes come from rows that fit, first place wins; dollars from one
signed excess for each case; roll-ups sum by codes first and are named afterwards.
"""

from __future__ import annotations

from casemill.plans.registry import percent_sql

_ANY = 1_000_000  # beyond every count and age


def described(code: str, ref: str, what: str = "description") -> str:
    """What a code table says of a code; NULL where it says nothing."""
    return f"(SELECT found.{what} FROM {ref} found WHERE found.code = {code})"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows) + ")"


def tolerance(year: str) -> str:
    return f"coalesce((SELECT threshold_amount FROM thresholds limits WHERE limits.fiscal_year = {year}), 54)"


# Lowest and highest age of a band.
_BANDS = [(-_ANY, 5, "Under 6"), (6, 17, "6-17"), (18, 24, "18-24"), (25, 49, "25-49"), (50, 59, "50-59"), (60, _ANY, "60+")]
AGE_BAND = f"(SELECT band FROM {_values(_BANDS)} AS bands(youngest, oldest, band) WHERE age BETWEEN youngest AND oldest)"

# Place, range of elderly and of children, what the size equals ('' for anything), type.
_TYPES = [
    (1, 1, _ANY, 0, 0, "elderly", "Elderly Only"),
    (2, 0, 0, 1, _ANY, "", "With Children (No Elderly)"),
    (3, 1, _ANY, 1, _ANY, "", "Elderly and Children"),
    (4, 0, 0, -_ANY, _ANY, "one", "Single Adult"),
]
HOUSEHOLD_TYPE = f"""coalesce((SELECT arg_min(kind, place) FROM {_values(_TYPES)}
 AS types(place, least_old, most_old, least_young, most_young, size_is, kind)
 WHERE coalesce(num_elderly, -1) BETWEEN least_old AND most_old AND coalesce(num_children, -1) BETWEEN least_young AND most_young
 AND (size_is = '' OR certified_household_size = if(size_is = 'one', 1, num_elderly))), 'Other Adult')"""

# Signs of earned and unearned income where there is gross income.
_KINDS = [(1, 0, "Earned Income Only"), (0, 1, "Unearned Income Only"), (1, 1, "Mixed Income")]
INCOME_KIND = f"""if(coalesce(gross_income, 0) = 0, 'Zero Income', coalesce((SELECT kind FROM {_values(_KINDS)}
 AS kinds(earned, unearned, kind) WHERE earned = sign(earned_income) AND unearned = sign(unearned_income)), 'Unknown'))"""

# Which way a status errs.
_WAYS = [(2, 1, "Overissuance"), (3, -1, "Underissuance")]
_WAY = f"{_values(_WAYS)} AS ways(of_status, way, direction)"


def finding(year: str) -> str:
    side = f"if(coalesce(abs(amount_error) - {tolerance(year)} > 0, false), 'Above', 'Within')"
    return f"""if(status = 1, 'No Error', coalesce((SELECT direction FROM {_WAY} WHERE of_status = status)
 || ' (' || {side} || ' Tolerance)', 'Unknown'))"""


def flag(column: str, name: str) -> str:
    return f"concat(if(coalesce({column}, 0) = 1, '', 'Not '), '{name}')"


# One row for each counted case: its weighted dollars, and the excess over the tolerance with the sign of its way.
_CASES = f"""SELECT *, if(amount_error > tolerance_threshold, coalesce(way, 0), 0) * amount_error * household_weight AS excess
 FROM (SELECT *, {tolerance("counted.fiscal_year")} AS tolerance_threshold FROM households counted WHERE case_classification = 1)
 LEFT JOIN {_WAY} ON of_status = status"""
# Sums by status, then over all: a status other than 1 is an error.
_BY_STATUS = f"""SELECT fiscal_year, state_name, state_code, tolerance_threshold, status, count(*) AS cases, sum(household_weight) AS weight,
 sum(household_weight * snap_benefit) AS paid, sum(household_weight * gross_income) AS income,
 sum(greatest(excess, 0)) AS over, sum(greatest(-excess, 0)) AS under FROM ({_CASES}) AS each_case GROUP BY ALL"""


def _cases(status: str) -> str:
    return f"CAST(coalesce(sum(cases) FILTER (WHERE {status}), 0) AS BIGINT)"


RATES = f"""SELECT fiscal_year, state_name, state_code, tolerance_threshold, {_cases("true")} AS total_sample_cases,
 {_cases("status <> 1")} AS error_sample_cases, {_cases("status = 2")} AS overissuance_sample_cases,
 {_cases("status = 3")} AS underissuance_sample_cases, sum(weight) AS estimated_total_households, sum(paid) AS total_weighted_benefits,
 sum(income) AS gross_weighted, sum(over) + sum(under) AS total_weighted_error_dollars, sum(over) AS weighted_overpayment_dollars,
 sum(under) AS weighted_underpayment_dollars FROM ({_BY_STATUS}) AS by_status GROUP BY ALL"""


def _mean(total: str) -> str:
    return f"CAST({total} AS DOUBLE) / CAST(estimated_total_households AS DOUBLE)"


def _rate(part: str, name: str) -> str:
    return f"{percent_sql(part, 'total_weighted_benefits')} AS {name}"


STATE_RATES = f"""SELECT * EXCLUDE (gross_weighted), {_mean("total_weighted_benefits")} AS avg_weighted_benefit,
 {_mean("gross_weighted")} AS avg_weighted_gross_income, {_rate("total_weighted_error_dollars", "payment_error_rate")},
 {_rate("weighted_overpayment_dollars", "overpayment_rate")}, {_rate("weighted_underpayment_dollars", "underpayment_rate")},
 {percent_sql("error_sample_cases", "total_sample_cases", 2)} AS case_error_rate FROM ({RATES}) AS state_sums"""

# Errors of counted cases by their codes, named afterwards: codes with one description meet.
_BY_CODES = """SELECT fiscal_year, state_name, element_code, error_finding, responsible_agency, count(*) AS findings,
 count(error_amount) AS known, sum(error_amount) AS dollars, sum(household_weight * error_amount) AS weighted
 FROM errors JOIN (SELECT case_id, fiscal_year, state_name, household_weight FROM households WHERE case_classification = 1) AS counted
 USING (case_id, fiscal_year) GROUP BY ALL"""
ROLLUP = f"""SELECT fiscal_year, state_name, element_code, {described("element_code", "ref_element")} AS element_description,
 {described("element_code", "ref_element", "category")} AS element_category,
 {described("error_finding", "ref_error_finding")} AS finding_type,
 {described("responsible_agency", "ref_agency_responsibility", "responsibility_type")} AS responsibility_type, findings, known, dollars, weighted
 FROM ({_BY_CODES}) AS by_codes WHERE element_code IN (SELECT code FROM ref_element)"""
ROLLUP = f"""SELECT * EXCLUDE (findings, known, dollars, weighted), CAST(sum(findings) AS BIGINT) AS sample_error_count,
 sum(weighted) AS weighted_error_dollars, CAST(sum(dollars) AS DOUBLE) / CAST(sum(known) AS BIGINT) AS avg_sample_error_amount
 FROM ({ROLLUP}) AS named GROUP BY ALL"""

# Persons by year, state and codes, named afterwards.
_PERSONS = f"""SELECT fiscal_year, state_name, {AGE_BAND} AS age_group, race_ethnicity, citizenship_status, years_education,
 {flag("working_indicator", "Working")} AS working_status, {flag("disability_indicator", "Disabled")} AS disability_status, household_weight
 FROM members JOIN (SELECT case_id, fiscal_year, state_name, household_weight FROM households) AS homes USING (case_id, fiscal_year)
 WHERE snap_affiliation_code BETWEEN 1 AND 2"""
PROFILE = f"""SELECT * EXCLUDE (persons, weight, years_education) REPLACE ({described("race_ethnicity", "ref_race_ethnicity")} AS race_ethnicity,
 {described("citizenship_status", "ref_citizenship_status")} AS citizenship_status), {described("years_education", "ref_education_level")} AS education_level,
 persons, weight FROM (SELECT * EXCLUDE (household_weight), count(*) AS persons, sum(household_weight) AS weight FROM ({_PERSONS}) AS each_person
 GROUP BY ALL) AS by_codes"""
PROFILE = f"""SELECT * EXCLUDE (persons, weight), CAST(sum(persons) AS BIGINT) AS sample_member_count, sum(weight) AS estimated_member_count
 FROM ({PROFILE}) AS named GROUP BY ALL"""
