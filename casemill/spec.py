"""Fixed values of the quality-control data model: columns, types, codes, thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

# Source variable -> (column, Spark type), household level.
HOUSEHOLD_VARIABLES: dict[str, tuple[str, str]] = {
    "HHLDNO": ("case_id", "string"),
    "CASE": ("case_classification", "int"),
    "REGIONCD": ("region_code", "string"),
    "STATE": ("state_code", "string"),
    "STATENAME": ("state_name", "string"),
    "YRMONTH": ("year_month", "string"),
    "STATUS": ("status", "int"),
    "STRATUM": ("stratum", "string"),
    "RAWHSIZE": ("raw_household_size", "int"),
    "CERTHHSZ": ("certified_household_size", "int"),
    "FSUSIZE": ("snap_unit_size", "int"),
    "FSNONCIT": ("num_noncitizens", "int"),
    "FSDIS": ("num_disabled", "int"),
    "FSELDER": ("num_elderly", "int"),
    "FSKID": ("num_children", "int"),
    "COMPOSITION": ("composition_code", "string"),
    "RAWGROSS": ("gross_income", "decimal(12,2)"),
    "RAWNET": ("net_income", "decimal(12,2)"),
    "RAWERND": ("earned_income", "decimal(12,2)"),
    "FSUNEARN": ("unearned_income", "decimal(12,2)"),
    "LIQRESOR": ("liquid_resources", "decimal(12,2)"),
    "REALPROP": ("real_property", "decimal(12,2)"),
    "FSVEHAST": ("vehicle_assets", "decimal(12,2)"),
    "FSASSET": ("total_assets", "decimal(12,2)"),
    "FSSTDDED": ("standard_deduction", "decimal(10,2)"),
    "FSERNDED": ("earned_income_deduction", "decimal(10,2)"),
    "FSDEPDED": ("dependent_care_deduction", "decimal(10,2)"),
    "FSMEDDED": ("medical_deduction", "decimal(10,2)"),
    "SHELDED": ("shelter_deduction", "decimal(10,2)"),
    "FSTOTDED": ("total_deductions", "decimal(10,2)"),
    "RENT": ("rent", "decimal(10,2)"),
    "UTIL": ("utilities", "decimal(10,2)"),
    "FSCSEXP": ("shelter_expense", "decimal(10,2)"),
    "HOMELESS_DED": ("homeless_deduction", "decimal(10,2)"),
    "FSBEN": ("snap_benefit", "decimal(10,2)"),
    "RAWBEN": ("raw_benefit", "decimal(10,2)"),
    "BENMAX": ("maximum_benefit", "decimal(10,2)"),
    "MINIMUM_BEN": ("minimum_benefit", "decimal(10,2)"),
    "CAT_ELIG": ("categorical_eligibility", "int"),
    "EXPEDSER": ("expedited_service", "int"),
    "CERTMTH": ("certification_month", "string"),
    "LASTCERT": ("last_certification_date", "int"),
    "TPOV": ("poverty_level", "decimal(10,2)"),
    "WRK_POOR": ("working_poor_indicator", "boolean"),
    "TANF_IND": ("tanf_indicator", "boolean"),
    "AMTERR": ("amount_error", "decimal(10,2)"),
    "FSGRTEST": ("gross_test_result", "int"),
    "FSNETEST": ("net_test_result", "int"),
    "HWGT": ("household_weight", "decimal(18,8)"),
    "FYWGT": ("fiscal_year_weight", "decimal(18,8)"),
}

# Person level, repeated with suffix 1..17.
PERSON_VARIABLES: dict[str, tuple[str, str]] = {
    "FSAFIL": ("snap_affiliation_code", "int"),
    "AGE": ("age", "int"),
    "SEX": ("sex", "int"),
    "RACETH": ("race_ethnicity", "int"),
    "REL": ("relationship_to_head", "int"),
    "CTZN": ("citizenship_status", "int"),
    "YRSED": ("years_education", "int"),
    "DIS": ("disability_indicator", "int"),
    "FOSTER": ("foster_child_indicator", "int"),
    "WRKREG": ("work_registration_status", "int"),
    "ABWDST": ("abawd_status", "int"),
    "WORK": ("working_indicator", "int"),
    "EMPRG": ("employment_region", "int"),
    "EMPSTA": ("employment_status_a", "int"),
    "EMPSTB": ("employment_status_b", "int"),
    "WAGES": ("wages", "decimal(10,2)"),
    "SLFEMP": ("self_employment_income", "decimal(10,2)"),
    "EITC": ("earned_income_tax_credit", "decimal(10,2)"),
    "OTHERN": ("other_earned_income", "decimal(10,2)"),
    "SOCSEC": ("social_security", "decimal(10,2)"),
    "SSI": ("ssi", "decimal(10,2)"),
    "VET": ("veterans_benefits", "decimal(10,2)"),
    "UNEMP": ("unemployment", "decimal(10,2)"),
    "WCOMP": ("workers_compensation", "decimal(10,2)"),
    "TANF": ("tanf", "decimal(10,2)"),
    "CSUPRT": ("child_support", "decimal(10,2)"),
    "GA": ("general_assistance", "decimal(10,2)"),
    "EDLOAN": ("education_loans", "decimal(10,2)"),
    "OTHGOV": ("other_government_income", "decimal(10,2)"),
    "CONT": ("contributions", "decimal(10,2)"),
    "DEEM": ("deemed_income", "decimal(10,2)"),
    "OTHUN": ("other_unearned_income", "decimal(10,2)"),
    "DPCOST": ("dependent_care_cost", "decimal(10,2)"),
    "ENERGY": ("energy_assistance", "decimal(10,2)"),
    "WGESUP": ("wage_supplement", "decimal(10,2)"),
    "DIVER": ("diversion_payment", "decimal(10,2)"),
}

# Error level, repeated with suffix 1..9.
ERROR_VARIABLES: dict[str, tuple[str, str]] = {
    "ELEMENT": ("element_code", "int"),
    "NATURE": ("nature_code", "int"),
    "AGENCY": ("responsible_agency", "int"),
    "AMOUNT": ("error_amount", "decimal(10,2)"),
    "DISCOV": ("discovery_method", "int"),
    "VERIF": ("verification_status", "int"),
    "OCCDATE": ("occurrence_date", "int"),
    "TIMEPER": ("time_period", "string"),
    "E_FINDG": ("error_finding", "int"),
}

MEMBER_SLOTS = 17
ERROR_SLOTS = 9
REQUIRED_SOURCE_COLUMNS = ("HHLDNO", "STATE", "YRMONTH", "FSBEN")
NULL_TOKENS = ("", "NA", "N/A", "NULL")

# Dollar threshold by fiscal year and the default for other years.
TOLERANCE_THRESHOLDS = {2021: 39, 2022: 48, 2023: 54}
DEFAULT_THRESHOLD = 54

# Income sources reported by the income statistics, in report order.
INCOME_SOURCES = ("wages", "social_security", "ssi", "unemployment", "tanf", "child_support")

# Member income fields that must not be negative.
NON_NEGATIVE_MEMBER_FIELDS = (
    "wages",
    "self_employment_income",
    "social_security",
    "ssi",
    "tanf",
    "unemployment",
    "child_support",
    "veterans_benefits",
)

# Closed benefit ranges of the histogram; None leaves the top open.
BENEFIT_RANGES = ((0, 100), (101, 200), (201, 500), (501, 1000), (1001, 2000), (2001, None))

# Keyword rules for nature categories; the first match wins.
NATURE_KEYWORDS = (
    ("income", ("income", "earnings")),
    ("composition", ("person", "member", "noncitizen")),
    ("deduction", ("deduction",)),
    ("resources", ("resource",)),
    ("computation", ("computation", "transcription", "rounding")),
    ("reporting", ("reporting", "budgeting")),
    ("benefits", ("benefit", "allotment", "prorat")),
)

# Element categories by code range and responsibility types by code,
# as described in the published notes on the code lists.
ELEMENT_CATEGORY_RANGES = (
    ("eligibility", 111, 170),
    ("assets", 211, 225),
    ("earned_income", 311, 314),
    ("deductions", 321, 323),
    ("unearned_income", 331, 350),
    ("deductions", 361, 366),
    ("income_totals", 371, 372),
    ("computation", 520, 560),
)
RESPONSIBILITY_RANGES = (("client", 1, 4), ("client", 7, 8), ("agency", 10, 10), ("agency", 12, 12), ("agency", 14, 21), ("other", 99, 99))

# Columns and lookups of the described exports.
HOUSEHOLD_EXPORT = (
    "case_id", "fiscal_year", "state_code", "state_name", "year_month", "status", "snap_benefit", "raw_benefit",
    "amount_error", "gross_income", "net_income", "earned_income", "unearned_income", "certified_household_size",
    "num_elderly", "num_children", "num_disabled", "categorical_eligibility", "expedited_service",
    "working_poor_indicator", "tanf_indicator",
)
MEMBER_EXPORT = (
    "case_id", "fiscal_year", "state_name", "member_number", "age", "sex", "race_ethnicity", "relationship_to_head",
    "citizenship_status", "snap_affiliation_code", "disability_indicator", "work_registration_status", "abawd_status",
    "working_indicator", "employment_status_a", "employment_status_b", "wages", "self_employment_income",
    "social_security", "ssi", "unemployment", "tanf", "child_support", "total_income",
)
ERROR_EXPORT = (
    "case_id", "fiscal_year", "state_name", "error_number", "element_code", "nature_code", "responsible_agency",
    "error_amount", "discovery_method", "verification_status", "occurrence_date", "time_period", "error_finding",
)

# Coded column -> reference table.
CODE_COLUMNS = {
    "case_classification": "ref_case_classification",
    "status": "ref_status",
    "categorical_eligibility": "ref_categorical_eligibility",
    "expedited_service": "ref_expedited_service",
    "sex": "ref_sex",
    "race_ethnicity": "ref_race_ethnicity",
    "relationship_to_head": "ref_relationship",
    "citizenship_status": "ref_citizenship_status",
    "years_education": "ref_education_level",
    "snap_affiliation_code": "ref_snap_affiliation",
    "disability_indicator": "ref_disability",
    "work_registration_status": "ref_work_registration",
    "abawd_status": "ref_abawd_status",
    "working_indicator": "ref_working_indicator",
    "employment_status_a": "ref_employment_status_type",
    "employment_status_b": "ref_employment_status_type",
    "element_code": "ref_element",
    "nature_code": "ref_nature",
    "responsible_agency": "ref_agency_responsibility",
    "discovery_method": "ref_discovery",
    "error_finding": "ref_error_finding",
}

# The reference tables and, where present, their extra column.
REFERENCE_TABLES = (
    "ref_status", "ref_element", "ref_nature", "ref_agency_responsibility", "ref_error_finding",
    "ref_categorical_eligibility", "ref_expedited_service", "ref_sex", "ref_snap_affiliation", "ref_discovery",
    "ref_state", "ref_case_classification", "ref_abawd_status", "ref_citizenship_status", "ref_race_ethnicity",
    "ref_relationship", "ref_work_registration", "ref_education_level", "ref_employment_status_type",
    "ref_disability", "ref_working_indicator", "ref_homelessness", "ref_reporting_system", "ref_action_type",
    "ref_allotment_adjustment",
)
REFERENCE_EXTRA = {"ref_element": "category", "ref_nature": "category", "ref_agency_responsibility": "responsibility_type"}

# Keywords of the two statement checks.
BLOCKED_WORDS = (
    "DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "CREATE", "TRUNCATE", "REPLACE", "GRANT", "REVOKE", "EXEC",
    "EXECUTE", "CALL", "PROCEDURE", "INTO OUTFILE", "INTO DUMPFILE", "LOAD_FILE",
)
BLOCKED_SUBSTRINGS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "REPLACE", "MERGE", "GRANT", "REVOKE",
    "EXEC", "EXECUTE",
)

DEFAULT_ROW_CAP = 50_000
LISTING_ROW_CAP = 100


@dataclass(frozen=True)
class DatasetSpec:
    """Names the operators need; the default describes the quality-control schema."""

    parent: str = "households"
    children: tuple[str, ...] = ("household_members", "qc_errors")
    key: tuple[str, ...] = ("case_id", "fiscal_year")
    child_keys: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "households": ("case_id", "fiscal_year"),
            "household_members": ("case_id", "fiscal_year", "member_number"),
            "qc_errors": ("case_id", "fiscal_year", "error_number"),
        }
    )
    state_column: str = "state_name"
    year_column: str = "fiscal_year"
    code_columns: dict[str, str] = field(default_factory=lambda: dict(CODE_COLUMNS))


QC_DATASET = DatasetSpec()
