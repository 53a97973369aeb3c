"""The quality-control tables derived from the given benchmark tables.

Every rule is SQL text that Spark and DuckDB both read, so queries and their checks
share one definition of the input. Each derived table is a projection of one given
table (plus a lookup of ``nation``): no join is spent on the fixture, and the plans
measured are those of the operators. The fiscal year is a function of the order key,
so children find their parents, except one in 97 parts whose year is shifted on
purpose to leave orphans.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill import spec
from casemill.codes import CODE_LISTS
from casemill.operators import enrich

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Codes of lists that are not published; literals of this fixture only.
FIXTURE_LISTS: dict[str, dict[int, str]] = {
    "ref_race_ethnicity": {1: "Group one", 2: "Group two", 3: "Group three", 4: "Group three"},
    "ref_citizenship_status": {1: "Born citizen", 2: "Naturalized citizen", 3: "Noncitizen"},
    "ref_education_level": {0: "None", 8: "Grade 8", 12: "Grade 12"},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in TABLES}


def _cents(expression: str, precision: int = 10) -> str:
    return f"CAST(CAST({expression} AS DECIMAL(12,0)) * 0.01 AS DECIMAL({precision},2))"


def _pick(values: list[int], index: str) -> str:
    """Item of a literal list; ``{pick}`` is the engine's list access."""
    return f"{{pick}}({{list}}{', '.join(map(str, values))}{{end}}, CAST({index} AS INT))"


def _dialect(text: str, engine: str) -> str:
    marks = ("element_at", "array(", ")") if engine == "spark" else ("list_extract", "[", "]")
    return text.replace("{pick}", marks[0]).replace("{list}", marks[1]).replace("{end}", marks[2])


_INCOME = "(o_custkey * 7919 + o_orderkey * 31)"

HOUSEHOLD_RULES: dict[str, str] = {
    "case_id": "CAST(o_orderkey AS STRING)",
    "fiscal_year": "CAST(2017 + o_orderkey % 7 AS INT)",
    "case_classification": "CASE WHEN o_orderkey % 20 = 0 THEN 2 WHEN o_orderkey % 33 = 0 THEN 3 ELSE 1 END",
    "region_code": "CAST(n_regionkey AS STRING)",
    "state_code": "CAST(o_custkey % 25 AS STRING)",
    "state_name": "translate(n_name, '_0123456789', '-abcdefghij')",
    "year_month": "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING)",
    "status": "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END",
    "stratum": "CAST(1 + o_orderkey % 4 AS STRING)",
    "certified_household_size": "CAST(CASE WHEN o_orderkey % 601 = 0 THEN 0 WHEN o_orderkey % 503 = 0 THEN 22"
    " WHEN o_orderkey % 709 = 0 THEN NULL WHEN o_orderkey % 811 = 0 THEN -1 ELSE 1 + o_orderkey % 6 END AS INT)",
    "num_noncitizens": "CAST(CASE WHEN o_custkey % 11 = 0 THEN 1 ELSE 0 END AS INT)",
    "num_disabled": "CAST(CASE WHEN o_custkey % 9 = 0 THEN 1 ELSE 0 END AS INT)",
    "num_elderly": "CAST(CASE WHEN o_custkey % 4 = 0 THEN 1 + o_orderkey % 6 WHEN o_custkey % 10 = 1 THEN 1 ELSE 0 END AS INT)",
    "num_children": "CAST(CASE WHEN o_custkey % 3 = 0 THEN 1 + o_custkey % 4 ELSE 0 END AS INT)",
    "gross_income": _cents(
        f"CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 0 ELSE {_INCOME} % 450000 END", 12
    ),
    "net_income": _cents(f"CASE WHEN o_orderkey % 211 = 0 THEN 460000 ELSE ({_INCOME} % 450000) - 50000 END", 12),
    "earned_income": _cents("CASE WHEN o_orderkey % 997 = 0 THEN -700 WHEN o_orderkey % 3 = 0 THEN 0"
                            " ELSE 1 + (o_custkey * 7919) % 200000 END", 12),
    "unearned_income": _cents("CASE WHEN o_orderkey % 4 = 1 THEN 0 ELSE 1 + (o_orderkey * 31) % 90000 END", 12),
    "total_deductions": _cents("(o_orderkey * 17) % 60000"),
    "snap_benefit": _cents("CASE WHEN o_orderkey % 887 = 0 THEN -1250 WHEN o_orderkey % 13 = 0 THEN NULL"
                           " ELSE CAST(round(o_totalprice * 100) AS BIGINT) % 260000 END"),
    "raw_benefit": _cents("(CAST(round(o_totalprice * 100) AS BIGINT) + 1700) % 260000"),
    "categorical_eligibility": "CAST(o_orderkey % 4 AS INT)",
    "expedited_service": "CAST(CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 1 + o_custkey % 3 END AS INT)",
    "poverty_level": _cents("(o_orderkey * 7) % 30000"),
    "working_poor_indicator": "(o_custkey % 8 = 0)",
    "tanf_indicator": "(o_custkey % 14 = 0)",
    "amount_error": _cents("CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderkey % 19 = 0 THEN 0 - (o_orderkey * 13) % 12000"
                           " ELSE (o_orderkey * 13) % 12000 END"),
    "household_weight": "CAST(CAST(100 + o_custkey % 700 AS DECIMAL(10,0)) * 0.25 AS DECIMAL(18,8))",
    "fiscal_year_weight": "CAST(CAST(100 + o_custkey % 700 AS DECIMAL(10,0)) * 1.5 AS DECIMAL(18,8))",
}

_CHILD_KEY = {
    "case_id": "CAST(l_orderkey AS STRING)",
    "fiscal_year": "CAST(2017 + l_orderkey % 7 + CASE WHEN l_partkey % 97 = 0 THEN 1 ELSE 0 END AS INT)",
}

_MEMBER_MONEY = [name for name, kind in spec.PERSON_VARIABLES.values() if kind.startswith("decimal")]

MEMBER_RULES: dict[str, str] = {
    **_CHILD_KEY,
    "member_number": "l_linenumber",
    "age": "CAST(CASE WHEN l_partkey % 211 = 0 THEN 90 + l_linenumber * 6 WHEN l_partkey % 401 = 0 THEN NULL"
    " ELSE l_quantity + l_linenumber * 7 - 6 END AS INT)",
    "sex": "CAST(1 + l_suppkey % 4 AS INT)",
    "race_ethnicity": "CAST(1 + l_suppkey % 5 AS INT)",
    "relationship_to_head": "l_linenumber",
    "citizenship_status": "CAST(1 + l_partkey % 4 AS INT)",
    "years_education": "CAST((l_linenumber % 4) * 4 AS INT)",
    "snap_affiliation_code": _pick([1, 1, 2, 4, 19, 12], "1 + l_suppkey % 6"),
    "disability_indicator": "CAST(CASE WHEN l_suppkey % 13 = 0 THEN NULL WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS INT)",
    "work_registration_status": "CAST(l_partkey % 5 AS INT)",
    "abawd_status": "CAST(1 + l_partkey % 3 AS INT)",
    "working_indicator": "CAST(CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE l_partkey % 2 END AS INT)",
    "employment_status_a": "CAST(l_suppkey % 4 AS INT)",
    "employment_status_b": "CAST(l_suppkey % 3 AS INT)",
    **{
        name: _cents(
            f"CASE WHEN (l_partkey + {i}) % 977 = 0 THEN -{100 + i} WHEN (l_suppkey + {i}) % 4 = 0"
            f" THEN 1 + (l_partkey * {i + 3} + l_orderkey) % 80000 ELSE 0 END"
        )
        for i, name in enumerate(_MEMBER_MONEY)
    },
}

_ELEMENTS = [*CODE_LISTS["ref_element"], 999, 888]
_NATURES = [*CODE_LISTS["ref_nature"], 5]
_AGENCIES = [*CODE_LISTS["ref_agency_responsibility"], 22]

ERROR_RULES: dict[str, str] = {
    **_CHILD_KEY,
    "error_number": "l_linenumber",
    "element_code": _pick(_ELEMENTS, f"1 + l_partkey % {len(_ELEMENTS)}"),
    "nature_code": _pick(_NATURES, f"1 + l_suppkey % {len(_NATURES)}"),
    "responsible_agency": _pick(_AGENCIES, f"1 + (l_partkey + l_suppkey) % {len(_AGENCIES)}"),
    "error_amount": _cents("CASE WHEN l_partkey % 499 = 0 THEN -500 WHEN l_partkey % 733 = 0 THEN 10000100"
                           " ELSE CAST(round(l_extendedprice * 100) AS BIGINT) % 90000 END"),
    "discovery_method": "CAST(1 + l_suppkey % 10 AS INT)",
    "verification_status": "CAST(l_partkey % 6 AS INT)",
    "occurrence_date": "CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS INT)",
    "time_period": "CAST(1 + l_partkey % 4 AS STRING)",
    "error_finding": "CASE WHEN l_linestatus = 'F' THEN 2 WHEN l_partkey % 7 = 0 THEN 4 WHEN l_partkey % 11 = 0 THEN 1 ELSE 3 END",
}


# Wide survey rows of an order. ``{n}`` is the slot number; NULL, empty and "NA" gates and
# unparseable amounts are spread over the slots.
WIDE_PERSON_RULES: dict[str, str] = {
    "FSAFIL": "CASE WHEN {n} > 1 + o_orderkey % 17 THEN CASE o_orderkey % 3 WHEN 0 THEN 'NA' WHEN 1 THEN '' END"
    " WHEN (o_orderkey + {n}) % 5 = 0 THEN NULL ELSE CAST(1 + (o_orderkey + {n}) % 4 AS STRING) END",
    "AGE": "CASE WHEN (o_orderkey + {n}) % 31 = 0 THEN 'N/A' ELSE CAST((o_orderkey * 7 + {n} * 13) % 100 AS STRING) END",
    "SEX": "CAST(1 + (o_custkey + {n}) % 2 AS STRING) || '.0'",
    "WAGES": "CASE WHEN (o_orderkey + {n}) % 4 = 0 THEN 'NULL' WHEN (o_orderkey + {n}) % 7 = 0 THEN 'abc'"
    " ELSE CAST((o_orderkey * {n}) % 5000 AS STRING) || '.50' END",
    "SSI": "CAST((o_custkey * {n}) % 900 AS STRING)",
}
WIDE_ERROR_RULES: dict[str, str] = {
    "ELEMENT": "CASE WHEN {n} <= o_orderkey % 10 AND (o_orderkey + {n}) % 4 <> 0"
    " THEN CAST(311 + (o_orderkey + {n}) % 60 AS STRING) END",
    "NATURE": "CAST(6 + (o_custkey + {n}) % 40 AS STRING)",
    "AGENCY": "CAST(1 + (o_orderkey + {n}) % 21 AS STRING)",
    "AMOUNT": "CASE WHEN (o_custkey + {n}) % 9 = 0 THEN '' ELSE CAST((o_orderkey * {n}) % 700 AS STRING) || '.25' END",
    "E_FINDG": "CAST(2 + (o_orderkey + {n}) % 3 AS STRING)",
}

# The variables without a rule of their own: whole numbers, or amounts where the type is one.
_REMAINDERS: dict[str, tuple[str, int, str]] = {}  # rule -> its number, the divisor, what follows the remainder
for _rules, _variables in ((WIDE_PERSON_RULES, spec.PERSON_VARIABLES), (WIDE_ERROR_RULES, spec.ERROR_VARIABLES)):
    for _i, (_source, (_, _kind)) in enumerate(_variables.items()):
        _cents_part = " || '.75'" if _kind.startswith("decimal") else ""
        _rule = f"CAST((o_custkey * {{n}} + o_orderkey + {_i}) % {_i % 7 + 3} AS STRING){_cents_part}"
        if _rules.setdefault(_source, _rule) == _rule:
            _REMAINDERS[_rule] = f"(o_custkey * {{n}} + o_orderkey + {_i})", _i % 7 + 3, ".75" if _cents_part else ""


def _spark_rule(rule: str) -> str:
    """A slot rule for Spark. The few texts of a remainder are picked from a list, which is cheaper than writing numbers."""
    if rule not in _REMAINDERS:
        return rule
    number, divisor, ending = _REMAINDERS[rule]
    texts = ", ".join(f"'{value}{ending}'" for value in range(1 - divisor, divisor))
    return f"get(array({texts}), CAST({number} % {divisor} AS INT) + {divisor - 1})"


def wide_columns() -> list[str]:
    """Select list of the wide survey frame over orders and nation."""
    out = []
    for source, (target, kind) in spec.HOUSEHOLD_VARIABLES.items():
        if target in HOUSEHOLD_RULES:
            rule = _dialect(HOUSEHOLD_RULES[target], "spark")
            rule = f"CAST({rule} AS int)" if kind == "boolean" else rule
            out.append(f"CAST({rule} AS STRING) AS {source}")
    for rules, slots in ((WIDE_PERSON_RULES, spec.MEMBER_SLOTS), (WIDE_ERROR_RULES, spec.ERROR_SLOTS)):
        for n in range(1, slots + 1):
            out += [f"{_spark_rule(rule).replace('{n}', str(n))} AS {source}{n}" for source, rule in rules.items()]
    return out


def _wide_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders that become wide rows, with the fiscal year in ``source_year``."""
    nation = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS _state", "n_name", "n_regionkey")
    orders = table(spark, sf_dir, "orders").selectExpr("*", "o_custkey % 25 AS _state").join(nation, "_state", "left")
    return orders.selectExpr("*", "CAST(2017 + o_orderkey % 7 AS INT) AS source_year")


# Wide rows a task writes, some 40 MB compressed; a file is read by one task as well.
_ROWS_A_TASK = 60_000


def _spread(rows: DataFrame) -> DataFrame:
    """Orders by ranges of their years, in as many parts as it takes to write them as wide rows.

    A wide row takes a hundred times the work of the order it is made from, so the few parts that orders are read in are too few.
    A part has few years, so a write by year makes little more than a file a part.
    """
    parts = max(-(-rows.count() // _ROWS_A_TASK), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartitionByRange(parts, "source_year", "o_orderkey", "o_custkey")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide survey rows with the fiscal year in ``source_year``."""
    return _wide_orders(spark, sf_dir).selectExpr(*wide_columns(), "source_year")


# Hundreds of columns repeat, and the least effort of gzip finds most of that.
_CSV = {"header": True, "escape": '"', "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def write_wide_csv(spark: SparkSession, sf_dir: str, path: str, condition: str = "true", columns=lambda df: df) -> None:
    """The wide rows of some orders as one CSV dataset; ``columns`` may change the frame without its years before."""
    rows = _spread(_wide_orders(spark, sf_dir).filter(condition)).selectExpr(*wide_columns())
    columns(rows).write.options(**_CSV).csv(path)


def write_wide_files(spark: SparkSession, sf_dir: str, folder: str, condition: str = "true") -> None:
    """The wide rows as one CSV dataset per fiscal year, named after the year.

    The orders are sorted by file before they become wide, so the write need not sort wide rows. A wide row is made into
    its line in one expression and written as one column, named by the header: each step that takes hundreds of columns would copy them.
    """
    rows = _spread(_wide_orders(spark, sf_dir).filter(condition))
    named = rows.withColumn("file", F.concat(F.lit("qc_pub_fy"), F.col("source_year").cast("string"), F.lit(".csv")))
    values, names = zip(*(column.rsplit(" AS ", 1) for column in wide_columns()), strict=True)
    fields = ", ".join(f"'{name}', {value}" for name, value in zip(names, values, strict=True))
    # A line is never NULL. The lambda holds off whole-stage code, whose one method for all columns would be too large to compile.
    line = f"coalesce(to_csv(named_struct({fields}), map('escape', '\"')), transform(array(file), x -> x)[0])"
    sorted_lines = named.sortWithinPartitions("file").selectExpr(f"{line} AS `{','.join(names)}`", "file")
    # Lines stay as they are: the separator is made up just now, so none holds it, and there are no quotes.
    sorted_lines.write.partitionBy("file").options(**_CSV | {"quote": "", "sep": uuid.uuid4().hex}).csv(folder)


def duck_slots(rules: dict[str, str], slots: int) -> str:
    """DuckDB form of the wide rows, one per order and slot, text columns named by source variable."""
    columns = ", ".join(f"{rule.replace('{n}', 's.n')} AS {source}" for source, rule in rules.items())
    return (
        f"SELECT CAST(o_orderkey AS STRING) AS case_id, CAST(2017 + o_orderkey % 7 AS INT) AS fiscal_year,"
        f" CAST(s.n AS INT) AS n, {columns} FROM orders, range(1, {slots + 1}) AS s(n)"
    )


def _select(rules: dict[str, str], engine: str) -> list[str]:
    return [f"{_dialect(expression, engine)} AS {name}" for name, expression in rules.items()]


def _by_year(rows: DataFrame, rules: dict[str, str], key: list[str], unique: bool) -> DataFrame:
    """The narrow rows of a table as its wide ones, in the order of their years within a partition.

    Sorted before they become wide, rows are written by year without a sort of wide rows. ``unique`` keeps one row
    of each key, chosen among the narrow rows as well, so that no wide row is shuffled.
    """
    named = rows.selectExpr("*", *[f"{_dialect(rules[name], 'spark')} AS {name}" for name in key])
    kept = named.dropDuplicates(key) if unique else named
    others = [f"{name}" if name in key else f"{_dialect(rule, 'spark')} AS {name}" for name, rule in rules.items()]
    return kept.sortWithinPartitions("fiscal_year").selectExpr(*others)


def households(spark: SparkSession, sf_dir: str, unique: bool = False) -> DataFrame:
    nation = table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS _state", "n_name", "n_regionkey")
    orders = table(spark, sf_dir, "orders").selectExpr("*", "o_custkey % 25 AS _state").join(nation, "_state", "left")
    return _by_year(orders, HOUSEHOLD_RULES, enrich.KEY, True) if unique else orders.selectExpr(*_select(HOUSEHOLD_RULES, "spark"))


def members(spark: SparkSession, sf_dir: str, unique: bool = False) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return _by_year(lines, MEMBER_RULES, [*enrich.KEY, "member_number"], True) if unique else lines.selectExpr(*_select(MEMBER_RULES, "spark"))


def errors(spark: SparkSession, sf_dir: str, unique: bool = False) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return _by_year(lines, ERROR_RULES, [*enrich.KEY, "error_number"], True) if unique else lines.selectExpr(*_select(ERROR_RULES, "spark"))


def refs(spark: SparkSession) -> dict[str, DataFrame]:
    return enrich.reference_tables(spark, FIXTURE_LISTS)


def _duck_refs() -> dict[str, str]:
    out = {"thresholds": "SELECT * FROM (VALUES " + ", ".join(
        f"({year}, CAST({amount} AS DECIMAL(10,2)))" for year, amount in spec.TOLERANCE_THRESHOLDS.items()
    ) + ") AS t(fiscal_year, threshold_amount)"}
    for name in spec.REFERENCE_TABLES:
        codes = {**CODE_LISTS, **FIXTURE_LISTS}.get(name, {})
        rows = ", ".join("({}, '{}')".format(code, text.replace("'", "''")) for code, text in codes.items())
        if not codes:
            out[name] = "SELECT CAST(NULL AS INT) AS code, CAST(NULL AS VARCHAR) AS description WHERE false"
            continue
        base = f"SELECT * FROM (VALUES {rows}) AS t(code, description)"
        if name == "ref_element":
            base = _duck_ranges(base, spec.ELEMENT_CATEGORY_RANGES, "category")
        elif name == "ref_agency_responsibility":
            base = _duck_ranges(base, spec.RESPONSIBILITY_RANGES, "responsibility_type")
        elif name == "ref_nature":
            base = f"SELECT code, description, {duck_keyword_case('description')} AS category FROM ({base})"
        out[name] = base
    return out


def duck_keyword_case(column: str) -> str:
    whens = []
    for category, words in spec.NATURE_KEYWORDS:
        test = " OR ".join(f"contains(lower({column}), '{word}')" for word in words)
        whens.append(f"WHEN {test} THEN '{category}'")
    return f"CASE {' '.join(whens)} END"


def _duck_ranges(base: str, ranges: tuple, out: str) -> str:
    whens = " ".join(f"WHEN code BETWEEN {low} AND {high} THEN '{name}'" for name, low, high in ranges)
    return f"SELECT code, description, CASE {whens} END AS {out} FROM ({base})"


def duck_tables() -> dict[str, str]:
    """DuckDB definition of every derived table."""
    return {
        "households": "SELECT " + ", ".join(_select(HOUSEHOLD_RULES, "duckdb"))
        + " FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 25",
        "members": "SELECT " + ", ".join(_select(MEMBER_RULES, "duckdb")) + " FROM lineitem",
        "errors": "SELECT " + ", ".join(_select(ERROR_RULES, "duckdb")) + " FROM lineitem",
        **_duck_refs(),
    }


def with_tables(sql: str) -> str:
    """Prefix a check with the derived tables it names."""
    defined = duck_tables()
    words = set(sql.replace(",", " ").replace("(", " ").replace(")", " ").split())
    needed = [name for name in defined if name in words]
    if not needed:
        return sql
    body = ", ".join(f"{name} AS ({defined[name]})" for name in needed)
    text = sql.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {body}, {text[5:]}"
    return f"WITH {body} {text}"
