"""Reference tables from code-lookup JSON, question/SQL pairs and document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators import classify

_METADATA_KEYS = ("description", "source_field")
_LOOKUPS = "code_lookups map<string, map<string, string>>"
_PAIRS = "example_queries array<struct<question: string, sql: string, explanation: string>>"


def lookup_rows(json: DataFrame, column: str = "value") -> DataFrame:
    """``(lookup, code, description)`` of lookup documents; metadata keys and non-integer codes are left out.

    Descriptions may be plain text or an object with ``name`` and ``abbr``.
    """
    parsed = json.select(F.from_json(column, _LOOKUPS).alias("doc"))
    lists = parsed.select(F.explode("doc.code_lookups").alias("lookup", "codes"))
    items = lists.select("lookup", F.explode("codes").alias("key", "text"))
    code = F.trim("key").try_cast("int")
    name = F.when(F.col("text").startswith("{"), F.get_json_object("text", "$.name"))
    return (
        items.filter(~F.col("key").isin(*_METADATA_KEYS) & code.isNotNull())
        .select(
            "lookup",
            code.alias("code"),
            F.coalesce(name, F.col("text")).alias("description"),
            F.when(F.col("text").startswith("{"), F.get_json_object("text", "$.abbr")).alias("abbreviation"),
        )
    )


def read_lookups(spark: SparkSession, path: str) -> DataFrame:
    """Lookup files, each one JSON document."""
    return lookup_rows(spark.read.text(path, wholetext=True))


def category_sets(json: DataFrame, lookup: str, column: str = "value") -> DataFrame:
    """``(category, codes, set_order)`` of a lookup that maps category names to code lists, in the document's order."""
    parsed = json.select(F.from_json(column, _LOOKUPS).alias("doc"))
    sets = parsed.select(F.posexplode(F.col("doc.code_lookups").getItem(lookup)).alias("set_order", "category", "text"))
    codes = F.from_json("text", "array<int>")
    return sets.select("category", codes.alias("codes"), "set_order").filter("codes IS NOT NULL")


def with_nature_category(codes: DataFrame) -> DataFrame:
    return codes.withColumn("category", classify.keyword_category(F.col("description")))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: Sequence[str] = ()) -> DataFrame:
    """Incoming rows replace existing rows of the same key; others stay.

    Of incoming rows that share a key the last by ``order``, columns of incoming, counts; without it the
    largest by the other columns. A null key matches no existing row.
    """
    rows = incoming.select(*existing.columns, *[c for c in order if c not in existing.columns])
    rank = F.struct(*[F.col(c) for c in (*order, *existing.columns)])
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*existing.columns), rank).alias("row")).select("row.*")
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(last)


def example_pairs(json: DataFrame, column: str = "value") -> DataFrame:
    """``(question, sql)`` of example documents; an explanation joins the question in brackets.

    Documents without examples, and examples without question or SQL, give no row.
    """
    parsed = json.select(F.from_json(column, _PAIRS).alias("doc"))
    pairs = parsed.select(F.explode("doc.example_queries").alias("pair")).select("pair.*")
    return pairs.filter((F.col("question") != "") & (F.col("sql") != "")).select(_full_question().alias("question"), "sql")


def _full_question() -> Column:
    has_note = F.coalesce(F.col("explanation"), F.lit("")) != ""
    return F.when(has_note, F.concat("question", F.lit(" ("), "explanation", F.lit(")"))).otherwise(F.col("question"))


def read_example_pairs(spark: SparkSession, path: str) -> DataFrame:
    return example_pairs(spark.read.text(path, wholetext=True))


MAX_DOCUMENT_BYTES = 10 * 1024 * 1024


def accepted_documents(documents: DataFrame, filename: str = "filename", text: str = "text") -> DataFrame:
    """Non-empty .md and .txt documents of at most 10 MB."""
    suffix = F.lower(F.regexp_extract(filename, r"(\.[^.]*)$", 1))
    small = F.octet_length(text) <= MAX_DOCUMENT_BYTES
    return documents.filter(suffix.isin(".md", ".txt") & small & F.col(text).rlike(r"(?U)\S"))


def rejected_documents(documents: DataFrame, filename: str = "filename", text: str = "text") -> DataFrame:
    """Documents that are not accepted, with the reason."""
    suffix = F.lower(F.regexp_extract(filename, r"(\.[^.]*)$", 1))
    reason = (
        F.when(~suffix.isin(".md", ".txt"), "Invalid file type. Allowed: .md, .txt")
        .when(F.octet_length(text) > MAX_DOCUMENT_BYTES, "File too large. Maximum: 10 MB")
        .when(F.col(text).isNull() | ~F.col(text).rlike(r"(?U)\S"), "File is empty")
    )
    return documents.withColumn("reason", reason).filter("reason IS NOT NULL")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Document files as ``(filename, text)``, accepted ones only."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(path, wholetext=True)
    named = files.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))
    return accepted_documents(named)
