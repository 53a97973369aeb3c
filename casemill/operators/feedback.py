"""Example store of question/SQL pairs driven by feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions.identity import content_id, pair_id
from casemill.functions.chunking import chunks_of
from casemill.sources.lookups import upsert


def with_pair_id(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("pair_id", pair_id(F.col("question"), F.col("sql")))


def latest_feedback(feedback: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Last value per pair; a map-side maximum, so a pair with very many votes stays small."""
    last = F.max_by("value", F.struct(*order)).alias("value")
    when = F.max(F.struct(*order)).alias("_when")
    out = feedback.groupBy("question", "sql").agg(last, when)
    return out.select("question", "sql", "value", "_when.*")


def apply_feedback(store: DataFrame, feedback: DataFrame) -> DataFrame:
    """Pairs after feedback: last value 1 adds or keeps, 0 removes, repeats change nothing."""
    latest = with_pair_id(latest_feedback(feedback)).select("pair_id", "question", "sql", "value")
    kept = store.select("pair_id", "question", "sql").join(latest.select("pair_id"), "pair_id", "left_anti")
    return kept.unionByName(latest.filter("value = 1").drop("value"))


def store_statistics(store: DataFrame) -> DataFrame:
    """Entries per type."""
    return store.groupBy("training_type").agg(F.count(F.lit(1)).alias("entries"))


def rebuild_store(
    documents: DataFrame, pairs: DataFrame, ddl: DataFrame | None = None, size: int = 500, overlap: int = 50
) -> DataFrame:
    """The whole store from its sources: chunked documents, pairs and table definitions, one row per id."""
    pieces = chunks_of(F.col("text"), F.col("filename"), size, overlap)
    chunks = documents.select(F.explode(pieces).alias("content"))
    parts = [
        _typed(chunks, "documentation", "doc"),
        with_pair_id(pairs).select(
            F.col("pair_id").alias("id"), F.lit("sql").alias("training_type"), "question", F.col("sql").alias("content")
        ),
    ]
    if ddl is not None:
        parts.append(_typed(ddl.select("content"), "ddl", "ddl"))
    store = parts[0]
    for part in parts[1:]:
        store = store.unionByName(part)
    # Equal contents share an id, so any of their rows is the same row.
    return store.dropDuplicates(["id"])


def _typed(contents: DataFrame, kind: str, suffix: str) -> DataFrame:
    return contents.select(
        content_id(F.col("content"), suffix).alias("id"),
        F.lit(kind).alias("training_type"),
        F.lit(None).cast("string").alias("question"),
        "content",
    )


def merge_store(store: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(store, incoming, ["id"])
