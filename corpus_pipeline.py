"""The corpus pipeline: documents without toxic ones, repeated passages and near copies, mixed and packed.

Each stage works on all that the one before kept, gets it as ``docs`` and returns a frame, which is written
and read again. All but the last return the columns of documents. A stage that hands texts to Python holds the size of their batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import linededup, mixing, neardup, packing, toxicity
from casemill.llm.common import limit_batches, settled, table
from casemill.llm.queries import tokenizer_path

MOST_REPEAT = 1.5
CAPACITY, END_ID = 2048, 0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, as they are; null and empty texts are scored like any other."""
    limit_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(model.score(F.col("text")) < toxicity.THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines and the passages of 50 words or more that stand elsewhere before; ``n_chars`` follows the text.

    A document of which nothing is left goes; one that was null or empty before stays.
    """
    limit_batches(spark)
    cut = linededup.remove_repeats(docs, passages=True)
    spans = F.col(next(c for c in cut.columns if c not in docs.columns))
    left = cut.filter(spans.isNull() | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(spans.isNull(), F.col("n_chars")).otherwise(length))
    return left.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id; equal rows stay once.

    Documents without words, and rows without doc_id, are near nothing and stay.
    """
    limit_batches(spark)
    kept = neardup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("of_doc")).distinct()
    left = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["of_doc"]), "left_semi")
    return left.dropDuplicates(["doc_id", "text"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The flattest mix of sources that keeps every document and repeats none more than ``MOST_REPEAT`` epochs."""
    return mixing.mix(docs, most_repeat=MOST_REPEAT).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document in sequences of at most ``CAPACITY`` tokens."""
    limit_batches(spark)
    return packing.pack_documents(docs, tokenizer_path(), CAPACITY, END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

# The stages rest on a trained classifier, MinHash and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
