"""Registered queries of the subpackage, and SQL checks where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import ans, bpe, chat, divergence, fingerprints, linededup, mixing, negatives, neardup, packing, topk, toxicity, warc
from casemill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return register


def rank_file() -> tuple[str, str]:
    """The public rank file that op12 uses, or ``CASEMILL_RANKS``, and the pattern that splits texts for it."""
    import public_tokenizers

    return os.environ.get("CASEMILL_RANKS") or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def tokenizer_path() -> str:
    """The public vocabulary file the token queries use; ``CASEMILL_TOKENIZER`` names another place."""
    if "CASEMILL_TOKENIZER" in os.environ:
        return os.environ["CASEMILL_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_warc_archive")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op3_role_repair")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 2048, 0)


@query("op5_minhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


TOP_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@query("op6_exact_top_k", TOP_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_source_mix")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattest mix that leaves no document out and repeats none more than twice."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), most_repeat=2.0)
    return mixed.select("doc_id", "source", "copy", "mix_block", "mix_order", "mix_tokens")


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ans.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), 1)


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without repeated chunks, with the chunks and characters that went; ``rest`` is the
    text without repeated passages of 50 words and more as well, ``rest_chars`` what went from it."""
    out, lines, passages, every = linededup.with_repeats(table(spark, sf_dir, "documents"))

    def chars(spans):
        return F.coalesce(F.expr(f"aggregate({spans}, 0L, (n, s) -> n + s.stop - s.start)"), F.lit(0))

    return out.select(
        "doc_id", F.coalesce(F.size(lines), F.lit(0)).alias("removed_chunks"), chars(lines).alias("removed_chars"),
        linededup.without(F.col("text"), F.col(lines)).alias("text"), F.coalesce(F.size(passages), F.lit(0)).alias("removed_passages"),
        chars(every).alias("rest_chars"), linededup.without(F.col("text"), F.col(every)).alias("rest"),
    )


@query("op10_document_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


AUDIT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT row_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3
), grp AS (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT grp.lang, grp.source, kept.term, count(w.term) AS n
  FROM grp JOIN kept USING (lang) LEFT JOIN w ON w.lang = grp.lang AND w.source = grp.source AND w.term = kept.term
  GROUP BY grp.lang, grp.source, kept.term
), p AS (
  SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source))::BIGINT AS p FROM c
), q AS (
  SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::BIGINT AS q FROM kept
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
  FROM grp AS a JOIN grp AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p AS x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p AS y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
), every AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
) WHERE part = 'pair' OR rank <= 200
"""


@query("op11_source_divergence", AUDIT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_byte_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *rank_file())


NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.row_id, a.vec_id AS anchor_id, a.label = b.label AS same, b.row_id AS other_row, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), pos AS (
  SELECT row_id, anchor_id, other_row AS positive_row, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id, other_row) <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT pos.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY pos.row_id, positive_row ORDER BY score DESC, vec_id, other_row) AS rank
  FROM pos JOIN s ON s.row_id = pos.row_id AND NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
) WHERE rank <= 3
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)
