"""Knowledge base, session, feedback and statement-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill import spec
from casemill.functions import text as tx
from casemill.functions.identity import content_id, pair_id
from casemill.operators import audit, balls, feedback, knowledge, sessions
from casemill.plans import fixtures as fx
from casemill.plans.loads import pair_json
from casemill.plans.registry import query
from casemill.session import scratch_path
from casemill.sources import lookups
from casemill.streaming.feedback import current_pairs, start_feedback

# Document rows of the knowledge base over the document table.
_DOCUMENT = {
    "filename": "concat('doc_', CAST(doc_id AS STRING), CASE WHEN lang = 'en' THEN '.md' ELSE '.txt' END)",
    "category": "lang",
    "user_id": "source",
    "is_private": "(n_chars % 5 = 0)",
}


def documents(spark: SparkSession, d: str) -> DataFrame:
    rules = [f"{rule} AS {name}" for name, rule in _DOCUMENT.items()]
    return fx.table(spark, d, "documents").selectExpr("doc_id", "text", *rules, "array(source, lang) AS tags")


# Chunk rows cut every 400 characters, a table both engines can write down.
_CHUNKS_SQL = """SELECT doc_id, CAST(i AS INT) AS chunk_index, CAST(ceil(length(text) / 400.0) AS INT) AS total_chunks,
 substr(text, CAST(i * 400 + 1 AS BIGINT), 400) AS text, lang AS category, source AS user_id,
 CASE WHEN n_chars % 5 = 0 THEN 'private' ELSE 'shared' END AS visibility,
 'doc_' || CAST(doc_id AS VARCHAR) AS document_id, 'file_' || CAST(n_chars % 700 AS VARCHAR) || '.txt' AS filename
 FROM documents, range(0, CAST(ceil(length(text) / 400.0) AS BIGINT)) AS s(i)"""


def even_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "documents").selectExpr(
        "doc_id",
        "text AS whole",
        "lang AS category",
        "source AS user_id",
        "CASE WHEN n_chars % 5 = 0 THEN 'private' ELSE 'shared' END AS visibility",
        "concat('doc_', CAST(doc_id AS STRING)) AS document_id",
        "concat('file_', CAST(n_chars % 700 AS STRING), '.txt') AS filename",
        "CAST(ceil(length(text) / 400) AS INT) AS total_chunks",
        "explode(IF(length(text) > 0, sequence(0, CAST(ceil(length(text) / 400) AS INT) - 1), array())) AS chunk_index",
    )
    split = F.col("total_chunks") > 1
    return rows.select(
        F.when(split, F.concat("document_id", F.lit("_chunk"), "chunk_index"))
        .otherwise(F.col("document_id"))
        .alias("chunk_id"),
        F.when(split, F.col("document_id")).alias("parent_id"),
        F.when(split, F.col("chunk_index")).alias("chunk_index"),
        F.when(split, F.col("total_chunks")).alias("total_chunks"),
        F.expr("substr(whole, chunk_index * 400 + 1, 400)").alias("text"),
        "category",
        "user_id",
        "visibility",
        "filename",
        F.array("user_id", "category").alias("tags"),
    )


@query(
    "document_chunks",
    "K1 K2 K3",
    f"""SELECT {_DOCUMENT["filename"]} AS filename, 'kb_' || md5({_DOCUMENT["filename"]}) AS document_id,
        md5(regexp_replace(text, '[ \\t\\n\\r\\v\\f]+', '', 'g')) AS content,
        CASE WHEN n_chars % 5 = 0 THEN 'user:' || source ELSE lang END AS category,
        CASE WHEN n_chars % 5 = 0 THEN 'private' ELSE 'shared' END AS visibility, true AS contiguous, true AS within_size FROM documents""",
)
def _document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Without overlap, a document's chunks are its text but for the blanks at the cuts."""
    chunks = knowledge.chunk_documents(documents(spark, d), overlap=0)
    return _rejoined(chunks, F.md5(F.regexp_replace("joined", r"[ \t\n\r\x0B\f]+", "").cast("binary")).alias("content"))


def _rejoined(chunks: DataFrame, *columns) -> DataFrame:
    """One row per document; the chunks of a document are no more than its text."""
    found = chunks.groupBy("filename", "category", "visibility", F.coalesce("parent_id", "chunk_id").alias("document_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("chunk_index", F.lit(0)).alias("at"), "text", "total_chunks"))).alias("parts")
    )
    indexes = F.sequence(F.lit(0), F.size("parts") - 1)
    counted = F.coalesce(F.col("parts")[0]["total_chunks"], F.lit(1)) == F.size("parts")
    return found.withColumn("joined", F.array_join("parts.text", "")).select(
        "filename", "document_id", "category", "visibility",
        ((F.col("parts.at") == indexes) & counted).alias("contiguous"),
        # One chunk keeps the whole text, blanks included.
        ((F.size("parts") == 1) | (F.array_max(F.transform("parts.text", F.length)) <= 500)).alias("within_size"),
        *columns,
    )


@query(
    "overlapping_chunks",
    "K1 K2 K3",
    f"""SELECT {_DOCUMENT["filename"]} AS filename, true AS contiguous, true AS within_size, length(text) <= 500 AS whole,
        CASE WHEN length(text) <= 500 THEN CAST(length(text) AS INT) END AS char_count FROM documents""",
)
def _overlapping_chunks(spark: SparkSession, d: str) -> DataFrame:
    """With overlap, chunks stay within the size and count up; a text within the size stays whole."""
    chunks = knowledge.chunk_documents(documents(spark, d))
    total = F.aggregate("parts.text", F.lit(0), lambda n, t: n + F.length(t))
    whole = (F.size("parts") == 1) & (total <= 500)
    return _rejoined(chunks, whole.alias("whole"), F.when(whole, total).alias("char_count")).select(
        "filename", "contiguous", "within_size", "whole", "char_count"
    )


@query(
    "replaced_documents",
    "K4",
    f"""WITH c AS ({_CHUNKS_SQL}), n AS (SELECT DISTINCT filename FROM c WHERE category = 'fr')
        SELECT category, count(*) AS chunks FROM c WHERE category = 'fr'
        OR filename NOT IN (SELECT filename FROM n) GROUP BY 1""",
)
def _replaced_documents(spark: SparkSession, d: str) -> DataFrame:
    chunks = even_chunks(spark, d)
    incoming = chunks.filter("category = 'fr'")
    # Every incoming chunk comes twice; the later version of its text counts.
    twice = incoming.withColumn("version", F.lit(2)).unionByName(incoming.withColumns({"version": F.lit(1), "text": F.lit("old")}))
    merged = knowledge.replace_documents(chunks.filter("category <> 'fr'").withColumn("version", F.lit(0)), twice, ["version"])
    merged = merged.filter("text <> 'old'")
    return merged.groupBy("category").agg(F.count(F.lit(1)).alias("chunks"))


@query(
    "visible_chunks",
    "K5",
    f"""WITH c AS ({_CHUNKS_SQL}) SELECT visibility, user_id, count(*) AS chunks FROM c
        WHERE (visibility = 'shared' OR user_id = 'src3') AND category = 'en' AND user_id IN ('src3', 'src7') GROUP BY 1, 2""",
)
def _visible_chunks(spark: SparkSession, d: str) -> DataFrame:
    rule = knowledge.visible("src3", category="en", tags=("src3", "src7"))
    return even_chunks(spark, d).filter(rule).groupBy("visibility", "user_id").agg(F.count(F.lit(1)).alias("chunks"))


@query(
    "private_chunks",
    "K5",
    f"WITH c AS ({_CHUNKS_SQL}) SELECT category, count(*) AS chunks FROM c WHERE user_id = 'src3' GROUP BY 1",
)
def _private_chunks(spark: SparkSession, d: str) -> DataFrame:
    kept = even_chunks(spark, d).filter(knowledge.visible("src3", "private"))
    return kept.groupBy("category").agg(F.count(F.lit(1)).alias("chunks"))


@query(
    "list_documents",
    "K9",
    f"""WITH c AS ({_CHUNKS_SQL}) SELECT document_id, filename, category, visibility, total_chunks,
        CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS content_preview
        FROM c WHERE chunk_index = 0""",
)
def _list_documents(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.list_documents(even_chunks(spark, d))


@query(
    "delete_document",
    "K10",
    f"""WITH c AS ({_CHUNKS_SQL}) SELECT document_id, count(*) AS chunks FROM c
        WHERE document_id NOT IN ('doc_3', 'doc_17') GROUP BY 1""",
)
def _delete_document(spark: SparkSession, d: str) -> DataFrame:
    left = knowledge.delete_document(knowledge.delete_document(even_chunks(spark, d), "doc_3"), "doc_17")
    key = F.coalesce("parent_id", "chunk_id").alias("document_id")
    return left.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"))


@query(
    "knowledge_statistics",
    "A22",
    f"WITH c AS ({_CHUNKS_SQL}) SELECT count(DISTINCT document_id) AS total_documents, count(*) AS total_chunks FROM c",
)
def _knowledge_statistics(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.statistics(even_chunks(spark, d))


@query(
    "normalized_tags",
    "K11",
    """WITH t AS (SELECT page_id, list_filter(list_transform(string_split_regex(url, '[/.?=&#]'),
         lambda x: substr(regexp_replace(lower(x), '[^a-z0-9_-]', '', 'g'), 1, 30)), lambda x: x <> '') AS l,
         substr(regexp_replace(lower(url), '[^a-z0-9_-]', '', 'g'), 1, 50) AS c FROM pages)
       SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS tags,
       CASE WHEN c = '' THEN 'general' ELSE c END AS category FROM t""",
)
def _normalized_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = tx.clean_tags(F.split("url", "[/.?=&#]"))
    return fx.table(spark, d, "pages").select(
        "page_id", F.array_join(tags, ",").alias("tags"), tx.clean_category(F.col("url")).alias("category")
    )


# Vector chunks and questions over the embedding table; every vector is both.
_VECTORS_SQL = """SELECT vec_id, 'c' || CAST(vec_id AS VARCHAR) AS chunk_id,
 CASE WHEN vec_id % 3 = 0 THEN 'f' || CAST(vec_id % 100 AS VARCHAR) || '.md' ELSE 'p' || CAST(vec_id % 100 AS VARCHAR) END AS document_key,
 'label' || CAST(label AS VARCHAR) AS category, 't' || CAST(label % 3 AS VARCHAR) AS tag,
 'u' || CAST(vec_id % 4 AS VARCHAR) AS user_id, CASE WHEN vec_id % 5 = 0 THEN 'private' ELSE 'shared' END AS visibility,
 label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"""


def vector_chunks(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "embeddings").selectExpr(
        "concat('c', CAST(vec_id AS STRING)) AS chunk_id",
        "IF(vec_id % 3 = 0, NULL, concat('p', CAST(vec_id % 100 AS STRING))) AS parent_id",
        "concat('f', CAST(vec_id % 100 AS STRING), '.md') AS filename",
        "concat('label', CAST(label AS STRING)) AS category",
        "array(concat('t', CAST(label % 3 AS STRING))) AS tags",
        "concat('u', CAST(vec_id % 4 AS STRING)) AS user_id",
        "IF(vec_id % 5 = 0, 'private', 'shared') AS visibility",
        "concat('text ', CAST(vec_id AS STRING)) AS text",
        "label",
        "embedding",
    )


def vector_questions(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "embeddings").selectExpr("vec_id AS question_id", "embedding")


def _candidates(condition: str, k: int, questions: str = "v") -> str:
    """The k nearest chunks per question as SQL; ``q`` is the question and ``c`` the chunk."""
    return f"""SELECT * FROM (SELECT q.question_id, c.chunk_id, c.document_key,
      round(list_cosine_distance(q.e, c.e), 12) AS distance,
      row_number() OVER (PARTITION BY q.question_id ORDER BY round(list_cosine_distance(q.e, c.e), 12), c.chunk_id) AS n
      FROM {questions} q JOIN v c ON {condition}) AS scored WHERE n <= {k}"""


def _retrieval(condition: str, k: int, questions: str = "v") -> str:
    return f"""SELECT question_id, CAST(result_rank AS INT) AS result_rank, chunk_id, document_key, distance,
      1 - distance / 2 AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS result_rank
      FROM (SELECT *, row_number() OVER (PARTITION BY question_id, document_key ORDER BY distance, chunk_id) AS d
        FROM ({_candidates(condition, 3 * k, questions)}) AS k WHERE distance <= 0.60) AS b WHERE d = 1) AS r
      WHERE result_rank <= {k}"""


_V = f"v AS (SELECT *, vec_id AS question_id FROM ({_VECTORS_SQL}) AS x)"


@query(
    "retrieve_sources",
    "K6 W3 T4",
    f"WITH {_V} {_retrieval('true', 10)}",
    money=("distance", "relevance"),
    digits=6,
)
def _retrieve_sources(spark: SparkSession, d: str) -> DataFrame:
    found = knowledge.retrieve(vector_chunks(spark, d), vector_questions(spark, d), 10)
    return found.select("question_id", "result_rank", "chunk_id", "document_key", "distance", "relevance")


@query(
    "best_chunk_per_document",
    "W3 T4",
    f"""WITH {_V} SELECT question_id, document_key, min(distance) AS distance
        FROM ({_candidates("true", 30)}) AS k GROUP BY 1, 2""",
    money=("distance",),
    digits=6,
)
def _best_chunk(spark: SparkSession, d: str) -> DataFrame:
    hits = knowledge.nearest_chunks(vector_chunks(spark, d), vector_questions(spark, d), 30)
    return knowledge.best_per_document(hits).drop("chunk_id")


@query(
    "source_names",
    "K6",
    f"""WITH {_V}, r AS (SELECT x.*, 'f' || CAST(vec_id % 100 AS VARCHAR) || '.md #' || tag AS filename
          FROM ({_retrieval("true", 10)}) AS x JOIN v ON v.chunk_id = x.chunk_id),
        f AS (SELECT question_id, filename, min(result_rank) AS p FROM r GROUP BY 1, 2),
        n AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY p) AS i FROM f)
        SELECT question_id, CAST(count(*) AS INT) AS source_count, string_agg(filename, ', ' ORDER BY i) FILTER (WHERE i <= 3)
        || CASE WHEN count(*) > 3 THEN ' (+' || (count(*) - 3) || ' more)' ELSE '' END AS sources FROM n GROUP BY 1""",
)
def _source_names(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.source_names(knowledge.retrieve(vector_chunks(spark, d), vector_questions(spark, d), 10))


@query(
    "visited_balls",
    "K6",
    f"""WITH {_V} SELECT question_id, true AS complete, true AS within_index FROM v""",
)
def _visited_balls(spark: SparkSession, d: str) -> DataFrame:
    """How much of the index each question meets; every question meets enough balls to hold its thirty candidates."""
    chunks = vector_chunks(spark, d)
    visits = balls.BallIndex(chunks).visits(vector_questions(spark, d), 30)
    met = F.col("visited_first") + F.col("visited_later")
    return visits.select("question_id", (F.col("visited_first") >= 1).alias("complete"), (met <= F.col("cells")).alias("within_index"))


def _collections(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    chunks = vector_chunks(spark, d)
    return {name: chunks.filter(F.col("label") % 3 == i) for i, (name, _) in enumerate(knowledge.COLLECTION_RELEVANCE)}


def _collection_sql(k: int) -> str:
    parts = [
        f"""SELECT question_id, '{name}' AS collection, CAST(n AS INT) AS collection_rank, chunk_id,
            CAST({relevance} AS DOUBLE) AS relevance,
            '{" SNAP_QC ".join(knowledge.COLLECTION_LABELS[name])}' AS source_display FROM ({_candidates(f"c.label % 3 = {i}", k)}) AS k{i}"""
        for i, (name, relevance) in enumerate(knowledge.COLLECTION_RELEVANCE)
    ]
    return " UNION ALL ".join(parts)


# The text of a chunk follows from its id.
_TEXT = "'text ' || substr(chunk_id, 2) AS text"


@query("retrieve_collections", "K7", f"WITH {_V} SELECT *, {_TEXT} FROM ({_collection_sql(5)}) AS c")
def _retrieve_collections(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.retrieve_collections(_collections(spark, d), vector_questions(spark, d), 5)


@query(
    "retrieve_all",
    "K8 U1 T4",
    f"""WITH {_V}, m AS (SELECT kb.question_id, 'kb' AS collection, result_rank AS collection_rank, kb.chunk_id, relevance,
          '📘 Label' || CAST(label AS VARCHAR) || ' - f' || CAST(vec_id % 100 AS VARCHAR) || '.md #' || tag AS source_display,
          0 AS place FROM ({_retrieval("true", 10)}) AS kb JOIN v ON v.chunk_id = kb.chunk_id
          UNION ALL SELECT *, CASE collection WHEN 'ddl' THEN 1 WHEN 'documentation' THEN 2 ELSE 3 END FROM ({_collection_sql(3)}) AS c)
        SELECT question_id, collection, collection_rank, chunk_id, relevance, source_display, {_TEXT}, CAST(result_rank AS INT) AS result_rank FROM (
          SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY relevance DESC, place, collection_rank) AS result_rank FROM m) AS r
        WHERE result_rank <= 10""",
    money=("relevance",),
    digits=6,
)
def _retrieve_all(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.retrieve_all(vector_chunks(spark, d), _collections(spark, d), vector_questions(spark, d), 10)


# Questions with directives over the conversation table.
_QUESTION = """CASE turn % 6 WHEN 0 THEN 'kb @me ' || text WHEN 1 THEN '#T1 #t2 ' || text
 WHEN 2 THEN 'snap_qc:SQL category:Label3 ' || text WHEN 3 THEN 'ALL ' || text || ' #t0'
 WHEN 4 THEN 'state_ca ' || text || ' @private' ELSE text END"""
_PREFIX = "'(?i)^\\s*(snap_qc|state_ca|kb|all)(?::(\\w+))?\\s+'"
_PARSED_SQL = f"""SELECT conv_id, turn, question, coalesce(nullif(lower(p), ''), 'kb') AS collection_path,
 CASE WHEN lower(p) = 'all' THEN 'kb,ddl,documentation,sql' WHEN lower(p) IN ('', 'kb') THEN 'kb'
   WHEN s <> '' THEN lower(s) ELSE 'ddl,documentation,sql' END AS collections,
 CASE WHEN regexp_matches(rest, '(?i)(@me|@private)\\b') THEN 'private' ELSE 'all' END AS user_scope,
 nullif(lower(regexp_extract(a, '(?i)\\bcategory:(\\w+)\\b', 1)), '') AS category,
 lower(array_to_string(regexp_extract_all(b, '#([\\w\\p{{L}}]+)', 1), ',')) AS tags,
 trim(regexp_replace(regexp_replace(b, '#[\\w\\p{{L}}]+', '', 'g'), '\\s+', ' ', 'g')) AS question_text FROM (
 SELECT *, regexp_replace(a, '(?i)\\bcategory:\\w+\\b', '', 'g') AS b FROM (
 SELECT *, regexp_replace(rest, '(?i)(@me|@private)\\b', '', 'g') AS a FROM (
 SELECT *, regexp_extract(question, {_PREFIX}, 1) AS p, regexp_extract(question, {_PREFIX}, 2) AS s,
   regexp_replace(question, {_PREFIX}, '') AS rest
 FROM (SELECT *, {_QUESTION} AS question FROM conversations) AS q1) AS q2) AS q3) AS q4"""


def parsed_questions(spark: SparkSession, d: str) -> DataFrame:
    asked = fx.table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{_QUESTION} AS question")
    return knowledge.parse_questions(asked)


@query(
    "question_directives",
    "K12",
    f"SELECT conv_id, turn, collection_path, collections, user_scope, category, tags, question_text FROM ({_PARSED_SQL}) AS p",
)
def _question_directives(spark: SparkSession, d: str) -> DataFrame:
    return parsed_questions(spark, d).select(
        "conv_id",
        "turn",
        "collection_path",
        F.array_join("collections", ",").alias("collections"),
        "user_scope",
        "category",
        F.array_join("tags", ",").alias("tags"),
        "question_text",
    )


_ASKED = f"""q AS (SELECT conv_id * 100 + turn AS question_id, 'u' || CAST(turn % 4 AS VARCHAR) AS user_id, user_scope,
 collection_path, string_split(collections, ',') AS collections, p.category, string_split(p.tags, ',') AS tags,
 p.tags AS tag_text, v.e FROM ({_PARSED_SQL}) AS p JOIN v ON v.vec_id = p.conv_id)"""
_ALLOWED = """(c.user_id = q.user_id OR (q.user_scope = 'all' AND c.visibility = 'shared'))
 AND (q.category IS NULL OR q.category = c.category) AND (q.tag_text = '' OR list_contains(q.tags, c.tag))"""
_KB_LABEL = "'📘 Label' || CAST(label AS VARCHAR) || ' - f' || CAST(vec_id % 100 AS VARCHAR) || '.md #' || tag"


def asked_questions(spark: SparkSession, d: str) -> DataFrame:
    """All questions; one without a vector stays and gets no sources."""
    vectors = fx.table(spark, d, "embeddings").selectExpr("vec_id AS conv_id", "embedding")
    return parsed_questions(spark, d).join(vectors, "conv_id", "left").withColumns(
        {
            "question_id": F.expr("conv_id * 100 + turn"),
            "user_id": F.expr("concat('u', CAST(turn % 4 AS STRING))"),
        }
    )


@query(
    "questions_without_vector",
    "K12",
    f"""SELECT collection_path, count(*) AS questions, count(*) FILTER (WHERE conv_id NOT IN (SELECT vec_id FROM embeddings)) AS unanswered
        FROM ({_PARSED_SQL}) AS p GROUP BY 1""",
)
def _questions_without_vector(spark: SparkSession, d: str) -> DataFrame:
    return asked_questions(spark, d).groupBy("collection_path").agg(
        F.count("*").alias("questions"), F.count_if(F.col("embedding").isNull()).alias("unanswered")
    )


@query(
    "bulk_retrieval",
    "K12 K5 K6",
    f"WITH {_V}, {_ASKED} {_retrieval(_ALLOWED, 5, 'q')}",
    money=("distance", "relevance"),
    digits=6,
)
def _bulk_retrieval(spark: SparkSession, d: str) -> DataFrame:
    asked = asked_questions(spark, d).select("question_id", "embedding", "user_id", "user_scope", "category", "tags")
    found = knowledge.retrieve(vector_chunks(spark, d), asked, 5)
    return found.select("question_id", "result_rank", "chunk_id", "document_key", "distance", "relevance")


def _routed_sql() -> str:
    parts, merged = [], []
    for i, (name, relevance) in enumerate(knowledge.COLLECTION_RELEVANCE):
        sign, kind = knowledge.COLLECTION_LABELS[name]
        sent = f"(SELECT * FROM q WHERE collection_path NOT IN ('kb', 'all') AND list_contains(collections, '{name}'))"
        parts.append(
            f"""SELECT k.question_id, '{name}' AS collection, k.chunk_id, CAST({relevance} AS DOUBLE) AS relevance, {i} AS place, n,
            '{sign} ' || upper(q.collection_path) || ' {kind}' AS source_display
            FROM ({_candidates(f"c.label % 3 = {i}", 5, sent)}) AS k JOIN q ON q.question_id = k.question_id"""
        )
        merged.append(
            f"""SELECT question_id, '{name}' AS collection, chunk_id, CAST({relevance} AS DOUBLE) AS relevance, {i + 1} AS place, n,
            '{sign} SNAP_QC {kind}' AS source_display FROM ({_candidates(f"c.label % 3 = {i}", 3, "everywhere")}) AS a{i}"""
        )
    shared = "(c.user_id = q.user_id OR c.visibility = 'shared')"
    return f"""WITH {_V}, {_ASKED}, kb_only AS (SELECT * FROM q WHERE collection_path = 'kb'),
      everywhere AS (SELECT * FROM q WHERE collection_path = 'all'),
      sets AS ({" UNION ALL ".join(parts)}),
      merged AS (SELECT r.question_id, 'kb' AS collection, r.chunk_id, relevance, 0 AS place, result_rank AS n,
        {_KB_LABEL} AS source_display FROM ({_retrieval(shared, 10, "everywhere")}) AS r JOIN v ON v.chunk_id = r.chunk_id
        UNION ALL {" UNION ALL ".join(merged)}),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY relevance DESC, place, n) AS result_rank FROM merged)
      SELECT r.question_id, CAST(result_rank AS INT) AS result_rank, 'kb' AS collection, r.chunk_id, relevance, {_KB_LABEL} AS source_display
      FROM ({_retrieval(_ALLOWED, 5, "kb_only")}) AS r JOIN v ON v.chunk_id = r.chunk_id
      UNION ALL SELECT question_id, CAST(result_rank AS INT), collection, chunk_id, relevance, source_display FROM ranked WHERE result_rank <= 10
      UNION ALL SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY place, n) AS INT), collection, chunk_id,
      relevance, source_display FROM sets"""


def _with_text(sql: str) -> str:
    head, body = sql.split("SELECT r.question_id, CAST(result_rank AS INT) AS result_rank, 'kb'", 1)
    return f"{head} SELECT *, {_TEXT} FROM (SELECT r.question_id, CAST(result_rank AS INT) AS result_rank, 'kb'{body}) AS routed"


@query("routed_retrieval", "K12 K7 K8", _with_text(_routed_sql()), money=("relevance",), digits=6)
def _routed_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.route_questions(vector_chunks(spark, d), _collections(spark, d), asked_questions(spark, d))


@query(
    "routed_retrieval_one_path",
    "K12 K6",
    f"""WITH {_V}, {_ASKED}, kb_only AS (SELECT * FROM q WHERE collection_path = 'kb')
      SELECT r.question_id, r.result_rank, 'kb' AS collection, r.chunk_id, relevance, {_KB_LABEL} AS source_display,
      'text ' || substr(r.chunk_id, 2) AS text FROM ({_retrieval(_ALLOWED, 5, "kb_only")}) AS r JOIN v ON v.chunk_id = r.chunk_id""",
    money=("relevance",),
    digits=6,
)
def _routed_retrieval_one_path(spark: SparkSession, d: str) -> DataFrame:
    """A batch in which no question asks for the other collections."""
    asked = asked_questions(spark, d).filter("collection_path = 'kb'")
    return knowledge.route_questions(vector_chunks(spark, d), _collections(spark, d), asked)


@query(
    "last_session_entries",
    "W4",
    """SELECT conv_id, turn, role, CAST(n AS INT) AS recency FROM (SELECT *, row_number() OVER
       (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) AS c WHERE n <= 3""",
)
def _last_session_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "conversations").select("conv_id", "turn", "role")
    return sessions.last_entries(rows, "conv_id", ["turn"], 3)


_SIZED = """SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS full_size, CAST(least(length(text), 300) AS BIGINT) AS short_size,
 CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INT) AS recency FROM conversations"""


def _sized(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "conversations").selectExpr(
        "conv_id", "turn", "length(text) AS full_size", "least(length(text), 300) AS short_size"
    )
    return sessions.last_entries(rows, "conv_id", ["turn"])


@query(
    "entries_within_budget",
    "W5",
    f"""SELECT conv_id, turn, running_size FROM (SELECT *, CAST(sum(full_size) OVER (PARTITION BY conv_id ORDER BY recency
        ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_size FROM ({_SIZED}) AS s WHERE recency <= 20) AS w WHERE running_size <= 4000""",
)
def _entries_within_budget(spark: SparkSession, d: str) -> DataFrame:
    return sessions.within_budget(_sized(spark, d), "conv_id", "full_size", 4000).select("conv_id", "turn", "running_size")


@query(
    "packed_entries",
    "W5",
    f"""WITH RECURSIVE s AS ({_SIZED}), r AS (
          SELECT conv_id, 0 AS i, CAST(0 AS BIGINT) AS used, false AS done, CAST('' AS VARCHAR) AS form, CAST(0 AS BIGINT) AS size
          FROM (SELECT DISTINCT conv_id FROM s) AS c
          UNION ALL SELECT r.conv_id, s.recency,
            CASE WHEN used + full_size <= 4000 THEN used + full_size WHEN used + short_size <= 4000 THEN used + short_size ELSE used END,
            NOT (used + full_size <= 4000 OR used + short_size <= 4000),
            CASE WHEN used + full_size <= 4000 THEN 'full' ELSE 'short' END,
            CASE WHEN used + full_size <= 4000 THEN full_size ELSE short_size END
          FROM r JOIN s ON s.conv_id = r.conv_id AND s.recency = r.i + 1 WHERE NOT r.done AND s.recency <= 20)
        SELECT conv_id, i AS recency, form, size FROM r WHERE i > 0 AND NOT done""",
)
def _packed_entries(spark: SparkSession, d: str) -> DataFrame:
    return sessions.packed_entries(_sized(spark, d), "conv_id", "full_size", "short_size", 4000)


def _json_text(column: str) -> str:
    out = f"replace(replace({column}, '\\', '\\\\'), '\"', '\\\"')"
    for code, escape in ((10, "n"), (9, "t"), (13, "r"), (8, "b"), (12, "f")):
        out = f"replace({out}, chr({code}), '\\{escape}')"
    return f"'\"' || {out} || '\"'"


def _uuid_sql(name: str) -> str:
    return f"""(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
      || substr('89ab', 1 + CAST((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 AS INT), 1) || substr(h, 18, 3) || '-'
      || substr(h, 21, 12) FROM (SELECT sha1('{chr(92)}x00'::BLOB || '{(chr(92) + "x00") * 15}'::BLOB || encode({name})) AS h) AS hashed)"""


def _pair_sql(question: str, sql: str) -> str:
    body = f"""'{{"question": ' || {_json_text(question)} || ', "sql": ' || {_json_text(sql)} || '}}'"""
    return f"{_uuid_sql(f'sha256({body})')} || '-sql'"


@query(
    "pair_ids",
    "F1",
    f"SELECT conv_id, turn, {_pair_sql('text', 'role')} AS pair_id FROM conversations",
)
def _pair_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "conversations")
    return rows.select("conv_id", "turn", pair_id(F.col("text"), F.col("role")).alias("pair_id"))


_FEEDBACK = {
    "question": "concat('user ', CAST(user_id AS STRING))",
    "sql": "concat('SELECT ', CAST(CAST(floor(value / 50) AS INT) AS STRING))",
    "value": "CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END",
}
_FEEDBACK_SQL = f"""SELECT ts, event_id, {", ".join(f"{rule} AS {'vote' if name == 'value' else name}" for name, rule in _FEEDBACK.items())}
 FROM events WHERE event_type <> 'signup'"""
_LATEST_SQL = f"""SELECT question, sql, vote FROM (SELECT *, row_number() OVER (PARTITION BY question, sql
 ORDER BY ts DESC, event_id DESC) AS n FROM ({_FEEDBACK_SQL}) AS f) AS o WHERE n = 1"""
_STORED_SQL = "SELECT DISTINCT 'user ' || CAST(user_id AS VARCHAR) AS question, 'SELECT ' || CAST(CAST(floor(value / 50) AS INT) AS VARCHAR) AS sql FROM events WHERE event_type = 'signup'"
_MERGED_SQL = f"""WITH l AS ({_LATEST_SQL}), s AS ({_STORED_SQL}) SELECT question, sql, {_pair_sql("question", "sql")} AS pair_id FROM (
 SELECT question, sql FROM l WHERE vote = 1 UNION SELECT question, sql FROM s
 WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.question = s.question AND l.sql = s.sql)) AS kept"""


def _votes(events: DataFrame) -> DataFrame:
    rules = [f"{rule} AS {name}" for name, rule in _FEEDBACK.items()]
    return events.filter("event_type <> 'signup'").selectExpr("ts", "event_id", *rules)


def _stored(spark: SparkSession, d: str) -> DataFrame:
    rules = [f"{_FEEDBACK[name]} AS {name}" for name in ("question", "sql")]
    pairs = fx.table(spark, d, "events").filter("event_type = 'signup'").selectExpr(*rules).distinct()
    return feedback.with_pair_id(pairs)


@query("latest_feedback", "W6", _LATEST_SQL)
def _latest_feedback(spark: SparkSession, d: str) -> DataFrame:
    latest = feedback.latest_feedback(_votes(fx.table(spark, d, "events")))
    return latest.select("question", "sql", F.col("value").alias("vote"))


@query("feedback_store", "F2 F1 W6", _MERGED_SQL)
def _feedback_store(spark: SparkSession, d: str) -> DataFrame:
    return feedback.apply_feedback(_stored(spark, d), _votes(fx.table(spark, d, "events")))


@query("streamed_feedback", "X2 F2", _MERGED_SQL)
def _streamed_feedback(spark: SparkSession, d: str) -> DataFrame:
    path, mark, drop = (scratch_path(spark, name) for name in ("feedback", "mark", "drop"))
    events = fx.table(spark, d, "events")
    events.repartition(4).write.parquet(drop)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(drop)
    start_feedback(_votes(stream), path, mark).awaitTermination()
    return current_pairs(spark, _stored(spark, d), path)


_PAIRS_SQL = """SELECT DISTINCT CASE WHEN item_id % 2 = 0 THEN text || ' (note)' ELSE text END AS question,
 'SELECT ' || item_id AS sql FROM benchmark WHERE item_id % 5 <> 0 AND item_id % 7 <> 0"""


@query("store_statistics", "F3 S15")
def _store_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Entries of all three types. SQL cannot cut the chunks; ``test_store_statistics_count_all_types`` counts them by the rule."""
    return feedback.store_statistics(_rebuilt(spark, d))


@query(
    "store_pair_statistics",
    "F3 S15",
    f"""SELECT 'sql' AS training_type, count(*) AS entries FROM ({_PAIRS_SQL}) AS p
       UNION ALL SELECT 'ddl', count(DISTINCT p_brand || p_type) FROM part""",
)
def _store_pair_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a store without documents, whose types SQL can count."""
    pairs = lookups.example_pairs(pair_json(spark, d))
    return feedback.store_statistics(feedback.rebuild_store(documents(spark, d).filter("false"), pairs, _ddl(spark, d)))


def _rebuilt(spark: SparkSession, d: str) -> DataFrame:
    return feedback.rebuild_store(documents(spark, d), lookups.example_pairs(pair_json(spark, d)), _ddl(spark, d))


def _ddl(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "part").select(F.concat("p_brand", "p_type").alias("content"))


@query(
    "rebuilt_store",
    "F4 K1 S15 F1",
    f"""SELECT 'documentation' AS training_type, {_DOCUMENT["filename"]} AS question,
        md5(regexp_replace(text, '[ \\t\\n\\r\\v\\f]+', '', 'g')) AS content FROM documents
        UNION ALL SELECT 'sql', question, sql FROM ({_PAIRS_SQL}) AS p
        UNION ALL SELECT DISTINCT 'ddl', CAST(NULL AS VARCHAR), p_brand || p_type FROM part""",
)
def _rebuilt_store(spark: SparkSession, d: str) -> DataFrame:
    """The store's entries; documents are put together again from the stored chunks."""
    store = feedback.rebuild_store(documents(spark, d), lookups.example_pairs(pair_json(spark, d)), _ddl(spark, d), overlap=0)
    stored = store.filter("training_type = 'documentation'").select("id", F.col("content").alias("stored"))
    chunks = knowledge.chunk_documents(documents(spark, d), overlap=0).withColumn("id", content_id(F.col("text"), "doc"))
    found = chunks.join(stored, "id").withColumn("text", F.col("stored")).drop("id", "stored")
    bare = F.regexp_replace("joined", r"[ \t\n\r\x0B\f]+", "").cast("binary")
    whole = _rejoined(found, F.md5(bare).alias("content"))
    others = store.filter("training_type <> 'documentation'").select("training_type", "question", "content")
    return whole.select(F.lit("documentation").alias("training_type"), F.col("filename").alias("question"), "content").unionByName(others)


_STATEMENT = """CASE WHEN event_type = 'view' THEN concat('SELECT * FROM households WHERE case_id = ', CAST(event_id AS STRING))
 WHEN event_type = 'click' THEN ' with x as (select created_at from t) select * from x; '
 WHEN event_type = 'signup' THEN concat('insert into t values (', CAST(user_id AS STRING), ')')
 WHEN event_type = 'purchase' THEN concat('SELECT 1; SELECT ', CAST(user_id AS STRING))
 WHEN value < 20 THEN 'EXPLAIN SELECT 1' WHEN value < 40 THEN 'SELECT 1 -- note' WHEN value < 60 THEN 'SELECT /* x */ 1'
 WHEN value < 80 THEN 'MERGE INTO t USING s' WHEN value < 100 THEN 'SELECT updated FROM t' ELSE 'SELECT a FROM t; drop table t' END"""
_STRICT_SQL = (
    "CASE " + " ".join(f"WHEN regexp_matches(upper(s), '\\b{w}\\b') THEN 'forbidden keyword: {w}'" for w in spec.BLOCKED_WORDS)
    + " WHEN NOT (starts_with(upper(trim(s)), 'SELECT') OR starts_with(upper(trim(s)), 'WITH')) THEN 'not a SELECT or WITH'"
    + " WHEN length(s) - length(replace(s, ';', '')) > 1 OR (length(s) - length(replace(s, ';', '')) = 1 AND NOT ends_with(trim(s), ';'))"
    + " THEN 'multiple statements' WHEN contains(s, '--') OR contains(s, '/*') OR contains(s, '*/') THEN 'comment' END"
)
_LOOSE_SQL = "(" + " OR ".join(f"contains(upper(s), '{w}')" for w in spec.BLOCKED_SUBSTRINGS) + ")"


@query(
    "statement_audit",
    "G1",
    f"""SELECT strict_reason IS NULL AS allowed, strict_reason, count(*) AS statements,
        count(*) FILTER (WHERE (strict_reason IS NULL) <> NOT loose) AS disagreements FROM (
        SELECT {_STRICT_SQL} AS strict_reason, {_LOOSE_SQL} AS loose FROM (SELECT {_STATEMENT} AS s FROM events) AS e) AS v GROUP BY 1, 2""",
)
def _statement_audit(spark: SparkSession, d: str) -> DataFrame:
    log = fx.table(spark, d, "events").selectExpr(f"{_STATEMENT} AS statement")
    return audit.audit_report(log)
