"""Knowledge base: chunk rows, access rules, retrieval and maintenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import text as tx
from casemill.functions.chunking import chunks_of
from casemill.operators.balls import FILTERS, BallIndex, written
from casemill.operators.ranking import top_per_group

DISTANCE_THRESHOLD = 0.60
OVERFETCH = 3
# Relevance given to hits of the example-store collections, best first.
COLLECTION_RELEVANCE = (("ddl", 0.9), ("documentation", 0.85), ("sql", 0.8))
# Signs and words of the collection labels.
COLLECTION_LABELS = {"ddl": ("🗄️", "Schema"), "documentation": ("📖", "Context"), "sql": ("💡", "Examples")}
# Dataset names a question may start with.
DATASETS = ("snap_qc", "state_ca")


def chunk_documents(documents: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Documents ``(filename, text, category, tags, user_id, is_private)`` to chunk rows.

    Ids are derived from the file name, so loading a document again gives the same ids.
    Unsplit documents have no parent link and keep their whole text. A text that is all blanks is kept whole
    as well, and one without text has no row.
    """
    private = F.coalesce("is_private", F.lit(False))
    document_id = F.concat(F.lit("kb_"), F.md5(F.col("filename").cast("binary")))
    base = documents.select(
        "filename",
        F.when(private, F.concat(F.lit("user:"), "user_id")).otherwise(F.col("category")).alias("category"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        "user_id",
        F.when(private, "private").otherwise("shared").alias("visibility"),
        document_id.alias("_id"),
        chunks_of(F.col("text"), F.col("filename"), size, overlap).alias("_chunks"),
    )
    rows = base.select("*", F.size("_chunks").alias("_total"), F.posexplode("_chunks").alias("_index", "text"))
    split = F.col("_total") > 1
    return rows.select(
        F.when(split, F.concat("_id", F.lit("_chunk"), "_index")).otherwise(F.col("_id")).alias("chunk_id"),
        F.when(split, F.col("_id")).alias("parent_id"),
        F.when(split, F.col("_index")).alias("chunk_index"),
        F.when(split, F.col("_total")).alias("total_chunks"),
        F.length("text").alias("char_count"),
        "filename",
        "category",
        "tags",
        "user_id",
        "visibility",
        "text",
        F.current_timestamp().alias("created_at"),
    )


def replace_documents(existing: DataFrame, incoming: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Chunks of incoming file names replace all stored chunks of those names.

    A chunk id that comes twice in one batch is kept once: the last by ``order``, columns of incoming, or
    without them the one with the largest text.
    """
    names = incoming.select("filename").distinct()
    rank = F.struct(*[F.col(c) for c in order], "text", F.struct(*[F.col(c) for c in incoming.columns if c != "text"]))
    last = incoming.groupBy("chunk_id").agg(F.max_by(F.struct(*incoming.columns), rank).alias("row")).select("row.*")
    return existing.join(names, "filename", "left_anti").unionByName(last)


def delete_document(chunks: DataFrame, document_id: str) -> DataFrame:
    """Chunks without the given document; the id is that of the document or of one chunk."""
    hit = (F.col("chunk_id") == document_id) | F.coalesce(F.col("parent_id") == document_id, F.lit(False))
    return chunks.filter(~hit)


def list_documents(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per document with a preview; first chunks carry all that is shown, so nothing is grouped."""
    first = chunks.filter(F.coalesce("chunk_index", F.lit(0)) == 0)
    out = first.select(
        F.coalesce("parent_id", "chunk_id").alias("document_id"),
        "filename",
        "category",
        "visibility",
        F.coalesce("total_chunks", F.lit(1)).alias("total_chunks"),
        tx.preview(F.col("text")).alias("content_preview"),
    )
    return out.orderBy("document_id").limit(limit) if limit else out


def statistics(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count_distinct(F.coalesce("parent_id", "chunk_id")).alias("total_documents"),
        F.count(F.lit(1)).alias("total_chunks"),
    )


def visible(
    user_id: str, user_scope: str = "all", category: str | None = None, tags: Sequence[str] = ()
) -> Column:
    """Own chunks in private scope, shared or own ones otherwise; category equal, any tag shared."""
    own = F.col("user_id") == user_id
    rule = own if user_scope == "private" else (F.col("visibility") == "shared") | own
    if category:
        rule = rule & (F.col("category") == category)
    if tags:
        rule = rule & F.arrays_overlap("tags", F.array(*[F.lit(tag) for tag in tags]))
    return rule


def parse_questions(questions: DataFrame, column: str = "question", datasets: Sequence[str] = DATASETS) -> DataFrame:
    """Directives of a question as columns: collection prefix, ``@me``, ``category:x``, ``#tags``; cleaned text kept."""
    names = "|".join([*datasets, "kb", "all"])
    prefix = rf"(?iU)^\s*({names})(?::(\w+))?\s+"
    mine, category, tag = r"(?iU)(@me|@private)\b", r"(?iU)\bcategory:(\w+)\b", r"(?U)#(\w+)"
    raw = F.col(column)
    path = F.lower(F.regexp_extract(raw, prefix, 1))
    chosen = F.lower(F.regexp_extract(raw, prefix, 2))
    all_three = F.array(*[F.lit(name) for name, _ in COLLECTION_RELEVANCE])
    collections = (
        F.when(path == "all", F.concat(F.array(F.lit("kb")), all_three))
        .when(path.isin("", "kb"), F.array(F.lit("kb")))
        .when(chosen != "", F.array(chosen))
        .otherwise(all_three)
    )
    rest = F.regexp_replace(raw, prefix, "")
    without_scope = F.regexp_replace(rest, mine, "")
    named = F.lower(F.regexp_extract(without_scope, category, 1))
    without_category = F.regexp_replace(without_scope, category, "")
    cleaned = F.regexp_replace(without_category, tag, "")
    return questions.withColumns(
        {
            "collection_path": F.when(path == "", "kb").otherwise(path),
            "collections": collections,
            "user_scope": F.when(rest.rlike(mine), "private").otherwise("all"),
            "category": F.when(named != "", named),
            "tags": F.transform(F.regexp_extract_all(without_category, F.lit(tag), 1), F.lower),
            "question_text": F.trim(F.regexp_replace(cleaned, r"(?U)\s+", " ")),
        }
    )


def nearest_chunks(chunks: DataFrame, questions: DataFrame, k: int, within: float | None = None) -> DataFrame:
    """The k nearest chunks per question over all chunks, through an index of balls (see ``operators.balls``).

    ``questions`` needs a bigint ``question_id`` and ``embedding``; with the four filter columns as well, each
    question only sees the chunks its filters allow. ``within`` leaves out chunks beyond a distance. No questions,
    or no chunks, give no rows. Rows without vector take no part.
    """
    return BallIndex(chunks, set(FILTERS) <= set(questions.columns)).nearest(questions, k, within)


def best_per_document(hits: DataFrame) -> DataFrame:
    """The nearest chunk of each document per question, found with a map-side minimum."""
    nearest = F.min(F.struct("distance", "chunk_id")).alias("_best")
    return hits.groupBy("question_id", "document_key").agg(nearest).select("question_id", "document_key", "_best.*")


def retrieve(
    chunks: DataFrame,
    questions: DataFrame,
    n_results: int = 10,
    distance_threshold: float = DISTANCE_THRESHOLD,
) -> DataFrame:
    """Ranked sources per question.

    Candidates are cut to three times ``n_results`` before the threshold and before the
    best chunk per document is chosen, so fewer than ``n_results`` may remain.
    """
    candidates = nearest_chunks(chunks, questions, n_results * OVERFETCH, distance_threshold)
    best = best_per_document(candidates)
    ranked = top_per_group(best, ["question_id"], ["distance", "chunk_id"], n_results, "result_rank")
    described = chunks.select("chunk_id", "filename", "category", "tags", "text")
    return described.join(ranked, "chunk_id").select(
        "question_id",
        "result_rank",
        "chunk_id",
        "document_key",
        "distance",
        (1 - F.col("distance") / 2).alias("relevance"),
        tx.source_label(F.col("category"), F.col("filename"), F.col("tags")).alias("source_display"),
        "filename",
        "text",
    )


def source_names(results: DataFrame) -> DataFrame:
    """Distinct sources per question in rank order, first three spelled out; results per question are few."""
    name = F.substring_index("source_display", " - ", -1).alias("name")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("result_rank"), name)))
    names = F.array_distinct(F.transform("_ordered", lambda item: item["name"]))
    listed = results.groupBy("question_id").agg(ordered.alias("_ordered")).select("question_id", names.alias("sources"))
    shown = F.array_join(F.slice("sources", 1, 3), ", ")
    more = F.when(F.size("sources") > 3, F.concat(F.lit(" (+"), F.size("sources") - 3, F.lit(" more)"))).otherwise("")
    return listed.select("question_id", F.size("sources").alias("source_count"), F.concat(shown, more).alias("sources"))


def retrieve_collections(
    collections: Mapping[str, DataFrame], questions: DataFrame, n_results: int = 5, dataset: str = DATASETS[0]
) -> DataFrame:
    """Nearest entries of each example-store collection with their text and the collection's fixed relevance and label."""
    found = []
    for name, relevance in COLLECTION_RELEVANCE:
        if name not in collections:
            continue
        # Collections belong to everybody, so access filters do not apply.
        hits = nearest_chunks(collections[name], questions.select("question_id", "embedding"), n_results)
        ranked = hits.withColumn(
            "collection_rank",
            F.row_number().over(Window.partitionBy("question_id").orderBy("distance", "chunk_id")),
        )
        sign, kind = COLLECTION_LABELS[name]
        found.append(
            ranked.join(collections[name].select("chunk_id", "text"), "chunk_id").select(
                "question_id",
                F.lit(name).alias("collection"),
                "collection_rank",
                "chunk_id",
                F.lit(relevance).alias("relevance"),
                F.lit(f"{sign} {dataset.upper()} {kind}").alias("source_display"),
                "text",
            )
        )
    return reduce(DataFrame.unionByName, found)


def retrieve_all(
    chunks: DataFrame, collections: Mapping[str, DataFrame], questions: DataFrame, n_results: int = 10, per_collection: int = 3
) -> DataFrame:
    """Knowledge-base and collection hits in one list per question: best relevance first, equal ones in source order."""
    kb = retrieve(chunks, questions, n_results).select(
        "question_id",
        F.lit("kb").alias("collection"),
        F.col("result_rank").alias("collection_rank"),
        "chunk_id",
        "relevance",
        "source_display",
        "text",
    )
    merged = kb.unionByName(retrieve_collections(collections, questions, per_collection))
    place = F.array_position(F.array(*[F.lit(n) for n in ("kb", *[c for c, _ in COLLECTION_RELEVANCE])]), F.col("collection"))
    order = [F.desc("relevance"), place, F.col("collection_rank")]
    return top_per_group(merged, ["question_id"], order, n_results, "result_rank")


def route_questions(chunks: DataFrame, collections: Mapping[str, DataFrame], questions: DataFrame) -> DataFrame:
    """Sources of every question where its directives send it.

    Takes the output of ``parse_questions`` with ``question_id``, ``embedding`` and
    ``user_id``. Knowledge-base questions use all their filters and get five sources, ``all``
    questions ten over knowledge base and collections by user only, dataset questions five
    per chosen collection. Questions are written once, since every collection reads them.
    """
    questions = written(questions.select("question_id", "embedding", "collection_path", "collections", *FILTERS), "questions")
    kb = questions.filter("collection_path = 'kb'").select("question_id", "embedding", *FILTERS)
    everywhere = questions.filter("collection_path = 'all'").select(
        "question_id",
        "embedding",
        "user_id",
        F.lit("all").alias("user_scope"),
        F.lit(None).cast("string").alias("category"),
        F.array().cast("array<string>").alias("tags"),
    )
    columns = ["question_id", "result_rank", "collection", "chunk_id", "relevance", "source_display", "text"]
    parts = [
        retrieve(chunks, kb, 5).withColumn("collection", F.lit("kb")).select(*columns),
        retrieve_all(chunks, collections, everywhere, 10).select(*columns),
    ]
    asked = questions.filter(~F.col("collection_path").isin("kb", "all"))
    found = []
    for place, (name, relevance) in enumerate(COLLECTION_RELEVANCE):
        if name not in collections:
            continue
        sent = asked.filter(F.array_contains("collections", name))
        hits = nearest_chunks(collections[name], sent.select("question_id", "embedding"), 5)
        hits = hits.join(collections[name].select("chunk_id", "text"), "chunk_id")
        labels = sent.select(F.col("question_id").cast("bigint").alias("question_id"), F.upper("collection_path").alias("_set"))
        sign, kind = COLLECTION_LABELS[name]
        found.append(
            hits.join(labels, "question_id").select(
                "question_id",
                F.lit(place).alias("_place"),
                "distance",
                F.lit(name).alias("collection"),
                "chunk_id",
                F.lit(relevance).alias("relevance"),
                F.concat(F.lit(f"{sign} "), "_set", F.lit(f" {kind}")).alias("source_display"),
                "text",
            )
        )
    if found:
        # At most five rows per collection and question meet here.
        order = Window.partitionBy("question_id").orderBy("_place", "distance", "chunk_id")
        ranked = reduce(DataFrame.unionByName, found).withColumn("result_rank", F.row_number().over(order))
        parts.append(ranked.select(*columns))
    return reduce(DataFrame.unionByName, parts)
