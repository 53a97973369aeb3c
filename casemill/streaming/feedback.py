"""Feedback fold as a stream."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casemill.operators.feedback import apply_feedback, latest_feedback
from casemill.sources import files

# After so many batches a stream folds what it has written into one folder with a row for each pair.
FOLD_EVERY = 32
_CHANGE = "question string, sql string, value int, ts timestamp, event_id bigint"


def _votes(feedback: DataFrame) -> DataFrame:
    return feedback.selectExpr(
        "question", "sql", "CAST(value AS int) AS value", "CAST(ts AS timestamp) AS ts", "CAST(event_id AS bigint) AS event_id"
    )


def changes(votes: DataFrame, known: DataFrame) -> DataFrame:
    """The newest vote of each pair of a batch that is newer than the known one, whatever order votes come in.

    An older or repeated vote gives no row. Both sides are joined as tables, so pairs are held by no task's memory.
    """
    order = F.struct("ts", "event_id")
    last = known.groupBy("question", "sql").agg(F.max(order).alias("_known"))
    last = last.withColumnsRenamed({"question": "_question", "sql": "_sql"})
    same = F.col("question").eqNullSafe(F.col("_question")) & F.col("sql").eqNullSafe(F.col("_sql"))
    newer = F.col("_known").isNull() | (order > F.col("_known"))
    return latest_feedback(votes).join(last, same, "left").filter(newer).select("question", "sql", "value", "ts", "event_id")


def start_feedback(feedback: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Fold streamed feedback ``(question, sql, value, ts, event_id)`` into the newest vote of each pair.

    A batch writes only the pairs it changes against what its stream has written before, under an id kept in the
    checkpoint and its batch number; a repeated batch replaces its own files, and a second stream on the path has other ids. Every ``FOLD_EVERY`` batches the
    stream writes one folder in place of its earlier ones, which go at the next such time, so that readers
    under way keep their files. A read costs the pairs and the changes of a few batches, not the history.
    """
    spark = feedback.sparkSession
    stream = files.kept_id(spark, f"{checkpoint}/stream-id")

    def write(rows: DataFrame, name: str) -> None:
        rows.select("question", "sql", "value", "ts", "event_id", F.lit(name).alias("batch_id")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(path)

    def fold(batch: DataFrame, batch_id: int) -> None:
        own = f"{stream}-{batch_id}"
        # What an earlier try of this batch has written is not known yet; this one writes it again.
        earlier = [place for place in _folders(spark, path).get(stream, {"live": []})["live"] if not place.endswith(f"batch_id={own}")]
        write(changes(batch, _read(spark, earlier)), own)
        if batch_id % FOLD_EVERY != FOLD_EVERY - 1:
            return
        before = _folders(spark, path).get(stream, {"live": [], "gone": []})
        write(latest_feedback(_read(spark, before["live"])), f"{stream}-fold{batch_id}")
        for place in before["gone"]:
            files.delete(spark, place)

    return (
        _votes(feedback)
        .writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _folders(spark: SparkSession, path: str) -> dict[str, dict[str, list[str]]]:
    """For each stream, the folders that count and those its newest fold stands for; by their names."""
    found: dict[str, list[tuple[int, bool, str]]] = {}
    for place in files.matching(spark, f"{path}/batch_id=*"):
        stream, mark, number = re.fullmatch(r"(.*?)-?(fold)?(-?\d*)", place.rstrip("/").split("/batch_id=")[-1]).groups()
        found.setdefault(stream, []).append((int(number or 0), bool(mark), place))
    out = {}
    for stream, places in found.items():
        last = max((number for number, folded, _ in places if folded), default=None)
        live = [p for number, folded, p in places if last is None or number > last or (folded and number == last)]
        out[stream] = {"live": live, "gone": [p for _, _, p in places if p not in live]}
    return out


def _read(spark: SparkSession, places: list[str]) -> DataFrame:
    return spark.read.schema(_CHANGE).parquet(*sorted(places)) if places else spark.createDataFrame([], _CHANGE)


def newest_votes(spark: SparkSession, path: str) -> DataFrame:
    """question, sql, value, ts, event_id of the newest vote of each pair over all streams of the path."""
    return latest_feedback(_read(spark, [place for found in _folders(spark, path).values() for place in found["live"]]))


def current_pairs(spark: SparkSession, store: DataFrame, path: str) -> DataFrame:
    """The store after all folded feedback; the same table the batch form gives."""
    return apply_feedback(store, newest_votes(spark, path))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the newest votes of all streams of a path as one folder of another path."""
    newest_votes(spark, path).withColumn("batch_id", F.lit("folded")).write.partitionBy("batch_id").parquet(target)
