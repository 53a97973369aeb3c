"""Exact top-k by inner product with a pivot table.

An extra component makes all candidates equally long, so that a larger inner product is a smaller
distance. Distances from every candidate to ``PIVOTS`` pivots are computed once. The largest
difference between a query's and a candidate's distance to a pivot bounds their distance from
below. Candidates are dealt into blocks around the pivots; each block also keeps the range of its
distances. A query first meets its own block and so learns a score it has to beat, then only the
blocks whose range admits that score. In a block, candidates are scored in the order of their
bounds until no bound can reach the k-th best score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import settled

PIVOTS, PIVOT_SAMPLE = 32, 4096
BLOCK_ROWS, MOST_BLOCKS = 4096, 4096  # beyond BLOCK_ROWS * MOST_BLOCKS rows the blocks grow
STEP = 512
NONE, MOST_SCORE = -(1 << 63), (1 << 63) - 1
MOST_SQUARE = 1e60  # beyond it distances leave the range they are stored in, and nothing is spared
MEETING = "block int, is_query boolean, vec_id long, vector binary, near binary, beat long"
FOUND = "query_id long, vec_id long, score long"


def _integers(scale: int):
    def run(batches):
        for batch in batches:
            ids, out = [], []
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("vector"), strict=True):
                values = vector.values
                if vec_id is None or values is None or values.null_count:
                    continue
                floats = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(floats).all():
                    continue
                whole = np.floor(scale * floats)
                if not np.isfinite(whole).all():
                    continue
                ids.append(vec_id)
                out.append(whole.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vector"])

    return run


def integer_vectors(vectors: DataFrame, id_column: str, column: str, scale: int, k: int) -> DataFrame:
    """vec_id and floor(scale * x) as packed doubles, which hold these whole numbers exactly, for all finite vectors.

    Of rows with one id and equal vectors ``k`` go on: more can't be among the k best of a query.
    """
    wanted = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    rows = wanted.filter("vec_id is not null and vector is not null").mapInArrow(_integers(scale), "vec_id long, vector binary")
    counted = rows.groupBy("vec_id", "vector").agg(F.count("*").alias("many"))
    return counted.select("vec_id", "vector", F.explode(F.sequence(F.lit(1).cast("long"), F.least("many", F.lit(k).cast("long")))).alias("copy"))


def stacked(packed: list[bytes], width: int) -> np.ndarray:
    """Rows of integers as doubles; shorter vectors have zeros behind."""
    out = np.zeros((len(packed), width))
    for i, raw in enumerate(packed):
        out[i, : len(raw) // 8] = np.frombuffer(raw, "<f8")
    return out


def lengthened(rows: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that brings their squared length to ``most``."""
    return np.hstack([rows, np.sqrt(np.maximum(0.0, most - (rows * rows).sum(axis=1)))[:, None]])


def farthest_first(points: np.ndarray, many: int) -> np.ndarray:
    chosen, far = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(many, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(0.0, square)).astype("<f4")


def _measure(pivots: np.ndarray, width: int, most: float):
    def run(batches):
        for batch in batches:
            near = distances(lengthened(stacked(batch.column("vector").to_pylist(), width), most), pivots)
            cell = near.argmin(axis=1) if len(near) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), pa.array([d.tobytes() for d in near], pa.binary()), pa.array(cell, pa.int32())],
                names=["vec_id", "vector", "near", "cell"],
            )

    return run


def _as_queries(pivots: np.ndarray, width: int):
    """Distances of queries to the pivots; a query's extra component is zero."""

    def run(batches):
        for batch in batches:
            points = stacked(batch.column("vector").to_pylist(), width)
            near = distances(np.hstack([points, np.zeros((len(points), 1))]), pivots)
            place = batch.schema.get_field_index("near")
            yield batch.set_column(place, "near", pa.array([d.tobytes() for d in near], pa.binary()))

    return run


def _ranges(batches):
    """Least and largest distance to each pivot of the blocks a task has met."""
    met: dict[int, list] = {}
    for batch in batches:
        near = np.array([np.frombuffer(d, "<f4") for d in batch.column("near").to_pylist()])
        blocks = np.asarray(batch.column("block"))
        for block in np.unique(blocks):
            rows = near[blocks == block]
            low, high = met.setdefault(int(block), [rows.min(axis=0), rows.max(axis=0)])
            met[int(block)] = [np.minimum(low, rows.min(axis=0)), np.maximum(high, rows.max(axis=0))]
    rows = [(b, p, float(low[p]), float(high[p])) for b, (low, high) in met.items() for p in range(len(low))]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "pivot", "low", "high"])


def highest(square: float, most: float, least_distance: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner product; the slack covers the rounding of the stored distances."""
    if not most < MOST_SQUARE:
        return np.full(least_distance.shape, np.inf)
    return (square + most - least_distance.astype(np.float64) ** 2) / 2 + 1e-5 * (square + most) + 1e-3


def _route(blocks: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, most: float):
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for row in rows:
                near, vector = np.frombuffer(row["near"], "<f4"), np.frombuffer(row["vector"], "<f8")
                gap = np.maximum(np.maximum(low - near, near - high), 0).max(axis=1)
                for block in blocks[(highest(float(vector @ vector), most, gap) >= row["beat"]) & (blocks != row["block"])]:
                    out.append({**row, "block": int(block)})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return run


def score_block(query_id, vector, near, beat, ids, points, table, most, k, whole):
    """The k best (ids, scores) of a block that reach ``beat``; candidates come in the order of their bounds."""
    bound = highest(float(vector @ vector), most, np.abs(table - near).max(axis=1))
    order = np.nonzero((bound >= beat) & (ids != query_id))[0]
    order = order[np.argsort(-bound[order], kind="stable")]
    best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(order), STEP):
        if bound[order[at]] < beat:
            break
        part = order[at : at + STEP]
        if whole:
            exact = (sum(int(x) * int(y) for x, y in zip(points[i], vector, strict=True)) for i in part)
            scores = np.array([max(NONE, min(MOST_SCORE, x)) for x in exact], np.int64)
        else:
            scores = (points[part] @ vector).astype(np.int64)
        hit = scores >= beat
        best_ids, best = np.concatenate([best_ids, ids[part][hit]]), np.concatenate([best, scores[hit]])
        keep = np.lexsort((best_ids, ~best))[:k]
        best_ids, best = best_ids[keep], best[keep]
        if len(best) == k:
            beat = max(beat, int(best[-1]))
    return best_ids, best


def _meet(width: int, most: float, k: int, whole: bool):
    def run(batches):
        block, held, built = None, [], None
        for batch in batches:
            names = ("block", "is_query", "vec_id", "vector", "near", "beat")
            found = [[], [], []]
            for at, is_query, vec_id, raw, near, beat in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if at != block:
                    block, held, built = at, [], None
                if not is_query:
                    held.append((vec_id, raw, near))
                    continue
                if not held:
                    continue
                if built is None:
                    ids, raws, nears = zip(*held, strict=True)
                    built = np.array(ids, np.int64), stacked(raws, width), np.array([np.frombuffer(d, "<f4") for d in nears])
                got = score_block(vec_id, stacked([raw], width)[0], np.frombuffer(near, "<f4"), beat, *built, most, k, whole)
                for column, values in zip(found, ([vec_id] * len(got[0]), got[0].tolist(), got[1].tolist()), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame, is_query, k: int = 20, scale: int = 64, id_column: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products, ties to smaller ids.

    Queries are the rows for which ``is_query``, an expression over ``vec_id``, holds; candidates are all
    rows but the query's own. Vectors that are null or hold null or non-finite components, and rows without
    id, take no part; a shorter vector counts as having zeros behind. Rows that share an id all count, as candidates of
    others and, if the id is a query, as one query with the k best scores of all of them. A scaled component may be of any
    size that a double holds; a score beyond 64 bits becomes the nearest number that fits.
    Further columns are not read. An empty table, or no query, gives no rows.
    """
    spark = vectors.sparkSession
    rows = settled(integer_vectors(vectors, id_column, column, scale, k), "vectors")
    sample = [r["vector"] for r in rows.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(PIVOT_SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    norms = rows.mapInArrow(_norms, "width int, square double")
    width, most = norms.agg(F.max("width"), F.max("square")).first()
    width, whole = max(1, width), most >= 1 << 52
    pivots = farthest_first(lengthened(stacked(sample, width), most), PIVOTS)
    table = settled(rows.mapInArrow(_measure(pivots, width, most), "vec_id long, vector binary, near binary, cell int"), "pivots")
    cells = {r["cell"]: r["n"] for r in table.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each pivot
    room = max(BLOCK_ROWS, -(-sum(cells.values()) // MOST_BLOCKS))
    parts = {c: -(-n // room) for c, n in sorted(cells.items())}
    first = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist(), strict=False))
    lookup = spark.createDataFrame([(c, first[c], parts[c]) for c in parts], "of_cell int, first_block int, parts int")
    dealt = table.join(F.broadcast(lookup), F.col("cell") == F.col("of_cell"))  # a row for each pivot
    dealt = dealt.withColumn("block", (F.col("first_block") + F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts"))).cast("int"))
    ranges = dealt.select("block", "near").mapInArrow(_ranges, "block int, pivot int, low double, high double")
    # MOST_BLOCKS + PIVOTS blocks at most, a row for each of their pivots.
    bounds = ranges.groupBy("block", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("block", "pivot").toPandas()
    blocks = bounds["block"].unique().astype(np.int64)
    low, high = (bounds[c].to_numpy().reshape(len(blocks), len(pivots)) for c in ("low", "high"))

    def meeting(asked: DataFrame) -> DataFrame:
        held = dealt.select("block", F.lit(False).alias("is_query"), "vec_id", "vector", "near", F.lit(NONE).cast("long").alias("beat"))
        met = held.union(asked.select(*held.columns)).repartition("block").sortWithinPartitions("block", "is_query")
        return met.mapInArrow(_meet(width, most, k, whole), FOUND)

    asked = dealt.filter(is_query).select("block", F.lit(True).alias("is_query"), "vec_id", "vector", "near", F.lit(NONE).cast("long").alias("beat"))
    asked = settled(asked.mapInArrow(_as_queries(pivots, width), MEETING), "queries")
    near = settled(meeting(asked), "near")
    known = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("many"))
    beats = asked.drop("beat").join(known, F.col("vec_id") == F.col("query_id"), "left").select(
        "block", "is_query", "vec_id", "vector", "near",
        F.when(F.col("many") == k, F.col("least")).otherwise(F.lit(NONE)).cast("long").alias("beat"),
    )
    routed = beats.mapInArrow(_route(blocks, low, high, width, most), MEETING)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = near.union(meeting(routed)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _norms(batches):
    for batch in batches:
        rows = [np.frombuffer(v, "<f8") for v in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(r) for r in rows], pa.int32()), pa.array([float(r @ r) for r in rows], pa.float64())], names=["width", "square"]
        )
