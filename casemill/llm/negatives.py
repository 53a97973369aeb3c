"""Hard negatives by a vertical scan of columnar vectors (branch and bound on dimensions).

Candidates lie in blocks; a block keeps one column of numbers for each dimension, and the least and
largest number of each. An anchor reads the columns in the descending order of its own components'
magnitudes. After each few columns, what the rest can still add to a score lies between sums of least
and largest contributions, so each candidate has a range for its score; candidates whose range can no
longer matter leave the bitmap, and the next columns are read for the others alone.

A first scan, over the blocks that hold the anchor's label, finds its positives. Each positive opens a
window of scores; a second scan, over the other blocks, finds the best rows within the windows.

Labels are dealt in pieces of about ``PIECE_ROWS`` rows, pieces into blocks of about ``BLOCK_ROWS``. Anchors travel
to the blocks; a block is copied once for each ``LANE_ANCHORS`` anchors, so that no task meets all anchors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import settled

BLOCK_ROWS, PIECE_ROWS, LANE_ANCHORS = 8192, 2048, 8192
COLUMNS_READ = 8
MOST_TASKS = 20_000
EXACT = 1 << 53
# Scores that doubles may not hold exactly are Python's numbers in tasks and decimals between them.
WIDE, WIDEST = "decimal(38,0)", 10**38 - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _whole(scale: int):
    def run(batches):
        for batch in batches:
            ids, labels, out = [], [], []
            rows = (batch.column(n).to_pylist() for n in ("vec_id", "label"))
            for vec_id, label, vector in zip(*rows, batch.column("vector"), strict=True):
                values = vector.values
                if values is None or values.null_count:
                    continue
                floats = values.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore"):
                    whole = np.floor(scale * floats)
                if np.isfinite(floats).all():
                    ids.append(vec_id)
                    labels.append(label)
                    out.append(np.nan_to_num(whole).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "label", "vector"]
            )

    return run


def _measures(batches):
    for batch in batches:
        rows = [np.frombuffer(v, "<f8") for v in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(r) for r in rows], pa.int32()), pa.array([float(np.abs(r).max(initial=0)) for r in rows], pa.float64())],
            names=["width", "most"],
        )


def stacked(packed: list[bytes], width: int, exact: bool) -> np.ndarray:
    """Rows of whole numbers; shorter vectors have zeros behind. Beyond 53 bits the numbers are Python's."""
    out = np.zeros((len(packed), width))
    for i, raw in enumerate(packed):
        out[i, : len(raw) // 8] = np.frombuffer(raw, "<f8")
    return out if exact else np.array([[int(x) for x in row] for row in out], dtype=object).reshape(out.shape)


class Block:
    """Candidates of a block, a column for each dimension."""

    def __init__(self, row_ids, ids, labels, rows: np.ndarray):
        order = np.lexsort((row_ids, ids))  # by id, so that a stable order by score settles ties
        self.row_ids, self.ids, self.labels = (np.asarray(x, np.int64)[order] for x in (row_ids, ids, labels))
        self.columns = np.ascontiguousarray(rows[order].T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)


def scan(block: Block, anchor: np.ndarray, alive: np.ndarray, needed: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Places that stay needed, and their exact scores. ``needed`` tells which, from the least and largest possible scores."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    order = order[anchor[order] != 0]
    ends = np.stack([anchor * block.low, anchor * block.high])
    least, largest = ends.min(axis=0)[order], ends.max(axis=0)[order]
    rest_low, rest_high = (np.concatenate([np.cumsum(x[::-1])[::-1], np.zeros(1, x.dtype)]) for x in (least, largest))
    live = np.nonzero(alive)[0]
    part = np.zeros(len(live), dtype=anchor.dtype)
    every = len(live) == len(alive)
    for at in range(0, len(order), COLUMNS_READ):
        dims = order[at : at + COLUMNS_READ]
        columns = block.columns[dims] if every else block.columns[np.ix_(dims, live)]
        part = part + anchor[dims] @ columns
        to = min(at + COLUMNS_READ, len(order))
        keep = needed(part + rest_low[to], part + rest_high[to])
        if not keep.all():
            live, part, every = live[keep], part[keep], False
            if not len(live):
                break
    if not len(order):
        keep = needed(part, part)
        live, part = live[keep], part[keep]
    return live, part


def kth(values: np.ndarray, k: int):
    """The k-th largest value, None if there are fewer."""
    if len(values) < k:
        return None
    return np.partition(values, len(values) - k)[len(values) - k] if values.dtype != object else sorted(values)[-k]


def best(block: Block, anchor: np.ndarray, alive: np.ndarray, k: int):
    """The k largest scores, ties to smaller ids."""

    def needed(low, high):
        cut = kth(low, k)
        return np.ones(len(low), bool) if cut is None else high >= cut

    live, scores = scan(block, anchor, alive, needed)
    first = np.argsort(-scores, kind="stable")[:k]
    return live[first], scores[first]


def best_within(block: Block, anchor: np.ndarray, alive: np.ndarray, windows: list[tuple], k: int):
    """For each window of scores, the k largest in it, ties to smaller ids."""

    def needed(low, high):
        keep = np.zeros(len(low), bool)
        for a, b in windows:
            cut = kth(low[(low >= a) & (high <= b)], k)
            keep |= (low <= b) & (high >= (a if cut is None else max(a, cut)))
        return keep

    live, scores = scan(block, anchor, alive, needed)
    found = []
    for a, b in windows:
        inside = np.nonzero((scores >= a) & (scores <= b))[0]
        first = inside[np.argsort(-scores[inside], kind="stable")[:k]]
        found.append((live[first], scores[first]))
    return found


def window(score: int, least: int, most: int) -> tuple[int, int]:
    """Least and largest whole number between ``least`` and ``most`` hundredths of a score; none for one below zero."""
    return (-(-score * least // 100), score * most // 100) if score >= 0 else (1, 0)


def _meet(width: int, exact: bool, k: int, limits: tuple[int, int] | None):
    """Rows of a block come before the anchors that meet it. Gives (anchor's row, window, candidate, score)."""
    names = ("block", "lane", "part", "row_id", "vec_id", "label", "vector", "scores")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if exact else pa.decimal128(38, 0))

    def batch_of(found):
        columns = list(zip(*found, strict=True)) or [[]] * 5
        columns[4] = [max(-WIDEST, min(WIDEST, int(s))) for s in columns[4]]
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["row_id", "part", "other_row", "vec_id", "score"])

    def met(block, row_id, vec_id, label, raw, scores):
        anchor, others = stacked([raw], width, exact)[0], block.ids != vec_id
        if limits is None:
            got = [best(block, anchor, others & (block.labels == label), k)]
        else:
            got = best_within(block, anchor, others & (block.labels != label), [window(int(s), *limits) for s in scores], k)
        for part, (places, values) in enumerate(got):
            for place, value in zip(places.tolist(), values.tolist(), strict=True):
                yield row_id, part, int(block.row_ids[place]), int(block.ids[place]), value

    def run(batches):
        at, held, block = None, [], None
        for batch in batches:
            found = []
            for number, lane, part, *row, scores in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if (number, lane) != at:
                    at, held, block = (number, lane), [], None
                if part == 0:
                    held.append(row)
                    continue
                if held:
                    row_ids, ids, labels, raws = zip(*held, strict=True)
                    block, held = Block(row_ids, ids, labels, stacked(raws, width, exact)), []
                if block is not None:
                    found.extend(met(block, *row, scores))
                if len(found) >= 50_000:
                    yield batch_of(found)
                    found = []
            yield batch_of(found)

    return run


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
    scale: int = 256, id_column: str = "vec_id", label_column: str = "label", column: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * x). An anchor's positives are its ``positives`` best other rows of the
    same label; for each, the ``negatives`` best rows of other labels whose score lies between ``least`` and ``most``
    hundredths of the positive's. Ties go to smaller ids. ``is_anchor`` is an expression
    over ``vec_id``.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; shorter vectors have zeros
    behind. Rows that share an id are rows of their own, but none is a positive or negative of another. Further
    columns are not read. A positive of a score below zero has an empty window. Scores are exact; a result beyond 64
    bits is shown as the largest or least long. An empty table, and one without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    wanted = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), F.col(column).cast("array<double>").alias("vector")
    ).filter("vec_id is not null and label is not null and vector is not null")
    whole = wanted.mapInArrow(_whole(scale), "vec_id long, label long, vector binary")
    rows = settled(whole.select(F.monotonically_increasing_id().alias("row_id"), "*"), "vectors")
    anchors = rows.filter(is_anchor)
    width, top, total = rows.mapInArrow(_measures, "width int, most double").agg(F.max("width"), F.max("most"), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], RESULT)
    width = max(1, width)
    exact = width * top * top < EXACT
    number, blocks, lanes = "long" if exact else WIDE, -(-total // BLOCK_ROWS), max(1, -(-anchors.count() // LANE_ANCHORS))

    def block_of(piece):
        return F.pmod(F.xxhash64("label", piece), F.lit(blocks))

    pieces = rows.groupBy("label").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("long").alias("pieces"))
    placed = rows.join(pieces, "label").withColumn("block", block_of(F.pmod(F.xxhash64("row_id"), F.col("pieces"))))
    placed = settled(placed.select("block", "row_id", "vec_id", "label", "vector"), "blocks")
    none = F.lit(None).cast(f"array<{number}>").alias("scores")
    lane = F.pmod(F.xxhash64("row_id"), F.lit(lanes)).cast("int").alias("lane")

    def meeting(asked: DataFrame, k: int, limits) -> DataFrame:
        copies = placed.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        held = copies.select("block", "lane", F.lit(0).alias("part"), "row_id", "vec_id", "label", "vector", none)
        cells = min(MOST_TASKS, 4 * blocks * lanes)  # some room, since cells are dealt by hash
        met = held.unionByName(asked).repartition(cells, "block", "lane").sortWithinPartitions("block", "lane", "part")
        return met.mapInArrow(_meet(width, exact, k, limits), f"row_id long, part int, other_row long, vec_id long, score {number}")

    def ranked(found: DataFrame, most: int) -> DataFrame:
        order = Window.partitionBy("row_id", "part").orderBy(F.desc("score"), "vec_id", "other_row")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    homes = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), block_of))
    asked = anchors.join(pieces, "label").select(F.explode(homes).alias("block"), lane, F.lit(1).alias("part"), "row_id", "vec_id", "label", "vector", none)
    near = ranked(meeting(asked, positives, None), positives).select("row_id", (F.col("rank") - 1).alias("part"), F.col("vec_id").alias("positive_id"), "score")
    near = settled(near, "positives")
    known = near.groupBy("row_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "score"))), lambda x: x["score"]).alias("scores"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1))).alias("block")
    asked = anchors.join(known, "row_id").select(every, lane, F.lit(1).alias("part"), "row_id", "vec_id", "label", "vector", "scores")
    found = ranked(meeting(asked, negatives, (least, most)), negatives).select("row_id", "part", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative"))

    def shown(score: str):
        return F.least(F.lit((1 << 63) - 1), F.greatest(F.lit(-(1 << 63)), F.col(score))).cast("long") if not exact else F.col(score)

    return (
        found.join(near, ["row_id", "part"])
        .join(anchors.select("row_id", F.col("vec_id").alias("anchor_id")), "row_id")
        .select("anchor_id", "positive_id", "rank", "negative_id", shown("score").alias("positive_score"), shown("negative").alias("negative_score"))
    )
