"""Exact nearest chunks by cosine distance over centroid balls.

Chunks are dealt to the nearest of a bounded number of centres. A ball knows how many chunks it has and
the least and largest angle between them and its centre, so the angle between a question and its centre
bounds the distance of the question from every chunk of the ball. Every ball is a cell, or several if it is
large. Questions of near balls share a lane, which is held by one task while chunks pass by: a question
moves once a round, and a chunk once for each lane that its cell may matter to. A lane first meets the cells
of the balls of the least bounds of its questions, enough of them to hold k chunks, so that each question
learns a distance it has to beat; then it meets only the other cells whose bound does not exceed that for
one of them. A task keeps the k nearest so far of each question, and no other pairs leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators.ranking import top_per_group
from casemill.session import scratch_path

FILTERS = ("user_id", "user_scope", "category", "tags")
# The driver holds the centres, a row for each ball and the sample the centres come from.
MOST_BALLS, SAMPLE_ROWS = 4096, 16384
CELL_ROWS, LEAST_ROWS = 4096, 64
# Questions of a lane: as many as give LANES lanes, between these two numbers.
LANES, LEAST_QUESTIONS, LANE_QUESTIONS = 48, 256, 32_768
QUESTION_BATCH = 512
# Chunks that meet a batch of questions at once, so that their products stay near the processor; pairs whose distances are taken at once.
TILE, EXACT_PAIRS = 1024, 65_536
# Distances are kept to this many digits, below which only the noise of the arithmetic differs.
DISTANCE_DIGITS = 12
# Bounds give way by this much, far more than the rounding of angles.
SLACK = 1e-7
HITS = "question_id bigint, chunk_id string, document_key string, distance double"
_CHUNK = ("id", "document_key", "embedding", "user_id", "category", "tags", "shared")
_ASKED = ("id", "embedding", "user_id", "category", "tags", "own_only")


def written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _kind(df: DataFrame) -> str:
    return "array<float>" if dict(df.dtypes)["embedding"] == "array<float>" else "array<double>"


def unit(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return matrix / norms


def angles(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(points @ centres.T, -1.0, 1.0))


def centres_of(points: np.ndarray, many: int, rounds: int = 3) -> np.ndarray:
    """Centres from some points: each time the farthest from those chosen, then moved to the mean of their nearest points."""
    chosen, nearness = [0], points @ points[0]
    while len(chosen) < min(many, len(points)) and nearness.min() < 1 - 1e-9:
        chosen.append(int(nearness.argmin()))
        nearness = np.maximum(nearness, points @ points[chosen[-1]])
    centres = points[chosen]
    for _ in range(rounds):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres = np.where(filled[:, None], sums, centres)
        centres = unit(centres)
    return centres


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                points = unit(batch["embedding"])
                around = angles(points, centres)
                # The last ball is for zeros alone, however far others are from their centres, and for what is no number.
                some = points.any(axis=1) & np.isfinite(points).all(axis=1)
                near = around[:, :-1].argmin(axis=1) if len(centres) > 1 else 0
                ball = np.where(some, near, len(centres) - 1)
                angle = np.where(some, around[np.arange(len(batch)), ball], np.pi / 2)
                yield batch.assign(ball=ball.astype("int32"), angle=angle)

    return run


def chain(centres: np.ndarray) -> np.ndarray:
    """An order of the centres in which each is followed by the nearest one left."""
    left, order = np.ones(len(centres), bool), [0]
    while len(order) < len(centres):
        left[order[-1]] = False
        order.append(int(np.where(left, centres @ centres[order[-1]], -np.inf).argmax()))
    return np.array(order)


class _Balls:
    """What routing needs of the balls: centres, ranges of angles, sizes and cells. Travels with the tasks."""

    def __init__(self, centres: np.ndarray, rows: list):
        rows = sorted(rows, key=lambda r: r["ball"])
        rows = [rows[i] for i in chain(centres[[r["ball"] for r in rows]])]
        self.centres = centres[[r["ball"] for r in rows]]
        self.low, self.high, self.size = (np.array([r[c] for r in rows]) for c in ("low", "high", "n"))
        self.ball = np.array([r["ball"] for r in rows])
        self.parts = np.maximum(1, -(-self.size // CELL_ROWS))
        self.first = np.cumsum(self.parts) - self.parts
        self.cells = int(self.parts.sum())

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """Least possible distance of each point from the chunks of each ball."""
        around = angles(points, self.centres)
        gap = np.maximum(np.maximum(around - self.high, self.low - around), 0.0)
        bounds = 1.0 - np.cos(np.minimum(gap, np.pi)) - SLACK
        # Zeros are at distance 1 from everything, whatever the angles say.
        bounds[:, ~self.centres.any(axis=1)] = 1.0 - SLACK
        bounds[~points.any(axis=1)] = 1.0 - SLACK
        return bounds

    def first_visits(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """[points, balls]: the balls of the least bounds that hold k chunks together."""
        order = np.argsort(bounds, axis=1, kind="stable")
        held = np.cumsum(self.size[order], axis=1) - self.size[order]
        visited = np.zeros(bounds.shape, bool)
        np.put_along_axis(visited, order, held < k, axis=1)
        return visited

    def cells_of(self, visited: np.ndarray) -> np.ndarray:
        """The cells of the balls that any of the points visits."""
        balls = np.flatnonzero(visited.any(axis=0))
        return np.concatenate([np.arange(f, f + p) for f, p in zip(self.first[balls], self.parts[balls], strict=True)] or [np.arange(0)])


def _home(balls: _Balls):
    """Questions with the ball of the least bound, and of several the one with the nearest centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), QUESTION_BATCH):
                rows = batch.iloc[start : start + QUESTION_BATCH]
                points = unit(rows["embedding"])
                order = np.lexsort((angles(points, balls.centres), balls.bounds(points)), axis=1)
                yield rows.assign(home=order[:, 0].astype("int32"))

    return run


def _route(balls: _Balls, k: int, within: float | None, again: bool):
    """Lanes with the cells their questions visit: the first ones, or ``again`` those that may beat ``beat``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lane, rows in batch.groupby("lane", sort=False):
                for start in range(0, len(rows), QUESTION_BATCH):
                    some = rows.iloc[start : start + QUESTION_BATCH]
                    bounds = balls.bounds(unit(some["embedding"]))
                    visited = bounds <= some["beat"].to_numpy(np.float64)[:, None] if again else balls.first_visits(bounds, k)
                    if within is not None:
                        visited &= bounds <= within
                    yield pd.DataFrame({"cell": balls.cells_of(visited).astype("int64")}).assign(lane=lane)[["lane", "cell"]]

    return run


def _count(balls: _Balls, k: int, within: float | None):
    """Questions with the number of cells that their own bounds name in the two rounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), QUESTION_BATCH):
                rows = batch.iloc[start : start + QUESTION_BATCH]
                bounds = balls.bounds(unit(rows["embedding"]))
                open_ = bounds <= (np.inf if within is None else within)
                first = balls.first_visits(bounds, k) & open_
                later = ~first & open_ & (bounds <= rows["beat"].to_numpy(np.float64)[:, None])
                yield pd.DataFrame({"id": rows["id"], "a": first @ balls.parts, "b": later @ balls.parts})

    return run


def _tag_matrix(tags: pd.Series, place: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(tags), max(1, len(place))), np.float32)
    for row, names in enumerate(tags):
        for name in names if names is not None else ():
            if name in place:
                out[row, place[name]] = 1
    return out


def _codes(*columns: pd.Series) -> list[np.ndarray]:
    """Whole numbers that are equal where texts of the columns are; -1 for none."""
    codes = pd.factorize(pd.concat(columns, ignore_index=True))[0]
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def allowed(asked: pd.DataFrame, chunks: pd.DataFrame) -> np.ndarray:
    """[questions, chunks]: own chunks in private scope, shared or own ones otherwise; category equal, any tag shared."""
    mine, theirs = _codes(asked["user_id"], chunks["user_id"])
    mask = (mine[:, None] == theirs) & (theirs >= 0)
    mask |= ~asked["own_only"].eq(True).to_numpy(bool)[:, None] & chunks["shared"].eq(True).to_numpy(bool)
    wanted, given = _codes(asked["category"], chunks["category"])
    mask &= ((wanted < 0) | (asked["category"] == "").to_numpy(bool))[:, None] | (wanted[:, None] == given)
    place = {name: i for i, name in enumerate(sorted({name for names in asked["tags"] if names is not None for name in names}))}
    if place:
        tags = _tag_matrix(asked["tags"], place)
        mask &= ~tags.any(axis=1)[:, None] | (tags @ _tag_matrix(chunks["tags"], place).T > 0)
    return mask


def allowed_pairs(asked: pd.DataFrame, chunks: pd.DataFrame, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The values of ``allowed`` at some pairs."""
    mine, theirs = asked["user_id"].to_numpy(object)[rows], chunks["user_id"].to_numpy(object)[columns]
    mask = (mine == theirs) & ~pd.isna(theirs)
    mask |= ~asked["own_only"].eq(True).to_numpy(bool)[rows] & chunks["shared"].eq(True).to_numpy(bool)[columns]
    wanted, given = asked["category"].to_numpy(object)[rows], chunks["category"].to_numpy(object)[columns]
    mask &= pd.isna(wanted) | (wanted == "") | (wanted == given)
    tags = [frozenset(names) if names is not None else frozenset() for names in asked["tags"]]
    theirs = chunks["tags"].to_numpy(object)
    for i in np.flatnonzero(mask & np.array([bool(t) for t in tags], bool)[rows]):
        names = theirs[columns[i]]
        mask[i] = names is not None and not tags[rows[i]].isdisjoint(names)
    return mask


def _below(values: np.ndarray) -> np.ndarray:
    """Numbers of single precision that are less."""
    return np.nextafter(values.astype(np.float32), np.float32(-np.inf))


class _Passing:
    """Some chunks in the order of their ids, with their directions in double and in single precision."""

    def __init__(self, chunks: pd.DataFrame):
        chunks = chunks.sort_values("id", kind="stable")
        self.points = unit(chunks["embedding"])
        self.rough = self.points.astype(np.float32)
        self.chunks = chunks.drop(columns="embedding")
        self.ids, self.keys = chunks["id"].to_numpy(object), chunks["document_key"].to_numpy(object)


class _Block:
    """Some questions with the k nearest chunks so far.

    Products in single precision tell which pairs may be near enough, by more than their error; only these
    are looked at further, and their distances are taken in double precision.
    """

    def __init__(self, asked: pd.DataFrame, k: int, within: float | None):
        self.asked, self.k, self.unit = asked.drop(columns="embedding"), k, unit(asked["embedding"])
        self.rough = self.unit.astype(np.float32)
        # Rounded distances beyond the limit are of no use.
        self.limit = np.minimum(asked["beat"].fillna(np.inf).to_numpy(np.float64), np.inf if within is None else within)
        self.rows, self.near = np.zeros(0, np.int64), np.zeros(0)
        self.ids, self.keys = np.zeros(0, object), np.zeros(0, object)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        # A product of unit vectors is off by less than its length times the unit of rounding, here with room to spare.
        self.error = (self.unit.shape[1] + 8) * 2.0**-23

    def meet(self, passing: _Passing, filtered: bool) -> None:
        for start in range(0, len(passing.points), TILE):
            self._meet(passing, slice(start, start + TILE), filtered)

    def _meet(self, passing: _Passing, tile: slice, filtered: bool) -> None:
        likeness, tie, many = self.rough @ passing.rough[tile].T, 10.0**-DISTANCE_DIGITS, self.k * len(self.limit)
        width, floor = likeness.shape[1], 1.0 - self.limit - tie - self.error
        hits = np.flatnonzero(likeness >= _below(floor)[:, None])
        chosen = False
        if width > self.k and len(hits) > 4 * many:
            if filtered:
                likeness[~allowed(self.asked, passing.chunks.iloc[tile])] = -np.inf
            last = -np.partition(-likeness, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)
            floor = np.fmax(floor, last - 2 * self.error - 2 * tie)
            hits, chosen = np.flatnonzero((likeness >= _below(floor)[:, None]) & (likeness > -np.inf)), filtered
        if not len(hits):
            return
        rows, columns = np.divmod(hits, width)
        columns += tile.start
        if filtered and not chosen:
            open_ = allowed_pairs(self.asked, passing.chunks, rows, columns)
            rows, columns = rows[open_], columns[open_]
        near = np.empty(len(rows))
        for at in range(0, len(rows), EXACT_PAIRS):
            some = slice(at, at + EXACT_PAIRS)
            near[some] = 1.0 - np.einsum("ij,ij->i", self.unit[rows[some]], passing.points[columns[some]])
        near = np.round(near, DISTANCE_DIGITS)
        close = np.isfinite(near) & (near <= self.limit[rows])
        rows, columns, near = rows[close], columns[close], near[close]
        if not len(rows):
            return
        if len(rows) > many:  # many equal distances; the columns are in id order
            order = np.lexsort((columns, near, rows))
            order = order[np.arange(len(order)) - np.searchsorted(rows, rows, side="left") < self.k]
            rows, columns, near = rows[order], columns[order], near[order]
        self.waiting.append((rows, near, passing.ids[columns], passing.keys[columns]))
        if sum(len(w[0]) for w in self.waiting) >= many:
            self._settle()

    def _settle(self) -> None:
        """Keep the k nearest of those so far and of those that wait."""
        held = [(self.rows, self.near, self.ids, self.keys), *self.waiting]
        rows, near, ids, keys = (np.concatenate(columns) for columns in zip(*held, strict=True))
        self.waiting = []
        order = np.lexsort((near, rows))
        if ((rows[order][1:] == rows[order][:-1]) & (near[order][1:] == near[order][:-1])).any():
            order = np.lexsort((pd.factorize(ids, sort=True)[0], near, rows))  # ids settle equal distances
        rank = np.arange(len(order)) - np.searchsorted(rows[order], rows[order], side="left")
        last = order[rank == self.k - 1]
        self.limit[rows[last]] = near[last]
        order = order[rank < self.k]
        self.rows, self.near, self.ids, self.keys = rows[order], near[order], ids[order], keys[order]

    def found(self) -> pd.DataFrame:
        self._settle()
        numbers = self.asked["id"].astype("int64").to_numpy()
        return pd.DataFrame({"question_id": numbers[self.rows], "chunk_id": self.ids, "document_key": self.keys, "distance": self.near})


def _meet(k: int, filtered: bool, within: float | None):
    """Lanes one after the other: the questions of a lane first, which are held, then the chunks that pass by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, blocks = None, []
        for batch in batches:
            for lane, rows in batch.groupby("lane", sort=False):
                if lane != at:
                    yield from (block.found() for block in blocks)
                    at, blocks = lane, []
                asked, chunks = rows[~rows["is_chunk"]], rows[rows["is_chunk"]]
                blocks += [_Block(asked.iloc[i : i + QUESTION_BATCH], k, within) for i in range(0, len(asked), QUESTION_BATCH)]
                if len(chunks) and blocks:
                    passing = _Passing(chunks)
                    for block in blocks:
                        block.meet(passing, filtered)
        yield from (block.found() for block in blocks)

    return run


class _Round(NamedTuple):
    """Hits of a round, the questions in their lanes with the distance to beat, and the number of lanes."""

    hits: DataFrame
    asked: DataFrame
    lanes: int


class BallIndex:
    """Chunks in balls, to be asked for the nearest ones of many questions.

    Chunk rows without a vector take no part. The chunks are written twice, as they come and with their balls.
    """

    def __init__(self, chunks: DataFrame, filtered: bool = False):
        self.spark: SparkSession = chunks.sparkSession
        self.filtered = filtered
        columns = {
            "user_id": F.col("user_id").cast("string") if filtered else F.lit(None).cast("string"),
            "category": F.col("category").cast("string") if filtered else F.lit(None).cast("string"),
            "tags": F.col("tags").cast("array<string>") if filtered else F.lit(None).cast("array<string>"),
            "shared": F.coalesce(F.col("visibility") == "shared", F.lit(False)) if filtered else F.lit(True),
        }
        # Vectors of floats travel as such; all arithmetic is in doubles.
        self.kind = _kind(chunks)
        stored = chunks.filter("embedding IS NOT NULL").select(
            F.col("chunk_id").alias("id"), F.coalesce("parent_id", "filename").alias("document_key"), F.col("embedding").cast(self.kind).alias("embedding"),
            *[column.alias(name) for name, column in columns.items()],
        )
        stored = written(stored, "chunks")
        self.rows = stored.count()
        self.balls = None
        if not self.rows:
            return
        wide = max(min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.rows // LEAST_ROWS), 1)
        many = min(MOST_BALLS, max(-(-self.rows // CELL_ROWS), wide))
        some = stored.filter(F.pmod(F.xxhash64("id"), F.lit(-(-self.rows // SAMPLE_ROWS))) == 0).select("id", "embedding").limit(SAMPLE_ROWS)
        some = some.collect()
        points = unit([r["embedding"] for r in sorted(some, key=lambda r: r["id"])]) if some else np.zeros((0, 0))
        points = points[points.any(axis=1) & np.isfinite(points).all(axis=1)]
        if not len(points):  # one that has a direction, if there is any
            usable = F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: F.abs(x) < float("inf"))
            one = stored.filter(usable).select("embedding").head(1) or stored.select("embedding").head(1)
            points = unit([r["embedding"] for r in one])
            points = points[points.any(axis=1) & np.isfinite(points).all(axis=1)] if points.any() else points
        centres = centres_of(points, many) if points.any() and np.isfinite(points).all() else points[:0]
        centres = np.vstack([centres, np.zeros((1, points.shape[1]))])  # the last ball has the vectors of zeros
        placed = written(stored.mapInPandas(_assign(centres), f"{stored.schema.simpleString()[7:-1]}, ball: int, angle: double"), "balls")
        found = placed.groupBy("ball").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
        self.balls = balls = _Balls(centres, found)  # MOST_BALLS rows at most
        lookup = self.spark.createDataFrame([(int(b), int(f), int(p)) for b, f, p in zip(balls.ball, balls.first, balls.parts, strict=True)], "ball int, first long, parts long")
        dealt = placed.drop("angle").join(F.broadcast(lookup), "ball").withColumn("cell", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")))
        self.chunks = dealt.select("cell", *_CHUNK)

    def _asked(self, questions: DataFrame) -> DataFrame:
        wanted = {name: F.col(name) if self.filtered else F.lit(None) for name in ("user_id", "category", "tags")}
        own_only = F.col("user_scope") == "private" if self.filtered else F.lit(False)
        return questions.filter("embedding IS NOT NULL").select(
            F.col("question_id").cast("bigint").cast("string").alias("id"), F.col("embedding").cast(_kind(questions)).alias("embedding"),
            *[column.cast("array<string>" if name == "tags" else "string").alias(name) for name, column in wanted.items()],
            own_only.alias("own_only"),
        )

    def _in_lanes(self, questions: DataFrame) -> tuple[DataFrame, int]:
        """Questions, written once, with the lane of their ball; and how many lanes there are."""
        asked = self._asked(questions)
        asked = written(asked.mapInPandas(_home(self.balls), f"{asked.schema.simpleString()[7:-1]}, home: int"), "asked")
        sizes = asked.groupBy("home").agg(F.count("*").alias("n")).orderBy("home").collect()  # a row for each ball at most
        most = min(LANE_QUESTIONS, max(-(-sum(r["n"] for r in sizes) // LANES), LEAST_QUESTIONS))
        lanes, filled, rows = 0, most, []
        for r in sizes:
            if filled + r["n"] > most:
                lanes, filled, parts = lanes + -(-r["n"] // most), -(-r["n"] // -(-r["n"] // most)), -(-r["n"] // most)
                rows.append((r["home"], lanes - parts, parts))
            else:
                filled += r["n"]
                rows.append((r["home"], lanes - 1, 1))
        lookup = self.spark.createDataFrame(rows, "home int, from_lane int, parts int")
        lane = F.col("from_lane") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        return asked.join(F.broadcast(lookup), "home").withColumn("lane", lane).select("lane", *_ASKED), lanes

    def _meeting(self, asked: DataFrame, lanes: int, pairs: DataFrame, k: int, within: float | None) -> DataFrame:
        """The k nearest allowed chunks of each question among the cells that its lane meets."""
        shared = F.col("embedding").cast(_kind(asked) if _kind(asked) == self.kind else "array<double>").alias("embedding")
        none = {"document_key": "string", "shared": "boolean", "own_only": "boolean", "beat": "double"}
        columns = ["lane", "is_chunk", "id", "document_key", "user_id", "category", "tags", "shared", "own_only", "beat"]

        def side(df: DataFrame, is_chunk: bool) -> DataFrame:
            lacking = {name: F.lit(None).cast(kind) for name, kind in none.items() if name not in df.columns}
            return df.withColumns({**lacking, "is_chunk": F.lit(is_chunk)}).select(*columns, shared)

        # Lanes times cells at most, and small; cells that no lane visits stay where they are.
        met = side(asked, False).unionByName(side(self.chunks.join(F.broadcast(pairs), "cell"), True))
        met = met.repartitionById(lanes, F.col("lane")).sortWithinPartitions("lane", "is_chunk")
        return met.mapInPandas(_meet(k, self.filtered, within), HITS)

    def _rounds(self, questions: DataFrame, k: int, within: float | None) -> tuple[_Round, DataFrame, DataFrame]:
        """The first round, and the cells that each lane meets in it and after it."""
        asked, lanes = self._in_lanes(questions)

        def pairs(df: DataFrame, again: bool) -> DataFrame:
            return df.mapInPandas(_route(self.balls, k, within, again), "lane int, cell long").distinct()

        open_ = F.lit(within if within is not None else 2.0)
        if not lanes:
            nothing = self.spark.createDataFrame([], "lane int, cell long")
            return _Round(self.spark.createDataFrame([], HITS), asked.withColumn("beat", open_), 0), nothing, nothing
        first = written(pairs(asked, False), "pairs")
        hits = written(top_per_group(self._meeting(asked, lanes, first, k, within), ["question_id"], ["distance", "chunk_id"], k), "hits")
        known = hits.groupBy(F.col("question_id").cast("string").alias("id")).agg(F.count("*").alias("n"), F.max("distance").alias("last"))
        beats = asked.join(known, "id", "left").withColumn("beat", F.when(F.col("n") >= k, F.least("last", open_)).otherwise(open_)).drop("n", "last")
        return _Round(hits, beats, lanes), first, pairs(beats, True).join(F.broadcast(first), ["lane", "cell"], "left_anti")

    def nearest(self, questions: DataFrame, k: int, within: float | None = None) -> DataFrame:
        """question_id, chunk_id, document_key, distance: the k nearest chunks of each question, those ``within`` a distance if given.

        Equal distances go by chunk id. A question needs a bigint ``question_id`` and an ``embedding``; one without a
        vector gets nothing. An index with filters lets each question see only what its four filter columns allow.
        """
        if self.balls is None:
            return self.spark.createDataFrame([], HITS)
        known, _, other = self._rounds(questions, k, within)
        if not known.lanes:
            return known.hits
        later = self._meeting(known.asked, known.lanes, written(other, "pairs"), k, within)
        found = known.hits.select("question_id", "chunk_id", "document_key", "distance").unionByName(later)
        return top_per_group(found, ["question_id"], ["distance", "chunk_id"], k)

    def visits(self, questions: DataFrame, k: int, within: float | None = None) -> DataFrame:
        """question_id, cells, visited_first, visited_later: how many of the index's cells each question asks for."""
        if self.balls is None:
            return self.spark.createDataFrame([], "question_id long, cells long, visited_first long, visited_later long")
        known, _, _ = self._rounds(questions, k, within)
        counted = known.asked.select("id", "embedding", "beat").mapInPandas(_count(self.balls, k, within), "id string, a long, b long")
        return counted.select(
            F.col("id").cast("long").alias("question_id"), F.lit(self.balls.cells).cast("long").alias("cells"),
            F.col("a").alias("visited_first"), F.col("b").alias("visited_later"),
        )
