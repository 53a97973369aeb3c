"""Best-fit packing by minimum bin slack.

Each bin starts with the longest piece left. A bitset subset-sum recurrence over the lengths that
are still available finds the fullest sum that fits beside it; these pieces leave together. All that
the recurrence needs is how many pieces of each length are left, so it runs on a table of at most
``capacity`` counts, and a combination is used for as many bins at once as the counts allow. The
number of combinations depends on the capacity only, not on the documents. Spark cuts and counts
the pieces, ranks equal lengths and looks up the place of each rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import settled
from casemill.llm.tokens import encoder_of, read_tokenizer, with_end

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, rank_in_block long"


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and their uses whose sum is the largest that fits ``room``; longer ones are tried first."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        before, left, step = reach, min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            reach |= (reach << take * length) & mask
            left, step = left - take, step * 2
        if reach != before:
            steps.append((length, before))
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> total & 1:
            used[length] = used.get(length, 0) + 1
            total -= length
    return used


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The bins as (uses of each length, number of such bins), the longest pieces first."""
    left, bins = {n: c for n, c in counts.items() if c > 0}, []
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a piece has to have between one token and the capacity")
    for longest in sorted(left, reverse=True):
        while left[longest]:
            left[longest] -= 1
            uses = fullest(left, capacity - longest)
            left[longest] += 1
            uses[longest] = uses.get(longest, 0) + 1
            times = min(left[n] // u for n, u in uses.items())
            for n, u in uses.items():
                left[n] -= u * times
            bins.append((uses, times))
    return bins


def places(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """For each length and range of ranks: the first bin, pieces of the length in each bin, and their offset."""
    rows, taken, base = [], dict.fromkeys(counts, 0), 0
    for uses, times in combinations(counts, capacity):
        offset = 0
        for length in sorted(uses, reverse=True):
            rows.append((length, taken[length], taken[length] + uses[length] * times, base, uses[length], offset))
            taken[length] += uses[length] * times
            offset += uses[length] * length
        base += times
    return pd.DataFrame(rows, columns=["of_length", "from_rank", "to_rank", "first_bin", "in_bin", "at"])


def _cutter(tokenizer_json: str, capacity: int, end_id: int):
    names = [f.split(" ")[0] for f in PIECE_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches):
        encoder, block = encoder_of(tokenizer_json), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            ids, counts = with_end(*encoder.column(batch.column("text")), end_id)
            wide = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            pieces = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(capacity, counts[doc] - piece * capacity)
            first = (np.cumsum(counts) - counts)[doc] + piece * capacity
            crc = [zlib.crc32(wide[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
            rank = met[length] + pd.Series(length).groupby(length).cumcount().to_numpy()
            met += np.bincount(length, minlength=capacity + 1)
            columns = [batch.column("doc_id").take(pa.array(doc)), piece, piece * capacity, length, crc,
                       np.full(len(doc), block), rank]
            yield pa.RecordBatch.from_arrays(
                [c.cast(k) if isinstance(c, pa.Array) else pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)],
                names=names,
            )

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Token pieces of whole texts: ids without special tokens, then ``end_id``; only longer ones are cut.

    ``block`` is the task that met the piece and ``rank_in_block`` counts the pieces of its length
    there, so that ranks need no window over a length that many documents share.
    """
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(_cutter(read_tokenizer(tokenizer_path), capacity, end_id), PIECE_SCHEMA)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have ``length``, ``block`` and ``rank_in_block``.

    ``pieces`` must be settled: the counts and the placing read it apart. Equal lengths may hold any
    share of the rows; their ranks come from per-task counts. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    per_block = pieces.groupBy("length", "block").count()
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select(
        F.col("length").alias("of_length"), F.col("block").alias("of_block"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ranks_before"),
    )
    # At most `capacity` rows reach the driver.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    schema = pa.schema([(n, pa.int64()) for n in ("of_length", "from_rank", "to_rank", "first_bin", "in_bin", "at")])
    # A few rows for each length, whatever the input: bounded by the capacity. As an Arrow table, they start no Python on the executors.
    found = F.broadcast(spark.createDataFrame(pa.Table.from_pandas(places(counts, capacity), schema, preserve_index=False)))
    ranked = pieces.join(
        starts, (F.col("length") == F.col("of_length")) & (F.col("block") == F.col("of_block")), "inner"
    ).select(*pieces.columns, (F.col("ranks_before") + F.col("rank_in_block")).alias("rank"))
    nth = F.col("rank") - F.col("from_rank")
    return ranked.join(
        found, (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    ).select(
        *pieces.columns,
        (F.col("first_bin") + F.expr("(rank - from_rank) div in_bin")).alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("in_bin")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    A null text counts as empty and gives one piece with the end id alone. Rows that repeat, equal or
    null ids are packed one by one like any others. Further columns are not read. Each row of the
    result is a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    packed = pack(settled(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
    return packed.drop("block", "rank_in_block")
