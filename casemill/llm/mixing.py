"""Mixing sources by temperature: weights are token shares to a power, realised as block permutations.

The exponent is found by nested bisection over sums that Spark takes over the sources, a row of sums
for a grid of exponents at a time, so sources are never gathered. A source's budget is whole epochs and a
rest. Documents are dealt by hash into blocks; blocks are permuted by another hash, and the rest takes
documents in that order until its tokens are used up. A copy's place in its source's sequence, as a share, is
its place in the mix, so every stretch of the mix has the target weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import free_name, settled

BLOCK_DOCS = 1024
MIX_BLOCK_TOKENS = 1 << 20
MOST_EXPONENT, GRID, ROUNDS = 8.0, 16, 6


def word_count(text: Column) -> Column:
    """Number of words, the tokens the mix counts by default; a null text has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"\S+")), F.lit(0)).cast("long")


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent: the sum of share**a, and the entropy of the normalised weights."""
    log = F.col("log_share")
    columns = []
    for i, a in enumerate(exponents):
        part = F.exp(F.lit(a) * log)
        columns += [F.sum(part).alias(f"z{i}"), F.sum(part * F.lit(a) * log).alias(f"e{i}")]
    row = shares.agg(*columns).first()
    return [(row[f"z{i}"], math.log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"]) for i in range(len(exponents))]


def find_exponent(shares: DataFrame, low_log: float, high_log: float, budget: float | None, entropy: float | None, most_repeat: float | None) -> tuple[float, float]:
    """The exponent and the sum of share**exponent.

    ``entropy`` asks for weights of that entropy (nats), ``most_repeat`` for the flattest weights that repeat
    no source more often; with both, the limit comes first. ``budget`` is in corpus sizes; None is the
    least that leaves no document out.
    """

    def too_flat(a: float, z: float, h: float) -> bool:
        size = budget if budget is not None else z * math.exp((1 - a) * (high_log if a <= 1 else low_log))
        # Repeats of a source are size * share**(a - 1) / z: the rarest source's most below 1, the largest's above.
        repeats = size / z * math.exp((a - 1) * (low_log if a <= 1 else high_log))
        over = most_repeat is not None and repeats > most_repeat * (1 + 1e-9)
        return over or (entropy is not None and h > entropy)

    low, high = 0.0, MOST_EXPONENT if entropy is not None else 1.0
    z_of = {}
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        found = _sums(shares, grid)
        flat = [too_flat(a, *s) for a, s in zip(grid, found, strict=True)]
        z_of = {a: s[0] for a, s in zip(grid, found, strict=True)}
        if not flat[0]:
            return low, z_of[low]
        cut = next((i for i, f in enumerate(flat) if not f), GRID)
        low, high = grid[cut - 1], grid[cut]
    return high, z_of[high]


def mix(
    docs: DataFrame, entropy: float | None = None, most_repeat: float | None = 2.0, budget: float | None = None, seed: int = 0,
    source: str = "source", tokens: Column | None = None, id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Every chosen copy of a row of ``docs`` with all its columns, and ``copy``, ``mix_block``, ``mix_order``, ``mix_tokens``.

    Weights are token shares to a power: see ``find_exponent``. With ``budget`` None every row is
    there once at least. Rows without source form a source of their own. A source without tokens is taken
    once as it is. Equal rows are chosen together or apart, each as a row of its own. Added columns take
    another name where docs has theirs. An empty table gives no rows. Sort by mix_block, mix_order to read the mix.
    """
    key, count, block, rank, copies, before = (free_name(docs, n) for n in ("mix_key", "mix_tokens", "mix_part", "mix_rank", "mix_copies", "mix_before"))
    copy, out_block, order = (free_name(docs, n) for n in ("copy", "mix_block", "mix_order"))
    counted = word_count(F.col(text)) if tokens is None else tokens.cast("long")
    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    mark = F.xxhash64(F.col(id_column), F.col(text), F.lit(seed))
    narrow = docs.select(named.alias("key"), counted.alias("tokens"), mark.alias("mark"))
    rows = narrow.agg(F.count("*")).first()[0]
    blocks = max(1, -(-rows // BLOCK_DOCS))
    part = F.pmod(F.col("mark"), F.lit(blocks))
    # A row for each source and block.
    parts = settled(narrow.groupBy("key", part.alias("part")).agg(F.sum("tokens").alias("tokens")), "parts")
    sizes = settled(parts.groupBy("key").agg(F.sum("tokens").alias("size")).filter("size > 0"), "sources")
    total, least, most = sizes.agg(F.sum("size"), F.min("size"), F.max("size")).first()
    if total:
        shares = sizes.select(F.log(F.col("size") / F.lit(float(total))).alias("log_share"))
        low_log, high_log = math.log(least / total), math.log(most / total)
        exponent, z = find_exponent(shares, low_log, high_log, budget, entropy, most_repeat)
        top = high_log if exponent <= 1 else low_log
        size = budget if budget is not None else z * math.exp((1 - exponent) * top)
    else:
        total, exponent, z, size = 1, 1.0, 1.0, 1.0
    share = F.col("size") / F.lit(float(total))
    repeats = sizes.withColumn("repeats", F.lit(size / z) * F.pow(share, F.lit(exponent - 1.0)))
    shuffled = Window.partitionBy("key").orderBy(F.xxhash64("part", F.lit(seed)), "part")
    placed = parts.withColumn("before", F.sum("tokens").over(shuffled.rowsBetween(Window.unboundedPreceding, -1)))
    places = placed.join(repeats, "key", "left").select(
        F.col("key").alias("of_key"), F.col("part").alias("of_part"), F.coalesce("before", F.lit(0)).alias("before"),
        F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("repeats", F.lit(1.0)).alias("repeats"),
    )
    full = docs.withColumns({key: named, count: counted, rank: mark}).withColumn(block, F.pmod(F.col(rank), F.lit(blocks)))
    inside = Window.partitionBy(key, block).orderBy(rank, id_column).rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn(before, F.coalesce(F.sum(count).over(inside), F.lit(0)))
    met = full.join(places.toDF(*(f"{key}_{c}" for c in places.columns)), (F.col(key) == F.col(f"{key}_of_key")) & (F.col(block) == F.col(f"{key}_of_part")))
    start, size_of, often = F.col(f"{key}_before") + F.col(before), F.col(f"{key}_size"), F.col(f"{key}_repeats")
    # An epoch's rest takes documents that end within it; rounding must not cost a whole epoch its last one.
    epochs = F.floor(often + F.lit(1e-9))
    rest = (often - epochs) * size_of
    taken = epochs + ((size_of > 0) & (start + F.col(count) <= rest)).cast("long")
    place = (F.col(copy) + F.when(size_of > 0, start / size_of).otherwise(F.lit(0.0))) / F.greatest(often, F.lit(1e-9))
    mix_blocks = max(1, math.ceil(size * total / MIX_BLOCK_TOKENS))
    return (
        met.withColumn(copies, taken.cast("int"))
        .filter(F.col(copies) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
        .withColumn(out_block, F.least(F.floor(place * mix_blocks), F.lit(mix_blocks - 1)).cast("long"))
        .withColumn(order, F.xxhash64(rank, copy))
        .select(*docs.columns, copy, out_block, order, count)
    )
