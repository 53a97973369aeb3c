"""Near duplicates: an inverted join over MinHash coordinates, confirmed on the full shingle sets.

1. A task hashes the five-word shingles of whole texts and takes the minimum under ``COORDINATES``
   functions. Texts with equal shingle sets become one node before anything is joined.
2. A coordinate and its value form a posting key. Keys are counted over all nodes; keys of one node
   link nothing. A node that shares fewer than ``MATCHES`` keys is done.
3. Keys are ordered by count, rare first. Two nodes that agree on ``MATCHES`` coordinates meet in the
   prefix of that order which leaves out ``MATCHES - 1`` keys, so only prefixes are posted.
4. Under each posted key the most central node, that with the largest sum of key counts, meets all others.
   Collisions are counted by merging sorted keys with skips; pairs with ``MATCHES`` or more are compared on
   their full sets.
5. Nodes that are still apart and whose keys have the same central node form a family. A family is cut into
   blocks, any two of which meet in one task; it counts collisions and compares full sets there, and gives
   out links alone. So no link is lost, and a group of copies is not expanded into its pairs.

A pair at the limit of 0.75 has fewer than ``MATCHES`` of ``COORDINATES`` collisions with a
probability below 1e-6. Set identities are 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm import words
from casemill.llm.common import settled, slices
from casemill.llm.components import components

COORDINATES, MATCHES = 96, 50
SHARE = 75  # per cent
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
COLUMNS = 4096
SLICE_BYTES = 1 << 20
SIGNED = "doc_id long, node long, n_shingles long, signature array<int>"


def distinct_sets(texts: pa.Array, powers: words.Powers) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their numbers."""
    found, many = words.shingles(texts, powers)
    ends, sets = np.cumsum(many), []
    for a, b in zip((ends - many).tolist(), ends.tolist(), strict=True):
        part = np.sort(found[a:b])
        sets.append(part[np.concatenate([[True], part[1:] != part[:-1]])] if b > a else part)
    return np.concatenate(sets) if sets else found, np.array([len(s) for s in sets], np.int64)


def identities(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set; an empty set has 0."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    total = words.mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64))
    return np.where(sizes > 0, total, np.uint64(0)).view(np.int64)


def signatures_of(sets: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """[texts with shingles, coordinates] of 32-bit minima."""
    full = sizes > 0
    begin = (np.cumsum(sizes) - sizes)[full]
    out = np.empty((int(full.sum()), coordinates), np.uint32)
    if len(begin):
        seeds = words.mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for k in range(coordinates):
            hashed = (sets ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1))
            out[:, k] = np.minimum.reduceat(hashed, begin) >> np.uint64(32)
    return out


def _sign(coordinates: int):
    def run(batches):
        powers = words.Powers()
        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id")
            for a, b in slices(texts, SLICE_BYTES):
                sets, sizes = distinct_sets(texts.slice(a, b - a), powers)
                flat = signatures_of(sets, sizes, coordinates).view(np.int32).ravel()
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, coordinates, 0))]).astype(np.int32)
                signature = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(a, b - a), pa.array(identities(sets, sizes)), pa.array(sizes), signature],
                    names=["doc_id", "node", "n_shingles", "signature"],
                )

    return run


def _sets(batches):
    powers = words.Powers()
    for batch in batches:
        for a, b in slices(batch.column("text"), SLICE_BYTES):
            sets, sizes = distinct_sets(batch.column("text").slice(a, b - a), powers)
            ends = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(sets)])
            yield pa.RecordBatch.from_arrays([pa.array(identities(sets, sizes)), packed], names=["node", "shingles"])


def skip_merge(short: np.ndarray, long: np.ndarray) -> int:
    """Common values of two sorted arrays: each value of the shorter skips through the longer by bisection."""
    if len(short) > len(long):
        short, long = long, short
    if not len(short):
        return 0
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    return int((long[at] == short).sum())


def _collide(matches: int):
    def run(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("keys_a", "keys_b"))
            keep = [skip_merge(x, y) >= matches for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirm(share: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist(), strict=True):
                common = skip_merge(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                keep.append(100 * common >= share * (len(x) // 8 + len(y) // 8 - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def common_counts(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """[rows, columns] sizes of the intersections of different sorted sets, by products of 0-1 matrices, a band of shingles at a time."""
    used = np.unique(np.concatenate([rows, columns]))
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(used, [len(sets[i]) for i in used])
    value, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[code] > 1  # a shingle of one set is in no intersection
    owner, code = owner[keep], (np.cumsum(times > 1) - 1)[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    place = [np.full(len(sets), -1) for _ in range(2)]
    place[0][rows], place[1][columns] = np.arange(len(rows)), np.arange(len(columns))
    out = np.zeros((len(rows), len(columns)), np.float32)
    for start in range(0, int((times > 1).sum()), COLUMNS):
        a, b = np.searchsorted(code, [start, start + COLUMNS])
        bands = []
        for at, many in zip(place, (len(rows), len(columns)), strict=True):
            band, mine = np.zeros((many, COLUMNS), np.float32), at[owner[a:b]]
            band[mine[mine >= 0], code[a:b][mine >= 0] - start] = 1
            bands.append(band)
        out += bands[0] @ bands[1].T
    return out.astype(np.int64)


def _meet(matches: int, share: int):
    def run(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        mine, node, group = (table.column(c).to_numpy() for c in ("mine", "node", "group"))
        signature = np.array(table.column("signature").to_pylist(), np.int32)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        left, right = np.nonzero(mine == low)[0], np.nonzero(mine == high)[0]
        hits = np.zeros((len(left), len(right)), np.int16)
        for k in range(signature.shape[1]):
            hits += signature[left, k][:, None] == signature[right, k]
        near = (hits >= matches) & (group[left][:, None] != group[right])
        a, b = size[left][:, None], size[right]
        near &= 100 * np.minimum(a, b) >= share * np.maximum(a, b)
        if low == high:
            near &= left[:, None] < right
        rows, columns = np.nonzero(near.any(axis=1))[0], np.nonzero(near.any(axis=0))[0]
        found = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(rows):
            common = common_counts(sets, left[rows], right[columns])
            union = size[left[rows]][:, None] + size[right[columns]] - common
            x, y = np.nonzero(near[np.ix_(rows, columns)] & (100 * common >= share * union))
            found = node[left[rows[x]]], node[right[columns[y]]]
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return run


def sign(docs: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, node (identity of the shingle set, 0 without words), n_shingles, signature."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(_sign(coordinates), SIGNED)


class Matcher:
    """Links between nodes; holds only frames, each settled in the shared folder."""

    def __init__(self, docs: DataFrame, signed: DataFrame, matches: int, share: int):
        self.matches, self.share = matches, share
        nodes = signed.filter("n_shingles > 0").groupBy("node").agg(
            F.min(F.struct("doc_id", "n_shingles", "signature")).alias("least")
        )
        self.nodes = settled(nodes.select("node", "least.*"), "nodes")
        keys = self.nodes.select("node", "n_shingles", F.posexplode("signature").alias("at", "value")).select(
            "node", "n_shingles", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long")).alias("key")
        )
        shared = keys.groupBy("key").agg(F.count("*").alias("posted")).filter("posted > 1")
        rows = keys.join(shared, "key").groupBy("node", "n_shingles").agg(
            F.sort_array(F.collect_list(F.struct("posted", "key"))).alias("ordered"), F.sum("posted").alias("central")
        )
        rows = rows.filter(F.size("ordered") >= matches).select(
            "node", "n_shingles", "central",
            F.expr(f"transform(slice(ordered, 1, size(ordered) - {matches - 1}), x -> x.key)").alias("prefix"),
            F.expr("sort_array(transform(ordered, x -> x.key))").alias("keys"),
        )
        self.posted = settled(rows, "posted")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        wanted = self.nodes.join(self.posted.select("node"), "node", "left_semi").select("doc_id")
        sets = texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "node long, shingles binary")
        self.sets = settled(sets.dropDuplicates(["node"]), "sets")

    def postings(self) -> DataFrame:
        return self.posted.select("node", "n_shingles", "central", F.explode("prefix").alias("key"))

    def near_in_size(self, a: str, b: str):
        """Sets whose sizes differ more cannot reach the share."""
        return 100 * F.least(a, b) >= self.share * F.greatest(a, b)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those with enough collisions whose full sets are alike."""
        keys = self.posted.select(F.col("node"), "keys")
        met = pairs.join(keys.toDF("a", "keys_a"), "a").join(keys.toDF("b", "keys_b"), "b")
        close = met.select("a", "b", "keys_a", "keys_b").mapInArrow(_collide(self.matches), "a long, b long")
        close = settled(close, "pairs")
        sized = close.join(self.sets.toDF("a", "shingles_a"), "a").join(self.sets.toDF("b", "shingles_b"), "b")
        return settled(sized.select("a", "b", "shingles_a", "shingles_b").mapInArrow(_confirm(self.share), "a long, b long"), "links")

    def hubs(self) -> DataFrame:
        rows = self.postings()
        return rows.groupBy("key").agg(F.max(F.struct("central", "node", "n_shingles")).alias("hub"))

    def hub_pairs(self) -> DataFrame:
        met = self.postings().join(self.hubs(), "key").filter(F.col("node") != F.col("hub.node"))
        met = met.filter(self.near_in_size("n_shingles", "hub.n_shingles"))
        return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()

    def family_links(self, roots: DataFrame) -> DataFrame:
        """Links between nodes that share a key and that ``roots`` (node, root) does not join yet."""
        rows = self.postings().join(roots.withColumnRenamed("root", "group"), "node", "left")
        rows = rows.withColumn("group", F.coalesce("group", "node"))
        apart = rows.groupBy("key").agg(F.max(F.struct("central", "node")).alias("hub"), F.min("group").alias("g0"), F.max("group").alias("g1"))
        apart = apart.filter("g0 <> g1").select("key", F.col("hub.node").alias("family"))
        members = rows.join(apart, "key").select("family", "node", "group", "n_shingles").distinct()
        members = settled(members, "families")
        sizes = members.groupBy("family").agg(F.count("*").alias("many"), F.sum("n_shingles").alias("shingle_count"))
        parts = F.greatest(F.ceil(F.col("many") / BLOCK_ROWS), F.ceil(F.col("shingle_count") / BLOCK_SHINGLES)).cast("int")
        dealt = members.join(sizes.select("family", parts.alias("parts")), "family")
        dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node", "family"), F.col("parts")).cast("int"))
        full = dealt.join(self.nodes.select("node", "signature"), "node").join(self.sets, "node")
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        cells = full.withColumn("other", other).select(
            "family", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "group", "signature", "shingles"
        )
        return settled(cells.groupBy("family", "low", "high").applyInArrow(_meet(self.matches, self.share), "a long, b long").distinct(), "links")


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of the links so far and the new ones."""
    if roots is not None:
        links = links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return components(links, "a", "b")


def near_duplicates(
    docs: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES, share: int = SHARE
) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links), kept, for each row.

    A link holds between sets with 100 * intersection >= share * union. Null and empty texts and texts
    without words have no shingles and are linked with nothing. Rows that repeat are copies of each
    other; rows that share a doc_id but not the text are apart. A row without doc_id takes no part: it
    has no component and is kept. Further columns are not read; an empty table gives no rows.
    """
    signed = settled(sign(docs, coordinates), "signed")
    matcher = Matcher(docs, signed.filter("doc_id is not null"), matches, share)
    roots = settled(joined(None, matcher.linked(matcher.hub_pairs())), "roots")
    roots = joined(roots, matcher.family_links(roots))
    members = matcher.nodes.select("node", "doc_id").join(roots, "node", "left")
    members = members.withColumn("root", F.coalesce("root", "node"))
    least = members.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = members.join(least, "root").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
