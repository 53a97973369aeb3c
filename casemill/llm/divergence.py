"""Divergence of sources within a language, over a cube of (group block, group block, term block) cells.

A group is a source within a language. The terms of a language that stand in enough documents are
dealt into term blocks, its groups into group blocks. A slice holds the shares of one group block in
one term block; it is copied to the cells of its term block that need it, one for each other group
block, so that a cell has all it needs to compare its two group blocks over its terms. Cells give
partial divergences, which are summed along the term axis.

Shares are whole numbers, p = 1 + floor(SCALE * (count + 1) / (N + V)), so all sums are exact: V is
the number of terms of the language and N the number of their occurrences in the group.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import settled

SCALE = 1_000_000_000
GROUP_BLOCK, TERM_BLOCK = 32, 4096
ENTRIES_HELD = 300_000
SALTS = 64
WINDOW_BYTES = 4 << 20
# A term is a run of letters A-Z, a-z and of characters beyond ASCII; A-Z count as a-z.
_FOLDED = bytes(b if b > 127 or chr(b).isalpha() and b > 96 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def _windows(raw: bytes):
    """A text in windows that end behind a term."""
    folded, at = raw.translate(_FOLDED), 0
    while at < len(folded):
        to = folded.find(b" ", at + WINDOW_BYTES)
        to = len(folded) if to < 0 else to
        yield folded[at:to].split()
        at = to


def _count(batches):
    """Occurrences of each term and documents that have it, for each group, given out whenever many are held."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    entries = 0

    def given():
        for (lang, source), (words, docs) in held.items():
            terms = list(words)
            columns = ([lang] * len(terms), [source] * len(terms), terms, words.values(), [docs[t] for t in terms])
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            arrays[2] = arrays[2].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            words, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(words), set()
            for window in _windows(text.as_py()):
                words.update(window)
                seen.update(window)
            docs.update(seen)
            entries += len(words) - before
            if entries > ENTRIES_HELD:
                yield from given()
                held.clear()
                entries = 0
    yield from given()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact: a division in base 1000, three digits of it."""
    over = total + terms
    first = F.struct((count + 1).alias("rest"), F.lit(0).cast("long").alias("whole"))

    def step(state, _):
        more = state["rest"] * 1000
        return F.struct((more % over).alias("rest"), (state["whole"] * 1000 + F.call_function("div", more, over)).alias("whole"))

    digits = F.array(*[F.lit(i) for i in range(3)])
    return 1 + F.aggregate(digits, first, step, lambda state: state["whole"])


def beside(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Join with a frame of one row for each key; a key with very many rows is dealt over ``SALTS`` parts."""
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(copies, [*keys, "salt"]).drop("salt")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def group_counts(docs: DataFrame, lang: str = "lang", source: str = "source", column: str = "text") -> tuple[DataFrame, DataFrame]:
    """All groups, and (lang, source, term, n, docs) of every term in every group.

    Null texts, languages and sources are empty strings; each row is a document, repeated rows too.
    """
    wanted = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (column, "text"))))
    counts = wanted.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return settled(wanted.select("lang", "source").distinct(), "groups"), settled(counts, "terms")


class Audit:
    """Terms kept for each language, and the shares of every group in them."""

    def __init__(self, groups: DataFrame, counts: DataFrame, least_docs: int):
        by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
        kept = settled(by_term.drop("docs"), "kept-terms")
        langs = groups.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("total").alias("total_n")), "lang", "left")
        self.langs = langs.select(
            "lang", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("total_n", F.lit(0)).alias("total_n"),
            F.greatest(F.lit(1), F.ceil(F.coalesce("size", F.lit(0)) / TERM_BLOCK)).cast("long").alias("term_blocks"),
        )
        block = F.pmod(F.xxhash64("term"), F.col("term_blocks"))
        placed = beside(kept, self.langs, ["lang"]).withColumn("k", block)
        t = F.row_number().over(Window.partitionBy("lang", "k").orderBy("term"))
        placed = placed.select("lang", "term", "k", t.alias("t"), share(F.col("total"), F.col("total_n"), F.col("size")).alias("q"))
        self.terms = settled(placed, "placed-terms")
        self.entries = settled(counts.select("lang", "source", "term", "n").join(self.terms, ["lang", "term"]), "entries")
        sums = self.entries.groupBy("lang", "source").agg(F.sum("n").alias("occurrences"))
        sized = groups.join(sums, ["lang", "source"], "left").join(self.langs, "lang").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
        blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("long").alias("group_blocks"))
        base = F.when(F.col("size") > 0, share(F.lit(0).cast("long"), F.col("occurrences"), F.col("size"))).otherwise(1)
        placed = sized.join(blocks, "lang").withColumn("b", F.pmod(F.xxhash64("source"), F.col("group_blocks")))
        g = F.row_number().over(Window.partitionBy("lang", "b").orderBy("source")) - 1
        self.groups = settled(placed.withColumn("g", g).withColumn("base", base), "placed-groups")

    def shares(self) -> DataFrame:
        """lang, source, term and its place, the group's share p and the language's q, where the group has the term."""
        of = self.groups.select("lang", "source", "b", "g", "occurrences", "size")
        return beside(self.entries, of, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("occurrences"), F.col("size")))

    def marked_terms(self, most: int) -> DataFrame:
        """The terms that a group has more often than its language, largest divergence first, up to ``most``."""
        over = self.shares().filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
        return _ranked(over, "term").filter(F.col("rank") <= most)

    def slices(self) -> DataFrame:
        """lang, k, b: the groups of block b, and their shares in the terms of block k."""
        groups = self.groups.groupBy("lang", "b", "group_blocks").agg(F.collect_list(F.struct("g", "source", "base")).alias("groups"))
        sizes = self.terms.groupBy("lang", "k").agg(F.count("*").alias("size"))
        blocks = self.langs.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)).alias("k"))
        grid = blocks.join(sizes, ["lang", "k"], "left").join(groups, "lang")
        held = self.shares().groupBy("lang", "k", "b").agg(F.collect_list(F.struct("g", "t", "p")).alias("held"))
        return grid.join(held, ["lang", "k", "b"], "left").withColumn("size", F.coalesce("size", F.lit(0)))

    def divergences(self) -> DataFrame:
        """Sum over all terms of a language of the divergence of each source from each other one."""
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("group_blocks") - 1)).alias("other")
        copies = self.slices().select("lang", "k", "size", "b", "groups", "held", other)
        cells = copies.select(
            "lang", "k", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "size", "groups", "held"
        )
        parts = cells.groupBy("lang", "k", "i", "j").applyInArrow(_cell, "lang string, source string, item string, value long")
        return _ranked(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _side(row: dict, terms: np.ndarray) -> tuple[list, np.ndarray]:
    """Names of a slice's groups, and their shares in the given terms; a group without a term has its base share."""
    groups = sorted(row["groups"].as_py(), key=lambda g: g["g"])
    shares = np.repeat(np.array([g["base"] for g in groups], dtype=np.int64)[:, None], len(terms), axis=1)
    held = row["held"].values
    if held is not None and len(held):
        g, t, p = (held.field(n).to_numpy(zero_copy_only=False) for n in ("g", "t", "p"))
        shares[g, np.searchsorted(terms, t)] = p
    return [g["source"] for g in groups], shares


def _cell(cell: pa.Table) -> pa.Table:
    """Partial divergences of the groups of one block from those of the other, both ways.

    Terms that neither block has give every pair the divergence of two base shares; they are counted, not visited.
    """
    rows = {r["b"].as_py(): r for r in ({n: cell.column(n)[i] for n in cell.column_names} for i in range(cell.num_rows))}
    ends = [rows[k] for k in sorted(rows)]
    sources, items, values = [], [], []
    # A block may have no group, since groups are dealt by hash; its cells with others have no pairs.
    ways = [(0, 1), (1, 0)] if len(ends) == 2 else [(0, 0)] if ends[0]["i"] == ends[0]["j"] else []
    seen = [r["held"].values.field("t").to_numpy(zero_copy_only=False) for r in ends if r["held"].values is not None]
    terms = np.unique(np.concatenate(seen)) if seen else np.empty(0, np.int64)
    unseen = ends[0]["size"].as_py() - len(terms)
    bases = [np.array([g["base"] for g in sorted(r["groups"].as_py(), key=lambda g: g["g"])], dtype=np.int64) for r in ends]
    sides = [_side(r, terms) for r in ends]
    for x, y in ways:
        (names, p), (others, q) = sides[x], sides[y]
        for a, name in enumerate(names):
            gap, gap0 = p[a] - q, bases[x][a] - bases[y]
            value = (gap * gap // q).sum(axis=1) + unseen * (gap0 * gap0 // bases[y])
            for b, other in enumerate(others):
                if x != y or a != b:
                    sources.append(name)
                    items.append(other)
                    values.append(int(value[b]))
    lang = [ends[0]["lang"].as_py()] * len(sources)
    return pa.table({"lang": pa.array(lang, pa.string()), "source": pa.array(sources, pa.string()), "item": pa.array(items, pa.string()), "value": pa.array(values, pa.int64())})


def audit(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source lies from the others and from its language.

    Part ``pair`` has each other source of the language with the divergence of the group from it, summed over all
    kept terms, 0 where none is kept; part ``term`` has the terms in which the group exceeds its language, up to
    ``most_terms``. Larger values come first, then items in the order of their bytes. Null columns are empty
    strings; repeated rows are documents of their own; texts are read whole; further columns are not read. A
    source that is alone in its language has no pairs; an empty table gives no rows.
    """
    held = Audit(*group_counts(docs), least_docs)
    return held.divergences().unionByName(held.marked_terms(most_terms))
