"""Line dedup over content-defined chunks of lines.

A task hashes the lines of whole texts. A line of ``LONG_WORDS`` or more words is a chunk. Runs of other
lines are cut behind a line where the rolling hash over the last ``WINDOW`` line hashes hits a mask,
so a cut moves with the lines around it and not with what stands before. Chunks of two lines or
more, or one long line, whose hash occurs again anywhere are looked at: all but the first, by doc_id and
place, are removed if their bytes equal the first one's.

Passages are found without regard to lines. A window is a run of ``LONG_WORDS`` words with the blanks between
them. Whatever stands in a window that has occurred before, by doc_id and place, is a repeated passage, so a passage is
as long as the texts agree. The seed of a window is its run of ``SEED`` words with the least hash; equal windows have equal
seeds. Windows in a row with one seed form a context, of up to ``2 * LONG_WORDS - SEED`` words. Only contexts whose seed
occurs again are looked at: where whole contexts are equal, all but the first are repeats, and only the firsts of
different contexts with one seed are compared window by window. Contexts are hashed where their seeds are found, and only the
texts of unlike ones are read again. Seeds have 58 bits, contexts and windows 64; both are compared together. Of equal texts only the first is searched; the others are passages as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm import words
from casemill.llm.common import discard, free_name, settled, slices

WINDOW, MASK, LEAST_LINES, LEAST_BYTES, LONG_WORDS = 2, 3, 2, 64, 50
SEED, SLICE_BYTES, MERGE_ROWS = 16, 1 << 20, 256
CHUNK = "doc_id long, tie long, start int, stop int, hash long"
_MOD, _FACTOR = (1 << 64) - 1, 0x9E3779B97F4A7C15
_PLACE = np.uint64(63)  # more than the runs of a window


def chunks(text: str) -> list[tuple[int, int, int]]:
    """Start, end without the last line's break, and content hash of each chunk that may be removed."""
    from xxhash import xxh3_64_intdigest, xxh64_intdigest

    found, held, at, begin, size = [], [], 0, 0, 0

    def close(stop):
        if len(held) >= LEAST_LINES and size >= LEAST_BYTES:
            body = text[begin : stop - 1 if text[stop - 1 : stop] == "\n" else stop]
            found.append((begin, begin + len(body), xxh3_64_intdigest(body.encode())))
        held.clear()

    for line in text.split("\n"):
        stop = min(len(text), at + len(line) + 1)
        if line.count(" ") + 1 >= LONG_WORDS:
            if held:
                close(at)
            found.append((at, at + len(line), xxh3_64_intdigest(line.encode())))
        elif stop > at:
            if not held:
                begin, size = at, 0
            held.append(xxh64_intdigest(line.encode()))
            size += len(line)
            rolled = 0
            for h in held[-WINDOW:]:
                rolled = (rolled * _FACTOR + h) & _MOD
            if len(held) >= max(WINDOW, LEAST_LINES) and (rolled ^ rolled >> 32) & MASK == 0:
                close(stop)
        at = stop
    if held:
        close(at)
    return found


def _chunk(bits: int):
    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE_BYTES):
                columns = [[], [], [], [], []]
                for doc_id, tie, text in zip(*(c.to_pylist() for c in batch.slice(a, b - a).columns), strict=True):
                    for start, stop, value in chunks(text or ""):
                        value &= (1 << bits) - 1
                        for column, x in zip(columns, (doc_id, tie, start, stop, value - (1 << 64) if value >> 63 else value), strict=True):
                            column.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "tie", "start", "stop", "hash"]
                )

    return run


class Places:
    """Where the words of a column of texts lie: hashes of runs of words, and their ends in characters.

    An end is doubled, and one more where a line begins or ends there.
    """

    def __init__(self, texts: pa.Array):
        self.data, self.bounds = words.raw_bytes(texts)
        self.starts, self.stops = words.word_spans(self.data, self.bounds)
        self.first_word = np.searchsorted(self.starts, self.bounds)
        self.inner = np.nonzero(self.data & 0xC0 == 0x80)[0]  # bytes within a character
        self.view = memoryview(self.data)

    def _chars(self, row, at):
        base = self.bounds[row]
        return at - base - np.searchsorted(self.inner, at) + np.searchsorted(self.inner, base)

    def ends(self, row, first, last) -> tuple[np.ndarray, np.ndarray]:
        start, stop = self.starts[first], self.stops[last]
        opens = (start == self.bounds[row]) | (self.data[start - 1] == 10)
        shuts = (stop == self.bounds[row + 1]) | (self.data[np.minimum(stop, len(self.data) - 1)] == 10)
        return 2 * self._chars(row, start) + opens, 2 * self._chars(row, stop) + shuts

    def hashes(self, first, last) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        spans = zip(self.starts[first].tolist(), self.stops[last].tolist(), strict=True)
        return np.array([xxh3_64_intdigest(self.view[a:b]) for a, b in spans], np.uint64).view(np.int64)

    def dense_hashes(self, first, last, powers: words.Powers) -> np.ndarray:
        """Of runs that lie close together, in the order of their first words; other values than those of ``hashes``."""
        return words.span_hashes(self.data, self.starts[first], self.stops[last], powers).view(np.int64)


def seeds(texts: pa.Array, powers: words.Powers) -> tuple[np.ndarray, ...]:
    """Of a column of texts, the row, first word, number of windows and seed of each context."""
    hashes, counts = words.word_hashes(*words.raw_bytes(texts), powers)
    reach = LONG_WORDS - SEED + 1
    if len(hashes) < LONG_WORDS:
        return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64))
    # The low bits tell neighbours apart, so that a change of the least is a change of its place.
    grams = words.run_hashes(hashes, SEED) & ~_PLACE | np.arange(len(hashes) - SEED + 1, dtype=np.uint64) & _PLACE
    least, size = grams, 1
    while size < reach:
        step = min(size, reach - size)
        least, size = np.minimum(least[:-step], least[step:]), size + step
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.nonzero(owner[LONG_WORDS - 1 :] == owner[: len(least)])[0]
    least = least[starts]
    opens = np.nonzero(np.concatenate([np.ones(min(1, len(starts)), bool), (np.diff(starts) > 1) | (least[1:] != least[:-1])]))[0]
    first = starts[opens]
    row = owner[first]
    return row, first - (np.cumsum(counts) - counts)[row], np.diff(np.append(opens, len(starts))), least[opens] & ~_PLACE


def parts(batches):
    """Parts of about ``SLICE_BYTES`` of a task's texts, whatever batches these come in."""
    held = None
    for batch in batches:
        batch = batch if held is None else pa.concat_batches([held, batch])
        *full, (at, _) = [*slices(batch.column("text"), SLICE_BYTES)] or [(0, 0)]
        for a, b in full:
            yield batch.slice(a, b - a)
        held = batch.slice(at)
    if held is not None:
        yield held


SEEDED = "doc_id long, tie long, body binary, low long, high long, seeds array<long>, hashes array<long>, lows array<long>, highs array<long>"


def _seed(batches):
    """Texts of ``LONG_WORDS`` words or more with their ends, and the seed, hash and ends of their contexts."""
    from xxhash import xxh3_128_digest

    powers = words.Powers()
    for part in parts(batches):
        row, at, many, value = seeds(part.column("text"), powers)
        if not len(row):
            continue
        places = Places(part.column("text"))
        first = places.first_word[row] + at
        last = first + many + LONG_WORDS - 2
        mine, begins = np.unique(row, return_index=True)
        whole = places.ends(mine, places.first_word[mine], places.first_word[mine + 1] - 1)
        cuts = pa.array(np.append(begins, len(row)), pa.int32())
        bodies = [xxh3_128_digest(places.view[places.bounds[i] : places.bounds[i + 1]]) for i in mine]
        lists = (value.view(np.int64), places.hashes(first, last), *places.ends(row, first, last))
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c).take(pa.array(mine, pa.int64())) for c in ("doc_id", "tie")), pa.array(bodies, pa.binary()),
             *(pa.array(x, pa.int64()) for x in whole), *(pa.ListArray.from_arrays(cuts, pa.array(x, pa.int64())) for x in lists)],
            names=["doc_id", "tie", "body", "low", "high", "seeds", "hashes", "lows", "highs"],
        )


CUT = "doc_id long, tie long, start long, stop long, hash long, seed long, is_first boolean, body string"
_CUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "tie", "start", "stop", "hash", "seed")] + [("is_first", pa.bool_()), ("body", pa.string())])


def _windows(owners: list[tuple], parts: list[str], powers: words.Powers) -> pa.RecordBatch:
    """Rows of ``CUT`` for the windows of contexts: their doc_id, tie, seed and ends, and their texts."""
    places = Places(pa.array(parts, pa.string()))
    many = np.diff(places.first_word) - LONG_WORDS + 1
    row = np.repeat(np.arange(len(parts)), many)
    first = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + places.first_word[row]
    last = first + LONG_WORDS - 1
    low, high = places.ends(row, first, last)
    doc_id, tie, seed, start, stop = zip(*owners, strict=True)
    start, stop = np.array(start, np.int64), np.array(stop, np.int64)
    # A context begins and ends a line only where its text does.
    opens, shuts = first == places.first_word[row], last == places.first_word[row + 1] - 1
    low = np.where(opens, start[row], low + (start[row] & ~1))
    high = np.where(shuts, stop[row], high + (start[row] & ~1))
    pick = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_id, pa.int64()).take(pick), pa.array(tie, pa.int64()).take(pick), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
         pa.array(places.dense_hashes(first, last, powers), pa.int64()), pa.array(seed, pa.int64()).take(pick), pa.nulls(len(row), pa.bool_()),
         pa.nulls(len(row), pa.string())], schema=_CUT,
    )


def _cut(batches):
    """The bytes of chunks, and the windows of contexts."""
    powers = words.Powers()
    for batch in batches:
        for a, b in slices(batch.column("text"), SLICE_BYTES):
            columns, owners, parts = [[] for _ in _CUT], [], []
            for doc_id, tie, text, spans, near in zip(*(c.to_pylist() for c in batch.slice(a, b - a).columns), strict=True):
                for x in spans or ():
                    row = (doc_id, tie, x["start"], x["stop"], x["hash"], None, x["is_first"], text[x["start"] : x["stop"]])
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                for x in near or ():
                    owners.append((doc_id, tie, x["seed"], x["low"], x["high"]))
                    parts.append(text[x["low"] >> 1 : x["high"] >> 1])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CUT, strict=True)], schema=_CUT)
            if parts:
                yield _windows(owners, parts, powers)


def regions(ends: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The passages that windows (with ends as of ``Places``) make up, each with one blank or break that goes with it.

    That is the one behind, or the one before where a passage ends a line that it does not begin: lines do not run together.
    """
    out, held = [], []
    for low, high in sorted(ends):
        if held and low >> 1 < held[1] >> 1:
            held[1] = max(held[1], high)
        else:
            held = [low, high]
            out.append(held)
    return [(low // 2 - 1, high // 2) if high & 1 and not low & 1 else (low // 2, high // 2 + 1) for low, high in out]


def _merge(batches):
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for whole in batches:
        for at in range(0, whole.num_rows, MERGE_ROWS):
            batch = whole.slice(at, MERGE_ROWS)
            passages, every = [], []
            for lines, ends in zip(batch.column("lines"), batch.column("ends"), strict=True):  # a document's windows at a time
                found = regions([(x["low"], x["high"]) for x in ends.as_py() or ()])
                met = []
                for start, stop in sorted(found + [(x["start"], x["stop"] + 1) for x in lines.as_py() or ()]):
                    if met and start < met[-1][1]:
                        met[-1][1] = max(met[-1][1], stop)
                    else:
                        met.append([start, stop])
                for column, rows in ((passages, found), (every, met)):
                    column.append([{"start": x, "stop": y - 1} for x, y in rows] or None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), batch.column("lines"), pa.array(passages, span), pa.array(every, span)],
                names=["doc_id", "tie", "lines", "passages", "every"],
            )


def _place(start):
    return F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "tie", F.col(start).alias("low"))


def repeats(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, tie (a hash of the text) and spans (start, stop; in characters, ascending) to remove: the repeated chunks
    (``lines``), the repeated ``passages`` of ``LONG_WORDS`` words or more, and ``every`` span of both, joined where they overlap.

    Rows of one doc_id with equal texts count as one document. A row without doc_id comes last. ``bits`` is how much of the hash of a
    chunk is used to find it again; chunks whose bytes differ are never taken for each other.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"),
        F.col("text").cast("string").alias("text"),
    ).filter("text is not null")
    found = settled(texts.mapInArrow(_chunk(bits), CHUNK), "chunks")
    firsts = found.groupBy("hash").agg(F.min(_place("start")).alias("first"), F.count("*").alias("times")).filter("times > 1")
    again = found.join(firsts.drop("times"), "hash")
    seeded = settled(texts.mapInArrow(_seed, SEEDED), "seeds")
    ranked = seeded.withColumn("place", _place("low"))
    groups = ranked.groupBy("body").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first <> last")
    leader = settled(groups.select(F.col("body").alias("of_body"), "first"), "leaders")
    ranked = ranked.join(leader, F.col("body") == F.col("of_body"), "left")
    copies = settled(ranked.filter("place > first").select("doc_id", "tie", "low", "high"), "copies")
    posted = ranked.filter("first is null or place = first").select(
        "doc_id", "tie", F.explode(F.arrays_zip("seeds", "hashes", "lows", "highs")).alias("x")
    ).select("doc_id", "tie", F.col("x.seeds").alias("seed"), F.col("x.hashes").alias("hash"), F.col("x.lows").alias("low"), F.col("x.highs").alias("high"))
    shared = posted.groupBy("seed").agg(F.count("*").alias("times"), (F.min("hash") != F.max("hash")).alias("unlike")).filter("times > 1")
    met = settled(posted.join(shared.drop("times"), "seed"), "contexts")
    kinds = met.groupBy("seed", "hash").agg(
        F.min(F.struct(_place("low").alias("first"), "doc_id", "high")).alias("least"), F.count("*").alias("times"), F.max("unlike").alias("unlike")
    ).select("seed", "hash", "least.*", "times", "unlike")
    kinds = settled(kinds, "kinds")
    # A document's own spans and contexts: no more than its lines and words.
    span = F.struct("start", "stop", "hash", (_place("start") == F.col("first")).alias("is_first"))
    wanted = again.select("doc_id", "tie", span.alias("span")).withColumn("context", F.lit(None).cast("struct<seed:long,low:long,high:long>")).union(
        kinds.filter("unlike").select("doc_id", "first.tie", F.lit(None), F.struct("seed", "first.low", "high"))
    )
    wanted = wanted.groupBy("doc_id", "tie").agg(F.collect_set("span").alias("spans"), F.collect_set("context").alias("near"))
    wanted = wanted.withColumnsRenamed({"doc_id": "of_doc", "tie": "of_tie"})
    cut = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("tie") == F.col("of_tie")))
    cut = settled(cut.select("doc_id", "tie", "text", "spans", "near").mapInArrow(_cut, CUT), "bodies")
    for done in (found, seeded):
        discard(done)
    bodies = cut.filter("seed is null")
    kept = bodies.filter("is_first").select(F.col("hash").alias("of_hash"), F.col("body").alias("first_body"))
    # Equal rows cut the same first span more than once.
    kept = kept.dropDuplicates(["of_hash"])
    same = bodies.filter("not is_first").join(kept, (F.col("hash") == F.col("of_hash")) & (F.col("body") == F.col("first_body")))
    whole = met.join(kinds.filter("times > 1").select("seed", "hash", "first"), ["seed", "hash"]).filter(_place("low") > F.col("first"))
    unlike = cut.filter("seed is not null").select("doc_id", "tie", "seed", "hash", F.col("start").alias("low"), F.col("stop").alias("high"))
    firsts = unlike.groupBy("seed", "hash").agg(F.min(_place("low")).alias("first"), F.count("*").alias("times")).filter("times > 1")
    later = unlike.join(firsts.drop("times"), ["seed", "hash"]).filter(_place("low") > F.col("first"))
    later = settled(later.select("doc_id", "tie", "low", "high"), "windows")
    ends = copies
    for rows in (later, whole):
        ends = ends.union(rows.select("doc_id", "tie", "low", "high"))
    both = same.select("doc_id", "tie", F.struct("start", "stop").alias("line"), F.lit(None).cast("struct<low:long,high:long>").alias("end")).union(
        ends.select("doc_id", "tie", F.lit(None), F.struct("low", "high"))
    )
    # No more than the lines and words of a document.
    both = both.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set("line")).alias("lines"), F.collect_set("end").alias("ends"))
    both = both.withColumn("lines", F.when(F.size("lines") > 0, F.col("lines")))
    span = "array<struct<start:long,stop:long>>"
    both = settled(both.mapInArrow(_merge, f"doc_id long, tie long, lines {span}, passages {span}, every {span}"), "spans")
    for done in (met, kinds, cut, copies, leader, later):
        discard(done)
    return both


def without(text: Column, spans: Column) -> Column:
    """The text less its spans; a span goes with the character behind it."""
    before = F.transform(spans, lambda s: s["stop"] + 1)
    begin = F.concat(F.array(F.lit(0).cast("long")), before)
    end = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    parts = F.zip_with(begin, end, lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int")))
    return F.when(spans.isNull(), text).otherwise(F.array_join(parts, ""))


def with_repeats(docs: DataFrame) -> tuple[DataFrame, str, str, str]:
    """All rows and columns of ``docs`` with the spans of ``repeats``, and the names these have: lines, passages, every."""
    doc, tie, *names = (free_name(docs, n) for n in ("line_doc", "line_tie", "removed_lines", "removed_passages", "removed_spans"))
    found = repeats(docs).toDF(doc, tie, *names)
    on = docs["doc_id"].cast("long").eqNullSafe(found[doc]) & (F.xxhash64(docs["text"].cast("string")) == found[tie])
    return docs.join(found, on, "left").drop(doc, tie), *names


def remove_repeats(docs: DataFrame, passages: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated chunks taken out of ``text``, and ``removed_spans``.

    With ``passages`` the repeated passages of ``LONG_WORDS`` words or more go too, wherever they begin and end.
    A text keeps the rest and its breaks as they are; one that is made of repeats only becomes
    empty. ``removed_spans`` is null where nothing goes, and has another name if docs has that one.
    Null and empty texts stay. An empty table gives no rows.
    """
    met, lines, passage, every = with_repeats(docs)
    met = met.drop(passage, lines) if passages else met.drop(passage, every).withColumnRenamed(lines, every)
    return met.withColumn("text", without(F.col("text"), F.col(every)))
