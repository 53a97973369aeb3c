"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

Each five-word shingle is hashed once. The high bits of the hash choose one of ``BINS`` bins, each
bin keeps its least hash. An empty bin takes the value of the first full bin in a fixed sequence of
bins that depends on the empty bin alone, so equal sets fill alike. The low ``BITS`` bits of each bin
are packed. Two fingerprints agree in a bin by chance with probability ``2**-BITS``; likeness
corrects for it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm import words
from casemill.llm.common import settled, slices, text_or_empty
from casemill.llm.neardup import distinct_sets

BINS, BITS = 256, 4
SLICE_BYTES = 1 << 20


def bins_of(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[texts, BINS] of low bits after densification; rows of texts without shingles are zero.

    The bits come from the value and the bin together, so one value in many bins agrees with another
    value no more often than chance.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = (sets >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(sets), bool)
    first[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    least = np.zeros((len(sizes), BINS), np.uint64)
    full = np.zeros((len(sizes), BINS), bool)
    least[owner[first], at[first]], full[owner[first], at[first]] = sets[first], True
    row, empty = np.nonzero(~full & (sizes > 0)[:, None])
    step = 0
    while len(row):
        step += 1
        pick = words.mix(np.arange(BINS, dtype=np.uint64) + np.uint64(step * BINS)) % np.uint64(BINS)
        source = pick.astype(np.int64)[empty]
        hit = full[row, source]
        least[row[hit], empty[hit]] = least[row[hit], source[hit]]
        row, empty = row[~hit], empty[~hit]
    mixed = words.mix(least ^ words.mix(np.arange(1, BINS + 1, dtype=np.uint64))) & np.uint64((1 << BITS) - 1)
    return np.where((sizes > 0)[:, None], mixed, np.uint64(0)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray, full_a: np.ndarray, full_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of shingle sets, 0 to 1; two empty sets are alike, an empty and a full one are not."""
    chance = 2.0**-BITS
    share = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(full_a & full_b, share, np.where(full_a | full_b, 0.0, 1.0))


def packed(bins: np.ndarray, full: np.ndarray) -> list[bytes]:
    """Low bits in ``BINS * BITS / 8`` bytes; no bytes for a text without shingles."""
    bits = np.unpackbits(bins[:, :, None], axis=2)[:, :, -BITS:].reshape(len(bins), -1)
    rows = np.packbits(bits, axis=1)
    return [row.tobytes() if f else b"" for row, f in zip(rows, full, strict=True)]


def fingerprint_column(texts: pa.Array, powers: words.Powers) -> tuple[np.ndarray, np.ndarray]:
    """Bins of each text and whether it has shingles."""
    bins, full = [np.empty((0, BINS), np.uint8)], [np.empty(0, bool)]
    for a, b in slices(texts, SLICE_BYTES):
        sets, sizes = distinct_sets(texts.slice(a, b - a), powers)
        bins.append(bins_of(sets, sizes))
        full.append(sizes > 0)
    return np.concatenate(bins), np.concatenate(full)


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the packed ``fingerprint`` of each whole text; a null text counts as empty."""

    def run(batches):
        powers = words.Powers()
        for batch in batches:
            value = packed(*fingerprint_column(batch.column("text"), powers))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value, pa.binary())], names=["doc_id", "fingerprint"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return wanted.mapInArrow(run, "doc_id long, fingerprint binary")


_RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [f.split(" ")[0] for f in _RESULT.split(", ")]
_EDGES = f"kind string, part int, {_RESULT}, text string"


def _compared(doc_ids, texts, following, bins, full, next_bins, next_full, powers) -> list:
    """The result's columns for documents and the texts that follow them."""
    edited = []
    for text, after in zip(texts, following, strict=True):
        cut = len(text) // 4
        edited.append(text[: len(text) - cut] + after[:cut])
    edited_bins, edited_full = fingerprint_column(pa.array(edited, pa.large_string()), powers)
    return [
        pa.array(doc_ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).digest() for t in edited], pa.binary()),
        pa.array(packed(bins, full), pa.binary()),
        pa.array(packed(edited_bins, edited_full), pa.binary()),
        pa.array(likeness(bins, edited_bins, full, edited_full)),
        pa.array(likeness(bins, next_bins, full, next_full)),
    ]


def _walk(batches):
    """Compare each document of a sorted part with the next; the first and last text go out for the seams."""
    powers, part, before = words.Powers(), TaskContext.get().partitionId(), None

    def edge(kind, doc_id, text):
        return pa.RecordBatch.from_pylist([{"kind": kind, "part": part, "doc_id": doc_id, "text": text}], schema=_SCHEMA)

    for batch in batches:
        for a, b in slices(batch.column("text"), SLICE_BYTES):
            doc_ids = batch.column("doc_id").slice(a, b - a).to_pylist()
            column = batch.column("text").slice(a, b - a)
            texts = column.to_pylist()
            bins, full = fingerprint_column(column, powers)
            if before is None:
                yield edge("head", doc_ids[0], texts[0])
            else:
                doc_ids, texts = [before[0], *doc_ids], [before[1], *texts]
                bins, full = np.concatenate([before[2], bins]), np.concatenate([before[3], full])
            before = doc_ids[-1], texts[-1], bins[-1:], full[-1:]
            if len(texts) > 1:
                done = _compared(doc_ids[:-1], texts[:-1], texts[1:], bins[:-1], full[:-1], bins[1:], full[1:], powers)
                n = len(texts) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["pair"] * n), pa.array([part] * n, pa.int32()), *done, pa.nulls(n, pa.string())], schema=_SCHEMA
                )
    if before is not None:
        yield edge("tail", before[0], before[1])


_SCHEMA = pa.schema(
    [("kind", pa.string()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()),
     ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
     ("text", pa.string())]
)


def _seams(batches):
    powers = words.Powers()
    for batch in batches:
        texts, after = batch.column("text"), batch.column("next_text")
        bins, full = fingerprint_column(texts, powers)
        next_bins, next_full = fingerprint_column(after, powers)
        doc_ids = batch.column("doc_id").to_pylist()
        done = _compared(doc_ids, texts.to_pylist(), after.to_pylist(), bins, full, next_bins, next_full, powers)
        yield pa.RecordBatch.from_arrays(done, names=_NAMES)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint each document and its edited text, and compare it with that and with the next document.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many of the next
    document. Documents follow each other by doc_id, nulls first, rows of one doc_id by a hash of the
    text and the text; the first follows the last. Null texts are empty. Texts without words have an
    empty fingerprint. Further columns are not read; an empty table gives no rows.

    One range shuffle brings neighbours together; each part hands on its first and last document, and
    these seams, two rows a part, are closed by a join.
    """
    spark = docs.sparkSession
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    wanted = wanted.withColumn("tie", F.xxhash64("text"))
    ordered = wanted.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    walked = settled(ordered.mapInArrow(_walk, _EDGES), "walked")
    # A number for each part with rows.
    parts = sorted(r["part"] for r in walked.filter("kind = 'head'").select("part").collect())
    steps = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "of_part int, next_part int")
    heads = walked.filter("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    tails = walked.filter("kind = 'tail'").join(steps, F.col("part") == F.col("of_part")).join(heads, "next_part")
    closed = tails.select("doc_id", "text", "next_text").mapInArrow(_seams, _RESULT)
    return walked.filter("kind = 'pair'").select(*_NAMES).union(closed).select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
