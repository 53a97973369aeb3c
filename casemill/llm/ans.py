"""Token files: a static range asymmetric numeral system over blocks that decode on their own.

One frequency table, counted over the whole corpus and shared by all files, is scaled to a power of
two. Documents are dealt out by range of ``doc_id`` and sorted, so files follow each other in that order.

A file is ``MAGIC``, frames, a directory and a footer. A frame holds whole documents, their ids and
token counts, and the tokens in blocks of ``BLOCK`` ids. Each block has ``LANES`` interleaved states
over one stream of 32-bit words; all blocks of a frame are coded at once, a vector step for each
row of lanes. The directory has a checkpoint for each frame (place, tokens and documents before it,
checksums of the stored bytes and of the ids), so that frames decode in parallel.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.llm.common import settled, shared_folder, store_of
from casemill.llm.tokens import encoder_of, read_tokenizer, with_end
from casemill.session import scratch_path

MAGIC = b"RANSTOK1"
LANES, BLOCK = 32, 16384
FRAME_TOKENS, FILE_TOKENS = 1 << 22, 1 << 23
MOST_TASKS = 10_000
LOW = np.uint64(1 << 31)  # a state is at least this and below it times 2**32


def scaled(counts: np.ndarray) -> tuple[int, np.ndarray]:
    """Bits and frequencies: they sum up to ``1 << bits``, and each id that occurs has one at least."""
    kinds, total = int((counts > 0).sum()), int(counts.sum())
    bits = max(12, min(18, max(1, total).bit_length() + 2), max(1, kinds).bit_length() + 2)
    if not total:
        return bits, np.zeros(len(counts), np.uint64)
    free = (1 << bits) - kinds
    share = counts * (free / total)
    freq = np.floor(share).astype(np.int64)
    rest = free - int(freq.sum())
    freq[np.argsort(-(share - freq), kind="stable")[:rest]] += 1
    freq[counts > 0] += 1
    assert freq.sum() == 1 << bits
    return bits, freq.astype(np.uint64)


class Table:
    def __init__(self, bits: int, freq: np.ndarray):
        self.bits, self.freq = bits, np.asarray(freq, np.uint64)
        self.below = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """States [blocks, lanes] and the word stream of each block."""
        steps = max(1, min(BLOCK // LANES, -(-len(ids) // LANES)))
        blocks = max(1, -(-len(ids) // (steps * LANES)))
        grid = np.full(blocks * steps * LANES, np.argmax(self.freq), np.int64)
        grid[: len(ids)] = ids
        grid = grid.reshape(blocks, steps, LANES)
        state = np.full((blocks, LANES), LOW, np.uint64)
        words, sent = np.empty((steps, blocks, LANES), np.uint32), np.empty((steps, blocks, LANES), bool)
        bits, top = np.uint64(self.bits), np.uint64(63 - self.bits)
        for t in range(steps - 1, -1, -1):
            of = grid[:, t]
            freq = self.freq[of]
            over = state >= (freq << top)
            words[t], sent[t] = state, over  # the low half of the state
            state = np.where(over, state >> np.uint64(32), state)
            whole = state // freq
            state = (whole << bits) + (state - whole * freq) + self.below[of]
        return state, [words[:, b][sent[:, b]].astype("<u4").tobytes() for b in range(blocks)]

    def decode(self, state: np.ndarray, streams: list[bytes], count: int) -> np.ndarray:
        blocks = len(streams)
        steps = max(1, min(BLOCK // LANES, -(-count // LANES)))
        sizes = np.array([len(s) // 4 for s in streams], np.int64)
        # One spare word: the last lookups of lanes that take nothing stay in range.
        words = np.concatenate([np.frombuffer(b"".join(streams), "<u4"), np.zeros(1, "<u4")]).astype(np.uint64)
        at, end = np.cumsum(sizes) - sizes, len(words) - 1
        state = state.astype(np.uint64)
        out = np.empty((blocks, steps, LANES), np.uint32)
        bits, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        for t in range(steps):
            slot = state & mask
            of = self.symbol[slot.astype(np.int64)]
            out[:, t] = of
            state = self.freq[of] * (state >> bits) + slot - self.below[of]
            under = state < LOW
            rank = np.cumsum(under, axis=1)
            word = words[np.minimum(at[:, None] + rank - under, end)]
            state = np.where(under, (state << np.uint64(32)) | word, state)
            at = at + rank[:, -1]
        if not (state == LOW).all():
            raise ValueError("a block does not end in its first state")
        return out.reshape(-1)[:count]


def _pack_frame(coder: Table, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> bytes:
    state, streams = coder.encode(ids)
    known = np.asarray(doc_ids.is_valid(), dtype=np.uint8)
    values = np.asarray(doc_ids.fill_null(0), dtype="<i8")
    head = zlib.compress(known.tobytes() + np.diff(values, prepend=np.int64(0)).astype("<i8").tobytes() + counts.astype("<u4").tobytes())
    sizes = np.array([len(s) for s in streams], "<u4").tobytes()
    return struct.pack("<QQII", len(ids), len(counts), len(head), len(streams)) + head + sizes + state.astype("<u8").tobytes() + b"".join(streams)


def _unpack_frame(coder: Table, raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    total, docs, head_size, blocks = struct.unpack_from("<QQII", raw)
    at = struct.calcsize("<QQII")
    head = zlib.decompress(raw[at : at + head_size])
    at += head_size
    known = np.frombuffer(head, np.uint8, docs).astype(bool)
    doc_ids = np.cumsum(np.frombuffer(head, "<i8", docs, docs))
    counts = np.frombuffer(head, "<u4", docs, 9 * docs).astype(np.int64)
    sizes = np.frombuffer(raw, "<u4", blocks, at)
    at += 4 * blocks
    state = np.frombuffer(raw, "<u8", blocks * LANES, at).reshape(blocks, LANES)
    at += 8 * blocks * LANES
    ends = at + np.cumsum(sizes.astype(np.int64))
    ids = coder.decode(state, [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], total)
    return pa.array(doc_ids, pa.int64(), mask=~known), counts, ids


def _tokenise(tokenizer_json: str, end_id: int):
    def run(batches):
        encoder = encoder_of(tokenizer_json)
        for batch in batches:
            ids, counts = with_end(*encoder.column(batch.column("text")), end_id)
            ends = np.concatenate([[0], np.cumsum(counts)]) * encoder.kind.itemsize
            data = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]
            )
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), data.cast(pa.binary())], names=["doc_id", "ids"])

    return run


def _count_ids(kind: str, size: int):
    def run(batches):
        met = np.zeros(size, np.int64)
        for batch in batches:
            for value in batch.column("ids").to_pylist():
                met += np.bincount(np.frombuffer(value, kind), minlength=size)
        at = np.nonzero(met)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(met[at])], names=["id", "n"])

    return run


def _write_files(kind: str, bits: int, freq: bytes, folder: str):
    def run(batches):
        coder, width = Table(bits, np.frombuffer(freq, "<u4")), np.dtype(kind).itemsize
        path = f"{folder}/{uuid.uuid4().hex}.rans"  # a repeated task writes another file; the manifest names the one that counts
        store, inner = store_of(path)
        out, directory, before, docs, pending, held = None, [], 0, 0, [], 0

        def flush():
            nonlocal out, before, docs, held
            if out is None:
                out = store.open_output_stream(inner, compression=None)
                out.write(MAGIC)
            doc_ids, counts = pa.concat_arrays([p[0] for p in pending]), np.concatenate([p[2] for p in pending])
            ids = np.frombuffer(b"".join(p[1] for p in pending), kind)
            frame = _pack_frame(coder, doc_ids, counts, ids)
            checks = zlib.crc32(frame), zlib.crc32(ids.astype("<u4").tobytes())
            directory.append([out.tell(), len(frame), before, len(ids), *checks])
            out.write(frame)
            before, docs, held = before + len(ids), docs + len(counts), 0
            pending.clear()

        for batch in batches:
            column, doc_ids = batch.column("ids"), batch.column("doc_id")
            counts = np.asarray(pc.binary_length(column), np.int64) // width
            at = 0
            while at < len(column):
                fits = int(np.searchsorted(np.cumsum(counts[at:]), FRAME_TOKENS - held, side="right"))
                to = at + max(fits, 0 if pending else 1)  # a longer document has a frame of its own
                if to > at:
                    pending.append((doc_ids.slice(at, to - at), b"".join(column.slice(at, to - at).to_pylist()), counts[at:to]))
                    held += int(counts[at:to].sum())
                if to < len(column):
                    flush()
                at = to
        if pending:
            flush()
        if out is not None:
            body = json.dumps({"table_crc32": coder.crc, "frames": directory}).encode()
            out.write(body + struct.pack("<QII", out.tell(), len(body), zlib.crc32(body)) + MAGIC)
            out.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"path": [path], "part": pa.array([part], pa.int32()), "tokens": [before], "docs": [docs]})

    return run


def _tail(file) -> dict:
    """The directory of a token file, checked."""
    size = struct.calcsize("<QII") + len(MAGIC)
    end = file.size()
    at, length, crc = struct.unpack_from("<QII", tail := file.read_at(size, end - size))
    body = file.read_at(length, at)
    if tail[-len(MAGIC) :] != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("not a whole token file")
    return json.loads(body)


def _frames(batches):
    for batch in batches:
        for path, part in zip(batch.column("path").to_pylist(), batch.column("part").to_pylist(), strict=True):
            store, inner = store_of(path)
            with store.open_input_file(inner) as file:
                found = _tail(file)
            at, size, before, tokens, stored, plain = (list(c) for c in zip(*found["frames"], strict=True))
            yield pa.RecordBatch.from_pydict(
                {"path": [path] * len(at), "part": pa.array([part] * len(at), pa.int32()), "at": at, "size": size, "before": before,
                 "tokens": tokens, "stored_crc32": stored, "ids_crc32": plain, "table_crc32": [found["table_crc32"]] * len(at)}
            )


def _read_table(path: str) -> Table:
    store, inner = store_of(path)
    with store.open_input_file(inner) as file:
        raw = file.read_at(file.size(), 0)
    bits, crc = struct.unpack_from("<II", raw, len(MAGIC))
    table = Table(bits, np.frombuffer(raw, "<u4", offset=len(MAGIC) + 8))
    if raw[: len(MAGIC)] != MAGIC or table.crc != crc:
        raise ValueError("not a whole frequency table")
    return table


def _decode(table_path: str, with_ids: bool):
    def run(batches):
        coder = None
        for batch in batches:
            for row in batch.to_pylist():
                coder = coder or _read_table(table_path)
                store, inner = store_of(row["path"])
                with store.open_input_file(inner) as file:
                    raw = file.read_at(row["size"], row["at"])
                if zlib.crc32(raw) != row["stored_crc32"] or row["table_crc32"] != coder.crc:
                    raise ValueError(f"frame at {row['at']} of {row['path']} is damaged")
                doc_ids, counts, ids = _unpack_frame(coder, raw)
                wide = ids.astype("<u4")
                plain = memoryview(wide).cast("B") if len(wide) else memoryview(b"")
                if zlib.crc32(plain) != row["ids_crc32"]:
                    raise ValueError(f"frame at {row['at']} of {row['path']} decodes to other ids")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(plain[4 * (e - n) : 4 * e]) for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                columns = {"doc_id": doc_ids, "start": pa.array(row["start"] + ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array([wide[e - n : e] for n, e in zip(counts, ends, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def encode_documents(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1) -> DataFrame:
    """Write the ids of whole texts, each followed by ``end_id``, as token files in ``folder``.

    The order is by doc_id, nulls first, and by the ids where doc_ids repeat. A null text is empty and
    has the end id alone. Further columns are not read; an empty table gives no file. Returns the
    settled manifest, a row for each file: path, part (ascending with doc_id), tokens, docs.
    """
    spark, text = docs.sparkSession, read_tokenizer(tokenizer_path)
    folder = shared_folder(spark, folder)
    encoder = encoder_of(text)
    size, kind = max(encoder.tokenizer.get_vocab_size(), end_id + 1), encoder.kind.str
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = settled(wanted.mapInArrow(_tokenise(text, end_id), "doc_id long, ids binary"), "ids")
    # At most one row for each id of the vocabulary reaches the driver.
    met = np.zeros(size, np.int64)
    for row in ids.select("ids").mapInArrow(_count_ids(kind, size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        met[row["id"]] = row["n"]
    bits, freq = scaled(met)
    raw, table = freq.astype("<u4").tobytes(), Table(bits, freq)
    store, inner = store_of(f"{folder}/table")
    store.create_dir(store_of(folder)[1], recursive=True)
    with store.open_output_stream(inner, compression=None) as out:
        out.write(MAGIC + struct.pack("<II", bits, table.crc) + raw)
    files = max(1, -(-int(met.sum()) // FILE_TOKENS))
    dealt = ids.withColumn("tie", F.xxhash64("ids")).repartitionByRange(files, "doc_id", "tie")
    ordered = dealt.sortWithinPartitions("doc_id", "tie", "ids").select("doc_id", "ids")
    return settled(ordered.mapInArrow(_write_files(kind, bits, raw, folder), "path string, part int, tokens long, docs long"), "manifest")


def decode_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Read token files back: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids.

    ``start`` counts the ids of all documents before, over all files. Frames are dealt out over the
    tasks by their checkpoints; a damaged frame, table or directory raises.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = manifest.select(F.col("path").alias("of_path"), F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("file_start"))
    schema = "path string, part int, at long, size long, before long, tokens long, stored_crc32 long, ids_crc32 long, table_crc32 long"
    frames = manifest.select("path", "part").mapInArrow(_frames, schema)
    dealt = frames.join(starts, F.col("path") == F.col("of_path")).withColumn("start", F.col("file_start") + F.col("before"))
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    # Frames are few and small as rows but not as work: a stated number keeps them in tasks of their own.
    tasks = frames.count()
    return dealt.repartition(max(1, min(tasks, MOST_TASKS)), "path", "at").mapInArrow(_decode(f"{shared_folder(manifest.sparkSession, folder)}/table", with_ids), columns)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Encode to files in the shared scratch folder and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return decode_files(encode_documents(docs, tokenizer_path, folder, end_id), folder, with_ids)
