"""Byte-level BPE by merge replay over a corpus, and decoding.

A text is split by the vocabulary's pattern, and every piece is encoded by itself, so a corpus is
encoded once for each distinct piece. The bytes of all new pieces of a slab of documents stand one
after the other; an index keeps, for each rank, the places whose token and the next one make the
token of that rank. Ranks are replayed in their order: each place of the least rank is merged, left
to right, and only the two pairs that touch the merged token are looked up again and filed.

A slab is what a task reads at a time. Its pieces stay known for the later slabs of the task, up to
``PIECES_KEPT``; nothing is shuffled, and a lost task is repeated by itself.

Merging in the order of ranks over all pieces at once gives each piece the merges that it would get
alone, unless a merge makes a pair of a lower rank than its own. Such pieces are found while that
happens and are merged alone.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import free_name, gather, slices

SLAB_BYTES = 4 << 20
PIECES_KEPT, KEPT_CHARS = 400_000, 256
WINDOW_CHARS = 1 << 20
PAIRS_KEPT = 1_000_000
_SHIFT = 32


def read_ranks(path: str) -> bytes:
    """The rank file as it is, sent to the tasks; below a MB whatever the input."""
    with open(path, "rb") as file:
        return file.read()


class Merger:
    """The tokens of a rank file, and the merges that they stand for."""

    def __init__(self, rank_file: bytes):
        rows = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.made: dict[int, int] = {}

    def rank(self, left: int, right: int) -> int:
        """Rank of the token that two tokens make together, or -1."""
        key = (left << _SHIFT) | right
        rank = self.made.get(key)
        if rank is None:
            rank = self.made[key] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return rank

    def alone(self, piece: bytes) -> list[int]:
        """Ids of one piece: the leftmost pair of the least rank is merged until none is left."""
        ids = [int(self.of_byte[b]) for b in piece]
        while len(ids) > 1:
            found = [(rank, at) for at in range(len(ids) - 1) if (rank := self.rank(ids[at], ids[at + 1])) >= 0]
            if not found:
                break
            rank, at = min(found)
            ids[at : at + 2] = [rank]
        return ids

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and where each piece's begin, with the end."""
        if len(self.made) > PAIRS_KEPT:
            self.made.clear()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        start = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        inner = np.ones(len(start), bool)
        inner[ends - 1] = False
        token, after, before, here = self._links(start, inner)
        index = self._index(here)
        here = here.tolist()
        waiting = list(index)
        heapq.heapify(waiting)
        early: set[int] = set()
        made, rank_of = self.made, self.rank
        while waiting:
            rank = heapq.heappop(waiting)
            places = index.pop(rank)
            places.sort()
            for at in places:
                if here[at] != rank:  # the token or the next one has changed since this place was filed
                    continue
                gone = after[at]
                token[at], token[gone], here[gone] = rank, -1, -1
                after[at] = beyond = after[gone]
                here[at] = -1
                if beyond >= 0:
                    before[beyond] = at
                    pair = (rank << _SHIFT) | token[beyond]
                    new = made[pair] if pair in made else rank_of(rank, token[beyond])
                    if new >= 0:
                        here[at] = new
                        if new < rank:
                            early.add(at)
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(waiting, new)
                left = before[at]
                if left >= 0:
                    pair = (token[left] << _SHIFT) | rank
                    here[left] = new = made[pair] if pair in made else rank_of(token[left], rank)
                    if new >= 0:
                        if new < rank:
                            early.add(at)
                        if new in index:
                            index[new].append(left)
                        else:
                            index[new] = [left]
                            heapq.heappush(waiting, new)
        ids = np.array(token, dtype=np.int64)
        kept = ids >= 0
        bounds = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
        ids = ids[kept]
        again = sorted({int(np.searchsorted(ends, at, side="right")) for at in early})
        return self._mended(pieces, ids, bounds, again) if again else (ids, bounds)

    def _mended(self, pieces: list[bytes], ids: np.ndarray, bounds: np.ndarray, again: list[int]):
        """The same with some pieces merged alone."""
        alone = {k: np.array(self.alone(pieces[k]), dtype=np.int64) for k in again}
        parts, at = [], 0
        counts = np.diff(bounds)
        for k, row in alone.items():
            parts += [ids[bounds[at] : bounds[k]], row]
            counts[k], at = len(row), k + 1
        parts.append(ids[bounds[at] :])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])

    def _links(self, start: np.ndarray, inner: np.ndarray):
        """Token of each place, the places before and after it in its piece or -1, and the rank of its pair or -1."""
        after = np.where(inner, np.arange(1, len(start) + 1), -1)
        before = np.arange(-1, len(start) - 1)
        before[1:][~inner[:-1]] = -1
        here = np.full(len(start), -1, dtype=np.int64)
        places = np.nonzero(inner)[0]
        pairs, which = np.unique((start[places] << _SHIFT) | start[places + 1], return_inverse=True)
        ranks = np.array([self.rank(int(p) >> _SHIFT, int(p) & ((1 << _SHIFT) - 1)) for p in pairs], dtype=np.int64)
        if len(pairs):
            here[places] = ranks[which]
        return start.tolist(), after.tolist(), before.tolist(), here

    def _index(self, here: np.ndarray) -> dict[int, list[int]]:
        """Places of each rank, from the ranks of the places."""
        places = np.nonzero(here >= 0)[0]
        places = places[np.argsort(here[places], kind="stable")]
        firsts = np.nonzero(np.diff(here[places], prepend=-1))[0]
        return {int(here[p[0]]): p.tolist() for p in np.split(places, firsts[1:]) if len(p)}


class Coder:
    """Texts to ids and ids to bytes; knows the pieces it has met."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        self.merger = Merger(rank_file)
        self.pattern = regex.compile(pattern)
        self.seam = regex.compile(r"\S\s")
        self.known: dict[str, bytes] = {}
        size = max(self.merger.tokens) + 1
        tokens = [self.merger.tokens.get(i, b"") for i in range(size)]
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def pieces(self, text: str):
        """Pieces of a text, a window at a time. No piece goes on from a character into a blank, so a cut there is safe."""
        at = 0
        while at < len(text):
            seam = self.seam.search(text, at + WINDOW_CHARS) if len(text) - at > WINDOW_CHARS else None
            to = seam.start() + 1 if seam else len(text)
            yield self.pattern.findall(text if not at and to == len(text) else text[at:to])
            at = to

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Packed ids of pieces. A piece that is a token is that token, whatever merges would make of it."""
        found, parts, ranks = {}, [], self.merger.ranks
        for piece in sorted(new):  # pieces that begin alike lie together
            raw = piece.encode()
            if raw in ranks:
                found[piece] = ranks[raw].to_bytes(4, "little")
            else:
                parts.append((piece, raw))
        if parts:
            ids, bounds = self.merger.replay([raw for _, raw in parts])
            packed, at = ids.astype("<i4").tobytes(), (4 * bounds).tolist()
            found.update((piece, packed[at[k] : at[k + 1]]) for k, (piece, _) in enumerate(parts))
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and how many each text has."""
        found = [list(self.pieces(t)) for t in texts]
        new = set()
        for windows in found:
            for pieces in windows:
                new.update(pieces)
        if len(self.known) > PIECES_KEPT:
            self.known.clear()
        new.difference_update(self.known)
        learned = self._learn(new)
        self.known.update(learned)
        look = self.known.__getitem__
        rows = [b"".join(map(look, [p for pieces in windows for p in pieces])) for windows in found]
        for piece in new:
            if len(piece) > KEPT_CHARS:
                del self.known[piece]
        ids = np.frombuffer(b"".join(rows), dtype="<i4")
        return ids, np.fromiter((len(r) // 4 for r in rows), np.int64, len(rows))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes that each row of ids stands for."""
        out, ends = [], np.cumsum(counts)
        for end, many in zip(ends.tolist(), counts.tolist(), strict=True):
            row = ids[end - many : end]
            parts = [row[a : a + SLAB_BYTES // 16] for a in range(0, many, SLAB_BYTES // 16)]
            out.append(b"".join(gather(self.pool, self.starts[p], self.sizes[p]).tobytes() for p in parts))
        return out


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def _encode(rank_file: bytes, pattern: str, column: str, decoded: bool):
    def run(batches):
        coder = Coder(rank_file, pattern)
        for batch in batches:
            texts = batch.column(column).cast(pa.large_string()).fill_null("")
            for a, b in slices(texts, SLAB_BYTES):
                ids, counts = coder.encode(texts.slice(a, b - a).to_pylist())
                new = [_lists(ids, counts)]
                if decoded:
                    new.append(pa.array(coder.decode(ids, counts), pa.binary()))
                part = batch.slice(a, b - a)
                names = [*part.schema.names, "\0ids", "\0bytes"][: part.num_columns + len(new)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=names)

    return run


def _decode(rank_file: bytes, pattern: str, column: str):
    def run(batches):
        coder = Coder(rank_file, pattern)
        for batch in batches:
            rows = batch.column(column)
            counts = np.diff(np.asarray(rows.offsets))
            ids = np.asarray(rows.flatten())
            counts = np.where(np.asarray(rows.is_valid()), counts, 0)
            found = pa.array(coder.decode(ids, counts), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "\0bytes"])

    return run


def _with(docs: DataFrame, run, *new: tuple[str, str]) -> DataFrame:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, *(f"`{name}` {kind}" for name, kind in new)]))


def encode(
    docs: DataFrame, rank_path: str, pattern: str, column: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """The columns of ``docs`` and the token ids of each text as ``ids``, an array of integers.

    With ``decoded``, a column of that name has the bytes that the ids stand for, from the ids alone. Rows stay as
    they are, repeated ones too; null and empty texts have no ids; an empty table gives an empty one. A column
    of ``docs`` that has a new column's name already makes the new one take another, found by ``new_names``.
    Special tokens are ordinary text. Texts are encoded whole, however long; a single piece too.
    """
    names = new_names(docs, ids, *([decoded] if decoded else []))
    kinds = ("array<int>", "binary")
    source = F.col(column).cast("string")
    return _with(
        docs.withColumn(column, source), _encode(read_ranks(rank_path), pattern, column, bool(decoded)), *zip(names, kinds, strict=False)
    )


def decode(rows: DataFrame, rank_path: str, pattern: str, ids: str = "ids", decoded: str = "bytes") -> DataFrame:
    """The columns of ``rows`` and the bytes that each array of ids stands for; null arrays are empty."""
    source = F.col(ids).cast("array<int>")
    return _with(
        rows.withColumn(ids, source), _decode(read_ranks(rank_path), pattern, ids), (new_names(rows, decoded)[0], "binary")
    )


def new_names(docs: DataFrame, *names: str) -> list[str]:
    """The names the new columns get beside those of ``docs``."""
    return [free_name(docs, name) for name in names]


def digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: its ids are encoded, then decoded."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = encode(wanted, rank_path, pattern, decoded="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
