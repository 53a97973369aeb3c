"""Words and word shingles of whole texts as 64-bit hashes, computed for a column of texts at once.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage
return; A-Z count as a-z. A text's shingles are its runs of five words; a text with fewer words
has its whole sequence as the only one, and a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20
SHINGLE = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables():
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    values[65:91] = values[97:123]
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return values, blank


_VALUE, _BLANK = _tables()
_BYTE = mix(np.arange(257, 513, dtype=np.uint64) * _ODD)


class Powers:
    """Powers of the odd factor and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int):
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, f)])) for f in (_FACTOR, inverse)
            )
        return self.up, self.down


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column one after the other, and where each text begins, with the end; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_hashes(data: np.ndarray, bounds: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words of each text."""
    opens = np.zeros(len(data) + 1, bool)
    opens[bounds] = True
    hashes, starts, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + WINDOW)
        while to < len(data) and not opens[to] and not _BLANK[data[to]]:
            # The window ends behind a word: a longer word stretches it.
            step = min(len(data), to + WINDOW)
            stops = np.nonzero(opens[to:step] | _BLANK[data[to:step]])[0]
            to = to + int(stops[0]) if len(stops) else step
        piece, new = data[at:to], opens[at:to]
        inside = ~_BLANK[piece]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | new[1:]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | new[1:]
        first, last = np.nonzero(first)[0], np.nonzero(last)[0]
        up, down = powers.to(len(piece) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[piece] * up[: len(piece)], dtype=np.uint64)])
        hashes.append(mix((sums[last + 1] - sums[first]) * down[first]))
        starts.append(first + at)
        at = to
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), bounds))


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends, in bytes; the words are those of ``word_hashes``."""
    opens = np.zeros(len(data) + 1, bool)
    opens[bounds] = True
    inside = ~_BLANK[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | opens[1 : len(data)]
    last[:-1] &= ~inside[1:] | opens[1 : len(data)]
    return np.nonzero(first)[0], np.nonzero(last)[0] + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of the bytes of each span as they are, capitals and blanks included; spans come in the order of their starts."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(starts, base + WINDOW, side="right"))
        piece = data[base : int(stops[at:to].max())]
        up, down = powers.to(len(piece) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[piece] * up[: len(piece)], dtype=np.uint64)])
        a, b = starts[at:to] - base, stops[at:to] - base
        out[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _ODD)
        at = to
    return out


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, whatever texts they belong to."""
    many = len(words) - size + 1
    total, have, block, width = np.zeros(many, np.uint64), 0, words, 1
    factor = int(_FACTOR)
    while True:
        lift = np.uint64(pow(factor, width, 1 << 64))
        if size & width:
            total, have = total * lift + block[have : have + many], have + width
        if have == size:
            return mix(total)
        block, width = block[:-width] * lift + block[width:], 2 * width


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle in the order of the text, repeats included, and the number of each text."""
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), many)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + begin[owner]
    length = np.minimum(counts, size)[owner]
    whole = np.concatenate([words, np.zeros(size, np.uint64)])
    total = length.astype(np.uint64) * _ODD
    for j in range(size):
        total = total * _FACTOR + np.where(j < length, whole[at + j], np.uint64(0))
    return mix(total), many


def shingles(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    return shingle_hashes(*word_hashes(*raw_bytes(texts), powers))
