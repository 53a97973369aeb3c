"""Token ids of whole texts with the ``tokenizers`` library, a distinct word at a time.

A tokenizer that normalises with NFC, white space and lower case and then splits at white space
encodes each blank-separated part of a text by itself. Such a text is cut at blanks and line
ends, each distinct part is encoded once, and the ids are put together again. Letters of the
Latin-1 range, maybe with ASCII marks behind them, need only the library's merges; every other
part goes through the whole library. A tokenizer of another make encodes whole texts.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from casemill.llm.common import gather, slices

# Letters, then ASCII marks; no apostrophe, since the splitting pattern treats it apart.
PLAIN_PART = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
WORDS_KEPT = 200_000
SLICE_BYTES = 6 << 20


def read_tokenizer(path: str) -> str:
    """The tokenizer file's text, sent to the tasks; a few MB whatever the input."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def splits_at_blanks(spec: dict) -> bool:
    normal = (spec.get("normalizer") or {}).get("normalizers", [])
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"]
        and normal[1] == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        and [s["type"] for s in split] == ["Split", "ByteLevel"]
        and split[0]["behavior"] == "Removed"
        and split[0]["invert"]
        and split[0]["pattern"]
        == {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
        and not split[1]["add_prefix_space"]
        and not split[1]["use_regex"]
        and not spec["model"].get("dropout")
    )


class _ByteLetters(dict):
    """A letter's spelling in the byte alphabet, as the library's pre-tokenizer gives it."""

    def __init__(self, split):
        super().__init__()
        self.split = split

    def __missing__(self, code):
        self[code] = spelled = "".join(part for part, _ in self.split.pre_tokenize_str(chr(code)))
        return spelled


class Encoder:
    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.by_word = splits_at_blanks(json.loads(tokenizer_json))
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _ByteLetters(self.tokenizer.pre_tokenizer) if self.by_word else None
        self.model = self.tokenizer.model
        self.stems: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _packed(self, ids) -> bytes:
        return np.array(ids, dtype=self.kind).tobytes()

    def _stem_ids(self, stems: list[str]) -> list[bytes]:
        if len(self.stems) > WORDS_KEPT:
            self.stems.clear()
        known, out = self.stems, []
        for stem in stems:
            ids = known.get(stem)
            if ids is None:
                spelled = stem if stem.isascii() else stem.translate(self.letters)
                ids = known[stem] = self._packed([t.id for t in self.model.tokenize(spelled)])
            out.append(ids)
        return out

    def _part_ids(self, parts: list[str]) -> list[bytes]:
        if len(self.parts) > WORDS_KEPT:
            self.parts.clear()
        new = [p for p in parts if p not in self.parts]
        for part, got in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.parts[part] = self._packed(got.ids)
        return [self.parts[p] for p in parts]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and how many each text has; a null text is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        found = [self._slice(texts.slice(a, b - a)) for a, b in slices(texts, SLICE_BYTES)]
        if not found:
            return np.empty(0, self.kind), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            got = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            rows = [np.array(g.ids, dtype=self.kind) for g in got]
            return np.concatenate(rows), np.array([len(r) for r in rows], dtype=np.int64)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        bounds = np.asarray(split.offsets)
        coded = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        which = np.asarray(coded.indices)
        pool, starts, sizes = self._distinct(coded.dictionary)
        width = sizes.sum(axis=1)[which]
        ids = gather(pool, starts[which].ravel(), sizes[which].ravel())
        ends = np.concatenate([[0], np.cumsum(width)])[bounds - bounds[0]]
        return ids, np.diff(ends)

    def _distinct(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pool of ids, and for each part the two places in it: of its letters and of its marks."""
        match = pc.extract_regex(parts, PLAIN_PART)
        plain = np.asarray(match.is_valid())
        stems = pc.utf8_lower(match.field("stem").filter(plain)).dictionary_encode()
        marks = match.field("marks").filter(plain).dictionary_encode()
        packed = self._stem_ids(stems.dictionary.to_pylist())
        first = len(packed)
        packed += self._part_ids(marks.dictionary.to_pylist())
        second = len(packed)
        packed += self._part_ids(parts.filter(~plain if plain.size else plain).to_pylist())
        packed.append(b"")
        code = np.full((len(parts), 2), len(packed) - 1, dtype=np.int64)
        code[plain, 0] = np.asarray(stems.indices)
        code[plain, 1] = first + np.asarray(marks.indices)
        code[~plain, 0] = np.arange(second, len(packed) - 1)
        size = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // self.kind.itemsize
        return np.frombuffer(b"".join(packed), dtype=self.kind), (np.cumsum(size) - size)[code], size[code]


def encoder_of(tokenizer_json: str) -> Encoder:
    """The encoder of this Python worker, with the words it has met in earlier tasks."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_encoders", {})
    if tokenizer_json not in kept:
        kept.clear()
        kept[tokenizer_json] = Encoder(tokenizer_json)
    return kept[tokenizer_json]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one end id after each text."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1
