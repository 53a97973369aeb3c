"""Recursive text splitting for the knowledge base, applied row by row.

The rule. A text up to ``size`` characters stays whole. Otherwise it is cut at the
first separator of the list it contains, each separator staying at the start of the
piece it opens. Pieces shorter than ``size`` are packed in order into chunks of at most
``size``; a new chunk repeats as many trailing pieces of the previous one as fit into
``overlap``. A longer piece is cut again with the remaining separators. Chunks lose
blanks at both ends, and empty ones are dropped; where one or none is left, the whole text stays.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators in order of preference, the second list for Markdown files.
TEXT_SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ", "")
MARKDOWN_SEPARATORS = (
    r"\n#{1,6} ", "```\n", r"\n\*\*\*+\n", r"\n---+\n", r"\n___+\n", r"\n\n", r"\n", " ", "",
)

_TEXT_RULES = tuple(re.escape(mark) for mark in TEXT_SEPARATORS)


def _pieces(text: str, pattern: str) -> list[str]:
    if not pattern:
        return list(text)
    cuts = [0, *(found.start() for found in re.finditer(pattern, text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def _packed(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    held: deque[str] = deque()
    length = 0
    for piece in pieces:
        if held and length + len(piece) > size:
            yield "".join(held)
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.popleft())
        held.append(piece)
        length += len(piece)
    if held:
        yield "".join(held)


def _cut(text: str, rules: tuple[str, ...], size: int, overlap: int) -> Iterator[str]:
    position = next((i for i, rule in enumerate(rules) if not rule or re.search(rule, text)), len(rules) - 1)
    short: list[str] = []
    for piece in _pieces(text, rules[position]):
        if len(piece) < size:
            short.append(piece)
            continue
        yield from _packed(short, size, overlap)
        short = []
        if position + 1 < len(rules):
            yield from _cut(piece, rules[position + 1 :], size, overlap)
        else:
            yield piece
    yield from _packed(short, size, overlap)


def chunk_text(text: str, markdown: bool = False, size: int = 500, overlap: int = 50) -> list[str]:
    if len(text) <= size:
        return [text]
    rules = MARKDOWN_SEPARATORS if markdown else _TEXT_RULES
    chunks = [chunk for chunk in (part.strip() for part in _cut(text, rules, size, overlap)) if chunk]
    return chunks if len(chunks) > 1 else [text]


def chunks_of(text: Column, filename: Column, size: int = 500, overlap: int = 50) -> Column:
    """Array of chunks; only the two columns travel to Python.

    Rows go there some hundred at a time: an Arrow batch would hold the texts and all their chunks of ten thousand
    rows at once.
    """

    @F.udf("array<string>", useArrow=False)
    def split(text: str | None, markdown: bool) -> list[str] | None:
        return None if text is None else chunk_text(text, markdown, size, overlap)

    # Marked so that the optimizer never copies the call into filters: each text is split once.
    return split.asNondeterministic()(text, F.coalesce(filename.endswith(".md"), F.lit(False)))
