"""Chunking: recursive splitting, regions that stay whole, headings, flat and parent-child chunks.

Splitting is recursive and can't be said in SQL, so a document goes through mapInPandas as a whole: one row
in, its chunks out. Ids derive from the source and the position, so that a task that runs twice makes the same rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
Length = Callable[[str], int]


def word_count(text: str) -> int:
    return len(text.split())


@dataclass
class Piece:
    text: str
    hard: bool = False  # cut inside a word, for want of a separator


def split_text(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS, length: Length = len) -> list[Piece]:
    """Pieces below ``size``, packed up to it, each starting with up to ``overlap`` of the one before. A piece of
    just ``size`` is split further. Without a separator left, slices of ``size`` characters."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    return [p for p in _split(text, size, overlap, separators, length) if p.text.strip()]


def _split(text: str, size: int, overlap: int, separators: tuple[str, ...], length: Length) -> list[Piece]:
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), None)
    if at is None or separators[at] == "":
        step = size - overlap
        return [Piece(text[i : i + size].strip(), len(text) > size) for i in range(0, max(1, len(text) - overlap), step)]
    sep, out, small = separators[at], [], []

    def flush() -> None:
        out.extend(Piece(t) for t in _packed(small, sep, size, overlap, length))
        small.clear()

    for part in text.split(sep):
        if not part:
            continue
        if length(part) < size:
            small.append(part)
        else:
            flush()
            out.extend(_split(part, size, overlap, separators[at + 1 :], length))
    flush()
    return out


def _packed(parts: list[str], sep: str, size: int, overlap: int, length: Length) -> list[str]:
    out, held, total, gap = [], [], 0, length(sep)
    for part in parts:
        n = length(part)
        if held and total + n + gap > size:
            out.append(sep.join(held).strip())
            # What the next one repeats: the last parts within the overlap, as long as the new one still fits.
            while held and (total > overlap or total + n + gap > size):
                total -= length(held[0]) + (gap if len(held) > 1 else 0)
                held.pop(0)
        total += n + (gap if held else 0)
        held.append(part)
    if held:
        out.append(sep.join(held).strip())
    return out


_FENCE = re.compile(r"^[ \t]*(```|~~~).*?^[ \t]*\1[ \t]*$", re.M | re.S)
_TABLE = re.compile(r"(?:^[ \t]*\|.*\|[ \t]*(?:\n|\Z)){2,}", re.M)
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$", re.M)


def atomic_regions(text: str) -> list[tuple[int, int]]:
    """Code fences, and tables outside of them."""
    fences = [m.span() for m in _FENCE.finditer(text)]
    tables = [m.span() for m in _TABLE.finditer(text) if not any(a < m.end() and m.start() < b for a, b in fences)]
    return sorted(fences + tables)


def headings(text: str) -> list[tuple[int, int, str]]:
    """(offset, level, title) outside of atomic regions."""
    regions = atomic_regions(text)
    return [(m.start(), len(m[1]), m[2].strip()) for m in _HEADING.finditer(text) if not any(a <= m.start() < b for a, b in regions)]


def section_at(found: list[tuple[int, int, str]], offset: int) -> str | None:
    """The headings in force at an offset, "A > B > C"."""
    path: list[tuple[int, str]] = []
    for at, level, title in found:
        if at > offset:
            break
        path = [(lv, ti) for lv, ti in path if lv < level] + [(level, title)]
    return " > ".join(ti for _, ti in path) or None


def structured_pieces(text: str, size: int, overlap: int, length: Length) -> list[tuple[Piece, int]]:
    """Pieces with the offset of their end; an atomic region that fits stays whole."""
    out: list[tuple[Piece, int]] = []
    pos = 0

    def plain(a: int, b: int) -> None:
        seen = a
        for piece in split_text(text[a:b], size, overlap, length=length):
            at = text.find(piece.text[: max(1, len(piece.text))], max(a, seen - len(piece.text)), b)
            seen = (at if at >= 0 else seen) + len(piece.text)
            out.append((piece, min(seen, b) - 1))

    for a, b in atomic_regions(text):
        if length(text[a:b]) > size:
            continue
        plain(pos, a)
        out.append((Piece(text[a:b].strip()), b - 1))
        pos = b
    plain(pos, len(text))
    return out


def chunk_id(source: object, *parts: object) -> str:
    return hashlib.sha256("|".join(map(str, (source, *parts))).encode()).hexdigest()[:32]


_SCHEMA = "chunk_id string, source_id {kind}, page_number int, chunk_index long, chunk_type string, parent_id string, section string, content string, hard_split boolean"


def numbered(rows: DataFrame, source: str = "source_id", page: str = "page_number") -> DataFrame:
    """Chunks with ``chunk_index`` counted over all pages of their source, from 0. A source's chunks are sorted in one
    task, which spills."""
    w = Window.partitionBy(source).orderBy(page, "chunk_index")
    return rows.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("long"))


def chunks(pages: DataFrame, size: int = 375, overlap: int = 40, parent_size: int = 0, length: Length = word_count, source: str = "source_id", page: str = "page_number", text: str = "content") -> DataFrame:
    """Chunks of each page row. ``parent_size`` 0: flat; -1: parents of three times ``size``; each parent comes
    before its children and is their parent_id. A flat chunk's section is that at its last character, a
    parent-child one's that at its parent's start. Null and blank texts have no chunks; chunk_index counts within the page."""
    big = 3 * size if parent_size == -1 else parent_size
    kind = pages.schema[source].dataType.simpleString()
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def of_page(src, number, body: str) -> Iterator[tuple]:
        found, n = headings(body), 0
        if not big:
            for piece, end in structured_pieces(body, size, overlap, length):
                yield chunk_id(src, number, n, "child"), src, number, n, "child", None, section_at(found, end), piece.text, piece.hard
                n += 1
            return
        start = 0
        for k, (parent, end) in enumerate(structured_pieces(body, big, 0, length)):
            section, pid = section_at(found, max(0, end - len(parent.text) + 1)), chunk_id(src, number, k, "parent")
            yield pid, src, number, n, "parent", pid, section, parent.text, parent.hard
            n += 1
            for piece, _ in structured_pieces(parent.text, size, overlap, length):
                yield chunk_id(src, number, n, "child"), src, number, n, "child", pid, section, piece.text, piece.hard
                n += 1
            start = end

    def run(batches):
        for b in batches:
            rows = [r for src, number, body in zip(b[source], b[page], b[text]) if isinstance(body, str) and body.strip() for r in of_page(src, number, body)]
            yield pd.DataFrame(rows, columns=names)

    return pages.select(source, page, text).mapInPandas(run, _SCHEMA.format(kind=kind))
