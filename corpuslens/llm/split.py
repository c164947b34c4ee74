"""Cutting oversized texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.sources.tables import checked_broadcast, checkpointed

MAX_BYTES = 8192
OVERLAP_CHARS = 200

#: Boundaries, the strongest first; a cut falls behind the match.
_BOUNDARIES = [re.compile(p) for p in (r"\f", r"\n[ \t\r]*\n\s*", r"\n", r"[.!?…][\"'”’»)\]]*\s+", r"[;:,]\s+", r"\s+")]


def _cut(text: str, start: int, end: int, slack: float) -> int:
    """Where to cut text[start:end]: at the strongest boundary near its midpoint, else at the midpoint."""
    middle = (start + end) // 2
    reach = max(1, int((end - start) * slack))
    low, high = max(start + 1, middle - reach), min(end - 1, middle + reach)
    for boundary in _BOUNDARIES:
        best = None
        for m in boundary.finditer(text, max(start, low - 1), high):
            if low <= m.end() <= high and (best is None or abs(m.end() - middle) < abs(best - middle)):
                best = m.end()
        if best is not None:
            return best
    return middle


def pieces(text: str, max_bytes: int = MAX_BYTES, overlap: int = OVERLAP_CHARS, slack: float = 0.2) -> list[tuple[int, int, int]]:
    """Pieces of `text` as (begin, core, end) in characters: text[begin:end], of which [begin:core] repeats the piece before.

    Recursive bisection: a range whose bytes exceed the limit less the overlap is cut at the strongest
    boundary within `slack` of its midpoint (form feed, blank line, line end, sentence end, comma, blank), in
    the middle of a run without any; then both halves likewise. The cores join to the whole text. A text
    within the limit is one piece; an empty text is one empty piece.
    """
    size = len(text.encode("utf-8", "surrogatepass"))
    if size <= max_bytes:
        return [(0, 0, len(text))]
    if max_bytes <= 8 * overlap + 8:
        overlap = max(0, (max_bytes - 8) // 8)
    limit = max_bytes - 4 * overlap  # a character has four bytes at most
    cores, stack = [], [(0, len(text), size)]
    while stack:
        start, end, n = stack.pop()
        if n <= limit or end - start < 2:
            cores.append((start, end))
            continue
        at = _cut(text, start, end, slack)
        left = len(text[start:at].encode("utf-8", "surrogatepass"))
        stack += [(at, end, n - left), (start, at, left)]
    out = [(cores[0][0], *cores[0])]
    for start, end in cores[1:]:
        begin = max(0, start - overlap)
        if overlap and (m := re.compile(r"\s+").search(text, begin, min(start, begin + overlap // 4))):
            begin = m.end() if m.end() < start else begin
        out.append((begin, start, end))
    return out


def split_row(text: str, first_page: int | None, last_page: int | None, **limits) -> list[tuple[int, int | None, int | None, str, int]]:
    """(piece_no, first_page, last_page, text, overlap_chars) of each piece.

    A page break is a form feed. The first page of a piece is the chunk's first page plus the breaks before
    it, its last page is the chunk's last page less the breaks behind it; so pages are exact where all breaks
    survived, and bounds where some were lost. A null page number stays null unless the other one and the
    breaks give it.
    """
    cuts = pieces(text, **limits)
    breaks = text.count("\f")
    if first_page is None and last_page is not None and breaks:
        first_page = last_page - breaks
    elif last_page is None and first_page is not None and breaks:
        last_page = first_page + breaks
    out = []
    for k, (begin, core, end) in enumerate(cuts):
        # page breaks at the edges belong to the neighbours
        inner_begin, inner_end = begin, end
        while inner_begin < end and text[inner_begin] in " \t\r\n\f":
            inner_begin += 1
        while inner_end > inner_begin and text[inner_end - 1] in " \t\r\n\f":
            inner_end -= 1
        if inner_begin == inner_end:
            inner_begin, inner_end = begin, end
        first = None if first_page is None else first_page + text.count("\f", 0, inner_begin)
        last = None if last_page is None else last_page - text.count("\f", inner_end)
        if first is not None and last is not None:
            if first_page <= last_page:
                first = min(first, last_page)
            last = max(first, last)
        out.append((k, first, last, text[begin:end], core - begin))
    return out


_PIECES = "source_id string, chunk_no int, piece_no int, pieces int, first_page int, last_page int, text string, overlap_chars int"


def _split(frames: Iterator[pd.DataFrame], **limits) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for source, chunk, first, last, text in zip(frame["source_id"], frame["chunk_no"], frame["first_page"], frame["last_page"], frame["text"]):
            page = [None if pd.isna(x) else int(x) for x in (first, last)]
            cut = split_row(text, *page, **limits)
            rows += [(source, None if pd.isna(chunk) else int(chunk), k, len(cut), a, b, t, o) for k, a, b, t, o in cut]
        out = pd.DataFrame(rows, columns=["source_id", "chunk_no", "piece_no", "pieces", "first_page", "last_page", "text", "overlap_chars"])
        yield out.astype({"chunk_no": "Int32", "piece_no": "int32", "pieces": "int32", "first_page": "Int32", "last_page": "Int32", "overlap_chars": "int32"})


def _once(chunks: DataFrame) -> DataFrame:
    """Each (source_id, chunk_no) once: the row loaded last, then the larger text. Null keys are keys of their own. Only rows of keys that come more than once are brought together."""
    twice = chunks.groupBy(F.col("source_id").alias("_source"), F.col("chunk_no").alias("_no")).count().where("count > 1").select("_source", "_no")
    twice = checked_broadcast(checkpointed(twice))
    same = F.col("source_id").eqNullSafe(F.col("_source")) & F.col("chunk_no").eqNullSafe(F.col("_no"))
    order = F.struct("loaded_at", F.coalesce(F.octet_length("text"), F.lit(-1)), "text", "first_page", "last_page")
    last = chunks.join(twice, same, "left_semi").groupBy("source_id", "chunk_no").agg(F.max_by(F.struct("first_page", "last_page", "text"), order).alias("x")).select("source_id", "chunk_no", "x.*")
    return chunks.join(twice, same, "left_anti").select("source_id", "chunk_no", "first_page", "last_page", "text").unionByName(last)


def oversized_pieces(chunks: DataFrame, max_bytes: int = MAX_BYTES, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Pieces of the chunks whose text exceeds `max_bytes`; only their rows are read into Python. See split_row."""
    large = _once(chunks.where(F.octet_length("text") > max_bytes).select("source_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.col("first_page").cast("int").alias("first_page"), F.col("last_page").cast("int").alias("last_page"), "text", "loaded_at"))
    return large.mapInPandas(lambda frames: _split(frames, max_bytes=max_bytes, overlap=overlap), _PIECES)


def split_chunks(chunks: DataFrame, max_bytes: int = MAX_BYTES, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """All chunks, the oversized ones as pieces: `source_id, chunk_no, piece_no, pieces, first_page, last_page, text, overlap_chars`.

    Rows delivered twice come out once. A chunk within the limit, also with empty or null text, is its own
    only piece. Texts are whole: without the overlaps, the pieces of a chunk join to its text. Columns beside
    those named are ignored; an empty table gives no row.
    """
    narrow = chunks.select("source_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.col("first_page").cast("int").alias("first_page"), F.col("last_page").cast("int").alias("last_page"), "text", "loaded_at")
    small = _once(narrow.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes))
    whole = small.select("source_id", "chunk_no", F.lit(0).alias("piece_no"), F.lit(1).alias("pieces"), "first_page", "last_page", "text", F.lit(0).alias("overlap_chars"))
    return whole.unionByName(oversized_pieces(chunks, max_bytes, overlap))


def oversized(chunks: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Chunks that come out in several pieces: `source_id, chunk_no`."""
    return oversized_pieces(chunks, max_bytes).where("pieces > 1 AND piece_no = 0").select("source_id", "chunk_no")
