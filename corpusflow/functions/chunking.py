"""Recursive text chunker: 512-character chunks, 64-character overlap.

The text is handled as spans (start, end), so nothing is copied until a finished chunk is cut out, and
every chunk knows its offset in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.fixed_values import CHUNK_OVERLAP, CHUNK_SEPARATORS, CHUNK_SIZE

Span = tuple[int, int]

CHUNK_TYPE = "array<struct<content:string,start:int>>"


def _pieces(text: str, lo: int, hi: int, separator: str) -> Iterator[Span]:
    """Cut text[lo:hi] in front of every separator, so the separator opens the piece that follows."""
    if not separator:
        yield from ((i, i + 1) for i in range(lo, hi))
        return
    begin, at = lo, text.find(separator, lo, hi)
    while at != -1:
        if at > begin:
            yield begin, at
        begin, at = at, text.find(separator, at + len(separator), hi)
    if begin < hi:
        yield begin, hi


def _pack(run: list[Span], size: int, overlap: int) -> Iterator[Span]:
    """Join neighbouring pieces up to `size`; the next chunk starts with at most `overlap` kept characters."""
    first = 0
    for i, (lo, hi) in enumerate(run):
        if first < i and hi - run[first][0] > size:
            yield run[first][0], run[i - 1][1]
            while first < i and (lo - run[first][0] > overlap or hi - run[first][0] > size):
                first += 1
    if run:
        yield run[first][0], run[-1][1]


def _windows(lo: int, hi: int, size: int, overlap: int) -> Iterator[Span]:
    """What `_pack` makes of single characters."""
    while hi - lo > size:
        yield lo, lo + size
        lo += size - overlap
    if lo < hi:
        yield lo, hi


def _spans(text: str, lo: int, hi: int, separators: tuple[str, ...], size: int, overlap: int) -> Iterator[Span]:
    used = next(
        (i for i, s in enumerate(separators) if not s or text.find(s, lo, hi) != -1),
        len(separators) - 1,
    )
    finer = separators[used + 1:]
    if not separators[used] and size > 1:
        yield from _windows(lo, hi, size, overlap)
        return
    run: list[Span] = []
    for piece in _pieces(text, lo, hi, separators[used]):
        if piece[1] - piece[0] < size:
            run.append(piece)
            continue
        yield from _pack(run, size, overlap)
        run = []
        if finer:
            yield from _spans(text, *piece, finer, size, overlap)
        else:
            yield piece
    yield from _pack(run, size, overlap)


def chunk_spans(
    text: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: tuple[str, ...] = CHUNK_SEPARATORS,
) -> list[Span]:
    """Spans of the stripped, non-empty chunks of one text, in order."""
    found = []
    for lo, hi in _spans(text, 0, len(text), separators, size, overlap):
        body = text[lo:hi]
        lo += len(body) - len(body.lstrip())
        body = body.strip()
        if body:
            found.append((lo, lo + len(body)))
    return found


def chunk_text(
    text: Column | str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: tuple[str, ...] = CHUNK_SEPARATORS,
) -> Column:
    """Column of chunk structs (content, start) for a text column."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")

    @F.pandas_udf(CHUNK_TYPE)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: [
                {"content": t[lo:hi], "start": lo} for lo, hi in chunk_spans(t, size, overlap, separators)
            ],
            na_action="ignore",
        )

    # keeps Catalyst from copying the function into filters on its result
    return split.asNondeterministic()(text)


def explode_chunks(docs: DataFrame, path: str, text: str, **options) -> DataFrame:
    """One row per chunk: id `path::index`, content, chunk_index and start. Documents without chunks vanish."""
    rest = [c for c in docs.columns if c != text]
    return (
        docs.select(*rest, F.posexplode(chunk_text(F.col(text), **options)).alias("chunk_index", "piece"))
        .select(
            *rest,
            F.concat_ws("::", F.col(path), F.col("chunk_index")).alias("id"),
            F.col("piece.content").alias("content"),
            "chunk_index",
            F.col("piece.start").alias("start"),
        )
    )
