"""Token counts by section: every text is encoded whole and once, and its tokens are dealt to sections by character span.

The tokens' spans and the sections' spans meet in an interval join within the row, by binary search. A token that
crosses a boundary is allocated by an explicit rule: ``first`` gives it to the section of its first character,
``most`` to the section that holds most of its characters (the earlier of equals), among sections that do not overlap.
Tokens that no section counts are counted in the section named null. Texts never leave their row and nothing is shuffled.

Texts are cut before a blank that follows a visible character, where the tokenizer always starts a token, so the pieces
encode as the whole text does. Defined results: null and empty texts have no tokens; their sections, and sections without a first or end, count 0. Repeated
rows are counted alike. Overlapping sections each count their own tokens by the rule. All columns of the input stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table
from .packing import Encoder
from .words import blocks

CHARS = 1 << 19  # characters of text whose tokens are held at once


def _token_spans(encoder: Encoder, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """First and end characters of all tokens of every text."""
    cut, which = encoder.pieces(texts)
    start, size = np.frombuffer(encoder.start, np.int64)[which], np.frombuffer(encoder.size, np.int64)[which]
    length = np.frombuffer(encoder.length, np.int32)[which].astype(np.int64)
    out = np.cumsum(size)
    index = np.repeat(start - (out - size), size) + np.arange(size.sum())
    pieces = np.array([len(x) for x in cut], np.int64)
    before = np.cumsum(length) - length
    places = np.cumsum(pieces) - pieces  # of each text's first piece
    origin = before[np.minimum(places, max(0, len(before) - 1))] if len(before) else np.zeros(len(texts), np.int64)
    shift = np.repeat(before - np.repeat(origin, pieces), size)
    first, stop = np.frombuffer(encoder.first, np.int32)[index] + shift, np.frombuffer(encoder.stop, np.int32)[index] + shift
    bounds = np.concatenate([[0], out])[np.concatenate([[0], np.cumsum(pieces)])]
    return [(first[a:b], stop[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _allocate(first: np.ndarray, end: np.ndarray, sections: list[tuple[int, int]], rule: str) -> list[tuple[int, int]]:
    """The range of tokens that each section [a, b) counts."""
    out = []
    begins, stops = np.array([a for a, _ in sections]), np.array([b for _, b in sections])

    def most(token: int, a: int, b: int) -> bool:
        """Whether no section beside this one holds more of the token, or as much and begins earlier."""
        held = np.minimum(stops, end[token]) - np.maximum(begins, first[token])
        beside = (stops <= a) | (begins >= b)
        own = min(b, end[token]) - max(a, first[token])
        return own > 0 and not (beside & ((held > own) | (held == own) & (begins < a))).any()

    for a, b in sections:
        low, high = (int(x) for x in np.searchsorted(first, (a, max(a, b)), "left"))
        if rule == "most" and b > a:
            if high > low and end[high - 1] > b and not most(high - 1, a, b):
                high -= 1
            if low and end[low - 1] > a and most(low - 1, a, b):
                low -= 1
        out.append((low, max(low, high)))
    return out


def count_tokens(docs: DataFrame, sections: Column, tokenizer: str, text: str = "text", rule: str = "first", output: str = "sections") -> DataFrame:
    """The rows with ``output``: array of (name, first, end, n_tokens).

    ``sections``: an array of structs (name string, first, end: character positions, end exclusive) of the row.
    """
    schema = "array<struct<name: string, first: bigint, end: bigint, n_tokens: bigint>>"

    @F.pandas_udf(schema)
    def counted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encoder = Encoder.held(tokenizer, spans=True)
        for texts, parts in batches:
            rows, held = [], texts.tolist()
            for a, b in blocks(held, CHARS):
                for (first, end), own in zip(_token_spans(encoder, held[a:b]), parts.iloc[a:b]):
                    own = [s for s in own if s is not None] if own is not None else []
                    known = [s["first"] is not None and s["end"] is not None for s in own]
                    ranges = _allocate(first, end, [(s["first"], s["end"]) for s, k in zip(own, known) if k], rule)
                    outside, row, left = np.ones(len(first), bool), [], iter(ranges)
                    for s, k in zip(own, known):
                        low, high = next(left) if k else (0, 0)
                        outside[low:high] = False
                        row.append({"name": s["name"], "first": s["first"], "end": s["end"], "n_tokens": high - low})
                    if outside.any():
                        row.append({"name": None, "first": 0, "end": int(end[-1]), "n_tokens": int(outside.sum())})
                    rows.append(row)
            yield pd.Series(rows, dtype=object)

    return docs.withColumn(output, counted(F.col(text), sections))


def lines_of(text: Column) -> Column:
    """Three sections that cover a text: its first line, its last line and what stands between."""
    n = F.length(text).cast("bigint")
    first = F.when(F.instr(text, "\n") > 0, F.instr(text, "\n")).otherwise(n).cast("bigint")
    tail = F.length(F.substring_index(text, "\n", -1)).cast("bigint")
    last = F.greatest(first, n - tail)
    part = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.alias("first"), b.alias("end"))
    return F.array(part("first_line", F.lit(0).cast("bigint"), first), part("middle", first, last), part("last_line", last, n))


@query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = count_tokens(docs, lines_of(F.col("text")), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.explode("sections").alias("s")).select("doc_id", F.col("s.name").alias("section"), "s.first", "s.end", "s.n_tokens")
