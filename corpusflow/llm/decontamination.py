"""Benchmark decontamination: a prefix-filtered set join of item windows with whole texts.

Every item is cut into windows of ``width`` consecutive words (an item of fewer words is one window). A window is a
set of shingles; containment of the whole window makes one shingle a sufficient prefix, and the rarest one in the
corpus, counted over all texts, gives the fewest candidates. A text position where a prefix shingle occurs names the
window's start; the bounds of the text exclude starts and lengths that do not fit, and the candidate is verified
word by word. Texts are read twice (shingle counts, join) and never shuffled.

The windows travel to the tasks in blocks of at most ``block_chars`` characters of items, so memory stays bounded for
any benchmark: each block is one more pass over the row within the same job. Words are compared by their 64-bit hashes.

Defined results: null and empty texts have no words and are clean. Null and empty items have no windows. Rows with the
same item_id are one item; a null item_id marks words as hit and is not listed. Repeated documents are judged alike.
All columns of the documents stay; new columns replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import query, table

SHINGLE = 3


@dataclass(frozen=True)
class Windows:
    """Distinct windows of one length, with the items they belong to."""

    words: np.ndarray  # windows x length, word hashes
    items: list[list[str | None]]

    @property
    def shingles(self) -> np.ndarray:
        """Hashes of the shingles of every window, one row per window."""
        n, length = self.words.shape
        size = min(SHINGLE, length)
        flat = W.runs(self.words.ravel(), size)
        flat = np.concatenate([flat, np.zeros(n * length - len(flat), np.uint64)]).reshape(n, length)
        return flat[:, : length - size + 1]


@dataclass(frozen=True)
class Prefixes:
    """For one window length: sorted prefix shingles, and for each the window and the shingle's place in it."""

    length: int
    shingle: np.ndarray
    window: np.ndarray
    place: np.ndarray
    words: np.ndarray
    items: list[list[str | None]]


def _windows(items: list[tuple[str | None, str | None]], width: int) -> list[Windows]:
    hashed, counts = W.word_hashes([text for _, text in items])
    W._POWERS.clear()  # tasks make their own; closures stay small
    found: dict[int, dict[bytes, set]] = {}
    start = 0
    for (item, _), n in zip(items, counts):
        length = min(width, int(n))
        for at in range(start, start + int(n) - length + 1) if length else ():
            found.setdefault(length, {}).setdefault(hashed[at : at + length].tobytes(), set()).add(item)
        start += int(n)
    return [
        Windows(np.frombuffer(b"".join(of), np.uint64).reshape(len(of), length), [sorted(x, key=str) for x in of.values()])
        for length, of in sorted(found.items())]


def _shingle_counts(docs: DataFrame, text: str, wanted: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """How often each wanted shingle (by size) occurs in all texts."""

    def count(batches) -> Iterator[pd.DataFrame]:
        totals = {size: np.zeros(len(x), np.int64) for size, x in wanted.items()}
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in W.blocks(texts):
                hashed, counts = W.word_hashes(texts[a:b])
                owner = np.repeat(np.arange(b - a), counts)
                for size, known in wanted.items():
                    seen = W.runs(hashed, size)
                    inside = owner[: len(seen)] == owner[size - 1 : size - 1 + len(seen)]
                    at = _find(known, seen)
                    totals[size] += np.bincount(at[(at >= 0) & inside], minlength=len(known))
        for size, total in totals.items():
            some = np.flatnonzero(total)
            yield pd.DataFrame({"size": size, "shingle": wanted[size][some].view(np.int64), "n": total[some]})

    rows = (
        docs.select(F.col(text).alias("text")).mapInPandas(count, "size int, shingle long, n long")
        .groupBy("size", "shingle").agg(F.sum("n").alias("n")).collect())
    return {(r["size"], r["shingle"] & (1 << 64) - 1): r["n"] for r in rows}


def _find(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in the sorted array, -1 where it is missing."""
    out = np.full(len(values), -1)
    if len(known):
        maybe = np.zeros(1 << 18, bool)
        maybe[known >> np.uint64(46)] = True
        some = np.flatnonzero(maybe[values >> np.uint64(46)])
        at = np.minimum(np.searchsorted(known, values[some]), len(known) - 1)
        right = known[at] == values[some]
        out[some[right]] = at[right]
    return out


def _prefixes(windows: Windows, counts: dict[tuple[int, int], int]) -> Prefixes:
    """The rarest shingle of every window; the first of equally rare ones."""
    shingles = windows.shingles
    length = windows.words.shape[1]
    size = min(SHINGLE, length)
    n = np.array([[counts.get((size, int(x)), 0) for x in row] for row in shingles])
    place = n.argmin(axis=1)
    chosen = shingles[np.arange(len(shingles)), place]
    order = np.argsort(chosen, kind="stable")
    return Prefixes(length, chosen[order], order, place[order], windows.words, windows.items)


def _hits(texts: list[str | None], index: list[Prefixes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text: words, spans of hit words (first, end) by position, and the items that occur."""
    hashed, counts = W.word_hashes(texts)
    first = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(texts)), counts)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    for p in index:
        seen = W.runs(hashed, min(SHINGLE, p.length))
        known = np.unique(p.shingle)
        at = np.flatnonzero(_find(known, seen) >= 0)
        low, high = np.searchsorted(p.shingle, seen[at], "left"), np.searchsorted(p.shingle, seen[at], "right")
        each = high - low
        entry = np.repeat(low, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        at = np.repeat(at, each)
        start, text = at - p.place[entry], owner[at]
        fits = (start >= first[text]) & (start + p.length <= first[text + 1])
        start, text, window = start[fits], text[fits], p.window[entry[fits]]
        for k in range(p.length):
            same = hashed[start + k] == p.words[window, k]
            start, text, window = start[same], text[same], window[same]
        for s, t, w in zip(start.tolist(), text.tolist(), window.tolist()):
            spans[t].append((s - int(first[t]), s - int(first[t]) + p.length))
            items[t].update(x for x in p.items[w] if x is not None)
    out = []
    for n, found, names in zip(counts.tolist(), spans, items):
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        out.append((n, merged, sorted(names)))
    return out


_RESULT = "struct<n_words: bigint, spans: array<struct<first: bigint, end: bigint>>, items: array<string>>"


def _matcher(index: list[Prefixes]):
    @F.pandas_udf(_RESULT)
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            rows = [row for a, b in W.blocks(texts) for row in _hits(texts[a:b], index)]
            yield pd.DataFrame({
                "n_words": [r[0] for r in rows],
                "spans": [[{"first": a, "end": b} for a, b in r[1]] for r in rows],
                "items": [r[2] for r in rows]})

    return match


def match_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", *,
    width: int = 10, block_chars: int = 16 << 20,
) -> DataFrame:
    """The documents with ``n_words``, ``hit_spans`` (word positions [first, end) inside item windows; spans of
    different blocks may overlap), ``n_hit`` (words in any span) and ``hit_items`` (sorted ids as strings)."""
    total = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_chars))
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    result = docs
    parts = []
    for k in range(n_blocks):
        block = rows.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == k) if n_blocks > 1 else rows
        windows = _windows([(r["item"], r["text"]) for r in block.collect()], width)
        wanted: dict[int, np.ndarray] = {}
        for x in windows:
            size = min(SHINGLE, x.words.shape[1])
            wanted[size] = np.unique(np.concatenate([wanted.get(size, np.zeros(0, np.uint64)), x.shingles.ravel()]))
        counts = _shingle_counts(docs, text, wanted) if wanted else {}
        result = result.withColumn(f"_items_{k}", _matcher([_prefixes(x, counts) for x in windows])(F.col(text)))
        parts.append(f"_items_{k}")
    spans = F.array_sort(F.flatten(F.array(*[F.col(f"{x}.spans") for x in parts])))
    hit = F.aggregate(
        spans, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("bigint"), s["end"] - F.greatest(a["end"], s["first"]))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end")), lambda a: a["n"])
    return result.withColumns({
        "n_words": F.col(f"{parts[0]}.n_words"), "hit_spans": spans, "n_hit": hit,
        "hit_items": F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{x}.items") for x in parts])))),
    }).drop(*parts)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no item window occurs, with the columns of the input."""
    keep = {c: f"_kept_{i}" for i, c in enumerate(docs.columns)}
    held = docs.select([F.col(f"`{c}`").alias(k) for c, k in keep.items()])
    return match_items(held, items, keep[text]).where("n_hit = 0").select([F.col(k).alias(c) for c, k in keep.items()])


_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM low, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r, p, d.n, item_id FROM dwin d JOIN win USING (n, k)),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""


@query("op6_decontamination", _SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = match_items(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
