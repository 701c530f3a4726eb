"""Keyword routing: rule-based text classification with substring keywords.

Short dictionaries stand in the plan as literals. Longer ones are found by a keyword automaton, in one pass over the text
(`automaton`); the rows are the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.fixed_values import ROUTING_KEYWORDS, STRONG_ROUTING_KEYWORDS
from corpusflow.operators.automaton import contained, scores

AMBIGUOUS = "ambiguous"
LITERALS = 200  # entries of a dictionary that may stand in the plan

Keywords = Mapping[str, Sequence[str]]


def weighted(keywords: Keywords = ROUTING_KEYWORDS, strong: Keywords = STRONG_ROUTING_KEYWORDS) -> list[tuple[str, str, int]]:
    """Dictionary rows (label, keyword, weight): weight 2 for strong keywords, which count once more."""
    return [
        (label, word, (word in listed) + (word in strong.get(label, ())))
        for label, listed in keywords.items()
        for word in dict.fromkeys([*listed, *strong.get(label, ())])
    ]


def keyword_hits(df: DataFrame, text: str, dictionary: Sequence[tuple[str, str, int]], literals: int = LITERALS) -> DataFrame:
    """One row per dictionary entry contained in the text: the other columns, label, keyword, weight. Nothing shuffles."""
    lowered = F.lower(F.col(text))
    rest = [c for c in df.columns if c != text]
    if len(dictionary) > literals:
        return _found_entries(df, lowered, rest, dictionary)
    entries = F.array(*[
        F.when(
            F.contains(lowered, F.lit(word)),
            F.struct(F.lit(label).alias("label"), F.lit(word).alias("keyword"), F.lit(weight).alias("weight")),
        )
        for label, word, weight in dictionary
    ])
    return df.select(*rest, F.inline(F.array_compact(entries)))


def _found_entries(df: DataFrame, lowered: Column, rest: list[str], dictionary: Sequence[tuple[str, str, int]]) -> DataFrame:
    spark = df.sparkSession
    words = list(dict.fromkeys(word for _, word, _ in dictionary))
    number = {word: i for i, word in enumerate(words)}
    rows = [(number[word], label, word, weight) for label, word, weight in dictionary]
    # as bounded as the automaton's broadcast
    held = F.broadcast(spark.createDataFrame(rows, "_entry int, label string, keyword string, weight int"))
    found = df.select(*rest, F.explode(contained(spark, lowered, words)).alias("_entry"))
    return found.join(held, "_entry").select(*rest, "label", "keyword", "weight")


def _score(lowered: Column, entries: list[tuple[str, int]]) -> Column:
    terms = [F.when(F.contains(lowered, F.lit(word)), weight).otherwise(0) for word, weight in entries]
    return reduce(Column.__add__, terms)


def route(
    df: DataFrame,
    text: str,
    dictionary: Sequence[tuple[str, str, int]] | None = None,
    override: Column | None = None,
    literals: int = LITERALS,
) -> DataFrame:
    """Add `label`: the only label with the highest positive score, else 'ambiguous'. `override` wins if set."""
    dictionary = weighted() if dictionary is None else dictionary
    labels = list(dict.fromkeys(l for l, _, _ in dictionary))
    lowered = F.lower(F.col(text))
    if len(dictionary) > literals:
        sums = scores(df.sparkSession, lowered, dictionary, labels)
        each = F.arrays_zip(sums.alias("score"), F.array(*[F.lit(x) for x in labels]).alias("label"))
    else:
        each = F.array(*[
            F.struct(_score(lowered, [(w, n) for l, w, n in dictionary if l == label]).alias("score"), F.lit(label).alias("label"))
            for label in labels
        ])
    scored = df.withColumn("_scores", each)
    top = F.array_max(F.transform("_scores", lambda s: s["score"]))
    best = F.filter("_scores", lambda s: (s["score"] == top) & (s["score"] > 0))
    routed = F.when(F.size(best) == 1, best[0]["label"]).otherwise(AMBIGUOUS)
    return scored.withColumn("label", routed if override is None else F.coalesce(override, routed)).drop("_scores")
