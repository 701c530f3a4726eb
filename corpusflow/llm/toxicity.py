"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

A window is one word (up to 48 bytes of it) behind a constant frame that both dictionaries know, so that a
compressed length is that of the word alone. Toxic words come out shorter under the toxic dictionary. A text is
judged by the shares of its windows whose two lengths differ by at least 1, 2, ... bytes; a logistic curve
fitted on labelled rows that the dictionaries have not seen turns the shares into a score between 0 and 1.

The document frequencies that choose the dictionaries' samples cover all labelled rows given. What reaches the
driver is bounded by parameters: ``toxic_words`` and ``ordinary_words`` rows of counts and ``fit_rows`` rows of shares.

Defined results: a null or empty text has no windows and gets the score of no evidence. Rows without a usable label
teach nothing; without labelled rows of both kinds every score is 0.0. Repeated rows are scored alike. All columns of
the input stay; the new ones replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, fold_of, in_fold, query, small, stored, table

FRAME = "<window of text> "
STEPS = 8  # differences of so many bytes or more share a bin
_WORD = "[^\\x00-\\x60\\x7B-\\x7F]+"  # of lower-cased text
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))  # the same in UTF-8: other bytes become spaces
_FEATURES = T.ArrayType(T.DoubleType())


@dataclass(frozen=True)
class Model:
    toxic: bytes  # trained dictionaries
    ordinary: bytes
    weights: tuple[float, ...]  # bias, then one weight per step
    level: int = 19


def _windows(text: str) -> list[bytes]:
    """Every word whole, long ones in pieces of 48 bytes."""
    words = text.lower().encode().translate(_LETTERS).split()
    if len(max(words, key=len, default=b"")) > 48:
        words = [word[i : i + 48] for word in words for i in range(0, len(word), 48)]
    return words


class _Memo(dict):
    """Values of a function by window: the latest ``most`` windows, and behind them as many met before."""

    def __init__(self, value, most: int = 250_000):
        self.value, self.most, self.before = value, most, {}

    def __missing__(self, window: bytes) -> int:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        known = self.before.get(window)
        self[window] = known = self.value(window) if known is None else known
        return known


def _measure(toxic: bytes, ordinary: bytes, level: int):
    """A function from texts to the shares of windows by difference of length."""
    import zstandard

    def compressor(content: bytes):
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress

    known, rude, frame = compressor(ordinary), compressor(toxic), FRAME.encode()

    def step(window: bytes) -> int:
        framed = frame + window + b" "
        return min(max(len(known(framed)) - len(rude(framed)), 0), STEPS)

    memo = _Memo(step)

    def shares(text: str | None) -> np.ndarray:
        windows = _windows(text) if text else []
        steps = np.fromiter(map(memo.__getitem__, windows), np.int64, len(windows))
        above = np.bincount(steps, minlength=STEPS + 1)[::-1].cumsum()[::-1][1:]
        # the square root lets one clear hit in a long text still count
        return np.log1p(200.0 * above / (len(steps) + 50.0)), np.log1p(above)

    return lambda text: np.concatenate(shares(text))


def _features(df: DataFrame, text: str, toxic: bytes, ordinary: bytes, level: int):
    @F.pandas_udf(_FEATURES)
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = _measure(toxic, ordinary, level)
        for batch in batches:
            yield pd.Series([measure(x) for x in batch])

    return features(df[text])


def _words(labelled: DataFrame, text: str, label: str) -> DataFrame:
    return labelled.select(F.col(label).alias("toxic"), F.regexp_extract_all(F.lower(F.col(text)), F.lit(_WORD), F.lit(0)).alias("w"))


def _row_counts(labelled: DataFrame, text: str, label: str) -> DataFrame:
    """In how many toxic and how many ordinary rows each word occurs."""
    each = _words(labelled, text, label).select("toxic", F.explode(F.array_distinct("w")).alias("word")).where(F.length("word") <= 48)
    return each.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))


def _neighbour_counts(labelled: DataFrame, text: str, label: str, wanted: DataFrame) -> DataFrame:
    """Before how many different words each wanted word stands in toxic and in ordinary rows.

    A text copied a thousand times has many rows and few neighbours, so it is no evidence. ``wanted`` is bounded.
    """
    pairs = F.arrays_zip(F.col("w").alias("word"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("next"))
    each = _words(labelled, text, label).select("toxic", F.explode(pairs).alias("p")).select("toxic", "p.word", "p.next")
    return (
        each.join(F.broadcast(wanted), "word", "left_semi")
        .groupBy("word", "next").agg(F.max("toxic").alias("bad"), F.max(1 - F.col("toxic")).alias("good"))
        .groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))


def _dictionary(samples: list[tuple[str, int]], size: int, tail: bool) -> bytes | None:
    """A dictionary trained on framed windows, each as often as counted.

    The trainer leaves out much of a small vocabulary. With ``tail`` the windows themselves follow what it chose, the
    most frequent last, where references are shortest.
    """
    import zstandard

    framed = [(FRAME + word + " ").encode() for word, n in samples for _ in range(n + 1)]
    total = sum(map(len, framed))
    framed *= 1 + 4096 // max(1, total)
    try:
        trained = zstandard.train_dictionary(max(256, min(size, total // 4)), framed, k=48, d=6).as_bytes()
    except zstandard.ZstdError:
        return None
    return trained + ("".join(word + " " for word, _ in reversed(samples)) + FRAME).encode() if tail else trained


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic curve by Newton steps, bias first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + l2 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(
    labelled: DataFrame, text: str = "text", label: str = "toxic", part: str | None = None, *, toxic_words: int = 20_000,
    ordinary_words: int = 50_000, least_evidence: float = 10.0, least_ratio: float = 4.0, toxic_bytes: int = 16_384,
    ordinary_bytes: int = 110_000, fit_rows: int = 20_000, level: int = 19,
) -> Model | None:
    """Train on rows with a text and a label 0 or 1; None when either kind is missing.

    Rows where the boolean column ``part`` is true calibrate, the others fill the dictionaries; without it a hash of
    the text decides. A word is a toxic sample when it is at least ``least_ratio`` times as frequent in toxic rows as in
    ordinary ones, and its count there times the logarithm of that ratio reaches ``least_evidence``. Of more words than
    the bounds allow, the most frequent are taken (ties by the word); some ``fit_rows`` rows, chosen by a hash of the text,
    calibrate.
    """
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("toxic"),
        (F.coalesce(F.col(part), F.lit(False)) if part else F.pmod(F.xxhash64(text), F.lit(4)) == 0).alias("held"))
    counts = rows.groupBy("held", "toxic").count().collect()
    n = {(r["held"], r["toxic"]): r["count"] for r in counts}
    bad, good = n.get((False, 1), 0), n.get((False, 0), 0)
    if not bad or not good:
        return None
    learn = rows.where("not held")
    ratio = (F.col("bad") / bad) / ((F.col("good") + 0.5) / good)
    words = stored(
        _row_counts(learn, "text", "toxic").select("word", "bad", "good", ((F.col("bad") > 2) & (ratio >= least_ratio)).alias("picked"))
        .where("picked or good > 2"), "toxicity-words")
    wanted = words.where("picked").orderBy(F.desc("bad"), "word").limit(toxic_words).select("word")
    told = (F.col("bad") > 0) & (ratio >= least_ratio) & (F.col("bad") * F.log(ratio) >= least_evidence)
    rude = _neighbour_counts(learn, "text", "toxic", wanted).where(told).orderBy(F.desc("bad"), "word").collect()
    plain = words.where("not picked").orderBy(F.desc("good"), "word").limit(ordinary_words).collect()
    toxic = _dictionary([(r["word"], min(r["bad"], 200)) for r in rude], toxic_bytes, True) if rude else None
    ordinary = _dictionary([(r["word"], min(r["good"], 10)) for r in plain], ordinary_bytes, False) if plain else None
    if toxic is None or ordinary is None:
        return Model(b"", b"", (math.log(bad / good),), level)
    held = bool(n.get((True, 1)) and n.get((True, 0)))
    share = min(1.0, fit_rows / sum(c for (part, _), c in n.items() if part or not held))
    kept = (rows.where("held") if held else rows).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    seen = kept.select("toxic", _features(kept, "text", toxic, ordinary, level).alias("f")).collect()
    if len({r["toxic"] for r in seen}) < 2:
        return Model(b"", b"", (math.log(bad / good),), level)
    weights = _logistic(np.array([r["f"] for r in seen]), np.array([r["toxic"] for r in seen], float))
    return Model(toxic, ordinary, tuple(float(w) for w in weights), level)


def score(docs: DataFrame, model: Model | None, text: str = "text", output: str = "score") -> DataFrame:
    """The rows with their toxicity as a double column."""
    if model is None:
        return docs.withColumn(output, F.lit(0.0))
    if not model.toxic:
        return docs.withColumn(output, F.lit(1 / (1 + math.exp(-model.weights[0]))))
    toxic, ordinary, level, weights = model.toxic, model.ordinary, model.level, np.array(model.weights)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = _measure(toxic, ordinary, level)
        for batch in batches:
            logits = np.array([weights[0] + measure(x) @ weights[1:] for x in batch], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -30, 30))))
        del measure
        give_back()

    return docs.withColumn(output, toxicity(F.col(text)))


def remove_toxic(docs: DataFrame, model: Model | None, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows whose score stays below the limit, with the columns of the input."""
    scored = score(docs, model, text, "_toxicity")
    return scored.where(F.col("_toxicity") < limit).drop("_toxicity")


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the rows whose crc32(doc_id) mod 5 isn't 0; those with remainder 4 calibrate.

    An id with several labels counts as toxic when any of them says so.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").where(~in_fold(F.col("doc_id"), 5)).join(small(marks), "doc_id")
    return fit(rows.withColumn("held", fold_of(F.col("doc_id"), 5) == 4), part="held")


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = score(docs.select("doc_id", "text"), fit_on_labels(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc_id", in_fold(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
