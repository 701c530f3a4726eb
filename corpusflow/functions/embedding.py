"""Text to unit vector. The model is a plug-in; the default is a hashed bag of words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# encodes a list of texts to one row of numbers per text
Encoder = Callable[[list[str]], np.ndarray]

_KNOWN_WORDS = 1_000_000


def hashed_bag_of_words(dims: int) -> Encoder:
    """Counts of the space-separated words over md5 buckets. Buckets of words seen before are remembered."""
    bucket_of: dict[str, int] = {}

    def bucket(word: str) -> int:
        found = bucket_of.get(word)
        if found is None:
            if len(bucket_of) >= _KNOWN_WORDS:
                bucket_of.clear()
            found = bucket_of[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dims
        return found

    def encode(texts: list[str]) -> np.ndarray:
        rows = [np.bincount([bucket(w) for w in t.split()], minlength=dims) if t else np.zeros(dims) for t in texts]
        return np.array(rows, dtype=float)

    return encode


def embed(text: Column, dims: int = 64, load_encoder: Callable[[], Encoder] | None = None) -> Column:
    """Unit vector column array<float>.

    `load_encoder` runs once per stream of batches, where a model loads; it encodes the texts as they are. Without
    one, words are lower-cased runs of letters and digits, cut out before the text goes to Python.
    """
    if load_encoder is None:
        load_encoder = lambda: hashed_bag_of_words(dims)
        text = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load_encoder()
        for batch in batches:
            vectors = encode(batch.tolist())
            lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = vectors / np.where(lengths == 0, 1.0, lengths)
            yield pd.Series(list(unit.astype(np.float32)))

    # keeps Catalyst from copying the model call into filters on its result
    return run.asNondeterministic()(F.coalesce(text, F.lit("")))
