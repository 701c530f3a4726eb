"""Many keywords in one pass over each text: a keyword automaton (goto, fail and output arrays) run in Arrow batches.

The automaton is a full transition table over the byte classes that occur in the keywords, so a step is one lookup and
the time is linear in the text whatever the number of keywords. Texts are cut into segments of ``SEGMENT`` bytes that
begin one keyword's length early, and all segments of a batch step together, as lanes of NumPy arrays.

A dictionary is a parameter of at most ``MOST_BYTES`` bytes of keywords; it travels as a broadcast variable. More than
``MOST_STATES`` states are split over several automata, each of which passes over the text once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SEGMENT = 1024
MOST_STATES = 1 << 18
MOST_BYTES = 64 << 20


class Automaton:
    """Finds which keywords occur in byte strings. Keyword i of the input has the number ``first`` + i."""

    def __init__(self, keywords: Sequence[bytes], first: int = 0) -> None:
        self.longest = max((len(w) for w in keywords), default=0)
        present = np.unique(np.frombuffer(b"".join(keywords), np.uint8))
        self.classes = np.zeros(256, np.int64)  # 0: a byte of no keyword
        self.classes[present] = np.arange(1, len(present) + 1)
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for number, word in enumerate(keywords, first):
            state = 0
            for c in self.classes[np.frombuffer(word, np.uint8)].tolist():
                if c not in children[state]:
                    children[state][c] = len(children)
                    children.append({})
                    ends.append([])
                state = children[state][c]
            ends[state].append(number)
        width = len(present) + 1
        self.goto = np.zeros((len(children), width), np.int32)
        fail = [0] * len(children)
        queue = [0]
        for state in queue:
            if state:
                self.goto[state] = self.goto[fail[state]]  # where no child leads on, the suffix decides
                ends[state] = ends[state] + ends[fail[state]]
            for c, child in children[state].items():
                fail[child] = int(self.goto[fail[state], c]) if state else 0
                queue.append(child)
            for c, child in children[state].items():
                self.goto[state, c] = child
        self.everywhere = np.array(ends[0], np.int64)  # the empty keyword
        self.size = np.array([len(x) for x in ends], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.numbers = np.array([x for e in ends for x in e], np.int64)
        self.flat = self.goto.ravel() * width  # states are kept as row offsets
        self.width = width
        self.hit = self.size > 0

    def found(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a text's place and a keyword's number, in order, each once."""
        sizes = np.array([len(x) for x in texts], np.int64)
        data = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        parts = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(texts)), parts)
        begin = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        stop = np.minimum(begin + SEGMENT, sizes[text])
        begin = np.maximum(begin - max(0, self.longest - 1), 0)
        length = stop - begin
        order = np.argsort(-length, kind="stable")
        at, length, text = (starts[text] + begin)[order], length[order], text[order]
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1 if len(length) else 1), "right")
        state = np.zeros(len(at), np.int64)
        seen: list[np.ndarray] = []
        held, states = 0, len(self.size)
        for step, lanes in enumerate(active.tolist()):
            state = state[:lanes]
            state = self.flat[state + data[at[:lanes] + step]].astype(np.int64)
            hits = np.flatnonzero(self.hit[state // self.width])
            if len(hits):
                seen.append(text[hits] * states + state[hits] // self.width)
                held += len(hits)
                if held > 1 << 22:
                    seen = [np.unique(np.concatenate(seen))]
                    held = len(seen[0])
        pairs = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        text, state = pairs // states, pairs % states
        n = self.size[state]
        number = self.numbers[np.repeat(self.start[state] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        text = np.concatenate([np.repeat(text, n), np.repeat(np.arange(len(texts)), len(self.everywhere))])
        number = np.concatenate([number, np.tile(self.everywhere, len(texts))])
        total = int(number.max()) + 1 if len(number) else 1
        both = np.unique(text * total + number)
        return both // total, both % total


def automata(keywords: Iterable[str]) -> list[Automaton]:
    """Automata that together hold all keywords, numbered in their order."""
    raw = [w.encode() for w in keywords]
    if sum(map(len, raw)) > MOST_BYTES:
        raise ValueError(f"a dictionary has at most {MOST_BYTES} bytes")
    out, first, size = [], 0, 0
    for i, word in enumerate(raw):
        if size and size + len(word) > MOST_STATES:
            out.append(Automaton(raw[first:i], first))
            first, size = i, 0
        size += len(word)
    if len(raw) > first:
        out.append(Automaton(raw[first:], first))
    return out


def contained(spark: SparkSession, text: Column, keywords: Sequence[str]) -> Column:
    """Numbers of the keywords that occur in the text, ascending: array<int>; empty for null."""
    shared = spark.sparkContext.broadcast(automata(keywords))

    @F.pandas_udf("array<int>")
    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [x or b"" for x in batch]
            known = np.array([x is not None for x in batch], bool)
            places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for automaton in shared.value:
                place, number = automaton.found(texts)
                places.append(place)
                found.append(number)
            place, number = np.concatenate(places), np.concatenate(found)
            kept = known[place]
            place, number = place[kept], number[kept]
            order = np.lexsort((number, place))
            cuts = np.searchsorted(place[order], np.arange(1, len(texts)))
            yield pd.Series(np.split(number[order].astype(np.int32), cuts) if len(texts) else [], dtype=object)

    return numbers(text.cast("binary"))


def scores(spark: SparkSession, text: Column, dictionary: Sequence[tuple[str, str, int]], labels: Sequence[str]) -> Column:
    """For each label the sum of the weights of its keywords that occur in the text: array<bigint>."""
    words = list(dict.fromkeys(word for _, word, _ in dictionary))
    number, column = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(labels)}
    by_word = sorted((number[w], column[label], weight) for label, w, weight in dictionary)
    shared = spark.sparkContext.broadcast((automata(words), np.array(by_word, np.int64).reshape(-1, 3)))

    @F.pandas_udf("array<bigint>")
    def summed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, entries = shared.value
        for batch in batches:
            texts = [x or b"" for x in batch]
            out = np.zeros((len(texts), len(labels)), np.int64)
            for automaton in held:
                place, word = automaton.found(texts)
                low, high = np.searchsorted(entries[:, 0], word), np.searchsorted(entries[:, 0], word, "right")
                n = high - low
                entry = entries[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                np.add.at(out, (np.repeat(place, n), entry[:, 1]), entry[:, 2])
            yield pd.Series(list(out), dtype=object)

    return summed(text.cast("binary"))
