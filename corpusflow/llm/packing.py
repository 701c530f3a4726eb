"""Packing: whole documents cut into token sequences of a fixed width by order-preserving dynamic programming.

Every task encodes its documents in the order it reads them, ends each with the end id, and lays them out as one
stream. Runs of documents of some ``run_tokens`` tokens are cut at the positions that make padding plus cut penalties
least: document ends are free, sentence ends and clause ends cost a little, any other place more. The best start of
the sequence that ends at a position is the front of a monotone queue over the positions within reach; starts at a
distance of a power of two, where no padding is due, are looked up beside it. Nothing is shuffled, a task holds one
run, and a repeated task gives the same sequences.

Texts are cut before a blank that follows a visible character; the tokenizer's own pattern always starts a token
there, so pieces encode as the whole text does, and a cache of bounded size keeps encoded pieces.

Defined results: a null or empty text is the end id alone. Repeated documents are packed as often as they occur. An
empty table gives no pieces. Of the input's columns the pieces carry the id alone.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_tokens import ByteTokens
from .common import query, table

#: A white-space character right before a blank; everything that either pattern language counts as white space.
_CLOSE = [chr(c) + " " for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_BEFORE_BLANK = re.compile(r"(?<=\S)(?= )")
CACHED = 300_000  # pieces
CACHED_CHARS = 16 << 20  # of all pieces, whatever their length
_JOINED = 50  # pieces encoded as one text


class _Places(dict):
    """Numbers keys in the order in which they are first asked for, and lists those that are new."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        place = self[key] = len(self)
        self.fresh.append(key)
        return place


class Encoder:
    """Token ids of texts, and how a cut behind each token ranks: 1 sentence end, 2 clause end, 3 elsewhere.

    A piece is what follows a blank up to the next; new pieces are encoded many at a time, joined by their blanks.
    """

    def __init__(self, path: str, spans: bool = False, cached: int = CACHED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.spans, self.cached, self.ranks = spans, cached, ByteTokens(path, special=True)
        vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
        self.rank = np.full(max(vocabulary.values()) + 1, 3, np.int8)
        self.blank = np.zeros(len(self.rank), bool)
        for token, i in vocabulary.items():
            if token[-1:] in ",;:)":
                self.rank[i] = 2
            if token[-1:] in ".!?" or "\u010a" in token:  # the sign that stands for a line end
                self.rank[i] = 1
            self.blank[i] = "\u0120" in token  # the sign that stands for a blank
        if spans:
            spelled = self.ranks.bytes + [x.encode() for x, _ in sorted(vocabulary.items(), key=lambda x: x[1])[len(self.ranks.bytes) :]]
            begun = lambda x: sum(b & 0xC0 != 0x80 for b in x)  # characters that begin in it
            count = lambda f: np.array([f(x) for x in spelled], np.int32)
            self.begun, self.within = count(begun), count(lambda x: x[:1] != b"" and x[0] & 0xC0 == 0x80)
        self.clear()

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character spans of the tokens of a text; a part of a character spans all of it."""
        stop = np.cumsum(self.begun[ids], dtype=np.int32)
        return stop - self.begun[ids] - self.within[ids], stop

    @classmethod
    def held(cls, path: str, spans: bool = False) -> Encoder:
        """The encoder of this worker process, so that the tasks it runs share what it has learned."""
        import tokenizers

        kept = tokenizers.__dict__.setdefault("_encoders_of_this_worker", {})
        if (path, spans) not in kept:
            kept[path, spans] = cls(path, spans, CACHED if spans else 800_000)
        return kept[path, spans]

    def clear(self) -> None:
        self.at = _Places()
        self.ids = array("I")
        self.start, self.size = array("q"), array("q")  # of each place's ids
        self.first, self.stop = array("i"), array("i")  # character spans from the piece's start
        self.length = array("i")  # characters of each place's piece
        self.chars = 0  # of all keys

    def _learn(self) -> None:
        """Encode the new keys: pieces without their blank, or whole pieces marked by a leading blank."""
        fresh, self.at.fresh = self.at.fresh, []
        start, size = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        plain = [i for i, x in enumerate(fresh) if x[:1] != " "]
        single = [(i, x[1:]) for i, x in enumerate(fresh) if x[:1] == " "]
        chunks = [plain[i : i + _JOINED] for i in range(0, len(plain), _JOINED)]
        for a in range(0, len(chunks), 200):
            some = chunks[a : a + 200]
            for chunk, found in zip(some, self.ranks.encode([" " + " ".join([fresh[i] for i in x]) for x in some])):
                ids = np.array(found, np.uint32)
                begin = np.flatnonzero(self.blank[ids])
                if len(begin) != len(chunk):
                    single += [(i, " " + fresh[i]) for i in chunk]
                    continue
                n = np.diff(begin, append=len(ids))
                start[chunk], size[chunk] = begin + len(self.ids), n
                self.ids.frombytes(ids.tobytes())
                if self.spans:
                    shift = np.repeat(np.cumsum([0] + [len(fresh[i]) + 1 for i in chunk[:-1]]), n)
                    first, stop = self.offsets(ids)
                    self.first.frombytes((first - shift.astype(np.int32)).tobytes())
                    self.stop.frombytes((stop - shift.astype(np.int32)).tobytes())
        for a in range(0, len(single), 2000):
            some = single[a : a + 2000]
            for (i, _), found in zip(some, self.ranks.encode([piece for _, piece in some])):
                start[i], size[i] = len(self.ids), len(found)
                self.ids.extend(found)
                if self.spans:
                    first, stop = self.offsets(np.array(found, np.int64))
                    self.first.frombytes(first.tobytes())
                    self.stop.frombytes(stop.tobytes())
        self.length.extend([len(x) - 1 if x[:1] == " " else len(x) + 1 for x in fresh])
        self.chars += sum(map(len, fresh))
        self.start.frombytes(start.tobytes())
        self.size.frombytes(size.tobytes())

    @staticmethod
    def _keys(text: str) -> list[str]:
        if text[-1] == " " or any(map(text.__contains__, _CLOSE)):
            return [" " + x for x in _BEFORE_BLANK.split(text) if x]
        first, *rest = text.split(" ")
        return [" " + first, *rest] if first else rest

    def pieces(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray]:
        """Keys per text, and the places of all keys in order."""
        cut = [self._keys(x) if x else [] for x in texts]
        if len(self.at) > self.cached or self.chars > CACHED_CHARS:
            self.clear()
        which = np.fromiter(map(self.at.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        if self.at.fresh:
            self._learn()
        return cut, which

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut, which = self.pieces(texts)
        start, size = np.frombuffer(self.start, np.int64)[which], np.frombuffer(self.size, np.int64)[which]
        out = np.cumsum(size)
        ids = np.frombuffer(self.ids, np.uint32)[np.repeat(start - (out - size), size) + np.arange(size.sum())]
        per_text = np.concatenate([[0], np.cumsum([len(x) for x in cut])])
        bounds = np.concatenate([[0], out])[per_text]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def cut_positions(size: int, rank: np.ndarray, width: int, gap: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a run may be cut and their ranks: all natural ends, and places in between at most ``gap`` apart."""
    natural = np.flatnonzero(rank < 3) + 1
    edges = np.concatenate([[0], natural[natural < size], [size]])
    steps = np.diff(edges)
    more = [np.arange(a + gap, a + n, gap) for a, n in zip(edges[:-1][steps > gap], steps[steps > gap])]
    cuts = np.unique(np.concatenate([edges, *more]))
    return cuts, np.concatenate([[0], rank[cuts[1:] - 1]])


def best_cuts(cuts: np.ndarray, penalty: np.ndarray, width: int, each: float = 32.0) -> list[int]:
    """The cut positions of least padding plus penalties.

    A sequence of n tokens is padded to the width unless n is a power of two, and costs ``each`` besides.
    """
    n = len(cuts)
    exact: list[list[int]] = [[] for _ in range(n)]
    reach = 1
    while reach <= width:
        at = np.searchsorted(cuts, cuts - reach)
        for j in np.flatnonzero(cuts[at] == cuts - reach).tolist():
            exact[j].append(int(at[j]))
        reach *= 2
    place, fee = cuts.tolist(), (penalty + each).tolist()
    best, back, key = [0.0] * n, [0] * n, [0.0] * n  # key: cost so far plus position, least at the queue's front
    queue = deque([0])
    for j in range(1, n):
        p = place[j]
        while place[queue[0]] < p - width:
            queue.popleft()
        start = queue[0]
        low = key[start] + width - p
        for i in exact[j]:
            if best[i] < low:
                low, start = best[i], i
        best[j], back[j] = low + fee[j], start
        key[j] = k = best[j] + p
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return [place[i] for i in reversed(out)]


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", *, width: int = 1024, end_id: int = 0,
    penalties: tuple[float, float, float, float] = (0.0, 2.0, 4.0, 12.0), run_tokens: int = 1 << 18, share: bool = True,
) -> DataFrame:
    """Pieces of documents: id, start (the document's ids before the piece), length, ids (little-endian 32-bit),
    doc_tokens, sequence_id and offset in the sequence. ``penalties``: cuts at document, sentence and clause ends and
    elsewhere, in tokens of padding. ``share``: keep what has been encoded for the worker's next tasks, which saves time and
    takes some 200 MB a worker; otherwise a task keeps its own, a third of that, and frees it."""

    def run(ids: list, parts: list[np.ndarray], encoder: Encoder, sequence: int) -> tuple[pd.DataFrame, int]:
        sizes = np.array([len(x) for x in parts])
        ends = np.cumsum(sizes)
        stream = np.concatenate(parts)
        rank = encoder.rank[stream]
        rank[ends - 1] = 0
        cuts, ranks = cut_positions(len(stream), rank, width)
        chosen = np.array(best_cuts(cuts, np.array(penalties)[ranks], width))
        edges = np.union1d(chosen, ends)
        first, last = np.concatenate([[0], edges[edges > 0][:-1]]), edges[edges > 0]
        doc = np.searchsorted(ends, first, side="right")
        where = np.searchsorted(chosen, first, side="right") - 1
        rows = pd.DataFrame({
            "id": [ids[i] for i in doc], "start": first - (ends - sizes)[doc], "length": last - first,
            "ids": [stream[a:b].astype("<u4").tobytes() for a, b in zip(first, last)], "doc_tokens": sizes[doc],
            "sequence_id": where + sequence, "offset": first - chosen[where]})
        return rows, sequence + len(chosen) - 1

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.held(tokenizer) if share else Encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 33
        ids: list = []
        parts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for a in range(0, len(batch), 500):
                some = batch.iloc[a : a + 500]
                for i, tokens in zip(some["id"], encoder.encode(some["text"].tolist())):
                    ids.append(i)
                    parts.append(np.append(tokens, np.uint32(end_id)))
                    size += len(tokens) + 1
                    if size >= run_tokens:
                        rows, sequence = run(ids, parts, encoder, sequence)
                        yield rows
                        ids, parts, size = [], [], 0
        if parts:
            yield run(ids, parts, encoder, sequence)[0]

    kind = docs.schema[doc_id].dataType
    schema = "id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    # as text, a large id beside a null one stays what it is
    pieces = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(packed, schema)
    return pieces.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", doc_id)


@query("op4_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
