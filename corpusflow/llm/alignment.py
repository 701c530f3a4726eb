"""Cross-tokenizer alignment: where the tokens of two tokenizers end together in the same bytes, by diagonal run skipping.

Each text, with a blank before it, is encoded by a byte-level tokenizer (A) and a piece tokenizer (B). Their end arrays
are walked side by side. While tokens pair off one to one the arrays are equal at the present shift of their indexes, so
blocks of growing size are compared there at once (one memory comparison each) and, after the first unequal block, blocks
of shrinking size: a stretch costs the logarithm of its length. What is not one to one is resolved locally, token by
token up to the next common end, which gives the new shift. Common ends cut the tokens into groups; the two tokens that
end a group are linked. No token is empty, so there is one link a group.

Linked tokens end in the same byte, so one is an ending of the other: at most (bytes of both vocabularies) pairs of ids
exist, whatever the corpus. Links are counted per pair in Spark from the written links; the counts, below that bound,
are broadcast to add them up per document. Nothing else is shuffled and every text stays in its row.

Texts are cut before a blank that follows a visible character. Both tokenizers start a token there (checked for B: no
piece has a blank behind another character), so the pieces encode as the whole text does, and a cache of bounded size
keeps encoded pieces. A long text passes in stretches of pieces, as all cuts are common ends.

Defined results: null and empty texts, and texts whose tokens do not spell the blank and the text (they hold U+2581),
have no tokens: zeros and ''. Repeated rows count as often as they occur. An empty table gives no rows. Ids are passed
on unchanged, null included; other columns are left out.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_tokens import ByteTokens
from .common import query, stored, table
from .packing import _BEFORE_BLANK, _CLOSE, _Places

CACHED = 300_000  # pieces of at most LONG characters
LONG = 100
STRETCH = 100_000  # pieces that are aligned at once
JOINED = 100  # pieces encoded as one text


class PieceTokens:
    """A piece model that puts a blank before the text: token bytes by id, and ids of texts given without that blank."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.bytes = [
            bytes([int(x[3:5], 16)]) if self._model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.alone = [self._model.piece_to_id("▁")]  # the model gives nothing for an empty text
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("a piece goes on behind a blank, so texts cannot be cut there")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x or self.alone for x in self._model.encode(texts, num_threads=1)]


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many values of a and of b lie up to each value that both have: two increasing int32 arrays of equal last value.

    Values of a at i and of b at j that are equal define a shift. ``same`` is the length of the stretch from there on
    in which all values are equal at that shift.
    """
    raw_a, raw_b, list_a, list_b = a.tobytes(), b.tobytes(), a.tolist(), b.tolist()
    size_a, size_b = len(list_a), len(list_b)
    at_a, at_b, lengths = array("q"), array("q"), array("q")
    i = j = 0
    while i < size_a:
        x, y = list_a[i], list_b[j]
        while x != y:  # an irregular group: up to the next common end
            if x < y:
                i += 1
                x = list_a[i]
            else:
                j += 1
                y = list_b[j]
        same, step, most = 1, 2, min(size_a - i, size_b - j)
        p, q = 4 * i, 4 * j
        while same < most:  # probe with growing blocks
            end = same + step
            if raw_a[p + 4 * same : p + 4 * end] != raw_b[q + 4 * same : q + 4 * end]:
                break
            same, step = min(end, most), 2 * step
        else:
            step = 0
        while step > 1:  # the first unequal value lies in the last block
            step >>= 1
            end = same + step
            if end <= most and raw_a[p + 4 * same : p + 4 * end] == raw_b[q + 4 * same : q + 4 * end]:
                same = end
        at_a.append(i)
        at_b.append(j)
        lengths.append(same)
        i += same
        j += same
    n = np.frombuffer(lengths, np.int64)
    within = np.arange(1, n.sum() + 1) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.frombuffer(at_a, np.int64), n) + within, np.repeat(np.frombuffer(at_b, np.int64), n) + within


class _Side:
    """Encoded pieces of one tokenizer, one behind the other."""

    def __init__(self, tokens, lead: str) -> None:
        self.tokens, self.lead = tokens, lead
        self.length = np.array([len(x) for x in tokens.bytes], np.int32)
        self.blank = np.array([b" " in x for x in tokens.bytes])
        self.clear()

    def clear(self) -> None:
        self.ids, self.start, self.size, self.spelled = array("I"), array("q"), array("q"), array("b")
        self.mark = 0, 0  # pieces and their ids that are kept

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces, those of one word many at a time: each then starts at a token with a blank."""
        start, size, spelled = (np.zeros(len(pieces), x) for x in (np.int64, np.int64, np.int8))
        word = [i for i, x in enumerate(pieces) if x and " " not in x and not x[-1].isspace()]
        single = [i for i, x in enumerate(pieces) if not x or " " in x or x[-1].isspace()]
        chunks = [word[i : i + JOINED] for i in range(0, len(word), JOINED)]
        join, ids = self.tokens.bytes.__getitem__, self.ids
        joined = [" ".join([pieces[i] for i in chunk]) for chunk in chunks]
        for chunk, text, found in zip(chunks, joined, self.tokens.encode([self.lead + x for x in joined])):
            of_all = np.array(found, np.uint32)
            begin = np.flatnonzero(self.blank[of_all])
            if len(begin) != len(chunk) or b"".join(map(join, found)) != (" " + text).encode():
                single += chunk
                continue
            start[chunk], size[chunk], spelled[chunk] = begin + len(ids), np.diff(begin, append=len(found)), 1
            ids.frombytes(of_all.tobytes())
        for i, found in zip(single, self.tokens.encode([self.lead + pieces[i] for i in single])):
            start[i], size[i], spelled[i] = len(ids), len(found), b"".join(map(join, found)) == (" " + pieces[i]).encode()
            ids.extend(found)
        for kept, new in ((self.start, start), (self.size, size), (self.spelled, spelled)):
            kept.frombytes(new.tobytes())

    def cut(self) -> None:
        """Forget the pieces behind the mark, which are too long to keep."""
        pieces, ids = self.mark
        if pieces < len(self.start):
            del self.ids[ids:]
            for kept in (self.start, self.size, self.spelled):
                del kept[pieces:]

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces asked for, and how many each has."""
        start, size = np.frombuffer(self.start, np.int64)[which], np.frombuffer(self.size, np.int64)[which]
        before = np.cumsum(size) - size
        return np.frombuffer(self.ids, np.uint32)[np.repeat(start - before, size) + np.arange(size.sum())], size


class Aligner:
    """Both tokenizers with a bounded cache, and the alignment of batches of texts."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = _Side(ByteTokens(path_a), " "), _Side(PieceTokens(path_b), "")
        self.at = _Places()
        self.ids_b = len(self.b.length)
        digits = [str(i).encode() for side in (self.a, self.b) for i in range(len(side.length))]
        self.size = np.array([len(x) + 1 for x in digits], np.int8)  # with the sign behind it
        width = int(self.size.max())
        self.digits = np.frombuffer(b"".join(x.ljust(width, b",") for x in digits), np.uint8).reshape(-1, width)

    @staticmethod
    def pieces(text: str) -> list[str]:
        """What follows each blank before which the text, a blank before it, is cut."""
        if text[0].isspace() or any(map(text.__contains__, _CLOSE)):
            return [x[1:] for x in _BEFORE_BLANK.split(" " + text)]
        return text.split(" ")

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Places of the pieces; those of pieces too long to keep are the last."""
        if len(self.at) > CACHED:
            self.at.clear()
            self.a.clear()
            self.b.clear()
        which = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        fresh, self.at.fresh = self.at.fresh, []
        if not fresh:
            return which
        first = len(self.at) - len(fresh)
        order = sorted(range(len(fresh)), key=lambda i: len(fresh[i]) > LONG)
        for new, old in enumerate(order):
            self.at[fresh[old]] = first + new
        moved = np.arange(len(self.at))
        moved[first + np.array(order)] = first + np.arange(len(fresh))
        pieces = [fresh[i] for i in order]
        kept = next((i for i, x in enumerate(pieces) if len(x) > LONG), len(pieces))
        for side in (self.a, self.b):
            side.learn(pieces[:kept])
            side.mark = len(side.start), len(side.ids)
            side.learn(pieces[kept:])
        for x in pieces[kept:]:
            del self.at[x]
        return moved[which]

    def stretches(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[list[str]]]]:
        """Rows and their pieces, some STRETCH pieces at a time; a long text goes on in the next stretch."""
        rows: list[int] = []
        held: list[list[str]] = []
        room = STRETCH
        for row, text in enumerate(texts):
            pieces = self.pieces(text) if text else []
            for i in range(0, len(pieces), STRETCH):
                part = pieces[i : i + STRETCH]
                rows.append(row)
                held.append(part)
                room -= len(part)
                if room <= 0:
                    yield rows, held
                    rows, held, room = [], [], STRETCH
        if rows:
            yield rows, held

    def spelled(self, texts: list[str | None]) -> list[str | None]:
        """Texts whose tokens cannot spell them are taken out: a piece's U+2581 always reads as a blank."""
        return [x if x and "▁" not in x else None for x in texts]

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, np.ndarray, memoryview, bool]]:
        """Row, tokens of A and B, groups, links (ids of A times the size of B plus ids of B), groups as text with a sign at the
        end, and whether the tokens spell the text; a long text has several results, in order."""
        for rows, held in self.stretches(self.spelled(texts)):
            which = self._places(list(chain.from_iterable(held)))
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            fine = np.minimum(np.frombuffer(self.a.spelled, np.int8)[which], np.frombuffer(self.b.spelled, np.int8)[which])
            right = np.minimum.reduceat(fine, cuts[:-1]).astype(bool) if len(held) else fine
            if not right.all():
                for row, is_right in zip(rows, right):
                    if not is_right:
                        yield row, 0, 0, 0, np.zeros(0, np.uint32), memoryview(b""), False
                which = which[np.repeat(right, np.diff(cuts))]
                rows, held = [x for x, y in zip(rows, right) if y], [x for x, y in zip(held, right) if y]
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
            if rows:
                yield from self._aligned(rows, cuts, which)
            for side in (self.a, self.b):
                side.cut()

    def _aligned(self, rows: list[int], cuts: np.ndarray, which: np.ndarray) -> Iterator[tuple]:
        (a, size_a), (b, size_b) = self.a.of(which), self.b.of(which)
        group_a, group_b = common_ends(np.cumsum(self.a.length[a], dtype=np.int32), np.cumsum(self.b.length[b], dtype=np.int32))
        ends_a = np.concatenate([[0], np.cumsum(size_a)])[cuts]
        ends_b = np.concatenate([[0], np.cumsum(size_b)])[cuts]
        ends = np.concatenate([[0], np.searchsorted(group_a, ends_a[1:], "right")])
        links = a[group_a - 1] * np.uint32(self.ids_b) + b[group_b - 1]
        # the tokens of both sides in the order of the groups, each with the sign behind it
        count_a, count_b = np.diff(group_a, prepend=0), np.diff(group_b, prepend=0)
        place_a = np.arange(len(a)) + np.repeat(group_b - count_b, count_a)
        place_b = np.arange(len(b)) + np.repeat(group_a, count_b)
        both = np.empty(len(a) + len(b), np.int64)
        both[place_a], both[place_b] = a, b + np.int64(len(self.a.length))
        sign = np.full(len(both), ord(","), np.uint8)
        sign[place_a[group_a - 1]], sign[place_b[group_b - 1]] = ord("|"), ord(";")
        size = self.size[both]
        signs = self.digits[both]
        signs[np.arange(len(both)), size - 1] = sign
        text = memoryview(signs[np.arange(signs.shape[1], dtype=np.int8) < size[:, None]].tobytes())
        at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[ends_a + ends_b]
        for k, row in enumerate(rows):
            yield (row, int(ends_a[k + 1] - ends_a[k]), int(ends_b[k + 1] - ends_b[k]), int(ends[k + 1] - ends[k]),
                   links[ends[k] : ends[k + 1]], text[at[k] : at[k + 1]], True)


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """One row a document: id, n_a, n_b, n_groups, n_links long, groups_sha256 string, links binary (little-endian unsigned
    32-bit: A's id times the size of B's vocabulary plus B's id) and, if asked for, ``groups``: `a1,a2|b1;a3|b2,b3`."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = np.zeros((3, len(texts)), np.int64)
            links: list[list[bytes]] = [[] for _ in texts]
            shown: list[list[bytes]] = [[] for _ in texts]
            digests = [None] * len(texts)
            wrong = set()
            for row, n_a, n_b, n_groups, linked, written, right in aligner.align(texts):
                if not right:
                    wrong.add(row)
                    continue
                counts[:, row] += (n_a, n_b, n_groups)
                links[row].append(linked.astype("<u4").tobytes())
                if groups:
                    shown[row].append(bytes(written))
                if digests[row] is None:
                    digests[row] = hashlib.sha256(written[:-1])
                else:
                    digests[row].update(b";")
                    digests[row].update(written[:-1])
            for row in wrong:
                counts[:, row], links[row], shown[row], digests[row] = 0, [], [], None
            arrays = [batch.column(0), *(pa.array(x) for x in (*counts, counts[2]))]
            arrays += [pa.array([x.hexdigest() if x else "" for x in digests], pa.string()), pa.array([b"".join(x) for x in links], pa.binary())]
            if groups:
                arrays.append(pa.array([b"".join(x)[:-1].decode() for x in shown], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = [doc_id, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"] + ["groups"] * groups
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary" + ", groups string" * groups
    return docs.select(doc_id, F.col(text).alias("_text")).mapInArrow(aligned, schema)


def _pairs_of(batch_column) -> np.ndarray:
    return np.frombuffer(b"".join(batch_column.to_pylist()), "<u4")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair long, n long): how many links of the corpus hold each pair of ids."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            new, n = np.unique(_pairs_of(batch.column(0)), return_counts=True)
            both, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, place, np.concatenate([counts, n]))
            keys, counts = both, total
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].astype(np.int64)), pa.array(counts[i : i + 100_000])], ["pair", "n"])

    return aligned.select("links").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def linked(aligned: DataFrame, counts: DataFrame, ids_b: int, doc_id: str = "doc_id") -> DataFrame:
    """The documents with n_best (links whose count is the highest of their B id) and count_sum (over all links).

    ``counts`` has at most as many rows as both vocabularies have bytes (see above) and is broadcast.
    """
    top = counts.groupBy((F.col("pair") % ids_b).alias("b")).agg(F.max("n").alias("most"))
    known = counts.withColumn("b", F.col("pair") % ids_b).join(top, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")).toArrow()
    pair = known.column("pair").to_numpy()
    order = np.argsort(pair)
    held = aligned.sparkSession.sparkContext.broadcast(
        (pair[order], known.column("n").to_numpy()[order], known.column("best").to_numpy(zero_copy_only=False)[order]))
    columns = [x for x in aligned.columns if x != "links"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = held.value
        for batch in batches:
            links = batch.column(len(columns))
            at = np.searchsorted(pair, _pairs_of(links))
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in links.to_pylist()])])
            sums = [np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)])[ends] for x in (best, n)] if len(pair) else [np.zeros(len(ends), np.int64)] * 2
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], *(pa.array(np.diff(x)) for x in sums)], [*columns, "n_best", "count_sum"])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in aligned.schema if x.name != "links")
    return aligned.select(*columns, "links").mapInArrow(summed, f"{fields}, n_best long, count_sum long")


@query("op12_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path_b = public_tokenizers.path("piece_bpe_32k.model")
    aligned = stored(align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path_b), "alignment")
    return linked(aligned, pair_counts(aligned), len(PieceTokens(path_b).bytes))
