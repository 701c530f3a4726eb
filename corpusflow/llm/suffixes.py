"""Suffix-array dedup: bytes covered by a string of a fixed length that also starts in a document with a smaller id go.

Difference-cover blockwise construction, dealt out by Spark. A suffix's bucket is not set by splitters but by its anchor,
the least hash of the 20-byte strings in its first 50 bytes: equal strings have equal anchors, and neighbouring suffixes
mostly share one, so they travel to their bucket as one short string (a fragment). Each Spark group is one bucket; in it

* the suffixes at the positions of a difference cover (6 of 31) are ranked first;
* the other suffixes are sorted one smaller bucket of leading bytes at a time, to a depth of 32 bytes only; what is still
  tied there is partitioned by pivots, comparing two suffixes by the ranks at the shift that puts both on the cover;
* neighbours that agree on 50 bytes are one string, whose least document decides.

The steps: (1) each block of documents sends the anchors it has, (2) their buckets answer which are shared with another
document, (3) the block sends the fragments of shared anchors, once each with its least id, (4) the buckets answer which
of their strings start in a smaller document elsewhere, (5) the block removes. Documents are shuffled once, by block, and
the steps reuse that shuffle. Anchors of very many different fragments (``hot``) send their strings one by one, dealt by
the string's own hash, so no bucket gathers them. A block passes in slices of bounded size, so long texts do too.

Bounds: a task holds one slice with its arrays (some 40 bytes a byte), the text of one block, or one bucket: the anchors
of four blocks' worth of text or the fragments of one. There are as many blocks and buckets as the input's size demands;
each slice sends one row of anchors to a bucket, so ``block_bytes`` should grow with the executors' memory on large inputs. Nothing goes to the driver but
the input's size in bytes. Hashes only choose candidates and fold equal fragments of a slice (128 bits); strings of
different blocks are compared byte by byte.

Defined results: null texts are empty. Texts shorter than the length keep all. A null id is neither smaller nor larger
than any: such rows keep all and take nothing from others. Rows with equal ids take nothing from each other. Ids are
passed on unchanged; other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table

GRAM, MOST = 20, 31  # bytes of an anchor string, and strings of a fragment at most
_U = np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences reach every residue."""
    size = 1
    while size * (size - 1) + 1 < period:
        size += 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            if len({(a - b) % period for a in (0, *rest) for b in (0, *rest)}) == period:
                return (0, *rest)
        size += 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MIX[1]
    return h ^ (h >> _U(29))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number each."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


def _string_hash(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    h = np.full(len(at), length, _U)
    for shift in (*range(0, length - 7, 8), length - 8):
        h = (h ^ (h >> _U(29))) * _MIX[2] + words[at + shift]
        h = (h ^ (h >> _U(32))) * _MIX[0]
    return _mixed(h)


def _anchors(data: np.ndarray, length: int) -> np.ndarray:
    """The least hash of the GRAM-byte strings in the ``length`` bytes from every position on."""
    words = _words(data).copy()
    h = words[: len(data) - GRAM + 1] * _MIX[0]
    for shift in (8, GRAM - 8):
        h ^= h >> _U(32)
        h += words[shift : shift + len(h)]
        h *= _MIX[1]
    h ^= h >> _U(31)
    wide, want = 1, length - GRAM + 1
    while wide < want:
        step = min(wide, want - wide)
        h = np.minimum(h[:-step], h[step:])
        wide += step
    return h


class _Slice:
    """The fragments of a stretch of a block: those that are alike are one, in the order of their anchors.

    ``places``: for each different fragment its anchor, number of strings, least rank and where an occurrence starts;
    ``of``, ``at``, ``rank``: fragment, position and document rank of all occurrences, grouped by fragment.
    """

    def __init__(self, block: _Block, first: int, stop: int) -> None:
        length = block.length
        data = block.data[first : stop + length - 1]
        n = len(data) - length + 1
        starts = np.flatnonzero(block.has_string(first, first + n)) if n > 0 else np.zeros(0, np.int64)
        least = _anchors(data, length)[starts] if len(starts) else np.zeros(0, _U)
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(starts) != 1) | (least[1:] != least[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(begin, append=len(starts))
        parts = -(-size // MOST)  # long runs of one anchor are cut
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, count = np.repeat(begin, parts) + within * MOST, np.minimum(np.repeat(size, parts) - within * MOST, MOST)
        anchor, at = _mixed(least[at]), starts[at]
        words = _words(data)
        key = _string_hash(words, at, length) * _MIX[1] ^ _string_hash(words, at + count - 1, length) + count.astype(_U)
        self._fold(anchor, key, at + first, count, block.rank_at(at + first))

    def _fold(self, anchor: np.ndarray, key: np.ndarray, at: np.ndarray, count: np.ndarray, rank: np.ndarray) -> None:
        order = np.lexsort((rank, key, anchor))
        anchor, key = anchor[order], key[order]
        self.at, self.count, self.rank = at[order], count[order], rank[order]
        new = np.ones(len(order), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1])
        self.first = np.flatnonzero(new)  # the occurrence of the least rank
        self.of = np.cumsum(new) - 1
        self.anchor = anchor[self.first]

    def shared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different anchors, how many different fragments each has, and whether it occurs under several ranks."""
        new = np.ones(len(self.anchor), bool)
        new[1:] = self.anchor[1:] != self.anchor[:-1]
        begin = np.flatnonzero(new)
        self.anchor_of = np.cumsum(new) - 1
        if not len(begin):
            return self.anchor, begin, begin.astype(bool)
        places = self.first[begin]
        low, high = np.minimum.reduceat(self.rank, places), np.maximum.reduceat(self.rank, places)
        return self.anchor[begin], np.diff(begin, append=len(new)), low != high

    def sent(self, codes: np.ndarray, block: _Block) -> list[_Sent]:
        """The fragments of shared anchors, and the single strings of hot ones."""
        code = codes[self.anchor_of[self.of]] if len(self.of) else np.zeros(0, np.uint8)
        plain, hot = code == 1, np.flatnonzero(code == 2)
        out = [_Sent(self.at[plain], self.count[plain], self.rank[plain], self.of[plain], self.anchor, block)]
        if len(hot):
            count = self.count[hot]
            at = np.repeat(self.at[hot], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            low = at.min()
            words = _words(block.data[low : at.max() + block.length])
            one = _string_hash(words, at - low, block.length)
            self_rank = np.repeat(self.rank[hot], count)
            order = np.lexsort((self_rank, at, one))
            order = np.lexsort((self_rank, one))
            one, at, self_rank = one[order], at[order], self_rank[order]
            new = np.ones(len(one), bool)
            new[1:] = one[1:] != one[:-1]
            out.append(_Sent(at, np.ones(len(at), np.int64), self_rank, np.cumsum(new) - 1, one[new], block))
        return out


class _Sent:
    """Occurrences of what is sent, grouped; each group is sent once, from its occurrence of least rank."""

    def __init__(self, at: np.ndarray, count: np.ndarray, rank: np.ndarray, of: np.ndarray, anchor: np.ndarray, block: _Block) -> None:
        self.at, self.count, self.rank = at, count, rank
        new = np.ones(len(of), bool)
        new[1:] = of[1:] != of[:-1]
        self.first, self.place = np.flatnonzero(new), np.cumsum(new) - 1
        self.anchor = _mixed(anchor[of[self.first]] + _MIX[2]) if len(of) else np.zeros(0, _U)

    def strings(self, block: _Block) -> pa.Array:
        at, size = self.at[self.first], self.count[self.first] + block.length - 1
        ends = np.cumsum(size)
        index = np.repeat(at - (ends - size), size) + np.arange(size.sum())
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(block.data[index])])

    def removed(self, masks: np.ndarray) -> np.ndarray:
        """Where strings start that go: all of a fragment's if a smaller document of the block has it, else those marked."""
        if not len(self.at):
            return self.at
        later = self.rank > self.rank[self.first][self.place]
        mask = np.where(later, (1 << self.count) - 1, masks[self.place])
        hit = np.flatnonzero(mask)
        bits = (mask[hit, None] >> np.arange(MOST)) & 1
        row, shift = np.nonzero(bits)
        return self.at[hit][row] + shift


class _Block:
    """The documents of one block in the order of their ids, one behind the other."""

    def __init__(self, rows: pa.Table, length: int, slice_bytes: int) -> None:
        rows = rows.select(["id", "text"]).sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()
        self.ids, texts = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rows.column(0), rows.column(1)))
        self.length, self.slice_bytes = length, slice_bytes
        ranks = pc.rank(self.ids, tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.cumsum(sizes)
        self.starts, self.ranks = self.ends - sizes, ranks
        offset = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset] if len(texts) else 0
        size = int(self.ends[-1]) if len(texts) else 0
        self.data = np.frombuffer(texts.buffers()[2], np.uint8)[offset : offset + size] if size else np.zeros(0, np.uint8)

    def has_string(self, first: int, stop: int) -> np.ndarray:
        """Whether a string of the length starts at each position and ends in the same document."""
        step = np.zeros(stop - first + 1, np.int8)
        long = self.ends - self.starts >= self.length
        a, b = (np.clip(x[long], first, stop) - first for x in (self.starts, self.ends - self.length + 1))
        np.add.at(step, a, 1)
        np.subtract.at(step, b, 1)
        return np.cumsum(step[:-1], dtype=np.int8) > 0

    def rank_at(self, at: np.ndarray) -> np.ndarray:
        return self.ranks[np.searchsorted(self.ends, at, "right")]

    def slices(self) -> Iterator[tuple[int, _Slice]]:
        for number, first in enumerate(range(0, len(self.data), self.slice_bytes)):
            yield number, _Slice(self, first, min(first + self.slice_bytes, len(self.data)))

    def covered(self, removed: np.ndarray) -> np.ndarray:
        """Which bytes lie in a string that goes. ``removed``: flags of the starts."""
        out = np.zeros(len(removed), bool)
        for first in range(0, len(removed), self.slice_bytes):
            some = removed[max(0, first - self.length + 1) : first + self.slice_bytes]
            total = np.concatenate([np.zeros(self.length, np.int32), np.cumsum(some, dtype=np.int32)])
            own = total[self.length :] - total[: -self.length] > 0
            out[first : first + self.slice_bytes] = own[len(some) - len(out[first : first + self.slice_bytes]) :]
        return out


def _by_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket numbers that grow with the hash."""
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _codes(own: _Slice, number: int, answers: pa.Table, buckets: int) -> np.ndarray:
    """What the buckets answered for each anchor of a slice: 0 not shared, 1 shared, 2 hot."""
    anchors = own.shared()[0]
    bucket = _by_bucket(anchors, buckets)
    out = np.zeros(len(anchors), np.uint8)
    for row in answers.filter(pc.equal(answers.column("slice"), number)).select(["bucket", "codes"]).to_pylist():
        a, b = np.searchsorted(bucket, [row["bucket"], row["bucket"] + 1])
        out[a:b] = np.frombuffer(row["codes"], np.uint8)
    return out


def _order(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, and the number of each item's group of equals; later keys are looked at where earlier ones tie."""
    n = len(keys[0])
    order = np.argsort(keys[0], kind="stable")
    group = np.zeros(n, np.int64)
    sorted_key = keys[0][order]
    group[1:] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
    for key in keys[1:]:
        tied = np.zeros(n, bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = key[order[at]]
        again = np.lexsort((own, group[at]))
        order[at] = order[at][again]
        own = own[again]
        new = np.zeros(n, bool)
        new[1:] = group[1:] != group[:-1]
        new[at[1:]] |= (own[1:] != own[:-1]) & (at[1:] - at[:-1] == 1)
        group = np.cumsum(new)
    return order, group


class SuffixSorter:
    """Suffixes of many short strings, sorted by a difference cover one bucket at a time."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, period: int = 31, bucket: int = 1 << 18) -> None:
        self.period, self.bucket = period, bucket
        self.cover = np.array(difference_cover(period))
        #: for two residues, the steps that bring both onto the cover
        on = np.isin(np.arange(2 * period) % period, self.cover)
        self.shift = np.array([[next(d for d in range(period) if on[a + d] and on[b + d]) for b in range(period)] for a in range(period)])
        self.residue = np.arange(len(data), dtype=np.int64)
        sizes = ends - starts
        self.residue -= np.repeat(starts, sizes)
        rest = np.repeat(ends, sizes) - np.arange(len(data))
        self.residue %= period
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.words = np.ndarray((len(data),), ">u8", self.data, strides=(1,))
        self._rank(rest)

    def _rank(self, rest: np.ndarray) -> None:
        """Ranks of the suffixes on the cover, each up to its string's end."""
        at = np.flatnonzero(on := np.isin(self.residue, self.cover))
        depth = int(rest[on].max()) if len(at) else 0
        last = np.minimum(rest[at], depth)
        keys = [self._word(at, 8 * i, last) for i in range(-(-depth // 8))] or [np.zeros(len(at), _U)]
        order, group = _order([*keys, last])  # equal but for zero bytes at the end: the shorter first
        self.rank = np.full(len(rest), -1, np.int64)
        self.rank[at[order]] = group

    def _word(self, at: np.ndarray, shift: int, last: np.ndarray | None = None) -> np.ndarray:
        """Eight bytes of each suffix, zero behind its end."""
        word = self.words[np.minimum(at + shift, len(self.words) - 1)].astype(_U)
        if last is None:
            return word
        left = np.clip(last - shift, 0, 8)
        return np.where(left == 0, _U(0), word >> (_U(8) * (_U(8) - left.astype(_U)) % _U(64)) << (_U(8) * (_U(8) - left.astype(_U)) % _U(64)))

    def buckets(self, at: np.ndarray) -> Iterator[np.ndarray]:
        """The suffixes dealt by their first two bytes, neighbouring small buckets together."""
        lead = (self.words[at] >> _U(48)).astype(np.int64)
        sizes = np.bincount(lead, minlength=1 << 16)
        number = np.cumsum(sizes) // self.bucket
        own = number[lead]
        order = np.argsort(own, kind="stable")
        edges = np.flatnonzero(np.diff(own[order], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(order)]):
            yield at[order[a:b]]

    def sorted(self, at: np.ndarray) -> np.ndarray:
        """One bucket in order: to the depth of the period by bytes, ties by the ranks on the cover."""
        order, group = _order([self._word(at, 8 * i) for i in range(-(-self.period // 8))])
        at = at[order]
        todo = np.arange(len(at))
        while True:
            size = np.bincount(group[todo], minlength=group[-1] + 1 if len(group) else 0)
            todo = todo[size[group[todo]] > 1]
            if not len(todo):
                return at
            own = group[todo]
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            count = np.diff(begin, append=len(own))
            pivot = at[todo[np.repeat(begin + count // 2, count)]]
            item = at[todo]
            step = self.shift[self.residue[item], self.residue[pivot]]
            side = np.sign(self.rank[item + step] - self.rank[pivot + step])
            again = np.lexsort((side, own))
            at[todo] = item[again]
            side = side[again]
            # groups get new numbers in order; those equal to the pivot are done
            new = np.zeros(len(group), bool)
            new[1:] = group[1:] != group[:-1]
            new[todo[1:]] |= (side[1:] != side[:-1]) & (own[1:] == own[:-1])
            group = np.cumsum(new)
            todo = todo[side != 0]

    def same(self, at: np.ndarray, length: int) -> np.ndarray:
        """Whether each suffix of a sorted bucket agrees with the one before on so many bytes."""
        out = np.ones(len(at), bool)
        out[:1] = False
        for shift in (*range(0, length - 7, 8), length - 8):
            word = self._word(at, shift)
            out[1:] &= word[1:] == word[:-1]
        return out


def _least(strings: pa.Array, ranks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings of a bucket: where each one's suffixes begin in the list of all, how many, and the least rank of each
    suffix's first ``length`` bytes."""
    sizes = pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    offset = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset]
    data = np.frombuffer(strings.buffers()[2], np.uint8)[offset : offset + ends[-1]]
    count = sizes - length + 1
    begin = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(sizes)), count)
    at = np.arange(count.sum()) - begin[owner] + starts[owner]
    number = np.zeros(len(data), np.int64)
    number[at] = np.arange(len(at))
    sorter = SuffixSorter(data, starts, ends)
    out = np.empty(len(at), np.int64)
    for bucket in sorter.buckets(at):
        bucket = sorter.sorted(bucket)
        group = np.flatnonzero(~sorter.same(bucket, length))
        own = number[bucket]
        least = np.minimum.reduceat(ranks[owner[own]], group)
        out[own] = np.repeat(least, np.diff(group, append=len(own)))
    return begin, count, out


def _answer_anchors(rows: pa.Table, hot: int) -> pa.Table:
    """One bucket of anchors: which occur in several documents, and which have very many fragments."""
    held = [np.frombuffer(x, "<u4") for x in rows.column("anchors").to_pylist()]
    marks = np.concatenate([np.frombuffer(x, "<u2") for x in rows.column("marks").to_pylist()])
    ends = np.cumsum([len(x) for x in held])
    anchors = np.concatenate(held)
    different, of = np.unique(anchors, return_inverse=True)
    n = np.bincount(of, minlength=len(different))
    shared = (n > 1) | (np.bincount(of, marks >> 15, minlength=len(different)) > 0)
    many = np.bincount(of, marks & 0x7FFF, minlength=len(different)) > hot
    codes = np.where(shared, np.where(many, 2, 1), 0).astype(np.uint8)[of]
    parts = np.split(codes, ends[:-1])
    keep = [i for i, x in enumerate(parts) if x.any()]
    return rows.select(["block", "slice", "bucket"]).take(pa.array(keep, pa.int64())).append_column("codes", pa.array([parts[i].tobytes() for i in keep], pa.binary()))


def _answer_strings(rows: pa.Table, length: int) -> pa.Table:
    """One bucket of fragments: for each row, which of its strings start in a document with a smaller id elsewhere."""
    ranks = pc.rank(rows.column("id"), tiebreaker="dense")
    ranks = ranks.to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(ranks, pa.Array) else ranks.to_numpy().astype(np.int64)
    coded = rows.column("string").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    of = coded.indices.to_numpy().astype(np.int64)
    own = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(own, of, ranks)
    begin, count, least = _least(coded.dictionary, own, length)
    size = count[of]
    shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    smaller = least[np.repeat(begin[of], size) + shift] < np.repeat(ranks, size)
    masks = np.add.reduceat(smaller.astype(np.int64) << shift, np.cumsum(size) - size)
    keep = np.flatnonzero(masks)
    return rows.select(["block", "slice", "place"]).take(pa.array(keep)).append_column("mask", pa.array(masks[keep].astype(np.int32)))


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, length: int = 50, block_bytes: int = 4 << 20, hot: int = 20_000,
) -> DataFrame:
    """One row a document: id, n_bytes long, spans (array of struct of first and end byte removed) and kept (binary)."""
    if not GRAM + 8 <= length <= GRAM + MOST - 1:
        raise ValueError(f"strings have {GRAM + 8} to {GRAM + MOST - 1} bytes")
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    slice_bytes = max(1, block_bytes // 2)
    buckets = -(-blocks // 4)  # of anchors: one per 16 bytes or so
    dealt = rows.where("id is not null").select(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block"), "id", "text")

    def anchors(key: tuple, of_block: pa.Table) -> pa.Table:
        block, out = _Block(of_block, length, slice_bytes), []
        for number, own in block.slices():
            found, count, several = own.shared()
            bucket = _by_bucket(found, buckets)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            low = (found & _U(0xFFFFFFFF)).astype("<u4")
            marks = (np.minimum(count, 0x7FFF) | several.astype(np.int64) << 15).astype("<u2")
            for a, b in zip(edges, [*edges[1:], len(found)]):
                out.append((key[0].as_py(), number, int(bucket[a]), low[a:b].tobytes(), marks[a:b].tobytes()))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                        names=["block", "slice", "bucket", "anchors", "marks"])

    def fragments(key: tuple, of_block: pa.Table, answers: pa.Table) -> pa.Table:
        block, out = _Block(of_block, length, slice_bytes), []
        for number, own in block.slices() if answers.num_rows else ():
            place = 0
            for sent in own.sent(_codes(own, number, answers, buckets), block):
                n = len(sent.first)
                ids = block.ids.take(pa.array(np.searchsorted(block.ends, sent.at[sent.first], "right")))
                out.append(pa.table({
                    "deal": _by_bucket(sent.anchor, blocks), "block": np.full(n, key[0].as_py()), "slice": np.full(n, number, np.int32),
                    "place": np.arange(place, place + n, dtype=np.int32), "id": ids, "string": sent.strings(block)}))
                place += n
        return pa.concat_tables(out) if out else pa.table({
            "deal": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "slice": pa.array([], pa.int32()), "place": pa.array([], pa.int32()),
            "id": block.ids[:0], "string": pa.array([], pa.binary())})

    def without(key: tuple, of_block: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(of_block, length, slice_bytes)
        gone = np.zeros(len(block.data), np.uint8)
        coded = answers.filter(pc.is_valid(answers.column("codes")))
        marked = answers.filter(pc.is_valid(answers.column("mask")))
        for number, own in block.slices() if coded.num_rows else ():
            here = marked.filter(pc.equal(marked.column("slice"), number))
            place = 0
            for sent in own.sent(_codes(own, number, coded, buckets), block):
                masks = np.zeros(len(sent.first), np.int64)
                at = here.column("place").to_numpy() - place
                fits = (at >= 0) & (at < len(masks))
                masks[at[fits]] = here.column("mask").to_numpy()[fits]
                gone[sent.removed(masks)] = 1
                place += len(masks)
        covered = block.covered(gone)
        kept = np.concatenate([[0], np.cumsum(~covered)])[np.concatenate([[0], block.ends])].astype(np.int32)
        texts = pa.Array.from_buffers(pa.binary(), len(block.ids), [None, pa.py_buffer(kept), pa.py_buffer(block.data[~covered])])
        edge = np.zeros(len(covered) + 1, bool)
        edge[block.starts] = True
        before = np.concatenate([[False], covered[:-1]])
        first = np.flatnonzero(covered & (~before | edge[:-1]))
        last = np.flatnonzero(covered & ~np.concatenate([(covered & ~edge[:-1])[1:], [False]])) + 1
        doc = np.searchsorted(block.ends, first, "right")
        offsets = np.searchsorted(doc, np.arange(len(block.ids) + 1)).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(first - block.starts[doc]), pa.array(last - block.starts[doc])], ["start", "end"])
        return pa.table({"id": block.ids, "n_bytes": block.ends - block.starts, "spans": pa.ListArray.from_arrays(pa.array(offsets), spans), "kept": texts})

    by_block = dealt.groupBy("block")
    codes = by_block.applyInArrow(anchors, "block long, slice int, bucket long, anchors binary, marks binary") \
        .groupBy("bucket").applyInArrow(lambda x: _answer_anchors(x, hot), "block long, slice int, bucket long, codes binary")
    strings = by_block.cogroup(codes.groupBy("block")).applyInArrow(fragments, f"deal long, block long, slice int, place int, id {kind}, string binary")
    masks = strings.groupBy("deal").applyInArrow(lambda x: _answer_strings(x, length), "block long, slice int, place int, mask int")
    answers = codes.unionByName(masks, allowMissingColumns=True)
    spans = "array<struct<start: bigint, end: bigint>>"
    out = by_block.cogroup(answers.groupBy("block")).applyInArrow(without, f"id {kind}, n_bytes long, spans {spans}, kept binary")
    whole = rows.where("id is null").select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast(spans).alias("spans"), F.col("text").alias("kept"))
    return out.union(whole).withColumnRenamed("id", doc_id)


@query("op11_suffix_dedup")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_spans(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
