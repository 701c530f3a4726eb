"""Language-model scores by logistic context mixing over the bits of coded tokens.

Tokens are words (runs of visible bytes, A-Z as a-z) and one end per text. The most frequent training tokens get
Huffman codes; all others share one escape code and are told apart behind it by their training counts, where a token
never seen takes the share that Good and Turing's estimate gives to new ones, as one event. Every bit of a code is predicted by several contexts: none, the
last token, the last two, and the last two frequent ones. A context's history is a pair of counts of zeros and ones in a
hashed table. Their log odds are added with weights chosen by gates, one per context for how much it has seen and one
for the depth in the code, and the weights follow each text online, every 16 tokens. They start from one fit on every bit of all training texts, each
bit judged without its own count.

What grows with the corpus stays distributed: token counts, tables and the slopes that give the first weights are sums over
all training texts; every part of the texts is joined with the counts of its own tokens. The driver holds what parameters
bound: the codes of ``coded`` tokens, the tables of ``slots`` places, and the sums of the slopes.

Defined results: null counts as empty, an empty text is its end. Repeated rows score alike. Without training rows all
tokens are new: the score is 0.0 bits per event of probability one, the base score follows its formula with N = V = 0.
Equal ids and texts need no order. Columns other than id and text are not carried.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import in_fold, query, stored, table

CONTEXTS, GATES, DEPTHS = 4, 8, 16
WEIGHTS = CONTEXTS * GATES + DEPTHS
PIECE = 1 << 15  # tokens whose bits are handled at once
END = 0x5BD1E9955BD1E995
_U = np.uint64
_SPREAD = _U(0xA0761D6478BD642F)
_STARTS = GATES * np.arange(CONTEXTS + 1)[:, None]


@dataclass(frozen=True)
class Codes:
    token: np.ndarray  # sorted hashes of coded tokens
    code: np.ndarray  # per coded token, and the escape at the end
    length: np.ndarray
    frequent: np.ndarray  # whether a token counts as frequent context
    log_new: float  # log10 share of new tokens behind the escape
    log_rest: float  # log10 of the other tokens' share, less that of the sum of their counts


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with ends, the text of each, and the tokens per text."""
    hashed, counts = W.word_hashes(texts, W.VISIBLE)
    n = counts + 1
    out = np.full(int(n.sum()), _U(END))
    last = np.cumsum(n) - 1
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner] = hashed
    return out, np.repeat(np.arange(len(texts)), n), n


def huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (with a leading 1) and lengths for symbols by their counts."""
    heap = [(max(1, c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    above: dict[int, tuple[int, int]] = {}
    fresh = len(counts)
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        above[i], above[j] = (fresh, 0), (fresh, 1)
        heapq.heappush(heap, (a + b, fresh))
        fresh += 1
    codes: dict[int, tuple[int, int]] = {fresh - 1: (1, 0)}
    for node in range(fresh - 2, -1, -1):
        parent, bit = above[node]
        code, n = codes[parent]
        codes[node] = (code << 1 | bit, n + 1)
    found = [codes[i] for i in range(len(counts))]
    return np.array([c for c, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


@dataclass(frozen=True)
class Nodes:
    """For every bit of every code, symbol after symbol."""

    name: np.ndarray  # hash of the bits before it
    alone: np.ndarray  # its hash in the empty context
    bit: np.ndarray
    first: np.ndarray  # per symbol: its first bit
    lower: np.ndarray  # coded tokens with smaller first 16 bits
    crowd: int  # the most coded tokens whose first 16 bits are the same


def _nodes(codes: Codes) -> Nodes:
    length = codes.length
    first = np.cumsum(length) - length
    of = np.repeat(np.arange(len(length)), length)
    depth = np.arange(len(of)) - first[of]
    left = (length[of] - depth).astype(np.uint64)
    name = W.mix((codes.code[of] >> left) * _U(0x9E3779B97F4A7C15))
    alone = ((W.mix(np.ones(1, np.uint64)) ^ name) * _SPREAD) >> _U(33)
    return Nodes(
        name, alone.view(np.int64), ((codes.code[of] >> (left - _U(1))) & _U(1)).astype(np.int8), first,
        *_heads(codes.token, 16))


def _heads(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """For sorted hashes: how many have smaller first bits than each number of so many bits, and the most that have the same."""
    heads = np.bincount((hashes >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.cumsum(heads) - heads, int(heads.max())


def _find(asked: np.ndarray, hashes: np.ndarray, lower: np.ndarray, crowd: int) -> np.ndarray:
    """Place of every hash among sorted ones, their number if it is not there. Hashes are spread evenly, so few have the same head."""
    if not len(hashes):
        return np.zeros(len(asked), np.int64)
    at = lower.take((asked >> _U(65 - len(lower).bit_length())).view(np.int64))
    for _ in range(crowd):
        at += hashes.take(at, mode="clip") < asked
    return np.where(hashes.take(at, mode="clip") == asked, at, len(hashes))


def _symbols(tokens: np.ndarray, codes: Codes, nodes: Nodes) -> np.ndarray:
    """Place of every token among the coded ones; the escape's for others."""
    return _find(tokens, codes.token, nodes.lower, nodes.crowd)


def _contexts(symbol: np.ndarray, owner: np.ndarray, codes: Codes) -> list[np.ndarray]:
    """Hashes of the contexts of every token but the empty one."""
    starts = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    name = W.mix(symbol.astype(np.uint64) + _U(17))

    def shifted(x):
        out = np.concatenate([x[:1] * _U(0), x[:-1]])
        out[starts] = _U(1)
        return out

    last = shifted(name)
    second = shifted(last)
    # the last two frequent tokens before each place, within the text
    often = np.flatnonzero(codes.frequent[symbol])
    begin = np.maximum.accumulate(np.where(starts, np.arange(len(symbol)), 0))
    seen = np.cumsum(codes.frequent[symbol]) - codes.frequent[symbol]
    recent = []
    for back in (1, 2):
        where = seen - back
        place = often[np.maximum(where, 0)] if len(often) else np.zeros(len(symbol), np.int64)
        recent.append(np.where((where >= 0) & (place >= begin), name[place], _U(2)))
    contexts = [last, last * _U(31) + second, recent[0] * _U(37) + recent[1]]
    return [W.mix(c + _U(k + 2)) for k, c in enumerate(contexts)]


def _bits(symbol: np.ndarray, contexts: list[np.ndarray], codes: Codes, slots: int, nodes: Nodes) -> tuple[np.ndarray, ...]:
    """Every coded bit, token by token: (token's index, node, depth, places in the tables of all contexts but the empty one)."""
    length = codes.length[symbol]
    of, depth = np.repeat(np.arange(len(symbol)), length), np.arange(int(length.sum()))
    depth -= np.repeat(np.cumsum(length) - length, length)
    row = nodes.first[symbol].take(of)
    row += depth
    places, name = np.empty((CONTEXTS - 1, len(of)), np.int64), nodes.name.take(row)
    for k, c in enumerate(contexts):
        mixed = c.take(of)
        mixed ^= name
        mixed *= _SPREAD
        mixed >>= _U(33)
        np.bitwise_and(mixed.view(np.int64), slots - 1, out=places[k])
    return of, row, np.minimum(depth, DEPTHS - 1, out=depth), places


def _levels(symbol: np.ndarray, contexts: list[np.ndarray], codes: Codes, slots: int, nodes: Nodes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same bits depth by depth: (depth, node, twice the places and the bit). Longest codes first: those still going on are the head."""
    longest = int(codes.length.max())
    order = np.argsort((longest - codes.length).astype(np.uint16).take(symbol), kind="stable")
    symbol, contexts = symbol.take(order), [c.take(order) for c in contexts]
    first, ends = nodes.first.take(symbol), np.bincount(codes.length.take(symbol), minlength=longest + 1)
    for depth, n in enumerate(len(symbol) - np.cumsum(ends)[:-1]):
        row = first[:n] + depth
        at, name, bit = np.empty((CONTEXTS - 1, n), np.int64), nodes.name.take(row), nodes.bit.take(row)
        for k, c in enumerate(contexts):
            mixed = c[:n] ^ name
            mixed *= _SPREAD
            mixed >>= _U(32)
            np.bitwise_and(mixed.view(np.int64), 2 * slots - 2, out=at[k])
        at += bit
        yield min(depth, DEPTHS - 1), row, at


def _runs(ends: np.ndarray, bits: int = 1 << 13) -> Iterator[tuple[int, int]]:
    """Ranges of items, whose bits end at ``ends``, with about so many bits: small pieces stay in the processor's cache."""
    start = done = 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, done + bits, "right")))
        yield start, end
        start, done = end, int(ends[end - 1])


def _inputs(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds and gate of counts."""
    odds = np.clip(np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))), -8, 8)
    return odds.astype(np.float32), np.minimum(np.log2(zeros + ones + 1), GATES - 1).astype(np.int16)


def _kinds(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal counts as one kind, those of most bits first: the kind of every place, the zeros and the ones of every kind."""
    both, kind, places = np.unique(np.stack([zeros, ones], -1).view(np.complex64).ravel(), return_inverse=True, return_counts=True)
    order = np.argsort(-places * (both.real + both.imag), kind="stable")
    number = np.empty(len(both), np.uint16 if len(both) <= 1 << 16 else np.uint32)
    number[order] = np.arange(len(both))
    return number[kind].reshape(CONTEXTS, -1), both.real[order], both.imag[order]


def equal_weights() -> np.ndarray:
    """Every context alike; the depth adds nothing."""
    return np.where(np.arange(WEIGHTS) < CONTEXTS * GATES, 0.3, 0.0)


def _add_by_gate(slopes: np.ndarray, bends: np.ndarray, depth: np.ndarray, gate: np.ndarray, x: np.ndarray, error: np.ndarray, spread: np.ndarray) -> None:
    """Add what bits with any gates give to the slopes of the contexts' weights and to their second derivatives."""
    slope, pull = error * x, spread * x
    for k in range(CONTEXTS):
        own = slice(k * GATES, (k + 1) * GATES)
        slopes[own] += np.bincount(gate[k], slope[k], GATES)
        bends[own, CONTEXTS * GATES :] += np.bincount(gate[k] * DEPTHS + depth, pull[k], GATES * DEPTHS).reshape(GATES, DEPTHS)
        bends[own, own] += np.diag(np.bincount(gate[k], pull[k] * x[k], GATES))
        for other in range(k + 1, CONTEXTS):
            both = np.bincount(gate[k] * GATES + gate[other], pull[k] * x[other], GATES * GATES)
            bends[own, other * GATES : (other + 1) * GATES] += both.reshape(GATES, GATES)


def _slopes(batches: Iterable[list[str]], codes: Codes, nodes: Nodes, kinds: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Sums over all bits of the texts, which are among the counts of ``kinds``: the log likelihood's gradient by the weights,
    at equal ones, above the upper half of its negative second derivatives. Each bit is judged without itself."""
    slots, share, top = kinds.shape[1], equal_weights()[0], GATES - 1
    _, gate = _inputs(np.maximum(zeros + ones - 1, 0), np.float32(0))
    odds, _ = _inputs(np.maximum(np.stack([zeros - 1, zeros], -1), 0).ravel(), np.maximum(np.stack([ones, ones - 1], -1), 0).ravel())
    # by place and bit; the empty context's by node
    odds, gate = odds.reshape(-1, 2)[kinds].reshape(CONTEXTS, -1), gate[kinds]
    alone = nodes.alone & (slots - 1)
    odds_of = [odds[0].take(2 * alone + nodes.bit), *odds[1:]]
    gate_of = [gate[0].take(alone), *gate[1:]]
    uneven = [k for k in range(CONTEXTS) if (gate_of[k] != top)[... if k == 0 else (zeros + ones)[kinds[k]] > 0].any()]
    tops, split = GATES * np.arange(1, CONTEXTS + 1) - 1, CONTEXTS * GATES
    slopes, bends = np.zeros(WEIGHTS), np.zeros((WEIGHTS, WEIGHTS))
    for texts in (texts[a:b] for texts in batches for a, b in W.blocks(texts, 1 << 19)):
        tokens, owner, _ = _tokens(texts)
        symbol = _symbols(tokens, codes, nodes)
        contexts = _contexts(symbol, owner, codes)
        for a in range(0, len(symbol), PIECE):
            rest = []
            for depth, row, at in _levels(symbol[a : a + PIECE], [c[a : a + PIECE] for c in contexts], codes, slots, nodes):
                x = np.empty((CONTEXTS, len(row)))
                for k in range(CONTEXTS):
                    x[k] = odds_of[k].take(at[k - 1] if k else row)
                p = x.sum(0)
                p *= -share
                np.exp(p, out=p)
                p += 1
                np.divide(1, p, out=p)
                error, spread = nodes.bit.take(row) - p, p * (1 - p)
                slopes[split + depth] += error.sum()
                bends[split + depth, split + depth] += spread.sum()
                if uneven:
                    gates = np.full((CONTEXTS, len(row)), top)
                    for k in uneven:
                        gates[k] = gate_of[k].take(at[k - 1] >> 1 if k else row)
                    some = np.flatnonzero((gates[uneven] != top).any(0))
                    if 2 * len(some) > len(row):
                        _add_by_gate(slopes, bends, np.full(len(row), depth), gates, x, error, spread)
                        continue
                    rest.append((np.full(len(some), depth), gates[:, some], x[:, some], error[some], spread[some]))
                    error[some] = spread[some] = 0
                # bits whose contexts have all seen much share their weights: plain products
                slopes[tops] += x @ error
                pull = x * spread
                bends[tops, split + depth] += pull.sum(1)
                bends[np.ix_(tops, tops)] += pull @ x.T
            if rest:
                _add_by_gate(slopes, bends, *(np.concatenate(v, -1) for v in zip(*rest)))
    return np.concatenate([slopes[None], np.triu(bends)])


@dataclass(frozen=True)
class Inputs:
    """Log odds and gates of all contexts: the empty one's by node, its odds signed by the node's bit, the others' by place."""

    odds: list[np.ndarray]
    gate: list[np.ndarray]
    sign: np.ndarray  # of the bit, per node
    uneven: list[int]  # contexts with more gates than the last


def _signed(odds_of: np.ndarray, gate_of: np.ndarray, nodes: Nodes, slots: int) -> Inputs:
    """``odds_of`` and ``gate_of``: by place, context after context."""
    odds, gate = odds_of.astype(float).reshape(CONTEXTS, slots), gate_of.astype(np.int64).reshape(CONTEXTS, slots)
    sign, alone = 2.0 * nodes.bit - 1, nodes.alone & (slots - 1)
    gates = [gate[0].take(alone), *gate[1:]]
    return Inputs([odds[0].take(alone) * sign, *odds[1:]], gates, sign, [k for k in range(CONTEXTS) if (gates[k] != GATES - 1).any()])


def _score(tokens, owner, n_texts, counts, codes: Codes, nodes: Nodes, odds_of, gate_of, weights, slots: int, block: int = 16, rate: float = 0.05, kinds: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of each text; ``counts``: training count of every token. ``odds_of`` and ``gate_of`` are by place, or by the kinds of places."""
    if kinds is not None:
        odds_of, gate_of = odds_of[kinds], gate_of[kinds]
    return _mixed(tokens, owner, n_texts, counts, codes, nodes, _signed(odds_of, gate_of, nodes, slots), weights, slots, block, rate)


def _mixed(tokens, owner, n_texts, counts, codes: Codes, nodes: Nodes, inputs: Inputs, weights, slots: int, block: int = 16, rate: float = 0.05) -> np.ndarray:
    symbol = _symbols(tokens, codes, nodes)
    behind = np.where(counts > 0, codes.log_rest + np.log10(np.maximum(counts, 1)), codes.log_new)
    behind = np.bincount(owner, np.where(symbol < len(codes.token), 0.0, behind), n_texts)
    if not codes.length.any():  # the escape alone has an empty code
        return behind
    contexts = _contexts(symbol, owner, codes)
    # the longest texts first: those still going on are the head of the weights
    size = np.bincount(owner, minlength=n_texts)
    order = np.argsort(-size, kind="stable")
    begin, size = (np.cumsum(size) - size)[order], size[order]
    active = np.searchsorted(-size, -block * np.arange(-(-int(size.max(initial=0)) // block)), "left")
    # steps: the tokens of a text in a turn, turn after turn
    steps = np.concatenate([[0], np.cumsum(active)])
    turn = np.repeat(np.arange(len(active)), active)
    row = np.arange(len(turn)) - steps[turn]
    n = np.minimum(block, size[row] - block * turn)
    until = np.concatenate([[0], np.cumsum(n)])
    by_turn = np.repeat(begin[row] + block * turn - until[:-1], n) + np.arange(until[-1])
    symbol, contexts = symbol[by_turn], [c[by_turn] for c in contexts]
    length = np.diff(np.concatenate([[0], np.cumsum(codes.length[symbol])])[until])
    # a step goes along the mean gradient of a text's bits in a turn
    pace, starts = rate / np.maximum(1, length), np.cumsum(length) - length
    ends = np.concatenate([[0], np.cumsum(length)])[steps]
    # contexts whose bits share one weight of a text, and after them those, and the depth, whose weights are looked up
    shared = [k for k in range(CONTEXTS) if k not in inputs.uneven]
    place_of, tops = {k: i for i, k in enumerate([*shared, *inputs.uneven])}, [GATES * (k + 1) - 1 for k in shared]
    flat, total, same = np.tile(weights, (n_texts, 1)), np.zeros(n_texts), len(shared)
    for first, end in _runs(ends[1:], 1 << 14):
        part, mine = slice(until[steps[first]], until[steps[end]]), slice(steps[first], steps[end])
        _, node, depth, places = _bits(symbol[part], [c[part] for c in contexts], codes, slots, nodes)
        sign, base = inputs.sign.take(node), np.repeat(row[mine] * WEIGHTS, length[mine])
        # the inputs of every bit, signed by it, and where its weights stand if they are looked up
        x, at = np.empty((CONTEXTS + 1, len(node))), np.empty((CONTEXTS + 1 - same, len(node)), np.int64)
        x[CONTEXTS] = sign
        np.add(base, depth, out=at[-1])
        at[-1] += CONTEXTS * GATES
        for k, i in place_of.items():
            if k:
                np.multiply(inputs.odds[k].take(places[k - 1]), sign, out=x[i])
            else:
                x[i] = inputs.odds[0].take(node)
            if i >= same:
                np.add(base, inputs.gate[k].take(places[k - 1] if k else node), out=at[i - same])
                at[i - same] += k * GATES
        for number in range(first, end):
            some, step = slice(ends[number] - ends[first], ends[number + 1] - ends[first]), slice(steps[number], steps[number + 1])
            head, y, i = flat[: active[number]], x[:, some], at[:, some].ravel()
            begins = starts[step] - ends[number]
            odds = np.empty(y.shape)
            odds[:same] = np.repeat(head[:, tops].T, length[step], axis=1)
            odds[same:] = head.ravel().take(i).reshape(-1, y.shape[1])
            odds *= y
            lost = np.exp(np.minimum(-odds.sum(0), 700.0))  # odds against the bit that came
            every = lost + 1
            with np.errstate(over="ignore"):
                missed = np.log(np.multiply.reduceat(every, begins))
            if not np.isfinite(missed).all():
                missed = np.add.reduceat(np.log(every), begins)
            total[: len(head)] -= missed
            lost /= every
            lost *= np.repeat(pace[step], length[step])
            np.multiply(y, lost, out=odds)
            head[:, tops] += np.add.reduceat(odds[:same], begins, axis=1).T
            head += np.bincount(i, odds[same:].ravel(), head.size).reshape(head.shape)
    out = np.empty(n_texts)
    out[order] = total / math.log(10)
    return out + behind


def _together(texts: list[str], most: int = 128) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are scored together: enough for array operations, few enough for the processor's cache."""
    for a, b in W.blocks(texts, 2 << 20):
        for first in range(a, b, most):
            yield first, min(b, first + most)


def _pairs(docs: DataFrame) -> DataFrame:
    """(part, token, n): the tokens of every part with their counts in its training rows (0 in others)."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        tokens, owner, _ = _tokens(rows["text"].tolist())
        learn = ~rows["held_out"].to_numpy(bool)
        learned = np.sort(tokens[learn[owner]])
        tokens = np.sort(tokens)
        token = tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])]
        n = np.searchsorted(learned, token, "right") - np.searchsorted(learned, token, "left")
        return pd.DataFrame({"part": rows["part"].iloc[0], "token": token.view(np.int64), "n": n})

    return docs.groupBy("part").applyInPandas(count, "part int, token long, n long")


def _tables(docs: DataFrame, codes: Codes, slots: int, chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Counts of zeros and ones over all training rows, summed by ranges of places."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, nodes, symbols = np.zeros(2 * CONTEXTS * slots, np.int64), _nodes(codes), np.zeros(len(codes.length), np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in W.blocks(texts, 1 << 20):
                tokens, owner, _ = _tokens(texts[a:b])
                symbol = _symbols(tokens, codes, nodes)
                contexts = _contexts(symbol, owner, codes)
                symbols += np.bincount(symbol, minlength=len(symbols))
                at, done = np.empty((CONTEXTS - 1, int(codes.length[symbol].sum())), np.int64), 0
                for i in range(0, len(symbol), PIECE):
                    for _, row, places in _levels(symbol[i : i + PIECE], [c[i : i + PIECE] for c in contexts], codes, slots, nodes):
                        at[:, done : done + len(row)] = places
                        done += len(row)
                for k in range(1, CONTEXTS):
                    both[2 * k * slots : 2 * (k + 1) * slots] += np.bincount(at[k - 1], minlength=2 * slots)
        # in the empty context, a symbol's bits occur as often as it does
        np.add.at(both, 2 * (nodes.alone & (slots - 1)) + nodes.bit, np.repeat(symbols, codes.length))
        both = both.reshape(-1, 2).T
        for v in (0, 1):
            for i in range(0, CONTEXTS * slots, chunk):
                part = both[v, i : i + chunk]
                some = np.flatnonzero(part)
                if len(some):
                    yield pd.DataFrame({"v": [v], "i": [i], "at": [some.astype("<u4").tobytes()], "n": [part[some].astype("<u8").tobytes()]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(chunk)
        for at, n in zip(rows["at"], rows["n"]):
            total[np.frombuffer(at, "<u4")] += np.frombuffer(n, "<u8")
        return pd.DataFrame({"v": rows["v"].iloc[:1], "i": rows["i"].iloc[:1], "n": [total.astype("<f4").tobytes()]})

    rows = docs.where("not held_out").select("text").mapInPandas(gather, "v int, i int, at binary, n binary")
    out = np.zeros((2, CONTEXTS * slots), np.float32)
    for r in rows.groupBy("v", "i").applyInPandas(add, "v int, i int, n binary").collect():
        out[r["v"], r["i"] : r["i"] + chunk] = np.frombuffer(r["n"], "<f4")
    return out[0], out[1]


def _weights(docs: DataFrame, model, bits: float, ridge: float = 1e-4) -> np.ndarray:
    """Weights fitted on every bit of all training rows: a Newton step from equal ones, for which sums over the rows are enough.

    ``ridge``, a share of the bits, holds the weights of gates that few bits or none pass.
    """

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, kinds, zeros, ones = model.value
        codes = Codes(**held)
        total = _slopes((batch["text"].tolist() for batch in batches), codes, _nodes(codes), kinds, zeros, ones)
        yield pd.DataFrame({"i": np.arange(1 + WEIGHTS), "n": [x.astype("<f8").tobytes() for x in total]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        # exact sums, so the order of the tasks does not matter
        sums = [math.fsum(x) for x in np.stack([np.frombuffer(n, "<f8") for n in rows["n"]]).T]
        return pd.DataFrame({"i": rows["i"].iloc[:1], "n": [np.array(sums, "<f8").tobytes()]})

    rows = docs.where("not held_out").select("text").mapInPandas(gather, "i int, n binary")
    total = np.zeros((1 + WEIGHTS, WEIGHTS))
    for r in rows.groupBy("i").applyInPandas(add, "i int, n binary").collect():
        total[r["i"]] = np.frombuffer(r["n"], "<f8")
    bends = np.triu(total[1:])
    bends = bends + bends.T - np.diag(np.diag(bends)) + (1 + ridge * bits) * np.eye(WEIGHTS)
    return equal_weights() + np.linalg.solve(bends, total[0])


def score(
    docs: DataFrame, doc_id: str, text: str, held_out: str, *, coded: int = 1 << 14, slots: int = 1 << 18, part_chars: int = 16 << 20,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, n_bytes (of the tokens' text) per row.

    Rows where ``held_out`` is true are not learned from. ``part_chars``: characters of text that one task scores.
    """
    size = docs.agg(F.sum(F.length(text))).first()[0] or 0
    parts = max(1, math.ceil(size / part_chars))
    # ids as text: through pandas a large id beside a null one would change
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
    pairs = stored(_pairs(rows), "tokens")
    totals = stored(pairs.groupBy("token").agg(F.sum("n").alias("c")).where("c > 0"), "counts")
    n, distinct, singles = (x or 0 for x in totals.agg(F.sum("c"), F.count("*"), F.count(F.when(F.col("c") == 1, 1))).first())
    top = totals.orderBy(F.desc("c"), "token").limit(coded).collect()
    rest = max(1, n - sum(r["c"] for r in top))
    hashes = np.array([r["token"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    code, length = huffman([top[i]["c"] for i in order] + [rest + singles])
    often = np.zeros(len(top) + 1, bool)
    often[np.argsort(order)[:200] if len(top) else []] = True
    new = (singles + 0.5) / (rest + singles + 1.0)
    codes = Codes(hashes[order], code, length, often, math.log10(new), math.log10(1 - new) - math.log10(rest))
    zeros, ones = _tables(rows, codes, slots)
    W._POWERS.clear()
    # bounded by coded and slots; plain arrays, as a broadcast's classes would have to be importable on the executors
    model = docs.sparkSession.sparkContext.broadcast((vars(codes), *_kinds(zeros, ones)))
    weights = _weights(rows, model, float(zeros[:slots].sum(dtype=float) + ones[:slots].sum(dtype=float)))
    base_total = math.log10(n + 0.1 * (distinct + 1))

    def judge(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        held, kinds, zeros, ones = model.value
        codes = Codes(**held)
        nodes, slots = _nodes(codes), kinds.shape[1]
        inputs = _signed(*(x[kinds] for x in _inputs(zeros, ones)), nodes, slots)
        known = known.assign(token=known["token"].to_numpy().view(np.uint64)).sort_values("token")
        token, count = known["token"].to_numpy(), np.append(known["c"].to_numpy(), 0)  # 0 for tokens not seen in training
        heads = _heads(token, 20)
        out = []
        # texts of like length end together
        texts = texts.iloc[np.argsort(texts["text"].str.len().to_numpy(), kind="stable")]
        strings = texts["text"].tolist()
        for a, b in _together(strings):
            tokens, owner, per = _tokens(strings[a:b])
            counts = count.take(_find(tokens, token, *heads))
            base = np.bincount(owner, np.log10(counts + 0.1) - base_total, b - a)
            total = _mixed(tokens, owner, b - a, counts, codes, nodes, inputs, weights, slots)
            part = texts.iloc[a:b]
            out.append(pd.DataFrame({
                "doc_id": part["doc_id"], "held_out": part["held_out"], "n_tokens": per, "n_known": np.bincount(owner, counts > 0, b - a).astype(np.int64),
                "base_score": base, "score": total, "bits": -total / math.log10(2), "n_bytes": [len(x.encode()) for x in strings[a:b]]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits", "n_bytes"])

    counts = pairs.join(totals, "token").select("part", "token", "c")
    scored = rows.groupBy("part").cogroup(counts.groupBy("part")).applyInPandas(
        judge, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits double, n_bytes long")
    return scored.withColumns({"doc_id": F.col("doc_id").cast(docs.schema[doc_id].dataType), "train_tokens": F.lit(n).cast("bigint")})


@query("op9_mixing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held", in_fold(F.col("doc_id"), 10))
    scored = score(docs, "doc_id", "text", "held")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
        (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
