"""op9's first weights, fitted on all training texts, and its scoring by small pieces."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corpusflow.llm import mixing


def texts_of(n: int, words: int, seed: int = 3) -> list[str]:
    """Sentences in which a word often decides the next."""
    names, rule, draw = [f"w{i}" for i in range(60)], random.Random(1), random.Random(seed)
    follows = {name: rule.choices(names, k=3) for name in names}
    out = []
    for _ in range(n):
        text = [draw.choice(names)]
        while len(text) < words:
            text.append(draw.choice(follows[text[-1]]) if draw.random() < 0.8 else draw.choice(names))
        out.append(" ".join(text))
    return out


def fitted(texts: list[str], slots: int):
    """Codes of the tokens of the texts but the rarest, and the tables of their bits."""
    tokens, owner, _ = mixing._tokens(texts)
    token, count = np.unique(tokens, return_counts=True)
    kept = np.sort(np.argsort(-count, kind="stable")[: len(token) - 5])
    code, length = mixing.huffman([*count[kept], 7])
    codes = mixing.Codes(token[kept], code, length, np.append(count[kept] > np.median(count), False), -1.0, -1.0)
    nodes, both = mixing._nodes(codes), np.zeros((2, mixing.CONTEXTS, slots), np.float32)
    symbol = mixing._symbols(tokens, codes, nodes)
    _, row, depth, places = mixing._bits(symbol, mixing._contexts(symbol, owner, codes), codes, slots, nodes)
    places = np.concatenate([(nodes.alone[row] & (slots - 1))[None], places])
    for k in range(mixing.CONTEXTS):
        np.add.at(both, (nodes.bit[row], k, places[k]), 1)
    return tokens, owner, codes, nodes, both, row, depth, places


def test_mixing_weights_learn_from_long_texts_too(spark, monkeypatch):
    """Before, texts of more than 65,536 characters, and all but 1,000, were left out of the fit."""
    long = texts_of(3, 20_000)
    assert all(len(x) > 1 << 16 for x in long)
    rows = [(i, x, False) for i, x in enumerate(long)] + [(10 + i, x, True) for i, x in enumerate(texts_of(6, 30, seed=4))]
    df = spark.createDataFrame(rows, "doc_id int, text string, held boolean")
    held = lambda: sum(r.score for r in mixing.score(df, "doc_id", "text", "held").where("held_out").collect())
    whole = held()
    monkeypatch.setattr(mixing, "_weights", lambda *a, **k: mixing.equal_weights())
    assert whole > held() + 1


def test_mixing_weights_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i, x, i % 7 == 0) for i, x in enumerate(texts_of(40, 30))]
    found = []
    for parts, some in ((1, rows), (5, rows[::-1])):
        df = spark.createDataFrame(some, "doc_id int, text string, held boolean").repartition(parts)
        found.append({r.doc_id: r.score for r in mixing.score(df, "doc_id", "text", "held").collect()})
    assert found[0] == pytest.approx(found[1], abs=1e-6)


def test_mixing_slopes_equal_a_plain_version():
    texts, slots = texts_of(5, 40), 1 << 6
    _, _, codes, nodes, both, row, depth, places = fitted(texts, slots)
    weights = mixing.equal_weights()
    slope, bend = np.zeros(mixing.WEIGHTS), np.zeros((mixing.WEIGHTS, mixing.WEIGHTS))
    for i, bit in enumerate(nodes.bit[row]):
        x = np.zeros(mixing.WEIGHTS)
        for k in range(mixing.CONTEXTS):
            n = both[:, k, places[k, i]] - [bit == 0, bit == 1]
            odds, gate = mixing._inputs(*n)
            x[k * mixing.GATES + gate] = odds
        x[mixing.CONTEXTS * mixing.GATES + depth[i]] = 1
        p = 1 / (1 + np.exp(-x @ weights))
        slope += (bit - p) * x
        bend += p * (1 - p) * np.outer(x, x)
    found = mixing._slopes([texts[:2], texts[2:]], codes, nodes, *mixing._kinds(*both.reshape(2, -1)))
    assert found[0] == pytest.approx(slope, abs=1e-3) and np.triu(found[1:]) == pytest.approx(np.triu(bend), abs=1e-3)


def test_mixing_finds_coded_tokens_and_kinds():
    tokens, _, codes, nodes, both, *_ = fitted(texts_of(5, 40), 1 << 6)
    crowded = mixing.Codes(np.sort(np.append(codes.token, np.arange(9, dtype=np.uint64) * np.uint64(5))), *[None] * 5)
    for some in (codes, crowded):
        lower = np.searchsorted(some.token >> np.uint64(48), np.arange(1 << 16, dtype=np.uint64))
        heads = np.bincount((some.token >> np.uint64(48)).astype(int))
        like = mixing.Nodes(*[None] * 4, lower, int(heads.max()))
        asked = np.concatenate([tokens, some.token, some.token + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
        place = {int(x): i for i, x in enumerate(some.token)}
        assert mixing._symbols(asked, some, like).tolist() == [place.get(int(x), len(some.token)) for x in asked]
    assert (nodes.lower == np.searchsorted(codes.token >> np.uint64(48), np.arange(1 << 16, dtype=np.uint64))).all()
    kinds, zeros, ones = mixing._kinds(*both.reshape(2, -1))
    assert (zeros[kinds].ravel() == both[0].ravel()).all() and (ones[kinds].ravel() == both[1].ravel()).all()


def test_mixing_scores_a_text_alike_alone_and_among_others():
    texts, slots = [*texts_of(4, 60), "", *texts_of(3, 5), "new words only"], 1 << 6
    tokens, owner, codes, nodes, both, *_ = fitted(texts, slots)
    kinds, zeros, ones = mixing._kinds(*both.reshape(2, -1))
    weights = mixing.equal_weights()
    together = mixing._score(tokens, owner, len(texts), np.ones(len(tokens)), codes, nodes, *mixing._inputs(zeros, ones), weights, slots, kinds=kinds)
    for i, text in enumerate(texts):
        own, zero, _ = mixing._tokens([text])
        alone = mixing._score(own, zero, 1, np.ones(len(own)), codes, nodes, *mixing._inputs(*both.reshape(2, -1)), weights, slots)
        assert alone[0] == pytest.approx(together[i], abs=1e-9)


def features(nodes, both, row, depth, places, i, own=0):
    """Weights that the bit goes by, and their inputs; ``own``: how often the bit itself is left out of its counts."""
    bit = int(nodes.bit[row[i]])
    at, x = [], []
    for k in range(mixing.CONTEXTS):
        odds, gate = mixing._inputs(*(both[:, k, places[k, i]] - np.float32(own) * np.array([bit == 0, bit == 1], np.float32)))
        at.append(k * mixing.GATES + int(gate))
        x.append(float(odds))
    return [*at, mixing.CONTEXTS * mixing.GATES + int(depth[i])], np.array([*x, 1.0]), bit


def filled(both, how: str):
    """Tables in which no place, every place, or every second place of a context has seen much."""
    more = np.random.default_rng(5).integers(200, 900, both.shape).astype(np.float32)
    if how == "sparse":
        return both
    if how == "mixed":
        more[:, :, ::2] = 0
    if how == "one context":
        more[:, 2] = 0
    return both + more


HOW = ["sparse", "mixed", "one context", "full"]


def test_mixing_levels_hold_every_bit_once():
    tokens, owner, codes, nodes, _, row, depth, places = fitted(texts_of(5, 40), 1 << 6)
    symbol = mixing._symbols(tokens, codes, nodes)
    levels = mixing._levels(symbol, mixing._contexts(symbol, owner, codes), codes, 1 << 6, nodes)
    found = [(r, d, *a) for d, rows, at in levels for r, a in zip(rows.tolist(), at.T.tolist())]
    assert sorted(found) == sorted(zip(row.tolist(), depth.tolist(), *(2 * places[1:] + nodes.bit[row]).tolist()))


@pytest.mark.parametrize("how", HOW)
def test_mixing_slopes_equal_a_plain_version_however_full_the_tables_are(how, monkeypatch):
    """Full tables take plain products of matrices, without sums by gate and depth: most of the time of the fit at size."""
    texts, slots = texts_of(5, 40), 1 << 6
    _, _, codes, nodes, both, row, depth, places = fitted(texts, slots)
    both, weights = filled(both, how), mixing.equal_weights()
    slope, bend = np.zeros(mixing.WEIGHTS), np.zeros((mixing.WEIGHTS, mixing.WEIGHTS))
    for i in range(len(row)):
        at, x, bit = features(nodes, both, row, depth, places, i, own=1)
        p = 1 / (1 + np.exp(-x @ weights[at]))
        slope[at] += (bit - p) * x
        bend[np.ix_(at, at)] += p * (1 - p) * np.outer(x, x)
    calls, plain = [], mixing._add_by_gate
    monkeypatch.setattr(mixing, "_add_by_gate", lambda *a: (calls.append(1), plain(*a)))
    found = mixing._slopes([texts[:2], [], texts[2:]], codes, nodes, *mixing._kinds(*both.reshape(2, -1)))
    assert found[0] == pytest.approx(slope, abs=1e-3) and found[1:] == pytest.approx(np.triu(bend), abs=1e-3)
    assert bool(calls) == (how != "full")


@pytest.mark.parametrize("how", HOW)
@pytest.mark.parametrize("scale", [1, 60])  # weights of 18 lose bits by odds whose product is beyond a float
def test_mixing_scores_equal_a_plain_version(how, scale):
    texts, slots, block, rate = ["", *texts_of(3, 40), "new words only", *texts_of(2, 9)], 1 << 6, 16, 0.05
    tokens, owner, codes, nodes, both, row, depth, places = fitted(texts, slots)
    both, weights = filled(both, how), scale * mixing.equal_weights()
    symbol = mixing._symbols(tokens, codes, nodes)
    of = np.repeat(np.arange(len(tokens)), codes.length[symbol])
    want = np.zeros(len(texts))
    for text in range(len(texts)):
        mine, w = np.flatnonzero(owner == text), weights.copy()
        for begin in range(0, len(mine), block):
            bits, step = np.flatnonzero(np.isin(of, mine[begin : begin + block])), np.zeros(mixing.WEIGHTS)
            for i in bits:
                at, x, bit = features(nodes, both, row, depth, places, i)
                sign = 2 * bit - 1
                miss = np.exp(min(-sign * float(x @ w[at]), 700.0))
                want[text] -= np.log1p(miss) / np.log(10)
                step[at] += sign * x * miss / (1 + miss)
            w += rate / len(bits) * step
        want[text] += -1.0 * (symbol[mine] == len(codes.token)).sum()
    kinds, zeros, ones = mixing._kinds(*both.reshape(2, -1))
    found = mixing._score(tokens, owner, len(texts), np.zeros(len(tokens)), codes, nodes, *mixing._inputs(zeros, ones), weights, slots, kinds=kinds)
    assert found == pytest.approx(want, rel=1e-9)
