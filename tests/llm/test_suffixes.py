"""Suffix-array dedup against brute force, its suffix sorter against Python's, and odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import suffixes
from corpusflow.llm.queries import QUERIES


def plain(texts: dict, length: int = 50) -> dict:
    """id -> covered flags, by a dictionary of the least id of every string."""
    first: dict[bytes, int] = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - length + 1):
            first.setdefault(texts[i][p : p + length], i)
    out = {}
    for i, text in texts.items():
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if first[text[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        out[i] = gone
    return out


def digest(text: bytes, gone: bytearray) -> tuple:
    kept = bytes(c for c, g in zip(text, gone) if not g)
    spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
    return len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def test_query_equals_brute_force(spark, folder):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = {i: digest(texts[i], gone) for i, gone in plain(texts).items()}
    found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_suffix_dedup"](spark, folder).collect()}
    assert found == want and sum(x[1] for x in want.values()) > 0


def copies(seed: int) -> dict:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(30))
    near = " ".join(word() for _ in range(120))
    texts = {}
    for i in range(60):
        kind, own = i % 6, " ".join(word() for _ in range(rng.randint(3, 80)))
        cut = rng.randrange(len(passage))
        texts[i] = {0: own, 1: own + passage + own, 2: passage[cut:] + own + passage[: cut + 55], 3: near[: rng.randrange(400)] + "X" + near[rng.randrange(300) :],
                    4: "a" * rng.randint(40, 400) + own, 5: ("ab" * 70 + word()) * 3}[kind]
    return texts


@pytest.mark.parametrize("hot, block", [(20_000, 4 << 20), (0, 3000), (3, 2000)])
def test_blocks_slices_and_hot_anchors(spark, hot, block):
    texts = copies(hot)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r for r in suffixes.repeated_spans(df, hot=hot, block_bytes=block).collect()}
    raw = {i: x.encode() for i, x in texts.items()}
    for i, gone in plain(raw).items():
        spans = [(s.start, s.end) for s in found[i].spans]
        flags = bytearray(len(gone))
        for a, b in spans:
            flags[a:b] = b"\1" * (b - a)
        assert flags == gone and all(a < b for a, b in spans)
        assert bytes(found[i].kept) == bytes(c for c, g in zip(raw[i], gone) if not g)


def test_odd_rows(spark):
    long = "x" * 20_000 + " ".join(str(i) for i in range(20_000))
    copy = "the same sixty bytes or so stand here in more than one of the rows"
    rows = [(10**17 + 3, copy), (10**17 + 4, copy), (None, copy), (None, copy + copy), (5, None), (6, ""), (7, long), (8, long), (9, "short"), (9, "short"), (11, copy[:49])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit(1) for x in ("id", "block", "spans", "kept", "n_bytes", "place")})
    found = sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], len(r.kept)) for r in suffixes.repeated_spans(df).collect()), key=str)
    n, m = len(copy), len(long)
    assert found == sorted([
        (10**17 + 3, n, [], n), (10**17 + 4, n, [(0, n)], 0), (None, n, [], n), (None, 2 * n, [], 2 * n), (5, 0, [], 0), (6, 0, [], 0),
        (7, m, [], m), (8, m, [(0, m)], 0), (9, 5, [], 5), (9, 5, [], 5), (11, 49, [], 49)], key=str)
    assert suffixes.repeated_spans(df.limit(0)).count() == 0
    named = spark.createDataFrame([("b", copy), ("a", copy), ("a", copy), ("c", copy + "!")], "doc_id string, text string")
    kept = sorted((r.doc_id, len(r.kept)) for r in suffixes.repeated_spans(named).collect())
    assert kept == [("a", n), ("a", n), ("b", 0), ("c", 1)]


@pytest.mark.parametrize("signs", ["ab", "\0a", "abcdefgh"])
def test_suffix_sorter(signs):
    rng = random.Random(1)
    strings = ["".join(rng.choice(signs) for _ in range(rng.randint(50, 80))).encode() for _ in range(200)]
    strings += [signs[0].encode() * 80, signs[0].encode() * 70, *strings[:40], *(x[:-1] + b"z" for x in strings[:40])]
    sizes = np.array([len(x) for x in strings])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(strings), np.uint8)
    sorter = suffixes.SuffixSorter(data, starts, ends, bucket=500)
    at = np.concatenate([np.arange(a, b - 49) for a, b in zip(starts, ends)])
    end_of = dict(zip(at.tolist(), np.repeat(ends, sizes - 49).tolist()))
    raw = data.tobytes()
    done = []
    for bucket in sorter.buckets(at):
        bucket = sorter.sorted(bucket)
        same = sorter.same(bucket, 50)
        assert [raw[a : a + 50] == raw[b : b + 50] for a, b in zip(bucket, bucket[1:])] == same[1:].tolist()
        done += [raw[p : end_of[p]] for p in bucket.tolist()]
    assert done == sorted(raw[p : end_of[p]] for p in at.tolist())


def test_difference_cover():
    for period in (7, 13, 31):
        cover = suffixes.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(suffixes.difference_cover(31)) == 6


def test_documents_are_shuffled_once(spark, folder):
    df = suffixes.repeated_spans(spark.read.parquet(f"{folder}/documents.parquet"))
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("ReusedExchange") >= 2
