"""Odd rows of packing and token counts: large ids beside null ones, odd sections, texts without blanks."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
BIG = 10**17


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    return lambda text: plain.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_stay_what_they_are(spark, ids_of):
    rows = [(BIG + 3, "one"), (BIG + 4, "two words"), (None, "none"), (2**53 + 1, None), (BIG + 4, "x<|endoftext|>y"), (-1, "日本語テキスト" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumns({x: F.lit(0) for x in ("id", "start", "ids", "offset")})
    pieces = packing.pack(df, PATH).collect()
    assert sorted({r.doc_id for r in pieces}, key=str) == sorted({i for i, _ in rows}, key=str)
    whole = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        whole.setdefault((r.doc_id, r.doc_tokens), b"")
        whole[r.doc_id, r.doc_tokens] += bytes(r.ids)
    assert whole == {(i, len(ids_of(t))): np.array(ids_of(t), "<u4").tobytes() for i, t in rows}
    named = packing.pack(spark.createDataFrame([("a", "x"), (None, "y")], "doc_id string, text string"), PATH)
    assert sorted(((r.doc_id, zlib.crc32(r.ids)) for r in named.collect()), key=str) == sorted(
        ((i, zlib.crc32(np.array(ids_of(t), "<u4").tobytes())) for i, t in (("a", "x"), (None, "y"))), key=str)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_little_padding(spark, folder):
    pieces = packing.pack(spark.read.parquet(f"{folder}/documents.parquet"), PATH).select("sequence_id", "length")
    sizes = [r.n for r in pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes)
    assert max(sizes) <= 1024 and padding <= 0.02 * sum(sizes)


def test_encoder_forgets_by_characters(monkeypatch, ids_of):
    monkeypatch.setattr(packing, "CACHED_CHARS", 5000)
    encoder = packing.Encoder(PATH)
    texts = ["日本語" * 1500 + str(i) for i in range(6)] + ["a b c"]
    for text in texts:
        assert encoder.encode([text])[0].tolist() == ids_of(text)[:-1] and encoder.chars <= 5000 + 4600


def counted(spark, rows, rule):
    """name -> n_tokens of each row's sections; rows: (text, [(name, first, end)])."""
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "i int, text string, parts array<struct<name:string,first:bigint,end:bigint>>")
    found = token_counts.count_tokens(df.withColumn("name", F.lit(1)), F.col("parts"), PATH, rule=rule).orderBy("i").collect()
    return [[(s.name, s.n_tokens) for s in r.sections] for r in found]


def test_sections(spark):
    rows = [
        ("abc def", [("a", 0, 5), ("b", 0, 5)]),  # overlapping: both count their own, " def" has only a blank and a letter in them
        ("hello", [("x", 0, 1), ("y", 1, 4), ("z", 4, 5)]),  # one token over three sections
        ("hello", [("x", 0, 2), ("y", 2, 4)]),  # equal shares: the earlier
        ("hello you", [("x", 0, 5), ("w", 0, 0)]),  # " you" lies outside
        (None, [("n", None, None), ("m", 0, 4)]),
        ("", []),
        ("abc", None),
    ]
    assert counted(spark, rows, "most") == [
        [("a", 2), ("b", 2)], [("x", 0), ("y", 1), ("z", 0)], [("x", 1), ("y", 0)], [("x", 1), ("w", 0), (None, 1)], [("n", 0), ("m", 0)], [], [(None, 1)]]
    assert counted(spark, rows, "first") == [
        [("a", 2), ("b", 2)], [("x", 1), ("y", 0), ("z", 0)], [("x", 1), ("y", 0)], [("x", 1), ("w", 0), (None, 1)], [("n", 0), ("m", 0)], [], [(None, 1)]]


def test_lines_of_null_and_long_text(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "日" * 50_000 + "\nlast")], "doc_id int, text string")
    found = {r.doc_id: [s.n_tokens for s in r.sections] for r in token_counts.count_tokens(df, token_counts.lines_of(F.col("text")), PATH).collect()}
    assert found[1] == [0, 0, 0] and found[2] == [0, 0, 0] and found[3][0] > 50_000 and found[3][2] == 1
    assert token_counts.count_tokens(df.limit(0), token_counts.lines_of(F.col("text")), PATH).count() == 0


def test_mixing_base_scores_and_ids(spark):
    from collections import Counter

    from corpusflow.llm import mixing

    rows = [(BIG + 3, "The cat sat", False), (BIG + 4, "the\x0bdog  the", False), (None, "a new cat", True), (2**53 + 1, None, True), (-5, "", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").coalesce(1)
    tokens = lambda t: [x.decode() for x in "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()] + ["<end>"]
    count = Counter(x for _, t, h in rows if not h for x in tokens(t))
    n, v = sum(count.values()), len(count)
    found = {r.doc_id: r for r in mixing.score(df, "doc_id", "text", "held").collect()}
    assert set(found) == {i for i, _, _ in rows}
    for i, t, h in rows:
        base = sum(np.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))
        assert found[i].base_score == pytest.approx(base, abs=1e-9) and found[i].train_tokens == n and found[i].held_out == h
        assert (found[i].n_tokens, found[i].n_known) == (len(tokens(t)), sum(count[x] > 0 for x in tokens(t)))


def test_mixing_works_where_the_package_is_not_installed(tmp_path):
    """The query run from another folder, by workers that cannot import the package."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from corpusflow.llm import mixing, packing, jaccard
from corpusflow.session import build_session
spark = build_session("away", 2)
df = spark.createDataFrame([(1, "a b c", False), (2, "a b", True)], "doc_id long, text string, held boolean")
assert mixing.score(df, "doc_id", "text", "held").count() == 2
assert packing.pack(df, {PATH!r}).count() == 2
assert jaccard.jaccard_classes(df.select("doc_id", "text")).count() == 2
"""
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_labels_of_one_kind_remove_nothing(spark):
    from corpusflow.llm import secrets

    texts = [f"order 2024-01-{i % 28 + 1:02d}-{100000 + i} shipped on 2024-02-03T10:11:12 via 1Z999AA1012345{i:04d} ok" for i in range(30)] + [None, ""]
    df = spark.createDataFrame([(i, t, "en", "src", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found = secrets.scan(df)
    kinds = {r.label for r in secrets.weak_labels(found).select("label").distinct().collect()}
    if not {0, 1} <= kinds:
        assert {r.text for r in secrets.redact(df).collect()} == set(texts)
    one = secrets.scan(df, labelled=secrets.weak_labels(found).withColumn("label", F.lit(0)))
    assert one.where("is_secret").count() == 0 and "label" not in one.columns


def test_spans_are_the_tokenizers(spark, folder):
    import random

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    signs = [*"ab é'1!", "\n", "\t", " the", "日", "\U0001f642", "  ", "."]
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    texts += [None, "", " ", "  ", " a", "  a b", "a ", "日本語 テキスト", "x <|endoftext|> y", " " * 300 + "x"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 90))) for _ in range(300)]
    encoder = packing.Encoder(PATH, spans=True)
    for some in (texts, texts[::-1]):
        for text, (first, end) in zip(some, token_counts._token_spans(encoder, some)):
            want = plain.encode(text or "", add_special_tokens=False).offsets
            assert list(zip(first.tolist(), end.tolist())) == want, repr(text)[:80]
