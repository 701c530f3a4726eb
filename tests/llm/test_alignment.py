"""Cross-tokenizer alignment against whole-text encoding and set intersection, and odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import alignment
from corpusflow.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """text -> (A ids, B ids, groups): whole texts by the libraries themselves, ends met as sets."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    bytes_a, bytes_b = alignment.ByteTokens(A).bytes, alignment.PieceTokens(B).bytes

    def of(text):
        if not text:
            return [], [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled = [[table[i] for i in x] for x, table in zip(ids, (bytes_a, bytes_b))]
        if any(b"".join(x) != (" " + text).encode() for x in spelled):
            return [], [], []
        ends = [np.cumsum([len(y) for y in x]).tolist() for x in spelled]
        groups, at = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            stop = [x.index(end) + 1 for x in ends]
            groups.append([x[i:j] for x, i, j in zip(ids, at, stop)])
            at = stop
        return *ids, groups

    return of


def written(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def rows_of(texts, plain):
    """(n_a, n_b, n_groups, n_links, sha256, n_best, count_sum) of each text."""
    all_of = [plain(x) for x in texts]
    count = Counter((a[-1], b[-1]) for x in all_of for a, b in x[2])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for a, b, groups in all_of:
        n = [(count[x[-1], y[-1]], best[y[-1]]) for x, y in groups]
        digest = hashlib.sha256(written(groups).encode()).hexdigest() if groups else ""
        out.append((len(a), len(b), len(groups), len(groups), digest, sum(x == y for x, y in n), sum(x for x, _ in n)))
    return out


def test_query_equals_plain(spark, folder, plain):
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    found = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in QUERIES["op12_alignment"](spark, folder).collect()}
    assert [found[r.doc_id] for r in docs] == rows_of([r.text for r in docs], plain)


ODD = [
    None, "", " ", "  ", "a", "trail ", "  lead", "a  b", "tab\t x\n y", "\n\n a", "a b ", "<s> <0x41> <unk> </s>", "<|endoftext|> x", "holds ▁ it", "日本語 テ\x00キスト ﬁ",
    "x" * 5000 + " y", " " * 30_000 + "x", "é" * 200, "it's don't WE'LL 123 4567!?", " \n x", "\n", "  y　 z", "🙂🙂 ok", "\x7f\x80",
]


@pytest.mark.parametrize("stretch, cached", [(100_000, 300_000), (7, 20)])
def test_odd_texts(plain, monkeypatch, stretch, cached):
    monkeypatch.setattr(alignment, "STRETCH", stretch)
    monkeypatch.setattr(alignment, "CACHED", cached)
    aligner = alignment.Aligner(A, B)
    rng = random.Random(2)
    signs = [*"ab é'1!", "\n", "\t", " the", "日", "🙂", "  "]
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 120))) for _ in range(200)]
    for some in (texts, texts[::-1]):
        held = {i: [0, 0, 0, b""] for i in range(len(some))}
        for row, n_a, n_b, n_groups, links, text, right in aligner.align(some):
            assert len(links) == n_groups
            held[row] = [held[row][0] + n_a, held[row][1] + n_b, held[row][2] + n_groups, held[row][3] + bytes(text)] if right else None
        for i, text in enumerate(some):
            a, b, groups = plain(text)
            assert held[i] is None and not a or held[i] == [len(a), len(b), len(groups), (written(groups) + ";").encode() if groups else b""], repr(text)[:80]


def test_common_ends():
    rng = np.random.default_rng(3)
    for share in (0.02, 0.3, 0.9, 0.999):
        for size in (1, 2, 50, 3000):
            ends = np.unique(np.append(rng.integers(1, 4 * size + 2, 2 * size), 4 * size + 2)).astype(np.int32)
            a, b = (ends[(rng.random(len(ends)) < share) | (ends == ends[-1])] for _ in range(2))
            common = np.intersect1d(a, b)
            found = alignment.common_ends(a, b)
            assert (found[0] == np.searchsorted(a, common) + 1).all() and (found[1] == np.searchsorted(b, common) + 1).all()


def test_ids_clashing_columns_and_no_rows(spark, plain):
    rows = [(10**17 + 3, "one two"), (None, "one two"), (10**17 + 4, None), (10**17 + 4, "one"), (1, "holds ▁")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit(1) for x in ("links", "groups", "n_a", "pair", "best", "_text")})
    aligned = alignment.align(df, A, B, groups=True)
    found = {(r.doc_id, r.n_a, r.groups) for r in aligned.collect()}
    assert found == {(i, len(plain(x)[0]), written(plain(x)[2])) for i, x in rows}
    ids_b = len(alignment.PieceTokens(B).bytes)
    summed = alignment.linked(aligned, alignment.pair_counts(aligned), ids_b)
    want = Counter((i, *x[5:]) for (i, _), x in zip(rows, rows_of([x for _, x in rows], plain)))
    assert Counter((r.doc_id, r.n_best, r.count_sum) for r in summed.collect()) == want
    named = alignment.align(spark.createDataFrame([("x", "a")], "doc_id string, text string"), A, B)
    assert named.first().doc_id == "x"
    empty = alignment.align(df.limit(0), A, B)
    assert alignment.linked(empty, alignment.pair_counts(empty), ids_b).count() == 0


def test_ranks_encode_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    from corpusflow.llm.byte_tokens import ByteTokens

    plain = Tokenizer.from_file(A)
    texts = [x for x in ODD if x] + ["a <|endoftext|> b", "<|endoftext|>"]
    for special in (False, True):
        plain.encode_special_tokens = not special
        assert ByteTokens(A, special).encode(texts) == [plain.encode(x, add_special_tokens=False).ids for x in texts]
