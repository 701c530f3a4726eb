import hashlib
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.functions import chunking, html, text
from corpusflow.functions.embedding import embed
from corpusflow.functions.registry import register
from corpusflow.functions.vectors import l2_normalize, norm, resolve_space, similarity
from corpusflow.operators import automaton, idf
from corpusflow.operators.refresh import is_due, is_stale
from corpusflow.operators.routing import keyword_hits, route


def one(spark, column, **row):
    values = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)) if row else spark.range(1)
    return values.select(column).head()[0]


@pytest.mark.parametrize("markup, expected", [
    ("<article>a<p>b</p><p>c</p></article>", "a\nb\nc"),
    ("<nav>x</nav><article>a<nav>n<p>m</p></nav>b</article>z", "ab"),
    ("<article>a</article>-<article>b</article>", "ab"),
    ("<article>a<script>var t='</p>';</script>b</article>", "ab"),
    ("<article>a<script>open", "a"),
    ("<article>a<svg>b<button>c</button>d</svg>e</article>", "ae"),
    ("no article", ""),
    ("<article>a &amp b  \t c<br>d</article>", "a & b  cd"),
    ("<article><p>a</p>\n  \n<div>b</div></article>", "a\n\nb"),
    ("<article><article>a</article>b</article>c", "ab"),
    ("", ""),
])
def test_article(markup, expected):
    assert html.article_text(markup) == expected


def test_html_strip_keeps_script_text_and_drops_comments():
    assert html.all_text("<!doctype html><script>f('</p>')</script><!-- c --><b>x</b>&lt;y&gt;<i>") == "f('</p>')x<y>"


def test_html_columns_pass_null(spark):
    df = spark.createDataFrame([("<article>a</article>",), (None,)], "h string")
    rows = df.select(html.html_strip("h").alias("s"), html.extract_article("h").alias("a")).collect()
    assert [tuple(r) for r in rows] == [("a", "a"), (None, None)]


def chunks(value, **options):
    return [value[a:b] for a, b in chunking.chunk_spans(value, **options)]


@pytest.mark.parametrize("value, options, expected", [
    ("", {}, []),
    (" \n\n ", {}, []),
    ("short", {}, ["short"]),
    ("x" * 512, {}, ["x" * 512]),
    ("aa\n\nbb\n\ncc", dict(size=6, overlap=0), ["aa\n\nbb", "cc"]),
    ("aaa bbb ccc ddd", dict(size=8, overlap=4), ["aaa bbb", "bbb ccc", "ccc ddd"]),
    ("aaa. bbb. ccc", dict(size=7, overlap=0), ["aaa", ". bbb", ". ccc"]),
    ("abcdefghij", dict(size=4, overlap=1), ["abcd", "defg", "ghij"]),
    ("aa bb\ncccccccc dd", dict(size=6, overlap=0), ["aa bb", "ccccc", "ccc", "dd"]),
])
def test_chunks(value, options, expected):
    assert chunks(value, **options) == expected


def test_long_word_is_cut_with_overlap():
    parts = chunks("w" * 2000)
    assert [len(p) for p in parts] == [512, 512, 512, 512, 208]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n\té ", max_size=400), st.integers(2, 60), st.data())
def test_chunk_invariants(value, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    spans = chunking.chunk_spans(value, size, overlap)
    assert all(0 < b - a <= size and value[a:b] == value[a:b].strip() for a, b in spans)
    assert all(later[0] >= former[0] and former[1] - later[0] <= overlap for former, later in zip(spans, spans[1:]))
    held = np.zeros(len(value), dtype=bool)
    for a, b in spans:
        held[a:b] = True
    assert all(ok or c.isspace() for c, ok in zip(value, held))


def test_explode_chunks_ids_and_empty_documents(spark):
    docs = spark.createDataFrame([("d/a.txt", "aaa bbb ccc"), ("d/b.txt", "  ")], "path string, text string")
    rows = chunking.explode_chunks(docs, "path", "text", size=8, overlap=0).orderBy("chunk_index").collect()
    assert [(r.id, r.content, r.chunk_index, r.start) for r in rows] == [("d/a.txt::0", "aaa bbb", 0, 0), ("d/a.txt::1", "ccc", 1, 8)]


@pytest.mark.parametrize("dist, space, expected", [
    (2 - 2 * 0.6327, "l2", 0.6327), (0.3, "cosine", 0.7), (-0.4, "ip", 0.4), (4.0, "l2", 0.0), (0.0, "l2", 1.0),
    (2.0, "cosine", 0.0), (-0.2, "cosine", 1.0), (2 - 2 * 0.6327, "something-else", 0.6327), (0.7347, "l2", 0.63265),
])
def test_similarity(spark, dist, space, expected):
    assert one(spark, similarity(F.lit(dist), space)) == pytest.approx(expected, abs=1e-9)


def test_space_resolution(spark):
    assert one(spark, resolve_space(F.lit("Cosine"), F.lit("ip"))) == "cosine"
    assert one(spark, resolve_space(F.lit(None).cast("string"), F.lit("IP"))) == "ip"
    assert one(spark, resolve_space(F.lit(""), F.lit(None).cast("string"))) == "l2"


def test_normalize_zero_vector(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, l2_normalize(zero)) == [0.0, 0.0]
    assert one(spark, norm(l2_normalize(F.array(F.lit(3.0), F.lit(4.0))))) == pytest.approx(1)


@pytest.mark.parametrize("last, now, stale", [
    (None, "2024-01-08T00:00:00Z", True),
    ("", "2024-01-08T00:00:00Z", True),
    ("soon", "2024-01-08T00:00:00Z", True),
    ("12:00", "2024-01-08T00:00:00Z", True),
    ("2024-01-01T00:00:00", "2024-01-08T00:00:00Z", True),
    ("2024-01-01T00:00:01", "2024-01-08T00:00:00Z", False),
    ("2024-01-01", "2024-01-08T00:00:00+00:00", True),
    ("2024-01-01T02:00:00+02:00", "2024-01-08T00:00:00Z", True),
    ("2024-01-01T00:00:00-00:30", "2024-01-08T00:00:00Z", False),
    ("2024-01-01T00:00:00.500000Z", "2024-01-08T00:00:00Z", False),
])
def test_staleness(spark, last, now, stale):
    assert one(spark, is_stale(F.lit(last).cast("string"), F.lit(now))) is stale


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_staleness_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert one(spark, is_stale(F.lit("2024-01-01T00:00:00"), F.lit("2024-01-08T00:00:00Z"))) is True
        assert one(spark, is_stale(F.lit("2024-01-01T00:00:01"), F.lit("2024-01-08T00:00:00Z"))) is False
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("last, hours, due", [
    (None, 24, True), ("2024-01-01T00:00:00Z", 0, True), ("2024-01-01T00:00:00Z", 24, True),
    ("2024-01-01T00:00:01Z", 24, False), ("bad", 24, True), ("2024-01-01T23:00:00Z", 0.5, True),
])
def test_due(spark, last, hours, due):
    assert one(spark, is_due(F.lit(last).cast("string"), F.lit("2024-01-02T00:00:00Z"), hours)) is due


@pytest.mark.parametrize("url, base, name", [
    ("https://x.y/en/a/b.html", "https://x.y/en/", "a_b.html.txt"),
    ("https://x.y/en/", "https://x.y/en/", "index.txt"),
    ("https://x.y/en", "https://x.y/en/", "https_x.y_en.txt"),
    ("https://x.y/a?b=c&d#e", "https://x.y/", "a_b_c_d_e.txt"),
    ("https://x.y/" + "q" * 200, "https://x.y/", "q" * 120 + ".txt"),
    ("https://x.y/en/a/en/b", "/en/", "a_en_b.txt"),
    ("/é/", "", "_.txt"),
])
def test_url_filename(spark, url, base, name):
    assert one(spark, text.url_filename(F.lit(url), base)) == name


def test_first_present(spark):
    values = [F.lit(v).cast("string") for v in (None, "", "x", "y")]
    assert one(spark, text.first_present(*values)) == "x"
    assert one(spark, text.first_present(F.lit(""))) == ""


@pytest.mark.parametrize("value, expected", [
    ('{"a": 1, "b": "x"}', {"a": "1", "b": "x"}), ("not json", {}), ("", {}), ("  ", {}), (None, {}), ("[1]", {}),
])
def test_decode_args(spark, value, expected):
    assert one(spark, text.decode_args(F.lit(value).cast("string"))) == expected


@pytest.mark.parametrize("value, expected", [
    ('[{"s": "a"}]', ["a"]), ('{"s": "a"}', []), ("null", []), ("", []), (None, []), ('[{"s": ', []), ("[]", []),
])
def test_decode_list(spark, value, expected):
    rows = one(spark, text.decode_list(F.lit(value).cast("string"), "struct<s:string>"))
    assert [r.s for r in rows] == expected


def test_kv_to_map_last_wins(spark):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
    assert one(spark, text.kv_to_map(F.array(pair("a", "1"), pair("b", "2"), pair("a", "3")))) == {"a": "3", "b": "2"}


def test_urn(spark):
    built = text.dataset_urn(F.lit("snowflake"), F.lit("db.public.orders"))
    assert one(spark, built) == "urn:li:dataset:(urn:li:dataPlatform:snowflake,db.public.orders,PROD)"
    assert tuple(one(spark, text.parse_dataset_urn(built))) == ("snowflake", "db.public.orders", "PROD")
    assert one(spark, text.parse_dataset_urn(F.lit("urn:li:tag:x"))) is None


@pytest.mark.parametrize("question, label", [
    ("List Unity Catalog tables in main.bronze", "databricks"),
    ("What Snowflake warehouses are running?", "snowflake"),
    ("List my S3 buckets and EC2 instances", "aws"),
    ("Explain Delta Lake time travel", "databricks"),
    ("Use Cortex to summarize this text", "snowflake"),
    ("What Bedrock models are available?", "aws"),
    ("Search DataHub for the orders dataset", "datahub"),
    ("List every glossary term in our business glossary", "datahub"),
    ("Show lineage for urn:li:dataset:(urn:li:dataPlatform:snowflake,db.public.orders,PROD)", "datahub"),
    ("What is a diamond?", "aws"),
    ("Hello", "ambiguous"),
    ("Move snowflake to databricks", "ambiguous"),
    ("", "ambiguous"),
])
def test_route(spark, question, label):
    df = spark.createDataFrame([(question,)], "q string")
    assert route(df, "q").head().label == label


def test_route_override_and_hits(spark):
    df = spark.createDataFrame([(1, "aws", "snowflake"), (2, "aws", None)], "i int, q string, o string")
    assert [r.label for r in route(df, "q", override=F.col("o")).orderBy("i").collect()] == ["snowflake", "aws"]
    hits = keyword_hits(df.select("i", "q"), "q", [("a", "aw", 1), ("a", "aws", 2), ("b", "x", 1)]).where("i = 1")
    assert sorted(tuple(r)[1:] for r in hits.collect()) == [("a", "aw", 1), ("a", "aws", 2)]


def test_embed_plug_in_and_empty_text(spark):
    df = spark.createDataFrame([("one two two",), ("",), (None,)], "t string")

    def load():
        return lambda texts: np.array([[len(t.split()), 4.0 if t else 0.0] for t in texts], dtype=float)

    rows = [r[0] for r in df.select(embed(F.col("t"), 2, load)).collect()]
    assert rows[0] == pytest.approx([0.6, 0.8]) and rows[1] == [0.0, 0.0] and rows[2] == [0.0, 0.0]


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT similarity(0.7347D), similarity(0.3D, 'cosine')").head()[:] == pytest.approx((0.63265, 0.7))
    assert spark.sql("SELECT extract_article('<article>a<p>b</article>'), html_strip('<b>x</b>')").head()[:] == ("a\nb", "x")
    rows = spark.sql("SELECT * FROM chunk_text('aaa bbb ccc', 8, 0)").collect()
    assert [tuple(r) for r in rows] == [(0, "aaa bbb", 0), (1, "ccc", 8)]
    lateral = spark.sql("SELECT id, c.content FROM VALUES (1, 'x y') AS t(id, body), LATERAL chunk_text(t.body) AS c")
    assert [tuple(r) for r in lateral.collect()] == [(1, "x y")]
    assert spark.sql("SELECT size(chunk_array(repeat('w', 600)))").head()[0] == 2


WORDS = ["he", "she", "his", "hers", "her", "a", "aa", "aaa", "é", "日本", "本", "ab", "bab", "\U0001f642", "x y"]


@pytest.mark.parametrize("segment, states", [(1024, 1 << 18), (3, 6)])
def test_automaton_finds_what_contains_finds(monkeypatch, segment, states):
    monkeypatch.setattr(automaton, "SEGMENT", segment)
    monkeypatch.setattr(automaton, "MOST_STATES", states)
    rng = random.Random(6)
    texts = ["", "ushers", "aaaa", "日本語", "no", "x  y x y", *("".join(rng.choice("abhesir xyé日本\U0001f642") for _ in range(rng.randrange(60))) for _ in range(300))]
    for words in (WORDS, [*WORDS, ""], ["zzz"], []):
        found = set()
        for part in automaton.automata(words):
            found |= set(zip(*(x.tolist() for x in part.found([t.encode() for t in texts]))))
        assert found == {(i, k) for i, t in enumerate(texts) for k, w in enumerate(words) if w in t}


def test_long_and_short_dictionaries_give_the_same_rows(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("ABhesir xyÉ日本") for _ in range(rng.randrange(80)))) for i in range(100)] + [(100, None), (101, ""), (102, "HERS" * 5000)]
    df = spark.createDataFrame(rows, "i int, q string")
    dictionary = [(label, w, n) for n, label in enumerate(("one", "two", "three"), 1) for w in WORDS if (len(w) + n) % 3]
    short, long = (sorted(map(tuple, keyword_hits(df, "q", dictionary, literals=n).collect())) for n in (10**6, 0))
    assert short == long and long
    short, long = (sorted(map(tuple, route(df, "q", dictionary, literals=n).select("i", "label").collect())) for n in (10**6, 0))
    assert short == long and len({x for _, x in long}) > 1


def test_time_does_not_grow_with_the_dictionary():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8)).encode()
    texts = [b" ".join(word() for _ in range(300)) for _ in range(400)]
    seconds = {}
    for n in (50, 5000):
        found = automaton.Automaton([word() for _ in range(n)])
        found.found(texts[:10])
        begin = time.process_time()
        found.found(texts)
        seconds[n] = time.process_time() - begin
    assert seconds[5000] < 4 * seconds[50] + 0.5


def test_dictionary_bound(monkeypatch):
    monkeypatch.setattr(automaton, "MOST_BYTES", 3)
    with pytest.raises(ValueError):
        automaton.automata(["ab", "cd"])


@given(st.integers(0, 400), st.integers(2, 40), st.data())
@settings(max_examples=60, deadline=None)
def test_character_windows_are_packed_single_characters(length, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    pieces = [(i, i + 1) for i in range(3, 3 + length)]
    assert list(chunking._windows(3, 3 + length, size, overlap)) == list(chunking._pack(pieces, size, overlap))


def test_idf_model_and_embedding(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat the"), (2, "The dog"), (3, ""), (4, None), (5, "the")], "i int, text string")
    model = idf.fit_idf(docs)
    weights = {r.word: r.idf for r in model.collect()}
    assert weights == {w: pytest.approx(np.log(6 / (1 + df)) + 1) for w, df in (("the", 3), ("cat", 1), ("dog", 1), (None, 0))}
    idf.save_idf(model, str(tmp_path / "idf"))
    asked = docs.union(spark.createDataFrame([(6, "unseen the")], "i int, text string"))
    found = {r.i: np.array(r.embedding) for r in idf.embed_idf(asked, idf.load_idf(spark, str(tmp_path / "idf")), "i", dims=16).collect()}
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16
    for i, words in ((1, ["the", "cat", "the"]), (2, ["the", "dog"]), (3, []), (4, []), (5, ["the"]), (6, ["unseen", "the"])):
        vector = np.zeros(16)
        for w in words:
            vector[place(w)] += weights.get(w, weights[None])
        length = np.linalg.norm(vector)
        assert np.allclose(found[i], vector / (length or 1), atol=1e-6)
    assert idf.embed_idf(docs.limit(0), idf.fit_idf(docs.limit(0)), "i").count() == 0
