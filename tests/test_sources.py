import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.evaluation import first_calls
from corpusflow.plans.ask import ask
from corpusflow.plans.corpus import chunk_rows, ingest, publish_pages
from corpusflow.plans.refresh import refresh
from corpusflow.plans.score import evaluate
from corpusflow.sources import collections as store
from corpusflow.sources.api_definitions import api_def_docs, api_def_ops
from corpusflow.sources.documents import scan_docs, union_sources
from corpusflow.sources.evaluation import read_eval, write_eval
from corpusflow.sources.tables import sample_table, sql_capped, table_profile
from corpusflow.sources.turnlog import append_to_log, write_daily_markdown, write_turn_markdown
from corpusflow.sources.versions import load_versions, save_versions


def docs(spark, **rows):
    return spark.createDataFrame(list(rows.items()), "id string, content string")


def contents(df):
    return {r.id: r.content for r in df.collect()}


def test_upsert_and_prune_properties(spark):
    old, new = docs(spark, a="1", b="2"), docs(spark, b="3", c="4")
    once = store.upsert(old, new)
    assert contents(once) == {"a": "1", "b": "3", "c": "4"} == contents(store.upsert(once, new))
    assert contents(store.prune(once, new)) == {"b": "3", "c": "4"} and contents(store.stale(once, new)) == {"a": "1"}


def test_diff(spark):
    found = store.corpus_diff(docs(spark, a="1", b="2", c="3"), docs(spark, b="2", c="4", d="5"), content="content")
    assert {r.id: r.state for r in found.collect()} == {"a": "removed", "b": "kept", "c": "changed", "d": "added"}


def test_stored_collection_life(spark, root):
    assert store.read_collection(spark, root) is None and store.prune_collection(docs(spark, a="").select("id"), root) == 0
    many = {f"k{i}": str(i) for i in range(200)}
    store.upsert_collection(docs(spark, **many), root, buckets=16)
    pinned = store.read_collection(spark, root)
    store.upsert_collection(docs(spark, k1="new", z="26"), root)
    expected = {**many, "k1": "new", "z": "26"}
    assert contents(store.read_collection(spark, root)) == expected
    assert contents(pinned) == many
    live = docs(spark, **{k: "" for k in expected if k != "k7"})
    assert store.prune_collection(live.select("id"), root) == 1
    expected.pop("k7")
    assert contents(store.read_collection(spark, root)) == expected
    store.expire(spark, root)
    assert contents(store.read_collection(spark, root)) == expected


def test_upsert_rewrites_only_touched_buckets(spark, root):
    store.write_collection(docs(spark, **{f"k{i}": "" for i in range(100)}), root, buckets=16)
    before = store._state(spark, root, store._commits(spark, root))["where"]
    store.upsert_collection(docs(spark, k1="new"), root)
    after = store._state(spark, root, store._commits(spark, root))["where"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_pruning_everything_leaves_an_empty_collection(spark, root):
    store.write_collection(docs(spark, a="1"), root)
    assert store.prune_collection(docs(spark, b="").select("id"), root) == 1
    assert contents(store.read_collection(spark, root)) == {}


def test_cut_off_commit_is_ignored_and_second_writer_refused(spark, root):
    store.write_collection(docs(spark, a="1"), root)
    seen = store._commits(spark, root)
    with open(f"{root}/_commits/{2:012d}.json", "w") as record:
        record.write('{"buckets": 6')
    assert contents(store.read_collection(spark, root)) == {"a": "1"}
    with pytest.raises(Exception):
        store._commit(spark, root, seen, {})
    store.upsert_collection(docs(spark, b="2"), root)
    assert contents(store.read_collection(spark, root)) == {"a": "1", "b": "2"}


@pytest.mark.parametrize("attempted, published", [(2, True), (3, False), (0, False)])
def test_publish_gate(spark, root, attempted, published):
    store.write_collection(docs(spark, old="0"), root)
    outcome = store.publish(docs(spark, a="1", b="2"), root, attempted)
    assert (outcome["written"], outcome["published"]) == (2, published)
    assert set(contents(store.read_collection(spark, root))) == ({"a", "b"} if published else {"old"})


def test_publish_pages(spark, root):
    body = "<article>" + "word " * 60 + "</article>"
    pages = spark.createDataFrame([("s", f"u/{i}", body) for i in range(4)] + [("s", "u/stub", "<article>x</article>")], "source string, url string, html string")
    rules = spark.createDataFrame([("s", ["/2"], None, None)], "source string, robots array<string>, exclude array<string>, include array<string>")
    assert publish_pages(pages, rules, root, "u/", min_ratio=0.8)["published"] is False
    assert publish_pages(pages, rules, root, "u/", min_ratio=0.75)["published"] is True
    assert sorted(r.name for r in spark.read.parquet(root).collect()) == ["0.txt", "1.txt", "3.txt"]


def test_publish_pages_judges_each_source(spark, root):
    body, schema = "<article>" + "word " * 60 + "</article>", "source string, url string, html string"
    rules = spark.createDataFrame([(s, None, None, None) for s in "ab"], "source string, robots array<string>, exclude array<string>, include array<string>")
    first = spark.createDataFrame([("a", "u/a1", body), ("b", "u/b1", body)], schema)
    assert publish_pages(first, rules, root, "u/")["switched"] == 2
    files = lambda source: sorted(Path(root, f"source={source}").rglob("*.parquet"))
    before = {source: files(source) for source in "ab"}
    # one good url, four times, of five: its copies do not help it; the other source goes on
    bad = [("b", "u/b2", body)] * 4 + [("b", f"u/stub{i}", "<article>x</article>") for i in range(4)]
    again = spark.createDataFrame([("a", f"u/a{i}", body) for i in range(2, 5)] + bad, schema)
    assert publish_pages(again, rules, root, "u/")["switched"] == 1
    assert sorted(r.url for r in spark.read.parquet(root).collect()) == ["u/a2", "u/a3", "u/a4", "u/b1"]
    assert files("b") == before["b"] and files("a") != before["a"]


def test_refresh_replaces_the_touched_platforms_only(spark, root):
    source = "id string, platform string, type string, latest string, written int, files array<string>"
    sources = lambda **latest: spark.createDataFrame([(i, i[0], "github_dir", x, 1, [i]) for i, x in latest.items()], source)
    docs = lambda **t: spark.createDataFrame([(p[0], p, x) for p, x in t.items()], "platform string, path string, text string")
    content = lambda: {(r.platform, r.source): r.content for r in spark.read.parquet(f"{root}/chunks").collect()}
    files = lambda platform: sorted(Path(root, "chunks", f"platform={platform}").rglob("*.parquet"))
    first = refresh(spark, sources(a1="1", b1="1", b2=None, c1="1"), docs(a1="one", b1="two", b2="three"), root, "2024-01-01T00:00:00+00:00")
    assert {r.id: r.status for r in first.collect()} == {"a1": "fetched", "b1": "fetched", "b2": "network_error", "c1": "fetched"}
    assert content() == {("a", "a1"): "one", ("b", "b1"): "two", ("b", "b2"): "three"}
    kept = files("b")
    # a changed, b is as it was, c changed and has no documents: its chunks, had it any, would stay
    again = refresh(spark, sources(a1="2", b1="1", c1="2"), docs(a3="four", b1="not read"), root, "2024-01-02T00:00:00+00:00")
    assert {r.id: r.status for r in again.collect()} == {"a1": "fetched", "b1": "up_to_date", "c1": "fetched"}
    assert content() == {("a", "a3"): "four", ("b", "b1"): "two", ("b", "b2"): "three"} and files("b") == kept
    quiet = refresh(spark, sources(a1="2", b1="1", c1="2"), docs(a1="x"), root, "2024-01-03T00:00:00+00:00")
    assert {r.status for r in quiet.collect()} == {"up_to_date"} and len(content()) == 3


def test_refresh_by_url_sets(spark, root):
    sources = spark.createDataFrame([("w", "p", "web_sitemap", None, 2, ["f"]), ("g", "p", "github_dir", "sha", 1, ["f"])],
                                    "id string, platform string, type string, latest string, written int, files array<string>")
    docs = spark.createDataFrame([("p", "d", "text")], "platform string, path string, text string")
    pages = lambda *urls: spark.createDataFrame([("w", u) for u in urls], "source string, url string")
    status = lambda urls, day: {r.id: r.status for r in refresh(spark, sources, docs, root, f"2024-01-0{day}T00:00:00+00:00", pages=pages(*urls)).collect()}
    assert status(["u1", "u2"], 1) == {"w": "fetched", "g": "fetched"}
    assert status(["u2", "u1", "u1"], 2) == {"w": "up_to_date", "g": "up_to_date"}
    assert status(["u1"], 3) == {"w": "fetched", "g": "up_to_date"}


def test_upsert_keeps_one_row_of_a_repeated_key(spark):
    old, new = docs(spark, a="1"), docs(spark, b="2").union(docs(spark, b="3"))
    assert store.upsert(old, new).count() == 2


def test_versions(spark, root):
    assert load_versions(spark, root).count() == 0
    record = lambda **c: spark.createDataFrame([(c["id"], c["sha"], None, c.get("at"), ["f"])], "id string, sha string, last_checked string, last_ingested string, files array<string>")
    save_versions(record(id="a", sha="1"), root)
    save_versions(record(id="a", sha="2", at="t").unionByName(record(id="b", sha="3")), root)
    assert sorted((r.id, r.sha) for r in load_versions(spark, root).collect()) == [("a", "2"), ("b", "3")]


def test_ingest_rules(spark, root):
    pages = lambda **t: spark.createDataFrame(list(t.items()), "path string, text string")
    assert ingest(spark, pages(a="x " * 600, b="y"), "aws", root) == {"ingested": 4, "pruned": 0}
    assert ingest(spark, pages(a="z"), "aws", root) == {"ingested": 0, "pruned": 0}
    assert ingest(spark, pages(a="z").where("false"), "aws", root, force=True) == {"ingested": 0, "pruned": 0}
    assert ingest(spark, pages(a="z", c="  "), "aws", root, force=True) == {"ingested": 1, "pruned": 3}
    row = store.read_collection(spark, root).head()
    assert (row.id, row.content, row.source, row.platform, row.chunk_index, len(row.embedding)) == ("a::0", "z", "a", "aws", 0, 64)


def test_scan_docs(spark, tmp_path):
    for name, content in {
        "a.MD": b"plain", "sub/deep/b.html": b"<p>x &lt; y</p>", "c.txt": b"ok\xff\xfe!", "d.pdf": b"no", "e": b"no", "f.md.bak": b"no",
        "g.graphql": b"type Q",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    found = {r.path: r.text for r in scan_docs(spark, str(tmp_path)).collect()}
    found = {path.split(tmp_path.name + "/")[-1]: text for path, text in found.items()}
    assert found == {"a.MD": "plain", "sub/deep/b.html": "x < y", "c.txt": "ok!", "g.graphql": "type Q"}


def test_scan_docs_paths_are_relative(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_text("t")
    assert scan_docs(spark, f"file:{tmp_path}").head().path == "x/a.md"
    assert scan_docs(spark, str(tmp_path)).head().path == "x/a.md"


def test_union_sources(spark):
    both = union_sources(spark.createDataFrame([(1, "a")], "i int, s string"), spark.createDataFrame([(2, 0.5)], "i int, d double"))
    assert sorted(tuple(r) for r in both.collect()) == [(1, "a", None), (2, None, 0.5)]


def definition(spark, service, body):
    return spark.createDataFrame([(service, body if isinstance(body, str) else json.dumps(body))], "service string, json string")


def test_api_definitions(spark):
    body = {
        "metadata": {"serviceFullName": "Simple", "protocol": "json", "apiVersion": "2"},
        "operations": {
            "Put": {"documentation": "<p>" + "d" * 401 + "</p>", "http": {"method": "POST", "requestUri": "/"}, "input": {"shape": "In"}},
            "Get": {"input": {"shape": "Unknown"}}, "List": {"documentation": "<b>all</b> "},
        },
        "shapes": {"In": {"required": ["k", "v"], "type": "structure"}, "Out": {}},
    }
    found = {r.operation: r for r in api_def_ops(definition(spark, "s3", body)).collect()}
    assert (found["Put"].required, found["Put"].doc, found["Put"].method) == (["k", "v"], "d" * 400 + "...", "POST")
    assert (found["Get"].required, found["Get"].doc, found["Get"].uri, found["List"].doc) == ([], "", "", "all")
    assert api_def_docs(definition(spark, "s3", body)).head().text == (
        "# S3 - API Reference\n\nService:    Simple\nProtocol:   json\nAPI version:2\n\n## Get\n\n## List\nall\n\n"
        "## Put\nHTTP: POST /\nRequired params: k, v\n" + "d" * 400 + "...\n"
    )
    assert api_def_docs(definition(spark, "s3", "{}")).head().text == "# S3 - API Reference\n\n"
    assert api_def_ops(definition(spark, "s3", "nope")).count() == 0


def test_tables(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(10)], "a int, b string")
    assert sql_capped(spark, "SELECT * FROM {t}", 3, t=df).count() == 3
    assert sql_capped(spark, "SELECT * FROM {t}", None, t=df).count() == 10 == sql_capped(spark, "SELECT * FROM {t}", 0, t=df).count()
    assert [r.a for r in sample_table(df, 2, [F.col("a").desc()]).collect()] == [9, 8]
    assert [tuple(r) for r in table_profile(df, approx_distinct=True).collect()] == [(0, "a", "int", 10, 10, 10), (1, "b", "string", 10, 5, 1)]


CASES = [
    {"id": "aws_1", "type": "single_tool", "query": "List my S3 buckets", "expected_tool": "list", "required_args": ["n"], "expected_arg_values": {"n": 20}},
    {"id": "aws_2", "type": "rag_only", "query": "What is IAM?", "expected_tool": None, "expected_rag_keyword": "iam"},
]


def test_eval_files_and_pipeline(spark, tmp_path):
    (tmp_path / "aws_queries.json").write_text(json.dumps(CASES, indent=1))
    cases = read_eval(spark, str(tmp_path))
    assert sorted((r.id, r.platform, r.expected_arg_values) for r in cases.collect()) == [("aws_1", "aws", {"n": "20"}), ("aws_2", "aws", None)]
    results = spark.createDataFrame([("aws_1", "aws", "", 10), ("aws_2", "aws", "IAM is", 31)], "id string, platform string, response string, latency_ms int")
    calls = spark.createDataFrame([("aws_1", 1, "other", {}), ("aws_1", 0, "list", {"n": "20"})], "id string, pos int, name string, args map<string,string>")
    assert first_calls(calls).head()[:] == ("aws_1", "list", {"n": "20"}, 2)
    scores, summary = evaluate(cases.drop("platform"), results, calls)
    assert all(r.ok and r.route_ok for r in scores.collect())
    assert summary.head().asDict() == {
        "platform": "aws", "n": 2, "tool_selection_accuracy": 100.0, "required_arg_hit_rate": 100.0, "arg_value_hit_rate": 100.0,
        "rag_keyword_hit_rate": 100.0, "routing_accuracy": 100.0, "p50_latency_ms": 20, "p95_latency_ms": 10,
    }
    write_eval(summary, scores, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/scores")).where("platform = 'aws'").count() == 2


def test_ask(spark):
    documents = spark.createDataFrame([("s3.md", "aws", "buckets hold objects"), ("glue.md", "aws", "catalog of tables"), ("x.md", "datahub", "buckets hold objects")], "path string, platform string, text string")
    chunks = chunk_rows(documents)
    questions = spark.createDataFrame([(1, "which s3 buckets hold objects"), (2, "buckets hold objects")], "qid int, question string")
    found = {r.qid: r for r in ask(questions, chunks).collect()}
    assert found[1].platform == "aws" and [s.source for s in found[1].sources] == ["s3.md"] and "buckets hold objects" in found[1].context
    assert found[2].platform == "ambiguous" and found[2].sources is None and found[2].context.startswith("No relevant")


def results(spark, *rows):
    return spark.createDataFrame(list(rows), """ts string, query string, platform string, response string, latency_ms int,
        tool_calls_made array<struct<name:string,args:map<string,string>,result:string>>, rag_sources array<struct<source:string,score:double>>""")


def test_turn_log(spark, tmp_path):
    log = str(tmp_path / "log")
    append_to_log(spark, results(spark, ("2024-01-01T10:00:00", "q1", "aws", "r1", 5, [("t", {"a": "1"}, "ok")], [("s", 0.5)]), ("2024-01-01T11:00:00", "q2", None, None, None, None, None)), ["ts"], log)
    append_to_log(spark, results(spark, ("2024-01-02T09:00:00", "q3", "aws", "r3", 7, [], [])), ["ts"], log)
    turns = spark.read.parquet(log)
    found = {r.id: r for r in turns.collect()}
    assert sorted(found) == [1, 2, 3]
    assert found[1].tools_json == '[{"name":"t","args":{"a":"1"},"result":"ok"}]' and found[1].rag_sources_json == '[{"source":"s","score":0.5}]'
    assert (found[2].platform, found[2].response, found[2].latency_ms, found[2].tools_json) == ("unknown", "", 0, "[]")
    write_daily_markdown(turns, str(tmp_path / "md"))
    read = lambda day: "".join(p.read_text() for p in sorted((tmp_path / "md" / f"date={day}").glob("part-*")))
    assert read("2024-01-01") == (
        "# Turn history — 2024-01-01\n\n---\n\n## #1 · 2024-01-01T10:00:00 · aws · 5ms\n\n**Q:** q1\n\n**A:**\n\nr1\n\n"
        "---\n\n## #2 · 2024-01-01T11:00:00 · unknown · 0ms\n\n**Q:** q2\n\n**A:**\n\n\n\n"
    )
    assert read("2024-01-02").startswith("# Turn history — 2024-01-02\n\n---\n\n## #3")
    write_turn_markdown(turns, str(tmp_path / "rendered"))
    assert spark.read.parquet(str(tmp_path / "rendered")).count() == 3


def test_two_definitions_of_one_service_stay_apart(spark):
    one = '{"operations": {"B": {"documentation": "<p>b</p>", "input": {"shape": "S"}}, "A": {}}, "shapes": {"S": {"required": ["x"]}}}'
    two = '{"operations": {"C": {"http": {"method": "GET", "requestUri": "/c"}}}}'
    df = spark.createDataFrame([("s", one), ("s", two), ("t", "not json"), ("u", '{"metadata": {}}'), ("v", None)], "service string, json string")
    texts = sorted(r.text for r in api_def_docs(df).where("service = 's'").collect())
    assert texts == ["# S - API Reference\n\n## A\n\n## B\nRequired params: x\nb\n", "# S - API Reference\n\n## C\nHTTP: GET /c\n"]
    assert sorted(r.operation for r in api_def_ops(df).collect()) == ["A", "B", "C"]
    assert "Exchange" not in api_def_docs(df)._jdf.queryExecution().executedPlan().toString()
