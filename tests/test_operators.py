import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import catalog, evaluation, history, lineage, refresh, search, urls, windows


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


RULES = "source string, robots array<string>, exclude array<string>, include array<string>"


def test_filter_urls(spark):
    pages = frame(spark, "source string, url string", *[("a", u) for u in ("/docs/x", "/docs/archive/x", "/docs/py/x", "/blog/x", "/DOCS/x")], ("b", "/any"))
    rules = frame(spark, RULES, ("a", ["/archive/"], ["/py/"], ["/docs/"]))
    assert rows(urls.filter_urls(pages, rules).select("url"), "url") == [("/any",), ("/docs/x",)]


def test_sitemap(spark):
    xml = frame(spark, "source string, xml string", ("s", "<loc> a </loc><loc>\nb&amp;c\n</loc><loc>a</loc><loc></loc><loc>x y</loc>"))
    assert rows(urls.sitemap_urls(xml), "loc") == [("s", "a"), ("s", "a"), ("s", "b&amp;c")]


def test_suffix(spark):
    names = ["a.MD", "d.x/readme", "d/.html", "a.tar.gz", "x", "d/a.txt"]
    found = frame(spark, "n string", *[(n,) for n in names]).select("n", urls.suffix(F.col("n")).alias("s"))
    assert {r.n: r.s for r in found.collect()} == {"a.MD": ".md", "d.x/readme": "", "d/.html": "", "a.tar.gz": ".gz", "x": "", "d/a.txt": ".txt"}


def test_fingerprint_of_small_and_large_sets(spark):
    many = [("big", f"u{i}") for i in range(500)] * 2 + [("small", "b"), ("small", "a"), ("small", "a")]
    df = frame(spark, "source string, url string", *many)
    found = {r.source: (r.sha, r.n) for r in urls.url_fingerprint(df).collect()}

    def marker(names):
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in names]
        return hashlib.sha256(":".join([str(len(names)), *[str(sum(int(d[a:a + 15], 16) for d in digests)) for a in (0, 15, 30, 45)]]).encode()).hexdigest()

    assert found == {"small": (marker(["a", "b"]), 2), "big": (marker([f"u{i}" for i in range(500)]), 500)}
    again = urls.url_fingerprint(df.orderBy(F.rand(5)).repartition(3))
    assert {r.source: (r.sha, r.n) for r in again.collect()} == found
    split = found
    other = urls.url_fingerprint(df.where("url <> 'u77'"))
    assert {r.source: r.sha for r in other.collect()}["big"] != split["big"][0]


NOW = "2024-01-08T00:00:00+00:00"


@pytest.fixture(scope="module")
def registry(spark):
    sources = frame(
        spark, "id string, platform string, type string, latest string, written int, files array<string>",
        ("same", "p1", "github_dir", "aaaaaaaaaaaa", 3, ["f"]),
        ("moved", "p1", "github_file", "bbbbbbbbbbbb", 1, ["g"]),
        ("new", "p2", "botocore_svc", "cc", 0, []),
        ("down", "p3", "github_dir", None, 0, []),
        ("web_old", "p2", "web_sitemap", "dd", 9, ["h"]),
        ("web_fresh", "p2", "web_sitemap", "dd", 9, ["h"]),
        ("odd", "p3", "ftp", "ee", 4, ["i"]),
    )
    versions = frame(
        spark, "id string, sha string, last_ingested string",
        ("same", "aaaaaaaaaaaa", "2020-01-01T00:00:00"), ("moved", "old", "2024-01-07T00:00:00"),
        ("web_old", "dd", "2024-01-01T00:00:00"), ("web_fresh", "dd", "2024-01-01T00:00:01"),
    )
    return sources, versions


@pytest.mark.parametrize("options, expected", [
    ({}, dict(same="up_to_date", moved="fetched", new="fetch_failed", down="network_error", web_old="fetched", web_fresh="up_to_date", odd="unknown_type")),
    (dict(force=True), dict(same="fetched", moved="fetched", new="fetch_failed", down="network_error", web_old="fetched", web_fresh="fetched", odd="unknown_type")),
    (dict(check_only=True), dict(same="up_to_date", moved="changed", new="changed", down="network_error", web_old="changed", web_fresh="up_to_date", odd="changed")),
    (dict(include_web=False), dict(same="up_to_date", moved="fetched", new="fetch_failed", down="network_error", web_old="skipped_web", web_fresh="skipped_web", odd="unknown_type")),
])
def test_refresh_status(registry, options, expected):
    found = refresh.detect_changes(*registry, NOW, **options).collect()
    assert {r.id: r.status for r in found} == expected


def test_refresh_details(registry):
    status = refresh.detect_changes(*registry, NOW)
    found = {r.id: r for r in status.collect()}
    assert found["same"].stored_sha == "a" * 10 and found["new"].stored_sha == "none" and found["new"].last_ingested == "never"
    assert found["moved"].files_written == 1 and found["same"].files_written is None
    assert tuple(refresh.refresh_rollup(status).head()) == (7, 2, 2)
    assert rows(refresh.reingest(registry[0], status).select("id"), "id") == [("moved",), ("new",), ("same",), ("web_fresh",), ("web_old",)]
    written = refresh.new_versions(status, registry[0], NOW)
    assert rows(written.select("id", "sha"), "id") == [("moved", "bbbbbbbbbbbb"), ("web_old", "dd")]
    assert tuple(refresh.refresh_rollup(status.where("false")).head()) == (0, 0, 0)


def test_markers_and_platform_skip(spark):
    marks = refresh.page_source_markers(frame(spark, "source string, sha string", ("w", "1")), frame(spark, "id string, latest string", ("g", "2")))
    assert rows(marks, "id") == [("g", "2"), ("w", "1")]
    skipped = refresh.is_platform_skipped
    assert [skipped(False, False, True), skipped(True, False, True), skipped(True, True, True), skipped(True, True, False)] == [False, True, False, True]


CASE = "id int, type string, expected_tool string, required_args array<string>, expected_arg_values map<string,string>, expected_rag_keyword string"
RESULT = "id int, platform string, routed string, response string, latency_ms int, first_tool string, first_args map<string,string>, n_calls bigint"


@pytest.mark.parametrize("case, result, marks", [
    (("single_tool", "t", ["a"], {"a": "1"}, None), ("p", "p", "r", 5, "t", {"a": "1"}, 1), (True, True, True, True, True)),
    (("single_tool", "t", ["a"], {"a": "1"}, None), ("p", "q", "r", 5, "u", {"b": "1"}, 1), (False, False, False, True, False)),
    (("single_tool", "t", [], {"x": "None"}, None), ("p", "p", "r", 5, "t", {}, 1), (True, True, True, True, True)),
    (("single_tool", "t", None, None, None), ("p", "p", "r", None, None, None, None), (False, True, True, True, True)),
    (("multi_tool", None, None, None, None), ("p", "p", "r", 5, "t", {}, 2), (False, True, True, True, True)),
    (("rag_only", None, None, None, "IAM"), ("p", "p", "use iam", 5, None, None, 0), (True, True, True, True, True)),
    (("rag_only", None, None, None, "iam"), ("p", "p", None, 5, None, None, None), (True, True, True, False, True)),
    (("rag_only", None, None, None, ""), ("p", "p", None, 5, None, None, None), (True, True, True, True, True)),
    (("single_tool", None, None, None, "iam"), ("p", "p", "x", 5, None, None, None), (True, True, True, True, True)),
])
def test_score(spark, case, result, marks):
    scored = evaluation.score_eval(frame(spark, CASE, (1, *case)), frame(spark, RESULT, (1, *result))).head()
    assert (scored.tool_ok, scored.req_ok, scored.val_ok, scored.rag_ok, scored.route_ok) == marks
    assert scored.ok == all(marks[:4])


def scores(spark, latencies, ok):
    return frame(
        spark, "id int, platform string, tool_ok boolean, req_ok boolean, val_ok boolean, rag_ok boolean, route_ok boolean, latency_ms int",
        *[(i, "p", o, True, True, True, o, l) for i, (l, o) in enumerate(zip(latencies, ok))],
    )


def test_summary_rounds_half_to_even_and_takes_floor_index(spark):
    found = evaluation.summarize_eval(scores(spark, range(16), [True] + [False] * 15)).head()
    assert (found.n, found.tool_selection_accuracy, found.required_arg_hit_rate) == (16, 6.2, 100.0)
    assert (found.p50_latency_ms, found.p95_latency_ms) == (7, 14)
    single = evaluation.summarize_eval(scores(spark, [9], [True])).head()
    assert (single.p50_latency_ms, single.p95_latency_ms) == (9, 9)
    assert evaluation.summarize_eval(scores(spark, [], [])).count() == 0


@pytest.mark.parametrize("values", [[5], [1, 2], [3, 3, 3, 9], list(range(100)), [7] * 40 + [8] * 3])
def test_percentiles_equal_sorting(spark, values):
    import statistics

    df = frame(spark, "g string, v int", *[("g", v) for v in values])
    found = evaluation.latency_summary(df, "g", "v").head()
    ordered = sorted(values)
    assert (found.n, found.p50, found.p95) == (len(values), int(statistics.median(values)), ordered[int(0.95 * (len(values) - 1))])


def test_percentiles_over_several_value_blocks(spark, monkeypatch):
    monkeypatch.setattr(windows, "_VALUES_PER_BLOCK", 10)
    df = frame(spark, "g string, v int", *[("g", v) for v in range(-50, 51)])
    assert tuple(evaluation.latency_summary(df, "g", "v").head()) == ("g", 101, 0, 45)


@pytest.mark.parametrize("n", [0, 1, 3, 100])
def test_large_caps_are_exact(spark, monkeypatch, n):
    df = frame(spark, "g string, v int", *[("hot", v) for v in range(90)], *[("cold", v) for v in range(5)])
    plain = windows.cap_per_group(df, ["g"], [F.col("v")], n)
    monkeypatch.setattr(windows, "_RANK_LIMIT", 0)
    assert rows(windows.cap_per_group(df, ["g"], [F.col("v")], n), "g", "v") == rows(plain, "g", "v")


@pytest.mark.parametrize("expected, least, calls, ok", [
    (["a", "b"], 2, ["a", "x", "b"], True), (["a", "b"], 2, ["b", "a"], False), (["a", "a"], 2, ["a"], False),
    (["a", "a"], 2, ["a", "a"], True), (["a"], 2, ["a"], False), ([], 0, [], True), (["a"], 1, [], False),
    (["a", "b", "c"], 3, ["a", "c", "b", "c"], True),
])
def test_sequence(spark, expected, least, calls, ok):
    cases = frame(spark, "id int, expected_tools_sequence array<string>, min_tool_calls int", (1, expected, least))
    logged = frame(spark, "id int, pos bigint, name string", *[(1, i, c) for i, c in enumerate(calls)])
    assert rows(evaluation.sequence_ok(cases, logged), "id") == [(1, ok)]


def test_sequence_of_one_huge_case(spark):
    """Most calls belong to one case, whose calls lie in many ranges; the rest are small cases around it."""
    rng = random.Random(9)
    expected, seqs, logged, lists = {}, [], [], {}
    for case in (1, 2, 3, 4, 5):
        want = [rng.choice("abc") for _ in range(rng.randint(0, 6))] + (["z"] * 30 + ["y"] * 3 if case == 3 else [])
        names = [rng.choice("abcd") for _ in range(rng.randint(0, 8))]
        if case == 3:
            names = [rng.choice("abcdz") for _ in range(4000)] + ["y", "q", "y"] + ["a"] * 50 + ["y"] * rng.randint(0, 1)
        lists[case] = names
        seqs.append((case, want, rng.randint(0, 3)))
        logged += [(case, 10 * i, n) for i, n in enumerate(names)]
        at = 0
        for n in names:
            at += at < len(want) and want[at] == n
        expected[case] = at == len(want) and len(names) >= seqs[-1][2]
    rng.shuffle(logged)
    calls = frame(spark, "id int, pos bigint, name string", *logged, (9, 1, "a"), (None, 1, "a"))
    for least in (0, 1):
        cases = frame(spark, "id int, expected_tools_sequence array<string>, min_tool_calls int", *seqs[:-1], (5, ["y"] * least, 0))
        expected[5] = not least or "y" in lists[5]
        found = evaluation.sequence_ok(cases, calls)
        assert {r.id: r.seq_ok for r in found.collect()} == expected
    for block in (1, 70, 10**6):
        assert {r.id: r.seq_ok for r in evaluation.sequence_ok(cases, calls, block).collect()} == expected
    plan = evaluation.sequence_ok(cases, calls)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(id#\w+, _block#", plan)


def test_missing_args(spark):
    calls = frame(spark, "name string, args map<string,string>", ("t", {"a": "", "b": "1", "c": None}))
    found = evaluation.missing_args(calls, frame(spark, "name string, required array<string>", ("t", ["a", "b", "c", "d"])))
    assert found.head().missing == ["a", "c", "d"]
    unknown = evaluation.missing_args(calls, frame(spark, "name string, required array<string>", ("u", ["a"]))).head()
    assert unknown.missing is None and unknown.known is False


@pytest.mark.parametrize("block", [1, 2, 7, 4096])
def test_with_next_equals_lead(spark, block):
    hot = [("hot", t, f"h{t}") for t in [*range(0, 40), *range(90, 95)]]
    data = frame(spark, "g string, t bigint, x string", *hot, ("a", 0, "a0"), ("a", 9, "a9"), ("b", 5, "b5"))
    found = windows.with_next(data, "g", "t", ["x"], block)
    from pyspark.sql.window import Window

    lead = data.withColumn("next_x", F.lead("x").over(Window.partitionBy("g").orderBy("t")))
    assert rows(found, "g", "t") == rows(lead, "g", "t")


def test_session_window_of_a_long_conversation(spark):
    messages = frame(
        spark, "conv_id int, turn int, role string, text string",
        *[(1, i, ("user", "assistant")[i % 2], f"m{i}") for i in range(30)], (1, 30, "system", "s"), (2, 0, "user", "x"),
    )
    found = {r.conv_id: [m.text for m in r.messages] for r in windows.session_window(messages).collect()}
    assert found == {1: [f"m{i}" for i in range(10, 30)], 2: ["x"]}


def test_pair_turns_skips_unanswered(spark):
    roles = ["system", "user", "user", "assistant", "assistant", "user"]
    messages = frame(spark, "conv_id int, turn int, role string, text string", *[(1, i, r, f"{r[0]}{i}") for i, r in enumerate(roles)])
    assert rows(windows.pair_turns(messages), "turn") == [(1, 2, "u2", "a3")]


def test_dense_ids_are_consecutive_in_order(spark):
    data = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.when(F.col("id") % 3 == 0, 1).otherwise(2).alias("g"))
    found = windows.dense_ids(data, ["g", "k"], 41).orderBy("g", "k").collect()
    assert [r.id for r in found] == list(range(42, 1042))


def test_latest_per_key(spark):
    events = frame(spark, "k string, t int, v string", ("a", 2, "new"), ("a", 1, "old"))
    found = windows.latest_per_key(frame(spark, "k string", ("a",), ("b",)), events, ["k"], ["t"], "v", "NO_RUNS")
    assert rows(found, "k") == [("a", "new"), ("b", "NO_RUNS")]


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "e"), ("a", "b")]


@pytest.mark.parametrize("direction, hops, expected", [
    ("DOWNSTREAM", 1, [("a", "b", 1), ("a", "c", 1)]),
    ("downstream", 2, [("a", "b", 1), ("a", "c", 1), ("a", "d", 2)]),
    ("UPSTREAM", 2, [("a", "b", 2), ("a", "c", 1)]),
])
def test_lineage(spark, direction, hops, expected):
    edges, seeds = frame(spark, "src string, dst string", *EDGES), frame(spark, "seed string", ("a",))
    assert rows(lineage.lineage(edges, seeds, direction, hops), "node") == expected


def test_lineage_all_and_cap(spark):
    edges, seeds = frame(spark, "src string, dst string", *EDGES), frame(spark, "seed string", ("a",), ("e",))
    assert rows(lineage.lineage_all(edges, seeds, "DOWNSTREAM"), "node") == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 3)]
    capped = lineage.capped_lineage(edges, seeds, "DOWNSTREAM", 2, 2)
    assert rows(capped.select("seed", "node", "degree"), "degree", "node") == [("a", "b", 1), ("a", "c", 1)]
    counted = lineage.capped_lineage(edges, seeds, "DOWNSTREAM", 2, 2, totals=True)
    assert rows(counted.select("seed", "node", "degree", "total_all_hops"), "degree", "node") == [("a", "b", 1, 4), ("a", "c", 1, 4)]
    assert rows(lineage.lineage_totals(edges, seeds, "DOWNSTREAM"), "seed") == [("a", 4), ("e", 0)]
    chain = frame(spark, "src int, dst int", *[(i, i + 1) for i in range(20)])
    assert lineage.lineage_all(chain, frame(spark, "seed int", (0,)), "DOWNSTREAM").agg(F.max("degree")).head()[0] == 20


@pytest.mark.parametrize("hops", [1, 2, 3, None])
def test_lineage_of_many_seeds_equals_breadth_first_search(spark, hops):
    """200 seeds take several words; node 0 is a hub, edges repeat, two have a null end."""
    rng = random.Random(4)
    pairs = [(rng.randrange(260), rng.choice((0, rng.randrange(260)))) for _ in range(420)] + [(0, i) for i in range(30)]
    after: dict = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    expected = set()
    for seed in range(200):
        at, seen, degree = {seed}, {seed}, 0
        while at and degree != hops:
            at, degree = {b for a in at for b in after.get(a, ())} - seen, degree + 1
            seen |= at
            expected |= {(seed, node, degree) for node in at}
    edges = frame(spark, "src int, dst int", *pairs, (None, 3), (3, None))
    seeds = frame(spark, "seed int", *[(i,) for i in range(200)], (5,), (None,)).repartition(3)
    found = [tuple(r) for r in lineage.lineage(edges, seeds, "DOWNSTREAM", hops).select("seed", "node", "degree").collect()]
    assert sorted(found) == sorted(expected)
    assert lineage.lineage(edges, seeds.limit(0), "UPSTREAM", hops).count() == 0 == lineage.lineage(edges.limit(0), seeds, "UPSTREAM", hops).count()


def test_capped_lineage_walks_no_further(spark, monkeypatch):
    chain = frame(spark, "src int, dst int", *[(i, i + 1) for i in range(9)])
    levels = []
    walk = lineage.walk
    monkeypatch.setattr(lineage, "walk", lambda *a: levels.append(walk(*a)) or levels[-1])
    assert lineage.capped_lineage(chain, frame(spark, "seed int", (0,)), "DOWNSTREAM", 2).count() == 2 and len(levels[0]) == 2


RAW = "urn string, type string, name string, platform string, properties struct<name:string,displayName:string,description:string,definition:string>"


@pytest.mark.parametrize("raw, expected", [
    (("u", "T", "n", "p", ("pn", "d", "desc", "def")), ("u", "T", "pn", "p", "desc")),
    (("u", "T", "n", None, ("", "d", "", "def")), ("u", "T", "d", "", "def")),
    (("u", "T", "n", "p", None), ("u", "T", "n", "p", "")),
    (("u", None, "", "p", (None, None, None, None)), ("u", "", "u", "p", "")),
])
def test_entity_summary(spark, raw, expected):
    assert tuple(catalog.summarize_entities(frame(spark, RAW, raw)).head()) == expected


def test_entity_search_and_facet(spark):
    entities = frame(
        spark, "urn string, type string, name string, platform string, description string",
        ("u1", "DATASET", "Orders", "s", ""), ("u2", "DATASET", "x", "s", "all orders"), ("u3", "CHART", "orders", "l", ""),
    )
    urns = lambda df: [r.urn for r in df.collect()]
    assert urns(catalog.search_entities(entities, "ORDERS", "dataset")) == ["u1", "u2"]
    assert urns(catalog.search_entities(entities, "*")) == ["u1", "u3", "u2"] and urns(catalog.search_entities(entities, "", count=1)) == ["u1"]
    assert rows(catalog.facet(entities, "platform", F.when(F.col("platform") == "s", "Shop")), "urn") == [("l", "l", 1), ("s", "Shop", 2)]


def test_dataset_detail_caps_fields_and_drops_owners(spark):
    fields = frame(spark, "urn string, pos int, path string, type string, description string", *[("u", i, f"c{i}", None, None) for i in range(60)])
    found = {r.urn: r for r in catalog.dataset_detail(
        frame(spark, "urn string", ("u",), ("v",)), fields,
        frame(spark, "urn string, owner string, name string", ("u", "o", None), ("u", None, "x")),
        frame(spark, "urn string, tag string", ("u", "t"), ("u", "t")), frame(spark, "urn string, term string", ("u", "g")),
        frame(spark, "urn string, domain struct<urn:string,name:string>", ("u", ("d", "D"))),
    ).collect()}
    u = found["u"]
    assert (len(u.fields), u.field_count, u.fields[49].path, u.fields[0].type) == (50, 60, "c49", "")
    assert [tuple(o) for o in u.owners] == [("o", "")] and u.tags == ["t"] and u.domain.name == "D"
    assert found["v"].field_count == 0 and found["v"].domain is None


def test_dataset_detail_caps_every_list(spark):
    empty = lambda schema: frame(spark, schema)
    found = catalog.dataset_detail(
        frame(spark, "urn string", ("u",)), empty("urn string, pos int, path string, type string, description string"),
        frame(spark, "urn string, owner string, name string", *[("u", f"o{i}", f"n{i}") for i in (3, 1, 2, 1)]),
        frame(spark, "urn string, tag string", *[("u", f"t{i % 5}") for i in range(50)], ("u", None)),
        frame(spark, "urn string, term string", ("other", "g")), empty("urn string, domain struct<urn:string,name:string>"), most_values=2,
    ).head()
    assert [tuple(o) for o in found.owners] == [("o1", "n1"), ("o2", "n2")] and found.tags == ["t0", "t1"]
    assert found.fields is None and found.glossary_terms is None and found.field_count == 0


def test_add_tags_is_idempotent(spark):
    have = frame(spark, "resource_urn string, tag_urn string", ("r", "urn:li:tag:A"))
    new = frame(spark, "resource_urn string, tag_urn string", ("r", "PII"), ("r", "urn:li:tag:A"))
    once = catalog.add_tags(have, new)
    assert rows(once, "tag_urn") == [("r", "urn:li:tag:A"), ("r", "urn:li:tag:PII")] == rows(catalog.add_tags(once, new), "tag_urn")


def test_filter_attrs(spark):
    df = frame(spark, "a string, b string", ("1", "x"), ("2", "x"), ("3", "y"))
    assert rows(catalog.filter_attrs(df, [{"Name": "a", "Values": ["1", "3"]}, {"Name": "b", "Values": ["x"]}]), "a") == [("1", "x")]
    assert catalog.filter_attrs(df, []).count() == 3


def test_search(spark):
    turns = frame(
        spark, "id int, query string, response string",
        (1, "How do I copy a Table", "use clone"), (2, "table of contents", "copy it"), (3, "tables", "50%_x"), (4, "of", "the end"),
    )
    index = search.build_postings(turns)
    found = search.search_turns(turns, index, {"and": "copy TABLE", "pre": "tabl*", "phrase": '"table of"', "seam": '"of the"', "none": " "})
    assert rows(found.select("search", "id"), "search", "id") == [("and", 1), ("and", 2), ("phrase", 2), ("pre", 1), ("pre", 2), ("pre", 3)]
    assert search.search_turns(turns, index, {"none": ""}).count() == 0
    assert [r.id for r in history.search_like(turns, "COPY").collect()] == [2, 1]
    assert [r.id for r in history.search_like(turns, "50%").collect()] == [3]
    assert [r.id for r in history.recent(turns, 2).collect()] == [4, 3] and history.get_turn(turns, id=2).head().query == "table of contents"


TEXTS = [
    (1, "a b c a b", "c d"), (2, "b a", "a b"), (3, "A. B!", None), (4, None, "b c d"), (5, "ab", "abc a"), (6, "", ""), (7, 'say "a b', "50%_x (a"), (8, "a b x a b c", "d"),
]
MATCHES = {
    "a b": [1, 2, 3, 7, 8], '"a b"': [1, 2, 3, 7, 8], '"a b c"': [1, 8], "a + b + c": [1, 8], '"a b" *': [1, 2, 3, 7, 8], "ab*": [5], '"a b" NOT d': [2, 3, 7],
    "c OR ab": [1, 4, 5, 8], "d AND c NOT a": [4], "d NOT a OR ab": [4, 5], "(ab OR b) AND c": [1, 4, 8], "query : a": [1, 2, 3, 7, 8], "response : a": [2, 5, 7],
    "^b": [2, 4], "^ab*": [5], '^ "a b"': [1, 2, 3, 8], "response : ^a": [2], "and": [], "a NOT b": [5], '""': [], '"!!" a NOT b': [5], '"" OR ab': [5], 'a NOT "."': [1, 2, 3, 5, 7, 8],
    # no expressions: LIKE patterns
    '"a b': [7], "a.": [3], "50%": [7], "(a": [7], "a OR": [], "AND": [], "NEAR(a b)": [], "titel : a": [], "a (b)": [], "_x": [], "%_x (": [7], "a )": [], "x'": [],
}


def test_match_expressions(spark):
    turns = frame(spark, "id int, query string, response string", *TEXTS)
    found = search.search_turns(turns, search.build_postings(turns), {m: m for m in MATCHES})
    assert {m: sorted(r.id for r in found.where(F.col("search") == m).collect()) for m in MATCHES if m != "_x"} == {m: x for m, x in MATCHES.items() if m != "_x"}


def test_match_grammar():
    assert search.parse_match("  ") is None and search.parse_match('"?"') is None
    a, b, c = (search.Phrase((x,)) for x in "abc")
    assert search.parse_match("a b NOT c") == ("NOT", ("AND", a, b), c)
    assert search.parse_match("a OR b AND c") == ("OR", a, ("AND", b, c))
    assert search.parse_match('"say ""a"""') == search.Phrase(("say", "a"))
    for wrong in ('"a', "a AND", "OR a", "(a", "a)", "()", "a.b", "x : a", "a +", "*", "NEAR(a b)", "a (b)", "NOT a", ":", "-a"):
        with pytest.raises(search.MatchError):
            search.parse_match(wrong)


def test_search_caps_before_text_is_read(spark, tmp_path):
    turns = frame(spark, "id int, query string, response string", *[(i, f"word {i}", "x y") for i in range(50)])
    turns.write.parquet(str(tmp_path / "turns"))
    search.build_postings(turns).write.parquet(str(tmp_path / "index"))
    turns, index = (spark.read.parquet(str(tmp_path / x)) for x in ("turns", "index"))
    found = search.search_turns(turns, index, {"a": "word", "b": '"x y" OR word'}, 3)
    assert rows(found.select("search", "id"), "search", "id") == [(s, i) for s in "ab" for i in (47, 48, 49)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window"):]
    assert "response" not in below and "query" not in below and "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


TURN = "id int, ts string, platform string, query string, response string, tools_json string, rag_sources_json string, latency_ms int"


def test_render_turn(spark):
    turn = (7, "2024-01-01T00:00:00", "aws", "one\ntwo\n", " answer ", '[{"name": "t", "args": {"a": 1}, "result": {"b": [1]}}]', '[{"source": "a\\\\b", "score": 0.456}]', 12)
    expected = """---
timestamp: 2024-01-01T00:00:00
platform: aws
latency_ms: 12
tools: [t]
rag_sources:
  - a/b (score=0.46)
query: |
  one
  two
---

# Query

one
two

# Response

answer

## Tool calls

### 1. `t`

**Args:** `{"a": 1}`

**Result:**

```json
{
  "b": [
    1
  ]
}
```
"""
    assert history.render_turns(frame(spark, TURN, turn)).head().markdown == expected
    bare = history.render_turns(frame(spark, TURN, (8, "t", None, "q", None, None, None, None))).head().markdown
    assert bare == "---\ntimestamp: t\nplatform: unknown\nlatency_ms: 0\ntools: []\nrag_sources: []\nquery: |\n  q\n---\n\n# Query\n\nq\n\n# Response\n\n\n"


def test_odd_tool_lists_are_no_errors(spark):
    from corpusflow.operators.history import tool_appendix

    texts = [None, "", "[1]", "{}", "not json", '[1, {"name": "t", "args": {"a": 1}, "result": [2]}]']
    found = [r.s for r in frame(spark, "i int, t string", *enumerate(texts)).select("i", tool_appendix("t").alias("s")).orderBy("i").collect()]
    assert found[:5] == [""] * 5
    assert found[5] == "\n## Tool calls\n\n### 1. `t`\n\n**Args:** `{\"a\": 1}`\n\n**Result:**\n\n```json\n[\n  2\n]\n```\n"


def test_null_keys_find_nothing_on_either_path(spark):
    from corpusflow.operators import retrieval

    asked = frame(spark, "qid int, p string, qvec array<double>", (1, "a", [1.0, 0.0]), (2, None, [1.0, 0.0]))
    held = frame(spark, "id int, p string, vec array<double>", (1, "a", [1.0, 0.0]), (2, None, [1.0, 0.0]))
    both = [retrieval.retrieve(asked, held, keys=["p"], k=1, broadcast_bytes=size) for size in (0, 1 << 20)]
    assert [rows(df.select("qid", "id"), "qid") for df in both] == [[(1, 1)], [(1, 1)]]
