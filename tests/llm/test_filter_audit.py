"""Filter audit: diagrams against plain counting in every order, and odd rows. The query has its SQL in test_llm."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import filter_audit


def plain(counts: dict, order: tuple) -> list:
    out, gone = [], 0
    for name in order:
        bit = 1 << name
        hit = [(m, w) for m, w in counts.items() if m & bit and not m & gone]
        fails = sum(w[0] for m, w in counts.items() if m & bit)
        removed = sum(w[0] for _, w in hit)
        gone |= bit
        out.append((name, sum(w[0] for m, w in counts.items() if not m & gone), removed, fails - removed,
                    sum(w[0] for m, w in counts.items() if m == bit), sum(w[1] for _, w in hit), sum(w[2] for _, w in hit)))
    return out


def read_off(diagram) -> list:
    fails = diagram.failing()
    return [(name, kept[0], removed[0], fails[name] - removed[0], alone, removed[1], removed[2]) for name, kept, removed, alone in diagram.steps()]


@pytest.mark.parametrize("filters", [1, 2, 3, 5])
def test_diagram_in_all_orders(filters):
    rng = random.Random(filters)
    counts = {m: (n := rng.randrange(50), rng.randrange(n + 1), rng.randrange(n + 1)) for m in range(1 << filters) if rng.random() < 0.6}
    diagram = filter_audit.Diagram(counts, filters)
    seen = []
    for _ in filter_audit._through(diagram, None):
        assert read_off(diagram) == plain(counts, tuple(diagram.order))
        seen.append(tuple(diagram.order))
    assert sorted(seen) == sorted(permutations(range(filters)))
    for order in permutations(range(filters)):
        next(filter_audit._through(diagram, [list(order)]))
        assert tuple(diagram.order) == order and read_off(diagram) == plain(counts, order)


def test_equal_rests_are_one_node():
    diagram = filter_audit.Diagram({m: (1, 0, 0) for m in range(32)}, 5)
    assert [len(x) for x in diagram.nodes] == [1] * 5
    for i in filter_audit.plain_changes(5):
        diagram.swap(i)
        assert [len(x) for x in diagram.nodes] == [1] * 5


def test_odd_rows(spark):
    enough = " ".join(f"w{i}" for i in range(200))
    long = " ".join(f"w{i % 150_000}" for i in range(200_000))
    rows = [
        (1, None, "en"), (2, "", "en"), (None, "", None), (None, enough, "en"), (3, enough, "en"), (3, enough, "en"), (4, enough, None), (5, enough, "en"),
        (6, "same " * 200, "en"), (7, "A" * 9 + enough, "en"), (8, "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA" * 3 + enough, "en"), (9, enough + "#", "en"), (10, long, "de"), (11, "a b\x1cc", "de"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({x: F.lit(0) for x in ("id", "mask", "n", "part", "good", "least", "place")})
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (None, 1, 1), (5, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    counts = {(r.part, r.mask): (r.n, r.good, r.toxic) for r in filter_audit.mask_counts(docs, labels).collect()}
    # A 1, B 2, C 4, D 8, E 16; the two rows of id 3 hold the smallest id, the row without id fails nothing for its copies
    assert counts == {
        ("en", 1): (1, 0, 0), ("en", 17): (1, 0, 0), ("", 1): (1, 0, 0), ("en", 0): (4, 2, 2), ("", 16): (1, 0, 0), ("en", 16): (1, 1, 0),
        ("en", 2): (1, 0, 0), ("en", 4): (1, 0, 0), ("en", 8): (1, 0, 0), ("de", 0): (1, 0, 0), ("de", 1): (1, 0, 0)}
    assert filter_audit.audit(filter_audit.mask_counts(docs.limit(0), labels), "ABCDE").count() == 0
    assert filter_audit.audit(filter_audit.mask_counts(docs, labels.limit(0)), "ABCDE").count() == 3 * 600


def test_given_orders_and_other_filters(spark):
    counts = spark.createDataFrame([("p", 1, 3, 0, 0), ("p", 3, 2, 1, 0), ("p", 0, 5, 0, 1)], "part string, mask int, n long, good long, toxic long")
    found = filter_audit.audit(counts, ["x", "y"], ["yx"]).orderBy("step").collect()
    assert [(r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in found] == [("y", 8, 2, 0, 0, 1, 2), ("x", 5, 3, 2, 3, 0, 3)]


def test_filter_on_any_type_of_id(spark):
    docs = spark.createDataFrame([("a", "t", "en"), ("b", "t", "en")], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([("b", 1, 1)], "doc_id string, quality int, toxic int")
    assert {(r.mask, r.n, r.good) for r in filter_audit.mask_counts(docs, labels).collect()} == {(1, 1, 0), (17, 1, 1)}
