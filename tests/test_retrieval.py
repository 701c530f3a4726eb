import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import retrieval
from corpusflow.operators import vector_index
from corpusflow.operators.retrieval import build_context, count_above_floor, rag_sources, retrieve
from corpusflow.operators.vector_index import VectorIndex, build_index

RNG = np.random.default_rng(3)


def table(spark, names, ids, keys, vectors):
    rows = [(i, k, [float(x) for x in v]) for i, k, v in zip(ids, keys, vectors)]
    return spark.createDataFrame(rows, f"{names[0]} bigint, platform string, {names[1]} array<float>")


@pytest.fixture(scope="module")
def sides(spark):
    """One platform holds most rows, many of them copies of one vector, so cells split and scores tie."""
    keys = ["hot"] * 300 + ["cold"] * 40 + ["alone"]
    vectors = RNG.standard_normal((341, 8)).astype(np.float32)
    vectors[20:140] = vectors[20]
    asked = RNG.standard_normal((60, 8)).astype(np.float32)
    asked[0] = vectors[20]
    asked_keys = ["hot"] * 40 + ["cold"] * 19 + ["nowhere"]
    return (
        table(spark, ("qid", "qvec"), range(60), asked_keys, asked),
        table(spark, ("id", "vec"), range(341), keys, vectors),
        (asked, asked_keys, vectors, keys),
    )


def brute_force(data, k, floor, space):
    asked, asked_keys, vectors, keys = data
    result = {}
    for q, (v, key) in enumerate(zip(asked.astype(float), asked_keys)):
        scored = []
        for i, (w, other) in enumerate(zip(vectors.astype(float), keys)):
            if key == other:
                raw = {"ip": v @ w, "cosine": v @ w / np.linalg.norm(v) / np.linalg.norm(w)}.get(space, 1 - ((v - w) ** 2).sum() / 2)
                score = round(min(1.0, max(0.0, raw)), 9)
                if score >= floor:
                    scored.append((-score, i))
        result[q] = [(i, -s) for s, i in sorted(scored)]
    return {q: hits[:k] for q, hits in result.items() if hits}, {q: len(h) for q, h in result.items()}


WAYS = {"broadcast": {}, "grid": dict(broadcast_bytes=0, cell_rows=50, cell_questions=7)}


@pytest.mark.parametrize("space", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("way", WAYS)
def test_retrieve_equals_brute_force(sides, way, space):
    expected, _ = brute_force(sides[2], 5, 0.3, space)
    found = {}
    for r in retrieve(sides[0], sides[1], space=space, **WAYS[way]).orderBy("qid", "rank").collect():
        found.setdefault(r.qid, []).append((r.id, r.score))
    assert {q: [i for i, _ in hits] for q, hits in found.items()} == {q: [i for i, _ in hits] for q, hits in expected.items()}
    assert all(np.allclose([s for _, s in found[q]], [s for _, s in expected[q]]) for q in expected)


@pytest.mark.parametrize("way", WAYS)
def test_counts_equal_brute_force(sides, way):
    _, expected = brute_force(sides[2], 5, 0.3, "cosine")
    assert {r.qid: r.n for r in count_above_floor(sides[0], sides[1], **WAYS[way]).collect()} == expected


def test_small_score_blocks_change_nothing(sides, monkeypatch):
    whole = retrieve(sides[0], sides[1]).collect()
    monkeypatch.setattr(retrieval, "_SCORES_AT_ONCE", 64)
    assert sorted(retrieve(sides[0], sides[1]).collect()) == sorted(whole)


def test_broadcast_bound_decides_the_way(sides):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan(retrieve(sides[0], sides[1]))
    assert "CoGroup" in plan(retrieve(sides[0], sides[1], broadcast_bytes=60 * 8 * 8 - 1))
    assert "CoGroup" not in plan(retrieve(sides[0], sides[1], broadcast_bytes=60 * 8 * 8))


@pytest.mark.parametrize("floor", [0.0, 0.3, 0.8])
def test_floor_before_topk_equals_topk_before_floor(sides, floor):
    early = retrieve(sides[0], sides[1], k=4, floor=floor).select("qid", "id").collect()
    late = retrieve(sides[0], sides[1], k=8, floor=0.0).where((F.col("score") >= floor) & (F.col("rank") <= 4)).select("qid", "id")
    assert sorted(early) == sorted(late.collect())


def test_no_questions_and_no_rows(sides):
    assert retrieve(sides[0].where("false"), sides[1]).count() == 0
    assert retrieve(sides[0], sides[1].where("false")).count() == 0


def test_skip_self(sides):
    same = sides[1].select(F.col("id").alias("qid"), "platform", F.col("vec").alias("qvec"))
    assert retrieve(same, sides[1], k=2, skip_self=True).where("qid = id").count() == 0
    assert retrieve(same, sides[1], k=200).where("qid = id").count() == 341


def recall(found, exact):
    exact = {(r.qid, r.id) for r in exact.collect()}
    return len(exact & {(r.qid, r.id) for r in found.collect()}) / len(exact)


def clustered(spark, n=3000, dims=16, seed=5):
    """Rows around 40 centres; the first platform holds nine tenths."""
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((40, dims))[rng.integers(0, 40, n)] + 0.4 * rng.standard_normal((n, dims))).astype(np.float32)
    keys = ["hot" if i % 10 else "cold" for i in range(n)]
    rows = table(spark, ("id", "vec"), range(n), keys, vectors)
    return rows, rows.where("id % 100 = 0").select(F.col("id").alias("qid"), "platform", F.col("vec").alias("qvec"))


@pytest.mark.parametrize("space", ["cosine", "l2"])
def test_index_recall_and_share(spark, space):
    rows, questions = clustered(spark)
    index = build_index(rows, space=space)
    args = dict(space=space, floor=0.1, skip_self=True)
    found = index.search(questions, floor=0.1, skip_self=True)
    assert recall(found, retrieve(questions, rows, **args)) >= 0.9
    every = {(r.qid, r.id): r.score for r in retrieve(questions, rows, k=10**6, **args).collect()}
    assert all(every[r.qid, r.id] == pytest.approx(r.score) for r in found.collect())
    cells = index.rows.groupBy("platform", "cell").count()
    scored = index.probes(questions).join(cells, ["platform", "cell"]).groupBy("platform").agg(F.sum("count").alias("n"), F.countDistinct("qid").alias("q"))
    total = {r.platform: r["count"] for r in rows.groupBy("platform").count().collect()}
    assert all(r.n <= total[r.platform] * r.q / 3 for r in scored.collect())


def test_index_of_all_cells_is_the_exact_search(sides):
    index = build_index(sides[1])
    assert sorted(index.search(sides[0], share=1.0).collect()) == sorted(retrieve(sides[0], sides[1]).collect())


def test_index_by_the_grid_equals_the_broadcast(sides, monkeypatch):
    few = build_index(sides[1])
    expected = sorted(few.search(sides[0]).collect())
    assert sorted(few.search(sides[0], broadcast_bytes=0, cell_rows=16, cell_questions=4).collect()) == expected
    monkeypatch.setattr(vector_index, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vector_index, "CELL_ROWS", 50)
    assert sorted(build_index(sides[1]).search(sides[0], broadcast_bytes=0).collect()) == expected


def test_saved_index_prunes_cells(spark, sides, root):
    index = build_index(sides[1])
    index.save(root)
    loaded = VectorIndex.load(spark, root)
    found = loaded.search(sides[0])
    assert sorted(found.collect()) == sorted(index.search(sides[0]).collect())
    one = loaded.search(sides[0].limit(1))
    plan = one._jdf.queryExecution().executedPlan().treeString()
    assert "(cell," in plan.split("PushedFilters:")[1].split("]")[0]


def test_index_of_odd_rows(spark):
    rows = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "a", [0.0, 0.0]), (4, None, [1.0, 0.0]), (5, "a", None), (6, "b", [0.0, 1.0])],
        "id bigint, platform string, vec array<float>").withColumn("cell", F.lit("clash")).withColumn("weight", F.lit(0))
    questions = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, "c", [1.0, 0.0]), (4, "b", None)], "qid bigint, platform string, qvec array<float>")
    index = build_index(rows)
    assert sorted(r.id for r in index.rows.collect()) == [1, 2, 3, 6]
    assert [(r.qid, r.id, r.score) for r in index.search(questions, share=1.0).orderBy("qid", "rank").collect()] == [(1, 1, 1.0), (1, 2, 1.0)]
    empty = build_index(rows.limit(0))
    assert empty.rows.count() == 0 and empty.search(questions).count() == 0


def test_context_and_sources(spark):
    questions = spark.createDataFrame([(1,), (2,)], "qid bigint")
    hits = spark.createDataFrame(
        [(1, 2, "b.md", 0.5, "  two\n"), (1, 1, "a.md", 0.876, "one"), (1, 6, "f.md", 0.3, "six")],
        "qid bigint, rank int, source string, score double, content string",
    )
    context = {r.qid: r.context for r in build_context(questions, hits).collect()}
    assert context[1] == "[Source: a.md | Score: 0.88]\none\n\n[Source: b.md | Score: 0.50]\ntwo\n"
    assert context[2] == "No relevant documentation retrieved."
    assert [tuple(s) for s in rag_sources(hits).head().sources] == [("a.md", 0.876), ("b.md", 0.5), ("f.md", 0.3)]
