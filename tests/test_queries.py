"""Every registered query against its SQL twin, and the plans they run with."""

import pytest

import __spark_entry__ as entry
import compare
from corpusflow.plans.workloads import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, folder, db, name):
    assert compare.differences(QUERIES[name](spark, folder), ORACLES[name], db) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "vec_id", "score", "rank"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


PLANNED = sorted(n for n in QUERIES if not n.startswith("stream_"))


@pytest.mark.parametrize("name", PLANNED)
def test_no_pairwise_join(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["retrieve_topk", "session_window", "url_cap", "cap_listing", "dataset_detail"])
def test_rank_limit_runs_before_the_shuffle(spark, folder, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, folder))


@pytest.mark.parametrize("name", ["history_recent", "query_history", "like_search", "entity_search", "sql_capped"])
def test_top_n_needs_no_full_sort(spark, folder, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, folder))


@pytest.mark.parametrize("name", ["keyword_hits", "route_keywords", "chunk_stats", "embed_docs", "extract_article", "flatten_nested"])
def test_row_wise_work_does_not_shuffle(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert "hashpartitioning" not in text and "rangepartitioning" not in text


def test_prefix_and_columns_reach_the_scan(spark, folder):
    text = QUERIES["object_rollup"](spark, folder)._jdf.queryExecution().executedPlan().treeString()
    assert "StringStartsWith(url,https://)" in text
    text = QUERIES["platform_facets"](spark, folder)._jdf.queryExecution().executedPlan().treeString()
    assert "ReadSchema: struct<p_brand:string>" in text


def test_import_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"],
                   cwd=Path(__file__).parent.parent, check=True)


def test_search_terms_reach_the_stored_index(spark, folder):
    text = QUERIES["stored_index_search"](spark, folder)._jdf.queryExecution().executedPlan().treeString()
    assert "StringStartsWith(token,eau)" in text and "EqualTo(token,the)" in text


def test_capped_lineage_counts_all_hops(spark, tmp_path):
    """Part 1 is in 25 orders of 25 customers: 20 orders are listed, all 50 nodes counted."""
    write = lambda name, schema, data: spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    write("orders", "o_orderkey long, o_custkey long", [(i, 100 + i) for i in range(25)])
    write("lineitem", "l_orderkey long, l_partkey long, l_suppkey long", [(i, 1, 1) for i in range(25)] * 2)
    write("part", "p_partkey long", [(1,), (2,)])
    found = QUERIES["lineage_capped"](spark, str(tmp_path)).collect()
    assert len(found) == 20 and {(r.seed, r.degree, r.total_all_hops) for r in found} == {("part/1", 1, 50)}


def test_texts_go_to_python_in_batches_of_bounded_bytes(spark, tmp_path):
    from pyspark.sql.functions import pandas_udf

    from corpusflow.plans.workloads.base import Tables

    spark.range(3000).selectExpr("id", "repeat('long ', 4000) AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))

    @pandas_udf("long")
    def in_batch(texts):
        return texts.str.len() * 0 + texts.str.len().sum()

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    most = Tables(spark, str(tmp_path)).documents.select(in_batch("text").alias("n")).agg({"n": "max"}).head()[0]
    assert most <= 8 << 20


def test_words_are_counted_without_a_shuffle(spark, folder):
    """Texts meet the weights by word and their sums meet by id; none is dealt out by id and word."""
    keys = [line.split("hashpartitioning(")[1] for line in plan(QUERIES["embed_docs_idf"](spark, folder)).splitlines() if "hashpartitioning(" in line]
    assert keys and not [k for k in keys if "doc_id#" in k and "word#" in k]
