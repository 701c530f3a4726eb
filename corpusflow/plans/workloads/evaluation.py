"""Evaluation queries. An order is a labelled case, its line items are the logged tool calls.

The order status gives the kind of case, the priority the platform, the price the latency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.registry import signature_rows
from corpusflow.operators.evaluation import (
    first_calls, latency_summary, missing_args, score_eval, sequence_ok, summarize_eval, summarize_eval_rollup,
)
from corpusflow.plans.workloads.base import Tables, query
from corpusflow.sources.evaluation import read_eval, write_eval
from corpusflow.session import scratch_path


def _order_columns() -> tuple[Column, Column]:
    return F.col("o_orderpriority"), F.col("o_orderstatus")


def _cases(t: Tables) -> DataFrame:
    text_map = "map<string,string>"
    priority, status = _order_columns()
    single = status == "F"
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(single, "single_tool").when(status == "O", "multi_tool").otherwise("rag_only").alias("type"),
        F.when(single & priority.isin("1-URGENT", "2-HIGH"), "A_F").when(single, "R_O").alias("expected_tool"),
        F.when(single & (priority == "5-LOW"), F.array(F.lit("qty"), F.lit("warehouse")))
        .when(single, F.array(F.lit("qty"))).alias("required_args"),
        F.when(single & (priority == "1-URGENT"), F.create_map(F.lit("line"), F.lit("1")))
        .when(single & (priority == "3-MEDIUM"), F.create_map(F.lit("region"), F.lit("None")))
        .cast(text_map).alias("expected_arg_values"),
        F.when(status == "P", F.when(priority == "2-HIGH", "").when(priority == "1-URGENT", "urgent").otherwise("LOW"))
        .alias("expected_rag_keyword"),
    )


def _calls(t: Tables) -> DataFrame:
    return t.spread("lineitem").select(
        F.col("l_orderkey").alias("id"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("pos"),
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("name"),
        F.create_map(
            F.lit("qty"), F.col("l_quantity").cast("int").cast("string"), F.lit("line"), F.col("l_linenumber").cast("string")
        ).alias("args"),
        "l_suppkey", "l_extendedprice",
    )


def _results(t: Tables) -> DataFrame:
    priority, _ = _order_columns()
    results = t.orders.select(
        F.col("o_orderkey").alias("id"), priority.alias("platform"),
        F.concat(F.lit("Priority "), priority, F.lit(" for "), "o_custkey").alias("response"),
        F.when(F.col("o_totalprice") > 100000, priority).otherwise("ambiguous").alias("routed"),
        F.floor(F.col("o_totalprice") / 100).cast("int").alias("latency_ms"),
    )
    firsts = first_calls(_calls(t), order=["pos", "l_suppkey", "l_extendedprice"])
    return results.join(firsts, "id", "left")


_SCORES_SQL = """
    calls AS (
        SELECT l_orderkey AS id, l_linenumber * 1000000000 + l_partkey AS pos, l_returnflag || '_' || l_linestatus AS name,
               l_linenumber, l_suppkey, l_extendedprice
        FROM (SELECT * REPLACE (l_linenumber::BIGINT AS l_linenumber) FROM lineitem)
    ),
    firsts AS (
        SELECT id, arg_min({'name': name, 'line': l_linenumber::VARCHAR}, (pos, l_suppkey, l_extendedprice)) AS f, count(*) AS n
        FROM calls GROUP BY 1
    ),
    joined AS (
        SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS p, o_custkey, o_totalprice, f.name AS name, f.line AS line, coalesce(n, 0) AS n
        FROM orders LEFT JOIN firsts ON id = o_orderkey
    ),
    scores AS (
        SELECT id, CASE s WHEN 'F' THEN 'single_tool' WHEN 'O' THEN 'multi_tool' ELSE 'rag_only' END AS type, p AS platform,
               CASE WHEN s = 'F' THEN coalesce(name = CASE WHEN p IN ('1-URGENT', '2-HIGH') THEN 'A_F' ELSE 'R_O' END, false)
                    ELSE n = 0 END AS tool_ok,
               CASE WHEN s = 'F' THEN n > 0 AND p <> '5-LOW' ELSE true END AS req_ok,
               CASE WHEN s = 'F' AND p = '1-URGENT' THEN coalesce(line, 'None') = '1' ELSE true END AS val_ok,
               CASE WHEN s = 'P' AND p NOT IN ('1-URGENT', '2-HIGH') THEN contains(lower('Priority ' || p), 'low') ELSE true END AS rag_ok,
               o_totalprice > 100000 AS route_ok, floor(o_totalprice / 100)::INTEGER AS latency_ms
        FROM joined
    )
"""


def _scores(t: Tables) -> DataFrame:
    return score_eval(_cases(t), _results(t))


@query("eval_score", f"WITH {_SCORES_SQL} SELECT *, tool_ok AND req_ok AND val_ok AND rag_ok AS ok FROM scores")
def scores(t: Tables) -> DataFrame:
    return _scores(t)


_RATES_SQL = ", ".join(
    f"round_even(100.0::DOUBLE * count(*) FILTER ({mark}) / count(*), 1) AS {name}"
    for mark, name in (
        ("tool_ok", "tool_selection_accuracy"), ("req_ok", "required_arg_hit_rate"), ("val_ok", "arg_value_hit_rate"),
        ("rag_ok", "rag_keyword_hit_rate"), ("route_ok", "routing_accuracy"),
    )
)


def _percentiles_sql(source: str, key: str, latency: str, p50: str, p95: str) -> str:
    return f"""
        SELECT {key}, trunc(quantile_cont({latency}, 0.5))::INTEGER AS {p50},
               (list({latency} ORDER BY {latency}))[floor(0.95::DOUBLE * (count(*) - 1))::BIGINT + 1]::INTEGER AS {p95}
        FROM {source} GROUP BY 1
    """


@query("eval_summary", f"""
    WITH {_SCORES_SQL}
    SELECT * FROM (SELECT platform, count(*) AS n, {_RATES_SQL} FROM scores GROUP BY 1)
    JOIN ({_percentiles_sql('scores', 'platform', 'latency_ms', 'p50_latency_ms', 'p95_latency_ms')}) USING (platform)
""")
def summary(t: Tables) -> DataFrame:
    return summarize_eval(_scores(t))


@query("eval_summary_rollup", f"""
    WITH {_SCORES_SQL}
    SELECT platform, count(*) AS n, {_RATES_SQL} FROM scores GROUP BY 1
    UNION ALL SELECT 'ALL', count(*), {_RATES_SQL} FROM scores
""")
def summary_rollup(t: Tables) -> DataFrame:
    return summarize_eval_rollup(_scores(t))


@query("eval_files", f"""
    WITH {_SCORES_SQL}, marked AS (SELECT *, tool_ok AND req_ok AND val_ok AND rag_ok AS ok FROM scores)
    SELECT platform, type, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM marked GROUP BY ALL
""")
def eval_files(t: Tables) -> DataFrame:
    """The cases written as JSON files per platform, read with the case schema, scored, and written out again."""
    root = scratch_path(t.spark, "eval")
    platforms = _results(t).select("id", "platform")
    _cases(t).join(platforms, "id").write.partitionBy("platform").json(f"{root}/cases")
    cases = read_eval(t.spark, f"{root}/cases/*/*.json", multi_line=False).drop("platform").withColumn("id", F.col("id").cast("long"))
    scored = score_eval(cases, _results(t))
    write_eval(summarize_eval_rollup(scored), scored, f"{root}/out")
    back = t.spark.read.schema(scored.schema).json(f"{root}/out/scores")
    return back.groupBy("platform", "type").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


@query("latency_summary", f"""
    WITH latencies AS (SELECT event_type, floor(value * 100)::INTEGER AS latency_ms FROM events)
    SELECT * FROM (SELECT event_type, count(*) AS n FROM latencies GROUP BY 1)
    JOIN ({_percentiles_sql('latencies', 'event_type', 'latency_ms', 'p50', 'p95')}) USING (event_type)
""")
def latencies(t: Tables) -> DataFrame:
    measured = t.events.select("event_type", F.floor(F.col("value") * 100).cast("int").alias("latency_ms"))
    return latency_summary(measured, "event_type")


@query("eval_seq", f"""
    WITH {_SCORES_SQL},
    logged AS (SELECT id, string_agg(name, ',' ORDER BY pos) AS names, count(*) AS n FROM calls GROUP BY 1)
    SELECT o_orderkey AS id, coalesce(n, 0) >= CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 3 END AND regexp_matches(
        coalesce(names, ''), CASE o_orderstatus WHEN 'F' THEN 'A_F.*R_O' WHEN 'O' THEN 'N_O' ELSE 'A_F.*N_F.*R_F' END) AS seq_ok
    FROM orders LEFT JOIN logged ON id = o_orderkey
""")
def sequences(t: Tables) -> DataFrame:
    _, status = _order_columns()
    wanted = lambda *names: F.array(*[F.lit(n) for n in names])
    cases = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(status == "F", wanted("A_F", "R_O")).when(status == "O", wanted("N_O"))
        .otherwise(wanted("A_F", "N_F", "R_F")).alias("expected_tools_sequence"),
        F.when(status == "F", 2).when(status == "O", 1).otherwise(3).alias("min_tool_calls"),
    )
    return sequence_ok(cases, _calls(t).select("id", "pos", "name"))


@query("missing_args", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS name, concat_ws(',',
           CASE WHEN l_returnflag IN ('A', 'N') AND l_quantity <= 5 THEN 'qty' END,
           CASE WHEN l_returnflag IN ('N', 'R') AND l_tax = 0 THEN 'tax' END,
           CASE WHEN l_returnflag = 'R' THEN 'reason' END) AS missing
    FROM lineitem
""")
def missing(t: Tables) -> DataFrame:
    signatures = t.spark.createDataFrame(
        [("A", ["qty"]), ("N", ["qty", "tax"]), ("R", ["tax", "reason"])], "name string, required array<string>"
    )
    quantity = F.when(F.col("l_quantity") <= 5, "").otherwise(F.col("l_quantity").cast("string"))
    tax = F.when(F.col("l_tax") != 0, F.col("l_tax").cast("string"))
    calls = t.spread("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("name"),
        F.create_map(F.lit("qty"), quantity, F.lit("tax"), tax).alias("args"),
    )
    return missing_args(calls, signatures).select(
        "l_orderkey", "l_linenumber", "l_partkey", "name", F.array_join("missing", ",").alias("missing")
    )


@query("registry_calls", """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'O' THEN 'similarity' ELSE 'chunk_text' END AS name,
           CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 'dist' WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'text'
                ELSE '' END AS missing
    FROM lineitem
""")
def registry_calls(t: Tables) -> DataFrame:
    """Line items as calls of two registered functions, checked against their own signatures."""
    name = F.when(F.col("l_linestatus") == "O", "similarity").otherwise("chunk_text")
    distance = F.when(F.col("l_returnflag") != "R", F.col("l_discount").cast("string"))
    words = F.when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag"))
    calls = t.spread("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", name.alias("name"),
        F.create_map(F.lit("dist"), distance, F.lit("text"), words).alias("args"),
    )
    return missing_args(calls, signature_rows(t.spark).select("name", "required")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "name", F.array_join("missing", ",").alias("missing")
    )
