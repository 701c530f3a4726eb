"""Scoring of logged answers against a labelled query set."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import first_present, icontains
from corpusflow.operators.windows import rank_values

RATES = {
    "tool_ok": "tool_selection_accuracy",
    "req_ok": "required_arg_hit_rate",
    "val_ok": "arg_value_hit_rate",
    "rag_ok": "rag_keyword_hit_rate",
    "route_ok": "routing_accuracy",
}


def first_calls(calls: DataFrame, id: str = "id", order: Sequence[str] = ("pos",)) -> DataFrame:
    """First tool call and number of calls per case, from one row per call: (id, first_tool, first_args, n_calls)."""
    first = F.min_by(F.struct("name", "args"), F.struct(*order))
    return calls.groupBy(id).agg(first.alias("_first"), F.count("*").alias("n_calls")).select(
        id, F.col("_first.name").alias("first_tool"), F.col("_first.args").alias("first_args"), "n_calls"
    )


def score_eval(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected cases joined to results by id, with one boolean per rule.

    expected: id, type, expected_tool, required_args array, expected_arg_values map, expected_rag_keyword.
    actual: id, first_tool, first_args map, n_calls, response, platform, routed, latency_ms.
    Only the first call counts; a case without expected tool wants no call at all. Argument values compare
    as text, an absent one as 'None'. The keyword rule applies to rag_only cases. The row mark leaves
    routing out.
    """
    both = expected.join(actual, "id", "left").withColumn(
        "first_args", F.coalesce("first_args", F.create_map().cast("map<string,string>"))
    )
    calls = F.coalesce("n_calls", F.lit(0))
    tool_ok = F.when(F.col("expected_tool").isNull(), calls == 0).otherwise(
        F.coalesce(F.col("first_tool") == F.col("expected_tool"), F.lit(False))
    )
    req_ok = F.forall(
        F.coalesce("required_args", F.array().cast("array<string>")), lambda k: F.map_contains_key("first_args", k)
    )
    wanted = F.map_entries(F.coalesce("expected_arg_values", F.create_map().cast("map<string,string>")))
    val_ok = F.forall(
        wanted,
        lambda e: F.coalesce(F.element_at("first_args", e["key"]), F.lit("None")) == F.coalesce(e["value"], F.lit("None")),
    )
    keyword, said = F.coalesce("expected_rag_keyword", F.lit("")), F.coalesce("response", F.lit(""))
    rag_ok = (F.col("type") != "rag_only") | icontains(said, keyword)
    marks = dict(
        tool_ok=tool_ok, req_ok=req_ok, val_ok=val_ok, rag_ok=rag_ok,
        route_ok=F.coalesce(F.col("routed") == F.col("platform"), F.lit(False)),
    )
    scored = both.select(
        "id", "type", "platform", *[c.alias(n) for n, c in marks.items()],
        F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"),
    )
    return scored.withColumn("ok", F.expr("tool_ok and req_ok and val_ok and rag_ok"))


def _rate(hits: Column, n: Column) -> Column:
    return F.bround(F.lit(100.0) * hits / n, 1)


def _picked(df: DataFrame, key: str, latency: str, sums: dict[str, Column]) -> tuple[DataFrame, list[Column]]:
    n = F.col("n")
    ranked = rank_values(df, key, latency, {
        "_low": F.floor((n - 1) / 2) + 1,
        "_high": F.floor(n / 2) + 1,
        "_p95": F.floor(F.lit(0.95) * (n - 1)) + 1,
    }, sums)
    return ranked, [((F.col("_low") + F.col("_high")) / 2).cast("int"), F.col("_p95").cast("int")]


def latency_summary(df: DataFrame, key: str, latency: str = "latency_ms") -> DataFrame:
    """n, truncated median and floor-index 95th percentile of an integer latency per group."""
    ranked, (p50, p95) = _picked(df, key, latency, {})
    return ranked.select(key, "n", p50.alias("p50"), p95.alias("p95"))


def summarize_eval(scores: DataFrame) -> DataFrame:
    """Per platform: n, five hit rates (half-even, one decimal) and latency percentiles, in one pass over the scores."""
    hits = {mark: F.col(mark).cast("int") for mark in RATES}
    ranked, (p50, p95) = _picked(scores, "platform", "latency_ms", hits)
    return ranked.select(
        "platform", "n", *[_rate(F.col(mark), F.col("n")).alias(name) for mark, name in RATES.items()],
        p50.alias("p50_latency_ms"), p95.alias("p95_latency_ms"),
    )


def summarize_eval_rollup(scores: DataFrame) -> DataFrame:
    """Hit rates per platform and, with platform 'ALL', over everything."""
    return (
        scores.rollup("platform").agg(F.grouping("platform").alias("_g"), F.count("*").alias("n"), *[
            _rate(F.sum(F.col(mark).cast("int")), F.count("*")).alias(name) for mark, name in RATES.items()
        ])
        .withColumn("platform", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("platform"))).drop("_g")
    )


def _advances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every (case, block) of a sorted partition the map "reached before -> reached after" of its calls."""
    case, where, standing, size, kind = None, {}, {}, 0, None
    done: list[tuple] = []

    def close() -> None:
        reached = [0] * size
        for place, starts in standing.items():
            for start in starts:
                reached[start] = place
        done.append((*case, reached))

    def written() -> pa.RecordBatch:
        columns = [pa.array(list(x), t) for x, t in zip(zip(*done), (kind, pa.int64(), pa.list_(pa.int32())))]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["id", "_block", "_reached"])

    for batch in batches:
        kind, wanted = batch.schema.field("id").type, batch.column("_want")
        rows = zip(batch.column("id").to_pylist(), batch.column("_block").to_pylist(), batch.column("name").to_pylist())
        for row, (case_id, block, name) in enumerate(rows):
            if case != (case_id, block):
                if case is not None:
                    close()
                want = wanted[row].as_py()
                case, where, size = (case_id, block), {}, len(want) + 1
                for place, tool in enumerate(want):
                    where.setdefault(tool, []).append(place)
                standing = {start: [start] for start in range(size)}
            for place in reversed(where[name]):  # from the end, so that a call moves each start by one place
                if place in standing:
                    standing.setdefault(place + 1, []).extend(standing.pop(place))
        if done:
            yield written()
    if case is not None:
        close()
        yield written()


def sequence_ok(cases: DataFrame, calls: DataFrame, block_calls: int = 4096) -> DataFrame:
    """Whether the expected tools occur in this order among a case's calls, and there are enough calls.

    cases: id, expected_tools_sequence array, min_tool_calls. calls: id, pos (an ordinal), name - one row per call. Calls
    that their case names are dealt out by case and block of positions, so one case with most of the calls is many
    tasks. Each block gives its map "reached before -> reached after", taking the earliest call that fits; the maps of a
    case are composed in the order of the blocks.
    """
    wanted = cases.select("id", F.col("expected_tools_sequence").alias("_want"))
    named = calls.join(wanted, "id").where(F.array_contains("_want", F.col("name"))).select(
        "id", F.floor(F.col("pos") / block_calls).alias("_block"), "pos", "name", "_want")
    kind = cases.schema["id"].dataType.simpleString()
    blocks = named.repartition("id", "_block").sortWithinPartitions("id", "_block", "pos")
    parts = blocks.mapInArrow(_advances, f"id {kind}, _block long, _reached array<int>")
    # one map per block of calls
    maps = F.array_sort(F.collect_list(F.struct("_block", "_reached")))
    walked = parts.groupBy("id").agg(F.aggregate(maps, F.lit(0), lambda at, m: F.get(m["_reached"], at)).alias("_reached"))
    totals = calls.groupBy("id").agg(F.count("*").alias("_calls"))
    complete = F.coalesce("_reached", F.lit(0)) == F.size("expected_tools_sequence")
    return (
        cases.join(walked, "id", "left").join(totals, "id", "left")
        .select("id", (complete & (F.coalesce("_calls", F.lit(0)) >= F.col("min_tool_calls"))).alias("seq_ok"))
    )


def missing_args(calls: DataFrame, signatures: DataFrame) -> DataFrame:
    """Required argument names that a call leaves null or empty, by tool name: adds `missing` and `known`.

    A call of a tool without a signature stays: `known` is false and `missing` null.
    """
    known = signatures.withColumn("known", F.lit(True))
    return calls.join(known, "name", "left").withColumns({
        "missing": F.filter("required", lambda n: first_present(F.element_at("args", n)) == ""),
        "known": F.coalesce("known", F.lit(False)),
    }).drop("required")
