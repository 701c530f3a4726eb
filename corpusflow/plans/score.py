"""Evaluation: labelled cases and logged results to scores and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusflow.operators.evaluation import first_calls, score_eval, summarize_eval
from corpusflow.operators.routing import route


def evaluate(cases: DataFrame, results: DataFrame, calls: DataFrame, dictionary=None) -> tuple[DataFrame, DataFrame]:
    """(scores, summaries). cases: see score_eval, plus query; results: id, platform, response, latency_ms;
    calls: id, pos, name, args - one row per logged tool call."""
    routed = route(cases.select("id", "query"), "query", dictionary).select("id", "label")
    actual = (
        results.join(first_calls(calls), "id", "left")
        .join(routed.withColumnRenamed("label", "routed"), "id", "left")
    )
    scores = score_eval(cases, actual)
    return scores, summarize_eval(scores)
