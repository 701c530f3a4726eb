"""Labelled query sets in, scores and summaries out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVAL_CASE = """
    id string, type string, query string, expected_tool string, required_args array<string>,
    expected_arg_values map<string,string>, expected_rag_keyword string, min_tool_calls int,
    expected_tools_sequence array<string>
"""


def read_eval(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Labelled cases from `<platform>_queries.json` files; argument values of any type are read as text.

    A hand-written file is one JSON array (multi_line); large sets come as one case per line.
    """
    cases = spark.read.schema(EVAL_CASE).option("multiLine", str(multi_line).lower()).json(path)
    platform = F.regexp_extract("_metadata.file_name", r"^(.*?)(?:_queries)?\.json$", 1)
    return cases.withColumn("platform", platform)


def write_eval(summaries: DataFrame, scores: DataFrame, path: str) -> None:
    """Summaries and per-case scores as JSON below `path`, scores partitioned by platform."""
    summaries.write.mode("overwrite").json(f"{path}/summaries")
    scores.write.mode("overwrite").partitionBy("platform").json(f"{path}/scores")
