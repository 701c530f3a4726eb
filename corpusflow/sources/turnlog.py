"""Turn log: append with ids, and the markdown sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.history import daily_entries, render_turns
from corpusflow.operators.windows import dense_ids


def encode_turns(results: DataFrame) -> DataFrame:
    """Turn rows of results: missing fields get their defaults, nested lists become JSON text.

    results: ts, query, platform, response, tool_calls_made, rag_sources, latency_ms and any order columns.
    """
    nested = {"tools_json": "tool_calls_made", "rag_sources_json": "rag_sources"}
    return results.withColumns({
        "platform": F.coalesce("platform", F.lit("unknown")),
        "response": F.coalesce("response", F.lit("")),
        "latency_ms": F.coalesce("latency_ms", F.lit(0)).cast("int"),
        **{text: F.coalesce(F.to_json(F.col(column)), F.lit("[]")) for text, column in nested.items()},
    }).drop(*nested.values())


def append_turns(results: DataFrame, order: Sequence[str], last_id: int = 0) -> DataFrame:
    """Encoded turns with ids last_id+1, last_id+2, ... in the given total order."""
    return dense_ids(encode_turns(results), order, last_id)


def last_turn_id(turns: DataFrame) -> int:
    return turns.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0]


def append_to_log(spark: SparkSession, results: DataFrame, order: Sequence[str], path: str) -> None:
    """Append to a Parquet turn log. One writer at a time, as ids continue from the largest."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = last_turn_id(spark.read.parquet(path)) if fs.exists(fs_path) else 0
    append_turns(results, order, last).write.mode("append").parquet(path)


def write_index(index: DataFrame, path: str, keys: Sequence[str] = ("id",)) -> None:
    """Store an inverted index in token order, so that the tokens of a search prune files and row groups.

    The turn keys take part in the range split: the postings of a common token fill many files.
    """
    index.repartitionByRange("token", *keys).sortWithinPartitions("token").write.parquet(path)


def write_daily_markdown(turns: DataFrame, path: str) -> None:
    """Day folders of markdown text in id order; the parts of a crowded day follow each other by part number."""
    ordered = daily_entries(turns).repartitionByRange("date", "id").sortWithinPartitions("date", "id")
    # the writer ends every row with a newline, so the entry's own last one is left out
    entry = F.left("text", F.length("text") - 1).alias("text")
    ordered.select("date", entry).write.partitionBy("date").text(path)


def write_turn_markdown(turns: DataFrame, path: str) -> None:
    """Rendered turns as (id, markdown) rows."""
    render_turns(turns).write.parquet(path)
