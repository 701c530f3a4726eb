"""Turn history: recent, lookup, substring search, token index, rendering. `search` has the full-text search."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import decode_list, strip, words

TOOLS = "struct<name:string,args:map<string,string>,result:string>"
SOURCES = "struct<source:string,score:double>"


def recent(turns: DataFrame, n: int = 10, by: Sequence[str] = ("id",)) -> DataFrame:
    """Newest n turns."""
    return turns.orderBy(*[F.col(c).desc() for c in by]).limit(n)


def get_turn(turns: DataFrame, **key) -> DataFrame:
    """Point lookup; equality on the key columns reaches the Parquet row-group statistics."""
    for column, value in key.items():
        turns = turns.where(F.col(column) == value)
    return turns


def turn_count(turns: DataFrame) -> DataFrame:
    return turns.agg(F.count("*").alias("n"))


def query_history(df: DataFrame, n: int, id: str, start: str, status: str, duration: str) -> DataFrame:
    """Latest n queries: (query_id, status, duration_ms); a missing duration is 0."""
    return df.orderBy(F.col(start).desc(), F.col(id).desc()).limit(n).select(
        F.col(id).alias("query_id"), F.col(status).alias("status"), F.coalesce(F.col(duration), F.lit(0)).alias("duration_ms")
    )


def decode_turns(turns: DataFrame) -> DataFrame:
    """JSON text columns to arrays; unreadable or non-list text gives an empty array, a null latency 0."""
    rest = [c for c in turns.columns if c not in ("tools_json", "rag_sources_json", "latency_ms")]
    return turns.select(
        *rest,
        decode_list(F.col("tools_json"), TOOLS).alias("tools"),
        decode_list(F.col("rag_sources_json"), SOURCES).alias("rag_sources"),
        F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"),
    )


def search_like(turns: DataFrame, keyword: str, n: int = 20, by: Sequence[str] = ("id",)) -> DataFrame:
    """Newest n turns whose query or response contains the keyword as a case-insensitive LIKE pattern."""
    pattern = f"%{keyword}%"
    return recent(turns.where(F.col("query").ilike(pattern) | F.col("response").ilike(pattern)), n, by)


def build_index(turns: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Inverted index over query and response: one row (token, *keys) per distinct token of a turn."""
    both = F.array_distinct(words(F.concat_ws(" ", "query", "response")))
    return turns.select(F.explode(both).alias("token"), *keys)


def daily_entries(turns: DataFrame) -> DataFrame:
    """Markdown of each turn with its date; the first turn of a day carries the day's heading: (date, id, text).

    turns: id, ts (ISO text), platform, query, response, latency_ms. Entries stay rows, so a crowded day is
    never gathered in one task; write them sorted by (date, id).
    """
    dated = turns.withColumn("date", F.substring_index("ts", "T", 1))
    firsts = dated.groupBy("date").agg(F.min("id").alias("_first"))
    heading = F.when(
        F.col("id") == F.col("_first"), F.concat(F.lit("# Turn history — "), "date", F.lit("\n\n"))
    ).otherwise("")
    title = F.format_string(
        "## #%s · %s · %s · %sms\n\n", "id", "ts", F.coalesce("platform", F.lit("unknown")),
        F.coalesce("latency_ms", F.lit(0)),
    )
    # one row per calendar day
    return dated.join(F.broadcast(firsts), "date").select(
        "date", "id",
        F.concat(
            heading, F.lit("---\n\n"), title, F.lit("**Q:** "), strip(F.col("query")),
            F.lit("\n\n**A:**\n\n"), strip(F.coalesce("response", F.lit(""))), F.lit("\n\n"),
        ).alias("text"),
    )


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "args", "result")])))
def _logged_calls(tools_json: pd.Series) -> pd.Series:
    """The objects of a JSON list with their arguments on one line and their result indented; anything else is left out."""

    def decoded(text: str | None) -> list[dict]:
        try:
            found = json.loads(text) if text else None
        except ValueError:
            found = None
        objects = [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []
        return [{"name": str(x.get("name", "?")), "args": json.dumps(x.get("args", {})), "result": json.dumps(x.get("result", {}), indent=2)} for x in objects]

    return tools_json.map(decoded)


def tool_appendix(tools_json: Column | str) -> Column:
    """Markdown section of a JSON tool-call list, '' when there is none."""
    block = lambda call, i: F.format_string(
        "### %d. `%s`\n\n**Args:** `%s`\n\n**Result:**\n\n```json\n%s\n```\n", i + 1, call["name"], call["args"], call["result"])
    sections = F.transform(_logged_calls(tools_json), block)
    return F.when(F.size(sections) > 0, F.concat(F.lit("\n## Tool calls\n\n"), F.array_join(sections, "\n"))).otherwise("")


def _front_matter() -> Column:
    tools = decode_list(F.col("tools_json"), TOOLS)
    sources = decode_list(F.col("rag_sources_json"), SOURCES)
    names = F.array_join(F.transform(tools, lambda t: F.coalesce(t["name"], F.lit("?"))), ", ")
    listed = F.array_join(
        F.transform(sources, lambda s: F.format_string(
            "\n  - %s (score=%.2f)", F.replace(F.coalesce(s["source"], F.lit("")), F.lit("\\"), F.lit("/")),
            F.coalesce(s["score"], F.lit(0.0)),
        )), "",
    )
    query_lines = F.regexp_replace(F.regexp_replace("query", r"\R$", ""), r"\R", "\n  ")
    return F.concat(
        F.lit("---\ntimestamp: "), "ts", F.lit("\nplatform: "), F.coalesce("platform", F.lit("unknown")),
        F.lit("\nlatency_ms: "), F.coalesce("latency_ms", F.lit(0)).cast("string"), F.lit("\ntools: ["), names,
        F.when(F.size(sources) > 0, F.concat(F.lit("]\nrag_sources:"), listed)).otherwise("]\nrag_sources: []"),
        F.lit("\nquery: |\n  "), query_lines, F.lit("\n---"),
    )


def render_turns(turns: DataFrame) -> DataFrame:
    """One self-contained markdown document per turn: (id, markdown).

    turns: id, ts, platform, query, response, tools_json, rag_sources_json, latency_ms.
    """
    return turns.select(
        "id",
        F.concat(
            _front_matter(), F.lit("\n\n# Query\n\n"), strip(F.col("query")), F.lit("\n\n# Response\n\n"),
            strip(F.coalesce("response", F.lit(""))), F.lit("\n"), tool_appendix("tools_json"),
        ).alias("markdown"),
    )

