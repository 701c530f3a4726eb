"""SQL surface: the functions that Spark lacks, registered by name, and their call signatures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.chunking import CHUNK_TYPE, chunk_spans
from corpusflow.functions.fixed_values import CHUNK_OVERLAP, CHUNK_SIZE
from corpusflow.functions.html import extract_article, html_strip

# name -> JSON-Schema signature, with the required arguments and defaults
SIGNATURES = {
    "html_strip": {"properties": {"html": {"type": "string"}}, "required": ["html"]},
    "extract_article": {"properties": {"html": {"type": "string"}}, "required": ["html"]},
    "chunk_text": {
        "properties": {
            "text": {"type": "string"},
            "size": {"type": "integer", "default": CHUNK_SIZE},
            "overlap": {"type": "integer", "default": CHUNK_OVERLAP},
        },
        "required": ["text"],
    },
    "similarity": {
        "properties": {"dist": {"type": "number"}, "space": {"type": "string", "default": "l2"}},
        "required": ["dist"],
    },
}


def _chunk_array():
    @F.pandas_udf(CHUNK_TYPE)
    def split(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"content": t[a:b], "start": a} for a, b in chunk_spans(t)], na_action="ignore")

    return split


class _Chunks:
    def eval(self, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
        for i, (lo, hi) in enumerate(chunk_spans(text or "", size, overlap)):
            yield i, text[lo:hi], lo


def register(spark: SparkSession) -> None:
    """SQL functions html_strip, extract_article, chunk_array, similarity and the table function chunk_text."""
    spark.udf.register("html_strip", html_strip)
    spark.udf.register("extract_article", extract_article)
    spark.udf.register("chunk_array", _chunk_array())
    spark.udtf.register("chunk_text", F.udtf(_Chunks, returnType="chunk_index int, content string, start int"))
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION similarity(dist DOUBLE, space STRING DEFAULT 'l2') RETURNS DOUBLE
        RETURN greatest(0.0D, least(1.0D, CASE space WHEN 'cosine' THEN 1 - dist WHEN 'ip' THEN -dist ELSE 1 - dist / 2 END))
    """)


def signature_rows(spark: SparkSession):
    """The registry as a table (name, required, defaults) to check calls against."""
    return spark.createDataFrame(
        [
            (name, s["required"], {k: str(p["default"]) for k, p in s["properties"].items() if "default" in p})
            for name, s in SIGNATURES.items()
        ],
        "name string, required array<string>, defaults map<string,string>",
    )
