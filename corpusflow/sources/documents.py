"""Document scans and document unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.fixed_values import DOC_SUFFIXES
from corpusflow.functions.html import html_strip
from corpusflow.operators.urls import suffix


def utf8_text(content: Column) -> Column:
    """Bytes to text, dropping invalid UTF-8 (and any replacement character already in the text)."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def doc_text(name: Column, raw: Column) -> Column:
    """HTML files are reduced to their text, all others pass unchanged."""
    return F.when(suffix(name) == ".html", html_strip(F.when(suffix(name) == ".html", raw))).otherwise(raw)


def scan_docs(spark: SparkSession, root: str, suffixes: Sequence[str] = DOC_SUFFIXES) -> DataFrame:
    """All files below `root` with one of the suffixes, in any letter case: (path, text).

    `path` is relative to root. File names are filtered while listing, before any content is read.
    """
    any_case = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    pattern = "*{" + ",".join(any_case(s) for s in suffixes) + "}"
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    )
    base = root.rstrip("/") + "/"
    wanted = files.where(suffix(F.col("path")).isin([s.lower() for s in suffixes]))
    relative = F.element_at(F.split("path", F.lit(_quoted(base)), 2), -1)
    return wanted.select(relative.alias("path"), doc_text(F.col("path"), utf8_text(F.col("content"))).alias("text"))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union by name; columns a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
