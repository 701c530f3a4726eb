"""Version store: what was last ingested per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.sources.collections import read_collection, upsert_collection

VERSION_SCHEMA = "id string, sha string, last_checked string, last_ingested string, files array<string>"


def load_versions(spark: SparkSession, root: str) -> DataFrame:
    """Stored version records; a missing or unreadable store counts as empty."""
    try:
        stored = read_collection(spark, root)
    except Exception:  # the contract: a store that cannot be read means nothing was ingested yet
        stored = None
    return spark.createDataFrame([], VERSION_SCHEMA) if stored is None else stored


def save_versions(records: DataFrame, root: str) -> None:
    """Insert or replace version records."""
    upsert_collection(records.select("id", "sha", "last_checked", "last_ingested", "files"), root, buckets=8)
