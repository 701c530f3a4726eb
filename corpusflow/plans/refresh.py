"""Refresh: detect changed sources, ingest the platforms they belong to, record what was ingested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.refresh import detect_changes, new_versions, page_source_markers
from corpusflow.operators.urls import url_fingerprint
from corpusflow.plans.corpus import chunk_rows
from corpusflow.session import cut_lineage
from corpusflow.sources.partitions import replace_partitions
from corpusflow.sources.versions import load_versions, save_versions


def with_markers(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Sources whose latest marker is that of their URL set where ``pages`` (source, url) has URLs of them."""
    markers = page_source_markers(url_fingerprint(pages), sources.select("id", "latest").join(
        pages.select(F.col("source").alias("id")).distinct(), "id", "left_anti"))
    return sources.drop("latest").join(markers, "id", "left").select(*sources.columns)


def refresh(
    spark: SparkSession, sources: DataFrame, docs: DataFrame, root: str, now: str,
    force: bool = False, include_web: bool = True, pages: DataFrame | None = None, **chunk_options,
) -> DataFrame:
    """Status per source, after the chunks below `root` were brought up to date.

    sources: see detect_changes, plus files. docs: platform, path, text - what is there now. pages: source and url of
    web sources, whose URL sets are their markers. All platforms with a fetched source are ingested whole in one
    write, which replaces the partitions of these platforms in `root/chunks`; a platform without documents keeps its
    chunks. Versions are saved last, so that a run that fails before is repeated.
    """
    versions = f"{root}/versions"
    if pages is not None:
        sources = with_markers(sources, pages)
    status = cut_lineage(
        detect_changes(sources, load_versions(spark, versions), now, force=force, include_web=include_web)
    )
    touched = status.where(F.col("status") == "fetched").select("platform").distinct()
    replace_partitions(chunk_rows(docs.join(touched, "platform", "left_semi"), **chunk_options), f"{root}/chunks", ["platform"])
    save_versions(new_versions(status, sources, now), versions)
    return status
