"""Change detection and refresh planning for document sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.fixed_values import MAX_AGE_DAYS, MIN_SUCCESS_RATIO, SOURCE_TYPES, WEB_TYPE
from corpusflow.functions.text import iso_timestamp, seconds_between


def is_stale(last_ingested: Column, now: Column, max_age_days: float = MAX_AGE_DAYS) -> Column:
    """True without a readable time, or from max_age_days on; naive times are UTC. All ISO-8601 text."""
    age = seconds_between(iso_timestamp(last_ingested), iso_timestamp(now)) / F.lit(86400.0)
    return F.coalesce(age >= max_age_days, F.lit(True))


def is_due(last_check: Column, now: Column, interval_hours: Column | float = 0) -> Column:
    """True unless a readable last check lies less than interval_hours back; 0 is always due."""
    hours = F.lit(interval_hours) if isinstance(interval_hours, (int, float)) else interval_hours
    waited = seconds_between(iso_timestamp(last_check), iso_timestamp(now))
    return F.coalesce((hours <= 0) | (waited >= hours * 3600), F.lit(True))


def detect_changes(
    sources: DataFrame,
    versions: DataFrame,
    now: str,
    *,
    force: bool = False,
    check_only: bool = False,
    include_web: bool = True,
) -> DataFrame:
    """Status per source: (id, platform, status, stored_sha, latest_sha, last_ingested, files_written).

    sources: id, platform, type, latest (marker, null = could not be read), written (files a fetch yields).
    versions: id, sha, last_ingested (ISO text). Hashes are cut to ten characters.
    """
    known = sources.join(versions.select("id", "sha", "last_ingested"), "id", "left")
    web = F.col("type") == WEB_TYPE
    stored = F.coalesce("sha", F.lit(""))
    changed = (F.col("latest") != stored) | (web & is_stale(F.col("last_ingested"), F.lit(now)))
    status = F.when(F.lit(not include_web) & web, "skipped_web").when(F.col("latest").isNull(), "network_error")
    if check_only:
        status = status.when(changed, "changed").otherwise("up_to_date")
    else:
        status = (
            status.when(~changed & F.lit(not force), "up_to_date")
            .when(~F.col("type").isin(*SOURCE_TYPES), "unknown_type")
            .when(F.coalesce("written", F.lit(0)) == 0, "fetch_failed")
            .otherwise("fetched")
        )
    return known.select(
        "id", "platform", status.alias("status"),
        F.coalesce(F.nullif(F.left(stored, F.lit(10)), F.lit("")), F.lit("none")).alias("stored_sha"),
        F.left("latest", F.lit(10)).alias("latest_sha"),
        F.coalesce("last_ingested", F.lit("never")).alias("last_ingested"),
        F.when(status == "fetched", F.col("written")).alias("files_written"),
    )


def platform_rollup(status: DataFrame) -> DataFrame:
    """Per platform: sources checked, whether it needs ingesting, whether any source failed."""
    return status.groupBy("platform").agg(
        F.count("*").alias("checked"),
        F.bool_or(F.col("status") == "fetched").alias("needs_ingest"),
        F.bool_or(F.col("status").isin("network_error", "fetch_failed")).alias("failed"),
    )


def refresh_rollup(status: DataFrame) -> DataFrame:
    """One row: sources checked, platforms changed, platforms with errors."""
    return platform_rollup(status).agg(
        F.coalesce(F.sum("checked"), F.lit(0)).alias("checked"),
        F.count_if("needs_ingest").alias("changed"),
        F.count_if("failed").alias("errors"),
    )


def reingest(sources: DataFrame, status: DataFrame) -> DataFrame:
    """All sources of every platform with a fetched source."""
    touched = status.where(F.col("status") == "fetched").select("platform").distinct()
    return sources.join(touched, "platform", "left_semi")


def publish_gate(pages: DataFrame, kept: Column, min_ratio: float = MIN_SUCCESS_RATIO) -> DataFrame:
    """Per source: attempted and kept pages, their ratio, and whether it may be published."""
    counts = pages.groupBy("source").agg(F.count("*").alias("attempted"), F.count_if(kept).alias("written"))
    ratio = F.when(F.col("attempted") > 0, F.col("written") / F.col("attempted")).otherwise(0.0)
    return counts.withColumn("ratio", ratio).withColumn("publish", F.col("ratio") >= min_ratio)


def new_versions(status: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    """Version records of the fetched sources: (id, sha, last_checked, last_ingested, files)."""
    fetched = status.where(F.col("status") == "fetched").select("id")
    return sources.join(fetched, "id", "left_semi").select(
        "id", F.col("latest").alias("sha"), F.lit(now).alias("last_checked"), F.lit(now).alias("last_ingested"), "files"
    )


def page_source_markers(fingerprints: DataFrame, supplied: DataFrame) -> DataFrame:
    """Latest marker per source: URL-set fingerprints of web sources next to supplied commit hashes."""
    return fingerprints.select(F.col("source").alias("id"), F.col("sha").alias("latest")).unionByName(
        supplied.select("id", "latest")
    )


def ingest_report(chunks: DataFrame, path: str = "path") -> DataFrame:
    """Chunks per file, and in total with path null: (path, n)."""
    return chunks.rollup(path).agg(F.count("*").alias("n"))


def is_platform_skipped(exists: bool, force: bool, has_files: bool) -> bool:
    """A present collection is left alone unless forced; a platform without files is never touched, nor pruned."""
    return not has_files or (exists and not force)

