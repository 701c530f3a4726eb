"""Refresh queries. Documents stand for doc sources; labels and events supply what was ingested before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.fixed_values import WEB_TYPE
from corpusflow.functions.text import iso_seconds
from corpusflow.operators.refresh import detect_changes, is_due, is_stale, new_versions, refresh_rollup, reingest
from corpusflow.operators.urls import fetched_pages, long_enough, url_fingerprint
from corpusflow.plans.refresh import refresh, with_markers
from corpusflow.plans.workloads.base import Tables, query
from corpusflow.plans.workloads.web import ARTICLE_SQL, DOMAIN_SQL, with_source
from corpusflow.session import scratch_path
from corpusflow.sources.versions import load_versions, save_versions

NOW = "2024-01-09T12:00:00+00:00"

_TYPE = """
    CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'github_dir'
         WHEN source IN ('src5', 'src6', 'src7', 'src8', 'src9') THEN 'github_file'
         WHEN source IN ('src10', 'src11', 'src12', 'src13') THEN 'botocore_svc'
         WHEN source IN ('src14', 'src15', 'src16', 'src17') THEN 'web_sitemap'
         ELSE 'ftp_mirror' END
"""


def _sources(t: Tables) -> DataFrame:
    lines = F.size(F.split("text", "\n")) - 1
    return t.spread("documents").select(
        F.concat(F.lit("doc/"), "doc_id").alias("id"),
        F.concat_ws("/", "source", "lang").alias("platform"),
        F.expr(_TYPE).alias("type"),
        F.when(F.col("n_chars") >= 300, F.sha2("text", 256)).alias("latest"),
        lines.alias("written"),
        F.array(F.concat("source", F.lit("/"), "doc_id")).alias("files"),
    )


def _clock() -> Column:
    return iso_seconds(F.col("ts"))


def _versions(t: Tables) -> DataFrame:
    """A version per labelled document: good ones unchanged, the time from the event of the same number."""
    read = F.when(F.col("toxic") == 1, "unreadable").when(F.col("event_type") == "view", None).when(
        F.col("event_type") == "click", _clock()
    ).otherwise(F.concat(_clock(), F.lit("+00:00")))
    known = t.labels.join(t.documents, "doc_id").join(t.events, F.col("doc_id") == F.col("event_id"), "left")
    return known.select(
        F.concat(F.lit("doc/"), "doc_id").alias("id"),
        F.when(F.col("quality") == 1, F.sha2("text", 256)).otherwise(F.sha2("lang", 256)).alias("sha"),
        read.alias("last_ingested"),
    )


def _status_sql(web: bool = True, check_only: bool = False) -> str:
    later = (
        "WHEN changed THEN 'changed' ELSE 'up_to_date'" if check_only else
        "WHEN NOT changed THEN 'up_to_date' WHEN type = 'ftp_mirror' THEN 'unknown_type' "
        "WHEN written = 0 THEN 'fetch_failed' ELSE 'fetched'"
    )
    first = "" if web else "WHEN type = 'web_sitemap' THEN 'skipped_web'"
    return f"""
        versions AS (
            SELECT doc_id, CASE WHEN quality = 1 THEN sha256(text) ELSE sha256(lang) END AS sha,
                   CASE WHEN toxic = 1 THEN 'unreadable' WHEN event_type = 'view' THEN NULL
                        WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                        ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS last_ingested
            FROM labels JOIN documents USING (doc_id) LEFT JOIN events ON event_id = doc_id
        ),
        known AS (
            SELECT doc_id, source || '/' || lang AS platform, {_TYPE} AS type, coalesce(sha, '') AS stored,
                   CASE WHEN n_chars >= 300 THEN sha256(text) END AS latest, last_ingested,
                   length(text) - length(replace(text, chr(10), '')) AS written
            FROM documents LEFT JOIN versions USING (doc_id)
        ),
        judged AS (
            SELECT *, latest <> stored OR (type = 'web_sitemap' AND coalesce(
                TIMESTAMP '2024-01-09 12:00:00' - INTERVAL 7 DAY >= try_cast(left(last_ingested, 19) AS TIMESTAMP), true)) AS changed
            FROM known
        ),
        status AS (
            SELECT 'doc/' || doc_id AS id, platform, CASE {first} WHEN latest IS NULL THEN 'network_error' {later} END AS status,
                   coalesce(nullif(left(stored, 10), ''), 'none') AS stored_sha, left(latest, 10) AS latest_sha,
                   coalesce(last_ingested, 'never') AS last_ingested, written
            FROM judged
        )
    """


@query("refresh_status", f"""
    WITH {_status_sql()}
    SELECT id, platform, status, stored_sha, latest_sha, last_ingested,
           CASE WHEN status = 'fetched' THEN written END::INTEGER AS files_written FROM status
""")
def refresh_status(t: Tables) -> DataFrame:
    return detect_changes(_sources(t), _versions(t), NOW)


@query("refresh_check", f"WITH {_status_sql(check_only=True)} SELECT id, status, stored_sha, last_ingested FROM status")
def refresh_check(t: Tables) -> DataFrame:
    return detect_changes(_sources(t), _versions(t), NOW, check_only=True).select("id", "status", "stored_sha", "last_ingested")


@query("refresh_rollup", f"""
    WITH {_status_sql(web=False)},
    platforms AS (
        SELECT platform, count(*) AS n, bool_or(status = 'fetched') AS f, bool_or(status IN ('network_error', 'fetch_failed')) AS e
        FROM status GROUP BY 1
    )
    SELECT sum(n)::BIGINT AS checked, count(*) FILTER (f) AS changed, count(*) FILTER (e) AS errors FROM platforms
""")
def rollup(t: Tables) -> DataFrame:
    return refresh_rollup(detect_changes(_sources(t), _versions(t), NOW, include_web=False))


@query("reingest_plan", f"""
    WITH {_status_sql(web=False)}
    SELECT id, platform FROM status WHERE platform IN (SELECT platform FROM status WHERE status = 'fetched')
""")
def reingest_plan(t: Tables) -> DataFrame:
    sources = _sources(t)
    return reingest(sources, detect_changes(sources, _versions(t), NOW, include_web=False)).select("id", "platform")


@query("version_store", f"""
    WITH {_status_sql()}
    SELECT id, coalesce(s.sha, v.sha) AS sha, CASE WHEN s.sha IS NULL THEN v.last_ingested ELSE '{NOW}' END AS last_ingested
    FROM (SELECT 'doc/' || doc_id AS id, sha, last_ingested FROM versions) v
    FULL JOIN (SELECT id, sha256(text) AS sha FROM status JOIN documents ON id = 'doc/' || doc_id WHERE status = 'fetched') s USING (id)
""")
def version_store(t: Tables) -> DataFrame:
    """Store the former versions, add those of the fetched sources, and read the store back."""
    root = scratch_path(t.spark, "versions")
    unchecked = {"last_checked": F.lit(None).cast("string"), "files": F.lit(None).cast("array<string>")}
    save_versions(_versions(t).withColumns(unchecked), root)
    sources = _sources(t)
    save_versions(new_versions(detect_changes(sources, load_versions(t.spark, root), NOW), sources, NOW), root)
    return load_versions(t.spark, root).select("id", "sha", "last_ingested")


@query("staleness", """
    SELECT event_id, CASE event_type WHEN 'view' THEN true WHEN 'error' THEN true
        WHEN 'purchase' THEN date_trunc('second', ts) - INTERVAL 2 HOUR <= TIMESTAMP '2024-01-08'
        ELSE date_trunc('second', ts) <= TIMESTAMP '2024-01-08' END AS stale
    FROM events
""")
def staleness(t: Tables) -> DataFrame:
    """Event times as ISO text in several spellings: missing, unreadable, with an offset, with Z, naive."""
    text = (
        F.when(F.col("event_type") == "view", None)
        .when(F.col("event_type") == "error", F.concat(F.lit("on "), _clock()))
        .when(F.col("event_type") == "purchase", F.concat(_clock(), F.lit("+02:00")))
        .when(F.col("event_type") == "signup", F.concat(_clock(), F.lit("Z")))
        .otherwise(_clock())
    )
    return t.events.select("event_id", is_stale(text, F.lit("2024-01-15T00:00:00+00:00")).alias("stale"))


@query("throttle", """
    SELECT user_id, event_type, event_type = 'view'
           OR date_trunc('second', max(ts)) <= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 HOUR * length(event_type) AS due
    FROM events GROUP BY 1, 2
""")
def throttle(t: Tables) -> DataFrame:
    """Every (user, event type) as a source whose check interval is the length of the type's name in hours."""
    last = t.events.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    hours = F.when(F.col("event_type") == "view", 0).otherwise(F.length("event_type"))
    return last.select(
        "user_id", "event_type", is_due(_clock(), F.lit("2024-01-30T00:00:00+00:00"), hours).alias("due")
    )


@query("refreshed_corpus", f"""
    WITH {_status_sql()},
    touched AS (SELECT DISTINCT lang FROM documents WHERE 'doc/' || doc_id IN (SELECT id FROM fresh WHERE status = 'fetched'))
    SELECT lang AS platform, count(*) AS n_docs, true AS second_run_is_quiet FROM documents WHERE lang IN (SELECT lang FROM touched) GROUP BY 1
""".replace("touched AS", """fresh AS (
        SELECT id, CASE WHEN latest_sha IS NULL THEN 'network_error' WHEN type = 'ftp_mirror' THEN 'unknown_type'
                        WHEN written = 0 THEN 'fetch_failed' ELSE 'fetched' END AS status
        FROM (SELECT 'doc/' || doc_id AS id, left(latest, 10) AS latest_sha, type, written FROM judged)
    ),
    touched AS"""))
def refreshed_corpus(t: Tables) -> DataFrame:
    """A first refresh of four language collections, then a second one that finds every fetched source unchanged."""
    root = scratch_path(t.spark, "refresh")
    sources = _sources(t).withColumn("platform", F.substring_index("platform", "/", -1))
    docs = t.spread("documents").select(F.col("lang").alias("platform"), F.concat_ws("/", "source", "doc_id").alias("path"), "text")
    first = refresh(t.spark, sources, docs, root, NOW)
    second = detect_changes(sources, load_versions(t.spark, f"{root}/versions"), NOW).select("id", F.col("status").alias("again"))
    quiet = (
        first.where("status = 'fetched'").join(second, "id").groupBy("platform")
        .agg(F.bool_and(F.col("again") == "up_to_date").alias("second_run_is_quiet"))
    )
    written = t.spark.read.parquet(f"{root}/chunks").groupBy("platform").agg(F.count_distinct("source").alias("n_docs"))
    return written.join(quiet, "platform")


_MARKER_SQL = "sha256(concat_ws(':', count(*), {}))".format(", ".join(
    f"CAST(sum(CAST('0x' || substr(sha256(url), {at}, 15) AS BIGINT)) AS VARCHAR)" for at in (1, 16, 31, 46)))


@query("url_markers", f"""
    WITH now AS (SELECT source, {_MARKER_SQL} AS sha FROM (SELECT DISTINCT {DOMAIN_SQL} AS source, url FROM pages) GROUP BY 1),
    before AS (
        SELECT source, {_MARKER_SQL} AS sha FROM (SELECT DISTINCT {DOMAIN_SQL} AS source, url FROM pages WHERE length({ARTICLE_SQL}) >= 200) GROUP BY 1
    )
    SELECT source AS id, CASE WHEN now.sha IS DISTINCT FROM before.sha THEN 'fetched' ELSE 'up_to_date' END AS status,
           coalesce(left(before.sha, 10), 'none') AS stored_sha, left(now.sha, 10) AS latest_sha
    FROM now LEFT JOIN before USING (source)
""")
def url_markers(t: Tables) -> DataFrame:
    """Web sources whose marker is their URL set; the stored one knew only the pages that are long enough."""
    pages = with_source(t.spread("pages"))
    none = F.lit(None).cast("string")
    sources = pages.groupBy(F.col("source").alias("id")).agg(F.count("*").cast("int").alias("written")).select(
        "id", F.col("id").alias("platform"), F.lit(WEB_TYPE).alias("type"), none.alias("latest"), "written")
    before = url_fingerprint(long_enough(fetched_pages(pages)))
    versions = before.select(F.col("source").alias("id"), "sha", F.lit("2024-01-08T12:00:00+00:00").alias("last_ingested"))
    return detect_changes(with_markers(sources, pages), versions, NOW).select("id", "status", "stored_sha", "latest_sha")
