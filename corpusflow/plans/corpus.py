"""Corpus pipeline: pages or files to a chunked, embedded, current collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.chunking import explode_chunks
from corpusflow.functions.embedding import embed
from corpusflow.functions.fixed_values import MIN_SUCCESS_RATIO
from corpusflow.operators.refresh import is_platform_skipped, publish_gate
from corpusflow.operators.urls import cap_pages, fetched_pages, filter_urls, page_docs
from corpusflow.sources.collections import BUCKETS, read_collection, stale, write_collection
from corpusflow.sources.partitions import replace_partitions
from corpusflow.session import cut_lineage


def web_documents(pages: DataFrame, rules: DataFrame, base: str = "", max_pages: int = 0) -> DataFrame:
    """Pages (source, url, html) their source's rules allow, as documents (source, url, name, text)."""
    urls = cap_pages(filter_urls(pages.select("source", "url"), rules), max_pages)
    return page_docs(fetched_pages(pages.join(urls, ["source", "url"], "left_semi")), base)


def publish_pages(
    pages: DataFrame, rules: DataFrame, root: str, base: str = "", max_pages: int = 0, min_ratio: float = MIN_SUCCESS_RATIO,
) -> dict:
    """Extract, filter and publish pages; each source is judged by its own share of good pages.

    Attempted are a source's distinct allowed URLs (at most `max_pages`), written are those of them that became
    documents, one per URL. The partitions of sources that reach `min_ratio` are replaced; those of the rest stay,
    unread.
    """
    urls = cap_pages(filter_urls(pages.select("source", "url"), rules), max_pages).withColumn("attempted", F.lit(True))
    docs = cut_lineage(web_documents(pages, rules, base, max_pages).dropDuplicates(["source", "url"]))
    outcome = urls.join(docs.select("source", "url", F.lit(True).alias("kept")), ["source", "url"], "left")
    gates = cut_lineage(publish_gate(outcome, F.coalesce("kept", F.lit(False)), min_ratio).where("attempted > 0"))
    passed = gates.where("publish and written > 0").select("source")
    counts = gates.agg(F.sum("attempted"), F.sum("written"), F.count_if((F.col("written") > 0) & F.col("publish"))).first()
    attempted, written, switched = (x or 0 for x in counts)
    if switched:
        replace_partitions(docs.join(passed, "source", "left_semi"), root, ["source"])
    return {"written": written, "attempted": attempted, "ratio": written / attempted if attempted else 0.0, "published": switched > 0, "switched": switched}


def chunk_rows(docs: DataFrame, platform: str | None = None, dims: int = 64, load_encoder=None) -> DataFrame:
    """Collection rows (id, content, embedding, source, platform, chunk_index) of documents (path, text)."""
    if platform is not None:
        docs = docs.withColumn("platform", F.lit(platform))
    return explode_chunks(docs.select("path", "platform", "text"), "path", "text").select(
        "id", "content", embed(F.col("content"), dims, load_encoder).alias("embedding"),
        F.col("path").alias("source"), "platform", "chunk_index",
    )


def ingest(
    spark: SparkSession, docs: DataFrame, platform: str, root: str, force: bool = False, buckets: int = BUCKETS, **options
) -> dict:
    """Bring a platform's collection up to date with its documents (path, text), all of them.

    An existing collection is left alone unless forced, and a platform without files is never touched.
    """
    before = read_collection(spark, root)
    if is_platform_skipped(before is not None, force, has_files=not docs.isEmpty()):
        return {"ingested": 0, "pruned": 0}
    # The documents are the platform's whole corpus, so writing the next version in one go leaves what an
    # upsert of all chunks and a prune of the rest would leave.
    write_collection(chunk_rows(docs, platform, **options), root, buckets=buckets)
    now = read_collection(spark, root)
    pruned = 0 if before is None else stale(before.select("id"), now).count()
    return {"ingested": now.count(), "pruned": pruned}
