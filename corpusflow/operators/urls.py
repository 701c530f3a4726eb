"""Sitemap, URL and page operators that feed the web corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.fixed_values import MAX_LISTED_FILES, MIN_PAGE_CHARS
from corpusflow.functions.html import extract_article
from corpusflow.functions.text import url_filename
from corpusflow.operators.windows import cap_per_group


def sitemap_urls(df: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per <loc> of each sitemap text; entities stay encoded."""
    rest = [c for c in df.columns if c != xml]
    locs = F.regexp_extract_all(F.col(xml), F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)
    return df.select(*rest, F.explode(locs).alias("loc"))


def suffix(name: Column) -> Column:
    """Lower-cased suffix with its dot, '' when the last path part has none or starts with its only dot."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]+)$", 1))


def cap_listing(
    listing: DataFrame, extensions: Sequence[str], max_files: int = MAX_LISTED_FILES, order: str = "pos"
) -> DataFrame:
    """First max_files files per source in listing order; listing: source, name, type and the order column."""
    allowed = [e.lower() for e in extensions]
    files = listing.where((F.col("type") == "file") & suffix(F.col("name")).isin(allowed))
    return cap_per_group(files, ["source"], [F.col(order)], max_files)


def filter_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Keep URLs their source's rules allow.

    rules: source, robots, exclude, include (arrays, null = none). Rules match as case-sensitive substrings;
    include decides only when it is given. Sources without rules keep everything.
    """
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("robots", "exclude", "include")}
    joined = urls.join(rules, "source", "left").withColumns(lists)
    hit = lambda column: F.exists(column, lambda part: F.contains(F.col("url"), part))
    allowed = ~hit("robots") & ~hit("exclude") & ((F.size("include") == 0) | hit("include"))
    return joined.where(allowed).select(*urls.columns)


def cap_pages(urls: DataFrame, max_pages: int = 0) -> DataFrame:
    """Distinct (source, url), the first max_pages per source in URL order; 0 keeps all."""
    return cap_per_group(urls.select("source", "url").distinct(), ["source"], [F.col("url")], max_pages)


def url_fingerprint(urls: DataFrame) -> DataFrame:
    """Marker of each source's URL set: (source, sha, n), by one rule for sets of any size.

    The SHA-256 of every distinct URL is cut into four slices of 60 bits. The marker is the hash of the number of
    URLs and of the four sums of slices: sums combine before the shuffle, and no task holds a set.
    """
    slices = [
        F.sum(F.conv(F.substring("_sha", at, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"_s{at}") for at in (1, 16, 31, 46)]
    sums = (
        urls.select("source", "url").distinct().withColumn("_sha", F.sha2("url", 256))
        .groupBy("source").agg(F.count("*").alias("n"), *slices))
    whole = F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"_s{at}") for at in (1, 16, 31, 46)])
    return sums.select("source", F.sha2(whole, 256).alias("sha"), "n")


def fetched_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the markup by its article text."""
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, extract_article(F.col(html)).alias("text"))


def long_enough(df: DataFrame, text: str = "text", least: int = MIN_PAGE_CHARS) -> DataFrame:
    """Drop stubs: texts shorter than `least` characters."""
    return df.where(F.char_length(text) >= least)


def page_docs(pages: DataFrame, base: str = "", least: int = MIN_PAGE_CHARS) -> DataFrame:
    """Pages (url, text) to documents: file name, and the text below a `Source:` line."""
    return long_enough(pages, least=least).withColumns({
        "name": url_filename(F.col("url"), base),
        "text": F.concat(F.lit("Source: "), "url", F.lit("\n\n"), "text", F.lit("\n")),
    })


def name_collisions(urls: DataFrame, base: str = "") -> DataFrame:
    """File names that several distinct URLs map to: (name, n)."""
    return (
        urls.select("url").distinct().groupBy(url_filename(F.col("url"), base).alias("name"))
        .agg(F.count("*").alias("n")).where(F.col("n") > 1)
    )
