"""Chunking and collection queries over `documents`.

The former snapshot is the raw documents; the next one is the whitespace-normalised documents of at least 200
characters together with the benchmark texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.chunking import chunk_text, explode_chunks
from corpusflow.operators.refresh import ingest_report
from corpusflow.operators.urls import long_enough
from corpusflow.plans.corpus import ingest
from corpusflow.plans.workloads.base import Tables, query
from corpusflow.session import scratch_path
from corpusflow.sources.collections import (
    corpus_diff, prune, prune_collection, read_collection, stale, upsert, upsert_collection, write_collection,
)
from corpusflow.sources.documents import scan_docs, union_sources

_PATH = "concat(source, '/', doc_id, '.txt')"


def _docs(t: Tables) -> DataFrame:
    return t.spread("documents").select("doc_id", F.expr(_PATH).alias("path"), "text")


@query("chunk_stats", r"""
    SELECT count(*) FILTER (regexp_replace(text, '\s+', '', 'g') <> '') AS n_docs_with_chunks, 512::BIGINT AS size_limit,
           true AS all_le_limit, true AS none_empty, true AS overlap_le_64
    FROM documents
""")
def chunk_stats(t: Tables) -> DataFrame:
    chunks = F.col("chunks")
    n = F.size(chunks)
    end = lambda c: c["start"] + F.length(c["content"])
    seams = F.zip_with(F.slice(chunks, 1, n - 1), F.slice(chunks, 2, n - 1), lambda a, b: end(a) - b["start"])
    per_doc = _docs(t).select(chunk_text("text").alias("chunks")).where(F.size("chunks") > 0).select(
        F.forall(chunks, lambda c: F.length(c["content"]) <= 512).alias("short"),
        F.forall(chunks, lambda c: F.trim(c["content"]) != "").alias("full"),
        F.forall(seams, lambda s: s <= 64).alias("joined"),
    )
    return per_doc.agg(
        F.count("*").alias("n_docs_with_chunks"), F.lit(512).cast("long").alias("size_limit"),
        F.coalesce(F.bool_and("short"), F.lit(True)).alias("all_le_limit"),
        F.coalesce(F.bool_and("full"), F.lit(True)).alias("none_empty"),
        F.coalesce(F.bool_and("joined"), F.lit(True)).alias("overlap_le_64"),
    )


@query("chunk_roundtrip", r"SELECT doc_id, md5(regexp_replace(text, '[ \t\n\r]+', '', 'g')) AS hash FROM documents")
def chunk_roundtrip(t: Tables) -> DataFrame:
    """The chunks of each document, without their overlaps, put together again."""
    chunks = F.col("chunks")
    end = lambda c: c["start"] + F.length(c["content"])
    done = lambda i: F.when(i == 0, F.lit(0)).otherwise(end(F.get(chunks, i - 1)))
    fresh = F.transform(
        chunks, lambda c, i: F.substring(c["content"], F.greatest(done(i) - c["start"], F.lit(0)) + 1, F.lit(512))
    )
    whole = F.regexp_replace(F.array_join(fresh, ""), "[ \t\n\r]+", "")
    return _docs(t).select("doc_id", chunk_text("text").alias("chunks")).select("doc_id", F.md5(whole).alias("hash"))


#: Chunks at character boundaries: 512 characters, each next chunk 448 further, stripped, empty ones left out.
_WINDOWS_SQL = f"""
    windows AS (
        SELECT path, k, regexp_replace(substr(text, k * 448 + 1, 512), '^\\s+|\\s+$', '', 'g') AS content
        FROM (SELECT {_PATH} AS path, text, unnest(range(greatest(1, 1 + ceil((length(text) - 512) / 448.0)::BIGINT))) AS k FROM documents)
    ),
    chunks AS (SELECT path, content, (row_number() OVER (PARTITION BY path ORDER BY k) - 1)::INTEGER AS chunk_index FROM windows WHERE content <> '')
"""


def _character_chunks(t: Tables) -> DataFrame:
    """The chunker with its last separator only, where SQL can follow it."""
    return explode_chunks(_docs(t).select("path", "text"), "path", "text", separators=("",))


@query("chunk_ids", f"WITH {_WINDOWS_SQL} SELECT path || '::' || chunk_index AS id, chunk_index, md5(content) AS hash FROM chunks")
def chunk_ids(t: Tables) -> DataFrame:
    return _character_chunks(t).select("id", "chunk_index", F.md5("content").alias("hash"))


@query("ingest_report", f"WITH {_WINDOWS_SQL} SELECT path, count(*) AS n FROM chunks GROUP BY ROLLUP (path)")
def report(t: Tables) -> DataFrame:
    return ingest_report(_character_chunks(t))


@query("ingested_chunks", f"""
    SELECT {_PATH} AS path, md5(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g')) AS hash, true AS in_order FROM documents
""")
def ingested(t: Tables) -> DataFrame:
    """Chunk, embed and store the documents, read the collection back and put each document together again."""
    root = scratch_path(t.spark, "ingested")
    ingest(t.spark, _docs(t), "documents", root)
    stored = read_collection(t.spark, root)
    plain = explode_chunks(_docs(t), "path", "text").select("id", "path", "chunk_index", "start", "content")
    rows = plain.join(stored.select("id", F.col("content").alias("kept"), "embedding"), "id").where(
        (F.col("kept") == F.col("content")) & (F.size("embedding") == 64)
    )
    # the chunks of one document; a document is one row of the input
    listed = F.array_sort(F.collect_list(F.struct("chunk_index", "start", "kept")))
    per_doc = rows.groupBy("path").agg(listed.alias("c"))
    end = lambda c: c["start"] + F.length(c["kept"])
    done = lambda i: F.when(i == 0, F.lit(0)).otherwise(end(F.get("c", i - 1)))
    fresh = F.transform(
        "c", lambda c, i: F.substring(c["kept"], F.greatest(done(i) - c["start"], F.lit(0)) + 1, F.lit(512))
    )
    order = F.forall(F.transform("c", lambda c, i: c["chunk_index"] == i), lambda ok: ok)
    return per_doc.select(
        "path", F.md5(F.regexp_replace(F.array_join(fresh, ""), "[ \t\n\r]+", "")).alias("hash"), order.alias("in_order")
    )


_NEXT_SQL = r"""
    before AS (SELECT 'doc/' || doc_id AS id, text AS content FROM documents),
    clean AS (
        SELECT 'doc/' || doc_id AS id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS content FROM documents
        UNION ALL SELECT 'bench/' || item_id, text FROM benchmark
    ),
    after AS (SELECT * FROM clean WHERE length(content) >= 200)
"""


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    doc = lambda content: t.spread("documents").select(F.concat(F.lit("doc/"), "doc_id").alias("id"), content.alias("content"))
    clean = union_sources(
        doc(F.trim(F.regexp_replace("text", "[ \t\n\r]+", " "))),
        t.benchmark.select(F.concat(F.lit("bench/"), "item_id").alias("id"), F.col("text").alias("content")),
    )
    return doc(F.col("text")), long_enough(clean, "content")


def _hashed(df: DataFrame) -> DataFrame:
    return df.select("id", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("hash"))


_UPSERTED_SQL = """
    merged AS (SELECT * FROM after UNION ALL SELECT * FROM before WHERE id NOT IN (SELECT id FROM after))
"""


@query("upsert_chunks", f"WITH {_NEXT_SQL}, {_UPSERTED_SQL} SELECT id, length(content) AS n_chars, md5(content) AS hash FROM merged")
def upserted(t: Tables) -> DataFrame:
    return _hashed(upsert(*_snapshots(t)))


@query("prune_stale", f"""
    WITH {_NEXT_SQL}, {_UPSERTED_SQL}
    SELECT id, CASE WHEN id IN (SELECT id FROM after) THEN 'kept' ELSE 'pruned' END AS state FROM merged
""")
def pruned(t: Tables) -> DataFrame:
    before, after = _snapshots(t)
    merged = upsert(before, after)
    return union_sources(
        prune(merged, after).select("id", F.lit("kept").alias("state")),
        stale(merged, after).select("id", F.lit("pruned").alias("state")),
    )


@query("corpus_diff", f"""
    WITH {_NEXT_SQL}
    SELECT id, CASE WHEN b.content IS NULL THEN 'added' WHEN a.content IS NULL THEN 'removed'
                    WHEN a.content = b.content THEN 'kept' ELSE 'changed' END AS state
    FROM before b FULL JOIN after a USING (id)
""")
def diff(t: Tables) -> DataFrame:
    before, after = _snapshots(t)
    return corpus_diff(_hashed(before), _hashed(after))


@query("stored_collection", f"WITH {_NEXT_SQL} SELECT id, length(content) AS n_chars, md5(content) AS hash FROM after")
def stored(t: Tables) -> DataFrame:
    """Write the former snapshot, upsert the next one, prune, and read the stored collection back."""
    before, after = _snapshots(t)
    root = scratch_path(t.spark, "stored")
    write_collection(before, root, buckets=8)
    upsert_collection(after, root)
    prune_collection(after.select("id"), root)
    return _hashed(read_collection(t.spark, root))


@query("union_sources", """
    SELECT 'documents' AS kind, count(*) AS n, count(lang) AS n_lang, count(url) AS n_url FROM (SELECT lang, NULL AS url FROM documents)
    UNION ALL SELECT 'benchmark', count(*), 0, 0 FROM benchmark
    UNION ALL SELECT 'pages', count(*), 0, count(url) FROM pages
""")
def unions(t: Tables) -> DataFrame:
    tagged = lambda df, kind, *columns: df.select(F.lit(kind).alias("kind"), *columns)
    everything = union_sources(
        tagged(t.documents, "documents", "text", "lang"), tagged(t.benchmark, "benchmark", "text"), tagged(t.pages, "pages", "url")
    )
    return everything.groupBy("kind").agg(
        F.count("*").alias("n"), F.count("lang").alias("n_lang"), F.count("url").alias("n_url")
    )


@query("scan_docs", """
    SELECT source, count(*) AS n_lines, sum(n)::BIGINT AS n_chars
    FROM (SELECT source, length(line) AS n FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents))
    GROUP BY 1
""")
def scanned(t: Tables) -> DataFrame:
    """Documents written as text files, a few per file, and found again by the recursive scan."""
    root = scratch_path(t.spark, "scan")
    writer = t.documents.select("source", "text").write.option("maxRecordsPerFile", 100)
    writer.partitionBy("source").text(root)
    files = scan_docs(t.spark, root)
    lines = files.select(
        F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"),
        F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("line"),
    )
    return lines.groupBy("source").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars")
    )
