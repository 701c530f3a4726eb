"""Streaming queries: the tables arrive as file streams and are drained; the result equals the batch query's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.plans.workloads.base import Tables, query
from corpusflow.plans.workloads.history import LATEST_SQL, SESSION_SQL, complete_runs, joined_messages
from corpusflow.session import scratch_path
from corpusflow.streaming.ingest import read_ingested, read_newest, run_available, stored_chunks, stream_ingest, write_batches
from corpusflow.streaming.latest import stream_latest
from corpusflow.streaming.sessions import stream_session

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(t: Tables, table: str) -> DataFrame:
    """A table as a file stream, be it one file or a folder of files: a pattern may name either, a plain path a folder only."""
    return t.spark.readStream.schema(getattr(t, table).schema).parquet(f"{t.folder}/{table}.parque[t]")


@query("stream_ingest", r"""
    SELECT source || '/' || doc_id || '.txt' AS path, md5(regexp_replace(text, '[ \t\n\r]+', '', 'g')) AS hash FROM documents
""")
def ingest(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "stream-ingest")
    path = F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path")
    docs = _stream(t, "documents").select(path, "text", F.col("_metadata.file_modification_time").alias("seen"))
    stream_ingest(docs, f"{root}/chunks", f"{root}/checkpoint")
    stored = read_ingested(t.spark, f"{root}/chunks")
    chunks = F.col("chunks")
    end = lambda c: c["start"] + F.length(c["content"])
    done = lambda i: F.when(i == 0, F.lit(0)).otherwise(end(F.get(chunks, i - 1)))
    fresh = F.transform(
        chunks, lambda c, i: F.substring(c["content"], F.greatest(done(i) - c["start"], F.lit(0)) + 1, F.lit(512))
    )
    return stored.select("path", F.md5(F.regexp_replace(F.array_join(fresh, ""), "[ \t\n\r]+", "")).alias("hash"))


@query("stream_chunk_counts", """
    SELECT count(*) FILTER (trim(text) <> '') AS n_docs, true AS consecutive FROM documents
""")
def chunk_counts(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "stream-chunks")
    path = F.concat("source", F.lit("/"), "doc_id").alias("path")
    docs = _stream(t, "documents").select(path, "text", F.col("_metadata.file_modification_time").alias("seen"))
    stream_ingest(docs, f"{root}/chunks", f"{root}/checkpoint")
    per_doc = stored_chunks(read_ingested(t.spark, f"{root}/chunks")).groupBy("path").agg(
        (F.max("chunk_index") + 1 == F.count("*")).alias("whole")
    )
    return per_doc.agg(F.count("*").alias("n_docs"), F.bool_and("whole").alias("consecutive"))


@query("stream_session", SESSION_SQL)
def session(t: Tables) -> DataFrame:
    """A message's time follows from its conversation and turn, a minute apart."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    root = scratch_path(t.spark, "stream-session")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("turn") + F.col("conv_id"))
    updates = stream_session(_stream(t, "conversations").withColumn("ts", at), max_turns=2)
    run_available(updates, write_batches(f"{root}/sessions"), f"{root}/checkpoint", "update")
    return read_newest(t.spark, f"{root}/sessions", ["conv_id"]).select("conv_id", joined_messages().alias("messages"))


@query("stream_latest", LATEST_SQL)
def latest(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "stream-latest")
    by = ["user_id", "event_type"]
    updates = stream_latest(complete_runs(_stream(t, "events")), by, ["ts", "event_id"], "last_result")
    run_available(updates, write_batches(f"{root}/latest"), f"{root}/checkpoint", "update")
    runs = read_newest(t.spark, f"{root}/latest", by, ["_order"]).drop("_order")
    known = t.events.select(*by).distinct()
    return known.join(runs, by, "left").withColumn("last_result", F.coalesce("last_result", F.lit("NO_RUNS")))
