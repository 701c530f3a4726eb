"""Streams into tables: micro-batches as partitions, and continuous corpus ingest."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusflow.functions.chunking import chunk_text
from corpusflow.sources.partitions import BATCH, newest_rows, write_batch

ForeachBatch = Callable[[DataFrame, int], None]


def run_available(stream: DataFrame, apply: ForeachBatch, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there, in micro-batches, then stop."""
    query = (
        stream.writeStream.foreachBatch(apply).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def write_batches(root: str) -> ForeachBatch:
    """Write each batch's rows, and no others, as a partition of the batch's number; a replayed batch replaces it."""
    return lambda batch, number: write_batch(batch, root, number)


def read_newest(spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The newest row per key of a table written by `write_batches`: the greatest order, then the latest batch."""
    return newest_rows(spark.read.parquet(root), keys, [*order, BATCH]).drop(BATCH)


def newest_documents(batch: DataFrame) -> DataFrame:
    """One version per path: the one seen last. Grouped maximum, so repeats meet before the shuffle."""
    return newest_rows(batch.select("path", "text", "seen"), ["path"], ["seen", "text"])


def ingest_batches(root: str) -> ForeachBatch:
    """Chunk each batch's documents and write one row (path, seen, chunks) per document into the batch's partition."""

    def apply(batch: DataFrame, number: int) -> None:
        docs = newest_documents(batch).select("path", "seen", chunk_text("text").alias("chunks"))
        write_batch(docs, root, number)

    return apply


def stream_ingest(docs: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Ingest a stream of documents (path, text, seen) into the table at `root`.

    A batch writes its own documents only, whatever the table holds. Readers take each path's newest version, so
    a shorter one also removes the tail of an older one.
    """
    return run_available(docs, ingest_batches(root), checkpoint)


def read_ingested(spark: SparkSession, root: str) -> DataFrame:
    """The current documents (path, seen, chunks) of a table written by `stream_ingest`."""
    return read_newest(spark, root, ["path"], ["seen"])


def stored_chunks(documents: DataFrame) -> DataFrame:
    """Chunk rows (id, path, chunk_index, content, start) of documents read by `read_ingested`."""
    exploded = documents.select("path", F.posexplode("chunks").alias("chunk_index", "piece"))
    return exploded.select(
        F.concat_ws("::", "path", "chunk_index").alias("id"), "path", "chunk_index",
        F.col("piece.content").alias("content"), F.col("piece.start").alias("start"),
    )
