"""From a table of questions to one routed row with its retrieved context per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.embedding import embed
from corpusflow.operators.retrieval import build_context, rag_sources, retrieve
from corpusflow.operators.routing import AMBIGUOUS, route


def ask(questions: DataFrame, chunks: DataFrame, dictionary=None, override: Column | None = None, dims: int = 64, **search) -> DataFrame:
    """(qid, question, platform, context, sources) of questions (qid, question).

    chunks: id, content, embedding, source, platform. Ambiguous questions are not searched.
    """
    routed = route(questions.select("qid", "question", *([] if override is None else [override.alias("_override")])),
                   "question", dictionary, None if override is None else F.col("_override"))
    routed = routed.select("qid", "question", F.col("label").alias("platform"))
    asked = routed.where(F.col("platform") != AMBIGUOUS).withColumn("qvec", embed(F.col("question"), dims))
    rows = chunks.select("id", "platform", F.col("embedding").alias("vec"))
    hits = retrieve(asked, rows, **search).join(chunks.select("id", "source", "content"), "id")
    return (
        routed.join(build_context(routed, hits), "qid")
        .join(rag_sources(hits), "qid", "left")
    )
