"""Embeddings weighted by inverse document frequency: a model fitted over the collection, stored with it, joined by word.

The vector of a text holds, per md5 bucket, the counts of its words times their weights, scaled to unit length. The
model is a table of words; words and weights meet in a join, so the vocabulary may grow with the collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import words

MODEL = "word string, idf double"


def fit_idf(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, idf): ln((1 + n) / (1 + documents with the word)) + 1; the weight of words it does not know has word null.

    Each document sends its different words once, and counts combine before the shuffle.
    """
    n = docs.count()
    known = docs.select(F.explode(F.array_distinct(words(text))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    weight = lambda df: F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) + 1
    rest = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("word"), weight(F.lit(0)).alias("idf"))
    return known.select("word", weight(F.col("df")).alias("idf")).unionByName(rest)


def save_idf(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_idf(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL).parquet(path)


def bucket_of(word: Column, dims: int) -> Column:
    """The bucket of the unweighted embedding: the first eight hex digits of the word's md5."""
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % dims).cast("int")


def _runs(found: str) -> Column:
    """(word, c) of a sorted array that is not empty: a text is one row, so its words are counted where it is read, without a shuffle."""
    at = lambda i: F.get(found, i)
    begins = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
    ends = F.concat(F.slice(begins, 2, F.size(found)), F.array(F.size(found)))
    return F.zip_with(begins, ends, lambda a, b: F.struct(at(a).alias("word"), (b - a).cast("long").alias("c")))


def embed_idf(docs: DataFrame, model: DataFrame, id: str, text: str = "text", dims: int = 64) -> DataFrame:
    """(id, embedding array<float>) of unit length; texts without words have the zero vector. Ids are distinct."""
    counts = docs.select(id, F.sort_array(words(text)).alias("_words")).where(F.size("_words") > 0).select(id, F.inline(_runs("_words")))
    unknown = model.where("word IS NULL").head()["idf"]  # one row
    weighted = counts.join(model.where("word IS NOT NULL"), "word", "left").withColumn("w", F.col("c") * F.coalesce("idf", F.lit(unknown)))
    buckets = weighted.groupBy(id, bucket_of(F.col("word"), dims).alias("b")).agg(F.sum("w").alias("w"))
    # at most one entry per dimension
    held = buckets.groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    at = F.sequence(F.lit(0), F.lit(dims - 1))
    vector = F.transform(at, lambda i: F.coalesce(F.try_element_at("m", i) / F.col("n"), F.lit(0.0)).cast("float"))
    return docs.select(id).join(held, id, "left").select(id, vector.alias("embedding"))
