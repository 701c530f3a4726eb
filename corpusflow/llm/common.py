"""Registration and the few Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def give_back() -> None:
    """Return a Python worker's freed memory to the system; workers stay for the stages that follow."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts go to Python in batches of at most so many rows: the session's setting counts rows, whatever their length."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under a name, with the SQL that gives the same rows."""

    def wrap(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: computed once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """A narrow side of a join, broadcast if it has few rows; larger ones are left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_fold(doc_id, folds: int):
    """True where crc32 of the id as text leaves no remainder: the held-out rows. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fold_of(doc_id, folds: int):
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b): one row (v, label) per vertex, the label being its smallest vertex.

    Every round each vertex takes its smallest neighbour and then that one's; the vertices so joined become one, and
    only edges between different ones go on. The graph shrinks by half at least, so rounds follow the logarithm of its
    size. A round's edges and steps are written tables; the steps are put together at the end.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), f"{name}-edges")
    steps = []
    while not steps or edges.limit(1).count():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a"))
        low = both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("label"))
        low = stored(low, f"{name}-low")
        step = stored(
            low.join(low.select(F.col("v").alias("label"), F.col("label").alias("root")), "label").select("v", F.col("root").alias("label")),
            f"{name}-steps")
        steps.append(step)
        of = lambda side: step.select(F.col("v").alias(side), F.col("label").alias(f"_{side}"))
        edges = stored(
            edges.join(of("a"), "a").join(of("b"), "b").where("_a != _b")
            .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), f"{name}-edges")
    labels = steps[0]
    for step in steps[1:]:
        on = step.select(F.col("v").alias("label"), F.col("label").alias("root"))
        labels = labels.join(on, "label", "left").select("v", F.coalesce("root", "label").alias("label"))
    return stored(labels, f"{name}-labels")
